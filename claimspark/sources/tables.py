"""Readers and writers. Every reader has an explicit schema; none infers one."""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TRIPLETS
from ..operators.ids import require_columns
from .scratch import new_scratch, scratch_path

__all__ = ["new_scratch", "scratch_path"]

INTERACTIONS = f"row_id bigint, user_id string, item_id string, timestamp bigint, rating double, review string, review_title string, user_name string, statements {TRIPLETS}, statement_ids array<bigint>, topic_ids array<bigint>, sentiments array<int>"
REVIEWS = "overall double, unixReviewTime bigint, reviewText string, reviewerName string, reviewerID string, asin string, summary string, helpful array<int>, reviewTime string, _corrupt_record string"
METADATA = "asin string, title string, description string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Exports with a header and doubled quotes, blanks around values kept. Null and empty text are both read back as null."""
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_statements(spark: SparkSession, path: str, index: str | None = "sid") -> DataFrame:
    """sid, statement, topic, sentiment. The unnamed first column is the id."""
    df = read_csv(spark, path, f"{index or 'sid'} bigint, statement string, topic string, sentiment string, frequency bigint")
    name = lambda c: F.lower(F.trim(c)).alias(c)
    return df.select(F.col(index or "sid").alias("sid"), "statement", name("topic"), name("sentiment"))


def read_predictions(spark: SparkSession, path: str, schema: str = "row_id bigint, reference string, prediction string") -> DataFrame:
    """Both texts are required; missing ones are empty."""
    df = require_columns(read_csv(spark, path, schema), ["reference", "prediction"])
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("reference", "prediction")})


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review lines in JSON, renamed; lines that are no JSON keep their text in _corrupt_record."""
    from ..functions.taxonomy import REVIEW_COLUMNS

    return spark.read.schema(REVIEWS).option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumnsRenamed(REVIEW_COLUMNS)


def _literal_text(value: object) -> str | None:
    """A value as the text that JSON's reader would give it."""
    if value is None or isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except (TypeError, ValueError):
        return repr(value)


def _literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines as dictionaries in Python's notation: None, True, u'..', escapes, any quotes; with why a line is none."""
    for batch in batches:
        rows = []
        for line in batch.column(0).to_pylist():
            found, problem = {}, None
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")  # unknown escapes keep their backslash
                    read = ast.literal_eval(line.strip())
                if isinstance(read, dict) and read.get("asin") is not None:
                    found = read
                else:
                    problem = "no object with an asin"
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError) as e:
                problem = type(e).__name__
            rows.append([*(_literal_text(found.get(c)) for c in ("asin", "title", "description")), line, problem])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 5, names=["asin", "title", "description", "line", "problem"])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """asin, title, description of one object a line, in JSON or as a Python literal.

    Lines that are neither, or have no asin, are in rejected_metadata; blank lines are skipped.
    """
    return _metadata(spark, path)[0]


def rejected_metadata(spark: SparkSession, path: str) -> DataFrame:
    """line, problem: what read_metadata could not read."""
    return _metadata(spark, path)[1]


def _metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", METADATA).alias("m"))
    strict = parsed.filter("m.asin is not null").select("m.*")
    rest = parsed.filter("m.asin is null").select("value").mapInArrow(_literals, f"{METADATA}, line string, problem string")
    return strict.unionByName(rest.filter("problem is null").drop("line", "problem")), rest.filter("problem is not null").select("line", "problem")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """domain, topic from one JSON object of lists."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("domain", "topics")).select("domain", F.explode("topics").alias("topic"))


def write_id_map(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_user_lists(users: DataFrame, path: str) -> None:
    """One folder for each split, so that readers prune by it."""
    users.write.mode("overwrite").partitionBy("split").parquet(path)


def write_metrics(metrics: DataFrame, path: str, name: str, version: str, overwrite: bool = False) -> bool:
    """Writes metrics of one name and input version; False where they are stored already."""
    spark, place = metrics.sparkSession, f"{path}/name={name}/version={version}"
    if not overwrite and _exists(spark, place):
        return False
    metrics.coalesce(1).write.mode("overwrite").json(place)
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(path)
    except AnalysisException:
        return False
    return True


def append_json(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


PROMPTS = "row_id bigint, prompt string"


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """row_id, prompt from JSON lines."""
    return spark.read.schema(PROMPTS).json(path)


def append_generations(prompts: DataFrame, path: str, generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Generates for the prompts that the written output does not have, appends, and reads all of it again.

    generate adds a column `output` to rows of row_id and prompt.
    """
    spark, schema = prompts.sparkSession, f"{PROMPTS}, output string"
    left = unprocessed(prompts, spark.read.schema(schema).json(path)) if _exists(spark, path) else prompts
    append_json(generate(left).select("row_id", "prompt", "output"), path)
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str, most: int = 10000) -> DataFrame:
    """row_id, text of the first lines of a text file, in file order."""
    lines = spark.read.text(path).withColumn("row_id", F.monotonically_increasing_id())
    return lines.orderBy("row_id").limit(most).select("row_id", F.col("value").alias("text"))


def read_corpus(spark: SparkSession, path: str, column: str | None = None, most: int = 10000) -> DataFrame:
    """text: the first lines of a text file, trimmed, or a whole column of CSV files with a header.

    Columns are found by name in the first header, all files must have the same. A column that
    is not there raises ValueError. Blank cells are null.
    """
    if column is None:
        return read_lines(spark, path, most).select(F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))
    table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return require_columns(table, [column]).select(F.col(f"`{column}`").alias("text"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """row_id from files of blank-separated row numbers."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("v")).select(F.col("v").try_cast("bigint").alias("row_id")).filter("row_id is not null")


def read_template(spark: SparkSession, path: str) -> str:
    """A prompt template, trimmed."""
    return spark.read.text(path, wholetext=True).first()[0].strip()


def unprocessed(inputs: DataFrame, done: DataFrame, key: str = "row_id") -> DataFrame:
    """Inputs whose key the written output does not have."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")
