"""Token counts by a digest cache.

A text's key is the SHA-256 of its normal form; a tokenizer's key is the SHA-256 of its
serialised definition with the encoder's revision, so that counts of an earlier encoder are not
taken over. Stored counts are joined by both; only distinct texts without a stored
count are encoded, and their counts are appended to the cache table.

The normal form must have the count of the text itself. Where a tokenizer only ends words at
white space, runs of ASCII white space become one space and go at both ends: no word, no token
that is looked for in the text as it stands, and no composition of characters reaches over them.
Other tokenizers take the text as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"
DEFAULT_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file: any change of vocabulary, merges or rules is a new version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.load(path)
        for part in common.slices(batches):
            counts = tokenizer.counts(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts)), part.column("content"), pa.array(counts, pa.int64())],
                names=["tokenizer", "content", "n_tokens"],
            )

    return run


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table at path; made empty where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException:
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
        return spark.read.schema(CACHE_SCHEMA).parquet(path)


def count_tokens(
    docs: DataFrame,
    cache_path: str,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: 0 bytes and the count of "". Repeated rows and null ids each
    give their own row. Other columns are ignored. An empty table gives an empty result.
    The cache holds each (tokenizer, content) once as long as one writer appends at a time; where
    several did, one of the equal counts is taken.
    Work: one shuffle of the distinct texts, pre-aggregated in each task, so that copies are
    neither moved nor encoded; then a join of narrow rows, whose hot keys Spark may split.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path(DEFAULT_TOKENIZER)
    plain = bpe.blanks_do_not_count(path)
    version = f"{tokenizer_digest(path)}-{bpe.REVISION}" + ("-blanks" if plain else "")
    text = F.coalesce(F.col(text_col), F.lit(""))
    form = F.trim(F.regexp_replace(text, r"[\x09-\x0D ]+", " ")) if plain else text
    keyed = docs.select(F.col(id_col), text.alias("text"), F.unhex(F.sha2(form, 256)).alias("content"))
    cache = open_cache(spark, cache_path)
    stored = cache.filter(F.col("tokenizer") == version)
    distinct = keyed.groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(stored.select("content"), "content", "left_anti")
    common.map_batches(misses, _encode(path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version)
    rows = keyed.select(id_col, F.octet_length("text").cast("long").alias("n_bytes"), "content")
    counts = stored.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    return rows.join(counts, "content", "left").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is kept at token-counts under spark.checkpoint.dir and read by later runs."""
    docs = common.read_table(spark, sf_dir, "documents")
    return count_tokens(docs, f"{common.shared_base(spark)}/token-counts")


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
