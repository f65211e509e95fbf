"""The corpus pipeline: filters, de-duplicates, mixes and packs the documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import common, jaccard, languages, mixing, packing, repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents farther than this from every language profile are rejected.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or far from every language; lang becomes the prediction."""
    profiles = languages.learn_profiles(docs.filter(~languages.held_out()), "text", "lang", "doc_id")
    found = languages.identify(docs, profiles, keep=["text", "source", "n_chars"])
    kept = found.filter((F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate component, that of the smallest id; null ids are after all others.

    Rows are told apart even where ids are null or repeated. Texts without words stay.
    """
    return jaccard.without_near_duplicates(docs, keep=("lang", "source", "n_chars")).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeats of smaller documents out of texts; documents of which nothing is left go.

    Equal ids are not smaller than each other, null ids are after all others; null texts count as empty.
    """
    cut = repeats.remove_repeats(docs, keep_text=True, keep=("lang", "source"))
    text = F.col("kept_text")
    return cut.filter((F.col("n_removed") == 0) | (F.trim(text) != "")).select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the supply in words, by the production weights, each document at most once.

    The document in which a leaf's prefix ends is kept whole, so that a leaf may exceed its
    budget by less than that document. Null names count as empty ones.
    """
    return mixing.mix(docs, mixing.WEIGHTS, 0.5, mixing.document_tree(), seed=1).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; null texts count as empty, repeated ids are pieces of their own."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]
#: Neither profiles, nor the distances to them, nor tokenizers can be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
