"""Pairs of statements, and of statements with documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def bipartite(reference: DataFrame, predicted: DataFrame, key: str = "row_index", match: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of a row's reference and predicted statements; `match` columns must be equal.

    What must match joins the key, so that no pair is made only to be dropped. Columns other
    than keys get the prefixes ref_ and pred_.
    """
    keys = [key, *match]
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}{c}") for c in df.columns if c not in keys])
    return side(reference, "ref_").join(side(predicted, "pred_"), keys)


def documents_of(statements: DataFrame, documents: DataFrame, key: str = "row_id") -> DataFrame:
    """Each statement beside its row's document."""
    return statements.join(documents, key)


def item_documents(metadata: DataFrame, statements: DataFrame, item: str = "item_id") -> DataFrame:
    """item, document: title, description and the item's distinct statements by id."""
    said = statements.select(item, "sid", "statement").distinct().groupBy(item).agg(F.array_sort(F.collect_list(F.struct("sid", "statement"))).alias("_s"))
    text = F.concat_ws(". ", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("description"), F.lit("")), F.array_join(F.transform("_s", lambda x: x["statement"]), ". "))
    return metadata.join(said, item, "left").select(item, text.alias("document"))


def chunked(documents: DataFrame, text: str = "document", size: Column | int | None = None) -> DataFrame:
    """Adds chunk_id and chunk. By default the number of chunks of a text is its sentences a chunk."""
    chunks = T.sentence_chunks(F.col(text), T.chunk_count(F.col(text)) if size is None else size)
    return documents.select("*", F.posexplode(chunks).alias("chunk_id", "chunk"))


def scored_once(pairs: DataFrame, score, premise: str = "premise", hypothesis: str = "hypothesis") -> DataFrame:
    """Scores each distinct pair of texts once and joins the result to all rows that have it."""
    distinct = pairs.select(premise, hypothesis).distinct()
    return pairs.join(score(distinct), [premise, hypothesis])
