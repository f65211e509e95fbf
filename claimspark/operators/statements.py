"""Triplets: audit, repair, ids, frequencies, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written
from . import ids


def exploded(df: DataFrame, triplets: str = "statements", key: str = "row_id") -> DataFrame:
    """One row a triplet: key, pos, statement, topic, sentiment. Null and empty lists give none."""
    return df.select(key, F.posexplode(triplets).alias("pos", "t")).select(key, "pos", "t.statement", "t.topic", "t.sentiment")


def audit(triplets: DataFrame, topics: list[str], sentiments: list[str]) -> DataFrame:
    """Counts of each triplet with its class: correct, wrong topic, wrong sentiment or both."""
    topic, sentiment = F.col("topic").isin(topics), F.col("sentiment").isin(sentiments)
    kind = F.when(topic & sentiment, "correct").when(sentiment, "wrong_topic").when(topic, "wrong_sentiment").otherwise("both_wrong")
    known = triplets.na.fill("", ["topic", "sentiment"])
    return known.withColumn("class", kind).groupBy("class", "topic", "sentiment", "statement").agg(F.count("*").alias("freq"))


def topic_table(counts: DataFrame, sentiments: list[str]) -> DataFrame:
    """Topics by sentiment: distinct statements and their frequencies, with totals; empty cells are 0."""
    wide = counts.groupBy("topic").pivot("sentiment", sentiments).agg(F.count(F.lit(1)).alias("unique"), F.sum("freq").alias("total")).na.fill(0)
    for kind in ("unique", "total"):
        wide = wide.withColumn(f"TOTAL_{kind}", sum((F.col(f"{s}_{kind}") for s in sentiments), F.lit(0)))
    return wide


def with_total_row(table: DataFrame, name: str = "TOTAL") -> DataFrame:
    """The topic table and a row of its columns' sums."""
    sums = table.agg(*[F.sum(c).alias(c) for c in table.columns if c != "topic"])
    return table.unionByName(sums.withColumn("topic", F.lit(name)))


def nonempty(df: DataFrame, triplets: str = "statements") -> DataFrame:
    """Rows with at least one triplet; null and empty lists go."""
    return df.filter(F.size(F.coalesce(F.col(triplets), F.array())) > 0)


def error_share(counts: DataFrame, wrong: str = "wrong_topic") -> DataFrame:
    """Percentage of triplets of a wrong class among those and the correct ones."""
    n = lambda c: F.coalesce(F.sum(F.when(F.col("class") == c, F.col("freq"))), F.lit(0))
    return counts.agg((F.try_divide(n(wrong), n(wrong) + n("correct")) * 100).alias("percent"))


def unanimous(votes: DataFrame, labelers: int = 3) -> DataFrame:
    """wrong_topic, topic where all labelers agree; null votes never count."""
    agreed = votes.groupBy("wrong_topic").agg(F.count("topic").alias("n"), F.count_distinct("topic").alias("nd"), F.min("topic").alias("topic"))
    return agreed.filter((F.col("n") == labelers) & (F.col("nd") == 1)).select("wrong_topic", "topic")


def repaired(counts: DataFrame, repairs: DataFrame) -> DataFrame:
    """Frequencies after repaired topics have been folded into the others."""
    joined = counts.join(repairs.select(F.col("wrong_topic").alias("_w"), F.col("topic").alias("_r")), F.col("topic") == F.col("_w"), "left")
    fixed = joined.withColumn("topic", F.coalesce("_r", "topic"))
    return fixed.groupBy("statement", "topic", "sentiment").agg(F.sum("freq").alias("freq"))


def frequent(counts: DataFrame, least: int = 10) -> DataFrame:
    return counts.groupBy("topic").agg(F.sum("freq").alias("freq")).filter(F.col("freq") >= least)


def rare_examples(counts: DataFrame, k: int = 4) -> DataFrame:
    """The k least frequent statements of each topic and sentiment, ties by statement."""
    w = Window.partitionBy("topic", "sentiment").orderBy("freq", "statement")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def normalised(triplets: DataFrame, repairs: DataFrame | None = None, topics: list[str] | None = None, sentiments: list[str] | None = None) -> DataFrame:
    """Topics in their normal form and repaired; with accepted topics, other triplets go."""
    out = triplets.withColumn("topic", T.topic_name(F.col("topic"))).withColumn("sentiment", F.lower(F.trim("sentiment")))
    if repairs is not None:
        out = out.join(repairs.select(F.col("wrong_topic").alias("_w"), F.col("topic").alias("_r")), F.col("topic") == F.col("_w"), "left")
        out = out.withColumn("topic", F.coalesce("_r", "topic")).drop("_w", "_r")
    if topics is not None:
        out = out.filter(F.col("topic").isin(topics))
    return out.filter(F.col("sentiment").isin(sentiments)) if sentiments is not None else out


def vocabulary(triplets: DataFrame, key: str = "row_id") -> DataFrame:
    """sid (by first appearance), statement, topic, sentiment, freq."""
    name = F.struct("statement", "topic", "sentiment")
    seen = triplets.groupBy("statement", "topic", "sentiment").agg(F.count("*").alias("freq"), F.min(F.struct(key, "pos")).alias("_f"))
    flat = seen.select(name.alias("_e"), "freq", F.col(f"_f.{key}").alias("_k"), F.col("_f.pos").alias("_p"))
    return ids.numbered(flat, ["_k", "_p", "_e"], "sid", ties=False).select("sid", "_e.*", "freq")


def with_ids(triplets: DataFrame, vocabulary: DataFrame, topics: DataFrame | None = None, key: str = "row_id", parts: int | None = None) -> DataFrame:
    """Per row the aligned lists statement_ids, topic_ids and sentiments, in order of appearance.

    With parts, lists are made in so many partitions, whatever the session's setting.
    """
    known = vocabulary.select("sid", "statement", "topic", "sentiment")
    joined = triplets.join(known, ["statement", "topic", "sentiment"])
    topic_id = F.lit(None).cast("int")
    if topics is not None:
        joined, topic_id = joined.join(topics.select("topic", "topic_id"), "topic", "left"), F.col("topic_id")
    joined = joined.repartition(parts, key) if parts else joined
    rows = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "sid", topic_id.alias("tid"), T.sentiment_number(F.col("sentiment")).alias("sent")))).alias("_l"))
    pick = lambda f: F.transform("_l", lambda x: x[f])
    return rows.select(key, pick("sid").alias("statement_ids"), pick("tid").alias("topic_ids"), pick("sent").alias("sentiments"))


def processed(df: DataFrame, cells: str = "statements", repairs: DataFrame | None = None, topics: list[str] | None = None, sentiments: list[str] | None = None, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """From extracted text to ids in one flow: the rows (key, statements, statement_ids) and their vocabulary.

    Cells are read as JSON or as a literal list. Cells that are null or unreadable stay null in
    both columns; readable ones that keep no triplet get empty lists; one object alone is a list
    of one. Triplets without a statement go. Cells are read once, into a written table. Without accepted topics (sentiments) all others stay, missing ones as null.
    """
    read = written(df.select(key, T.parse_triplets(F.col(cells), literals=True).alias("_t")), "triplets")
    flat = read.select(key, F.posexplode("_t").alias("pos", "t")).filter(F.coalesce("t.statement", F.lit("")) != "")
    named = normalised(flat.select(key, "pos", T.topic_name(F.col("t.statement")).alias("statement"), "t.topic", "t.sentiment"), repairs, topics, sentiments)
    words = vocabulary(named, key)
    v = words.select("sid", F.col("statement").alias("_s"), F.col("topic").alias("_o"), F.col("sentiment").alias("_m"))
    same = (F.col("statement") == F.col("_s")) & F.col("topic").eqNullSafe(F.col("_o")) & F.col("sentiment").eqNullSafe(F.col("_m"))
    triplet = F.struct("statement", "topic", "sentiment")
    lists = named.join(v, same).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "sid", triplet.alias("t")))).alias("_l"))
    rows = read.select(key, F.col("_t").isNotNull().alias("_read")).join(lists, key, "left")
    pick = lambda f: F.when(F.col("_read"), F.coalesce(F.transform("_l", lambda x: x[f]), F.array()))
    return rows.select(key, pick("t").alias("statements"), pick("sid").alias("statement_ids")), words


def looked_up(df: DataFrame, vocabulary: DataFrame, id_list: str = "statement_ids", sentiments: str | None = None, key: str = "row_id") -> DataFrame:
    """key, pos, sid, statement, topic, sentiment of listed ids; unknown ids are skipped.

    Sentiments of the row count if there are as many as ids; else those of the vocabulary.
    """
    sids = F.transform(id_list, lambda x: x.try_cast("bigint"))  # lists of texts are read as numbers
    own = F.col(sentiments) if sentiments else F.array().cast("array<int>")
    use = (F.size(own) == F.size(sids)) & (F.size(sids) > 0)
    zipped = F.transform(sids, lambda s, i: F.struct(s.alias("sid"), F.when(use, T.sentiment_of_number(F.get(own, i))).alias("own")))
    flat = df.select(key, F.posexplode(zipped).alias("pos", "z")).select(key, "pos", "z.sid", "z.own")
    return flat.join(vocabulary.select("sid", "statement", "topic", "sentiment"), "sid").select(key, "pos", "sid", "statement", "topic", F.coalesce("own", "sentiment").alias("sentiment"))


def explanations(df: DataFrame, vocabulary: DataFrame, id_list: str = "statement_ids", sentiments: str | None = "sentiments", key: str = "row_id", parts: int | None = None) -> DataFrame:
    """key, explanation: the paragraph of a row's statements; "" for rows without any.

    Clauses are made once for each statement of the vocabulary, not for each use. With parts, a
    row's clauses are put together in so many partitions, whatever the session's setting.
    """
    clauses = vocabulary.withColumn("statement", T.clause(F.col("statement")))
    said = looked_up(df, clauses, id_list, sentiments, key)
    said = said.repartition(parts, key) if parts else said
    once = said.groupBy(key, "sentiment", F.lower("statement").alias("_k")).agg(F.min(F.struct("pos", "statement")).alias("_f"))
    lists = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_f.pos").alias("pos"), F.col("_f.statement").alias("clause"), "sentiment"))).alias("_s"))
    return df.select(key).join(lists, key, "left").select(key, T.paragraph_of_clauses(F.col("_s")).alias("explanation"))


def extraction_failures(df: DataFrame, triplets: str = "statements") -> DataFrame:
    return df.agg(F.count_if(F.col(triplets).isNull()).alias("failures"), F.try_divide(F.count_if(F.col(triplets).isNull()), F.count("*")).alias("rate"))


def length_summary(vocabulary: DataFrame, column: str = "statement") -> DataFrame:
    n = F.char_length(column)
    return vocabulary.agg(F.avg(n).alias("avg_length"), F.max(n).alias("max_length"), F.min(n).alias("min_length"), F.percentile(n, 0.5).alias("median_length"))
