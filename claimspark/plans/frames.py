"""Derived frames over the driver tables, and the same as SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    item = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("event_id").alias("row_id"), "user_id", item.alias("item_id"), F.col("ts").alias("timestamp"), F.col("value").alias("rating"), F.col("event_type").alias("topic"))


INTERACTIONS = """i AS (SELECT event_id AS row_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS item_id, ts AS "timestamp", value AS rating, event_type AS topic FROM events)"""


def sentiment_of(size: str) -> Column:
    m = F.col(size) % 3
    return F.when(m == 0, "positive").when(m == 1, "negative").otherwise("neutral")


#: Rows of a task that shuffles triplets, about: their partitions grow in number with the table, not in size.
TASK_ROWS = 1 << 19


def row_parts(spark: SparkSession, sf_dir: str) -> int:
    """How many partitions triplets have; small tables are spread, too."""
    rows = table(spark, sf_dir, "lineitem").count()
    return max(1, math.ceil(rows / TASK_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / (1 << 15))))


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id (order), pos (part), statement, topic, sentiment of the parts in each order, dealt by row_id."""
    n = row_parts(spark, sf_dir)
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("pos")).repartition(n, "row_id", "pos").distinct()
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("statement"), F.lower("p_type").alias("topic"), sentiment_of("p_size").alias("sentiment"))
    return keys.join(p, F.col("pos") == F.col("p_partkey")).drop("p_partkey").repartition(n, "row_id")


_SENTIMENT = "CASE p_size % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END"
TRIPLETS = f"""t AS (SELECT row_id, pos, p_name AS statement, lower(p_type) AS topic, {_SENTIMENT} AS sentiment
  FROM (SELECT DISTINCT l_orderkey AS row_id, l_partkey AS pos FROM lineitem) JOIN part ON pos = p_partkey)"""


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("sid"), F.col("p_name").alias("statement"), F.lower("p_type").alias("topic"), sentiment_of("p_size").alias("sentiment"))


VOCABULARY = f"v AS (SELECT p_partkey AS sid, p_name AS statement, lower(p_type) AS topic, {_SENTIMENT} AS sentiment FROM part)"


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, reference (a user's turn), prediction (the assistant's next turn)."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    a = c.filter("role = 'assistant'").select(F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("text").alias("prediction"))
    joined = u.join(a, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")))
    return joined.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "reference", "prediction")


OUTPUTS = """o AS (SELECT u.conv_id * 1000 + u.turn AS row_id, u.text AS reference, a.text AS prediction
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement pairs of an order with probabilities made of quantity, discount and tax."""
    x = table(spark, sf_dir, "lineitem")
    a, b, c = F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10
    s = a + b + c
    from ..functions.text import relation

    cols = {"p2r_entail": a / s, "p2r_neutral": b / s, "p2r_contradiction": c / s, "r2p_entail": b / s, "r2p_neutral": c / s, "r2p_contradiction": a / s}
    out = x.select(F.col("l_orderkey").alias("row_index"), F.col("l_partkey").alias("pred_sid"), F.col("l_suppkey").alias("ref_sid"), *[v.alias(k) for k, v in cols.items()])
    return out.withColumns({f"{d}_label": relation(*[F.col(f"{d}_{k}") for k in ("entail", "neutral", "contradiction")]) for d in ("p2r", "r2p")})


PAIR_SCORES = """x AS (SELECT l_orderkey AS row_index, l_partkey AS pred_sid, l_suppkey AS ref_sid, l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 10 AS c FROM lineitem),
 s AS (SELECT row_index, pred_sid, ref_sid, a / (a + b + c) AS pe, b / (a + b + c) AS pn, c / (a + b + c) AS pc, b / (a + b + c) AS re, c / (a + b + c) AS rn, a / (a + b + c) AS rc FROM x)"""


def word_list(text: str) -> str:
    """SQL for the words of a text."""
    return f"list_filter(string_split_regex(trim({text}), '\\s+'), lambda w: w <> '')"
