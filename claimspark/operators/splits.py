"""Splits of interactions and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ids import numbered


def _fractions(*parts: float) -> tuple[float, ...]:
    total = sum(parts)
    return parts if total == 1.0 else tuple(p / total for p in parts)


def active_users(df: DataFrame, least: int, user: str = "user_id") -> DataFrame:
    """Rows of users with at least `least` rows."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(user))).filter(F.col("_n") >= least).drop("_n")


def temporal_split(
    df: DataFrame, train: float = 0.8, evaluation: float = 0.1, test: float = 0.1, least: int = 5, user: str = "user_id", order: tuple[str, ...] = ("timestamp", "row_id")
) -> DataFrame:
    """Adds `split` to the rows of users with at least `least`, by place in time.

    Cuts are whole numbers below n * fraction in double precision. If a user's test part would
    be empty, the last two rows become evaluation and test.
    """
    tr, ev, _ = _fractions(train, evaluation, test)
    w = Window.partitionBy(user)
    ranked = df.withColumn("_n", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy(*order))).filter(F.col("_n") >= least)
    a, b = F.floor(F.col("_n") * F.lit(tr)), F.floor(F.col("_n") * F.lit(tr + ev))
    short = F.col("_n") == b
    a, b = F.when(short, F.col("_n") - 2).otherwise(a), F.when(short, F.col("_n") - 1).otherwise(b)
    return ranked.withColumn("split", F.when(F.col("_at") <= a, "train").when(F.col("_at") <= b, "eval").otherwise("test")).drop("_n", "_at")


def without_cold_items(split: DataFrame, item: str = "item_id") -> DataFrame:
    """Leaves out evaluation and test rows whose item does not occur in the training part."""
    known = split.filter("split = 'train'").select(item).distinct()
    rest = split.filter("split <> 'train'").join(known, item, "left_semi")
    return split.filter("split = 'train'").unionByName(rest)


def _parted(at: Column, n: Column, evaluation: float, test: float, eval_first: bool) -> Column:
    e, t = F.floor(n * F.lit(evaluation)), F.floor(n * F.lit(test))
    if eval_first:
        return F.when(at < e, "eval").when(at < e + t, "test").otherwise("train")
    return F.when(at < n - e - t, "train").when(at < n - t, "eval").otherwise("test")


def user_split(users: DataFrame, evaluation: float = 0.1, test: float = 0.1, order: str = "idx") -> DataFrame:
    """Users in order: the first fraction evaluates, the next tests, the rest trains."""
    total = users.agg(F.count("*").alias("_total"))
    return numbered(users, [order], "_at").crossJoin(F.broadcast(total)).withColumn("split", _parted(F.col("_at"), F.col("_total"), evaluation, test, True)).drop("_at", "_total")


def activity_bins(counts: DataFrame, count: str = "n", quantiles: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Adds `bin`: right-closed intervals between linear quantiles; equal edges are one."""
    edges = counts.agg(F.array_distinct(F.percentile(count, list(quantiles))).alias("_edges"))
    inner = F.slice(F.col("_edges"), 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    binned = counts.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner, lambda e: F.col(count) > e)))
    return binned.drop("_edges")


def stratified_user_split(df: DataFrame, evaluation: float = 0.1, test: float = 0.1, seed: int = 42, user: str = "user_id") -> DataFrame:
    """user, n, bin, split: users of like activity are shuffled by a digest and parted."""
    binned = activity_bins(df.groupBy(user).agg(F.count("*").alias("n")))
    digest = F.md5(F.concat(F.col(user).cast("string"), F.lit(f"#{seed}")).cast("binary"))
    placed = numbered(binned.withColumn("_o", digest), ["bin", "_o", user], "_all", ties=False)
    bins = F.broadcast(placed.groupBy("bin").agg(F.min("_all").alias("_first"), F.count("*").alias("_n")))  # a row a bin
    shuffled = placed.join(bins, "bin").withColumn("_at", F.col("_all") - F.col("_first"))
    return shuffled.select(user, "n", "bin", _parted(F.col("_at"), F.col("_n"), evaluation, test, False).alias("split"))


def hash_split(df: DataFrame, key: str, train: float = 0.8, evaluation: float = 0.1, seed: int = 0) -> DataFrame:
    """Exact sizes int(n * fraction) in the order of a digest of the key."""
    n = df.agg(F.count("*").alias("_total"))
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")).cast("binary"))
    placed = numbered(df.withColumn("_order", order), ["_order", key], "_at").crossJoin(F.broadcast(n))
    a = F.floor(F.col("_total") * F.lit(train))
    b = a + F.floor(F.col("_total") * F.lit(evaluation))
    return placed.withColumn("split", F.when(F.col("_at") < a, "train").when(F.col("_at") < b, "eval").otherwise("test")).drop("_order", "_at", "_total")


def split_sizes(split: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(user).alias("users"), F.count_distinct(item).alias("items"))
