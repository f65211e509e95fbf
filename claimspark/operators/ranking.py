"""Rating, ranking and threshold metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ids


def rating_errors(df: DataFrame, prediction: str = "prediction", rating: str = "rating") -> DataFrame:
    d = F.col(prediction) - F.col(rating)
    return df.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def rating_range(df: DataFrame, rating: str = "rating") -> DataFrame:
    return df.agg(F.avg(rating).alias("mean"), F.min(rating).alias("min"), F.max(rating).alias("max"))


def clipped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties by half.

    Scores are counted by value first, so running sums go over distinct scores.
    """
    by = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    won = ids.running_sums(by, score, {"_below": "n"}).withColumn("w", F.col("p") * (F.col("_below") + F.col("n") / 2))
    return won.agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("n")).alias("auc"))


def top_k(scores: DataFrame, k: int, group: str = "user_id", item: str = "item_id", score: str = "score") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(score), item)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def truth_sets(df: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    return df.groupBy(user).agg(F.array_sort(F.collect_set(item)).alias("items"))


def ranking_metrics(ranked: DataFrame, truth: DataFrame, k: int, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Per user: recall, precision, mrr (over all hits), ndcg at k, and `rows`, its rows in the truth.

    ranked has user, item, rank from 1; truth may repeat pairs. Users without a ranking get 0.
    """
    rows = truth.groupBy(user).agg(F.count_distinct(item).alias("size"), F.count("*").alias("rows"))
    hit = ranked.filter(F.col("rank") <= k).join(truth.select(user, item).distinct(), [user, item])
    hits = hit.groupBy(user).agg(F.count("*").alias("hits"), F.sum(1 / F.col("rank")).alias("mrr"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("size"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    joined = rows.join(hits, user, "left").na.fill(0, ["hits", "mrr", "dcg"])
    return joined.select(user, "rows", (F.col("hits") / F.col("size")).alias("recall"), (F.col("hits") / k).alias("precision"), "mrr", (F.col("dcg") / ideal).alias("ndcg"))


def ranking_summary(metrics: DataFrame, per_interaction: bool = True) -> DataFrame:
    """Means over interaction rows, or over users."""
    w = F.col("rows") if per_interaction else F.lit(1)
    suffix = "_per_interaction" if per_interaction else "_per_user"
    return metrics.agg(*[(F.sum(F.col(m) * w) / F.sum(w)).alias(m + suffix) for m in ("recall", "precision", "mrr", "ndcg")])


def percentiles(df: DataFrame, score: str, steps: int) -> DataFrame:
    """One row with t: the exact percentiles 0/steps, 1/steps ... of a column, linear between ranks.

    Distinct scores carry the ranks that they cover; only those that a percentile falls on go on.
    """
    by = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("c"))
    total = by.agg(F.sum("c").alias("n"))
    ranked = ids.running_sums(by, "s", {"first": "c"}).crossJoin(F.broadcast(total)).withColumn("after", F.col("first") + F.col("c"))
    last = F.greatest(F.col("n") - 1, F.lit(1))
    low, high = F.greatest(F.lit(0), F.floor(F.col("first") * steps / last) - 2 - F.ceil(F.lit(steps) / last)), F.least(F.lit(steps - 1), F.ceil(F.col("after") * steps / last) + 2)
    hit = ranked.filter(low <= high).select("s", "first", "after", "n", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("i"))
    at = (F.col("n") - 1) * (F.col("i") / F.lit(steps))
    below, above = F.floor(at), F.ceil(at)
    covers = lambda rank: (rank >= F.col("first")) & (rank < F.col("after"))
    share = F.when(covers(below) & covers(above), F.lit(1.0)).when(covers(below), above - at).when(covers(above), at - below)
    parts = hit.withColumn("part", share).filter(F.col("part").isNotNull()).groupBy("i").agg(F.sum(F.col("part") * F.col("s")).alias("t"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("t"))


def best_threshold(df: DataFrame, score: str = "score", label: str = "label", steps: int = 500) -> DataFrame:
    """Among the scores' percentiles, the last one of best balanced accuracy for score > threshold.

    Two small tables meet: the thresholds, and counts by the number of thresholds below a score.
    """
    cuts = percentiles(df, score, steps)
    placed = df.crossJoin(F.broadcast(cuts)).withColumn("above", F.aggregate("t", F.lit(0), lambda n, t: n + (F.col(score) > t).cast("int")))
    counts = placed.groupBy("above").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    # percentiles ascend, so a score is over threshold i if more than i of them are below it
    listed = counts.agg(F.collect_list(F.struct("above", "p", "n")).alias("c"), F.sum("p").alias("ps"), F.sum("n").alias("ns"))
    each = cuts.select(F.posexplode("t").alias("i", "threshold")).crossJoin(F.broadcast(listed))
    tp = F.aggregate(F.filter("c", lambda x: x["above"] > F.col("i")), F.lit(0).cast("bigint"), lambda s, x: s + x["p"])
    tn = F.aggregate(F.filter("c", lambda x: x["above"] <= F.col("i")), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    scored = each.withColumn("accuracy", (F.coalesce(F.try_divide(tp, F.col("ps")), F.lit(0.0)) + F.coalesce(F.try_divide(tn, F.col("ns")), F.lit(0.0))) / 2)
    return scored.agg(F.max_by("threshold", F.struct(F.round("accuracy", 12), "i")).alias("threshold"), F.max("accuracy").alias("accuracy"))


def over_threshold(c: Column, threshold: float | Column) -> Column:
    return (c > threshold).cast("int")


def ranking_to_pairs(ranking: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """user_id, item_id, label from rows of a positive item and negative items."""
    kept = ranking.join(users.select("user_id").distinct(), "user_id", "left_semi") if users is not None else ranking
    positive = kept.select("user_id", F.col("positive_item_id").alias("item_id"), F.lit(1).alias("label"))
    return positive.unionByName(kept.select("user_id", F.explode("negative_item_ids").alias("item_id"), F.lit(0).alias("label")))


def implicit_recommender(df: DataFrame, k: int, user: str = "user_id", item: str = "item_id", rank: int = 16, seed: int = 0) -> DataFrame:
    """user, item, rank by alternating least squares on interaction counts."""
    from pyspark.ml.recommendation import ALS

    counts = df.groupBy(F.col(user).cast("int").alias(user), F.col(item).cast("int").alias(item)).agg(F.count("*").cast("float").alias("n"))
    model = ALS(rank=rank, maxIter=5, implicitPrefs=True, userCol=user, itemCol=item, ratingCol="n", seed=seed).fit(counts)
    found = model.recommendForAllUsers(k).select(user, F.posexplode("recommendations").alias("pos", "r"))
    return found.select(F.col(user).cast("long").alias(user), F.col(f"r.{item}").cast("long").alias(item), (F.col("pos") + 1).alias("rank"))
