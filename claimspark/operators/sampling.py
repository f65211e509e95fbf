"""Negative and proportional sampling in the order of digests, so that results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ids import numbered


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws("#", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def capped(df: DataFrame, source: str, most: int, key: str, seed: int = 0) -> DataFrame:
    """At most `most` rows of each source, in the order of a digest."""
    return _first(df.withColumn("_o", _digest(F.col(key), seed)), source, ["_o", key], most).drop("_o")


def first_of_source(df: DataFrame, source: str, most: int, order: str = "row_id") -> DataFrame:
    return _first(df, source, [order], most)


def _first(df: DataFrame, source: str, order: list[str], most: int) -> DataFrame:
    """By ranks over all rows, so that a source with most of them is spread over ranges."""
    placed = numbered(df, [source, *order], "_all", ties=False)
    firsts = placed.groupBy(F.col(source).alias("_s")).agg(F.min("_all").alias("_first"))
    return placed.join(firsts, placed[source].eqNullSafe(firsts["_s"])).filter(F.col("_all") - F.col("_first") < most).drop("_all", "_s", "_first")


def negative_items(positives: DataFrame, items: DataFrame, draws: int = 8, seed: int = 0) -> DataFrame:
    """row_id, user_id, item_id, negative_id: an item the user has not, drawn by digest.

    Items are numbered; `draws` numbers are drawn for each row and the first that is no positive
    is kept. A row whose draws are all positives gets one of the items its user has not by its
    rank among them; only users who have every item get null.
    """
    pool = numbered(items.select(F.col("item_id").alias("_item")).distinct(), ["_item"], "_no", ties=False)
    n = F.broadcast(pool.agg(F.count("*").alias("_n")))
    tries = positives.crossJoin(n).select("row_id", "user_id", "item_id", "_n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_try"))
    number = F.pmod(F.xxhash64(F.lit(seed), "row_id", "_try"), F.col("_n"))
    drawn = tries.withColumn("_no", number).join(pool, "_no")
    known = positives.select("user_id", F.col("item_id").alias("_item")).distinct()
    kept = drawn.join(known, ["user_id", "_item"], "left_anti").groupBy("row_id").agg(F.min_by("_item", "_try").alias("negative_id"))
    rows = positives.select("row_id", "user_id", "item_id").join(kept, "row_id", "left")
    had = known.join(pool, "_item").withColumn("_at", F.row_number().over(Window.partitionBy("user_id").orderBy("_no")) - 1)
    gaps = had.select("user_id", (F.col("_no") - F.col("_at")).alias("_v"), F.lit(None).cast(rows.schema["row_id"].dataType).alias("row_id"))
    free = had.groupBy("user_id").agg(F.count("*").alias("_had")).crossJoin(n).select("user_id", (F.col("_n") - F.col("_had")).alias("_free")).filter("_free > 0")
    rest = rows.filter(F.col("negative_id").isNull()).select("row_id", "user_id").join(free, "user_id")
    asked = rest.select("user_id", F.pmod(F.xxhash64(F.lit(seed), "row_id", F.lit(0)), F.col("_free")).alias("_v"), "row_id")
    # the v-th item that a user has not is number v + how many had ones stand before it
    w = Window.partitionBy("user_id").orderBy("_v", F.col("row_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = gaps.unionByName(asked).withColumn("_no", F.col("_v") + F.count_if(F.col("row_id").isNull()).over(w)).filter(F.col("row_id").isNotNull())
    late = ranked.join(pool, "_no").groupBy("row_id").agg(F.min("_item").alias("_late"))
    return rows.join(late, "row_id", "left").select("row_id", "user_id", "item_id", F.coalesce("negative_id", "_late").alias("negative_id"))


def negative_edges(edges: DataFrame, users: DataFrame, items: DataFrame, factor: int = 4, seed: int = 0) -> DataFrame:
    """As many user-item pairs without an edge as there are edges, or all where there are fewer.

    Pairs are drawn by digest, `factor` for each edge. Where these are too few, others are taken
    by evenly spread ranks among the pairs left; the complement of the graph is never made.
    """
    u, i = numbered(users.select("user_id").distinct(), ["user_id"], "_u", ties=False), numbered(items.select("item_id").distinct(), ["item_id"], "_i", ties=False)
    # all of it is used several times: edges and drawn pairs are made once
    sizes = written(edges.select("user_id", "item_id").distinct(), "edges")
    counts = F.broadcast(sizes.agg(F.count("*").alias("_e")).crossJoin(u.agg(F.count("*").alias("_nu"))).crossJoin(i.agg(F.count("*").alias("_ni"))))
    tries = sizes.crossJoin(counts).select("*", F.explode(F.sequence(F.lit(1), F.lit(factor))).alias("_try"))
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), F.lit(seed), "user_id", "item_id", "_try"), F.col(n))
    drawn = tries.select(draw("u", "_nu").alias("_u"), draw("i", "_ni").alias("_i"), "_e").distinct()
    pairs = written(drawn.join(u, "_u").join(i, "_i").join(sizes, ["user_id", "item_id"], "left_anti").select("_u", "_i", "user_id", "item_id", "_e"), "drawn")
    size = counts.first()
    known = sizes.join(u, "user_id").join(i, "item_id").select("_u", "_i")
    taken = known.unionByName(pairs.select("_u", "_i")).select((F.col("_u") * F.lit(size._ni) + F.col("_i")).alias("_v"))
    n_drawn, left = pairs.count(), size._nu * size._ni - taken.count()
    short = min(size._e - n_drawn, left)
    if short > 0:
        gaps = numbered(taken, ["_v"], "_at", ties=False).select((F.col("_v") - F.col("_at")).alias("_v"), F.lit(-1).cast("long").alias("_k"))
        # rank k * left // short, in parts that do not overflow
        spread = F.expr(f"id * {left // short} + cast(id as decimal(19, 0)) * {left % short} div {short}")
        asked = edges.sparkSession.range(short).select(spread.alias("_v"), F.col("id").alias("_k"))
        # of the rows before the k-th rank, k are ranks and the others taken pairs
        placed = numbered(gaps.unionByName(asked), ["_v", "_k"], "_at").filter("_k >= 0")
        free = placed.select((F.col("_v") + F.col("_at") - F.col("_k")).alias("_v"))
        more = free.select(F.expr(f"_v div {size._ni}").alias("_u"), F.expr(f"_v % {size._ni}").alias("_i"), F.lit(size._e).alias("_e"))
        pairs = pairs.select("user_id", "item_id", "_e").unionByName(more.join(u, "_u").join(i, "_i").select("user_id", "item_id", "_e"))
    placed = numbered(pairs.withColumn("_o", _digest(F.col("user_id"), F.col("item_id"), seed)), ["_o", "user_id", "item_id"], "_at", ties=False)
    return placed.filter(F.col("_at") < F.col("_e")).select("user_id", "item_id")


def with_other_review(df: DataFrame, seed: int = 0) -> DataFrame:
    """Each row as positive (label 1), and beside it another row of its item by another user (label 0).

    The negative is the first of the item's other rows by digest; items of one row have none.
    Its number is drawn from the item's rows, so an item's rows are never paired with each other.
    """
    ordered = df.select("row_id", "user_id", "item_id").withColumn("_o", _digest(F.col("row_id"), seed))
    ranked = numbered(ordered, ["item_id", "_o", "row_id"], "_all", ties=False).drop("_o")
    items = ranked.groupBy("item_id").agg(F.min("_all").alias("_first"), F.count("*").alias("_n"))
    placed = ranked.join(items, "item_id").withColumn("_at", F.col("_all") - F.col("_first") + 1).drop("_all", "_first")
    step = F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.greatest(F.col("_n") - 1, F.lit(1))) + 1
    wanted = placed.filter("_n > 1").select("row_id", "user_id", "item_id", (F.pmod(F.col("_at") - 1 + step, F.col("_n")) + 1).alias("_at"))
    other = placed.select("item_id", "_at", F.col("row_id").alias("text_row"), F.col("user_id").alias("_u"))
    negative = wanted.join(other, ["item_id", "_at"]).filter("_u <> user_id").select("row_id", "user_id", "item_id", "text_row", F.lit(0).alias("label"))
    return df.select("row_id", "user_id", "item_id", F.col("row_id").alias("text_row"), F.lit(1).alias("label")).unionByName(negative)


def review_samples(df: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """row_id, text_row, label, history_ids: each row's own review (label 1) and one of its user's about another item (label 0).

    Both carry the padded rows of the same item by other users, `width` at most. A user's pairs
    stand in a ring by digest and the negative is of the next item in it, so each row gets one
    unless its user has a single item. The ring is made of ranks over all pairs, so that no user's
    rows meet in one task.
    """
    from ..functions import text as T
    from .retrieval import first_histories

    pick = F.min_by("row_id", F.struct(_digest(F.col("row_id"), seed), "row_id"))
    pairs = df.groupBy("user_id", "item_id").agg(pick.alias("text_row")).withColumn("_o", _digest(F.col("user_id"), F.col("item_id"), seed))
    ring = numbered(pairs, ["user_id", "_o", "item_id"], "_at", ties=False)
    ends = ring.groupBy("user_id").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")).filter("_first < _last")
    ahead = ring.join(ends, "user_id").select("user_id", "item_id", F.when(F.col("_at") == F.col("_last"), F.col("_first")).otherwise(F.col("_at") + 1).alias("_at"))
    other = ahead.join(ring.select("_at", "text_row"), "_at").select("user_id", "item_id", "text_row")
    rows = df.select("row_id", "user_id", "item_id")
    samples = rows.select("row_id", F.col("row_id").alias("text_row"), F.lit(1).alias("label")).unionByName(rows.join(other, ["user_id", "item_id"]).select("row_id", "text_row", F.lit(0).alias("label")))
    near = first_histories(df, rows, width, sides=("item_id",)).groupBy("row_id").agg(F.array_sort(F.collect_list("history_id")).alias("history_ids"))  # width at most
    return samples.join(near, "row_id", "left").withColumn("history_ids", T.padded(F.coalesce("history_ids", F.array().cast("array<bigint>")), width, -1))


def head(df: DataFrame, most: int, order: str = "row_id") -> DataFrame:
    """The first rows in order; the limit is what is asked for."""
    return df.orderBy(order).limit(most)


def with_history(samples: DataFrame, history: DataFrame, width: int) -> DataFrame:
    """Samples with their row's padded history (history_inputs); rows without one get padding only."""
    from ..functions import text as T
    from .retrieval import history_inputs

    none = T.padded(F.array().cast("array<bigint>"), width, -1)
    joined = samples.join(history_inputs(history, width), "row_id", "left")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("history_ids", "type_ids")})
