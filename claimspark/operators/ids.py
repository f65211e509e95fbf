"""Row numbers and dense ids. Both scale: rows are sorted into stored ranges, never numbered by one unpartitioned window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _in_ranges(df: DataFrame, order: list[Column | str], ties: bool) -> DataFrame:
    """A written table of the rows, range-partitioned and sorted, with _range and _inside (0, 1 ... within its range).

    Every range exchange draws its own bounds, so ranges may only be used by several branches of a
    plan where they are stored: this table is the one source of ranks, sizes and sums. Rows that
    tie in the order are told apart by a hash of all columns and then by a stored number, so equal
    rows, however many, are split over ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    by = [f"_k{i}" for i in range(len(keys))]
    if ties:
        placed = written(placed.withColumns({"_hash": F.xxhash64(*df.columns), "_row": F.monotonically_increasing_id()}), "ties")
        by += ["_hash", "_row"]
    at = F.monotonically_increasing_id()  # of a sorted partition: its number in the upper bits
    sorted_ = placed.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", at)
    inside = sorted_.withColumns({"_range": F.shiftright("_at", 33), "_inside": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    return written(inside.drop(*by, "_at"), "ranges")


def _before(totals: DataFrame, sums: list[str]) -> DataFrame:
    """_range and, of each sum, that of all ranges before; there is one row a range."""
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("_range", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in sums]))


def numbered(df: DataFrame, order: list[Column | str], name: str = "row_id", ties: bool = True) -> DataFrame:
    """Adds 0, 1, 2 ... in the given order; of rows that tie, equal ones are interchangeable.

    Rows are sorted into ranges, which are written; they are numbered within a range and moved on
    by the sizes of the ranges before. ties=False says that the order has none, which saves a
    written table.
    """
    placed = _in_ranges(df, order, ties)
    before = _before(placed.groupBy("_range").agg(F.count("*").alias("_rows")), ["_rows"])
    return placed.join(before, "_range").withColumn(name, F.col("_rows_before") + F.col("_inside")).drop("_range", "_inside", "_rows_before")


def running_sums(df: DataFrame, order: Column | str, sums: dict[str, str]) -> DataFrame:
    """Adds, by new name, sums of columns over all rows before a row, in the order of a column without ties.

    Ranges are written, summed up within themselves and moved on by the sums of the ranges before.
    """
    placed = _in_ranges(df, [order], ties=False)
    names = [f"_t{i}" for i in range(len(sums))]
    before = _before(placed.groupBy("_range").agg(*[F.sum(v).alias(t) for t, v in zip(names, sums.values(), strict=True)]), names)
    inside = Window.partitionBy("_range").orderBy("_inside").rowsBetween(Window.unboundedPreceding, -1)
    made = placed.join(before, "_range").select("*", *[(F.col(f"{t}_before") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(new) for t, (new, v) in zip(names, sums.items(), strict=True)])
    return made.drop("_range", "_inside", *[f"{t}_before" for t in names])


def dense_ids(df: DataFrame, entity: str, order: list[str], name: str = "idx") -> DataFrame:
    """(entity, id): entities numbered by first appearance in the order; nulls are left out."""
    first = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(F.struct(*order)).alias("_first"))
    flat = first.select(entity, *[F.col(f"_first.{c}").alias(f"_o{i}") for i, c in enumerate(order)])
    return numbered(flat, [*(f"_o{i}" for i in range(len(order))), entity], name, ties=False).select(entity, name)


def encoded(df: DataFrame, ids: DataFrame, entity: str, name: str = "idx", keep_unknown: bool = False) -> DataFrame:
    """Adds the id of an entity; rows without one go, unless they are kept with null."""
    return df.join(ids, entity, "left" if keep_unknown else "inner")


def aligned(reference: DataFrame, prediction: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of both tables with the same key; what only one has is left out."""
    return reference.join(prediction, key)


def alignment_report(reference: DataFrame, prediction: DataFrame, key: str = "row_id") -> DataFrame:
    """How many keys both tables have, and how many only one."""
    a, b = reference.select(F.col(key), F.lit(1).alias("_a")), prediction.select(F.col(key), F.lit(1).alias("_b"))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"), F.count_if(F.col("_b").isNull()).alias("only_reference"), F.count_if(F.col("_a").isNull()).alias("only_prediction"))
