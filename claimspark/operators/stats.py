"""Grouped dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(value: str, prefix: str = "") -> list[Column]:
    """avg, max, min, median and sample deviation of a column."""
    return [
        F.avg(value).alias(f"{prefix}avg"),
        F.max(value).alias(f"{prefix}max"),
        F.min(value).alias(f"{prefix}min"),
        F.percentile(value, 0.5).alias(f"{prefix}median"),
        F.stddev_samp(value).alias(f"{prefix}std"),
    ]


def count_stats(df: DataFrame, group: list[str], count: str, unique: bool = True) -> DataFrame:
    """Statistics of how many (distinct) values groups have."""
    n = F.count_distinct(count) if unique else F.count(count)
    return df.groupBy(*group).agg(n.alias("n")).agg(*summary("n"))


def _by_statement(df: DataFrame, keys: list[str], statement: str, facets: tuple[str, ...]) -> DataFrame:
    """keys, _s, _cells: a statement's counts by the facets' values, no more of them than values combine in.

    Rows are added up before they are shuffled, and what a statement adds to every margin is read
    off its cells, so no row is repeated for each grouping.
    """
    counted = df.groupBy(*keys, F.col(statement).alias("_s"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(facets)]).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys, "_s").agg(F.collect_list(F.struct(*[f"_f{i}" for i in range(len(facets))], "_n")).alias("_cells"))


def _rows(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0).cast("long"), lambda s, x: s + x["_n"])


def _margin(facet: str, entry) -> Column:
    """entry(value, rows) of each value that the cells have of a facet."""
    cells = F.col("_cells")
    values = F.array_distinct(F.transform(cells, lambda x: x[facet]))
    return F.transform(values, lambda v: entry(v.cast("string"), _rows(F.filter(cells, lambda x: x[facet].eqNullSafe(v)))))


def grid(df: DataFrame, entity: str, statement: str = "statement", facets: tuple[str, ...] = ("sentiment", "topic")) -> DataFrame:
    """For an entity, over all and by each facet: statistics of its distinct and total statements.

    facet is "all" or the facet's name. Null statements are not counted, their entities are.
    """
    entry = lambda name: lambda v, n: F.struct(F.lit(name).alias("facet"), v.alias("value"), n.alias("n"))
    parts = [F.array(entry("all")(F.lit(""), _rows(F.col("_cells")))), *[_margin(f"_f{i}", entry(f)) for i, f in enumerate(facets)]]
    found = F.col("_s").isNotNull()
    each = _by_statement(df.select(F.col(entity).alias("_e"), statement, *facets), ["_e"], statement, facets).select("_e", found.cast("long").alias("_u"), F.inline(F.concat(*parts)))
    counted = each.groupBy("_e", "facet", "value").agg(F.sum("_u").alias("unique"), F.sum(F.col("n") * F.col("_u")).alias("total"))
    return counted.groupBy("facet", "value").agg(F.count("*").alias("entities"), *summary("unique", "unique_"), *summary("total", "total_"))


def totals(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Rows and how many different values columns have; each column is counted by itself, so that no row is repeated for each of them."""
    if approximate:
        return df.agg(F.count("*").alias("rows"), *[F.approx_count_distinct(c).alias(f"n_{c}") for c in columns])
    out = df.agg(F.count("*").alias("rows"))
    for c in columns:
        out = out.crossJoin(F.broadcast(df.select(c).distinct().agg(F.count(c).alias(f"n_{c}"))))  # one row each
    return out


def distribution(df: DataFrame, facet: str, statement: str = "statement") -> DataFrame:
    """Each value's statements, total and distinct, with percentages of the whole table."""
    every = df.agg(F.count("*").alias("_t"), F.count_distinct(statement).alias("_u"))
    each = df.groupBy(facet).agg(F.count("*").alias("total"), F.count_distinct(statement).alias("unique"))
    share = lambda a, b: F.try_divide(F.col(a) * 100.0, F.col(b))
    return each.crossJoin(F.broadcast(every)).withColumn("total_percent", share("total", "_t")).withColumn("unique_percent", share("unique", "_u")).drop("_t", "_u")


def cross_matrix(df: DataFrame, a: str, b: str, statement: str = "statement") -> DataFrame:
    """Counts over both columns with margins, named "All"; distinct margins are not sums."""
    every = F.lit("All")

    def entry(x: Column, y: Column, n: Column, level: int) -> Column:
        return F.struct(x.alias("_x"), y.alias("_y"), F.lit(level).alias("_level"), n.alias("n"))

    inner = F.transform("_cells", lambda c: entry(c["_f0"].cast("string"), c["_f1"].cast("string"), c["_n"], 0))
    margins = [_margin("_f0", lambda v, n: entry(v, every, n, 1)), _margin("_f1", lambda v, n: entry(every, v, n, 2)), F.array(entry(every, every, _rows(F.col("_cells")), 3))]
    each = _by_statement(df.select(a, b, statement), [], statement, (a, b)).select(F.col("_s").isNotNull().cast("long").alias("_u"), F.inline(F.concat(inner, *margins)))
    return each.groupBy("_x", "_y", "_level").agg(F.sum("n").alias("total"), F.sum("_u").alias("unique")).select(F.col("_x").alias(a), F.col("_y").alias(b), "total", "unique")


def diversity(df: DataFrame, entity: str, facets: tuple[str, ...] = ("topic", "sentiment")) -> DataFrame:
    """Statistics of how many different values of each facet entities have."""
    counted = df.groupBy(entity).agg(*[F.count_distinct(f).alias(f) for f in facets])
    return counted.agg(*[c for f in facets for c in summary(f, f"{f}_")])


def largest(df: DataFrame, entity: str, statement: str = "statement", k: int = 5, unique: bool = False) -> DataFrame:
    """The k entities with most statements, ties by entity."""
    n = F.count_distinct(statement) if unique else F.count(statement)
    return df.groupBy(entity).agg(n.alias("n")).orderBy(F.desc("n"), entity).limit(k)


def top_labels(df: DataFrame, column: str = "statement", k: int = 10, width: int = 50) -> DataFrame:
    """The k most frequent texts with a short label, ties by text."""
    counted = df.groupBy(column).agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), column).limit(k)
    short = F.when(F.char_length(column) > width, F.concat(F.substring(column, 1, width), F.lit("..."))).otherwise(F.col(column))
    return counted.withColumn("label", short)
