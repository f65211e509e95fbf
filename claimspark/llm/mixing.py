"""Mixing sources to target weights by hierarchical budgeting.

Weights run through a tree of domains, languages and sources. A node's budget is shared among
its children by weight. A child that cannot use its share (its supply times the epochs allowed)
leaves the rest to its siblings, and only what the whole family cannot use goes to the parent's
siblings. Each leaf then takes a prefix, in tokens, of its documents in the seeded order of
epoch 0, 1, ...

Budgets are tables, one level of the tree after the other; no family of siblings has to fit into
one task. `share` and `budgets` are the same rules in Python, which tests compare with.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ids import numbered, running_sums
from . import common

#: Documents in a range of the seeded order, about: running sums are taken within one range.
RANGE_DOCS = 256
#: Leaves up to which their plan is broadcast; a larger plan is joined as Spark chooses.
BROADCAST_LEAVES = 10_000
TREE = ("domain", "lang", "source")


@dataclass
class Node:
    """A node of the tree; supply is in tokens of one epoch."""

    path: tuple[str, ...]
    supply: int = 0
    docs: int = 0
    budget: int = 0
    children: dict[str, Node] = field(default_factory=dict)


def share(budget: int, weights: list[float], capacities: list[int]) -> list[int]:
    """Whole budgets by weight, none over its capacity; what one cannot use the others share by weight.

    All of the budget is given out unless the capacities together are smaller. Fractions are
    rounded down, and the tokens left go to the largest fractions, then to the first.
    """
    left = min(budget, sum(capacities))
    open_ = [i for i, c in enumerate(capacities) if c > 0]
    if not any(weights[i] > 0 for i in open_):
        weights = [1.0] * len(weights)
    given = [0] * len(weights)
    spare = left
    while spare and open_:
        if not any(weights[i] > 0 for i in open_):  # only nodes of weight 0 have supply left
            weights = [1.0] * len(weights)
        total = math.fsum(weights[i] for i in open_)
        full = [i for i in open_ if spare * weights[i] / total >= capacities[i]]
        if not full:
            exact = {i: spare * weights[i] / total for i in open_}
            for i in open_:
                given[i] = min(capacities[i], math.floor(exact[i]))
            rest = spare - sum(given[i] for i in open_)
            for i in sorted(open_, key=lambda i: (given[i] - exact[i], i)):
                more = min(rest, 1, capacities[i] - given[i])
                given[i] += more
                rest -= more
            break
        for i in full:
            given[i] = capacities[i]
            spare -= capacities[i]
        open_ = [i for i in open_ if i not in full]
        spare = max(spare, 0)
    return given


def budgets(leaves: list[tuple[tuple[str, ...], int, int]], weights: dict[tuple[str, ...], float], total: int, max_epochs: int) -> list[Node]:
    """The leaves (path, supply in tokens, documents) with their budgets. Nodes without a weight weigh 1."""
    root = Node(())
    found = []
    for path, supply, docs in sorted(leaves):
        node = root
        node.supply += supply
        for depth in range(1, len(path) + 1):
            node = node.children.setdefault(path[depth - 1], Node(path[:depth]))
            node.supply += supply
        node.docs = docs
        found.append(node)
    root.budget = min(total, root.supply * max_epochs)
    todo = [root]
    while todo:
        node = todo.pop()
        kids = list(node.children.values())
        for kid, b in zip(kids, share(node.budget, [weights.get(k.path, 1.0) for k in kids], [k.supply * max_epochs for k in kids]), strict=True):
            kid.budget = b
        todo += kids
    return found


def shared(kids: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `given` to children (parent's columns, name, weight, capacity and their parent's budget), as `share` does.

    Among siblings in the order of capacity over weight, those before some point are filled.
    """
    open_ = kids.filter("capacity > 0").withColumn("_late", F.col("weight") <= 0).withColumn("_w", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0))
    family = [*parent, "_late"]
    # children of weight 0 share what all others cannot use
    early = open_.groupBy(*parent).agg(F.sum(F.when(~F.col("_late"), F.col("capacity")).otherwise(0)).alias("_early"), F.sum("capacity").alias("_all"))
    mine = F.least("budget", "_all")
    part = F.when(F.col("_late"), F.greatest(mine - F.col("_early"), F.lit(0))).otherwise(F.least(mine, F.col("_early")))
    sized = (open_.join(early, parent) if parent else open_.crossJoin(F.broadcast(early))).withColumn("_part", part)
    key = F.struct(*family, (F.col("capacity") / F.col("_w")).alias("r"), name)
    placed = common.materialize(running_sums(sized, key, {"_cs": "capacity", "_ws": "_w"}), "shares")
    first = placed.groupBy(*family).agg(F.min("_cs").alias("_c0"), F.min("_ws").alias("_w0"), F.sum("_w").alias("_wt"))
    left_c, left_w = F.col("_part") - (F.col("_cs") - F.col("_c0")), F.col("_wt") - (F.col("_ws") - F.col("_w0"))
    marked = placed.join(first, family).withColumn("_full", left_c * F.col("_w") >= F.col("capacity") * left_w)
    spare = marked.groupBy(*family).agg((F.first("_part") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0))).alias("_spare"), F.sum(F.when(~F.col("_full"), F.col("_w"))).alias("_wo"))
    exact = F.col("_spare") * F.col("_w") / F.col("_wo")
    whole = marked.join(spare, family).withColumn("_floor", F.when(F.col("_full"), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.floor(exact))))
    ranked = common.materialize(numbered(whole.withColumn("_less", F.when(F.col("_full"), F.lit(1.0)).otherwise(F.col("_floor") - exact)), [*family, "_less", name], "_at"), "ranks")
    rests = ranked.groupBy(*family).agg(F.min("_at").alias("_a0"), (F.first("_part") - F.sum("_floor")).alias("_rest"))
    more = (~F.col("_full") & (F.col("_at") - F.col("_a0") < F.col("_rest"))).cast("long")
    return ranked.join(rests, family).select(*parent, name, (F.col("_floor") + more).cast("long").alias("given"))


def leaf_budgets(supply: DataFrame, tree: list[str], weights: dict[tuple[str, ...], float], total: int, max_epochs: int) -> DataFrame:
    """The supply table (tree's columns, supply, docs) of leaves that get a budget, with it, level by level."""
    spark = supply.sparkSession
    budget = F.least(F.lit(total), F.sum("supply") * max_epochs).cast("long")
    above, parent = supply.agg(budget.alias("budget")), []
    for depth, name in enumerate(tree, 1):
        path = tree[:depth]
        nodes = supply.groupBy(*path).agg((F.sum("supply") * max_epochs).alias("capacity"))
        known = [(*p, float(w)) for p, w in weights.items() if len(p) == depth]
        weighed = nodes.withColumn("weight", F.lit(1.0))
        if known:
            table = spark.createDataFrame(known, ", ".join(f"{c} string" for c in path) + ", _weight double")
            weighed = nodes.join(_small(table, len(known)), path, "left").withColumn("weight", F.coalesce("_weight", F.lit(1.0))).drop("_weight")
        kids = weighed.join(above, parent) if parent else weighed.crossJoin(F.broadcast(above))
        above, parent = common.materialize(shared(kids, parent, name).filter("given > 0").withColumnRenamed("given", "budget"), "budgets"), path
    return supply.join(above, tree)


def word_count(text_col: str) -> Column:
    """Runs of other characters than ASCII white space."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"[ \t\n\x0B\f\r]+"))).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_LEAVES else df


def mix(
    docs: DataFrame,
    weights: dict[tuple[str, ...], float],
    total: int | float,
    tree: dict[str, Column] | None = None,
    tokens: Column | None = None,
    max_epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All columns of the chosen documents, with domain, lang, source (the tree), epoch, n_tokens and take_tokens.

    total is in tokens, or a share of the supply if it is a float. A document appears once for
    each epoch that takes it. take_tokens is n_tokens, but smaller for the document in which a
    leaf's prefix ends; the sums of take_tokens are the leaves' budgets exactly. Documents without
    tokens are taken with the epochs and prefixes that they fall in. Null names in the tree count
    as empty ones. Rows without an id are ordered by a hash of all their columns. Ties of the seeded
    order (repeated ids) are ordered by tokens; equal rows are interchangeable. Input columns named like the operator's own give way to them. An empty
    table gives an empty result. No table of the tree goes to the
    driver.
    """
    tree = tree or {c: F.col(c) for c in TREE}
    own = [*tree, "epoch", "n_tokens", "take_tokens"]
    count = tokens if tokens is not None else word_count(text_col)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns if c not in own]).alias("_row"),
        F.col(id_col).alias("_id"),
        *[F.coalesce(e.cast("string"), F.lit("")).alias(c) for c, e in tree.items()],
        count.alias("n_tokens"),
    )
    names = list(tree)
    supply = common.materialize(rows.groupBy(*names).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("supply"), F.count("*").alias("docs")), "supply")
    goal = int(total * (supply.agg(F.sum("supply")).first()[0] or 0)) if isinstance(total, float) else total
    # whole epochs, tokens of the partial one, and bits of the order's ranges
    bits = F.least(F.lit(40), F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / RANGE_DOCS))))
    budgeted = leaf_budgets(supply, names, weights, goal, max_epochs)
    leaf_plan = common.materialize(budgeted.select(*names, F.expr("cast(budget div supply as int)").alias("_full"), (F.col("budget") % F.col("supply")).alias("_rest"), bits.cast("int").alias("_bits")), "plan")
    near = rows.join(_small(leaf_plan, leaf_plan.count()), names)
    name = F.coalesce(F.col("_id").cast("string"), F.xxhash64("_row").cast("string"))
    order = F.xxhash64(F.lit(seed), F.col("_full"), name)
    span = F.when(F.col("_bits") == 0, F.lit(0)).otherwise(F.expr("shiftrightunsigned(_order, 64 - _bits)"))
    ranged = near.withColumn("_order", order).withColumn("_range", span.cast("long"))
    sums = ranged.filter("_rest > 0").groupBy(*tree, "_range").agg(F.sum("n_tokens").alias("n"), F.first("_rest").alias("rest"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*tree).orderBy("_range")))
    ends = upto.filter("upto >= rest").groupBy(*tree).agg(F.min(F.struct("_range", "upto", "n")).alias("end"))
    end_plan = common.materialize(ends.select(*names, F.col("end._range").alias("_end"), (F.col("end.upto") - F.col("end.n")).alias("_before")), "ends")
    placed = ranged.join(_small(end_plan, end_plan.count()), names, "left")
    whole = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("_full") - F.when(F.col("_range") < F.col("_end"), 0).otherwise(1), F.lit(1))).alias("epoch")).filter("_full > 0 or _range < _end")
    whole = whole.withColumn("take_tokens", F.col("n_tokens"))
    running = F.sum("n_tokens").over(Window.partitionBy(*tree).orderBy("_order", "_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1))
    last = placed.filter("_range = _end").withColumn("_at", F.col("_before") + F.coalesce(running, F.lit(0))).filter("_at < _rest")
    last = last.withColumn("epoch", F.col("_full")).withColumn("take_tokens", F.least("n_tokens", F.col("_rest") - F.col("_at"))).drop("_at")
    return whole.unionByName(last).select("_row.*", *tree, "epoch", "n_tokens", "take_tokens")


#: Production weights of the documents table; sources of a language weigh the same.
WEIGHTS: dict[tuple[str, ...], float] = {("d0",): 4.0, ("d1",): 3.0, ("d2",): 2.0, ("d3",): 1.0} | {
    (d, lang): w for d in ("d0", "d1", "d2", "d3") for lang, w in (("en", 4.0), ("de", 2.5), ("fr", 2.0), ("es", 1.5))
}


def document_tree() -> dict[str, Column]:
    """Four domains, to which sources belong by a hash of their name."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return {"domain": F.concat(F.lit("d"), F.crc32(source.cast("binary")) % 4), "lang": F.col("lang"), "source": F.col("source")}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    counted = common.materialize(docs.select("doc_id", "lang", "source", word_count("text").alias("words")), "words")
    mixed = mix(counted, WEIGHTS, 0.5, document_tree(), tokens=F.col("words"), max_epochs=2, seed=1)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens")


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}
