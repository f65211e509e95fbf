import pytest
from pyspark.sql import functions as F

from claimspark.llm import mixing


def test_share_fills_siblings_by_weight():
    assert mixing.share(100, [1, 1, 2], [1000, 1000, 1000]) == [25, 25, 50]
    assert mixing.share(100, [1, 1, 2], [5, 1000, 1000]) == [5, 32, 63]
    assert mixing.share(100, [1, 1], [30, 30]) == [30, 30]
    assert mixing.share(10, [0, 0], [30, 30]) == [5, 5]
    assert mixing.share(50, [1, 0], [20, 100]) == [20, 30]
    assert mixing.share(0, [1], [5]) == [0]


def test_shortages_go_to_siblings_before_ancestors():
    leaves = [(("a", "x"), 10, 1), (("a", "y"), 1000, 1), (("b", "z"), 1000, 1)]
    got = {n.path: n.budget for n in mixing.budgets(leaves, {}, 400, 1)}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}
    leaves[1] = (("a", "y"), 50, 1)
    got = {n.path: n.budget for n in mixing.budgets(leaves, {}, 400, 1)}
    assert got == {("a", "x"): 10, ("a", "y"): 50, ("b", "z"): 340}


def brute(rows, leaves, seed_order, ranges):
    out = []
    for leaf in leaves:
        mine = [r for r in rows if (r["domain"], r["lang"], r["source"]) == leaf.path]
        full, rest = divmod(leaf.budget, leaf.supply)
        for e in range(full):
            out += [(r["doc_id"], e, r["n"]) for r in mine]
        at = 0
        for r in sorted(mine, key=lambda r: seed_order[(full, r["doc_id"])] % (1 << 64)):
            if at >= rest:
                break
            out.append((r["doc_id"], full, min(r["n"], rest - at)))
            at += r["n"]
    return sorted(x for x in out)


@pytest.mark.parametrize(("total", "epochs", "ranges"), [(0.5, 1, 4096), (0.9, 2, 4096), (1.7, 2, 4096), (0.6, 3, 8)])
def test_takes_token_prefixes_of_seeded_epochs(spark, monkeypatch, total, epochs, ranges):
    monkeypatch.setattr(mixing, "RANGE_DOCS", ranges)
    rows = [{"doc_id": i, "text": "w " * (1 + i * 7 % 13), "lang": "ab"[i % 2], "source": f"s{i * i % 5}", "domain": f"d{i % 3}", "n": 1 + i * 7 % 13, "epoch": "clash"} for i in range(300)]
    df = spark.createDataFrame(rows).repartition(3)
    weights = {("d0",): 5.0, ("d1", "a"): 0.0}
    got = mixing.mix(df, weights, total, max_epochs=epochs, seed=9)
    taken = sorted((r.doc_id, r.epoch, r.take_tokens) for r in got.collect())
    supply: dict = {}
    for r in rows:
        s = supply.setdefault((r["domain"], r["lang"], r["source"]), [0, 0])
        s[0] += r["n"]
        s[1] += 1
    goal = int(total * sum(s for s, _ in supply.values()))
    leaves = [n for n in mixing.budgets([(k, s, d) for k, (s, d) in supply.items()], weights, goal, epochs) if n.budget]
    keys = spark.range(300).select("id", F.explode(F.sequence(F.lit(0), F.lit(epochs))).alias("e")).select("id", "e", F.xxhash64(F.lit(9), "e", F.col("id").cast("string")).alias("h"))
    order = {(r.e, r.id): r.h for r in keys.collect()}
    assert sum(t for _, _, t in taken) == goal
    if ranges == 8:
        assert taken == brute(rows, leaves, order, ranges)
    else:  # one range: ordered by the signed hash
        signed = {k: (v + (1 << 63)) % (1 << 64) for k, v in order.items()}
        assert taken == brute(rows, leaves, signed, ranges)


def test_nulls_repeats_and_empty_texts(spark):
    rows = [(1, "a b", None, "s"), (1, "a b", None, "s"), (None, "c", "en", None), (3, None, "en", None), (4, "", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("domain", F.lit("d"))
    got = mixing.mix(df, {}, 1.0).select("doc_id", "lang", "source", "epoch", "take_tokens").collect()
    assert sorted((r.doc_id or -1, r.lang, r.source, r.epoch, r.take_tokens) for r in got) == [(-1, "en", "", 0, 1), (1, "", "s", 0, 2), (1, "", "s", 0, 2), (3, "en", "", 0, 0), (4, "en", "", 0, 0)]
    assert mixing.mix(df.limit(0), {}, 1.0).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_budget_tables_equal_the_rules_in_python(spark, seed):
    import random

    rng = random.Random(seed)
    leaves = {(f"d{rng.randrange(4)}", f"l{rng.randrange(3)}", f"s{rng.randrange(40)}"): (rng.choice([0, 1, 3, 50, 1000, 123457]), rng.randint(1, 9)) for _ in range(120)}
    nodes = sorted({p[:k] for p in leaves for k in (1, 2, 3)})
    weights = {p: rng.choice([0.0, 0.5, 1.0, 2.5, 7.0]) for p in nodes if rng.random() < 0.5}
    supply = sum(s for s, _ in leaves.values())
    table = spark.createDataFrame([(*p, s, n) for p, (s, n) in leaves.items()], "domain string, lang string, source string, supply long, docs long").repartition(3)
    for total, epochs in ((supply * 2 // 3, 1), (supply * 2, 3)):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(table, list(mixing.TREE), weights, total, epochs).collect()}
        want = {n.path: n.budget for n in mixing.budgets([(p, s, d) for p, (s, d) in leaves.items()], weights, total, epochs) if n.budget}
        assert got == want


def test_rows_without_ids_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_DOCS", 8)
    df = spark.createDataFrame([(None, f"word {i}", "d", "en", "s") for i in range(400)], "doc_id long, text string, domain string, lang string, source string").repartition(4)
    got = mixing.mix(df, {}, 0.5).collect()
    assert sum(r.take_tokens for r in got) == 400
    assert len({r.text for r in got}) == len(got) == 200


def test_budgets_of_many_leaves(spark):
    """More leaves than Spark samples for the bounds of ranges; equal ones, so that fractions tie."""
    leaves = {("d", f"l{i % 3}", f"s{i}"): (1000 + (i * 7919 % 500 if i % 2 else 0), 3) for i in range(12_000)}
    table = spark.createDataFrame([(*p, s, n) for p, (s, n) in leaves.items()], "domain string, lang string, source string, supply long, docs long").repartition(3)
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(table, list(mixing.TREE), {("d", "l1"): 2.0}, 4_000_000, 1).collect()}
    want = {n.path: n.budget for n in mixing.budgets([(p, s, d) for p, (s, d) in leaves.items()], {("d", "l1"): 2.0}, 4_000_000, 1) if n.budget}
    assert got == want
    assert sum(got.values()) == 4_000_000
