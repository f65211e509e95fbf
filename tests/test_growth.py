"""Work that must not grow faster than the tables: what is made for each pair, goal or task, counted on small ones."""

import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimspark.operators import consistency, graph, retrieval, sampling, stats, textmetrics
from claimspark.plans import frames

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def rows_written(monkeypatch):
    """Rows of the tables that graph operators write, by name."""
    sizes, plain = {}, graph.written

    def counted(df, name):
        out = plain(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    return sizes


def _crowd(spark, users=30, items=4):
    """Every user has two of the items, and every edge is asked for."""
    edges = spark.createDataFrame([(u, 1000 + (u + k) % items) for u in range(users) for k in range(2)], "src long, dst long")
    return edges, edges.select((F.col("src") * 10000 + F.col("dst")).alias("pair"), F.col("src").alias("user_id"), F.col("dst").alias("item_id"))


def _never(*_, **__):
    raise AssertionError("nodes are listed for each pair")


def test_induced_sums_list_no_nodes_of_a_pair(spark, monkeypatch):
    edges, pairs = _crowd(spark)
    labelled = edges.withColumn("label", (F.col("src") + F.col("dst")) % 7)
    found = graph.relabelled(labelled, graph.induced_edges(edges, graph.k_hop(edges, pairs, 1)))
    want = {tuple(r) for r in found.groupBy("pair").agg(F.count("*"), F.sum("label")).collect()}
    loose = graph.induced_sums(labelled, pairs.unionByName(pairs.limit(1).withColumn("item_id", F.lit(1003)).withColumn("pair", F.lit(-1))), "label").filter("pair >= 0")
    assert {tuple(r) for r in loose.collect()} == want  # a pair without an edge takes the longer way
    monkeypatch.setattr(graph, "k_hop", _never)
    assert {tuple(r) for r in graph.induced_sums(labelled, pairs, "label").collect()} == want


def test_best_paths_share_the_halves_of_a_goal(spark, rows_written):
    edges, pairs = _crowd(spark)
    weighted = graph.undirected(edges).withColumn("weight", F.lit(1.0))
    assert graph.best_paths(weighted, pairs, 3, 3).count() == 3 * pairs.count()
    assert rows_written["tails"] == [edges.count()]  # an item's users once, not for each of its pairs


def test_true_ways_meet_users_once_for_two_items(spark, monkeypatch, tmp_path):
    from claimspark.plans import metric_queries as Q

    edges, pairs = _crowd(spark)
    monkeypatch.setattr(Q, "_edges", lambda *_: edges)
    monkeypatch.setattr(Q, "_asked_pairs", lambda *_: pairs)
    hits = Q.path_hits(spark, str(tmp_path))
    assert hits.count() == pairs.count()
    real, items = {}, {}
    for u, i in edges.collect():
        real.setdefault(i, set()).add(u)
        items.setdefault(u, set()).add(i)
    seen = []
    monkeypatch.setattr(graph, "path_hits", lambda paths, truth: seen.append(truth) or truth)
    Q.path_hits(spark, str(tmp_path))
    got = {(r.pair, r.src, r.dst) for r in seen[0].filter("path_id = 0").collect()}
    want = set()
    for pair, u, i in pairs.collect():
        other = min(items[u] - {i})
        friends = (real[other] & real[i]) - {u}
        want |= {(pair, u, other), (pair, other, min(friends)), (pair, min(friends), i)} if friends else set()
    assert got == want
    assert "row_number" in seen[0]._jdf.queryExecution().toString()


def test_one_hop_counts_list_no_nodes_of_a_pair(spark, monkeypatch):
    edges, pairs = _crowd(spark)
    nodes = edges.select(F.col("src").alias("id"), F.lit("user").alias("ntype")).union(edges.select("dst", F.lit("item"))).distinct()
    want = {tuple(r) for r in graph.type_counts(nodes, graph.k_hop(edges, pairs, 1)).collect()}
    monkeypatch.setattr(graph, "k_hop", _never)
    assert {tuple(r) for r in graph.one_hop_counts(edges, pairs).collect()} == want


@pytest.mark.parametrize("bits", [1, 1 << 9])
def test_two_hop_sums_list_no_nodes_of_a_pair(spark, monkeypatch, bits):
    edges, pairs = _crowd(spark)
    monkeypatch.setattr(graph, "REACH_BITS", bits)
    monkeypatch.setattr(graph, "REACH_BLOCK", 7)
    monkeypatch.setattr(graph, "REACH_PART", 11)
    found = graph.k_hop(edges, pairs, 2).groupBy("pair").agg(F.count_if(F.col("id") < 1000), F.count_if(F.col("id") >= 1000), F.sum(F.col("id") % 97).cast("double"))
    want = {tuple(r) for r in found.collect()}
    monkeypatch.setattr(graph, "k_hop", _never)
    assert {tuple(r) for r in graph.two_hop_sums(edges, pairs, lambda ids: ids % 97).collect()} == want


def test_two_hop_sums_count_nodes_that_are_users_and_items(spark, monkeypatch):
    rng = np.random.default_rng(6)
    found = {(int(u), int(i)) for u, i in zip(rng.integers(90, 130, 260), 100 + rng.zipf(1.6, 260) % 25, strict=True)}
    edges = spark.createDataFrame(sorted(found), "src long, dst long")
    pairs = edges.filter("src % 3 = 0").select((F.col("src") * 1000 + F.col("dst")).alias("pair"), F.col("src").alias("user_id"), F.col("dst").alias("item_id"))
    beside: dict = {}
    for a, b in found:
        beside.setdefault(a, {a}).add(b)
        beside.setdefault(b, {b}).add(a)
    want = set()
    for u, i in (e for e in found if e[0] % 3 == 0):
        reached = {n for m in beside[u] | beside[i] for n in beside[m]}
        want.add((u * 1000 + i, sum(n < 110 for n in reached), sum(n >= 110 for n in reached), float(sum(n % 97 for n in reached))))
    monkeypatch.setattr(graph, "REACH_BLOCK", 7)
    monkeypatch.setattr(graph, "REACH_PART", 50)
    monkeypatch.setattr(graph, "k_hop", _never)
    for hub in (1 << 12, 5):
        monkeypatch.setattr(graph, "REACH_HUB", hub)
        assert {tuple(r) for r in graph.two_hop_sums(edges, pairs, lambda ids: ids % 97, lambda ids: ids < 110).collect()} == want
    apart = edges.select("src", (F.col("dst") + 100).alias("dst"))  # no node of both kinds, but users with ids of items
    moved = pairs.withColumn("item_id", F.col("item_id") + 100)
    got = {r.pair: (r.users, r.items) for r in graph.two_hop_sums(apart, moved, lambda ids: ids % 97, lambda ids: ids < 110).collect()}
    plain = {r.pair: (r.users, r.items) for r in graph.two_hop_sums(apart, moved, lambda ids: ids % 97).collect()}
    assert all(sum(got[p]) == sum(plain[p]) for p in plain) and got != plain


def test_similarity_counts_meet_blocks_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 4))
    x[7], x[8] = 0, x[9]
    monkeypatch.setattr(retrieval, "SQUARE", 20)
    monkeypatch.setattr(retrieval, "TILE", 64)
    with np.errstate(invalid="ignore"):
        u = x / np.linalg.norm(x, axis=1)[:, None]
    cos = np.nan_to_num(u @ u.T, nan=-2) - 4 * np.eye(90)
    near = cos > 1 - 1.1**2 / 2
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, vector array<float>")
    got = {r["index"]: (r.n, r.best) for r in retrieval.similarity_counts(v, 1.1).collect()}
    assert got.keys() == {i for i in range(90) if near[i].any()}
    assert all(n == near[i].sum() and best == pytest.approx(cos[i].max(), abs=1e-6) for i, (n, best) in got.items())


def test_similarity_lists_are_whole_and_by_buckets(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = np.repeat(rng.normal(size=(6, 5)), 20, axis=0)
    x = np.round(centres + 0.05 * rng.normal(size=centres.shape), 6)
    x[3], x[5], x[7] = 0, x[6], 2 * x[8]
    monkeypatch.setattr(retrieval, "SQUARE", 16)
    monkeypatch.setattr(retrieval, "TILE", 64)
    with np.errstate(invalid="ignore"):
        u = x / np.linalg.norm(x, axis=1)[:, None]
    cos = np.nan_to_num(u @ u.T, nan=-2) - 4 * np.eye(len(x))
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)] + [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [math.inf, 0.0, 0.0, 0.0, 0.0]), (203, [math.nan] * 5)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    compared, near = [], retrieval._near
    compared, near, met = [], retrieval._near, spark.sparkContext.accumulator(0)

    def counted(least):
        run = near(least)

        def each(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met.add(1)
            yield from run(key, batches)

        return each

    monkeypatch.setattr(retrieval, "_near", counted)
    for distance, bucket in ((0.3, 0.1), (0.3, 1.0), (1.1, 1.0)):
        before = met.value
        got = {r["index"]: (r.similars, r.similarities) for r in retrieval.similarity_lists(v, distance, bucket=bucket).collect()}
        compared.append(met.value - before)
        want = {i: sorted(np.flatnonzero(cos[i] > 1 - distance**2 / 2)) for i in range(len(x))}
        assert got.keys() == {i for i, w in want.items() if w}
        for i, (ids, cosines) in got.items():
            assert sorted(ids) == want[i]
            assert cosines == pytest.approx(sorted(cos[i][want[i]], reverse=True), abs=1e-9)
            assert cosines == pytest.approx([cos[i][j] for j in ids], abs=1e-9)
    assert compared[0] < compared[1] <= compared[2] == 36  # short buckets keep blocks of other centres apart
    assert retrieval.similarity_lists(v.filter("id >= 200"), 1.1).count() == 0
    n = {r["index"]: (r.n, r.best) for r in retrieval.similarity_counts(v, 1.1).collect()}
    assert n == {i: (len(ids), cosines[0]) for i, (ids, cosines) in got.items()}


def _scores(spark):
    rng = np.random.default_rng(1)
    rows = [(p, int(rng.integers(5)), int(rng.integers(4)) * 7, float(rng.random())) for p in range(40) for _ in range(rng.integers(1, 12))]
    rows += [(50, 1, None, 0.5), (50, 2, 3, 0.25), (50, 2, 3, None), (51, 1, 1, None), (None, 1, 1, 0.5)]
    cells = {}
    for p, i, j, s in rows:
        if p is not None:
            i, j = (1 << 63) - 1 if i is None else i, (1 << 63) - 1 if j is None else j
            cells.setdefault(p, []).append((i, j, 0.0 if s is None or j == (1 << 63) - 1 else s))
    made = {}
    for p, found in cells.items():
        a, b = sorted({c[0] for c in found}), sorted({c[1] for c in found})
        made[p] = np.zeros((len(a), len(b)))
        for i, j, s in found:
            made[p][a.index(i), b.index(j)] = max(made[p][a.index(i), b.index(j)], s)
    return spark.createDataFrame(rows, "pair long, prem_i long, hyp_i long, score double").repartition(3), made


@pytest.mark.parametrize("n", [2, 3])
def test_soft_ngrams_shuffle_rows_once(spark, monkeypatch, n):
    df, made = _scores(spark)
    monkeypatch.setattr(consistency, "CELLS", 40)
    got = consistency.soft_ngrams(df, n)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.pair: r for r in got.collect()}
    assert got.keys() == made.keys()
    for p, m in made.items():
        a, b = m.shape[0] - n + 1, m.shape[1] - n + 1
        runs = np.array([[np.mean([m[i + k, j + k] for k in range(n)]) for j in range(b)] for i in range(a)]) if a > 0 and b > 0 else np.zeros((1, 1))
        assert got[p].precision == pytest.approx(runs.max(axis=0).mean())
        assert got[p].recall == pytest.approx(runs.max(axis=1).mean())


def test_soft_lcs_shuffles_rows_once(spark, monkeypatch):
    df, made = _scores(spark)
    monkeypatch.setattr(consistency, "CELLS", 40)
    got = consistency.soft_lcs(df)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.pair: r.score for r in got.collect()}
    assert got.keys() == made.keys()
    for p, m in made.items():
        best = np.zeros((m.shape[0] + 1, m.shape[1] + 1))
        for i in range(m.shape[0]):
            for j in range(m.shape[1]):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + m[i, j])
        assert got[p] == pytest.approx(best[-1, -1] / max(m.shape))


def test_matrices_of_one_pair_may_come_in_several_batches(spark):
    df, made = _scores(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.pair for r in consistency.soft_lcs(df).collect()}
        assert got == made.keys() and consistency.soft_lcs(df).count() == len(made)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_triplets_lie_in_more_partitions_not_in_larger_ones(spark, monkeypatch):
    rows = frames.table(spark, DIR, "lineitem").count()
    monkeypatch.setattr(frames, "TASK_ROWS", 500)
    assert frames.triplets(spark, DIR).rdd.getNumPartitions() == -(-rows // 500)
    plan = frames.triplets(spark, DIR).groupBy("row_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(row_id") == 2  # those of the triplets; grouping adds none


def test_totals_repeat_no_row_for_each_column(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (None, "a", "x")], "k long, s string, t string")
    got = stats.totals(df, ["k", "s", "t"])
    assert tuple(got.first()) == (3, 1, 2, 1)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_negative_edges_draw_once(spark, monkeypatch):
    names, plain = [], sampling.written
    monkeypatch.setattr(sampling, "written", lambda df, name: names.append(name) or plain(df, name))
    edges = spark.createDataFrame([(u, (u * 7 + k) % 11) for u in range(9) for k in range(3)], "user_id long, item_id long")
    got = {tuple(r) for r in sampling.negative_edges(edges, edges.select("user_id"), edges.select("item_id")).collect()}
    assert len(got) == 27 and not got & {tuple(r) for r in edges.collect()}
    assert names == ["edges", "drawn"]


def test_lines_reach_python_as_text():
    assert textmetrics._union_lcs(pd.Series(["a b\nc", "", "x"]), pd.Series(["a c\nb", "a", ""])).tolist() == [3, 0, 0]


def _crowded_item(spark, users, asked):
    """One item that all users have, another that a few have; keys that are null or met by none."""
    rows = [(u, u * 7919, 1) for u in range(users)] + [(users + u, u * 7919, 2) for u in range(9)] + [(-1, None, 1), (-2, 7919, None), (-3, 5, 3)]
    df = spark.createDataFrame(rows, "row_id long, user_id long, item_id long")
    return df, df.filter((F.col("row_id") < asked) | (F.col("row_id") >= users))


def _tasks(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def _small_squares(monkeypatch):
    for name, size in (("LISTED", 4), ("MEETING", 16), ("TASK_ROWS", 100)):
        monkeypatch.setattr(retrieval, name, size, raising=False)


def test_co_purchases_share_an_item_among_tasks(spark, monkeypatch):
    _small_squares(monkeypatch)
    df, asked = _crowded_item(spark, 60, 50)
    e, t = ({(r.user_id, r.item_id) for r in x.collect()} for x in (df, asked))
    e, t = ({p for p in x if None not in p} for x in (e, t))
    want = [(u, i, o, "user") for u, i in t for o, j in e if i == j and o != u] + [(u, i, o, "item") for u, i in t for v, o in e if u == v and o != i]
    got = retrieval.co_purchases(df.union(df), asked.union(asked))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert max(_tasks(got)) < 1000  # the item's 50 targets have 59 others each


def test_neighbours_are_told_in_an_order_that_files_keep_small(spark, tmp_path):
    df, asked = _crowded_item(spark, 4000, 80)
    got = retrieval.co_purchases(df, asked)
    got.write.parquet(str(tmp_path / "out"))
    rows, size = got.count(), sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert rows > 80 * 3999 and size < 0.7 * rows


def test_neighbour_averages_list_no_neighbours(spark):
    df, asked = _crowded_item(spark, 60, 50)
    found = retrieval.co_purchases(df, asked).groupBy("kind").count().collect()
    want = {r.kind: r["count"] / asked.count() for r in found}
    got = retrieval.neighbour_averages(df, asked)
    assert tuple(got.first()) == pytest.approx((want["user"], want["item"]))
    assert tuple(retrieval.neighbour_averages(df, asked.filter("row_id is null")).first()) == (None, None)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 3  # by key, each to one row at most


def test_histories_share_an_item_among_tasks(spark, monkeypatch):
    _small_squares(monkeypatch)
    df, asked = _crowded_item(spark, 60, 50)
    df = df.union(df.filter("row_id < 5").withColumn("row_id", F.col("row_id") + 1000))  # some have it twice
    rows, t = ([tuple(r) for r in x.collect() if None not in tuple(r)] for x in (df, asked))
    want = [(r, k, h) for r, u, i in t for h, v, j in rows for k in (0, 1) if (u == v and i != j if k == 0 else i == j and u != v)]
    got = retrieval.histories(df, asked)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert max(_tasks(got)) < 1000  # the item's 50 targets have 59 others each, and more
    assert sorted(tuple(r) for r in retrieval.histories(df).filter("row_id < 50 or row_id between 60 and 100").collect()) == sorted(want)
