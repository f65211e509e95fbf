import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.functions import scorers
from claimspark.operators import consistency, factuality, graph, ids, pairs, ranking, retrieval, sampling, splits, statements, stats
from claimspark.operators import textmetrics as M


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def interactions(spark, sizes):
    data, n = [], 0
    for user, size in sizes.items():
        for t in range(size):
            data.append((n, user, f"i{t % 7}", t // 2, float(t % 5)))
            n += 1
    return spark.createDataFrame(data, "row_id long, user_id string, item_id string, timestamp long, rating double").repartition(3)


def test_temporal_split_sizes(spark):
    got = splits.temporal_split(interactions(spark, {"a": 4, "b": 5, "c": 6, "d": 9, "e": 10, "f": 25}))
    counts = {(r.user_id, r.split): r["count"] for r in got.groupBy("user_id", "split").count().collect()}
    assert counts == {("b", "train"): 4, ("b", "test"): 1, ("c", "train"): 4, ("c", "eval"): 1, ("c", "test"): 1, ("d", "train"): 7, ("d", "eval"): 1, ("d", "test"): 1, ("e", "train"): 8, ("e", "eval"): 1, ("e", "test"): 1, ("f", "train"): 20, ("f", "eval"): 2, ("f", "test"): 3}
    last = got.filter("user_id = 'e' and split = 'test'").collect()[0]
    assert last.row_id == 33  # ties in time keep the order of rows


def test_cold_items_go(spark):
    df = spark.createDataFrame([("train", "a"), ("eval", "a"), ("test", "b")], "split string, item_id string")
    assert rows(splits.without_cold_items(df)) == [("eval", "a"), ("train", "a")]


@pytest.mark.parametrize("partitions", ["1", "4", "50"])
def test_dense_ids_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(5, "x"), (1, "y"), (3, "x"), (2, None), (0, "z"), (4, "y")], "row_id long, e string").repartition(5)
        assert rows(ids.dense_ids(df, "e", ["row_id"])) == [("x", 2), ("y", 1), ("z", 0)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_user_splits_are_disjoint_and_cover(spark):
    df = interactions(spark, {f"u{i}": 1 + i % 9 for i in range(60)})
    s = splits.stratified_user_split(df)
    assert s.count() == 60 == s.select("user_id").distinct().count()
    assert {r.split for r in s.collect()} == {"train", "eval", "test"}
    assert {r[0]: r[1] for r in splits.hash_split(df.select("row_id"), "row_id").groupBy("split").count().collect()}["train"] == int(df.count() * 0.8)


def test_activity_bins_drop_equal_edges(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([1, 1, 1, 1, 1, 2, 3, 9])], "u int, n long")
    assert [r.bin for r in splits.activity_bins(df).orderBy("u").collect()] == [0, 0, 0, 0, 0, 0, 1, 1]


def test_votes_audit_and_ids(spark):
    votes = spark.createDataFrame([("w", "l1", "a"), ("w", "l2", "a"), ("w", "l3", "a"), ("v", "l1", "a"), ("v", "l2", "b"), ("v", "l3", "a"), ("u", "l1", None), ("u", "l2", "a"), ("u", "l3", "a")], "wrong_topic string, labeler string, topic string")
    assert rows(statements.unanimous(votes)) == [("w", "a")]
    t = spark.createDataFrame([(0, 0, "s", "a", "positive"), (0, 1, "s", "w", "positive"), (1, 0, "q", "a", "odd"), (1, 1, "r", "zz", None)], "row_id long, pos int, statement string, topic string, sentiment string")
    counts = statements.audit(t, ["a"], ["positive"])
    assert {r["class"] for r in counts.collect()} == {"correct", "wrong_topic", "wrong_sentiment", "both_wrong"}
    assert statements.error_share(counts).collect()[0][0] == 50.0
    assert ("s", "a", "positive", 2) in rows(statements.repaired(counts, statements.unanimous(votes)))
    v = statements.vocabulary(t.filter("sentiment = 'positive'"))
    assert rows(v.select("sid", "topic")) == [(0, "a"), (1, "w")]
    assert rows(statements.with_ids(t, v)) == [(0, [0, 1], [None, None], [1, 1])]


def test_explanations_skip_unknown_ids_and_use_row_sentiments(spark):
    v = spark.createDataFrame([(0, "is good", "t", "positive"), (1, "is bad", "t", "negative")], "sid long, statement string, topic string, sentiment string")
    df = spark.createDataFrame([(0, [1, 0, 9], [1, -1, 0]), (1, [0], [1, 1]), (2, [], []), (3, None, None), (4, [9], None)], "row_id long, statement_ids array<long>, sentiments array<int>")
    got = dict(rows(statements.explanations(df, v)))
    assert got == {0: "The user would appreciate this product because it is bad. However, they may dislike that it is good.", 1: "The user would appreciate this product because it is good.", 2: "", 3: "", 4: ""}


def test_pairs_match_inside_the_join(spark):
    r = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 3, "a")], "row_index long, sid long, topic string")
    p = spark.createDataFrame([(0, 7, "a"), (2, 8, "a")], "row_index long, sid long, topic string")
    assert rows(pairs.bipartite(r, p)) == [(0, 1, "a", 7, "a"), (0, 2, "b", 7, "a")]
    assert rows(pairs.bipartite(r, p, match=("topic",))) == [(0, "a", 1, 7)]
    plan = pairs.bipartite(r, p, match=("topic",))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_factuality_and_nan(spark):
    p = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (2, None)], "index long, label int")
    r = spark.createDataFrame([(0, 1), (1, 0)], "index long, label int")
    got = {x["index"]: (x.precision, x.recall, x.f1) for x in factuality.precision_recall_f1(p, r).collect()}
    assert got == {0: (0.5, 1.0, 2 / 3), 1: (1.0, 0.0, 0.0)}
    s = {x.metric: (x["mean"], x["std"]) for x in factuality.summary(factuality.precision_recall_f1(p, r)).collect()}
    assert s["precision"] == (0.75, 0.25)
    assert factuality.summary(factuality.precision_recall_f1(p.limit(0), r)).count() == 0
    nan = float("nan")
    cols = "row_index long, pred_sid long, ref_sid long, p2r_entail double, p2r_neutral double, p2r_contradiction double, p2r_label string, r2p_entail double, r2p_neutral double, r2p_contradiction double, r2p_label string"
    x = spark.createDataFrame([(0, 1, 1, 0.2, 0.3, 0.5, "contradiction", nan, 0.1, 0.1, "neutral"), (0, 1, 2, 0.8, 0.1, 0.1, "entailment", 0.6, 0.3, 0.1, "entailment")], cols)
    e = factuality.entailment_scores(x).collect()[0]
    assert (e.ent_precision, e.ent_recall, e.bin_precision, e.bin_recall) == (0.6, 0.5, 1.0, 0.5)
    assert e.coh_recall == pytest.approx((-0.3 + 0.7) / 2)


def test_soft_matching(spark):
    s = spark.createDataFrame([("a", p, h, v) for p, h, v in [(0, 0, 1.0), (0, 1, 0.2), (1, 0, 0.1), (1, 1, 0.5)]], "pair string, prem_i int, hyp_i int, score double")
    assert consistency.chunked_alignment(s).collect()[0].score == 0.75
    assert consistency.soft_lcs(s).collect()[0].score == 0.75
    zs = s.select("pair", F.col("prem_i").alias("doc_i"), F.col("hyp_i").alias("gen_i"), F.col("score").alias("entail"), F.lit(0.0).alias("contradiction"))
    assert consistency.zero_shot(zs).collect()[0].score == 0.75
    assert rows(consistency.histogram(zs, [0.0, 0.5, 1.0]).select("gen_i", "bin", "n")) == [(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 1)]


def test_text_metrics(spark):
    df = spark.createDataFrame([(0, "the cat sat", "the cat sat down"), (1, "", "x")], "k long, p string, r string")
    assert rows(M.rouge_n(df, "p", "r", "k").select("k", F.round("f", 6))) == [(0, round(6 / 7, 6)), (1, 0.0)]
    assert [round(r[0], 6) for r in df.select(M.rouge_l(F.col("p"), F.col("r"))).collect()] == [round(6 / 7, 6), 0.0]
    same = spark.createDataFrame([(0, "a b c d e", "a b c d e")], df.schema)
    assert M.bleu(same, "p", "r", "k").collect()[0][0] == pytest.approx(1.0)
    assert M.bleu(df, "p", "r", "k", 4).collect()[0][0] == 0.0
    e = M.entropy(spark.createDataFrame([("a b a b",)], "t string"), "t").collect()[0]
    assert e.entropy_1 == 1.0 and e.entropy_2 == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3)) and e.entropy_3 == 1.0
    assert M.entropy(df.limit(0), "p").collect()[0].entropy_mean == 0.0
    got = spark.createDataFrame([("abab",), ("",)], "t string").select(M.distinct_n(F.col("t"), 2)).collect()
    assert [r[0] for r in got] == [0.5, 0.0]
    lcs = spark.createDataFrame([(list("abcbdab"), list("bdcaba")), ([], ["a"]), (["a"], [])], "a array<string>, b array<string>").select(M.lcs_length(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in lcs] == [4, 0, 0]


def test_ranking(spark):
    s = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1), (None, None)], "score double, label int")
    assert ranking.auc(s.filter("label is not null")).collect()[0].auc == 0.875
    t = ranking.best_threshold(s.filter("label is not null")).collect()[0]
    assert t.accuracy == 0.75
    ranked = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("u", "c", 3)], "user_id string, item_id string, rank int")
    truth = spark.createDataFrame([("u", "a"), ("u", "c"), ("u", "c"), ("v", "a")], "user_id string, item_id string")
    m = {r.user_id: r for r in ranking.ranking_metrics(ranked, truth, 3).collect()}
    assert (m["u"].recall, m["u"].precision, m["u"].mrr, m["u"]["rows"]) == (1.0, 2 / 3, 1 + 1 / 3, 3)
    assert m["u"].ndcg == pytest.approx((1 + 0.5) / (1 + 1 / math.log2(3)))
    assert m["v"].recall == 0.0
    assert ranking.ranking_summary(ranking.ranking_metrics(ranked, truth, 3)).collect()[0][0] == 0.75


def test_graph(spark):
    e = spark.createDataFrame([(0, 10), (1, 10), (1, 11), (2, 11), (2, 12)], "src long, dst long")
    u = graph.undirected(e)
    assert graph.degrees(u).filter("id = 11").collect()[0].degree == 2
    ring = spark.createDataFrame([(0, 10), (10, 1), (1, 11), (11, 0), (11, 2)], "src long, dst long")
    core = graph.k_core(graph.undirected(ring), 2)
    assert {r.src for r in core.collect()} == {0, 1, 10, 11}
    assert graph.k_core(u, 9).count() == u.count()
    pair = spark.createDataFrame([(7, 0, 11)], "pair long, user_id long, item_id long")
    weighted = u.withColumn("weight", F.lit(1.0))
    (path,) = graph.best_paths(weighted, pair, 2, 3).collect()
    assert path.path == [0, 10, 1, 11] and path.cost == pytest.approx(math.log(2) * 3)
    truth = spark.createDataFrame([(7, 0, 0, 10), (7, 0, 10, 1), (7, 0, 1, 11), (7, 1, 9, 9)], "pair long, path_id int, src long, dst long")
    hits = graph.path_hits(graph.best_paths(weighted, pair, 2, 3), truth)
    assert graph.hit_rate(hits).collect()[0][0] == 1.0
    assert {r.id for r in graph.k_hop(e, pair, 1).collect()} == {0, 10, 11, 1, 2}
    assert graph.without_hubs(u, 1).count() == 0
    assert rows(graph.edge_difference(e, e.limit(0))) == rows(e)


def test_margins_count_a_statement_once(spark):
    """Nulls in every column, a value named as the margin, repeated rows, an empty table: as grouping sets give it."""
    rng = random.Random(2)
    data = [(rng.choice([1, 2, None]), rng.choice(["x", "y", "z", None]), rng.choice([1, -1, None]), rng.choice(["All", "a", None])) for _ in range(300)]
    df = spark.createDataFrame(data, "e int, statement string, sentiment int, topic string")
    df.createOrReplaceTempView("margins")
    want = spark.sql("""SELECT if(grouping(sentiment) = 1, 'All', string(sentiment)), if(grouping(topic) = 1, 'All', topic), count(*), count(DISTINCT statement)
        FROM margins GROUP BY CUBE (sentiment, topic)""")
    assert rows(stats.cross_matrix(df, "sentiment", "topic")) == rows(want)
    assert stats.cross_matrix(df.limit(0), "sentiment", "topic").count() == 0
    sets = """SELECT if(grouping(sentiment) = 0, 'sentiment', if(grouping(topic) = 0, 'topic', 'all')) AS facet, if(grouping(sentiment) = 0, string(sentiment), if(grouping(topic) = 0, topic, '')) AS value,
        count(DISTINCT statement) AS u, count(statement) AS t FROM margins GROUP BY GROUPING SETS ((e), (e, sentiment), (e, topic))"""
    want = spark.sql(f"SELECT facet, value, count(*), avg(u), max(u), avg(t), max(t), percentile(t, 0.5) FROM ({sets}) GROUP BY facet, value")
    assert rows(stats.grid(df, "e").select("facet", "value", "entities", "unique_avg", "unique_max", "total_avg", "total_max", "total_median")) == rows(want)
    assert stats.grid(df.limit(0), "e").count() == 0


def test_k_hop_shares_frontiers(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_EDGES", 4)
    rng = random.Random(3)
    edges = sorted({(rng.randrange(60), 100 + rng.randrange(40)) for _ in range(150)} | {(7, 100 + i) for i in range(40)})
    asked = [(i, rng.randrange(60), 100 + rng.randrange(40)) for i in range(150)]
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reached(ends: set[int], k: int) -> set[int]:
        for _ in range(k):
            ends = ends | {y for x in ends for y in near.get(x, ())}
        return ends

    e = spark.createDataFrame([*edges, (None, 100), (3, None)], "src long, dst long")
    rows_ = [*asked, asked[0], (0, 59, None), (None, 1, 100), (500, None, None), (501, 9999, None)]
    p = spark.createDataFrame(rows_, "pair long, user_id long, item_id long")
    for k in (0, 1, 2, 3):
        got = [tuple(r) for r in graph.k_hop(e, p, k).select("pair", "id").collect()]
        want = {(i, x) for i, u, v in asked for x in reached({u, v} | ({59} if i == 0 else set()), k)} | {(501, 9999)}
        assert len(got) == len(set(got)) and set(got) == want
    assert graph.k_hop(e, p.limit(0), 2).count() == 0


def test_propagation_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    src, dst, w = rng.integers(0, 50, 900), rng.integers(0, 50, 900), rng.random(900)
    src[:300], dst[300:600] = 4, 9
    vectors = rng.random((40, 3))
    adj = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(src, dst, w, strict=True)] + [(None, 1, 1.0), (1, None, 1.0)], "src long, dst long, weight double")
    given = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(0, [1.0]), (41, [None, 2.0]), (None, [1.0]), (42, None)]
    dense = np.zeros((50, 3))
    dense[:40] = vectors
    dense[0, 0] += 1
    dense[41, 1] = 2
    matrix = np.zeros((50, 50))
    np.add.at(matrix, (dst, src), w)
    want = dense + matrix @ dense + matrix @ (matrix @ dense)
    emb = spark.createDataFrame(given, "id long, vector array<double>")
    blocks = graph._blocks
    for cell in (10_000, 40):
        monkeypatch.setattr(graph, "_blocks", lambda a, _, cell=cell: blocks(a, cell))
        got = {r.id: r.vector for r in graph.layer_sum(adj, emb, 2).collect()}
        assert set(got) == set(range(40)) | {41} | set(dst.tolist())
        for i, v in got.items():
            assert v == pytest.approx(want[i].tolist())
    sizes = [r["count"] for r in blocks(adj.dropna(), 40)[0].groupBy("_row", "_col", "_part").count().collect()]
    assert max(sizes) < 90
    assert graph.layer_sum(adj, emb.limit(0)).count() == 0
    assert {r.id for r in graph.layer_sum(adj.limit(0), emb).collect()} == set(range(40)) | {41}


def test_retrieval_and_sampling(spark):
    df = interactions(spark, {"a": 6, "b": 8})
    h = retrieval.histories(df)
    joined = h.join(df.select("row_id", "user_id", "item_id"), "row_id").join(df.select(F.col("row_id").alias("history_id"), F.col("user_id").alias("u"), F.col("item_id").alias("i")), "history_id")
    assert joined.filter("user_id = u and item_id = i").count() == 0
    n = sampling.negative_items(df, df.select("item_id"), draws=40)
    known = {(r.user_id, r.item_id) for r in df.collect()}
    assert all(r.negative_id is None or (r.user_id, r.negative_id) not in known for r in n.collect())
    assert any(r.negative_id for r in n.filter("user_id = 'a'").collect())
    neg = sampling.negative_edges(df, df.select("user_id"), df.select("item_id"))
    assert all((r.user_id, r.item_id) not in known for r in neg.collect())
    two = sampling.with_other_review(df)
    assert two.filter("label = 1").count() == df.count()
    assert two.filter("label = 0 and row_id = text_row").count() == 0
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "id long, vector array<double>")
    assert retrieval.similarity_lists(v, 1.5).count() > 0
    t = spark.createDataFrame([(0, [1, 2], [0.9, 0.2])], "index long, similars array<long>, similarities array<double>")
    assert rows(retrieval.similar_ids(t, 0.5)) == [(0, 1, 0.9)]
    assert rows(retrieval.similar_ids(t, 0.1, spark.createDataFrame([(2,)], "id long"))) == [(0, 2, 0.2)]
    assert retrieval.purchase_lists(df, df.select("item_id").distinct().withColumn("summary", F.col("item_id")), 2).filter("size(summaries) = 3").count() == 2


def test_statistics(spark):
    df = spark.createDataFrame([("r", "s", "positive", "t"), ("r", "s", "negative", "t"), ("q", "z", "positive", "u")], "row_id string, statement string, sentiment string, topic string")
    g = {(r.facet, r.value): (r.entities, r.unique_avg, r.total_avg) for r in stats.grid(df, "row_id").collect()}
    assert g[("all", "")] == (2, 1.0, 1.5) and g[("sentiment", "negative")] == (1, 1.0, 1.0) and g[("topic", "t")] == (1, 1.0, 2.0)
    m = {(r.sentiment, r.topic): (r.total, r.unique) for r in stats.cross_matrix(df, "sentiment", "topic").collect()}
    assert m[("All", "All")] == (3, 2) and m[("All", "t")] == (2, 1)


def test_pluggable_scorer_and_generator(spark):
    df = spark.createDataFrame([(0, "a b", "a"), (1, "a b", "a"), (2, None, "x")], "k long, premise string, hypothesis string")

    def load():
        return lambda p, h: [(float(len(a)), 0.0, float(len(b))) for a, b in zip(p, h, strict=True)]

    got = {r.k: (r.p2h_entail, r.h2p_entail) for r in scorers.score_pairs(df, load).collect()}
    assert got == {0: (3.0, 1.0), 1: (3.0, 1.0), 2: (0.0, 1.0)}
    made = scorers.generate(df, F.concat(F.lit("p:"), "hypothesis"), lambda: lambda ps: [p.upper() for p in ps])
    assert {r.output for r in made.collect()} == {"P:A", "P:X"}
    assert [r.label for r in scorers.verified(spark.createDataFrame([(" 1 ",), ("yes",)], "output string")).collect()] == [1, None]
    assert scorers.embed(df, "hypothesis", lambda: lambda ts: [[1.0, float(len(t))] for t in ts]).filter("vector[1] = 1").count() == 3


def test_tasks_name_what_they_lack():
    from claimspark.operators import tasks

    tasks.require("statement2explanation", {"predictions": "p.csv"})
    assert tasks.missing("statement2item_chunk", {"predictions": "p", "references": ""}) == ["references", "reference_statements", "item_metadata"]
    with pytest.raises(ValueError, match="needs predictions"):
        tasks.require("statement2explanation", {})
    with pytest.raises(ValueError, match="unknown task"):
        tasks.require("other", {})


def test_text_ids_are_looked_up_as_numbers(spark):
    from claimspark.operators import statements

    rows = spark.createDataFrame([(1, ["2", "x", None, "3"])], "row_id long, statement_ids array<string>")
    known = spark.createDataFrame([(2, "a", "t", "positive"), (3, "b", "t", "negative")], "sid long, statement string, topic string, sentiment string")
    assert sorted((r.sid, r.pos) for r in statements.looked_up(rows, known).collect()) == [(2, 0), (3, 3)]


@pytest.fixture(params=["1", "4", "64"])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("equal", [False, True])
def test_numbers_of_more_rows_than_are_sampled(spark, partitions, equal):
    n = 1_000_000 if partitions == 4 else 20_000
    key = F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 1000 if equal else F.col("id"))
    df = spark.range(n, numPartitions=3).select(key.alias("k"), (F.col("id") * 7919 % n).alias("v"))
    twice = [ids.numbered(df, ["k"], "no") for _ in range(2)]
    for got in twice:
        whole = got.agg(F.count("*"), F.count_distinct("no"), F.min("no"), F.max("no")).first()
        assert tuple(whole) == (n, n, 0, n - 1)
        order = got.groupBy("k").agg(F.min("no").alias("a"), F.max("no").alias("b"), F.count("*").alias("c"))
        assert order.filter("b - a + 1 <> c").isEmpty()  # equal keys stand together
        want, at = [], 0
        for k, c in sorted(df.groupBy("k").count().collect()) if equal else []:
            want.append((k, at))
            at += c
        assert not equal or sorted((r.k, r.a) for r in order.collect()) == want
    assert twice[0].exceptAll(twice[1]).isEmpty()


def test_equal_rows_do_not_share_a_range(spark, partitions):
    from claimspark.operators.ids import _in_ranges

    placed = _in_ranges(spark.range(40_000, numPartitions=4).select(F.lit(1).alias("k")), ["k"], True)
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert sum(sizes) == 40_000
    assert max(sizes) < 2 * 40_000 / partitions or partitions == 1


def test_running_sums_of_more_rows_than_are_sampled(spark, partitions):
    n = 30_000
    df = spark.range(n, numPartitions=2).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 13).alias("a"))
    for _ in range(2):
        got = {r.k: r.s for r in ids.running_sums(df, "k", {"s": "a"}).collect()}
        at = 0
        for k, a in sorted((i * 7919 % n, i % 13) for i in range(n)):
            assert got[k] == at
            at += a


def test_area_under_curve_of_many_scores(spark):
    df = spark.range(30_000, numPartitions=2).select((F.col("id") * 7919 % 30_011).cast("double").alias("score"), (F.col("id") % 3 % 2).cast("int").alias("label"))
    rows_ = sorted((r.score, r.label) for r in df.collect())
    won = below = 0
    for _, label in rows_:
        won += below * label
        below += 1 - label
    assert ranking.auc(df).first().auc == pytest.approx(won / (below * (30_000 - below)))


def test_running_sums_cross_ranges(spark):
    rows = [(i * 7919 % 1000, i % 13, float(i % 5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, a long, b double").repartition(5)
    got = {r.k: (r.sa, r.sb) for r in ids.running_sums(df, "k", {"sa": "a", "sb": "b"}).collect()}
    a, b = 0, 0.0
    for k, x, y in sorted(rows):
        assert got[k] == (a, b)
        a, b = a + x, b + y


def test_processed_triplets_keep_null_rows(spark):
    cells = [
        (1, '[{"statement": "It-works", "topic": "PRICE_tag", "sentiment": " Positive"}, null, {"topic": "price"}]'),
        (2, "[{'statement': 'it works', 'topic': 'price tag', 'sentiment': 'positive'}, {'statement': 'b', 'topic': None, 'sentiment': 'odd'}, {}]"),
        (3, None),
        (4, "no list"),
        (5, "[]"),
        (6, "[{'statement': 'c', 'topic': 'cost'}]"),
        (7, "{'statement': 'c'}"),
    ]
    df = spark.createDataFrame(cells, "row_id bigint, statements string")
    repairs = spark.createDataFrame([("cost", "price tag")], "wrong_topic string, topic string")
    rows, words = statements.processed(df, repairs=repairs)
    got = {r.row_id: (r.statement_ids, None if r.statements is None else [tuple(t) for t in r.statements]) for r in rows.collect()}
    works = ("it works", "price tag", "positive")
    assert got == {
        1: ([0], [works]),
        2: ([0, 1], [works, ("b", None, "odd")]),
        3: (None, None),
        4: (None, None),
        5: ([], []),
        6: ([2], [("c", "price tag", None)]),
        7: ([3], [("c", None, None)]),
    }
    assert {(r.sid, r.statement, r.topic, r.sentiment, r.freq) for r in words.collect()} == {(0, *works, 2), (1, "b", None, "odd", 1), (2, "c", "price tag", None, 1), (3, "c", None, None, 1)}
    strict, _ = statements.processed(df, repairs=repairs, topics=["price tag"], sentiments=["positive"])
    assert {r.row_id: r.statement_ids for r in strict.collect()} == {1: [0], 2: [0], 3: None, 4: None, 5: [], 6: [], 7: []}
    none, _ = statements.processed(df.limit(0))
    assert none.count() == 0


def test_words_of_ids_by_a_vocabulary(spark):
    vocabulary = spark.createDataFrame([("good", 5), ("bad", 6)], "word string, idx int")
    rows = [(1, [5, 6, 3, 1, 5]), (2, [1, 5]), (3, []), (4, None), (5, [6, 99, None, 0, 6])]
    got = M.words_of_ids(spark.createDataFrame(rows, "k bigint, ids array<bigint>"), vocabulary, "ids", "k")
    assert {r.k: r.words for r in got.collect()} == {1: ["good", "bad", "<unk>"], 2: [], 3: [], 4: [], 5: ["bad", "<bos>", "bad"]}


def test_evidence_means_are_of_all_history_in_any_order(spark):
    # added as doubles, these have a mean just below 33 in 4,024 of their 5,040 orders
    ratings = [32.23, 28.93, 35.69, 22.22, 34.26, 23.13, 54.54]
    values = [(r, h, h, rating) for r in range(40) for h, rating in enumerate(random.Random(r).sample(ratings, len(ratings)))]
    values += [(50, 0, 0, 10.0), (50, 1, 1, 20.0), (50, 2, 99, 90.0), (51, 0, 0, 1.0), (51, 1, 1, math.nan), (52, 0, 0, 1e300), (52, 1, 1, 1.0)]
    history = spark.createDataFrame(values, "row_id long, history_id long, history_item_id long, history_rating double").repartition(3)
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(7)], "history_item_id long, vector array<double>")
    queries = spark.createDataFrame([(r, [0.0], 1.0 if r % 2 else -1.0) for r in [*range(40), 50, 51, 52]], "row_id long, query array<double>, adjustment double")
    got = {}
    for r in retrieval.evidence(history, vectors, queries, 9, True, "history_item_id").collect():
        got.setdefault(r.row_id, set()).add(r.history_id)
    for row in range(40):
        assert got[row] == {h for r, h, _, rating in values if r == row and (rating >= 33) == (row % 2 == 1)}
    assert got[50] == {0, 1}  # below 40, the mean with the text that has no vector
    assert got[51] == {1}  # no number is under NaN, as in SQL
    assert got[52] == {1}
