"""Queries that have no SQL, against plain Python over the same tables."""

import hashlib
import math
import os
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimspark.functions import text as T
from claimspark.operators import ranking, textmetrics
from claimspark.plans import registry
from claimspark.plans.frames import interactions, outputs, pair_scores, table

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def run(spark, name):
    return registry.QUERIES[name](spark, DIR).collect()


# --- cleaning -------------------------------------------------------------------------------


#: Input and what each rule must make of it, by hand.
CLEANED = [
    ("It works well... Really,, well!!", "It works well. Really, well!"),
    ("a word , then another ; done .", "a word, then another; done."),
    ("one,two;three", "one, two; three"),
    ("many   blanks  here", "many blanks here"),
    ("a tab\tis a control character", "a tabis a control character"),
    ("[INST] fine work[/INST]", "fine work"),
    ("kept [[ and ]] gone", "kept and gone"),
    ("\ufb01ne \uff21 \u2460", "fine A 1"),
    ("zero\u200bwidth", "zerowidth"),
    ("bell\x07rings", "bellrings"),
    ("The end<|endoftext|>", "The end"),
    ("Good value. good VALUE! Other.", "Good value. Other."),
    ("nice, nice, sturdy", "nice, sturdy"),
    ("first line\nsecond line", "first line second line"),
    ("same\nsame", "same"),
    ("", ""),
    (None, ""),
    ("   ", ""),
]


def test_cleaned_cases(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CLEANED)], "k int, t string").repartition(2)
    got = {r.k: r.c for r in T.clean_column(df, "t", "c").collect()}
    assert got == {k: want for k, (_, want) in enumerate(CLEANED)}


def test_text_cleaned(spark):
    """What must hold for any text: nothing is left to clean, and no word is made up."""
    rows = run(spark, "text_cleaned")
    given = {r.row_id: r.prediction for r in outputs(spark, DIR).collect()}
    assert {r.row_id for r in rows} == given.keys()
    again = {r.k: r.c for r in T.clean_column(spark.createDataFrame([(r.row_id, r.cleaned) for r in rows], "k long, t string"), "t", "c").collect()}
    for r in rows:
        text = r.cleaned
        assert again[r.row_id] == text
        assert text == text.strip() == unicodedata.normalize("NFKC", text)
        assert not [c for c in text if c == "\n" or unicodedata.category(c) in ("Cc", "Cf")]
        assert not any(x in text for x in (" ,", " .", "  ", "..", ",,"))
        assert set(re.findall(r"\w+", text)) <= set(re.findall(r"\w+", unicodedata.normalize("NFKC", given[r.row_id] or "")))
        sentences = [x for x in text.lower().split(". ") if x]
        assert len(sentences) == len(set(sentences))


# --- common subsequences --------------------------------------------------------------------


def lcs(x, y, score=lambda a, b: float(a == b)):
    rows = [[0.0] * (len(y) + 1)]
    for a in x:
        row = [0.0]
        for j, b in enumerate(y):
            row.append(max(rows[-1][j + 1], row[j], rows[-1][j] + score(a, b)))
        rows.append(row)
    return rows[-1][-1]


def words(text):
    return [w for w in re.split(r"\s+", (text or "").lower()) if w]


def test_rouge_lcs(spark):
    got = {r.row_id: r.f for r in run(spark, "rouge_lcs")}
    for r in outputs(spark, DIR).collect():
        p, q = words(r.prediction), words(r.reference)
        n = lcs(p, q)
        want = 2 * n / (len(p) + len(q)) if n else 0.0
        assert got[r.row_id] == pytest.approx(want, abs=2e-6)


def test_rouge_lcs_summary_of_known_lines(spark):
    rows = [
        ("w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5", "w1 w2 w3 w4 w5", 2 * 0.4 * 0.8 / 1.2),
        ("a b\n\nc", "c\nA b", 1.0),
        ("a", "a a a", 2 * 1.0 * (1 / 3) / (4 / 3)),
        ("", "a", 0.0),
        ("x", "y", 0.0),
    ]
    df = spark.createDataFrame([(i, p, r) for i, (p, r, _) in enumerate(rows)], "k int, p string, r string")
    got = {x.k: x.s for x in df.select("k", textmetrics.rouge_l_summary(F.col("p"), F.col("r")).alias("s")).collect()}
    assert got == pytest.approx({i: w for i, (_, _, w) in enumerate(rows)})


def test_rouge_lcs_summary_of_single_lines_is_rouge_l(spark):
    o = outputs(spark, DIR)
    got = o.select(textmetrics.rouge_l_summary(F.col("prediction"), F.col("reference")).alias("a"), textmetrics.rouge_l(F.col("prediction"), F.col("reference")).alias("b"), (F.instr("prediction", "\n") + F.instr("reference", "\n")).alias("n")).collect()
    alike = [r for r in got if r.n == 0]
    assert alike
    assert all(r.a == pytest.approx(r.b) for r in alike)
    assert {r.row_id for r in run(spark, "rouge_lcs_summary")} == {r.row_id for r in o.collect()}


def test_soft_subsequences(spark):
    got = {r.pair: r.score for r in run(spark, "soft_subsequences")}
    best = defaultdict(dict)
    for r in pair_scores(spark, DIR).select("row_index", "ref_sid", "pred_sid", "p2r_entail").collect():
        cell = best[r.row_index]
        cell[r.ref_sid, r.pred_sid] = max(cell.get((r.ref_sid, r.pred_sid), 0.0), r.p2r_entail)
    assert got.keys() == best.keys()
    for pair, cell in best.items():
        x, y = sorted({p for _, p in cell}), sorted({r for r, _ in cell})
        want = lcs(x, y, lambda a, b, cell=cell: cell.get((b, a), 0.0)) / max(len(x), len(y))
        assert got[pair] == pytest.approx(want, abs=2e-6)


# --- sampling -------------------------------------------------------------------------------


def test_negative_items(spark):
    rows = {r.row_id: r for r in interactions(spark, DIR).collect()}
    has, items = defaultdict(set), {r.item_id for r in rows.values()}
    for r in rows.values():
        has[r.user_id].add(r.item_id)
    got = run(spark, "negative_items")
    assert sorted(r.row_id for r in got) == sorted(rows)
    for r in got:
        assert (r.negative_id is None) == (has[r.user_id] == items)
        assert r.negative_id is None or r.negative_id in items - has[r.user_id]
    assert len({r.negative_id for r in got}) > len(items) / 2


def test_negative_edges(spark):
    rows = interactions(spark, DIR).collect()
    edges, users, items = {(r.user_id, r.item_id) for r in rows}, {r.user_id for r in rows}, {r.item_id for r in rows}
    got = [(r.user_id, r.item_id) for r in run(spark, "negative_edges")]
    assert len(got) == len(set(got)) == min(len(edges), len(users) * len(items) - len(edges))
    assert not set(got) & edges
    assert {u for u, _ in got} <= users
    assert {i for _, i in got} <= items


def _xx(seed: int, number: int, size: int) -> int:
    return xxhash.xxh64(number.to_bytes(size, "little", signed=True), seed=seed % (1 << 64)).intdigest()


def test_other_reviews(spark):
    of_item = defaultdict(list)
    for r in interactions(spark, DIR).collect():
        of_item[r.item_id].append(r)
    want = set()
    for item, rows in of_item.items():
        rows.sort(key=lambda r: (hashlib.md5(f"{r.row_id}#0".encode()).hexdigest(), r.row_id))
        n = len(rows)
        for at, r in enumerate(rows):
            want.add((r.row_id, r.user_id, item, r.row_id, 1))
            if n > 1:
                h = _xx(_xx(42, 0, 4), r.row_id, 8)
                h -= (h >> 63) << 64
                other = rows[(at + h % max(n - 1, 1) + 1) % n]
                if other.user_id != r.user_id:
                    want.add((r.row_id, r.user_id, item, other.row_id, 0))
    got = [(r.row_id, r.user_id, r.item_id, r.text_row, r.label) for r in run(spark, "other_reviews")]
    assert len(got) == len(set(got))
    assert set(got) == want


# --- ranking and vectors --------------------------------------------------------------------


def test_recommender_metrics(spark):
    i = interactions(spark, DIR)
    found = ranking.implicit_recommender(i.filter("row_id % 2 = 0"), 10).collect()
    truth, rows = defaultdict(set), Counter()
    for r in i.filter("row_id % 2 = 1").collect():
        truth[r.user_id].add(r.item_id)
        rows[r.user_id] += 1
    ranks = defaultdict(list)
    for r in found:
        if r.item_id in truth[r.user_id]:
            ranks[r.user_id].append(r["rank"])
    each = {}
    for u, t in truth.items():
        if not t:
            continue
        ideal = sum(1 / math.log2(k + 1) for k in range(1, min(len(t), 10) + 1))
        each[u] = {"recall": len(ranks[u]) / len(t), "precision": len(ranks[u]) / 10, "mrr": sum(1 / k for k in ranks[u]), "ndcg": sum(1 / math.log2(k + 1) for k in ranks[u]) / ideal}
    got = run(spark, "recommender_metrics")[0]
    for m in ("recall", "precision", "mrr", "ndcg"):
        assert got[f"{m}_per_user"] == pytest.approx(sum(e[m] for e in each.values()) / len(each), abs=2e-6)
        assert got[f"{m}_per_interaction"] == pytest.approx(sum(e[m] * rows[u] for u, e in each.items()) / sum(rows[u] for u in each), abs=2e-6)
    assert got.precision_per_user > 0.2  # every second interaction is known, items are few


def test_similarity_lists(spark):
    v = {r.vec_id: np.array(r.embedding, float) for r in table(spark, DIR, "embeddings").collect()}
    ids = sorted(v)
    x = np.stack([v[i] / np.linalg.norm(v[i]) for i in ids])
    cos = x @ x.T - 2 * np.eye(len(ids))
    want = {i: int(n) for i, n in zip(ids, (cos >= 1 - 1.1**2 / 2).sum(axis=1), strict=True) if n}
    got = {r["index"]: r for r in run(spark, "similarity_lists")}
    assert sum(want.values()) > 0
    assert all(r.n <= want.get(i, 0) for i, r in got.items())
    assert sum(r.n for r in got.values()) >= 0.9 * sum(want.values())
    assert all(r.best <= cos[ids.index(i)].max() + 2e-6 for i, r in got.items())


def test_vector_clusters(spark):
    v = {r.vec_id: np.array(r.embedding, float) for r in table(spark, DIR, "embeddings").collect()}
    got = {r.vec_id: r.cluster for r in run(spark, "vector_clusters")}
    assert got.keys() == v.keys()
    centres = {c: np.mean([v[i] for i, k in got.items() if k == c], axis=0) for c in set(got.values())}
    nearest = [min(centres, key=lambda c, i=i: np.sum((v[i] - centres[c]) ** 2)) == got[i] for i in v]
    assert np.mean(nearest) > 0.9


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 40, list(range(1000)), [float(i % 7) for i in range(333)]])
def test_percentiles(spark, values):
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "s double").repartition(3)
    got = ranking.percentiles(df, "s", 50).first().t
    assert got == pytest.approx(np.percentile(values, [2 * i for i in range(50)]).tolist())


def test_every_query_without_sql_is_tested_here():
    here = open(__file__).read()
    others = {"core_edges"}  # test_whole_rows
    assert [n for n in registry.QUERIES.keys() - registry.ORACLES.keys() - others if f'run(spark, "{n}")' not in here] == []
