import random

import numpy as np
import pytest

from claimspark.llm import jaccard


def corpus(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows: list[tuple] = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.6:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.3:
                words = words[: rng.randint(0, len(words))]
        else:
            words = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "region", "pivots"), [(1, 1000, 64), (2, 3, 2), (3, 8, 5), (5, 5, 1)])
def test_equals_brute_force(spark, seed, region, pivots):
    rows = corpus(seed, 150) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a B"), (1005, "Äb c"), (1006, "äb c")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, region int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, region=region, pivots=pivots).collect()}
    want = jaccard.brute_force(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_repeated_rows_and_null_ids(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(5, text), (5, text), (3, text.upper()), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard.near_duplicates(df).collect())
    assert got == [(-1, 0, -1), (-1, 3, 3), (3, 3, 3), (5, 3, 3), (5, 3, 3)]


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_region_join_equals_all_pairs():
    rng = random.Random(4)
    sets = []
    for _ in range(120):
        base = sets[rng.randrange(len(sets))] if sets and rng.random() < 0.7 else np.array(sorted(rng.sample(range(5000), 40)), np.uint64)
        sets.append(np.unique(np.append(base[rng.randint(0, 4) :], [rng.randrange(5000) for _ in range(rng.randint(0, 4))]).astype(np.uint64)))
    region = jaccard.Region(sets, 75)
    got = region.join()
    link = [[100 * len(set(a) & set(b)) >= 75 * len(set(a) | set(b)) for b in sets] for a in sets]
    label = list(range(len(sets)))
    for _ in sets:
        label = [min(label[j] for j in range(len(sets)) if link[i][j]) for i in range(len(sets))]
    assert got.tolist() == label


def test_meeting_keys_lose_no_pair():
    rng = random.Random(6)
    for _ in range(300):
        a = rng.sample(range(1000), rng.randint(1, 60))
        b = a[: rng.randint(1, len(a))] + rng.sample(range(1000, 2000), rng.randint(0, 6))
        sets = [np.array(sorted(x), np.uint64) for x in (a, b)]
        linked = 100 * len(set(a) & set(b)) >= 75 * len(set(a) | set(b))
        bounds = jaccard.size_classes(80, 75)
        (wide_a, own_a), (wide_b, own_b) = (jaccard.meeting_keys(x[: jaccard.prefix_length(len(x), 75)], len(x), 0, bounds, 75) for x in sets)
        wide, own = (wide_a, own_b) if len(a) >= len(b) else (wide_b, own_a)
        assert not linked or set(wide.tolist()) & set(own.tolist())
        assert set(own_a.tolist()) <= set(wide_a.tolist())


def templated(n: int) -> list[tuple[int, str]]:
    """Documents that share most of a template, alike but not linked, with a linked copy of some."""
    frame = " ".join(f"t{i}" for i in range(60))
    return [(i, f"{frame} " + " ".join(f"u{i - (i % 50 == 1)}x{k}" for k in range(14)) + " end" * (i % 50 == 1)) for i in range(n)]


def test_templated_documents_need_few_rounds(spark, monkeypatch):
    rounds = []
    assign = jaccard._assign
    monkeypatch.setattr(jaccard, "_assign", lambda percent: rounds.append(1) or assign(percent))
    rows = templated(4000)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), region=200).collect()}
    assert got == {i: i - (i % 50 == 1) for i, _ in rows}
    assert len(rounds) <= 3


def test_shared_paragraphs_by_squares(spark):
    rng = random.Random(8)
    parts = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(16)]
    rows = [(i, " ".join(rng.sample(parts, 8))) for i in range(300)]
    rows += [(1000 + i, t + " more") for i, t in rows[::7]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, region=40, pivots=4).collect()}
    assert got == jaccard.brute_force(rows)


def test_few_sets_under_the_keys_of_many_need_no_squares(spark, monkeypatch):
    """Frames with one word changed lie under the keys of all documents on the frame, that link with no one."""
    frame = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join([*frame, *(f"u{i}x{k}" for k in range(22))])) for i in range(1200)]
    bare = [(2000 + k, " ".join("changed" if i == 20 + 10 * k else w for i, w in enumerate(frame))) for k in range(5)]
    copies = [(3000 + i, t + " more") for i, t in rows[::100]]
    joined, by_keys = [], jaccard._by_keys
    monkeypatch.setattr(jaccard, "_by_keys", lambda hard, *more: joined.append(hard.count()) or by_keys(hard, *more))
    monkeypatch.setattr(jaccard, "_squares", lambda *_: pytest.fail("squares of a whole cell"))
    df = spark.createDataFrame(rows + bare + copies, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df, region=150).collect()}
    want = {i: i for i, _ in rows} | {i: 2000 for i, _ in bare} | {i: i - 3000 for i, _ in copies}
    assert got == want
    assert joined and max(joined) > 1000


def test_long_texts_are_cut_into_pieces_of_whole_words():
    text = (" ".join(f"w{i % 5000}" for i in range(400000)) + " " + "x" * 3000000 + " a b c").encode()
    data = np.frombuffer(text, np.uint8)
    doc, h = jaccard.shingle_sets(data, np.array([0, len(data)]))
    words = text.decode().split()
    assert len(h) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    both = np.concatenate([data, np.frombuffer(b"w0 w1 w2 w3 w4 w5", np.uint8)])
    doc, h2 = jaccard.shingle_sets(both, np.array([0, len(data), len(both)]))
    assert set(h2[doc == 1].tolist()) <= set(h.tolist())
