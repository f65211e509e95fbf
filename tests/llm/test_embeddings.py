import numpy as np
import pytest

from claimspark.llm import embeddings


def brute(rows, limit=0.95):
    good = [(k, np.array(v, float)) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {k: 0 for k, _ in rows}
    label = {k: k for k, _ in rows}
    pairs = []
    for i, (a, x) in enumerate(good):
        for b, y in good[i + 1 :]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= limit:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    for _ in pairs:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return links, label


@pytest.mark.parametrize(("side", "crowd"), [(1024, 16384), (7, 16384), (9, 5)])
def test_recall_against_brute_force(spark, side, crowd):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        if rows and rng.random() < 0.5:
            x = np.array(rows[rng.integers(len(rows))][1]) + rng.standard_normal(32) * rng.choice([0.0, 0.02, 0.15])
        else:
            x = rng.standard_normal(32) * rng.choice([1e-3, 1.0, 1e5])
        rows.append((i, x.astype(np.float32).astype(float).tolist()))
    rows += [(900, None), (901, []), (902, [0.0] * 32), (903, [1.0, None] * 16), (904, [float("nan")] * 32), (905, [float("inf")] * 32), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, digest int").repartition(4)
    got = {r.vec_id: r for r in embeddings.near_vectors(df, side=side, crowd=crowd).collect()}
    links, label = brute(rows)
    found, want = sum(r.n_links for r in got.values()), sum(links.values())
    assert want > 100
    assert 0.98 * want <= found <= want
    assert all(got[k].n_links <= links[k] for k in links)
    assert np.mean([got[k].component_id == label[k] for k in label]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [2.0, 0.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect())
    assert got == [(-1, 3, 4), (4, 3, 4), (7, 3, 4), (7, 3, 4), (9, 0, 9)]


def test_empty_table(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_crowd_of_near_copies_is_contracted(spark, monkeypatch):
    rng = np.random.default_rng(5)
    hot = rng.standard_normal(48)
    x = np.concatenate([hot + rng.standard_normal((2500, 48)) * rng.choice([0.005, 0.01, 0.17], (2500, 1), p=[0.6, 0.35, 0.05]), rng.standard_normal((500, 48))]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    asked = []
    measured = embeddings._met
    monkeypatch.setattr(embeddings, "_met", lambda points, *a: asked.append(points.count()) or measured(points, *a))
    got = sorted((r.vec_id, r.n_links) for r in embeddings.near_vectors(df, crowd=400).collect())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    found = np.array([n for _, n in got])
    assert (found <= want).all()
    assert found.sum() >= 0.995 * want.sum()
    assert asked[0] == 3000
    assert asked[1] < 1200  # leaders and what is outside the crowd


def test_bytes_sent_are_bounded():
    for n in (500, 50_000, 1_000_000, 100_000_000):
        lines, blocks, tables, _ = embeddings.plan(n)
        assert n / (2 * lines) ** blocks <= embeddings.LOAD
        if n <= 10_000_000:
            assert tables * (embeddings.ROW_BYTES + blocks * tables) <= 4 * 256
        lines, blocks, tables, _ = embeddings.plan(n, vector_bytes=4 * 768)
        assert tables * (embeddings.ROW_BYTES + blocks * tables) <= 4 * 4 * 768
