import hashlib
import math
import os

import numpy as np
import pytest

from claimspark.llm import vector_codes

DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Every part against every entry, in plain integers."""
    kept = [(k, [math.floor(256 * x) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(kept[0][1]) // parts
    part = lambda v, p: v[p * dims : (p + 1) * dims]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[near(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [part(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p] == i]
                if mine:
                    books[p][i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out, by_label = [], {}
    for k, v, label in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((k, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((k, c, e, by_label[label]) for k, c, e, label in out), key=repr), sha


def coded(df, **kw):
    got, books = vector_codes.encode_vectors(df, **kw)
    return sorted((tuple(r) for r in got.collect()), key=repr), vector_codes.digest(books)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    want, sha = brute(rows)
    got = vector_codes.op12_vector_codes(spark, DIR)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    found = got.collect()
    assert {r.codebooks_sha256 for r in found} == {sha}
    assert sorted((tuple(r)[:4] for r in found), key=repr) == want


@pytest.mark.parametrize(("dims", "few"), [(1, 16), (3, 1), (3, 0), (5, 4)])
def test_tries_with_ties_copies_and_bad_rows(spark, monkeypatch, dims, few):
    monkeypatch.setattr(vector_codes, "FEW", few)
    monkeypatch.setattr(vector_codes, "TOGETHER", 70)
    rng = np.random.default_rng(dims)
    grid = (rng.integers(-3, 4, (300, 4 * dims)) / 256).tolist()  # few values: ties and shared prefixes
    rows = [(int(i * 7 % 300), v, [None, 1, 2][i % 3]) for i, v in enumerate(grid)]
    rows += [(5, rows[0][1], 1)] * 40 + [(None, rows[3][1], 9), (None, None, 9), (400, [None] * 4 * dims, 1), (401, [float("nan")] * 4 * dims, 1), (402, [float("-inf")] + [0.0] * (4 * dims - 1), 2), (403, [], 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept = [r for r in rows if r[1]]
    assert coded(df, parts=4, entries=9) == brute(kept, 4, 9)


def test_walk_is_exact_on_a_deep_trie():
    rng = np.random.default_rng(1)
    parts, _, weight = vector_codes._trie(rng.integers(-2, 3, (4000, 6)))
    book = rng.integers(-2, 3, (64, 6))
    code, error = vector_codes.walk(parts, book)
    far = ((parts[:, None] - book) ** 2).sum(axis=2)
    assert (code == far.argmin(axis=1)).all()
    assert (error == far.min(axis=1)).all()
    assert weight.sum() == 4000


def test_empty_tables_few_rows_other_lengths_and_clashing_names(spark):
    assert coded(spark.createDataFrame([], SCHEMA)) == ([], hashlib.sha256(b"").hexdigest())
    assert coded(spark.createDataFrame([(1, None, 1)], SCHEMA))[0] == []
    one = spark.createDataFrame([(3, [0.5] * 16, None), (4, [0.25] * 16, None), (9, [0.1] * 32, 1)], SCHEMA)
    clash = one.selectExpr("*", "1 AS code", "2 AS error", "3 AS _id", "4 AS _label", "5 AS n")
    assert coded(clash)[0] == [(3, "00" * 16, 0, 0), (4, "01" * 16, 0, 0)]  # the row of another length goes
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.encode_vectors(spark.createDataFrame([(1, [1.0] * 10, 1)], SCHEMA))
    far = spark.createDataFrame([(1, [1e300] * 16, 1), (2, [-1e300] * 16, 1), (3, [1.0] * 16, 1)], SCHEMA)
    assert [r[1] for r in coded(far)[0]] == ["00" * 16, "01" * 16, "02" * 16]
