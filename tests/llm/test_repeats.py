import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from claimspark.llm import groups, repeats

SCHEMA = "doc_id long, text string, part int, least string"


def corpus(seed: int, n: int, letters: str = "abé ") -> list[tuple]:
    rng = random.Random(seed)
    shared = ["".join(rng.choice(letters) for _ in range(rng.randint(40, 160))) for _ in range(6)]
    rows = []
    for i in range(n):
        pieces = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 6))]
        if pieces and rng.random() < 0.3:
            cut = rng.randint(0, len(pieces[0]))
            pieces[0] = pieces[0][:cut]
        rows.append((i, "".join(pieces)))
    return rows


@pytest.mark.parametrize(("seed", "hot", "merged"), [(1, 1 << 16, 4096), (2, 4, 4096), (3, 0, 4096), (4, 1 << 16, 1), (5, 4, 2)])
def test_equals_brute_force(spark, seed, hot, merged):
    rows = corpus(seed, 60)
    rng = random.Random(seed)
    texts = [(i, t) for i, t in rows] + [(100, rows[3][1]), (101, None), (102, ""), (None, rows[5][1]), (103, "x" * 49), (104, "y" * 50), (105, "y" * 300), (106, " ".join(map(str, range(9000))))]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in texts], SCHEMA).repartition(5)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(df, hot=hot, merged=merged).collect())
    want = sorted((-1 if k is None else k, n, hashlib.sha256(kept).hexdigest()) for k, n, kept in repeats.brute_force(texts))
    assert got == want
    assert sum(n for _, n, _ in got) > 0


def test_repeated_rows_are_kept_and_spans_are_counted(spark):
    a, b = "".join(f"{i:03d}," for i in range(40)), "".join(f"{i:03d};" for i in range(40))
    df = spark.createDataFrame([(1, a), (1, a), (2, "<" + a + ">" + b), (3, a + "!" + b)], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed, r.n_spans) for r in repeats.remove_repeats(df, keep_text=True).collect()}
    assert got == {(1, 0, 0), (2, 160, 1), (3, 320, 2)}


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_run_length_index_equals_sorting():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    starts = np.cumsum([0, *map(len, strings)])
    index = repeats.RunLengthIndex(data, starts)
    suffixes = [(s[i:], j, i) for j, s in enumerate(strings) for i in range(len(s))]
    suffixes.sort(key=lambda x: (x[0], x[1]))
    row, shared = index.statistics()
    order = [int(starts[j]) + i for _, j, i in suffixes]
    assert np.argsort(row).tolist() == order

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    assert shared[order].tolist() == [0] + [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    runs = np.repeat(index.run_bytes, np.diff(np.append(index.heads, len(data))))
    assert [int(x) for x in runs if x >= 0] == [data[p - 1] for p in order if p not in starts]
    assert len(index.heads) < len(data)


def test_phrase_in_most_documents_is_sent_by_windows(spark):
    rng = random.Random(7)
    phrase = "a phrase of forty-nine bytes that is in every docum"[:49]
    rows = [(i, "".join(rng.choice("xyz") for _ in range(60)) + phrase + "".join(rng.choice("xyz") for _ in range(60))) for i in range(400)]
    rows += [(1000 + i, t[20:]) for i, t in rows[::9]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_removed) for r in repeats.remove_repeats(df, hot=100).collect())
    assert got == sorted((k, n) for k, n, _ in repeats.brute_force(rows))


def test_long_document_in_pieces(monkeypatch):
    rng = random.Random(9)
    data = np.frombuffer("".join(rng.choice("abcd ") for _ in range(5000)).encode(), np.uint8)
    starts = np.array([0, len(data)])
    whole = repeats.Minimizers(data, starts, 50, 24)
    monkeypatch.setattr(repeats, "PIECE", 700)
    cut = repeats.Minimizers(data, starts, 50, 24)

    def chosen(m):
        return np.repeat(m.hash, m.windows).tolist(), np.concatenate([np.arange(f, f + c) for f, c in zip(m.first, m.windows, strict=True)]).tolist()

    assert chosen(whole) == chosen(cut)
    assert len(cut.hash) > len(whole.hash)


def test_long_texts_make_groups_of_their_own(spark):
    texts = [(i, "x" * n) for i, n in enumerate([10] * 50 + [40_000] * 20 + [3_000_000] * 3)]
    table = groups.working_table(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), "doc_id", "text")
    sizes = [r["sum(octet_length(text))"] for r in table.groupBy("part").agg({"doc_id": "count"}).join(table.groupBy("part").agg(F.sum(F.octet_length("text"))), "part").collect()]
    assert max(sizes) <= groups.GROUP_ROWS * groups.PLAIN_BYTES
    assert len(sizes) == 3


def test_groups_of_longer_texts_are_filled(spark, monkeypatch):
    monkeypatch.setattr(groups, "GROUP_ROWS", 64)
    texts = [(i, "x" * (40_000 if i % 10 == 0 else 10)) for i in range(1000)]
    table = groups.working_table(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), "doc_id", "text")
    parts = table.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    assert sum(p.n for p in parts) == 1000
    assert max(p.bytes for p in parts) <= 64 * groups.PLAIN_BYTES
    assert sum(p.bytes > 40_000 for p in parts) <= 100 // 8 + 2  # every tenth text is long, yet eight make a group
    assert len(parts) <= 1000 // 64 + 1 + 100 // 8 + 2


def test_only_stretches_that_share_windows_are_indexed():
    rng = random.Random(8)
    strings = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(50, 76))) for _ in range(9000)]
    strings[5], strings[8000] = strings[4][:60], b"zz" + strings[17][:55]
    data, length = np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings])
    matrix = repeats._stretches(data, np.cumsum(length) - length, length, 76)
    assert [bytes(row[:n]) for row, n in zip(matrix, length)] == strings
    assert all(not row[n:].any() for row, n in zip(matrix, length))
    assert repeats._sharing(matrix, length - 49, 50).tolist() == [4, 5, 17, 8000]
    assert repeats._sharing(matrix[:0], length[:0], 50).tolist() == []
