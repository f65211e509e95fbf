import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from claimspark.llm import packing, token_counts


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 1024])
    histogram = {rng.randint(1, capacity): rng.randint(1, 500) for _ in range(rng.randint(0, capacity))}
    patterns = packing.pack_histogram(dict(histogram), capacity)
    held: Counter = Counter()
    for count, pattern in patterns:
        assert count > 0 and sum(pattern) <= capacity
        for length in pattern:
            held[length] += count
    assert held == Counter(histogram)


def test_shortest_pack_first():
    assert packing.pack_histogram({5: 1, 3: 1, 2: 2}, 8) == [(1, (5, 3)), (1, (2, 2))]
    assert packing.pack_histogram({6: 2, 4: 1, 2: 3}, 8) == [(1, (6, 2)), (1, (6,)), (1, (4, 2, 2))]


def test_pieces_are_gapless_and_ids_are_the_library_s(spark):
    rng = random.Random(1)
    texts = ["w" * rng.randint(0, 4) + " word" * rng.randint(0, 40) for _ in range(80)] + [None, "", "a  b\n\n c", "<|endoftext|>", "é" * 500]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(3, "again", 7), (None, "none", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    got = packing.pack(df, capacity=64).collect()
    library = Tokenizer.from_file(token_counts.tokenizer_path("byte_bpe_50k.json"))
    want: Counter = Counter()
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), 64):
            want[(i, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    packs = defaultdict(list)
    for r in got:
        packs[r.sequence_id].append((r.offset, r.length))
    assert sorted(packs) == list(range(len(packs)))
    for pieces in packs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_empty_table_and_no_end(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, text string")
    assert [r.doc_id for r in packing.pack(df, end=None).collect()] == [2]
