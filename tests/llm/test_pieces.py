import hashlib
import os
import random

import numpy as np
import pytest

from claimspark.llm import pieces

DIR = "/root/testdata/sf0.001"
PARTS = ["a", "b", " ", "  ", "▁", "é", "yyyyy", "the ", " the", "\n", "\t", "\0", "𝒳", "<s>", "</s>", "<0x0A>", "<unk>", "你好", "ing", "\r\n", "'", "0", "​", "﷽", "가", "�", "\xa0", "café"]


@pytest.fixture(scope="module")
def model():
    return pieces.MergePieces(pieces.model_path())


def mixed_texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def numbers(blobs):
    return [np.frombuffer(b, np.uint32).tolist() for b in blobs]


def test_encodes_and_decodes_as_the_library(model):
    texts = mixed_texts(8000)
    ids, corrected = model.encode(texts)
    want = model.library.encode(texts)
    assert numbers(ids) == want
    assert not any(corrected)
    assert [model.decode(x) for x in want] == model.library.decode(want)


def test_decodes_any_ids_as_the_library(model):
    rng = random.Random(2)
    rows = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(262) for _ in range(rng.randint(0, 8))] for _ in range(20000)]
    assert [model.decode(x) for x in rows] == model.library.decode(rows)


def test_table_and_heap_agendas_agree(model):
    words = [w for t in mixed_texts(3000, 5) for w in model.stretches(" " + t) if len(w) <= pieces.SHORT]
    assert model.merge_all(words) == [model.merge(w) for w in words]
    assert model.merge_all([]) == []


def test_long_stretches_fall_apart_where_no_piece_reaches(model):
    rng = random.Random(3)
    for text in ("".join(rng.choice("abcdefgh你好ßé\n") for _ in range(5000)), "y" * 20000, "=" * 5000 + "x", " " * 3000):
        got, _ = model.encode([text])
        assert numbers(got) == [model.library.encode(text)]
    assert len(model.apart("你好你好")) > 1
    assert not any(len(k) > pieces.SHORT for k in model.seen)


def test_a_difference_is_found_and_the_library_counts(model, monkeypatch):
    broken = pieces.MergePieces(pieces.model_path())
    monkeypatch.setattr(broken, "merge_all", lambda words: [[5] for _ in words])
    ids, corrected = broken.encode(["two words", ""])
    assert numbers(ids) == [model.library.encode("two words"), []]
    assert corrected == [2, 0]


def test_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 50)
    small = pieces.MergePieces(pieces.model_path())
    texts = mixed_texts(400, 7)
    got = [x for i in range(0, 400, 20) for x in numbers(small.encode(texts[i : i + 20])[0])]
    assert got == small.library.encode(texts)


def test_rows_of_any_kind(spark, model):
    rows = [(1, "two words", 5), (1, "two words", 5), (None, "", 6), (2, None, 7), (3, " ", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long").selectExpr("*", "1 AS decoded").repartition(2)
    got = sorted(((r.doc_id or 0, r.ids, r.decoded) for r in pieces.encode(df).collect()), key=repr)
    two = model.library.encode("two words")
    assert got == sorted([(1, two, "two words"), (1, two, "two words"), (0, [], ""), (2, [], ""), (3, model.library.encode(" "), " ")], key=repr)
    assert pieces.encode(df.limit(0)).count() == 0


def test_other_kinds_of_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(pieces.model_path(), "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = 1
    (tmp_path / "other.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        pieces.MergePieces(str(tmp_path / "other.model"))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_query_equals_the_library(spark, model):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = pieces.op13_pieces(spark, DIR).collect()
    assert {r.doc_id for r in got} == docs.keys()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        ids = model.library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_corrected) == (len(ids), sha(",".join(map(str, ids))), sha(model.library.decode(ids)), 0)
