import hashlib
import random

import numpy as np

from claimspark.llm import fingerprints as fp


def test_order_does_not_matter_and_paragraphs_come_and_go():
    a = "One. Two.\nThree here. Four.\nFive"
    b = "Five\nOne. Two.\nThree here. Four."
    assert fp.pack(fp.vector(a)) == fp.pack(fp.vector(b))
    assert fp.pack(fp.vector(a)) != fp.pack(fp.vector(a + "\nFive"))
    assert fp.changed(fp.pack(fp.vector(a)), ["Six.", ""], ["Five"]) == fp.pack(fp.vector("One. Two.\nThree here. Four.\nSix.\n"))
    assert fp.pack(fp.vector(None)) == fp.pack(fp.vector(""))


def test_likeness_follows_shared_sentences():
    rng = random.Random(2)
    sentences = [f"Sentence number {rng.random()}." for _ in range(60)]
    a = fp.vector(" ".join(sentences))
    half = fp.vector(" ".join(sentences[:30]) + "\n" + " ".join(f"Other {i}." for i in range(30)))
    assert fp.likeness(a, a) == 1.0
    assert 0.35 < fp.likeness(a, half) < 0.65
    assert fp.likeness(a, fp.vector("Nothing alike.")) < 0.3
    assert fp.likeness(fp.vector(""), fp.vector("")) == 1.0


def test_edited_texts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "ü", "ab"] + ["".join(rng.choice("ab é.\n ") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    rows = [(i * 3, t, 5, 1) for i, t in enumerate(texts)] + [(None, "none", 5, 1), (9, "same id", 5, 1), (9, "same id", 5, 1)]
    df = spark.createDataFrame(rows, 'doc_id long, text string, "range" int, tail int'.replace('"', "`")).repartition(4)
    got = sorted(map(tuple, fp.edit_likeness(df).collect()), key=repr)
    order = sorted(((i is None, -(i or 0), [-ord(c) for c in (t or "")] + [1], i, t or "") for i, t, _, _ in rows))
    want = []
    for k, (*_, i, text) in enumerate(order):
        nxt = order[(k + 1) % len(order)][-1]
        n = len(text)
        edited = text[: n - n // 2] + nxt[: n // 2]
        v, e, x = fp.vector(text), fp.vector(edited), fp.vector(nxt)
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), fp.pack(v), fp.pack(e), fp.likeness(v, e), fp.likeness(v, x)))
    assert got == sorted(want, key=repr)


def test_single_document_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    (r,) = fp.edit_likeness(df).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert r.near_next == 1.0
    assert fp.edit_likeness(df.limit(0)).count() == 0


def test_changes_as_a_table(spark):
    docs = spark.createDataFrame([(1, "a.\nb."), (2, "x"), (3, None)], "doc_id long, text string")
    changes = spark.createDataFrame([(1, "c.", True), (1, "a.", False), (3, "y", True), (9, "z", True)], "doc_id long, paragraph string, inserted boolean").repartition(3)
    got = {r.doc_id: r.fingerprint for r in fp.apply_changes(fp.fingerprints(docs), changes).collect()}
    assert got == {1: fp.pack(fp.vector("b.\nc.")), 2: fp.pack(fp.vector("x")), 3: fp.pack(fp.vector("y"))}
    assert np.array_equal(fp.unpack(got[1])[0], fp.vector("c.\nb.")[0])
