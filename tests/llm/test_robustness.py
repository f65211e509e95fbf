"""Very long texts, nulls, ties, repeated rows, empty tables and clashing names, for operators and stages."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimspark.llm import embeddings, fingerprints, jaccard, languages, mixing, packing, repeats, toxicity

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(1)
    text = " ".join(f"word{rng.randrange(9000)}" + "." * (i % 20 == 19) for i in range(400_000))
    return [(1, text), (2, text + " more"), (3, "y" * 3_000_000), (4, text[:2_000_000]), (5, "short text of a few words"), (6, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_long_texts_join(spark, long_texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, long_texts)).collect()}
    assert {k: c for k, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    words = long_texts[0][1].split()
    assert got[1][0] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


def test_long_texts_lose_their_repeats(spark, long_texts):
    got = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, long_texts)).collect()}
    text = long_texts[0][1]
    assert (got[1].n_removed, got[3].n_removed, got[5].n_removed) == (0, 0, 0)
    assert (got[2].n_removed, got[2].n_bytes) == (len(text), len(text) + 5)
    assert got[2].kept_sha256 == hashlib.sha256(b" more").hexdigest()
    assert got[4].n_removed == 2_000_000


def test_long_texts_are_packed_whole(spark, long_texts):
    rows = long_texts[2:6]
    got = packing.pack(frame(spark, rows)).collect()
    for key, _ in rows:
        mine = sorted((r.start, r.length, r.doc_tokens) for r in got if r.doc_id == key)
        assert sum(n for _, n, _ in mine) == mine[0][2]
        assert [a for a, _, _ in mine] == [sum(n for _, n, _ in mine[:i]) for i in range(len(mine))]


def test_long_texts_in_narrow_operators(spark, long_texts):
    df = frame(spark, long_texts)
    model = toxicity.Model({3: 1.0}, -1.0)
    scores = {r.doc_id: r.score for r in toxicity.score_texts(df, model).collect()}
    assert scores[6] == toxicity.Model({}, -1.0).score(set())
    assert all(0 <= s <= 1 for s in scores.values())
    profiles = {"xx": languages.grams(long_texts[0][1])[0][:50].tolist(), "yy": languages.grams("y" * 100)[0][:50].tolist()}
    found = {r.doc_id: r.lang_pred for r in languages.identify(df, profiles).collect()}
    assert (found[3], found[6]) == ("yy", "und")
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(df).collect()}
    assert len(set(prints.values())) == 6
    edited = {r.doc_id: r for r in fingerprints.edit_likeness(df).collect()}
    assert edited[3].n_chars == 3_000_000
    assert edited[2].near_next > 0.9
    mixed = mixing.mix(df.withColumns({c: F.lit("a") for c in ("domain", "lang", "source")}), {}, 1.0).collect()
    assert sum(r.take_tokens for r in mixed) == sum(len((t or "").split()) for _, t in long_texts)


def test_long_texts_in_the_pipeline(spark, long_texts):
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in long_texts], SCHEMA).coalesce(1)
    assert {r.doc_id for r in STAGES["near_duplicates"](spark, df, "").select("doc_id").collect()} == {1, 3, 4, 5, 6}
    cut = {r.doc_id: r.n_chars for r in STAGES["repeats"](spark, df, "").collect()}
    assert cut == {1: len(long_texts[0][1]), 2: 5, 3: 3_000_000, 5: 25, 6: 0}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, name):
    assert STAGES[name](spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_near_duplicates_are_told_apart_as_rows(spark):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "all other words of another null row")
    rows = [(1, a), (1, b), (2, a), (None, c), (None, b), (3, a.upper()), (None, c), (4, ""), (None, None)]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in STAGES["near_duplicates"](spark, df, "").collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (None, c), (4, ""), (None, "")], key=repr)


def test_stages_ignore_clashing_columns(spark):
    base = "the people of the town had to wait for a long time in the rain"
    rows = [(i, f"{base} {'and then ' * (i % 3)}number {i // 3} went home", "en", "s", 9) for i in range(30)]
    plain = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clash = plain.withColumns({c: F.lit("x") for c in ("row", "part", "digest", "_text", "component_id", "domain", "epoch", "score", "lang_pred", "bucket")})
    for name, stage in corpus_pipeline.STAGES:
        a, b = stage(spark, plain, ""), stage(spark, clash, "")
        assert a.columns == b.columns
        if name != "packing":
            assert a.columns == corpus_pipeline.COLUMNS
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_toxicity_of_repeated_rows_and_ties(spark):
    rows = [(i, "you stupid ugly fool" if i % 4 == 0 else "a nice day in the garden") for i in range(200)]
    docs = spark.createDataFrame([*rows, *rows[:40]], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200, 2)] + [(0, 1), (0, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_texts(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == 240
    by_kind = [{r.score for r in got if (r.doc_id % 4 == 0) == k} for k in (True, False)]
    assert [len(s) for s in by_kind] == [1, 1]  # equal texts have equal scores
    assert by_kind[0].pop() > by_kind[1].pop()
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score_texts(none, toxicity.learn(none, labels)).count() == 0


def test_languages_of_repeated_rows_and_ties(spark):
    train = spark.createDataFrame([(i, "same words in both", lang) for i, lang in enumerate(["bb", "aa"] * 5)], "doc_id long, text string, lang string")
    profiles = languages.learn_profiles(train, "text", "lang", "doc_id")
    docs = spark.createDataFrame([(1, "same words"), (1, "same words"), (None, "same words"), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.lang_pred) for r in languages.identify(docs, profiles).collect())
    assert got == [("1", "aa"), ("1", "aa"), ("2", "und"), ("None", "aa")]
    assert languages.learn_profiles(train.limit(0), "text", "lang", "doc_id") == {}
    assert languages.identify(docs.limit(0), profiles).count() == 0


def test_cell_larger_than_a_square(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    x = (centre + rng.standard_normal((1500, 16)) * 0.12).astype(np.float32).astype(float)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(4)
    got = np.array([r.n_links for r in sorted(embeddings.near_vectors(df).collect(), key=lambda r: r.vec_id)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert (got <= want).all()
    assert got.sum() >= 0.99 * want.sum()


def test_ring_is_one_component(spark):
    from claimspark.llm import groups

    nodes = random.Random(3).sample(range(1 << 40), 5000)
    edges = [(a, b) for a, b in zip(nodes, nodes[1:] + nodes[:1], strict=True)]
    random.Random(4).shuffle(edges)
    got = groups.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()
    assert {r.component for r in got} == {min(nodes)}
    assert len(got) == 5000
