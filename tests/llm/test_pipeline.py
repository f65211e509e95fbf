import random

import pytest

import corpus_pipeline
from claimspark.llm import jaccard, mixing, repeats

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    vocab = {lang: [pre + "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 6))) for _ in range(200)] for lang, pre in (("en", "th"), ("de", "sch"))}
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "de"])
        if rows and rng.random() < 0.4:
            base = rng.choice(rows)
            words, lang = base[1].split(), base[2]
            if words and rng.random() < 0.6:
                words[rng.randrange(len(words))] = rng.choice(vocab[lang])
        else:
            words = [rng.choice(vocab[lang]) for _ in range(rng.randint(3, 90))]
        if rng.random() < 0.3:
            words += ("a passage that several documents share word for word " + lang).split() * 2
        text = " ".join(words)
        rows.append((i, text, lang, rng.choice(["src0", "src1", None]), len(text)))
    rows += [(200, "123 !!", "en", "src0", 6), (201, None, None, None, None), (202, "", "en", "src1", 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "mixing", "packing"]


def test_language_rejects_texts_without_letters(spark, docs):
    got = STAGES["language"](spark, frame(spark, docs), "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in got.collect()} == set(range(90))


def test_one_document_of_each_group_stays(spark, docs):
    got = STAGES["near_duplicates"](spark, frame(spark, docs), "")
    want = {k for k, (_, c) in jaccard.brute_force([(r[0], r[1]) for r in docs]).items() if k == c}
    assert {r.doc_id for r in got.collect()} == want
    assert len(want) < len(docs)


def test_repeats_are_cut_out(spark, docs):
    got = {r.doc_id: r for r in STAGES["repeats"](spark, frame(spark, docs), "").collect()}
    for key, n, kept in repeats.brute_force([(r[0], r[1]) for r in docs]):
        text = kept.decode("utf-8", "ignore")
        if n and not text.strip(" "):
            assert key not in got
        else:
            assert got[key].text == text and got[key].n_chars == len(text)


def test_mixing_meets_the_budget(spark, docs):
    df = frame(spark, docs)
    got = STAGES["mixing"](spark, df, "").collect()
    words = sum(len((r[1] or "").split()) for r in docs)
    longest = max(len((r[1] or "").split()) for r in docs)
    leaves = 2 * 3 * 2
    assert words // 2 <= sum(len((r.text or "").split()) for r in got) <= words // 2 + leaves * longest
    assert len({r.doc_id for r in got}) == len(got)
    assert mixing.WEIGHTS


def test_whole_pipeline(spark, docs, tmp_path):
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {r.doc_id for r in got} <= set(range(90))
