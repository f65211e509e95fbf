import pytest
from tokenizers import Tokenizer

from claimspark.llm import bpe, common, token_counts

PATH = token_counts.tokenizer_path("word_bpe_49k.json")
TEXTS = [
    "Plain words, with 123 numbers!!! and it's o'clock",
    "",
    None,
    " \n\t ",
    "<|endoftext|> inside <|startoftext|>x",
    "ÀÉÎ é Σίσυφος ΣΟΦΟΣ İstanbul",
    "nul\0byte and \x1c separators   wide blanks",
    "日本語 и кириллица 🎉🎉",
    "a" * 3000 + " " + "!?" * 500,
    "x " * 20000,
]


def expected(text):
    return len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def test_counts_are_those_of_the_library(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[0], "x"), (None, TEXTS[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, content string")
    got = token_counts.count_tokens(df, common.shared_dir(spark, "cache"), limit=100).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, len((t or "").encode()), expected(t), expected(t) > 100) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_only_distinct_misses_are_appended(spark):
    cache = common.shared_dir(spark, "cache")
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    token_counts.count_tokens(df, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    more = df.unionByName(spark.createDataFrame([(4, "d"), (5, "c")], df.schema))
    assert token_counts.count_tokens(more, cache).count() == 5
    assert spark.read.parquet(cache).count() == 3
    other = token_counts.count_tokens(df, cache, tokenizer=token_counts.tokenizer_path("byte_bpe_50k.json"))
    assert other.count() == 3
    assert spark.read.parquet(cache).count() == 5


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(df, common.shared_dir(spark, "cache")).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_fast_encoders_equal_the_library(name):
    path = token_counts.tokenizer_path(name)
    library = Tokenizer.from_file(path)
    texts = [t for t in TEXTS if t is not None] + ["two  blanks", " leading", "trailing ", "a\n\nb", "a\nb c", "tab\tbed", "aaaa!!!! bbbb"]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    tokenizer = bpe.load(path)
    assert type(tokenizer) is not bpe.Library
    assert tokenizer.counts(texts) == [len(x) for x in want]
    import numpy as np

    assert [np.frombuffer(x, np.uint32).tolist() for x in tokenizer.ids(texts)] == want


def test_piece_model_counts():
    import sentencepiece

    path = token_counts.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert bpe.load(path).counts(["a b", ""]) == [len(model.encode("a b")), 0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_verified_character_counts_as_in_the_library(name):
    import random
    import re

    path = token_counts.tokenizer_path(name)
    library, fast = Tokenizer.from_file(path), bpe.load(path)
    inside = re.compile(f"[{bpe._VERIFIED}]")
    chars = [chr(c) for c in range(0x20000) if inside.match(chr(c))]
    assert len(chars) > 30000
    rng = random.Random(3)
    texts = [f"{c}a{c}1{c}!{c}" for c in chars] + [f"x{c}{rng.choice(chars)}{rng.choice(chars)} {c}" for c in chars]
    assert fast.counts(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_random_texts_count_as_in_the_library(name):
    import random

    path = token_counts.tokenizer_path(name)
    library, fast = Tokenizer.from_file(path), bpe.load(path)
    rng = random.Random(4)
    sets = [range(0x20, 0x7F), range(0xA0, 0x250), range(0x300, 0x370), range(0x8A0, 0x980), range(0xA640, 0xA7FF), range(0x1E00, 0x2070), range(0x30000, 0x32900), range(0x9, 0x21)]
    texts = ["".join(chr(rng.choice(rng.choice(sets))) for _ in range(rng.randint(1, 12))) for _ in range(50000)]
    assert fast.counts(texts) == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_normal_form_keeps_counts():
    import random
    import re

    library = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "B", "'s", "1", "́", "é", "!", " ", "\t", "\n ", "\r\n", "\x0b", " ", "<|endoftext|>", "Σ"]) for _ in range(rng.randint(1, 15))) for _ in range(20000)]
    forms = [re.sub("[\x09-\x0d ]+", " ", t).strip(" ") for t in texts]
    assert [len(x.ids) for x in library.encode_batch(forms, add_special_tokens=False)] == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    assert bpe.blanks_do_not_count(PATH)
    assert not bpe.blanks_do_not_count(token_counts.tokenizer_path("byte_bpe_50k.json"))


def test_second_run_of_the_query_encodes_nothing(spark, tmp_path):
    rows = [(1, "One  text\n"), (2, "One text"), (3, "another"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cache = f"{common.shared_base(spark)}/token-counts"
    before = token_counts.open_cache(spark, cache).count()
    first = sorted(map(tuple, token_counts.op2_token_counts(spark, str(tmp_path)).collect()))
    after = spark.read.parquet(cache).count()
    again = sorted(map(tuple, token_counts.op2_token_counts(spark, str(tmp_path)).collect()))
    assert first == again
    assert [r[0] for r in first] == [1, 2, 3, 4]
    assert after <= before + 3
    assert spark.read.parquet(cache).count() == after
