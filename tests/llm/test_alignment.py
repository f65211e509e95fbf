import hashlib
import json
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from claimspark.llm import alignment, bpe, pieces
from claimspark.llm.token_counts import tokenizer_path

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def brute(rows):
    """From the two libraries, by lists and searches."""
    import sentencepiece
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    a_lib, b_lib = Tokenizer.from_file(path), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    a_lib.encode_special_tokens = True
    names = {i: t for t, i in json.load(open(path))["model"]["vocab"].items()}
    table = letters()
    docs, counts = [], Counter()
    for key, text in rows:
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        raw_a = [bytes(table[c] for c in names[i]) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_lib.id_to_piece(i)]]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            docs.append((key, [], [], "", []))
            continue
        ends_a, ends_b = list(running(raw_a)), list(running(raw_b))
        both = sorted(set(ends_a) & set(ends_b))
        links = [(i, j) for i, x in zip(a, ends_a) for j, y in zip(b, ends_b) if x == y] if len(a) < 300 else [(a[ends_a.index(x)], b[ends_b.index(x)]) for x in both]
        made, low = [], 0
        for x in both:
            made.append(",".join(str(i) for i, e in zip(a, ends_a) if low < e <= x) + "|" + ",".join(str(i) for i, e in zip(b, ends_b) if low < e <= x))
            low = x
        docs.append((key, a, b, ";".join(made), links))
        counts.update(links)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    return [(k, len(a), len(b), made.count(";") + bool(made), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha(made)) for k, a, b, made, links in docs], counts


def running(raw):
    at = 0
    for x in raw:
        at += len(x)
        yield at


TEXTS = [
    "the cat sat on the mat", "the cat sat on the mat", "", None, "café naïve über", "a▁b is changed by B", "no end <|endoftext|> here <s> x </s> <0x0A>", "  two  blanks\n\nand lines \t",
    "你好，世界 𝒳 \0 zero", "don't can't 12345 6.78", " ", "\n", "yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy", "é" * 40, "가나다 ﷽ ​ zero-width",
]


@pytest.mark.parametrize("docs_in_block", [2, 2000])
def test_rows_of_any_kind(spark, monkeypatch, docs_in_block):
    monkeypatch.setattr(alignment, "BLOCK_DOCS", docs_in_block)
    rows = [*enumerate(TEXTS), (None, "the mat"), (0, "on the mat the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS pair", "3 AS n_a").coalesce(2)
    out, counts = alignment.align_documents(df)
    assert out.columns == COLUMNS
    want, n = brute(rows)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert {(r.a, r.b): r.n for r in counts.collect()} == dict(n)
    assert alignment.align_documents(df.limit(0))[0].count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 6000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, alignment.align_documents(df)[0].collect())) == sorted(brute(rows)[0])
    got = alignment.op11_alignment(spark, DIR)
    assert got.columns == COLUMNS
    assert got.count() == spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_groups_are_slices_between_common_ends():
    ends = lambda *sizes: np.cumsum(np.array(sizes, np.int64))
    assert alignment.common_ends(ends(1, 2, 3), ends(3, 1, 2)) == ([2, 3], [1, 3])
    assert alignment.common_ends(ends(), ends()) == ([], [])


def test_texts_are_compared_with_tokens_where_a_tokenizer_may_lose_bytes(monkeypatch):
    both = alignment.Aligner(tokenizer_path("byte_bpe_50k.json"), pieces.model_path())
    whole = [(a.tolist(), b.tolist()) for a, b in both.tokens(TEXTS[4:])] if None not in TEXTS[4:] else []
    monkeypatch.setattr(both, "keeping", False)
    assert [(a.tolist(), b.tolist()) for a, b in both.tokens(TEXTS[4:])] == whole


def test_special_strings_are_plain_and_a_long_text_is_whole():
    a = bpe.load_plain(tokenizer_path("byte_bpe_50k.json"))
    assert 50256 not in memoryview(a.ids([" x <|endoftext|> y\t\t"])[0]).cast("I").tolist()
    both = alignment.Aligner(tokenizer_path("byte_bpe_50k.json"), pieces.model_path())
    text = "some words of a long text, " * 40_000
    ((x, y),) = both.tokens([text])
    made, links = both.groups(x, y)
    assert len(links) == made.count(";") + 1
    assert sum(both.a_size[x]) == sum(both.b_size[y]) == len(text) + 1
