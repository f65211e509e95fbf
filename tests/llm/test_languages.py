import os
from collections import Counter

import numpy as np
import pytest

from claimspark.llm import languages

DIR = "/root/testdata/sf0.01"


def brute_grams(text):
    out: Counter = Counter()
    word = ""
    for ch in (text or "").lower() + " ":
        if ch.isalpha():
            word += ch
        elif word:
            padded = f"\0{word}\0"
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    g = padded[i : i + n]
                    if g != "\0":
                        out[sum((ord(c) + 1) << (21 * (n - 1 - j)) for j, c in enumerate(g))] += 1
            word = ""
    return out


@pytest.mark.parametrize("text", [None, "", "12 34", "a", "Hello, wörld: hello!", "ab  cd\n\nef-gh", "日本 語"])
def test_grams_equal_brute_force(text):
    numbers, counts = languages.grams(text)
    assert dict(zip(numbers.tolist(), counts.tolist(), strict=True)) == dict(brute_grams(text))


def test_out_of_place_distance():
    a, b = brute_grams("aaa aab abc"), brute_grams("zzz zzy xyz")
    rank = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))]
    profiles = languages.Profiles({"A": rank(a), "Z": rank(b)})
    top = rank(brute_grams("aab zz"))
    distance = {k: sum(abs(p.index(g) - i) if g in p else languages.TOP for i, g in enumerate(top)) for k, p in (("A", rank(a)), ("Z", rank(b)))}
    lang, score = profiles.predict("aab zz")
    assert lang == min(distance, key=distance.get)
    assert score == pytest.approx(1 - distance[lang] / (languages.TOP * len(top)))
    assert profiles.predict("  12 ") == ("und", 0.0)
    assert languages.Profiles({}).predict("abc") == ("und", 0.0)


def test_ranked_keeps_ties_by_number():
    numbers, counts = np.arange(10), np.array([1, 5, 5, 1, 1, 9, 1, 1, 1, 1])
    assert languages.ranked(numbers, counts, 4).tolist() == [5, 1, 2, 0]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_held_out_accuracy(spark):
    got = languages.op5_languages(spark, DIR)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_nulls_and_extra_columns(spark):
    rows = [(1, "the cat and the dog", "en", 1.0), (2, "der hund und die katze", "de", 1.0), (3, None, None, 1.0), (None, "the dog", "en", 1.0), (4, "!!", "de", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    profiles = languages.learn_profiles(df, "text", "lang", "doc_id")
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages.identify(df, profiles).collect()}
    assert got[3] == ("und", 0.0) and got[4] == ("und", 0.0)
    assert got[1][0] == "en" and got[2][0] == "de" and got[None][0] == "en"
    assert languages.learn_profiles(df.limit(0), "text", "lang", "doc_id") == {}
    assert languages.identify(df.limit(0), profiles).count() == 0
