import pytest
from pyspark.sql import functions as F

from claimspark.functions import text as T


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def one(spark, text, column):
    return values(spark, [(text,)], "x string", y=column(F.col("x")))[0][0]


@pytest.mark.parametrize(
    ("raw", "clause"),
    [
        ("I'm happy with my toy. . ", "the user is happy with their toy"),
        ("made in US", "made in the user"),
        ("i.e. fine", "the user.e. fine"),
        ("has  \tgood wheels", "it has good wheels"),
        ("This is ours", "This is the user's"),
        ("We've seen our share", "the user has seen the user's share"),
        ("hasty work", "hasty work"),
    ],
)
def test_clause(spark, raw, clause):
    assert one(spark, raw, T.clause) == clause


def test_paragraph_orders_and_says_things_once(spark):
    schema = "s array<struct<statement string, sentiment string>>"
    rows = [([("Is good", "positive"), ("is Good.", "positive"), ("is bad", "negative"), ("x", "neutral"), ("y", "odd"), ("works", "positive"), ("lasts", "positive")],), ([("x", "neutral")],), ([],), (None,), ([("bad", "negative"), ("x", "neutral")],)]
    got = [r[0] for r in values(spark, rows, schema, p=T.paragraph(F.col("s")))]
    assert got == [
        "The user would appreciate this product because it Is good, it works, and it lasts. However, they may dislike that it is bad. They seem indifferent to x.",
        "The user seems indifferent to x.",
        "",
        "",
        "The user may dislike that bad. They seem indifferent to x.",
    ]


def test_parsing(spark):
    assert one(spark, "[1, 2]", T.parse_numbers) == [1, 2]
    assert one(spark, "[1, x", T.parse_numbers) == []
    assert one(spark, None, T.parse_numbers) == []
    said = "ok [ {'statement': \"it's\", 'topic': 'a', 'sentiment': 'b'} ] and [1]"
    assert one(spark, said, T.first_json_array) == "[ {'statement': \"it's\", 'topic': 'a', 'sentiment': 'b'} ]"
    assert one(spark, "none here", T.first_json_array) is None
    literal = "[{'statement': 'a', 'topic': None, 'sentiment': 'c\\x21'}]"
    assert one(spark, literal, lambda c: T.parse_triplets(c, literals=True))[0].sentiment == "c!"
    assert one(spark, "[{", lambda c: T.parse_triplets(c, literals=True)) is None
    assert one(spark, 'x "summarization": "a \\"b\\"\\n" y', T.summary_value) == 'a "b"\n'
    assert one(spark, "cost 1,234.5 then 3", T.last_number) == 3.0
    assert one(spark, "1,234.5", T.last_number) == 1234.5
    assert one(spark, "none", T.last_number) == 0.0
    assert one(spark, "a [b", T.before_bracket) == "a "
    assert one(spark, '{"summarization": "fine"}', lambda c: T.profile_value(c, "amazon")) == "fine"
    assert one(spark, 'x "summarization": "fine" }', lambda c: T.profile_value(c, "yelp")) == "fine"


def test_sentences(spark):
    assert one(spark, "Dr. A. Smith came.  He left! Ok etc. and so. x", T.sentences) == ["dr. a. smith came.", "he left!", "ok etc. and so.", "x"]
    assert one(spark, None, T.sentences) == []
    assert one(spark, "One two. three. Four", T.capital_sentences) == ["One two. three.", "Four."]
    assert one(spark, "A b. C d. E f. G", lambda c: T.sentence_chunks(c, 3)) == ["A b.. C d.. E f..", "G.."]
    assert one(spark, "", lambda c: T.sentence_chunks(c, 3)) == []
    assert one(spark, "first block here\n\nsecond block here\n\nno", T.paragraphs) == ["first block here", "second block here"]
    assert one(spark, "long enough one. tiny. long enough two.", T.sentence_pairs) == ["long enough one. long enough two.", "long enough two."]
    assert one(spark, "a b c d e", lambda c: T.word_chunks(c, 2)) == ["a b", "c d", "e"]
    assert one(spark, " a  b c ", lambda c: T.first_words(c, 2)) == "a b"


def test_cleaner(spark):
    def clean(text):
        return T.clean_column(spark.createDataFrame([(text,)], "x string"), "x", "y").collect()[0].y

    assert clean("Good toy!! Good  toy! [INST]It is 3.5 stars ,really</s>") == "Good toy! It is 3. 5 stars, really"
    assert clean("tab\tjoins ​words﻿") == "tabjoins words"
    assert clean("good, and cheap, and good, and nice") == "good, and cheap, and nice"
    assert clean("a, b, a.") == "a, b"
    assert clean("ﬁne [ ] ok") == "fine ok"
    assert clean(None) == ""
    assert one(spark, "it 's ( fine ) , ok . really ? <x>", lambda c: T.detokenized(c, ["<x>"])) == "it's( fine), ok. really?"


def test_token_ids(spark):
    ids = F.array(*[F.lit(i).cast("bigint") for i in (7, 8, 9)])
    cols = {"a": T.padded(ids, 5, 2), "b": T.padded(ids, 2), "c": T.padded(ids, 5, 2, left=True), "d": T.padded(ids, 2, left=True), "e": T.framed(ids, 4, 0, 1, 2), "f": T.until(ids, 9), "g": T.until(ids, 5), "h": T.until(ids, 7)}
    got = values(spark, [(1,)], "x int", **cols)[0]
    assert got == ([7, 8, 9, 2, 2], [7, 8], [2, 2, 7, 8, 9], [8, 9], [0, 7, 8, 9, 1, 2], [7, 8], [7, 8, 9], [])


def test_labels_and_numbers(spark):
    rows = [("POS", 1), (" - ", -1), ("1", 0), ("?", 5)]
    got = values(spark, rows, "s string, n int", a=T.sentiment_name(F.col("s")), b=T.sentiment_of_number(F.col("n")))
    assert got == [("positive", "positive"), ("negative", "negative"), ("positive", "neutral"), ("neutral", "neutral")]
    assert one(spark, " Water-Proof_ness ", T.topic_name) == "water proof ness"
    rel = values(spark, [(0.4, 0.4, 0.2), (0.1, 0.45, 0.45), (0.1, 0.2, 0.7)], "e double, n double, c double", r=T.relation(F.col("e"), F.col("n"), F.col("c")))
    assert [r[0] for r in rel] == ["entailment", "neutral", "contradiction"]
    v = values(spark, [([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>", c=T.cosine(F.col("a"), F.col("b")), d=T.squared_distance(F.col("a"), F.col("b")))
    assert v == [(0.0, 5.0), (0.0, 2.0), (1.0, 0.0)]
