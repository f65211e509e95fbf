import pytest
from pyspark.sql import functions as F

from claimspark.operators.ids import require_columns
from claimspark.sources import tables as S
from claimspark.streaming import incremental


def test_csv_keeps_quotes_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nline'), (2, None), (3, "")], "row_id bigint, prediction string")
    place = str(tmp_path / "csv")
    S.write_csv(df.withColumn("reference", F.lit("r")), place)
    got = S.read_csv(spark, place, "row_id bigint, prediction string, reference string")
    assert sorted((r.row_id, r.prediction) for r in got.collect()) == [(1, 'a "q", b\nline'), (2, None), (3, None)]
    assert sorted(r.prediction for r in S.read_predictions(spark, place, "row_id bigint, prediction string, reference string").collect()) == ["", "", 'a "q", b\nline']
    with pytest.raises(ValueError, match="missing"):
        require_columns(df, ["nothing"])


def test_statements_metadata_reviews_and_topics(spark, tmp_path):
    (tmp_path / "sts.csv").write_text(",statement,topic,sentiment,frequency\n4,It works, Price ,POSITIVE,2\n")
    assert [tuple(r) for r in S.read_statements(spark, str(tmp_path / "sts.csv")).collect()] == [(4, "It works", "price", "positive")]
    (tmp_path / "meta.txt").write_text("{'asin': 'a', 'title': \"it's\", 'description': 'd'}\nbroken\n")
    assert [tuple(r) for r in S.read_metadata(spark, str(tmp_path / "meta.txt")).collect()] == [("a", "it's", "d")]
    (tmp_path / "r.json").write_text('{"overall": 4.0, "asin": "i", "reviewerID": "u", "unixReviewTime": 5}\nnot json\n')
    got = S.read_reviews(spark, str(tmp_path / "r.json")).orderBy("rating").collect()
    assert [(r.rating, r.item_id, r["_corrupt_record"]) for r in got] == [(None, None, "not json"), (4.0, "i", None)]
    (tmp_path / "topics.json").write_text('{"Toys": ["price", "age"]}')
    assert {r.topic for r in S.read_topics(spark, str(tmp_path / "topics.json")).collect()} == {"price", "age"}
    (tmp_path / "train.index").write_text("0 2 x 5\n7")
    assert {r.row_id for r in S.read_index(spark, str(tmp_path / "train.index")).collect()} == {0, 2, 5, 7}
    assert [r.text for r in S.read_lines(spark, str(tmp_path / "train.index"), 1).collect()] == ["0 2 x 5"]
    (tmp_path / "prompt.txt").write_text("\n Do this.\n")
    assert S.read_template(spark, str(tmp_path / "prompt.txt")) == "Do this."


def test_metrics_are_written_once(spark, tmp_path):
    m = spark.createDataFrame([("a", 1.0)], "metric string, mean double")
    place = str(tmp_path)
    assert S.write_metrics(m, place, "x", "v1")
    assert not S.write_metrics(m, place, "x", "v1")
    assert S.write_metrics(m, place, "x", "v1", overwrite=True)
    users = spark.createDataFrame([("u", "train")], "user_id string, split string")
    S.write_user_lists(users, place + "/users")
    assert spark.read.parquet(place + "/users").filter("split = 'train'").count() == 1


def test_streams_go_on_where_they_ended(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.createDataFrame([(1, "a"), (2, "b")], "row_id bigint, text string").write.parquet(src)

    def run():
        stream = incremental.read_stream(spark, src, "row_id bigint, text string")
        incremental.score_available(stream, lambda df: df.withColumn("n", F.length("text")), out, check)
        return sorted(r.row_id for r in spark.read.parquet(out).collect())

    assert run() == [1, 2]
    assert run() == [1, 2]
    spark.createDataFrame([(3, "c")], "row_id bigint, text string").write.mode("append").parquet(src)
    assert run() == [1, 2, 3]
    done = spark.read.parquet(out)
    assert [r.row_id for r in S.unprocessed(spark.createDataFrame([(3,), (4,)], "row_id bigint"), done).collect()] == [4]


def test_metadata_literals_are_read_and_other_lines_are_returned(spark, tmp_path):
    lines = [
        "{'asin': 'a', 'title': None, 'description': 'd'}",
        "{'asin': 'b', 'title': u'r\\xe9sum\\xe9', 'description': \"it's\", 'used': True}",
        "{'asin': 'c', 'title': '\\x41 \\u00e9', 'description': ['x', 'y']}",
        '{"asin": "d", "title": "in \\"JSON\\"", "description": null}',
        "{'asin': 'e', 'title': 'two\\nlines', 'price': 1.5, 'related': {'also': ['q']}}",
        "",
        "{'title': 'no asin'}",
        "{'asin': 'broken'",
        "__import__('os').getcwd()",
        "[" * 300 + "]" * 300,
    ]
    (tmp_path / "meta.txt").write_text("\n".join(lines), encoding="utf-8")
    got = {r.asin: (r.title, r.description) for r in S.read_metadata(spark, str(tmp_path / "meta.txt")).collect()}
    assert got == {"a": (None, "d"), "b": ("résumé", "it's"), "c": ("A é", '["x", "y"]'), "d": ('in "JSON"', None), "e": ("two\nlines", None)}
    assert [r.line for r in S.rejected_metadata(spark, str(tmp_path / "meta.txt")).collect()] == lines[6:]
    (tmp_path / "none.txt").write_text("")
    assert S.read_metadata(spark, str(tmp_path / "none.txt")).count() == 0


def test_corpus_of_lines_or_of_a_column(spark, tmp_path):
    (tmp_path / "out.txt").write_text("  one \n\ntwo\t\nthree\n")
    assert sorted(r.text for r in S.read_corpus(spark, str(tmp_path / "out.txt"), most=3).collect()) == ["", "one", "two"]
    rows = [(1, ' a "q", b\nline '), (2, None), (3, ""), (4, "x\\y")]
    place = str(tmp_path / "csv")
    S.write_csv(spark.createDataFrame(rows, "row_id bigint, `said so` string"), place)
    got = [r.text for r in S.read_corpus(spark, place, "said so").collect()]
    assert sorted(got, key=str) == sorted([' a "q", b\nline ', None, None, "x\\y"], key=str)
    with pytest.raises(ValueError, match="missing"):
        S.read_corpus(spark, place, "nothing")
