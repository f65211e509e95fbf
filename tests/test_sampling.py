import pytest

from claimspark.operators import sampling


def frame(spark, pairs):
    return spark.createDataFrame([(n, u, i) for n, (u, i) in enumerate(pairs)], "row_id long, user_id string, item_id long").repartition(3)


def test_only_users_with_every_item_get_no_negative(spark):
    has = {"a": set(range(60)) - {17, 41}, "b": set(range(60)), "c": {5}, "d": set(range(59))}
    df = frame(spark, [(u, i) for u, items in has.items() for i in sorted(items)])
    got = sampling.negative_items(df, df.select("item_id")).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.negative_id is None) == (r.user_id == "b")
        assert r.negative_id is None or r.negative_id in set(range(60)) - has[r.user_id]
    assert {r.negative_id for r in got if r.user_id == "a"} == {17, 41}


@pytest.mark.parametrize("kept", [10, 15, 20, 28, 30])
def test_as_many_negative_edges_as_edges(spark, kept):
    pairs = [(u, i) for u in "abc" for i in range(10)]
    known = sorted(pairs, key=lambda p: (p[1] * 7 + ord(p[0])) % 30)[:kept]
    got = sampling.negative_edges(frame(spark, known), frame(spark, pairs).select("user_id"), frame(spark, pairs).select("item_id"), factor=1).collect()
    found = [(r.user_id, r.item_id) for r in got]
    assert len(set(found)) == len(found) == min(kept, 30 - kept)
    assert not set(found) & set(known)
