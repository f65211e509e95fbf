import os
import random

import numpy as np
import pytest

from claimspark.llm import toxicity

DIR = "/root/testdata/sf0.1"


def texts(seed, n, share):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        toxic = rng.random() < share
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        if toxic:
            words += rng.sample(["vile", "Vile!", "rotten", "rottenest"], 2)
        rng.shuffle(words)
        out.append((" ".join(words), int(toxic)))
    return out


def test_learns_from_positive_and_unlabelled_texts():
    f = toxicity.Features()
    sets = lambda rows: [np.array(sorted(f.of(t))) for t, _ in rows]
    positive = [r for r in texts(1, 3000, 0.1) if r[1]]
    model = toxicity.train_nnpu(sets(positive), sets(texts(2, 2000, 0.1)), 0.1)
    got = [(model.score(f.of(t)) >= toxicity.THRESHOLD, bool(y)) for t, y in texts(3, 1000, 0.1)]
    assert np.mean([a == b for a, b in got]) > 0.98


def test_defined_without_training_texts(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(docs, none)
    got = toxicity.score_texts(docs.withColumn("score", docs.doc_id), model).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.learn(docs.limit(0), none).bias < 0
    assert toxicity.score_texts(docs.limit(0), model).count() == 0
    labelled = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 0)], none.schema)
    assert 0 <= toxicity.learn(docs, labelled).score({1, 2}) <= 1


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_held_out_precision_and_recall(spark):
    got = toxicity.op4_toxicity(spark, DIR)
    rows = got.join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").filter("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / max(1, sum(r.predicted for r in rows)) > 0.85
    assert hit / sum(r.toxic for r in rows) > 0.8


def test_many_rows_without_ids_are_drawn_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "UNLABELLED", 300)
    drawn = []
    real = toxicity._sampled
    monkeypatch.setattr(toxicity, "_sampled", lambda *a: drawn.append(real(*a)) or drawn[-1])
    null = spark.range(200_000).selectExpr("cast(null as long) AS doc_id", "concat('text number ', id, ' of many') AS text")
    known = spark.createDataFrame([(i, "you stupid fool") for i in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(5)] + [(9, 0)], "doc_id long, toxic int")
    toxicity.learn(null.unionByName(known), labels)
    assert len(drawn[0]) == 5
    assert 200 < len(drawn[1]) < 400
    hot = spark.range(50_000).selectExpr("7L AS doc_id", "concat('text number ', id) AS text")
    drawn.clear()
    toxicity.learn(hot.unionByName(known), spark.createDataFrame([(7, 1), (9, 0)], "doc_id long, toxic int"))
    assert len(drawn[0]) == 2 * toxicity.POSITIVES
    assert len(drawn[1]) <= 600
