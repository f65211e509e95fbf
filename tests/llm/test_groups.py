import random

from claimspark.llm import embeddings, groups, jaccard


def test_long_paths_in_random_order_are_one_component(spark):
    rng = random.Random(5)
    nodes = rng.sample(range(1 << 40), 5000)
    edges = [(a, b) for p in (nodes[:4000], nodes[4000:]) for a, b in zip(p, p[1:])]
    rng.shuffle(edges)
    got = dict(groups.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect())
    least = {n: min(p) for p in (nodes[:4000], nodes[4000:]) for n in p}
    assert got == least


def test_version_chain_of_documents_is_one_component(spark):
    words = [f"w{i}" for i in range(6000)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(1400)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 1400
    assert {r.component_id for r in got} == {0}


def test_chain_of_vectors_is_one_component(spark):
    from math import cos, sin

    rows = []
    for i in range(1000):  # a curve on the sphere: only neighbours are near
        turn, low = divmod(i, 20)
        rows.append((i, [0.0] * turn + [cos(low * 0.0785), sin(low * 0.0785)] + [0.0] * (50 - turn)))
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    assert len({r.component_id for r in got}) <= 2  # a pair at the limit may be missed
