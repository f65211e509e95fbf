import math
import os
import random

import pytest

from claimspark.operators import graph
from claimspark.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def brute_core(edges: set, k: int) -> set:
    left = set(edges)
    while True:
        degree: dict = {}
        for a, _ in left:
            degree[a] = degree.get(a, 0) + 1
        weak = {n for n, d in degree.items() if d < k}
        if not weak:
            return left or edges
        left = {(a, b) for a, b in left if a not in weak and b not in weak}


def test_core_edges_come_from_all_interactions(spark):
    from claimspark.plans.frames import interactions

    pairs = {(r.user_id, r.item_id + 100000) for r in interactions(spark, DIR).select("user_id", "item_id").collect()}
    got = [tuple(r) for r in registry.QUERIES["core_edges"](spark, DIR).select("src", "dst").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_core(pairs | {(b, a) for a, b in pairs}, 16)


def all_paths(edges, start, goal, longest):
    ahead = {}
    for a, b, w in edges:
        ahead.setdefault(a, []).append((b, w))
    degree = {b: sum(1 for _, x, _ in edges if x == b) for _, b, _ in edges}
    todo, out = [((start,), 0.0)], []
    while todo:
        path, cost = todo.pop()
        for b, w in ahead.get(path[-1], []):
            if b in path:
                continue
            step = (path + (b,), cost + math.log(degree[b]) - math.log(w))
            if b == goal:
                out.append(step)
            elif len(step[0]) <= longest:
                todo.append(step)
    return sorted(out, key=lambda p: (round(p[1], 9), p[0]))


@pytest.mark.parametrize(("longest", "k", "work"), [(1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 4, 8), (4, 3, 2), (5, 3, 1 << 20)])
def test_best_paths_are_the_cheapest_of_all(spark, longest, k, work):
    rng = random.Random(longest)
    pairs = sorted({(a, b) for a, b in ((int(14 * rng.random() ** 2), rng.randrange(14)) for _ in range(90)) if a != b})
    edges = [(a, b, rng.choice([0.5, 1.0, 1.0, 2.0])) for a, b in pairs]
    asked = [(i, a, b) for i, (a, b) in enumerate([(0, 13), (1, 5), (2, 9), (3, 4), (13, 0), (7, 99)])]
    df = spark.createDataFrame(edges, "src long, dst long, weight double").repartition(3)
    got = graph.best_paths(df, spark.createDataFrame(asked, "pair long, user_id long, item_id long"), k, longest, work=work).collect()
    for pair, a, b in asked:
        want = all_paths(edges, a, b, longest)[:k]
        mine = sorted((r for r in got if r.pair == pair), key=lambda r: r["rank"])
        assert [tuple(r.path) for r in mine] == [p for p, _ in want]
        assert [r.cost for r in mine] == pytest.approx([c for _, c in want])
