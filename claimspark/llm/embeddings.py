"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on many random lines. A vector lies farthest out on the same one of
a block of lines as a vector near to it with a known probability; so each line is sorted and
only its ends are kept, which makes cells, and tables are made of one to three blocks each. For
each pair that shares a cell, the query-centred windows of further lines in which the other
vector lies are counted, and the pair is verified by its cosine in double precision only if the
count passes a limit calibrated for recall. Cells exchange ids, codes of the blocks and rounded
projections; vectors are sent only to cells where they are in pairs that passed.

A crowded cell is first contracted: vectors within a small angle of a leader are linked with
each other without being compared, and pairs of such balls are decided by the leaders' angle
unless that is close to the limit; then their members are compared.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, groups

COSINE = 0.95
#: Half width of a window on a line of standard normal coordinates.
HALF = 1.0
#: Share of pairs at the limit that no table may miss, and that the count may miss.
MISSED, UNCOUNTED = 0.003, 0.001
#: Lines of a block, to choose from, and blocks of a table at most.
LINES, BLOCKS = (16, 32, 64, 128), 4
#: Unrelated vectors that share a cell with a vector, at most.
LOAD = 8192
#: Lines whose windows are counted.
COUNTED = 32
#: Bytes that a table sends for a vector, but for a code of one byte a block, and how many times a vector's own bytes are sent where possible.
ROW_BYTES, TIMES = 52, 4
#: Rows on a side of a square of pairs that is compared at once, and rows that one group gets, about.
SIDE, GROUP = 1024, 4000
#: Members over which a cell is crowded, and the angle of a ball about its leader.
CROWD, BALL = 16384, math.radians(3)


def _normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


@functools.cache
def same_end(lines: int, cosine: float, draws: int = 40000) -> float:
    """How likely two unit vectors of that cosine lie farthest out on the same end of the same line of a block."""
    rng = np.random.default_rng([7, lines])
    x = rng.standard_normal((draws, lines))
    y = cosine * x + math.sqrt(1 - cosine * cosine) * rng.standard_normal((draws, lines))
    return float(np.mean(_outermost(x) == _outermost(y)))


def _outermost(at: np.ndarray) -> np.ndarray:
    """For each row the line where it lies farthest out, doubled, and one more on the positive side."""
    line = np.abs(at).argmax(axis=-1)
    return 2 * line + (np.take_along_axis(at, line[..., None], -1)[..., 0] > 0)


def plan(n: int, cosine: float = COSINE, vector_bytes: int = 256) -> tuple[int, int, int, int]:
    """(lines of a block, blocks of a table, tables, least count of windows) for n vectors.

    Of the choices whose cells are small enough, the one of least work whose tables send TIMES
    the vectors' bytes at most, or else the one that sends the fewest bytes.
    """
    made = []
    for lines in LINES:
        for blocks in range(1, BLOCKS + 1):
            load = n / (2 * lines) ** blocks
            if load > LOAD and (lines, blocks) != (LINES[-1], BLOCKS):
                continue
            tables = math.ceil(math.log(MISSED) / math.log(1 - same_end(lines, cosine) ** blocks))
            sent = tables * (ROW_BYTES + blocks * tables)
            made.append((sent > TIMES * vector_bytes, load * tables * 0.04 + sent * 0.02 if sent <= TIMES * vector_bytes else sent, lines, blocks, tables))
    _, _, lines, blocks, tables = min(made)
    near = math.sqrt(2 - 2 * cosine)
    p = 2 * _normal_cdf(HALF / near) - 1
    least, below = 0, 0.0
    while least < COUNTED:  # the largest count that a pair at the limit misses with probability UNCOUNTED at most
        below += math.comb(COUNTED, least) * p**least * (1 - p) ** (COUNTED - least)
        if below > UNCOUNTED:
            break
        least += 1
    return lines, blocks, tables, least


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length of vectors in the column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        x = flat[starts[rows][:, None] + np.arange(dim)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


_ROW = "tab int, cell long, vec long, codes binary, window binary"


def _project(lines: int, blocks: int, tables: int, seed: int):
    known: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, 2048):
            ids = part.column("vec").to_numpy()
            for rows, x in _units(part.column("embedding")):
                dim = x.shape[1]
                if dim not in known:
                    known[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, COUNTED + tables * blocks * lines))
                at = x @ known[dim]
                windows = [w.tobytes() for w in np.clip(np.round(at[:, :COUNTED] * 16), -127, 127).astype(np.int8)]
                codes = _outermost(at[:, COUNTED:].reshape(len(rows), tables * blocks, lines)).astype(np.uint8)
                h = np.broadcast_to(groups.mix(np.arange(tables, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(dim)), (len(rows), tables))
                for c in codes.reshape(len(rows), tables, blocks).transpose(2, 0, 1):
                    h = groups.mix(h * np.uint64(31) + c.astype(np.uint64))
                packed = [c.tobytes() for c in codes]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))),
                        pa.array(np.ascontiguousarray(h).view(np.int64).ravel()),
                        pa.array(np.repeat(ids[rows], tables)),
                        *(pa.array([b for b in v for _ in range(tables)], pa.binary()) for v in (packed, windows)),
                    ],
                    names=["tab", "cell", "vec", "codes", "window"],
                )

    return run


def _matrix(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype).reshape(table.num_rows, -1)


_PASSED = "tab int, cell long, i int, j int, vec long, partners binary"


def _count(blocks: int, least: int):
    """Pairs within each cell (or square of a large cell) whose windows pass, as lists of partners of the pairs' members."""
    near_window = round(HALF * 16) + 1  # projections are rounded to sixteenths

    def passing(t: int, w, c, rows, cols, same):
        step = max(1, (1 << 22) // (len(cols) * w.shape[1]))
        for a in range(0, len(rows), step):
            r = rows[a : a + step]
            count = (np.abs(w[r][:, None, :] - w[cols][None, :, :]) <= near_window).sum(axis=2, dtype=np.int16)
            p, q = np.nonzero(count >= least)
            p, q = r[p], cols[q]
            if same:
                p, q = p[p < q], q[p < q]
            equal = (c[p, : t + 1] == c[q, : t + 1]).all(axis=2)
            new = equal[:, t] & ~equal[:, :t].any(axis=1)  # an earlier table has had the others
            yield p[new], q[new]

    def run(table: pa.Table) -> pa.Table:
        tab, cell, i, j, vec, slot = (table.column(n).to_numpy() for n in ("tab", "cell", "i", "j", "vec", "slot"))
        order = np.lexsort((vec, j, i, cell, tab))
        tab, cell, i, j, vec, slot = (v[order] for v in (tab, cell, i, j, vec, slot))
        windows = _matrix(table, "window", np.int8)[order].astype(np.int16)
        codes = _matrix(table, "codes", np.uint8)[order]
        codes = codes.reshape(len(codes), -1, blocks)
        change = (tab[1:] != tab[:-1]) | (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        heads = np.flatnonzero(np.append(True, change))
        at, partners = [], []
        for a, b in zip(heads, np.append(heads[1:], len(tab)), strict=True):
            rows, cols = np.flatnonzero(slot[a:b] == i[a]), np.flatnonzero(slot[a:b] == j[a])
            found = list(passing(int(tab[a]), windows[a:b], codes[a:b], rows, cols, i[a] == j[a]))
            p, q = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (rows[:0], rows[:0])
            if not len(p):
                continue
            ranked = np.argsort(p, kind="stable")
            p, q = p[ranked], vec[a:b][q[ranked]]
            members = np.unique(np.concatenate([p, np.searchsorted(vec[a:b], q)]))
            cuts = np.searchsorted(p, np.append(members, b - a))
            at.append(members + a)
            partners.extend(q[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True))
        at = np.concatenate(at) if at else heads[:0]
        out = {"tab": tab[at], "cell": cell[at], "i": i[at], "j": j[at], "vec": vec[at]}
        return pa.table({c: pa.array(v) for c, v in out.items()} | {"partners": pa.array(partners, pa.binary())})

    return run


def _vectors(table: pa.Table) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """For each row its length's matrix and its row there; unit vectors by length."""
    place, by_dim = np.zeros((table.num_rows, 2), np.int64), {}
    for rows, x in _units(table.column("embedding")):
        place[rows, 0], place[rows, 1], by_dim[x.shape[1]] = x.shape[1], np.arange(len(rows)), x
    return place, by_dim


_FOUND = "vec long, links long, hub long, doubtful long"


def _verify(cosine: float):
    """Links of the passed pairs, and a forest of them. Pairs of balls near the limit are doubtful."""
    most = math.acos(cosine)

    def run(table: pa.Table) -> pa.Table:
        rows = np.unique(table.column("vec").to_numpy(), return_index=True)[1]
        partners = table.column("partners").to_pylist()
        every = table.column("vec").to_numpy()
        p = np.repeat(every, [len(x) // 8 for x in partners])
        q = np.frombuffer(b"".join(partners), np.int64)
        once = table.take(rows)
        vec, weight, radius = (once.column(c).to_numpy() for c in ("vec", "weight", "radius"))
        place, by_dim = _vectors(once)
        p, q = np.searchsorted(vec, p), np.searchsorted(vec, q)
        p, q = (x[place[p, 0] == place[q, 0]] for x in (p, q))
        cos = np.empty(len(p))
        for dim, x in by_dim.items():
            mine = np.flatnonzero(place[p, 0] == dim)
            for a in range(0, len(mine), 1 << 14):
                some = mine[a : a + (1 << 14)]
                cos[some] = np.einsum("ij,ij->i", x[place[p[some], 1]], x[place[q[some], 1]])
        slack = radius[p] + radius[q]
        angle = np.arccos(np.clip(cos, -1, 1))
        close = np.where(slack > 0, angle + slack <= most - 1e-6, cos >= cosine)
        doubt = (slack > 0) & ~close & (angle - slack <= most + 1e-6)
        a, b = p[doubt], q[doubt]
        p, q = p[close], q[close]
        links, root = np.zeros(len(vec), np.int64), np.arange(len(vec))
        np.add.at(links, p, weight[q])
        np.add.at(links, q, weight[p])
        while not np.array_equal(root[p], root[q]):  # hooks the roots of both ends to the lesser one
            low = np.minimum(root[p], root[q])
            np.minimum.at(root, root[p], low)
            np.minimum.at(root, root[q], low)
            while not np.array_equal(root, root[root]):
                root[:] = root[root]
        hit = np.flatnonzero(links)
        none = np.full(len(hit), -1)
        out = {"vec": (vec[hit], vec[a]), "links": (links[hit], np.zeros(len(a), np.int64)), "hub": (vec[root[hit]], vec[a]), "doubtful": (none, vec[b])}
        return pa.table({c: pa.array(np.concatenate(v)) for c, v in out.items()})

    return run


def _contract(ball: float):
    """Leaders of a slot of a crowded cell; the other vectors of the slot are within the angle of theirs."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table.column("vec").to_numpy()))
        vec = table.column("vec").to_numpy()
        leader, angle = vec.copy(), np.zeros(len(vec))
        for rows, x in _units(table.column("embedding")):
            left = np.arange(len(rows))
            while len(left):
                cos = x[left] @ x[left[0]]
                near = cos >= math.cos(ball)
                near[0] = True
                leader[rows[left[near]]] = vec[rows[left[0]]]
                angle[rows[left[near]]] = np.arccos(np.clip(cos[near], -1, 1))
                left = left[~near]
        angle[leader == vec] = 0
        return pa.table({"vec": pa.array(vec), "leader": pa.array(leader), "angle": pa.array(angle)})

    return run


def _compare_balls(cosine: float):
    """Links between the members of two balls."""

    def run(table: pa.Table) -> pa.Table:
        vec, ball, copies = (table.column(c).to_numpy() for c in ("vec", "ball", "copies"))
        first, second = np.flatnonzero(ball == table.column("a")[0].as_py()), np.flatnonzero(ball == table.column("b")[0].as_py())
        links = np.zeros(len(vec), np.int64)
        place, by_dim = _vectors(table)
        if len(by_dim) == 1:
            x = by_dim[place[0, 0]][place[:, 1]]
            for k in range(0, len(first), 512):
                some = first[k : k + 512]
                close = x[some] @ x[second].T >= cosine
                links[some] = close @ copies[second]
                links[second] += copies[some] @ close
        hit = np.flatnonzero(links)
        return pa.table({"vec": pa.array(vec[hit]), "links": pa.array(links[hit])} | {c: table.column(c).take(hit) for c in ("a", "b")})

    return run


def _met(points: DataFrame, cosine: float, seed: int) -> tuple[DataFrame, int, int]:
    """Projections of the points by tables, blocks of a table, and the least count."""
    n, vector_bytes = points.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0)) * 4).first()
    lines, blocks, tables, least = plan(n, cosine, max(256, vector_bytes))
    met = common.materialize(common.map_batches(points.select("vec", "embedding"), _project(lines, blocks, tables, seed), _ROW), "projections")
    return met, blocks, least


def _slot(members: str, side: int):
    return F.pmod(F.xxhash64("vec"), F.ceil(F.col(members) / side).cast("int")).cast("int")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, seed: int = 17, side: int = SIDE, crowd: int = CROWD
) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do vectors of different lengths. Equal vectors link; they are compared once and
    counted as often as they occur, so a repeated row counts as another vector. Component ids
    are the smallest vec_id of a component; null ids come after all others. Other columns are
    ignored; an empty table gives an empty result.
    """
    x = F.col("embedding")
    finite = F.coalesce(
        x.isNotNull()
        & (F.size(x) > 0)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists(x, lambda v: v != 0),
        F.lit(False),
    )
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    keyed = rows.select("vec_id", F.when(finite, F.unhex(F.sha2(F.array_join(F.transform(x, lambda v: (v.cast("double") + 0.0).cast("string")), ",").cast("binary"), 256))).alias("digest"), "embedding")
    once = keyed.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    once = common.materialize(once.select(F.monotonically_increasing_id().alias("vec"), "digest", "least", "copies", "embedding"), "vectors")
    member = once.select("vec", F.col("vec").alias("leader"), "digest", "least", "copies")
    points = once.select("vec", F.col("copies").alias("weight"), F.lit(0.0).alias("radius"), "embedding")
    met, blocks, least = _met(points, cosine, seed)
    crowded = common.materialize(met.filter("tab = 0").groupBy("cell").agg(F.count("*").alias("members")).filter(F.col("members") > crowd), "crowded")
    if not crowded.isEmpty():
        placed = met.filter("tab = 0").select("cell", "vec").join(crowded, "cell").withColumn("slot", _slot("members", side)).join(once.select("vec", "embedding"), "vec")
        balls = common.materialize(placed.select("cell", "slot", "vec", "embedding").groupBy("cell", "slot").applyInArrow(_contract(BALL), "vec long, leader long, angle double"), "balls")
        member = common.materialize(once.join(balls, "vec", "left").select("vec", F.coalesce("leader", "vec").alias("leader"), "digest", "least", "copies", F.coalesce("angle", F.lit(0.0)).alias("angle")), "members")
        sums = member.groupBy("leader").agg(F.sum("copies").alias("weight"), F.max("angle").alias("radius"))
        points = common.materialize(sums.join(once.select(F.col("vec").alias("leader"), "embedding"), "leader").select(F.col("leader").alias("vec"), "weight", "radius", "embedding"), "points")
        met, blocks, least = _met(points, math.cos(math.acos(cosine) + 2 * BALL), seed)
    sizes = met.groupBy("tab", "cell").agg(F.count("*").alias("members")).filter("members > 1")
    slots = F.ceil(F.col("members") / side).cast("int")
    squares = F.transform(F.sequence(F.lit(0), slots - 1), lambda k: F.struct(F.least(k, F.col("slot")).alias("i"), F.greatest(k, F.col("slot")).alias("j")))
    bundle = F.pmod(F.xxhash64("tab", "cell", "i", "j"), F.lit(met.count() // GROUP + 1))
    dealt = met.join(sizes, ["tab", "cell"]).withColumn("slot", _slot("members", side)).select("*", F.inline(squares)).drop("members").withColumn("bundle", bundle)
    passed = common.materialize(dealt.groupBy("bundle").applyInArrow(_count(blocks, least), _PASSED), "passed")
    square = F.pmod(F.xxhash64("tab", "cell", "i", "j"), F.lit(passed.count() // GROUP + 1))
    checked = passed.select(square.alias("square"), "vec", "partners").join(points, "vec")
    found = common.materialize(checked.groupBy("square").applyInArrow(_verify(cosine), _FOUND), "links")
    doubtful = common.materialize(found.filter("doubtful >= 0").select(F.col("vec").alias("a"), F.col("doubtful").alias("b")), "doubtful")
    edges = found.filter("doubtful < 0 and vec <> hub").select(F.col("vec").alias("a"), F.col("hub").alias("b"))
    counts = found.filter("doubtful < 0").select(F.col("vec").alias("leader"), "links").groupBy("leader").agg(F.sum("links").alias("links"))
    own = None
    if not doubtful.isEmpty():
        ends = doubtful.select("a", "b", F.explode(F.array("a", "b")).alias("ball"))
        sides = ends.join(member.select(F.col("leader").alias("ball"), "vec", "copies"), "ball").join(once.select("vec", "embedding"), "vec")
        between = common.materialize(sides.groupBy("a", "b").applyInArrow(_compare_balls(cosine), "vec long, links long, a long, b long"), "between")
        edges = edges.unionByName(between.select("a", "b"))
        own = between.groupBy("vec").agg(F.sum("links").alias("more"))
    parts = groups.components(edges)
    weights = points.select(F.col("vec").alias("leader"), "weight")
    joined = member.join(weights, "leader").join(counts, "leader", "left").join(parts, F.col("leader") == F.col("node"), "left").withColumn("component", F.coalesce("component", "leader"))
    joined = joined.join(own, "vec", "left") if own is not None else joined.withColumn("more", F.lit(0))
    links = F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0)) + F.col("weight") - 1
    joined = common.materialize(joined.select("digest", "least", "component", links.cast("long").alias("links")), "joined")
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(names, "component").select("digest", "links", "component_id")
    out = keyed.select("vec_id", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op9_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embedding_duplicates": op9_embedding_duplicates}
#: All pairs by cosine, then reachability.
_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
 u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95),
 r(vec_id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached), c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id)
 SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c"""
ORACLES: dict[str, str] = {"op9_embedding_duplicates": _SQL}
