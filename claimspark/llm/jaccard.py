"""Exact Jaccard join of documents on word n-grams, in the metric space of the Jaccard distance.

In that space almost all distances are 1, so pivots alone divide nothing. Two exact steps come
first: documents too many of whose shingles occur nowhere else have no partner and leave; the
others meet where the rarest shingles of the smaller and of the larger of two sets, of which
partners must share one, meet. What is connected so is a region.

A region too large for one task takes Spark rounds. In each, a hash chooses many pivots, and
each member is assigned to its nearest one: the Voronoi cell, where pivots that are linked with
each other share a cell. Members that may have partners in another cell, by the triangle
inequality, are replicated to it. Cells are joined in the same way, so that rounds grow with
the logarithm of the region. In a cell that pivots do not divide (its members are all about
equally far from each other) only members that share a meeting key are compared, or, where
that sends more, all of them in squares of blocks; either way a task gets a bounded load.
Members known to be connected already are never compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, groups

WORDS = 5
#: Documents link at this similarity, in hundredths.
PERCENT = 75
#: Bytes of fingerprints that a bucket gets, about.
BUCKET_BYTES = 6 << 20
#: Load of a region that one task joins: a member counts 1, and 1 more for each so many shingles.
REGION, SHINGLES = 1000, 2000
#: Pivots of a region in a round, about.
PIVOTS = 64
#: Large regions up to which their names and loads are broadcast (some 10 MB); more are joined by shuffling.
BROADCAST_ROWS = 100_000

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_POWER = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


def _pieces(raw: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` bytes that end at white space."""
    a = 0
    while a < len(raw):
        b = a + most
        while b < len(raw) and not _BLANK[raw[b]]:
            blanks = np.flatnonzero(_BLANK[raw[b : b + 4096]])
            b += int(blanks[0]) if len(blanks) else 4096
        yield a, min(b, len(raw))
        a = b


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word; no word crosses the documents' bounds."""
    word = ~_BLANK[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = bounds[:-1][np.diff(bounds) > 0]
    first[begins] = word[begins]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    at, to = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.cumsum(np.append(np.uint64(0), groups.BYTE[_LOWER[raw]] * _powers(len(raw), _POWER)), dtype=np.uint64)
    h = (total[to] - total[at]) * _powers(len(raw), pow(_POWER, -1, 1 << 64))[at]
    return groups.mix(h + (to - at).astype(np.uint64)), np.searchsorted(bounds, at, side="right") - 1


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of every distinct shingle, ordered by both.

    Words are runs of bytes other than ASCII white space, lower-cased in A-Z. A document of
    fewer words has its whole sequence as one shingle; one without words has none. Long
    documents are taken piece by piece.
    """
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, b in groups.chunks(starts):
        raw, bounds = data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        if b == a + 1:
            parts = [_words(raw[i:j], np.array([0, j - i])) for i, j in _pieces(raw)]
        else:
            parts = [_words(raw, bounds)] if len(raw) else []
        if not any(len(p[0]) for p in parts):
            continue
        h, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
        count = np.bincount(owner, minlength=b - a)
        whole = len(h) - words + 1
        if whole > 0:
            s = h[:whole].copy()
            for i in range(1, words):
                s = groups.mix(s) + h[i : whole + i]
            same = owner[:whole] == owner[words - 1 :]
            docs.append(owner[:whole][same] + a)
            hashes.append(groups.mix(s[same]))
        for d in np.flatnonzero((count > 0) & (count < words)):
            s = count[d : d + 1].astype(np.uint64)
            for x in h[np.searchsorted(owner, d) : np.searchsorted(owner, d, side="right")]:
                s = groups.mix(s) + x  # an array, so that it wraps round as intended
            docs.append(np.array([d + a]))
            hashes.append(groups.mix(s))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        fresh = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
        doc, h = doc[fresh], h[fresh]
    return doc, h


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _split(keys: np.ndarray, buckets: int):
    cuts = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
    return [(b, int(cuts[b]), int(cuts[b + 1])) for b in range(buckets) if cuts[b] < cuts[b + 1]]


def _one_of_each(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size, set digest as two numbers, whether it is the group's first document of its set)."""
    size = np.bincount(doc, minlength=n_docs)
    one, two = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
    np.add.at(one, doc, groups.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    np.add.at(two, doc, groups.mix(h + np.uint64(0x5851F42D4C957F2D)))
    digest = np.stack([groups.mix(one + size.astype(np.uint64)), two], axis=1)
    _, first = np.unique(np.ascontiguousarray(digest).view("V16").ravel(), return_index=True)
    only = np.zeros(n_docs, bool)
    only[first] = True
    return size, digest, only & (size > 0)


def _send(words: int, buckets: int):
    """Each group's distinct shingles, by bucket, with how many of its different sets have them."""

    def run(table: pa.Table) -> pa.Table:
        data, starts = groups.texts_of(table)
        doc, h = shingle_sets(data, starts, words)
        _, _, only = _one_of_each(doc, h, len(starts) - 1)
        keys, counts = np.unique(_keys(h[only[doc]], buckets), return_counts=True)
        part = table.column("part")[0].as_py()
        parts = _split(keys, buckets)
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in parts], pa.int32()),
                "part": pa.array([part] * len(parts), pa.int64()),
                "prints": pa.array([(keys[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for _, i, j in parts], pa.binary()),
                "counts": pa.array([groups.squeeze(counts[i:j].astype(np.uint16)) for _, i, j in parts], pa.binary()),
            }
        )

    return run


def answer_frequencies(table: pa.Table) -> pa.Table:
    """For each group's shingles in a bucket: the logarithm of the number of sets that have them."""
    blobs = [np.frombuffer(x, np.uint32) for x in groups.column(table, "prints")]
    every = np.concatenate(blobs)
    counts = np.concatenate([groups.expand(x, np.uint16) for x in groups.column(table, "counts")]).astype(np.int64)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    total = np.add.reduceat(counts[order], heads)
    level = np.empty(len(every), np.uint8)
    level[order] = np.repeat(np.log2(total).astype(np.uint8), np.diff(np.append(heads, len(every))))
    cuts = np.cumsum([0, *map(len, blobs)])
    return pa.table(
        {"part": table.column("part"), "bucket": table.column("bucket"), "levels": pa.array([groups.squeeze(level[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())}
    )


def prefix_length(n: int, percent: int) -> int:
    """How many shingles of a set of n a partner may lack, plus one: they must share one of so many."""
    return n - -(-n * percent // 100) + 1


def overlap(a: int, b: int, percent: int) -> int:
    """The least size of the intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def size_classes(n: int, percent: int) -> np.ndarray:
    """Least sizes of classes up to one that holds n: the smaller of two linked sets is in the larger one's class or the one before."""
    bounds = [1, 2]
    while bounds[-1] <= n:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * 100 // percent + 1))
    return np.array(bounds)


def meeting_keys(shingles: np.ndarray, n: int, alone: int, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of (shingle, class of the smaller set) under which a set looks for smaller ones, and lies as the smaller one.

    `shingles` are the first prefix_length of the set's n, rarest first; the first `alone` are in no other set.
    Every smaller partner shares a shingle that is among the first n - overlap + 1 of both.
    """
    c = int(np.searchsorted(bounds, n, side="right")) - 1
    least = -(-n * percent // 100)
    wide = []
    for k in (c, c - 1):
        if k >= 0 and (k == c or int(bounds[c]) - 1 >= least):
            top = n - overlap(n, max(int(bounds[k]), least), percent) + 1
            wide.append(groups.mix(shingles[alone:top] + np.uint64(k)))
    own = groups.mix(shingles[alone : n - overlap(n, n, percent) + 1] + np.uint64(c))
    return np.concatenate(wide), own


_SETS = "part long, row long, doc_id long, n_shingles long, digest binary, shingles binary, wide array<long>, own array<long>"


def _survivors(words: int, buckets: int, percent: int):
    """Every document with its set's size and digest; once a group, the sets that may have partners."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {"n_shingles": [], "digest": [], "shingles": [], "wide": [], "own": []}
        names = {c: docs.column(c) if docs.num_rows else pa.array([], pa.int64()) for c in ("part", "row", "doc_id")}
        if docs.num_rows:
            data, starts = groups.texts_of(docs)
            doc, h = shingle_sets(data, starts, words)
            size, digest, only = _one_of_each(doc, h, len(starts) - 1)
            keys = _keys(h, buckets)
            distinct = np.unique(keys[only[doc]])
            level = np.zeros(len(distinct), np.uint8)
            answers = dict(zip(groups.column(told, "bucket"), groups.column(told, "levels"), strict=True))
            for b, i, j in _split(distinct, buckets):
                level[i:j] = groups.expand(answers[b], np.uint8)
            mine = level[np.searchsorted(distinct, keys)] if len(keys) else level
            shared = np.bincount(doc, weights=mine > 0, minlength=len(size)).astype(np.int64)
            cuts = np.searchsorted(doc, np.arange(len(size) + 1))
            bounds = size_classes(int(size.max()), percent)
            for d in range(len(size)):
                n = int(size[d])
                most = prefix_length(n, percent)
                alone = n - int(shared[d])
                out["n_shingles"].append(n)
                out["digest"].append(digest[d].tobytes() if n else None)
                if only[d] and alone < most:
                    s, lv = h[cuts[d] : cuts[d + 1]], mine[cuts[d] : cuts[d + 1]]
                    wide, own = meeting_keys(s[np.lexsort((s, lv))[:most]], n, alone, bounds, percent)
                    out["shingles"].append(s.tobytes())
                    out["wide"].append(wide.view(np.int64))
                    out["own"].append(own.view(np.int64))
                else:
                    for name in ("shingles", "wide", "own"):
                        out[name].append(None)
        types = {"n_shingles": pa.int64(), "wide": pa.list_(pa.int64()), "own": pa.list_(pa.int64())}
        return pa.table(names | {c: pa.array(v, types.get(c, pa.binary())) for c, v in out.items()})

    return run


def _links(inter: np.ndarray, a, b, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


class Region:
    """Sets of a region, the sets that hold each shingle, and the links between sets as a forest."""

    def __init__(self, sets: list[np.ndarray], percent: int, known: list[str | None] | None = None) -> None:
        self.percent = percent
        self.size = np.array([len(s) for s in sets], np.int64)
        self.bounds = np.cumsum(np.append(0, self.size))
        _, self.shingle = np.unique(np.concatenate(sets), return_inverse=True)
        self.holders = np.repeat(np.arange(len(sets)), self.size)[np.argsort(self.shingle, kind="stable")]
        self.count = np.bincount(self.shingle)
        self.start = np.cumsum(np.append(0, self.count))
        self.root = np.arange(len(sets))
        first: dict[str, int] = {}
        for i, name in enumerate(known or []):  # members of one name are connected already
            if name is not None:
                self.union(first.setdefault(name, i), i)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)

    def shared_with(self, i: int) -> np.ndarray:
        """Sizes of the intersections of i's set with every set."""
        mine = self.shingle[self.bounds[i] : self.bounds[i + 1]]
        n = self.count[mine]
        heads = np.cumsum(n) - n
        at = np.repeat(self.start[mine] - heads, n) + np.arange(n.sum())
        return np.bincount(self.holders[at], minlength=len(self.size))

    def linked(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the others link with i, and the distances."""
        inter = self.shared_with(i)[others]
        either = self.size[others] + self.size[i] - inter
        return 100 * inter >= self.percent * either, 1 - inter / either

    def join(self) -> np.ndarray:
        """The smallest member that links lead to, for every member."""
        reach = 1 - self.percent / 100
        left = np.arange(len(self.size))
        while len(left) > 1:
            pivot, left = left[0], left[1:]
            near, distance = self.linked(pivot, left)
            cell, far = left[near], distance[near]
            for i in cell.tolist():
                self.union(pivot, i)
            outside, away = left[~near], distance[~near]
            boundary = away <= 2 * reach + 1e-9
            for y, d in zip(outside[boundary].tolist(), away[boundary], strict=True):
                if self.find(y) == self.find(pivot):
                    continue  # one link to the cell is enough: all of the cell is one component
                window = cell[far >= d - reach - 1e-9]
                if len(window) and self.linked(y, window)[0].any():
                    self.union(pivot, y)
            left = outside
        return np.array([self.find(i) for i in range(len(self.size))], np.int64)

    def join_sides(self, side: np.ndarray) -> np.ndarray:
        """As join, but only links between the two sides count."""
        others = np.flatnonzero(side)
        for i in np.flatnonzero(~side).tolist():
            for j in others[self.linked(i, others)[0]].tolist():
                self.union(i, j)
        return np.array([self.find(i) for i in range(len(self.size))], np.int64)


def _join_region(percent: int):
    """Edges of a forest of a region's links; where there are slots, of a square of two blocks."""

    def run(table: pa.Table) -> pa.Table:
        digests = groups.column(table, "digest")
        if len(digests) == 1:
            return pa.table({"a": pa.array(digests, pa.binary()), "b": pa.array(digests, pa.binary())})
        order = sorted(range(len(digests)), key=lambda i: digests[i])
        sets, known = groups.column(table, "shingles"), groups.column(table, "known")
        region = Region([np.frombuffer(sets[i], np.uint64) for i in order], percent, [known[i] for i in order])
        side = None
        if "slot" in table.column_names and table.column("i")[0].as_py() != table.column("j")[0].as_py():
            side = (table.column("slot").to_numpy() == table.column("j")[0].as_py())[order]
        root = region.join() if side is None else region.join_sides(side)
        names = [digests[i] for i in order]
        return pa.table({"a": pa.array(names, pa.binary()), "b": pa.array([names[r] for r in root], pa.binary())})

    return run


_CELLS = "region string, digest binary, shingles binary, known string, load double, before double, distance double, nearest double, home boolean, a binary, b binary"


def _assign(percent: int):
    """A chunk of a region's members by its pivots: links to pivots, and a row for each cell where a member has its home or may have partners."""
    reach = 1 - percent / 100

    def run(members: pa.Table, pivots: pa.Table) -> pa.Table:
        out: dict[str, list] = {n.split()[0]: [] for n in _CELLS.split(", ")}

        def row(**values) -> None:
            for name, column in out.items():
                column.append(values.get(name))

        if members.num_rows:
            region = members.column("region")[0].as_py()
            by_name = dict(sorted(zip(groups.column(pivots, "pivot"), groups.column(pivots, "pivot_set"), strict=True)))
            names = list(by_name)
            centres = [np.frombuffer(x, np.uint64) for x in by_name.values()]
            between = Region(centres, percent)
            for i in range(len(centres)):
                for j in np.flatnonzero(between.linked(i, np.arange(len(centres)))[0]).tolist():
                    between.union(i, j)
            heads, cell_of = np.unique([between.find(i) for i in range(len(centres))], return_inverse=True)
            for i, c in enumerate(cell_of.tolist()):
                if i != heads[c]:
                    row(a=names[i], b=names[heads[c]])
            flat = np.concatenate(centres)
            order = np.argsort(flat, kind="stable")
            ranked, owner = flat[order], np.repeat(np.arange(len(centres)), [len(x) for x in centres])[order]
            sizes = np.array([len(x) for x in centres])
            for digest, packed, known, load in zip(*(groups.column(members, c) for c in ("digest", "shingles", "known", "load")), strict=True):
                mine = np.frombuffer(packed, np.uint64)
                left, right = np.searchsorted(ranked, mine), np.searchsorted(ranked, mine, side="right")
                n = right - left
                at = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
                inter = np.bincount(owner[at], minlength=len(centres))
                either = sizes + len(mine) - inter
                near, distance = 100 * inter >= percent * either, 1 - inter / either
                away, met = np.full(len(heads), 2.0), np.full(len(heads), -1)
                np.minimum.at(away, cell_of, distance)
                met[cell_of[near]] = np.flatnonzero(near)
                for p in met[met >= 0].tolist():
                    if names[p] != digest:
                        row(a=digest, b=names[p])
                home = int(np.argmin(away))
                for c in np.flatnonzero(away[: home + 1] <= away[home] + 2 * reach + 1e-9).tolist():
                    cell = f"{region}.{names[heads[c]].hex()}"
                    row(region=cell, digest=digest, shingles=packed, known=cell if met[c] >= 0 else known, load=load, before=members.column("total")[0].as_py(), distance=float(away[c]), nearest=float(away[home]), home=c == home)
        types = {"region": pa.string(), "known": pa.string(), "load": pa.float64(), "before": pa.float64(), "distance": pa.float64(), "nearest": pa.float64(), "home": pa.bool_()}
        return pa.table({c: pa.array(v, types.get(c, pa.binary())) for c, v in out.items()})

    return run


def _squares(hard: DataFrame, percent: int, most: float) -> DataFrame:
    """Links of regions that pivots do not divide: every two blocks of a region meet in a task."""
    slots = F.ceil(F.col("total") / most).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda k: F.struct(F.least(k, F.col("slot")).alias("i"), F.greatest(k, F.col("slot")).alias("j")))
    blocks = hard.withColumn("slots", slots).withColumn("slot", F.pmod(F.xxhash64("digest"), F.col("slots")).cast("int"))
    return blocks.select("region", "digest", "shingles", "known", "slot", F.inline(meets)).groupBy("region", "i", "j").applyInArrow(_join_region(percent), "a binary, b binary")


def _join_meetings(percent: int):
    """Edges between sets that look for smaller ones and the smaller ones of a bucket of meeting keys."""

    def run(table: pa.Table) -> pa.Table:
        digests, sets, known = (groups.column(table, c) for c in ("digest", "shingles", "known"))
        region = Region([np.frombuffer(x, np.uint64) for x in sets], percent, known)
        own = table.column("own").to_numpy(zero_copy_only=False)
        root = region.join_sides(own if 2 * own.sum() > len(own) else ~own)  # goes through the side with fewer sets
        return pa.table({"a": pa.array(digests, pa.binary()), "b": pa.array([digests[r] for r in root], pa.binary())})

    return run


def _meetings(hard: DataFrame, keys: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    """Who meets by keys in regions that pivots do not divide, and which regions send less so than in squares.

    A key counts where a member lies under it as the smaller one and another looks there. Keys fall into as many
    buckets as a square has blocks; in a bucket the smaller ones and those who look are cut into blocks each, and
    every two blocks of the two sides meet. A key of nearly all members costs one side's rows times the other
    side's blocks, so a few sets under the keys of many cost nothing like a square.
    """
    lying = hard.select("region", "digest", "load", "total").join(keys, "digest")
    looked = lying.select("region", "digest", "load", "total", "own", F.explode("wide").alias("key"))
    each = common.materialize(looked.select("region", "digest", "load", "total", "key", F.array_contains("own", F.col("key")).alias("own")), "keys")
    live = each.groupBy("region", "key").agg(F.count("*").alias("_n"), F.max("own").alias("_own")).filter("_own and _n > 1").select("region", "key")
    bucket = F.pmod(F.xxhash64("key"), F.ceil(F.col("total") / most)).cast("int")
    sides = F.explode(F.when(F.col("own"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    met = each.join(live, ["region", "key"]).select("region", "digest", "load", "total", bucket.alias("bucket"), sides.alias("own")).distinct()
    met = common.materialize(met, "meetings")
    weight = lambda own: F.coalesce(F.sum(F.when(F.col("own") == own, F.col("load"))), F.lit(0.0))
    buckets = met.groupBy("region", "bucket").agg(F.max("total").alias("_total"), weight(True).alias("_less"), weight(False).alias("_more"))
    buckets = buckets.withColumns({"less": F.greatest(F.lit(1), F.ceil(F.col("_less") * 2 / most)).cast("int"), "more": F.greatest(F.lit(1), F.ceil(F.col("_more") * 2 / most)).cast("int")})
    buckets = common.materialize(buckets, "meeting-blocks")
    cost = F.sum(F.col("_less") * F.col("more") + F.col("_more") * F.col("less"))
    chosen = buckets.groupBy("region").agg(cost.alias("_cost"), F.max("_total").alias("_total")).filter(F.col("_cost") <= F.col("_total") * F.ceil(F.col("_total") / most))
    # a region without any live key has no link left to find
    squares = hard.select("region").distinct().join(chosen, "region", "left_anti").join(buckets.select("region").distinct(), "region", "left_semi")
    blocks = buckets.select("region", "bucket", "less", "more").join(chosen.select("region"), "region", "left_semi")
    return met.join(blocks, ["region", "bucket"]).drop("load", "total"), common.materialize(squares, "squares")


def _by_keys(hard: DataFrame, meetings: DataFrame, percent: int) -> DataFrame:
    mine, others = (F.when(F.col("own"), F.col(a)).otherwise(F.col(b)) for a, b in (("less", "more"), ("more", "less")))
    slot = F.pmod(F.xxhash64("digest"), mine).cast("int")
    dealt = meetings.select("region", "digest", "bucket", "own", slot.alias("slot"), F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    i, j = F.when(F.col("own"), F.col("slot")).otherwise(F.col("other")), F.when(F.col("own"), F.col("other")).otherwise(F.col("slot"))
    sent = dealt.withColumns({"i": i, "j": j}).join(hard.select("region", "digest", "shingles", "known"), ["region", "digest"])
    return sent.groupBy("region", "bucket", "i", "j").applyInArrow(_join_meetings(percent), "a binary, b binary")


def _pairs_of(regions: DataFrame, keys: DataFrame, percent: int, most: float, pivots: int) -> DataFrame:
    """Edges (a, b) that connect what links connect. Regions of a load over `most` first take pivot rounds.

    keys (digest, wide, own) are the meeting keys of sets.
    """
    found: list[DataFrame] = []
    load = 1 + F.octet_length("shingles") / (8 * SHINGLES)
    rest = common.materialize(regions.select("region", "digest", "shingles", F.lit(None).cast("string").alias("known"), load.alias("load"), F.lit(None).cast("double").alias("before")), "regions")
    reach = 1 - percent / 100
    while True:
        sizes = rest.groupBy("region").agg(F.sum("load").alias("total"), F.count("*").alias("members"), F.min("digest").alias("least"), F.count("known").alias("named"), F.min("known").alias("one"), F.max("known").alias("other"), F.min("before").alias("was"))
        settled, whole = F.expr("coalesce(named = members and one = other, false)"), F.coalesce(F.col("total") > F.col("was") / 2, F.lit(False))
        over = common.materialize(sizes.filter(F.col("total") > most).select("region", "total", "members", "least", settled.alias("settled"), (whole & ~settled).alias("hard")), "large")
        n_large, n_hard = over.agg(F.count("*"), F.count_if("hard")).first()
        sent = F.broadcast(over) if n_large <= BROADCAST_ROWS else over  # one task must not get a large region only to find its size
        small = rest.join(sent.select("region"), "region", "left_anti") if n_large else rest
        found.append(common.materialize(small.groupBy("region").applyInArrow(_join_region(percent), "a binary, b binary").filter("a <> b"), "links"))
        if not n_large:
            break
        large = rest.join(sent, "region").filter("not settled").drop("settled")
        if n_hard:
            hard = common.materialize(large.filter("hard"), "hard")
            meetings, in_squares = _meetings(hard, keys, most)
            found.append(common.materialize(_by_keys(hard, meetings, percent).filter("a <> b"), "links"))
            if not in_squares.isEmpty():
                found.append(common.materialize(_squares(hard.join(in_squares, "region", "left_semi"), percent, most).filter("a <> b"), "links"))
        large = large.filter("not hard")
        chunks = F.ceil(F.col("total") / most).cast("int")
        dealt = large.withColumn("chunk", F.pmod(F.xxhash64("digest"), chunks).cast("int"))
        chosen = F.pmod(F.xxhash64("region", "digest"), F.col("members")) < pivots
        picked = large.filter(chosen | (F.col("digest") == F.col("least")))
        picked = common.materialize(picked.select("region", F.col("digest").alias("pivot"), F.col("shingles").alias("pivot_set"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")), "pivots")
        assigned = common.materialize(dealt.groupBy("region", "chunk").cogroup(picked.groupBy("region", "chunk")).applyInArrow(_assign(percent), _CELLS), "cells")
        found.append(assigned.filter("a is not null").select("a", "b"))
        cells = assigned.filter("region is not null").drop("a", "b")
        # what the triangle inequality leaves: members within reach of the cell's own, its core within reach of others
        core = F.coalesce(F.col("known") == F.col("region"), F.lit(False))
        spans = cells.groupBy("region").agg(F.max(F.when(F.col("home"), F.col("distance"))).alias("radius"), F.min(F.when(~core, F.col("distance"))).alias("open"))
        inside = (F.col("home") | (F.col("distance") <= F.col("radius") + reach + 1e-9)) & (~core | (F.col("distance") >= F.col("open") - reach - 1e-9))
        rest = common.materialize(cells.join(spans, "region").filter(inside).select("region", "digest", "shingles", "known", "load", "before"), "regions")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return common.materialize(out.distinct(), "links")


def _classes(table: DataFrame, words: int, percent: int, region: float, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(part, row, doc_id, n_shingles, digest) of a working table's documents, and (digest, component) of sets with links."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    size = groups.total_bytes(table)
    buckets = int(min(1 << 20, max(8, size * 2 // 3 // BUCKET_BYTES + 1)))
    prints = table.groupBy("part").applyInArrow(_send(words, buckets), "bucket int, part long, prints binary, counts binary")
    levels = common.materialize(prints.groupBy("bucket").applyInArrow(answer_frequencies, "part long, bucket int, levels binary"), "levels")
    sets = common.materialize(table.groupBy("part").cogroup(levels.groupBy("part")).applyInArrow(_survivors(words, buckets, percent), _SETS), "sets")
    open_sets = sets.filter(F.col("shingles").isNotNull())
    once = common.materialize(open_sets.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("shingles", "wide", "own"))), "distinct-sets")
    hubs = once.select("digest", F.explode("own").alias("key")).groupBy("key").agg(F.min("digest").alias("hub"))
    met = once.select("digest", F.explode("wide").alias("key")).join(hubs, "key").filter("digest <> hub").select(F.col("digest").alias("a"), F.col("hub").alias("b")).distinct()
    regions = groups.components(met).select(F.col("node").alias("digest"), F.hex("component").alias("region"))
    links = _pairs_of(once.select("digest", "shingles").join(regions, "digest"), once.select("digest", "wide", "own"), percent, region, pivots)
    return sets.select("part", "row", "doc_id", "n_shingles", "digest"), groups.components(links).select(F.col("node").alias("digest"), "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, region: float = REGION, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links lead to) of every document.

    Sets are of 64-bit hashes of shingles. Equal sets link, so repeated rows and exact copies
    get one component. Null, empty and blank texts have no shingle, link with nothing and are
    their own component. A null id never names a component with others in it. Other columns
    are ignored; an empty table gives an empty result. Long texts are whole; groups of them are
    bounded by their bytes.
    """
    kept, linked = _classes(groups.working_table(docs, id_col, text_col), words, percent, region, pivots)
    of_set = kept.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("least"))
    joined = of_set.join(linked, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = common.materialize(joined.join(names, "component").select("digest", "component_id"), "names")
    return kept.join(named, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _rows_of(docs: pa.Table, chosen: pa.Table) -> pa.Table:
    """The chosen rows of a group."""
    if not docs.num_rows:
        return docs.drop_columns(["part", "row"])
    return docs.filter(pa.array(np.isin(docs.column("row").to_numpy(), chosen.column("row").to_numpy()))).drop_columns(["part", "row"])


def without_near_duplicates(docs: DataFrame, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text (null as empty) and the columns to keep of one row of each component: of its smallest id, null ids last.

    Rows are told apart as rows, so repeated and null ids neither keep copies nor lose other
    texts; of rows alike in id, one stays. Texts without a shingle all stay.
    """
    table = groups.working_table(docs, id_col, text_col, keep)
    kept, linked = _classes(table, words, percent, REGION, PIVOTS)
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("row"), F.col("part"))
    of_set = kept.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(place).alias("first"))
    joined = of_set.join(linked, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    best = joined.groupBy("component").agg(F.min("first").alias("first")).select("first.part", "first.row")
    chosen = common.materialize(best.unionByName(kept.filter(F.col("digest").isNull()).select("part", "row")), "chosen")
    # groups meet their chosen rows where they lie, so that no text is shuffled
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name not in ("part", "row"))
    whole = table.groupBy("part").cogroup(chosen.groupBy("part")).applyInArrow(_rows_of, schema)
    return whole.select("doc_id", "text", *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)])


def brute_force(texts: list[tuple[int, str | None]], words: int = WORDS, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """id to (set size, component) by comparing all pairs, for tests; ids are distinct."""
    import re

    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for key, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
        sets[key] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    label = {k: k for k in sets}
    keys = sorted(sets)
    for _ in keys:
        changed = False
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                if label[a] != label[b] and sets[a] and sets[b] and Fraction(100 * len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= percent:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
        if not changed:
            break
    return {k: (len(sets[k]), label[k]) for k in keys}


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_table(spark, sf_dir, "documents"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
#: All pairs that share a shingle, then reachability.
_SQL = """WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM t WHERE len(w) > 0)),
 z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT i.a, i.b FROM i JOIN z x ON x.doc_id = i.a JOIN z y ON y.doc_id = i.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
 r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
 SELECT r.doc_id, coalesce(max(z.n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN z ON z.doc_id = r.doc_id GROUP BY r.doc_id"""
ORACLES: dict[str, str] = {"op8_jaccard_join": _SQL}
