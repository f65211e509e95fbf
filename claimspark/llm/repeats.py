"""Exact removal of long repeats by run-length indexes.

A repeat of WINDOW bytes is found through its minimizer, the k-mer of least hash in it, which
two equal windows choose at the same place. Passes over the groups of a working table:

1. the fingerprints of each group's minimizers go to buckets of the hash, which answer with one
   bit each: does another group have it too? Minimizers of a single document end here;
2. for the others, the bytes of all windows that chose them (a stretch of at most 2 * WINDOW - K
   bytes) go, once a group, to a bucket of the minimizer;
3. a bucket builds the suffix array of its stretches, its Burrows-Wheeler transform as runs, and
   samples the longest common prefixes at run heads. Streaming over the text, every other
   matching statistic follows from the one before it (one less). Neighbours in the array that
   match over WINDOW bytes or more are the same window; the least document id of each tells
   which windows a smaller document has. The answer is one bit a window;
4. each group marks the bytes that such windows cover and cuts them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, groups

WINDOW = 50
K = 24
#: Bytes of fingerprints that a bucket gets, and of texts for each bucket of stretches, about.
BUCKET_BYTES, ROUTE_BYTES = 6 << 20, 6 << 20
#: Places of a minimizer, counted once in each group and document, over which its windows are sent one by one.
HOT = 1 << 16
#: Groups whose stretches for a bucket are made distinct together before they go on; fewer groups send them at once.
MERGED = 4096
#: Bytes of documents, about, that are hashed together: arrays of 8 bytes for each stay in a core's cache.
CHUNK = 1 << 16
#: Windows of a long document that are looked at together.
PIECE = 1 << 20
_NONE = np.iinfo(np.int64).max  # a null id is after all others


class Minimizers:
    """Of a byte array with documents: minimizer hashes, and first window and number of windows of each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, window: int, k: int) -> None:
        hashes, docs, firsts, counts = [], [], [], []
        for a, b in groups.chunks(starts, CHUNK):
            size = int(starts[b] - starts[a])
            step = size if b > a + 1 else PIECE  # pieces of a long document share all but one byte of a window
            for at in range(0, max(1, size - window + 1), max(1, step)):
                begin = int(starts[a]) + at
                piece = data[begin : min(begin + step + window - 1, int(starts[b]))]
                bounds = starts[a : b + 1] - starts[a] if b > a + 1 else np.array([0, len(piece)])
                h, d, f, c = self._chunk(piece, bounds, window, k)
                hashes.append(h)
                docs.append(d + a)
                firsts.append(f + begin)
                counts.append(c)
        none = [np.zeros(0, np.int64)]
        self.hash = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        self.doc = np.concatenate(docs or none)
        self.first = np.concatenate(firsts or none)
        self.windows = np.concatenate(counts or none)

    @staticmethod
    def _chunk(data: np.ndarray, starts: np.ndarray, window: int, k: int):
        n = len(data)
        empty = np.zeros(0, np.int64)
        if n < window:
            return np.zeros(0, np.uint64), empty, empty, empty
        h = _kmer_hashes(data, k)
        keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the leftmost
        least = _sliding_min(keyed, window - k + 1)
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        valid = np.ones(n + 1, bool)
        for i in range(1, len(starts)):  # windows end with their document
            valid[max(int(starts[i - 1]), int(starts[i]) - window + 1) : int(starts[i])] = False
        first = np.flatnonzero(valid[: n - window + 1])
        if not len(first):
            return np.zeros(0, np.uint64), empty, empty, empty
        chosen = at[first]
        heads = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        where = first[heads]
        return h[chosen[heads]], np.searchsorted(starts, where, side="right") - 1, where, np.diff(np.append(heads, len(first)))


def _kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-mers, put together from those of powers of two."""
    factor, power, out, done = 0xD1342543DE82EF95, groups.BYTE[data], None, 0
    size, bits = 1, k
    while True:
        if bits & 1:
            piece = power if out is None else power[done:]
            out = power if out is None else out[: len(piece)] * np.uint64(pow(factor, size, 1 << 64)) + piece[: len(out)]
            done += size
        bits >>= 1
        if not bits:
            break
        power = power[:-size] * np.uint64(pow(factor, size, 1 << 64)) + power[size:] if len(power) > size else power[:0]
        size *= 2
    return groups.mix(out[: max(0, len(data) - k + 1)])


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def _split(keys: np.ndarray, buckets: int):
    """Ranges (bucket, from, to) of ascending keys bucket << 32 | fingerprint."""
    cuts = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
    return [(b, int(cuts[b]), int(cuts[b + 1])) for b in range(buckets) if cuts[b] < cuts[b + 1]]


def _keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _shared_here(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and which of them several documents of the group have."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    fresh = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    changes = np.append(False, (k[1:] == k[:-1]) & (d[1:] != d[:-1])) if len(k) else fresh
    group = np.cumsum(fresh) - 1
    shared = np.zeros(int(fresh.sum()), bool)
    shared[group[changes]] = True
    return k[fresh], shared


def _send_fingerprints(window: int, k: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        data, starts = groups.texts_of(table)
        keys, counts = np.unique(_keys(Minimizers(data, starts, window, k).hash, buckets), return_counts=True)
        part = table.column("part")[0].as_py()
        parts = _split(keys, buckets)
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in parts], pa.int32()),
                "part": pa.array([part] * len(parts), pa.int64()),
                "prints": pa.array([(keys[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for _, i, j in parts], pa.binary()),
                "counts": pa.array([groups.squeeze(np.minimum(counts[i:j], 65535).astype(np.uint16)) for _, i, j in parts], pa.binary()),
            }
        )

    return run


def _answer_shared(hot: int):
    """For each group's fingerprints in a bucket: the bits of those that another group has too, and of those in over `hot` places."""

    def run(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.uint32) for x in groups.column(table, "prints")]
        every = np.concatenate(blobs)
        counts = np.concatenate([groups.expand(x, np.uint16) for x in groups.column(table, "counts")]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        members = np.diff(np.append(heads, len(every)))
        shared, many = np.zeros(len(every), bool), np.zeros(len(every), bool)
        shared[order] = np.repeat(members > 1, members)
        many[order] = np.repeat(np.add.reduceat(counts[order], heads) > hot, members)
        cuts = np.cumsum([0, *map(len, blobs)])
        bits = [[groups.squeeze(np.packbits(x[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)] for x in (shared, many)]
        return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "bits": pa.array(bits[0], pa.binary()), "hot": pa.array(bits[1], pa.binary())})

    return run


def _ids(table: pa.Table) -> np.ndarray:
    return np.array([_NONE if x is None else x for x in groups.column(table, "doc_id")], np.int64)


def _stretches(data: np.ndarray, first: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """A matrix of the bytes of each stretch, filled with zeros to a multiple of 8."""
    full = -(-width // 8) * 8
    out = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(full, np.uint8)]), full)[first]
    out[np.arange(full) >= length[:, None]] = 0
    return out


def _row_hashes(matrix: np.ndarray, length: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(matrix).view(np.uint64)
    h = groups.mix(length.astype(np.uint64) + np.uint64(1))
    for c in range(words.shape[1]):
        h = groups.mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, c])
    return h


def _distinct(matrix: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(representative rows, which of them each row equals); rows of equal hash are compared byte by byte."""
    words, h = matrix.view(np.uint64), _row_hashes(matrix, length)
    _, rep, inverse = np.unique(h, return_index=True, return_inverse=True)
    if not (np.array_equal(words, words[rep[inverse]]) and np.array_equal(length, length[rep[inverse]])):
        whole = np.ascontiguousarray(np.concatenate([matrix, length.astype("<u8").view(np.uint8).reshape(-1, 8)], axis=1))
        _, rep, inverse = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return rep, inverse


_CANDIDATES = "part long, bucket int, sizes binary, bytes binary, least binary, places binary"


def _send_stretches(window: int, k: int, buckets: int, routes: int):
    """Rows of bucket >= 0 carry stretches; the row of bucket -1 keeps where they are in the group."""

    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("part", "bucket", "sizes", "bytes", "least", "places")}
        if docs.num_rows:
            data, starts = groups.texts_of(docs)
            found = Minimizers(data, starts, window, k)
            keys = _keys(found.hash, buckets)
            distinct, shared = _shared_here(keys, found.doc)
            hot = np.zeros(len(distinct), bool)
            told = {b: x for b, *x in zip(*(groups.column(bits, c) for c in ("bucket", "bits", "hot")), strict=True)}
            for b, i, j in _split(distinct, buckets):
                other, many = (np.unpackbits(groups.expand(x, np.uint8), count=j - i).astype(bool) for x in told[b])
                shared[i:j] |= other
                hot[i:j] = many
            place = np.searchsorted(distinct, keys)
            kept = np.flatnonzero(shared[place])
            single = hot[place[kept]]
            pieces = np.where(single, found.windows[kept], 1)
            kept, single = np.repeat(kept, pieces), np.repeat(single, pieces)
            first = found.first[kept] + np.arange(len(kept)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            count, doc = np.where(single, 1, found.windows[kept]), found.doc[kept]
            length = count + window - 1
            matrix = _stretches(data, first, length, 2 * window - k)
            rep, inverse = _distinct(matrix, length)
            where = np.where(single[rep], _row_hashes(matrix[rep], length[rep]), found.hash[kept][rep])
            route = (groups.mix(where) % np.uint64(routes)).astype(np.int64)
            order = np.argsort(route, kind="stable")  # candidates are numbered by route
            number = np.empty(len(rep), np.int64)
            number[order] = np.arange(len(rep))
            candidate = number[inverse]
            rep, route = rep[order], route[order]
            least = np.full(len(rep), _NONE, np.int64)
            np.minimum.at(least, candidate, _ids(docs)[doc])
            part = docs.column("part")[0].as_py()
            cuts = np.flatnonzero(np.append(True, route[1:] != route[:-1])) if len(route) else np.zeros(0, np.int64)
            width = np.arange(matrix.shape[1])
            for i, j in zip(cuts, np.append(cuts, len(route))[1:], strict=True):
                sizes = length[rep[i:j]]
                rows = matrix[rep[i:j]]
                for name, value in (("part", part), ("bucket", int(route[i])), ("sizes", sizes.astype(np.uint8).tobytes()), ("bytes", groups.squeeze(rows[width < sizes[:, None]])), ("least", groups.squeeze(least[i:j])), ("places", None)):
                    out[name].append(value)
            places = np.stack([candidate, first, count, doc]).astype(np.uint32)
            for name, value in (("part", part), ("bucket", -1), ("sizes", None), ("bytes", None), ("least", groups.squeeze(least)), ("places", groups.squeeze(places))):
                out[name].append(value)
        types = {"part": pa.int64(), "bucket": pa.int32()}
        return pa.table({c: pa.array(v, types.get(c, pa.binary())) for c, v in out.items()})

    return run


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of strings, with samples at the ends of runs.

    Rows are the suffixes in order; a suffix ends with its string, and equal ones are ordered by
    string. For each run are kept: the row of its head, its byte, the row to which a step
    backwards leads from its head, and at its first suffix the position in the text and the
    common prefix with the suffix above, which is the last one of the run before.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray) -> None:
        n = len(data)
        self.starts = starts
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        left = starts[owner + 1] - np.arange(n)  # bytes to the string's end
        order = self._sort(data, left)
        before = np.append(data[-1:], data[:-1]).astype(np.int64)
        before[starts[:-1]] = -1 - np.arange(len(starts) - 1)  # string starts have marks of their own, equal to nothing
        bwt = before[order]
        self.heads = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        self.run_bytes = bwt[self.heads]
        self.head_at = order[self.heads]
        end_at = order[np.append(self.heads[1:], n) - 1]
        self.prefix = self._common(data, left, np.append(end_at[-1:], end_at[:-1]), self.head_at)
        self.prefix[0] = 0
        # rows that begin with a byte: first the strings' last positions, then by the rows of what follows
        last = data[starts[1:] - 1].astype(np.int64)
        ends = np.bincount(last, minlength=256)
        first_row = np.cumsum(np.bincount(data, minlength=256)) - np.bincount(data, minlength=256)
        by_byte = np.argsort(last, kind="stable")
        self.entry = np.empty(len(last), np.int64)
        self.entry[by_byte] = first_row[last[by_byte]] + np.arange(len(last)) - (np.cumsum(ends) - ends)[last[by_byte]]
        length = np.diff(np.append(self.heads, n))
        by_run = np.argsort(self.run_bytes, kind="stable")
        ranked, sizes = self.run_bytes[by_run], length[by_run]
        total = np.cumsum(sizes) - sizes
        total -= total[np.searchsorted(ranked, ranked)]
        self.step_to = np.empty(len(length), np.int64)
        byte = np.maximum(ranked, 0)
        self.step_to[by_run] = np.where(ranked < 0, -1, first_row[byte] + ends[byte] + total)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the strings: its row, and how many bytes match the suffix in the row above.

        All strings are streamed backwards together. A run's head has its statistic sampled;
        elsewhere a position's is one less than that of the position before.
        """
        n, lengths = int(self.starts[-1]), np.diff(self.starts)
        row_of = np.empty(n, np.int64)
        by_length = np.argsort(-lengths, kind="stable")
        row, at, ranked = self.entry[by_length], self.starts[1:][by_length] - 1, lengths[by_length]
        row_of[at] = row
        for k in range(1, int(ranked[0])):
            active = int(np.searchsorted(-ranked, -k))  # strings of more than k bytes
            row, at = row[:active], at[:active] - 1
            run = np.searchsorted(self.heads, row, side="right") - 1
            row = self.step_to[run] + row - self.heads[run]
            row_of[at] = row
        shared, sampled = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        shared[self.head_at], sampled[self.head_at] = self.prefix, self.head_at
        last = np.maximum.accumulate(sampled)  # each string's first position is a sample
        return row_of, shared[last] - (np.arange(n) - last)

    @staticmethod
    def _sort(data: np.ndarray, left: np.ndarray) -> np.ndarray:
        n = len(data)
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for i in range(8):  # no byte of a text is 255, so byte + 1 leaves 0 for the end
            key = (key << np.uint64(8)) | np.where(left > i, padded[i : n + i] + np.uint64(1), np.uint64(0))
        size = 8
        while True:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            fresh = np.append(True, ranked[1:] != ranked[:-1])
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(fresh).astype(np.uint64)
            if size >= left.max() or fresh.all():
                return order
            ahead = np.zeros(n, np.uint64)
            ahead[: n - size] = rank[size:]
            key = (rank << np.uint64(32)) | np.where(left > size, ahead, np.uint64(0))
            size *= 2

    @staticmethod
    def _common(data: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b share."""
        out = np.zeros(len(a), np.int64)
        most = np.minimum(left[a], left[b])
        alive = np.arange(len(a))
        while len(alive):
            alive = alive[out[alive] < most[alive]]
            alive = alive[data[a[alive] + out[alive]] == data[b[alive] + out[alive]]]
            out[alive] += 1
        return out


def window_minima(data: np.ndarray, starts: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """For each position of the strings, the least id of a string with the window that starts there."""
    row, shared = RunLengthIndex(data, starts).statistics()
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = starts[owner + 1] - np.arange(len(data)) >= window
    opens, ids = np.empty(len(data), bool), np.empty(len(data), np.int64)
    opens[row] = shared < window  # a new window begins
    ids[row] = np.where(inside, least[owner], _NONE)
    classes = np.flatnonzero(opens)
    return np.minimum.reduceat(ids, classes)[(np.cumsum(opens) - 1)[row]]


class Candidates:
    """Stretches that groups sent to a bucket, and which of them are equal."""

    def __init__(self, table: pa.Table, window: int, k: int) -> None:
        sizes = [np.frombuffer(x, np.uint8) for x in groups.column(table, "sizes")]
        self.cuts = np.cumsum([0, *map(len, sizes)])
        self.length = np.concatenate(sizes).astype(np.int64)
        data = np.concatenate([groups.expand(x, np.uint8) for x in groups.column(table, "bytes")])
        self.least = np.concatenate([groups.expand(x, np.int64) for x in groups.column(table, "least")])
        starts = np.cumsum(np.append(0, self.length))[:-1]
        self.matrix = _stretches(data, starts, self.length, 2 * window - k)
        self.rep, self.inverse = _distinct(self.matrix, self.length)
        self.lowest = np.full(len(self.rep), _NONE, np.int64)
        np.minimum.at(self.lowest, self.inverse, self.least)

    def by_row(self, bits: np.ndarray) -> pa.Array:
        return pa.array([groups.squeeze(bits[i:j]) for i, j in zip(self.cuts[:-1], self.cuts[1:], strict=True)], pa.binary())


def _merge(window: int, k: int):
    """Of several groups' stretches for a bucket each different one once, with its least id."""

    def run(table: pa.Table) -> pa.Table:
        c = Candidates(table, window, k)
        sizes = c.length[c.rep]
        packed = c.matrix[c.rep][np.arange(c.matrix.shape[1]) < sizes[:, None]]
        blobs = {"sizes": sizes.astype(np.uint8).tobytes(), "bytes": groups.squeeze(packed), "least": groups.squeeze(c.lowest)}
        return pa.table({"part": table.column("salt").slice(0, 1).cast(pa.int64()), "bucket": table.column("bucket").slice(0, 1)} | {n: pa.array([b], pa.binary()) for n, b in blobs.items()})

    return run


def _spread(window: int, k: int):
    """The answers for merged stretches, for each group that sent them."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        c = Candidates(table, window, k)
        bits = groups.expand(groups.column(told, "windows")[0], np.uint32)[c.inverse]
        full = ((np.uint64(1) << (c.length - window + 1).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        bits = np.where(c.lowest[c.inverse] < c.least, full, bits)
        return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "windows": c.by_row(bits)})

    return run


def _answer_windows(window: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        c = Candidates(table, window, k)
        length, least, matrix, rep, inverse, lowest = c.length, c.least, c.matrix, c.rep, c.inverse, c.lowest
        windows = length[rep] - window + 1
        # a stretch without a window of a hash that another window has is equal to nothing else
        several = _sharing(matrix[rep], windows, window)
        minima = np.repeat(lowest[:, None], window - k + 1, axis=1)
        if len(several):
            many = np.cumsum(np.append(0, length[rep[several]]))
            width = np.arange(matrix.shape[1])
            packed = matrix[rep[several]][width < length[rep[several]][:, None]]
            found = window_minima(packed, many, lowest[several], window)
            for w in range(window - k + 1):
                rows = np.flatnonzero(windows[several] > w)
                minima[several[rows], w] = found[many[rows] + w]
        bits = np.zeros(len(length), np.uint32)
        for w in range(window - k + 1):
            smaller = (minima[inverse, w] < least) & (length - window >= w)
            bits |= smaller.astype(np.uint32) << np.uint32(w)
        return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "windows": c.by_row(bits)})

    return run


def _sharing(matrix: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """The stretches with a window whose hash another window has, too; windows tells how many a stretch has."""
    if not len(matrix):
        return np.zeros(0, np.int64)
    width = matrix.shape[1]
    hashes = [_kmer_hashes(np.ascontiguousarray(matrix[i : i + 4096]).ravel(), window) for i in range(0, len(matrix), 4096)]
    owner = np.repeat(np.arange(len(matrix)), windows)
    at = owner % 4096 * width + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    cuts = np.searchsorted(owner, np.arange(0, len(matrix) + 4096, 4096))
    found = np.concatenate([h[at[i:j]] for h, i, j in zip(hashes, cuts, cuts[1:])])
    ranked = np.sort(found)
    several = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    place = np.minimum(np.searchsorted(several, found), max(0, len(several) - 1))
    return np.unique(owner[several[place] == found]) if len(several) else np.zeros(0, np.int64)


def covered(docs: pa.Table, told: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A group's bytes, document starts, and which bytes are repeats of a smaller document."""
    data, starts = groups.texts_of(docs)
    places, least = np.zeros((4, 0), np.int64), np.zeros(0, np.int64)
    answers: list[tuple[int, bytes]] = []
    for bucket, windows, place, low in zip(*(groups.column(told, c) for c in ("bucket", "windows", "places", "least")), strict=True):
        if bucket < 0:
            places, least = groups.expand(place, np.uint32).reshape(4, -1).astype(np.int64), groups.expand(low, np.int64)
        else:
            answers.append((bucket, windows))
    bits = np.concatenate([groups.expand(w, np.uint32) for _, w in sorted(answers)] or [np.zeros(0, np.uint32)])
    candidate, first, count, doc = places
    edge = np.zeros(len(data) + 1, np.int64)
    whole = _ids(docs)[doc] > least[candidate]
    full = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
    mask = np.where(whole, full, bits[candidate].astype(np.uint64)) if len(candidate) else full
    entire = (mask == full) & (count > 0)
    np.add.at(edge, first[entire], 1)
    np.add.at(edge, (first + count - 1 + window)[entire], -1)
    rest = np.flatnonzero(~entire & (mask > 0))
    for w in range(int(count.max()) if len(count) else 0):
        rows = rest[(mask[rest] >> np.uint64(w)) & np.uint64(1) > 0]
        np.add.at(edge, first[rows] + w, 1)
        np.add.at(edge, first[rows] + w + window, -1)
    return data, starts, np.cumsum(edge[:-1]) > 0


def _results(window: int, keep_text: bool, keep: tuple[str, ...]):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        kept_texts: list[str] = []
        if docs.num_rows:
            data, starts, gone = covered(docs, told, window)
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                g = gone[i:j]
                n = int(g.sum())
                kept = (data[i:j][~g] if n else data[i:j]).tobytes()
                out["n_bytes"].append(j - i)
                out["n_removed"].append(n)
                out["n_spans"].append(int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if n else 0)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    kept_texts.append(kept.decode("utf-8", "ignore"))
        types = {"kept_sha256": pa.string()}
        cols = {"doc_id": docs.column("doc_id")} | {c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()}
        cols |= {"kept_text": pa.array(kept_texts, pa.string())} if keep_text else {}
        return pa.table(cols | {c: docs.column(f"_keep{i}") for i, c in enumerate(keep)})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, keep_text: bool = False, keep: tuple[str, ...] = (), hot: int = HOT, merged: int = MERGED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, and columns to keep) of every document.

    A byte goes if a string of `window` bytes that covers it also starts in a document of
    smaller id. Null and empty texts, and texts under `window` bytes, lose nothing. Equal ids
    are not smaller than each other, so repeated rows are kept whole; null ids come after all
    others. Where a cut splits a character, kept_text leaves out its remaining bytes. Other
    columns are ignored; an empty table gives an empty result.
    """
    if not 0 < window - k + 1 <= 32:
        raise ValueError("window - k must be from 0 to 31")
    table = groups.working_table(docs, id_col, text_col, keep)
    size = groups.total_bytes(table)
    per_byte = 2 / (window - k + 2)
    buckets = int(min(1 << 20, max(8, size * per_byte * 4 // BUCKET_BYTES + 1)))
    routes = int(max(8, size // ROUTE_BYTES + 1))
    prints = table.groupBy("part").applyInArrow(_send_fingerprints(window, k, buckets), "bucket int, part long, prints binary, counts binary")
    bits = common.materialize(prints.groupBy("bucket").applyInArrow(_answer_shared(hot), "part long, bucket int, bits binary, hot binary"), "shared")
    sent = common.materialize(table.groupBy("part").cogroup(bits.groupBy("part")).applyInArrow(_send_stretches(window, k, buckets, routes), _CANDIDATES), "stretches")
    stretches = sent.filter("bucket >= 0").select("part", "bucket", "sizes", "bytes", "least")
    salts = sent.select("part").distinct().count() // merged + 1
    windows = "part long, bucket int, windows binary"
    if salts > 1:  # a passage that all groups have must not send a row of each to one bucket
        salted = stretches.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(salts)).cast("int"))
        once = common.materialize(salted.groupBy("bucket", "salt").applyInArrow(_merge(window, k), "part long, bucket int, sizes binary, bytes binary, least binary"), "merged")
        found = once.repartition(routes, "bucket").groupBy("bucket").applyInArrow(_answer_windows(window, k), windows).withColumnRenamed("part", "salt")
        answers = salted.groupBy("bucket", "salt").cogroup(found.groupBy("bucket", F.col("salt").cast("int"))).applyInArrow(_spread(window, k), windows)
    else:
        # a bucket costs seconds for its few packed MB, so partitions are not joined by their bytes
        answers = stretches.repartition(routes, "bucket").groupBy("bucket").applyInArrow(_answer_windows(window, k), windows)
    nothing = F.lit(None).cast("binary")
    told = answers.select("part", "bucket", "windows", nothing.alias("places"), nothing.alias("least")).unionByName(
        sent.filter("bucket < 0").select("part", "bucket", nothing.alias("windows"), "places", "least")
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return table.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_results(window, keep_text, keep), schema)


def brute_force(texts: list[tuple[int | None, str | None]], window: int = WINDOW) -> Iterator[tuple[int | None, int, bytes]]:
    """(id, removed bytes, kept bytes) by comparing all windows, for tests."""
    ids = [_NONE if i is None else i for i, _ in texts]
    raw = [(t or "").encode() for _, t in texts]
    least: dict[bytes, int] = {}
    for i, t in zip(ids, raw, strict=True):
        for p in range(len(t) - window + 1):
            w = t[p : p + window]
            least[w] = min(least.get(w, _NONE), i)
    for (key, _), i, t in zip(texts, ids, raw, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if least[t[p : p + window]] < i:
                gone[p : p + window] = b"\1" * window
        yield key, sum(gone), bytes(b for b, g in zip(t, gone, strict=True) if not g)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.read_table(spark, sf_dir, "documents"))



QUERIES = {"op7_repeats": op7_repeats}
#: Windows of 50 bytes as hexadecimal text; spans are put together from the windows that a smaller document has.
_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
 c AS (SELECT doc_id, CAST(k AS BIGINT) AS k, substr(h, k * 1024 + 1, 1124) AS piece, n FROM (SELECT doc_id, h, n, unnest(range(0, n // 512 + 1)) AS k FROM n)),
 w AS (SELECT doc_id, k * 512 + p AS p, substr(piece, 2 * p + 1, 100) AS s FROM (SELECT doc_id, k, piece, n, unnest(range(0, 512)) AS p FROM c) WHERE k * 512 + p + 50 <= n),
 m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1), x AS (SELECT w.doc_id, w.p FROM w JOIN m ON w.s = m.s AND m.least < w.doc_id),
 g AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS after FROM x),
 e AS (SELECT doc_id, p, CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END AS opens, least(50, coalesce(after, p + 50) - p) AS bytes FROM g),
 s AS (SELECT doc_id, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS span, p, bytes FROM e), r AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b, sum(bytes) AS bytes FROM s GROUP BY doc_id, span),
 k AS (SELECT r.doc_id, sum(bytes) AS removed, count(*) AS spans, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(max(h), 2 * max(b) + 1) AS kept
   FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM r) r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id)
 SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM n LEFT JOIN k ON k.doc_id = n.doc_id"""
ORACLES: dict[str, str] = {"op7_repeats": _SQL}
