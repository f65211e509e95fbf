"""Sequence packing: shortest pack first over the histogram of lengths.

Documents are tokenised once and cut into full pieces and a rest. Only the histogram of piece
lengths (at most `capacity` numbers) reaches the driver. Lengths are placed longest first into
the shortest pack that has room, which updates counts of packing patterns; patterns are then
joined back to pieces by the rank of a piece among those of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

CAPACITY = 1024
END = 0
DEFAULT_TOKENIZER = "byte_bpe_50k.json"


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how many packs, lengths in them) that hold every piece of the histogram once."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    spaces: list[int] = []  # with patterns, ascending

    def put(count: int, pattern: tuple[int, ...], left: int) -> None:
        if count:
            if not room[left]:
                spaces.insert(int(np.searchsorted(spaces, left)), left)
            room[left].append((count, pattern))

    for length in range(capacity, 0, -1):
        todo = histogram.get(length, 0)
        while todo:
            space = spaces[-1] if spaces else 0  # the shortest pack has the most room
            if space >= length:
                count, pattern = room[space].pop()
                if not room[space]:
                    spaces.pop()
                filled = min(count, todo)  # one piece each: then others may be the shortest
                put(filled, pattern + (length,), space - length)
                put(count - filled, pattern, space)
                todo -= filled
            else:  # a new pack stays the shortest until it is full
                fit = capacity // length
                put(todo // fit, (length,) * fit, capacity - fit * length)
                put(int(todo % fit > 0), (length,) * (todo % fit), capacity - todo % fit * length)
                todo = 0
    return sorted((p for ps in room.values() for p in ps), key=lambda p: (p[1], p[0]), reverse=True)


def slots_of(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset) of the slots that pieces fill in rank order."""
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for count, pattern in patterns:
        at = 0
        for length in pattern:
            rows[length].append((ranks[length], sequence, at))
            ranks[length] += count
            at += length
        sequence += count
    return {k: np.array(v, np.int64) for k, v in rows.items()}


_PIECE = "part int, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, place long"


def cut_pieces(docs: DataFrame, path: str, capacity: int, end: int | None, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every document, and the place of each among those of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.load(path)
        part_id = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        for part in common.slices(batches, 256):
            rows: list[tuple] = []
            keys = []
            encoded = tokenizer.ids([t or "" for t in part.column(1).to_pylist()])
            for key, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                ids += tail
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    rows.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, int(seen[length])))
                    keys.append(key)
                    seen[length] += 1
            cols = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [pa.array([part_id] * len(rows), pa.int32()), pa.array(keys, part.schema.field(0).type), *map(pa.array, cols)],
                names=["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_batches(docs.select(id_col, text_col), run, _PIECE.format(kind=kind))


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int | None = END, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty: only the end id (without one, no piece). Every row is a document of
    its own, also with a null or repeated id. Other columns are ignored; an empty table gives
    an empty result. Work: one tokenising pass that writes narrow pieces, then joins of those
    by (task, length), which no single length can make hot.
    """
    from .token_counts import tokenizer_path

    path = tokenizer or tokenizer_path(DEFAULT_TOKENIZER)
    pieces = common.materialize(cut_pieces(docs, path, capacity, end, id_col, text_col), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}
    slots = slots_of(pack_histogram(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("place")).alias("rank"))
    kind = ranked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                mine = lengths == length
                table = slots[int(length)]
                row = np.searchsorted(table[:, 0], ranks[mine], side="right") - 1
                sequence[mine] = table[row, 1] + ranks[mine] - table[row, 0]
                offset[mine] = table[row, 2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return common.map_batches(ranked, run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
