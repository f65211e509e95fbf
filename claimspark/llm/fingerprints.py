"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph gives a wide vector: EQ_LANES 64-bit lanes hashed from the whole paragraph,
summed modulo 2**64, and SIM_LANES lanes that sum the signs (+1 or -1) hashed from its
sentences, modulo 2**16. A document's fingerprint is the sum over its paragraphs, whatever
their order; a paragraph is inserted or deleted by adding or subtracting its vector. Equal
multisets of paragraphs have equal fingerprints. The squared length of a difference of sign
lanes estimates how many sentences differ, which gives a likeness from 0 to 1.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import common

EQ_LANES, SIM_LANES = 8, 256
_SENTENCE = re.compile(r"(?<=[.!?])\s+")

Vector = tuple[np.ndarray, np.ndarray]


def vector(text: str | None) -> Vector:
    """The summed vector of a text's paragraphs (lines); null and empty text have none."""
    if not text:
        return np.zeros(EQ_LANES, np.uint64), np.zeros(SIM_LANES, np.int16)
    hashed = hashlib.blake2b
    lines = text.split("\n")
    wide = b"".join([hashed(p.encode(), digest_size=8 * EQ_LANES).digest() for p in lines])
    signs = b"".join([hashed(s.encode(), digest_size=SIM_LANES // 8).digest() for p in lines for s in _SENTENCE.split(p) if s])
    bits = np.unpackbits(np.frombuffer(signs, np.uint8).reshape(-1, SIM_LANES // 8), axis=1)
    eq = np.frombuffer(wide, "<u8").reshape(-1, EQ_LANES).sum(axis=0, dtype=np.uint64)
    return eq, (2 * bits.sum(axis=0, dtype=np.int64) - len(bits)).astype(np.int16)


def pack(v: Vector) -> str:
    return base64.b64encode(v[0].astype("<u8").tobytes() + v[1].astype("<i2").tobytes()).decode()


def unpack(fingerprint: str) -> Vector:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * EQ_LANES], "<u8").copy(), np.frombuffer(raw[8 * EQ_LANES :], "<i2").copy()


def changed(fingerprint: str, inserted: list[str], deleted: list[str]) -> str:
    """The fingerprint after paragraphs have been inserted and deleted, without the text."""
    eq, sim = unpack(fingerprint)
    for paragraphs, sign in ((inserted, 1), (deleted, -1)):
        for p in paragraphs:
            e, s = vector(p) if p else vector_of_blank()
            eq, sim = (eq + e, sim + s) if sign > 0 else (eq - e, sim - s)
    return pack((eq, sim))


def vector_of_blank() -> Vector:
    """An empty line among other lines; a text without any character has no paragraph."""
    wide = hashlib.blake2b(b"", digest_size=8 * EQ_LANES).digest()
    return np.frombuffer(wide, "<u8").copy(), np.zeros(SIM_LANES, np.int16)


def likeness(a: Vector, b: Vector) -> float:
    """1 for equal fingerprints; else about the share of sentences that both have."""
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    total = float(x @ x + y @ y)
    d = (a[1] - b[1]).astype(np.float64)  # int16: differences wrap modulo 2**16
    return min(1.0, max(0.0, 1.0 - float(d @ d) / total)) if total else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row; null text counts as empty, repeated rows stay.

    Texts are taken whole and rows alone; other columns are ignored. An empty table gives an
    empty result.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fingerprint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            prints = [pack(vector(t)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.string())], names=[id_col, "fingerprint"])

    return common.map_batches(docs.select(id_col, text_col), run, schema)


def apply_changes(prints: DataFrame, changes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fingerprints after changes (id, paragraph, inserted boolean); documents without a change stay.

    The changes of a document are summed to one vector in each task first, so a document with
    very many changes does not gather them in one group. Changes of unknown ids have no effect.
    Null paragraphs count as empty lines.
    """
    kind = changes.schema[id_col].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, 4096):
            by: dict[object, list[Vector]] = {}
            for key, p, ins in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                v = vector(p) if p else vector_of_blank()
                by.setdefault(key, []).append(v if ins else (np.uint64(0) - v[0], -v[1]))
            keys = list(by)
            total = [pack((sum((v[0] for v in by[k]), np.zeros(EQ_LANES, np.uint64)), sum((v[1] for v in by[k]), np.zeros(SIM_LANES, np.int16)))) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, part.schema.field(0).type), pa.array(total, pa.string())], names=[id_col, "delta"])

    deltas = common.map_batches(changes.select(id_col, "paragraph", "inserted"), sums, f"{id_col} {kind}, delta string")

    def merged(prints: pd.Series, deltas: pd.Series) -> pd.Series:
        out = []
        for p, ds in zip(prints, deltas, strict=True):
            eq, sim = unpack(p)
            for d in ds if ds is not None else []:
                e, s = unpack(d)
                eq, sim = eq + e, sim + s
            out.append(pack((eq, sim)))
        return pd.Series(out)

    together = deltas.groupBy(id_col).agg(F.collect_list("delta").alias("_deltas"))
    udf = F.pandas_udf(merged, "string")
    return prints.select(id_col, "fingerprint").join(together, id_col, "left").select(id_col, udf("fingerprint", "_deltas").alias("fingerprint"))


def _compare(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # group, id, text and vector of the row whose next is awaited
        for part in common.slices(batches, 256):
            out: list[tuple] = []
            for group, tail, key, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                v = vector(text)
                if held is not None and held[0] == group:
                    out.append(_edited(held, text, v))
                held = None if tail else (group, key, text, v)
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_NAMES)

    return run


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _edited(held: tuple, next_text: str, next_v: Vector) -> tuple:
    _, key, text, v = held
    n = len(text)
    edited = text[: n - n // 2] + next_text[: n // 2]
    ev = vector(edited)
    return key, n, hashlib.sha256(edited.encode()).hexdigest(), pack(v), pack(ev), likeness(v, ev), likeness(v, next_v)


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints each text, and its text edited with the start of the next one by descending id.

    Null text counts as empty. Null ids come last; equal ids are ordered by descending text.
    After the last document comes the first; a single document follows itself. Other columns
    are ignored; an empty table gives an empty result.
    Work: one shuffle of the texts into ranges of ids. Each range also gets the first document
    of the range after it, so the result needs no global sort or single task.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = [i / (8 * n) for i in range(1, 8 * n)]
    bounds = np.unique(np.array(rows.agg(F.percentile_approx("doc_id", cuts, 80 * n)).first()[0] or [], dtype=np.int64))

    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = pd.Series(np.full(len(ids), -1, np.int64))
        out[known.to_numpy()] = np.searchsorted(bounds, ids[known].to_numpy(np.int64), side="right")
        return out

    ranged = rows.withColumn("range", F.pandas_udf(range_of, LongType())("doc_id"))
    firsts = {r["range"]: r["first"] for r in ranged.groupBy("range").agg(F.max("doc_id").alias("first")).collect()}
    order = sorted(firsts, reverse=True)
    if not order:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    heads = [(order[i - 1], firsts[r]) for i, r in enumerate(order)]  # one row a range: at most 8n + 1
    head_ids = F.broadcast(spark.createDataFrame(heads, "range long, head long"))
    tails = (
        rows.join(head_ids, F.col("doc_id").eqNullSafe(F.col("head")))
        .groupBy("range", "doc_id")
        .agg(F.max("text").alias("text"))
        .select("range", F.lit(1).alias("tail"), "doc_id", "text")
    )
    dealt = (
        ranged.select("range", F.lit(0).alias("tail"), "doc_id", "text")
        .unionByName(tails)
        .repartition(n, "range")
        .sortWithinPartitions("range", "tail", F.desc_nulls_last("doc_id"), F.desc("text"))
    )
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return common.map_batches(dealt, _compare(pa.int64()), schema)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(common.read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_fingerprints": op10_fingerprints}
ORACLES: dict[str, str] = {}
