"""Working tables for operators that go over the texts several times.

Documents are dealt into groups of neighbouring rows. The table is bucketed by group, so each
later pass reads a group's texts in place, and only packed numbers are shuffled: from groups to
buckets of a hash and back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of a group, at most, and bytes of a text up to which so many make a group. Texts up to
#: twice, four times ... as long make groups of an eighth, a sixteenth ... of the rows, so that a
#: group has GROUP_ROWS * PLAIN_BYTES bytes at most, groups of longer texts a quarter of it or eight texts, or a single text.
GROUP_ROWS, PLAIN_BYTES = 2000, 16 << 10


def working_table(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(part, row, doc_id, text with null as empty, _keep0, _keep1 ...), bucketed by part without a shuffle.

    Rows are numbered, for ids may be null or repeated. Groups are of neighbouring rows of one
    partition and one tier of length, so that their bytes are bounded. A tier's rows are brought
    together first: groups answer all buckets of a hash, so half-empty ones would make rows in
    proportion to groups times buckets. The catalog names the table only until its files have been found.
    """
    spark = docs.sparkSession
    at = F.monotonically_increasing_id()
    tier = F.least(F.lit(GROUP_ROWS.bit_length()), F.greatest(F.lit(0), F.ceil(F.log2((F.octet_length("text") + 1) / PLAIN_BYTES)))).cast("int")
    rows_of_tier = F.element_at(F.array(*[F.lit(max(1, GROUP_ROWS >> t if t == 0 else max(GROUP_ROWS >> t + 2, min(GROUP_ROWS >> t, 8)))) for t in range(GROUP_ROWS.bit_length() + 1)]), F.col("tier") + 1)
    place = F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / rows_of_tier)
    part = F.shiftright("at", 33) * F.lit(1 << 37) + F.col("tier") * F.lit(1 << 33) + place
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *kept).withColumn("tier", tier)
    texts = texts.sortWithinPartitions("tier").withColumn("at", at)  # a partition's number and, by tier, a row's place in it
    rows = texts.select(part.cast("long").alias("part"), F.col("at").alias("row"), "doc_id", "text", *[f"_keep{i}" for i in range(len(keep))])
    name = f"claimspark_{uuid.uuid4().hex}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = common.shared_dir(spark, "texts")
    rows.write.bucketBy(buckets, "part").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return table


def total_bytes(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a group as one byte array, and where each starts (with the end)."""
    column = table.column("text").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(starts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents (first, after last) of `most` bytes at most; a longer document is alone."""
    first = 0
    for i in range(len(starts) - 1):
        if i > first and starts[i + 1] - starts[first] > most:
            yield first, i
            first = i
    if len(starts) > 1:
        yield first, len(starts) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def squeeze(a: np.ndarray) -> bytes:
    """The array's bytes, compressed."""
    raw = a.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def expand(blob: bytes, dtype) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype)
    size = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype)


def column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) connect it with.

    Rounds go on until no label changes. In each, a node and the node of its label both take the
    least label of a label among its neighbours, and a node its label's label. As labels, not
    only their members, move to smaller ones, rounds grow with the logarithm of the longest
    path (15 for a path of 10,000 nodes in random order). Every round is a written table.
    """
    both = common.materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = common.materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("above"))
        known = labels.join(up, labels.label == up["at"]).select("node", "label", "above")
        near = both.join(known.select("node", "above"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("above").alias("least"))
        met = known.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "above", "least").alias("new"), "least")
        moves = F.array(F.struct("node", F.col("label").alias("old"), "new"), F.struct(F.col("label").alias("node"), F.lit(None).cast(labels.schema["label"].dataType).alias("old"), F.col("least").alias("new")))
        step = common.materialize(met.select(F.inline(moves)).groupBy("node").agg(F.max("old").alias("old"), F.min("new").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.filter(F.col("old") != F.col("label")).isEmpty():
            return labels.select("node", F.col("label").alias("component"))
