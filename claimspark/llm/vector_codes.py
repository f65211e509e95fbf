"""Vector codes: parts of integer vectors coded by codebooks, trained and assigned by tries of parts.

Vectors are cut into equal parts, and each part position has a codebook. The distinct parts of a
batch of vectors, sorted, are a lexicographic trie: its nodes are common prefixes of dimensions.
A depth-first walk carries the vector of squared distances from the prefix to every entry, so a
prefix that many parts share is compared once. A leaf takes the nearest entry (argmin, ties to
the lower index) and adds its part, weighted by how often it occurs, to that entry's sums.

Only such sums, one row for each task, position, and entry, go through Spark's aggregation; the
driver sees codebooks, whose size is parts x entries x dimensions and does not grow with the data.
All arithmetic is on integers, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components reach this far at most, so that squared distances of up to 1,024 dimensions fit 64 bits.
FARTHEST = 1 << 25
#: Vectors whose parts make one trie.
TOGETHER = 1 << 14
#: Parts below a node that are compared at once instead of walked.
FEW = 16


def walk(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each of the distinct, sorted parts, and its squared distance."""
    size, width = parts.shape
    code, error = np.zeros(size, np.int64), np.zeros(size, np.int64)
    todo = [(0, size, 0, np.zeros(len(codebook), np.int64))]
    while todo:  # the last one put is the first taken: depth first
        start, end, depth, far = todo.pop()
        if depth == width or end - start <= FEW:
            rest = far + ((parts[start:end, None, depth:] - codebook[None, :, depth:]) ** 2).sum(axis=2)
            code[start:end] = rest.argmin(axis=1)
            error[start:end] = rest.min(axis=1)
            continue
        column = parts[start:end, depth]
        firsts = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
        below = far + (column[firsts, None] - codebook[None, :, depth]) ** 2
        if depth == width - 1:  # children are leaves
            counts = np.diff(np.append(firsts, end - start))
            code[start:end] = np.repeat(below.argmin(axis=1), counts)
            error[start:end] = np.repeat(below.min(axis=1), counts)
            continue
        edges = [*(firsts + start).tolist(), end]
        todo += [(edges[i], edges[i + 1], depth + 1, below[i]) for i in range(len(firsts) - 1, -1, -1)]
    return code, error


def _trie(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct parts in lexicographic order, the number of each row's, and how often each occurs."""
    order = np.lexsort(parts.T[::-1])
    ranked = parts[order]
    new = np.concatenate(([True], (ranked[1:] != ranked[:-1]).any(axis=1)))
    number = np.empty(len(parts), np.int64)
    number[order] = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    return ranked[firsts], number, np.diff(np.append(firsts, len(parts)))


def _vectors(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray]]:
    """Batches put together to TOGETHER rows about, with their integer vectors."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for part in common.slices(iter([batch]), TOGETHER):
            held.append(part)
            rows += part.num_rows
            if rows >= TOGETHER:
                yield held, _matrix(held, column, width)
                held, rows = [], 0
    if rows:
        yield held, _matrix(held, column, width)


def _matrix(held: list[pa.RecordBatch], column: int, width: int) -> np.ndarray:
    return np.concatenate([b.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for b in held]).reshape(-1, width)


def _sums(codebooks: np.ndarray):
    """For each task the weighted sums of parts by position and entry."""
    parts, entries, dims = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, x in _vectors(batches, 0, parts * dims):
            for p in range(parts):
                distinct, _, weight = _trie(x[:, p * dims : (p + 1) * dims])
                code, _ = walk(distinct, codebooks[p])
                np.add.at(sums[p], code, distinct * weight[:, None])
                np.add.at(counts[p], code, weight)
        at, entry = np.nonzero(counts)
        if len(at):
            values = pa.FixedSizeListArray.from_arrays(pa.array(sums[at, entry].ravel()), dims).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[at, entry]), values], names=["part", "entry", "n", "sums"])

    return run


def _refined(vectors: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Each entry becomes the floor of the mean of its parts; an entry without any stays."""
    dims = codebooks.shape[2]
    each = common.map_batches(vectors.select("_comps"), _sums(codebooks), "part int, entry int, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
    made = codebooks.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect():  # parts x entries rows
        made[r.part, r.entry] = [int(r[f"s{d}"]) // r.n for d in range(dims)]
    return made


def _coded(codebooks: np.ndarray):
    """Appends code and error to rows whose first column is the vector."""
    parts, entries, dims = codebooks.shape
    digits = np.array([f"{i:02x}" for i in range(entries)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, x in _vectors(batches, 0, parts * dims):
            codes, errors = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
            for p in range(parts):
                distinct, number, _ = _trie(x[:, p * dims : (p + 1) * dims])
                code, error = walk(distinct, codebooks[p])
                codes[:, p] = code[number]
                errors += error[number]
            texts = ["".join(row) for row in digits[codes].tolist()]
            start = 0
            for b in held:
                end = start + b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts[start:end]), pa.array(errors[start:end])], names=[*b.schema.names[1:], "code", "error"])
                start = end

    return run


def whole_vectors(vectors: DataFrame, vector_col: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite


def encode_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """(id, code, error, label_error for each kept row; the codebooks as parts x entries x dimensions).

    Rows whose vector is null, empty or holds null, NaN or infinite components go. The vector of the
    smallest id sets the length; rows of another length go too, and one that `parts` does not
    divide is an error. Components are floor(scale * x); those beyond 2^25 count as 2^25, so that
    all sums are exact. Codebooks start from the rows of the smallest ids (nulls last, repeated
    ids in the order of their vectors); fewer rows than entries make fewer entries. Repeated rows
    and null ids each give their own row. label_error sums the error over equal labels, nulls
    together; its label need not be unique to a task: errors are summed up in each task first and
    a hot label's rows may be split by Spark. Other columns are ignored; an empty table gives an
    empty result and no entries. Work: the integer vectors are written once and read rounds + 1
    times; nothing else is shuffled than sums by entry and by label.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits, so 256 entries at most")
    spark = vectors.sparkSession
    x = F.transform(vector_col, lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(FARTHEST))), F.lit(float(-FARTHEST)))).cast("int"))
    kept = common.materialize(vectors.filter(whole_vectors(vectors, vector_col)).select(x.alias("_comps"), F.col(id_col).alias("_id"), F.col(label_col).alias("_label")), "vectors")
    schema = f"_id {kept.schema['_id'].dataType.simpleString()}, _label {kept.schema['_label'].dataType.simpleString()}, code string, error long"
    first = kept.orderBy(F.col("_id").asc_nulls_last(), "_comps").select("_comps").limit(entries).collect()
    width = len(first[0][0]) if first else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    fitting = kept.filter(F.size("_comps") == width)
    if any(len(r[0]) != width for r in first):
        first = fitting.orderBy(F.col("_id").asc_nulls_last(), "_comps").select("_comps").limit(entries).collect()
    dims = width // parts
    codebooks = np.array([r[0] for r in first], np.int64).reshape(-1, parts, dims).transpose(1, 0, 2).copy()
    if first:
        for _ in range(rounds):
            codebooks = _refined(fitting, codebooks)
        coded = common.materialize(common.map_batches(fitting.select("_comps", "_id", "_label"), _coded(codebooks), schema), "codes")
    else:
        coded = spark.createDataFrame([], schema)
    by_label = coded.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_of")
    out = coded.join(by_label, F.col("_label").eqNullSafe(F.col("_of")), "left").select(F.col("_id").alias(id_col), "code", "error", "label_error")
    return out, codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = encode_vectors(common.read_table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(digest(codebooks)))


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES: dict[str, str] = {}
