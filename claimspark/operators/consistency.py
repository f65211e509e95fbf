"""Document consistency from sentence-pair scores: (pair, doc_i, gen_i, entail, contradiction, ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FUNCTIONS = {"max": F.max, "mean": F.avg, "min": F.min}


def zero_shot(scores: DataFrame, over_document: str = "max", over_generated: str = "mean", keys: list[str] | None = None) -> DataFrame:
    """Score of each pair: entailment less contradiction, each reduced over document sentences, then over generated ones."""
    keys = keys or ["pair"]
    first, second = _FUNCTIONS[over_document], _FUNCTIONS[over_generated]
    each = scores.groupBy(*keys, "gen_i").agg((first("entail") - first("contradiction")).alias("_s"))
    return each.groupBy(*keys).agg(second("_s").alias("score"))


def histogram(scores: DataFrame, edges: list[float], value: str = "entail", first: int = 10) -> DataFrame:
    """pair, gen_i, bin, n over right-open bins, the last one closed; the first generated sentences only."""
    v = F.col(value)
    bin_ = sum(((v >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    inside = scores.filter((F.col("gen_i") < first) & (v >= edges[0]) & (v <= edges[-1]))
    return inside.groupBy("pair", "gen_i", bin_.alias("bin")).agg(F.count("*").alias("n"))


def chunked_alignment(scores: DataFrame) -> DataFrame:
    """Best over premise chunks, then mean over hypothesis sentences."""
    return scores.groupBy("pair", "hyp_i").agg(F.max("score").alias("_s")).groupBy("pair").agg(F.avg("_s").alias("score"))


def soft_unigrams(scores: DataFrame) -> DataFrame:
    """Soft precision (best premise for each hypothesis sentence), recall (the reverse) and F1."""
    from ..functions.text import harmonic_mean

    p = chunked_alignment(scores).withColumnRenamed("score", "precision")
    r = scores.groupBy("pair", "prem_i").agg(F.max("score").alias("_s")).groupBy("pair").agg(F.avg("_s").alias("recall"))
    return p.join(r, "pair").withColumn("f1", harmonic_mean(F.col("precision"), F.col("recall")))


#: Cells of sentence matrices that a task has in hand at once, about.
CELLS = 1 << 22


def _in_matrices(scores: DataFrame, kernel, names: list[str]) -> DataFrame:
    """pair and columns that kernel makes of sentence matrices (pairs x premises x hypotheses) of one shape.

    Rows are shuffled once, by pair, and sorted, so all of a pair's rows lie side by side and its
    matrix is made in the task. Sentences are in the order of their numbers, nulls last; of repeated
    cells the best counts, cells without a score are 0.
    """
    last = F.lit((1 << 63) - 1)
    known = F.when(F.col("prem_i").isNotNull() & F.col("hyp_i").isNotNull(), F.col("score").cast("double"))
    rows = scores.filter(F.col("pair").isNotNull()).select("pair", *[F.coalesce(F.col(c).cast("long"), last).alias(c) for c in ("prem_i", "hyp_i")], F.coalesce(known, F.lit(float("-inf"))).alias("score"))

    def places(group: np.ndarray, sentence: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's sentence as 0, 1 ... of its pair, and how many there are."""
        order = np.lexsort((sentence, group))
        g, x = group[order], sentence[order]
        fresh = np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]))
        size = np.bincount(g[fresh], minlength=n)
        at = np.empty(len(group), np.int64)
        at[order] = np.cumsum(fresh) - 1 - (np.cumsum(size) - size)[g]
        return at, size

    def made(t: pa.Table) -> pa.RecordBatch:
        pair, first, group = np.unique(t.column("pair").to_numpy(), return_index=True, return_inverse=True)
        (i, p), (j, h) = (places(group, t.column(c).to_numpy(), len(pair)) for c in ("prem_i", "hyp_i"))
        score, out = t.column("score").to_numpy(), np.zeros((len(names), len(pair)))
        shapes, shape = np.unique(p * (1 << 31) + h, return_inverse=True)
        by = np.argsort(shape, kind="stable")
        cuts = np.searchsorted(shape[by], np.arange(len(shapes) + 1))
        rows_by = np.argsort(shape[group], kind="stable")
        row_cuts = np.searchsorted(shape[group][rows_by], np.arange(len(shapes) + 1))
        for s in range(len(shapes)):
            mine, rows_ = by[cuts[s] : cuts[s + 1]], rows_by[row_cuts[s] : row_cuts[s + 1]]
            np_, nh = int(p[mine[0]]), int(h[mine[0]])
            step = max(1, CELLS // (np_ * nh))
            for k in range(0, len(mine), step):
                some = mine[k : k + step]
                inside = rows_[(group[rows_] >= some[0]) & (group[rows_] <= some[-1])]
                m = np.full((len(some), np_, nh), -np.inf)
                np.maximum.at(m, (np.searchsorted(some, group[inside]), i[inside], j[inside]), score[inside])
                m[np.isneginf(m)] = 0.0
                out[:, some] = kernel(m)
        return pa.RecordBatch.from_pydict({"pair": t.column("pair").combine_chunks().take(pa.array(first)), **dict(zip(names, out, strict=True))})

    def run(batches):
        kept: list[pa.RecordBatch] = []  # rows of the last pair so far
        for b in batches:
            if not b.num_rows:
                continue
            pair = b.column("pair").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(pair, pair[-1]))
            if cut or (kept and kept[0].column("pair")[0].as_py() != pair[0]):
                yield made(pa.Table.from_batches([*kept, b.slice(0, cut)]))
                kept = []
            kept.append(b.slice(cut))
        if kept:
            yield made(pa.Table.from_batches(kept))

    sorted_ = rows.repartition("pair").sortWithinPartitions("pair")
    return sorted_.mapInArrow(run, ", ".join([f"pair {rows.schema['pair'].dataType.simpleString()}", *[f"{n} double" for n in names]]))


def soft_ngrams(scores: DataFrame, n: int) -> DataFrame:
    """As soft_unigrams for runs of n sentences: a run's score is the mean along n steps of the score matrix's diagonal.

    Pairs that are too short for a run score 0.
    """
    from ..functions.text import harmonic_mean

    def kernel(m: np.ndarray) -> np.ndarray:
        p, h = m.shape[1] - n + 1, m.shape[2] - n + 1
        if p < 1 or h < 1:
            return np.zeros((2, len(m)))
        runs = sum(m[:, k : k + p, k : k + h] for k in range(n)) / n
        return np.stack([runs.max(axis=1).mean(axis=1), runs.max(axis=2).mean(axis=1)])

    made = _in_matrices(scores, kernel, ["precision", "recall"])
    return made.withColumn("f1", harmonic_mean(F.col("precision"), F.col("recall")))


def soft_lcs(scores: DataFrame) -> DataFrame:
    """Soft longest common subsequence of premise and hypothesis sentences, over the longer one's length.

    The table's rows are folded one hypothesis sentence at a time, for all pairs of a shape together.
    """

    def kernel(m: np.ndarray) -> np.ndarray:
        before = np.zeros((len(m), m.shape[1] + 1))
        for k in range(m.shape[2]):
            row = before.copy()
            np.maximum(row[:, 1:], before[:, :-1] + m[:, :, k], out=row[:, 1:])
            before = np.maximum.accumulate(row, axis=1)
        return before[None, :, -1] / max(m.shape[1:])

    return _in_matrices(scores, kernel, ["score"])


def by_paragraph(scores: DataFrame, key: str = "doc") -> DataFrame:
    return scores.groupBy(key).agg(F.avg("score").alias("mean"), F.max("score").alias("max"), F.min("score").alias("min"))
