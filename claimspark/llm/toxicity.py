"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on hashed words is trained in numpy from confirmed toxic texts and
unlabelled texts. With class prior p the risk is p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-));
where the second part turns negative its gradient is reversed, so that unlabelled positives
are not learned by heart as negatives.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 18
#: Bounds of the training sample: confirmed toxic texts, and unlabelled texts.
POSITIVES, UNLABELLED = 4000, 12000
#: Features in fewer texts of the sample, or not clearly commoner among confirmed texts, are not used.
MIN_TEXTS, LEAST_Z = 5, 4.0
THRESHOLD = 0.7
#: Lengths of the beginnings of words that are features.
BEGINNINGS = (3, 4, 5)
_MEMO_WORDS = 200_000
_EDGES = re.compile(r"^\W+|\W+$")


def buckets(raw: str) -> tuple[int, ...]:
    """Features of a blank-separated word, lower case and without punctuation at its ends: itself and its beginnings."""
    word = _EDGES.sub("", raw.lower())
    parts = [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)] if word else []
    return tuple([zlib.crc32(x.encode()) % BUCKETS for x in parts])


class Features:
    """The distinct features of texts. Long texts have many words, so each is looked up once."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> set[int]:
        known = self.known
        if len(known) > _MEMO_WORDS:
            known.clear()
        found: set[int] = set()
        for w in set((text or "").split()):
            if w not in known:
                known[w] = buckets(w)
            found.update(known[w])
        return found


@dataclass
class Model:
    """Weights by feature, and the bias; scores are sigmoids of their sums."""

    weights: dict[int, float]
    bias: float

    def score(self, features: set[int]) -> float:
        z = self.bias + sum([self.weights[f] for f in sorted(features) if f in self.weights])
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0))))


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 150, rate: float = 0.1, l2: float = 1e-4) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss.

    Without positive or unlabelled texts the model scores every text with the prior.
    """
    if not positive or not unlabelled:
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return Model({}, float(np.log(p / (1 - p))))
    rows = positive + unlabelled
    flat = np.concatenate(rows)
    n_pos, n_unl = len(positive), len(unlabelled)
    from_pos = sum(map(len, positive))
    p, u = (np.bincount(x, minlength=BUCKETS) / n for x, n in ((flat[:from_pos], n_pos), (flat[from_pos:], n_unl)))
    mean = (p * n_pos + u * n_unl) / len(rows)
    texts = mean * len(rows)
    more = (p - u) / np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / n_pos + 1 / n_unl))
    used = np.flatnonzero((texts >= MIN_TEXTS) & (more >= LEAST_Z))
    index = np.full(BUCKETS, -1)
    index[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = index[flat]
    owner, col = owner[col >= 0], col[col >= 0]
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, epochs + 1):
        z = np.bincount(owner, weights=w[col], minlength=len(rows)) + b
        s = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        loss_minus = np.logaddexp(0, z)
        negative_part = loss_minus[n_pos:].mean() - prior * loss_minus[:n_pos].mean()
        g = np.zeros(len(rows))
        if negative_part >= 0:
            g[:n_pos] = prior * (s[:n_pos] - 1) / n_pos - prior * s[:n_pos] / n_pos
            g[n_pos:] = s[n_pos:] / n_unl
        else:  # only the reversed gradient of the part that went negative
            g[:n_pos] = prior * s[:n_pos] / n_pos
            g[n_pos:] = -s[n_pos:] / n_unl
        grad = np.append(np.bincount(col, weights=g[owner], minlength=len(used)) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    z = np.bincount(owner, weights=w[col], minlength=len(rows)) + b
    return Model(dict(zip(used.tolist(), w.tolist(), strict=True)), float(b - _shift(z[:n_pos], z[n_pos:], prior)))


def _shift(pos: np.ndarray, unl: np.ndarray, prior: float) -> float:
    """Moves the threshold where the estimated F1 of the prediction is best.

    With prior p, recall comes from the positives and the share of predicted texts from the
    unlabelled ones: F1 = 2 * p * recall / (p + predicted share). Among equally good cuts the
    middle of the widest gap is taken, and it gets the logit of THRESHOLD.
    """
    every = np.unique(np.concatenate([pos, unl]))
    if len(every) < 2:
        return 0.0
    cuts = (every[1:] + every[:-1]) / 2
    recall = 1 - np.searchsorted(np.sort(pos), cuts) / len(pos)
    share = 1 - np.searchsorted(np.sort(unl), cuts) / len(unl)
    f1 = 2 * prior * recall / (prior + share)
    good = np.flatnonzero(f1 >= f1.max() * 0.995)
    cut = cuts[good[np.argmax(np.diff(every)[good])]]
    return float(cut - np.log(THRESHOLD / (1 - THRESHOLD)))


def _sampled(docs: DataFrame, text_col: str, most: int) -> list[np.ndarray]:
    """The features of the texts, of `most` of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part in common.slices(batches):
            found = [np.array(sorted(features.of(t)), "<i4").tobytes() for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["features"])

    table = common.map_batches(docs.select(text_col), run, "features binary").limit(most).toPandas()
    return [np.frombuffer(x, "<i4").astype(np.int64) for x in sorted(table["features"])]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Trains on at most about POSITIVES confirmed and UNLABELLED unlabelled texts, chosen by a hash.

    The prior is the share of toxic labels; a document with several labels counts as toxic if
    one of them is. Null labels, null ids and labels of missing documents are left out; null and
    empty texts count as texts without words. Rows are drawn by their id, rows without one by their
    text. Documents that occur several times are drawn together and count each time, but never
    more than twice POSITIVES and twice UNLABELLED rows go to the driver. Other columns are ignored. Without documents or toxic labels
    every text scores the same, near 0.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    total = docs.count()
    if not toxic or not total:
        return Model({}, -4.0)
    draw = F.pmod(F.xxhash64(id_col, F.lit("toxicity")), F.lit(1_000_000))
    row_draw = F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(F.lit("row"), text_col), F.lit(1_000_000))).otherwise(draw)
    ids = known.filter((F.col("toxic") == 1) & (draw < 1_000_000 * POSITIVES / toxic)).select(id_col).limit(2 * POSITIVES).collect()
    confirmed = spark.createDataFrame(ids, known.select(id_col).schema)
    positive = _sampled(docs.join(F.broadcast(confirmed), id_col, "left_semi"), text_col, 2 * POSITIVES)
    unlabelled = _sampled(docs.filter(row_draw < 1_000_000 * UNLABELLED / total), text_col, 2 * UNLABELLED)
    return train_nnpu(positive, unlabelled, toxic / n)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row; null and empty texts get the score of a text without words.

    Texts are taken whole and rows alone, so repeated rows stay and equal texts have equal
    scores. Other columns are ignored. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    state: list[Features] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.append(Features())
        for part in common.slices(batches):
            scores = [model.score(state[0].of(t)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    return common.map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = common.id_crc("doc_id") % 3 == 1
    model = learn(docs.filter(~held_out), labels.filter(~held_out))
    scored = score_texts(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
