"""Language identification by rank-order profiles.

A profile ranks the most frequent character 1- to 3-grams of a language (words padded with a
blank on both sides). A document's own most frequent n-grams are ranked the same way, and each
language gets the sum of out-of-place distances; n-grams that a profile lacks count as the
largest distance. The nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: N-grams of a profile, and of a document.
TOP = 300
#: Labelled documents of a language from which its profile is learned, about.
SAMPLE = 3000
UNKNOWN = "und"

#: Bits of a code point within an n-gram's number.
_BITS = 21


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, where every run of other characters is one 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    present = np.unique(codes)
    others = present[[not chr(c).isalpha() for c in present]]
    if len(others):
        codes[np.isin(codes, others)] = 0
    codes = np.concatenate([[0], codes, [0]])
    return codes[(codes != 0) | (np.append(1, codes[:-1]) != 0)]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text's words as numbers, ascending, and how often each occurs.

    A word is padded with one blank (0) on both sides; a blank alone is no n-gram, and none
    spans two words. The number of abc is a, b and c in 21 bits each, plus one; missing
    letters count as nothing.
    """
    c = _letters(text or "")
    if len(c) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = c[c > 0] + 1
    two = ((c[:-1] + 1) << _BITS) | (c[1:] + 1)
    inner = c[1:-1] > 0
    three = (((c[:-2] + 1) << (2 * _BITS)) | ((c[1:-1] + 1) << _BITS) | (c[2:] + 1))[inner]
    every = np.sort(np.concatenate([one, two, three]))
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[first], np.diff(np.append(first, len(every)))


def ranked(numbers: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, ties by number."""
    if len(numbers) > top:  # keeps ties at the cut for the sort
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        kept = counts >= least
        numbers, counts = numbers[kept], counts[kept]
    return numbers[np.argsort(-counts, kind="stable")][:top]


class Profiles:
    """Profiles ready for look-up: for each language its n-grams ascending and their ranks."""

    def __init__(self, profiles: dict[str, list[int]]) -> None:
        self.languages = sorted(profiles)
        self.tables = []
        for x in self.languages:
            p = np.array(profiles[x], np.int64)
            order = np.argsort(p)
            self.tables.append((p[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        top = ranked(*grams(text))
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        place = np.arange(len(top))
        distances = []
        for table, ranks in self.tables:
            at = np.minimum(np.searchsorted(table, top), len(table) - 1)
            distances.append(int(np.where(table[at] == top, np.abs(ranks[at] - place), TOP).sum()))
        best = int(np.argmin(distances))
        return self.languages[best], 1.0 - distances[best] / (TOP * len(top))


def learn_profiles(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int = SAMPLE) -> dict[str, list[int]]:
    """Profiles from about `sample` labelled documents of each language, chosen by a hash of the id.

    Only TOP n-grams for each language reach the driver. Null labels are left out, null and empty
    texts add nothing, repeated rows count as often as they occur, n-grams of equal frequency are
    ordered by their codes, other columns are ignored. An empty table gives no profile.
    """
    known = labelled.filter(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return {}
    keep = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    chosen = known.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < keep[F.col(lang_col)] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                numbers, inverse = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate([f[1] for f in found]), minlength=len(numbers)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(numbers), pa.array(n)], names=["lang", "gram", "n"])

    counts = common.map_batches(chosen.select(F.col(lang_col), F.col(text_col)), count, "lang string, gram long, n long")
    summed = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = summed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP).orderBy("lang", "rank").collect()
    profiles: dict[str, list[int]] = {}
    for r in top:
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id (and the columns of `keep`), lang_pred and score (1 less the distance over the largest possible).

    Null, empty and letterless texts get "und" and 0, as does every text without any profile.
    Every row is treated alone, so repeated rows stay and other columns have no effect. Of
    equally near languages the first in alphabetical order is taken. Texts are taken whole. An
    empty table gives an empty result.
    """
    cols = [id_col, *(keep or [])]
    at = cols.index(text_col) if text_col in cols else len(cols)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols]
    state: list[Profiles] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.append(Profiles(profiles))
        for part in common.slices(batches):
            found = [state[0].predict(t) for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[: len(cols)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*cols, "lang_pred", "score"],
            )

    return common.map_batches(docs.select(*cols, *([F.col(text_col).alias("_text")] if at == len(cols) else [])), run, ", ".join([*fields, "lang_pred string", "score double"]))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.filter(~held_out()), "text", "lang", "doc_id")
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_languages": op5_languages}
ORACLES: dict[str, str] = {}
