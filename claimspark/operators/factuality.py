"""Statement-level precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import harmonic_mean


def label_means(labels: DataFrame, key: str = "index", name: str = "precision") -> DataFrame:
    """Mean, number and sum of 0/1 labels of each example; null labels are left out."""
    return labels.groupBy(key).agg(F.avg("label").alias(name), F.count("label").alias(f"n_{name}"), F.sum("label").alias(f"hits_{name}"))


def best_of_chunks(labels: DataFrame, key: str = "index") -> DataFrame:
    """One label a statement: the best over its chunks."""
    return labels.groupBy(key, "statement_id").agg(F.max("label").alias("label"))


def precision_recall_f1(precision: DataFrame, recall: DataFrame, key: str = "index") -> DataFrame:
    """Examples that both tables have."""
    joined = label_means(precision, key, "precision").join(label_means(recall, key, "recall"), key)
    return joined.withColumn("f1", harmonic_mean(F.col("precision"), F.col("recall")))


def report(precision: DataFrame, recall: DataFrame, key: str = "index") -> DataFrame:
    """num_examples, common_ratio of the larger table's examples, and statements of the common ones on each side."""
    p, r = label_means(precision, key, "precision"), label_means(recall, key, "recall")
    sizes = p.agg(F.count("*").alias("_p")).crossJoin(r.agg(F.count("*").alias("_r")))  # one row each
    both = p.join(r, key).agg(F.count("*").alias("num_examples"), F.coalesce(F.sum("n_precision"), F.lit(0)).alias("precision_total_statements"), F.coalesce(F.sum("n_recall"), F.lit(0)).alias("recall_total_statements"))
    ratio = F.try_divide(F.col("num_examples"), F.greatest("_p", "_r"))
    return both.crossJoin(sizes).select("num_examples", ratio.alias("common_ratio"), "precision_total_statements", "recall_total_statements")


def mean_std(df: DataFrame, metrics: list[str], key: str | None = None) -> DataFrame:
    """metric, mean, std (population), n; 0 where there is nothing."""
    long = df.unpivot([key] if key else [], metrics, "metric", "value")
    out = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))
    return out.na.fill(0.0, ["mean", "std"])


def summary(examples: DataFrame) -> DataFrame:
    return mean_std(examples.select("precision", "recall", "f1"), ["precision", "recall", "f1"])


def entailment_scores(pairs: DataFrame, key: str = "row_index") -> DataFrame:
    """Per example: continuous, binary and coherence precision and recall, and F1 of the first two.

    Precision takes each predicted statement's best over references, recall each reference's
    best over predictions. NaN counts as missing. Coherence has no F1: it can be negative.
    """
    p = {c: F.nanvl(c, F.lit(None).cast("double")) for c in pairs.columns if c.split("_")[-1] in ("entail", "neutral", "contradiction")}
    clean = pairs.withColumns(p)

    def side(direction: str, statement: str, name: str) -> DataFrame:
        e, n, c = (F.col(f"{direction}_{x}") for x in ("entail", "neutral", "contradiction"))
        holds = F.coalesce((F.col(f"{direction}_label") == "entailment") | (e > F.greatest(n, c)), F.lit(False))
        best = clean.groupBy(key, statement).agg(F.max(e).alias("cont"), F.max(holds.cast("int")).alias("bin"), F.max(e - c).alias("coh"))
        return best.groupBy(key).agg(F.avg("cont").alias(f"ent_{name}"), F.avg("bin").alias(f"bin_{name}"), F.avg("coh").alias(f"coh_{name}"))

    both = side("r2p", "pred_sid", "precision").join(side("p2r", "ref_sid", "recall"), key)
    for kind in ("ent", "bin"):
        both = both.withColumn(f"{kind}_f1", harmonic_mean(F.col(f"{kind}_precision"), F.col(f"{kind}_recall")))
    return both


ENTAILMENT_METRICS = ["ent_precision", "ent_recall", "ent_f1", "bin_precision", "bin_recall", "bin_f1", "coh_precision", "coh_recall"]
