"""Pluggable scorers and generators: functions over partitions, loaded once a worker.

The scorer shipped is lexical containment. It is no entailment model: its columns are named
lexical_* and stand in only where a pipeline must run without model files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

PairScorer = Callable[[list[str], list[str]], list[tuple[float, float, float]]]


def lexical_containment(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis's distinct words that the premise has; 0 without words."""
    p, h = F.array_distinct(T.words(F.lower(premise))), F.array_distinct(T.words(F.lower(hypothesis)))
    return F.when(F.size(h) > 0, F.size(F.array_intersect(p, h)) / F.size(h)).otherwise(0.0)


def score_pairs(pairs: DataFrame, load: Callable[[], PairScorer], premise: str = "premise", hypothesis: str = "hypothesis", batch: int = 64) -> DataFrame:
    """Adds entail, neutral, contradiction of both directions (p2h_ and h2p_) in one pass.

    load is called once in each Python worker and gives a function over lists of texts.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema), *(f"{d}_{k} double" for d in ("p2h", "h2p") for k in ("entail", "neutral", "contradiction"))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch].copy()
                a, b = part[premise].fillna("").tolist(), part[hypothesis].fillna("").tolist()
                for d, scores in (("p2h", scorer(a, b)), ("h2p", scorer(b, a))):
                    for i, k in enumerate(("entail", "neutral", "contradiction")):
                        part[f"{d}_{k}"] = [float(s[i]) for s in scores]
                yield part

    return pairs.mapInPandas(run, schema)


def generate(df: DataFrame, prompt: Column, load: Callable[[], Callable[[list[str]], list[str]]], output: str = "output", batch: int = 32) -> DataFrame:
    """Adds the text that a generator gives for each row's prompt."""
    with_prompt = df.withColumn("_prompt", prompt.cast("string"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{output}` string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            out: list[str] = []
            prompts = frame["_prompt"].fillna("").tolist()
            for start in range(0, len(prompts), batch):
                out += model(prompts[start : start + batch])
            yield frame.drop(columns="_prompt").assign(**{output: out})

    return with_prompt.mapInPandas(run, schema)


def verified(df: DataFrame, output: str = "output") -> DataFrame:
    """A verifier's output as a label; anything but a whole number gives null."""
    return df.withColumn("label", F.trim(output).try_cast("int"))


def embed(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], output: str = "vector", batch: int = 64) -> DataFrame:
    """Adds a vector for each text."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{output}` array<float>"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            texts, out = frame[text].fillna("").tolist(), []
            for start in range(0, len(texts), batch):
                out += model(texts[start : start + batch])
            yield frame.assign(**{output: out})

    return df.mapInPandas(run, schema)


def score_texts(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[float]]], output: str = "score", batch: int = 64) -> DataFrame:
    """Adds a score of each text by itself, such as its likelihood under a model."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{output}` double"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            texts, out = frame[text].fillna("").tolist(), []
            for start in range(0, len(texts), batch):
                out += [float(x) for x in model(texts[start : start + batch])]
            yield frame.assign(**{output: out})

    return df.mapInPandas(run, schema)
