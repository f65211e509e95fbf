"""Text metrics: overlap with references, diversity, vocabularies and keywords."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def unique_sentence_ratio(c: Column) -> Column:
    s = T.sentences(c)
    return F.when(F.size(s) > 0, F.size(F.array_distinct(s)) / F.size(s)).otherwise(0.0)


def unique_text_ratio(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.try_divide(F.count_distinct(text), F.count(text)).alias("unique_text_ratio"))


def gram_counts(df: DataFrame, text: str, n: int, keys: list[str]) -> DataFrame:
    """keys, gram, n: how often each run of n words occurs in a text."""
    grams = df.select(*keys, F.explode(T.ngrams(T.words(F.col(text)), n)).alias("gram"))
    return grams.groupBy(*keys, "gram").agg(F.count("*").alias("n"))


def _grams(words: Column, n: int, side: int) -> Column:
    """(order, gram, side) of each run of n words."""
    return F.transform(T.ngrams(words, n), lambda g: F.struct(F.lit(n).alias("order"), F.array_join(g, " ").alias("gram"), F.lit(side).alias("side")))


def entropy(df: DataFrame, text: str, orders: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Entropy in bits of the corpus's n-grams of each order, and their arithmetic mean.

    All orders are counted together: each text's n-grams are exploded once.
    """
    each = F.concat(*[_grams(F.col("_w"), n, 0) for n in orders])
    counts = df.select(T.words(F.col(text)).alias("_w")).select(F.inline(each)).groupBy("order", "gram").agg(F.count("*").alias("c"))
    # H = log2(N) - sum(c * log2(c)) / N needs no second pass for N
    by = counts.groupBy("order").agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("h"))
    wide = by.agg(*[F.max(F.when(F.col("order") == n, F.col("h"))).alias(f"entropy_{n}") for n in orders])
    return wide.withColumn("entropy_mean", sum((F.coalesce(F.col(f"entropy_{n}"), F.lit(0.0)) for n in orders), F.lit(0.0)) / len(orders))


def distinct_n(c: Column, n: int, unit: str = "char") -> Column:
    """Different runs of n characters (or words) over the number of characters (or words)."""
    units = F.filter(F.split(c, ""), lambda x: x != "") if unit == "char" else T.words(c)
    grams = F.transform(T.ngrams(units, n), lambda g: F.array_join(g, "\x01"))  # strings are told apart by hash
    return F.when(F.size(units) > 0, F.size(F.array_distinct(grams)) / F.size(units)).otherwise(0.0)


def _matches(df: DataFrame, a: str, b: str, key: str, orders: list[int]) -> DataFrame:
    """key, order, gram, ca, cb: how often each side has an n-gram. Both sides and all orders are
    exploded together after their words have been split once, so nothing is joined."""
    split = df.select(key, T.words(F.col(a)).alias("_a"), T.words(F.col(b)).alias("_b"))
    each = F.concat(*[_grams(F.col(c), n, s) for n in orders for s, c in enumerate(("_a", "_b"))])
    grams = split.select(key, F.inline(each)).groupBy(key, "order", "gram")
    return grams.agg(F.count_if(F.col("side") == 0).alias("ca"), F.count_if(F.col("side") == 1).alias("cb"))


def matched(df: DataFrame, a: str, b: str, key: str, n: int) -> DataFrame:
    """key, match (clipped common n-grams), total_a, total_b; texts without n-grams count 0."""
    sums = _matches(df, a, b, key, [n]).groupBy(key).agg(F.sum(F.least("ca", "cb")).alias("match"), F.sum("ca").alias("total_a"), F.sum("cb").alias("total_b"))
    return df.select(key).join(sums, key, "left").na.fill(0, ["match", "total_a", "total_b"])


def bleu(df: DataFrame, prediction: str, reference: str, key: str, order: int = 4, smooth: bool = False) -> DataFrame:
    """Corpus score with one reference: clipped precisions to `order`, and the brevity penalty."""
    found = _matches(df, prediction, reference, key, list(range(1, order + 1))).groupBy("order").agg(F.sum(F.least("ca", "cb")).alias("m"), F.sum("ca").alias("t"))
    every = df.sparkSession.range(1, order + 1).select(F.col("id").cast("int").alias("order")).join(found, "order", "left").na.fill(0, ["m", "t"])
    one = 1 if smooth else 0
    precision = F.try_divide(F.col("m") + one, F.col("t") + one)
    logs = every.agg(F.min(F.coalesce(precision, F.lit(0.0))).alias("least"), F.avg(F.when(precision > 0, F.ln(precision))).alias("log"))
    n = lambda c: F.sum(F.size(T.words(F.col(c))))
    sizes = df.agg(n(prediction).alias("p"), n(reference).alias("r"))
    penalty = F.when(F.col("p") > F.col("r"), 1.0).when(F.col("p") > 0, F.exp(1 - F.col("r") / F.col("p"))).otherwise(0.0)
    return logs.crossJoin(sizes).select(F.when(F.col("least") > 0, F.exp("log") * penalty).otherwise(0.0).alias(f"bleu_{order}"))


def rouge_n(df: DataFrame, prediction: str, reference: str, key: str, n: int = 1) -> DataFrame:
    """key, precision, recall, f of clipped n-grams; words in lower case, without a stemmer."""
    low = df.select(key, F.lower(prediction).alias("_p"), F.lower(reference).alias("_r"))
    m = matched(low, "_p", "_r", key, n)
    p, r = (F.coalesce(F.try_divide("match", t), F.lit(0.0)) for t in ("total_a", "total_b"))
    return m.select(key, p.alias("precision"), r.alias("recall")).withColumn("f", T.harmonic_mean(F.col("precision"), F.col("recall")))


def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    def length(x, y) -> int:
        places: dict[str, int] = {}
        for i, w in enumerate(x):
            places[w] = places.get(w, 0) | 1 << i
        whole = (1 << len(x)) - 1
        free = whole  # bit i is 0 where a match of the first words ends
        for w in y:
            hit = free & places.get(w, 0)
            free = ((free + hit) | (free - hit)) & whole
        return len(x) - free.bit_count()

    return pd.Series([length(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of words, by an Arrow function on bit sets."""
    return F.pandas_udf(_lcs, "bigint")(a, b)


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F of the longest common subsequence of words in lower case."""
    p, r = T.words(F.lower(prediction)), T.words(F.lower(reference))
    n = lcs_length(p, r)
    return F.when((F.size(p) > 0) & (F.size(r) > 0), T.harmonic_mean(n / F.size(p), n / F.size(r))).otherwise(0.0)


def overlap_precision(output: Column, sources: Column) -> Column:
    """Share of an output's words that its sources have."""
    w = T.words(output)
    return F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: F.array_contains(sources, x))) / F.size(w)).otherwise(0.0)


def word_frequencies(df: DataFrame, text: str, key: str) -> DataFrame:
    """word, freq, and where it first occurs."""
    return df.select(key, F.posexplode(T.words(F.col(text))).alias("pos", "word")).groupBy("word").agg(F.count("*").alias("freq"), F.min(F.struct(key, "pos")).alias("first"))


#: The words with the first ids of a vocabulary.
RESERVED = ("<bos>", "<eos>", "<pad>", "<unk>", "|")


def word_vocabulary(df: DataFrame, text: str, key: str, size: int = 20000) -> DataFrame:
    """word, freq, idx of the most frequent words, ties by first appearance; ids follow the reserved ones."""
    counted = word_frequencies(df, text, key).filter(~F.col("word").isin(*RESERVED))
    flat = counted.select("word", "freq", F.col(f"first.{key}").alias("_k"), F.col("first.pos").alias("_p")).orderBy(F.desc("freq"), "_k", "_p").limit(size)
    order = Window.orderBy(F.desc("freq"), "_k", "_p")  # at most `size` rows
    return flat.withColumn("idx", F.row_number().over(order) + F.lit(len(RESERVED) - 1)).select("word", "freq", "idx")


def token_ids(df: DataFrame, vocabulary: DataFrame, text: str, key: str) -> DataFrame:
    """key, ids: the vocabulary's ids of a text's words, unknown words as <unk>."""
    unknown = RESERVED.index("<unk>")
    flat = df.select(key, F.posexplode(T.words(F.col(text))).alias("pos", "word")).join(vocabulary.select("word", "idx"), "word", "left")
    rows = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("idx", F.lit(unknown)).alias("idx")))).alias("_l"))
    return rows.select(key, F.transform("_l", lambda x: x["idx"].cast("bigint")).alias("ids"))


def words_of_ids(df: DataFrame, vocabulary: DataFrame, ids: str, key: str, end: str = "<eos>") -> DataFrame:
    """key, words: the words of each list of ids up to the first end mark.

    Reserved ids give their marks; ids that neither has, and null ones, give nothing. Empty and
    null lists give empty lists.
    """
    kept = T.until(F.col(ids), RESERVED.index(end))
    flat = df.select(key, F.posexplode(kept).alias("pos", "idx")).join(vocabulary.select("idx", "word"), "idx", "left")
    named = flat.withColumn("word", F.coalesce("word", F.get(F.array(*map(F.lit, RESERVED)), F.when(F.col("idx") < len(RESERVED), F.col("idx")).cast("int"))))
    rows = named.filter("word is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("_l"))
    return df.select(key).join(rows, key, "left").select(key, F.coalesce(F.transform("_l", lambda x: x["word"]), F.array()).alias("words"))


def tfidf(df: DataFrame, text: str, key: str, stop_words: tuple[str, ...] = (), least_documents: int = 2) -> DataFrame:
    """key, term, weight: term frequency times ln((1 + n) / (1 + df)) + 1, of unit length within a text."""
    terms = df.select(key, F.explode(T.words(F.lower(text))).alias("term")).filter(~F.col("term").isin(*stop_words) if stop_words else F.lit(True))
    tf = terms.groupBy(key, "term").agg(F.count("*").alias("tf"))
    documents = df.agg(F.count("*").alias("_n"))
    dfs = tf.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= least_documents)
    weighed = tf.join(dfs, "term").crossJoin(F.broadcast(documents)).withColumn("w", F.col("tf") * (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighed.withColumn("weight", F.col("w") / norm).select(key, "term", "weight")


def keywords(df: DataFrame, text: str, key: str, k: int = 5, **options) -> DataFrame:
    """The k terms of largest weight of each text, ties by term."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), "term")
    return tfidf(df, text, key, **options).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def embedding_similarity(df: DataFrame, a: str, b: str) -> DataFrame:
    c = T.cosine(F.col(a), F.col(b))
    return df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))


def feature_lists(df: DataFrame, entity: str, feature: str, order: str = "row_id") -> DataFrame:
    """Each entity's features in order."""
    rows = df.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(order, F.col(feature).alias("f")))).alias("_l"))
    return rows.select(entity, F.transform("_l", lambda x: x["f"]).alias("features"))


def mean_distinct(df: DataFrame, text: str, n: int) -> DataFrame:
    """Distinct n-grams over words of each text, on average; texts without words count 0."""
    w = T.words(F.col(text))
    each = F.when(F.size(w) > 0, F.size(F.array_distinct(T.ngrams(w, n))) / F.size(w)).otherwise(0.0)
    return df.agg(F.avg(each).alias("distinct"))


def _union_lcs(predictions: pd.Series, references: pd.Series) -> pd.Series:
    """Words of reference sentences that lie on a longest common subsequence with some predicted sentence, each word as often as the prediction has it at most."""

    def on_path(r: list[str], c: list[str]) -> set[int]:
        rows = [[0] * (len(c) + 1)]
        for x in r:
            before, row = rows[-1], [0]
            for j, y in enumerate(c):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
            rows.append(row)
        found, i, j = set(), len(r), len(c)
        while i and j:
            if r[i - 1] == c[j - 1]:
                found.add(i - 1)
                i, j = i - 1, j - 1
            elif rows[i][j - 1] > rows[i - 1][j]:
                j -= 1
            else:
                i -= 1
        return found

    # lines come as one text and are cut row by row, so that no batch of lists of words is held
    cut = lambda text: [line.split(" ") for line in text.split("\n")] if text else []

    def hits(prediction: list[list[str]], reference: list[list[str]]) -> int:
        left = Counter(w for s in prediction for w in s)
        n = 0
        for r in reference:
            for i in sorted(set().union(*(on_path(r, c) for c in prediction))):
                if left[r[i]] > 0:
                    left[r[i]] -= 1
                    n += 1
        return n

    return pd.Series([hits(cut(p), cut(r)) for p, r in zip(predictions, references, strict=True)], dtype="int64")


def rouge_l_summary(prediction: Column, reference: Column) -> Column:
    """F of the longest common subsequences of lines, united over the prediction's lines for each of the reference."""
    lines = lambda c: F.filter(F.transform(F.split(F.lower(c), "\n"), T.words), lambda w: F.size(w) > 0)
    p, r = lines(prediction), lines(reference)
    flat = lambda c: F.array_join(F.transform(c, lambda w: F.array_join(w, " ")), "\n")  # noqa: E731  words have no white space
    n = F.pandas_udf(_union_lcs, "bigint")(flat(p), flat(r))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, w: s + F.size(w))
    return F.when((total(p) > 0) & (total(r) > 0), T.harmonic_mean(n / total(p), n / total(r))).otherwise(0.0)
