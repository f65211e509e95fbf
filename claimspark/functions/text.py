"""Text as Column functions: clauses, sentences, cleaning, parsing and prompts.

Patterns with white space or word boundaries carry (?U), so that they follow Unicode.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLETS = "array<struct<statement:string,topic:string,sentiment:string>>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body's lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), 0)


# --- points of view and clauses -------------------------------------------------------------

#: First-person forms and what takes their place, applied in this order.
POINT_OF_VIEW = (
    ("I'm", "the user is"),
    ("I've", "the user has"),
    ("I'd", "the user would"),
    ("I", "the user"),
    ("me", "the user"),
    ("mine", "the user's"),
    ("my", "their"),
    ("we're", "the user is"),
    ("we've", "the user has"),
    ("we'd", "the user would"),
    ("we", "the user"),
    ("us", "the user"),
    ("ours", "the user's"),
    ("our", "the user's"),
)
#: Verbs that open a clause without a subject.
OPENING_VERBS = (
    "has have is are was were be being been comes holds folds works fits breaks lasts improves keeps provides allows "
    "supports includes offers requires lacks feels looks sounds seems"
)
#: Subjects that a clause may start with.
SUBJECTS = ("it", "its", "this", "that", "they", "the product", "the item", "the board")


def third_person(c: Column) -> Column:
    """Rewrites the first person; the order of rules matters, and "US" becomes a user too."""
    return reduce(lambda x, rule: F.regexp_replace(x, rf"(?iU)\b{rule[0]}\b", rule[1]), POINT_OF_VIEW, c)


def tidy(c: Column) -> Column:
    """Trims, drops full stops and blanks at the end, and turns runs of white space into one space."""
    ends = F.regexp_replace(c, r"(?U)^\s+|[.\s]+$", "")
    return F.regexp_replace(ends, r"(?U)\s+", " ")


def with_subject(c: Column) -> Column:
    """Puts "it" before a clause that starts with a verb of the list and has no subject."""
    verbs = "|".join(OPENING_VERBS.split())
    starts = c.rlike(rf"(?iU)^(?:{verbs})\b") & ~c.rlike(rf"(?iU)^(?:{'|'.join(SUBJECTS)})\b")
    return F.when(starts, F.concat(F.lit("it "), c)).otherwise(c)


def clause(c: Column) -> Column:
    return with_subject(third_person(tidy(c)))


def as_sentence(statement: Column, sentiment: Column) -> Column:
    """A statement as a sentence of its own; every other sentiment counts as neutral."""
    said = clause(statement)
    return (
        F.when(sentiment == "positive", F.concat(F.lit("The user would appreciate this product because "), said, F.lit(".")))
        .when(sentiment == "negative", F.concat(F.lit("The user may dislike that "), said, F.lit(".")))
        .otherwise(F.concat(F.lit("They seem indifferent to "), said, F.lit(".")))
    )


def join_clauses(clauses: Column) -> Column:
    """a / a, and b / a, b, and c."""
    n = F.size(clauses)
    several = F.concat(F.array_join(F.slice(clauses, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(clauses, -1))
    return F.when(n <= 0, "").when(n == 1, F.try_element_at(clauses, F.lit(1))).otherwise(several)


def first_of_each(items: Column, key) -> Column:
    """Keeps the first item of each key, in order."""
    keyed = F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("v")))

    def kept(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: p["k"])
        marked = let(keys, lambda ks: F.transform(pairs, lambda p, i: F.struct(p["v"].alias("v"), (F.array_position(ks, p["k"]) == i + 1).alias("first"))))
        return F.transform(F.filter(marked, lambda m: m["first"]), lambda m: m["v"])

    return let(keyed, kept)


def paragraph(statements: Column) -> Column:
    """The reader's paragraph of an array of (statement, sentiment), in order of appearance.

    Clauses that are equal up to case within a sentiment are said once. Positive come before
    negative before neutral ones; other sentiments are left out. Null and empty give "".
    """
    said = F.transform(statements, lambda s: F.struct(clause(s["statement"]).alias("clause"), s["sentiment"].alias("sentiment")))
    return paragraph_of_clauses(first_of_each(said, lambda s: F.concat(F.lower(s["clause"]), F.lit("\n"), s["sentiment"])))


def paragraph_of_clauses(said: Column) -> Column:
    """The paragraph of an array of (clause, sentiment) that says nothing twice; null gives ""."""

    def of(sentiment: str) -> Column:
        return F.transform(F.filter(said, lambda s: s["sentiment"] == sentiment), lambda s: s["clause"])

    def blocks_of(parts: Column) -> Column:
        return _blocks(parts["pos"], parts["neg"], parts["neu"])

    return let(F.struct(of("positive").alias("pos"), of("negative").alias("neg"), of("neutral").alias("neu")), blocks_of)


# The openings and joints of the paragraph that readers get.
def _blocks(pos: Column, neg: Column, neu: Column) -> Column:
    first, later = F.size(pos) > 0, (F.size(pos) > 0) | (F.size(neg) > 0)

    def block(clauses: Column, opening: Column) -> Column:
        return F.when(F.size(clauses) > 0, F.concat(opening, join_clauses(clauses), F.lit(".")))

    blocks = F.array(
        block(pos, F.lit("The user would appreciate this product because ")),
        block(neg, F.when(first, F.lit("However, they may dislike that ")).otherwise(F.lit("The user may dislike that "))),
        block(neu, F.when(later, F.lit("They seem indifferent to ")).otherwise(F.lit("The user seems indifferent to "))),
    )
    return F.coalesce(F.array_join(F.array_compact(blocks), " "), F.lit(""))


# --- sentiments and topics ------------------------------------------------------------------


def sentiment_name(c: Column) -> Column:
    """Aliases of sentiments; everything unknown is neutral."""
    x = F.lower(F.trim(c.cast("string")))
    return F.when(x.isin("positive", "pos", "+", "1"), "positive").when(x.isin("negative", "neg", "-", "-1"), "negative").otherwise("neutral")


def sentiment_number(c: Column) -> Column:
    return F.when(c == "positive", 1).when(c == "negative", -1).when(c == "neutral", 0)


def sentiment_of_number(c: Column) -> Column:
    return F.when(c == 1, "positive").when(c == -1, "negative").otherwise("neutral")


def topic_name(c: Column) -> Column:
    return F.lower(F.trim(F.translate(c, "-_", "  ")))


# --- parsing --------------------------------------------------------------------------------


def parse_numbers(c: Column) -> Column:
    """A list of whole numbers in text; an empty array for anything else."""
    return F.coalesce(F.from_json(c, "array<bigint>"), F.array().cast("array<bigint>"))


def _literal_triplets(cells: pd.Series) -> pd.Series:
    import ast

    def parse(cell):
        if cell is None:
            return None
        try:
            found = ast.literal_eval(cell)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        if not isinstance(found, list):
            return None
        return [{k: None if x.get(k) is None else str(x[k]) for k in ("statement", "topic", "sentiment")} for x in found if isinstance(x, dict)]

    return cells.map(parse)


def parse_triplets(c: Column, literals: bool = False) -> Column:
    """Triplets from JSON text; with literals, text that is no JSON is read as a literal list.

    Only rows that are no JSON reach the Arrow function. Null and unreadable text gives null.
    """
    found = F.from_json(c, TRIPLETS)
    if not literals:
        return found
    return F.coalesce(found, F.pandas_udf(_literal_triplets, TRIPLETS)(F.when(found.isNull(), c)))


def first_json_array(c: Column) -> Column:
    """The first array of objects within text, as text; null if there is none."""
    found = F.regexp_extract(c, r"(?s)\[\s*\{.*?\}\s*\]", 0)
    return F.nullif(found, F.lit(""))


def summary_value(c: Column) -> Column:
    """The value of "summarization" in JSON-like text, unescaped; null if there is none."""
    pattern = r'(?s)"summarization"\s*:\s*"((?:[^"\\]|\\.)*)"'
    raw = F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))
    steps = (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\\\", "\\"))
    return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), steps, raw)


def profile_value(c: Column, corpus: str) -> Column:
    """The profile text of a corpus: text after the marker, or the field of a JSON object."""
    if corpus in ("yelp", "google"):
        after = F.try_element_at(F.split(c, '"summarization": "', -1), F.lit(2))
    elif corpus == "amazon":
        after = F.get_json_object(F.replace(c, F.lit("\n"), F.lit("")), "$.summarization")
    else:
        raise ValueError(f"unknown corpus {corpus!r}")
    return F.trim(F.regexp_replace(after, r'(?s)"[^"]*$', ""))


def last_number(c: Column) -> Column:
    """The last number, commas between digits left out; 0.0 without any. Signs are not read."""
    plain = F.regexp_replace(c, r"(\d),(\d)", "$1$2")
    found = F.regexp_extract_all(plain, F.lit(r"(\d+(?:\.\d+)?)"), 1)
    return F.coalesce(F.try_element_at(found, F.lit(-1)).cast("double"), F.lit(0.0))


def before_bracket(c: Column) -> Column:
    return F.split(c, r"\[", 2)[0]


# --- words, sentences, chunks ---------------------------------------------------------------


def words(c: Column) -> Column:
    """Words between runs of white space; an empty array for blank text and null."""
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"(?U)\s+"))


def first_words(c: Column, n: int) -> Column:
    """The text, or its first n words joined by single spaces if it has more."""
    w = words(c)
    return F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")).otherwise(c)


def ngrams(units: Column, n: int) -> Column:
    """Runs of n units of an array; none if there are fewer."""
    none = F.array().cast("array<array<string>>")

    def runs(u: Column) -> Column:
        last = F.size(u) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(u, i, n))).otherwise(none)

    return let(units, runs)


#: Abbreviations after which a sentence goes on.
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "vs.", "etc.", "e.g.", "i.e.", "no.", "fig.", "al.", "inc.", "ltd.")


def sentences(c: Column) -> Column:
    """Lower-cased sentences; a piece that ends with an abbreviation or initial is joined with the next."""
    flat = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    pieces = F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda p: p != "")

    def goes_on(piece: Column) -> Column:
        last = F.lower(F.substring_index(F.rtrim(piece), " ", -1))
        return last.isin(*ABBREVIATIONS) | last.rlike(r"^[a-z]\.$")

    # a sentence runs from a piece that nothing goes on into up to the next such piece; slices, not a fold, keep this linear
    def joined(p: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: (i == 1) | ~goes_on(F.get(p, i - 2)))
        return let(opens, lambda at: F.transform(at, lambda a, k: F.array_join(F.slice(p, a, F.coalesce(F.get(at, k + 1), F.size(p) + 1) - a), " ")))

    whole = let(pieces, lambda p: F.when(F.size(p) > 0, joined(p)).otherwise(F.array().cast("array<string>")))
    return F.filter(F.transform(whole, lambda s: F.trim(F.lower(s))), lambda s: s != "")


def lines_and_sentences(c: Column) -> Column:
    """Pieces between line feeds and after end punctuation, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.?!])\s+|\n+"), lambda p: F.trim(p)), lambda s: s != "")


def capital_sentences(c: Column) -> Column:
    """Pieces that a capital letter follows, each with an end mark."""
    pieces = F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+(?=[A-Z])"), lambda p: F.trim(p)), lambda s: s != "")
    return F.transform(pieces, lambda s: F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit("."))))


def long_sentences(c: Column, least: int = 10) -> Column:
    """Sentences over `least` characters; a rule stands in for a trained splitter."""
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.char_length(s) > least)


def sentence_pairs(c: Column, least: int = 10) -> Column:
    """Each long sentence with the one after it."""
    return let(long_sentences(c, least), lambda s: F.transform(s, lambda _, i: F.array_join(F.slice(s, i + 1, 2), " ")))


def paragraphs(c: Column, least: int = 10) -> Column:
    """Blocks between empty lines, or lines where there are none, over `least` characters."""
    parts = F.when(F.instr(c, "\n\n") > 0, F.split(c, "\n\n")).otherwise(F.split(c, "\n"))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.char_length(p) > least)


def granules(c: Column, granularity: str) -> Column:
    """A text's units for pairwise scoring."""
    kinds = {
        "document": lambda: F.array(c),
        "paragraph": lambda: paragraphs(c),
        "sentence": lambda: long_sentences(c),
        "2sents": lambda: sentence_pairs(c),
        "mixed": lambda: F.concat(long_sentences(c), paragraphs(c)),
    }
    if granularity not in kinds:
        raise ValueError(f"unknown granularity {granularity!r}")
    return kinds[granularity]()


def approx_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(c) / 4)).cast("int")


def chunk_count(c: Column, tokens: int = 1024, most: int = 10) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(approx_tokens(c) / tokens))).cast("int")


def batches(units: Column, size: Column | int) -> Column:
    """Consecutive slices of an array, the last one shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    none = F.array().cast("array<array<string>>")

    def cut(u: Column, k: Column) -> Column:
        n = F.size(u)
        steps = F.sequence(F.lit(0), F.greatest(F.ceil(n / k).cast("int") - 1, F.lit(0)))
        return F.when(n > 0, F.transform(steps, lambda i: F.slice(u, i * k + 1, k))).otherwise(none)

    return let(size, lambda k: let(units, lambda u: cut(u, k)))


def sentence_chunks(c: Column, size: Column | int = 3) -> Column:
    """Chunks of `size` capital-led sentences, joined by ". " and closed by another full stop."""
    return F.transform(batches(capital_sentences(c), size), lambda b: F.concat(F.array_join(b, ". "), F.lit(".")))


def word_chunks(c: Column, size: int = 350) -> Column:
    return F.transform(batches(words(c), size), lambda b: F.array_join(b, " "))


# --- cleaning of generated text -------------------------------------------------------------

#: Marks that models leave in their output.
ARTIFACTS = ("[/INST]", "[INST]", "<s>", "</s>", "<|endoftext|>", "<|assistant|>", "<|user|>", "<|system|>")
#: Byte-order mark, zero-width characters, word joiner, soft hyphen.
INVISIBLE = "\ufeff\u200b\u200c\u200d\u2060\u00ad"
#: Separators of clauses; the longest that occurs is used.
CLAUSE_SEPARATORS = (", however, ", "; however, ", ", and ", "; and ", ", but ", "; but ", " and ", " but ")


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible(c: Column) -> Column:
    """NFKC; text in ASCII does not change."""
    beyond = c.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, F.pandas_udf(_nfkc, "string").asNondeterministic()(F.when(beyond, c))).otherwise(c)


def without_controls(c: Column) -> Column:
    """Drops control and format characters, tabs too, but keeps line ends."""
    return F.regexp_replace(c, r"[\p{Cc}\p{Cf}&&[^\n\r]]", "")


# The patterns and their order, which decide what generated texts look like after cleaning.
def tidy_punctuation(c: Column) -> Column:
    """One mark instead of repeats, no blank before it and one after it; also within 3.5 or 10:30."""
    x = F.regexp_replace(c, r"([,.!?])\1+", "$1")
    x = F.regexp_replace(x, r"(?U)\s+([,.!?;:])", "$1")
    x = F.regexp_replace(x, r"(?U)([,.!?;:])([^\s])", "$1 $2")
    x = F.regexp_replace(x, r"(?U)[^\S\n]+(?=\n|$)|\r\n?", "")
    x = F.regexp_replace(x, r"[ \t]{2,}", " ")
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def without_artifacts(c: Column) -> Column:
    x = reduce(lambda y, a: F.replace(y, F.lit(a), F.lit("")), ARTIFACTS, c)
    x = without_controls(F.translate(x, INVISIBLE, ""))
    x = F.regexp_replace(x, r"(?U)(?:(?<=\s)|^)[\[\]]+(?=\s|$)", " ")  # fixed value: brackets that stand alone
    return tidy_punctuation(x)


def sentence_key(c: Column) -> Column:
    """What makes two sentences the same: lower case, single blanks, no punctuation."""
    x = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.regexp_replace(x, r"[,.!?;:]+", "")


def once_per_clause(c: Column) -> Column:
    """Says each clause of a sentence once."""
    out = None
    for sep in (*CLAUSE_SEPARATORS, None):
        parts = F.transform(F.split(c, f"\\Q{sep}\\E" if sep else ",", -1), lambda p: F.trim(p))
        kept = first_of_each(F.filter(parts, lambda p: p != ""), sentence_key)
        made = F.when(F.size(parts) <= 1, c).otherwise(tidy_punctuation(F.array_join(kept, sep or ", ")))
        out = F.when(F.instr(c, sep) > 0, made) if out is None else out.when(F.instr(c, sep) > 0, made) if sep else out.otherwise(made)
    return out


def cleaned(c: Column) -> Column:
    """A text in NFKC without artifacts, each sentence and clause once; null gives ""."""
    x = F.coalesce(without_artifacts(c), F.lit(""))
    said = first_of_each(lines_and_sentences(x), sentence_key)
    return F.when(x == "", "").otherwise(tidy_punctuation(F.array_join(F.transform(said, once_per_clause), " ")))


def clean_column(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the cleaned text. NFKC is a step of its own: Arrow functions cannot run inside lambdas."""
    return df.withColumn("_nfkc", compatible(F.col(column))).withColumn(name, cleaned(F.col("_nfkc"))).drop("_nfkc")


def detokenized(c: Column, special: Sequence[str] = ()) -> Column:
    """Joins clitics, brackets and punctuation to words, and drops special tokens."""
    x = reduce(lambda y, t: F.replace(y, F.lit(t), F.lit("")), special, c)
    for pattern, to in ((r" '(s|m|ve|d|ll|re)", "'$1"), (r" \(", "("), (r" \)", ")"), (" ,", ","), (r" \.", "."), (" !", "!"), (r" \?", "?")):
        x = F.regexp_replace(x, pattern, to)
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s{2,}", " "), r"(?U)^\s+|\s+$", "")


# --- token ids ------------------------------------------------------------------------------


def padded(ids: Column, length: int, pad: int = 0, left: bool = False) -> Column:
    """Cut or filled to a length, on the right or on the left."""
    filler = F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    if left:
        cut = F.slice(ids, F.greatest(F.size(ids) - length + 1, F.lit(1)), length)
        return F.concat(filler, cut)
    return F.concat(F.slice(ids, 1, length), filler)


def framed(ids: Column, length: int, bos: int, eos: int, pad: int) -> Column:
    """bos, at most `length` ids, eos, then padding to length + 2."""
    inner = F.concat(F.array(F.lit(bos).cast("bigint")), F.slice(ids, 1, length), F.array(F.lit(eos).cast("bigint")))
    return padded(inner, length + 2, pad)


def until(ids: Column, eos: int) -> Column:
    """The ids before the first eos, or all."""
    at = F.array_position(ids, F.lit(eos).cast("bigint")).cast("int")
    return F.when(at > 0, F.slice(ids, 1, F.greatest(at - 1, F.lit(0)))).otherwise(ids)


# --- prompts --------------------------------------------------------------------------------


def words_of_ids(ids: Column, vocabulary: Column, eos: int) -> Column:
    """The words of ids (places in an array of words, from 0) before the first eos; unknown ids give nothing."""
    return F.filter(F.transform(until(ids, eos), lambda i: F.get(vocabulary, i.cast("int"))), lambda w: w.isNotNull())


def messages(system: str, user: Column) -> Column:
    role = lambda name, content: F.struct(F.lit(name).alias("role"), content.alias("content"))
    return F.array(role("system", F.lit(system)), role("user", user))


def extraction_prompt(system: str, review: Column, most_words: int = 128) -> Column:
    return messages(system, F.concat(F.lit("Review: "), first_words(review, most_words), F.lit("\nOutput:")))


def verification_prompt(system: str, document: Column, statement: Column, topic: Column, sentiment: Column) -> Column:
    parts = F.concat(F.lit("Document: "), document, F.lit("\nStatement: "), statement, F.lit("\nTopic: "), topic, F.lit("\nSentiment: "), sentiment, F.lit("\nLabel:"))
    return messages(system, parts)


def numbered(items: Column) -> Column:
    """1. first, 2. second, one a line."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def profile_prompt(system: str, title: Column, description: Column, reviews: Column) -> Column:
    return messages(system, F.concat(F.lit("Title: "), title, F.lit("\nDescription: "), description, F.lit("\nReviews:\n"), numbered(reviews)))


def explanation_prompt(system: str, domain: str, title: Column, user_profile: Column, item_profile: Column) -> Column:
    """Fixed format: the model's instruction frame with places for the vectors of user and item."""
    head = f"<s>[INST] <<SYS>>{system}<</SYS>>user record: <USER_EMBED> {domain} record: <ITEM_EMBED> {domain} name: "
    return F.concat(F.lit(head), title, F.lit(" user profile: "), user_profile, F.lit(f" {domain} profile: "), item_profile, F.lit(" <EXPLAIN_POS>[/INST]"))


def path_prompt(question: Column, paths: Column, neighbours: Column, k: int) -> Column:
    """A question with its first k paths and first k neighbours, one a line."""
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{name}:\n"), numbered(F.slice(c, 1, k)))).otherwise("")
    return F.concat(question, part("Paths", paths), part("Neighbours", neighbours), F.lit("\n### Explanation:"))


def evidence_prompt(question: Column, evidence: Column) -> Column:
    return F.concat(F.lit("Context:\n"), numbered(evidence), F.lit("\nQuestion: "), question, F.lit("\nAnswer:"))


# --- numbers and vectors --------------------------------------------------------------------


def harmonic_mean(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def relation(entail: Column, neutral: Column, contradiction: Column) -> Column:
    """The most probable relation; ties go to entailment, then to neutral."""
    return F.when((entail >= neutral) & (entail >= contradiction), "entailment").when(neutral >= contradiction, "neutral").otherwise("contradiction")
