"""Queries of the text functions over documents, conversations, parts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scorers
from ..functions import text as T
from ..operators import textmetrics as M
from .frames import OUTPUTS, VOCABULARY, outputs, r6, rounded, table, vocabulary, word_list

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_POV = [
    ("I''m", "the user is"), ("I''ve", "the user has"), ("I''d", "the user would"), ("I", "the user"), ("me", "the user"), ("mine", "the user''s"), ("my", "their"),
    ("we''re", "the user is"), ("we''ve", "the user has"), ("we''d", "the user would"), ("we", "the user"), ("us", "the user"), ("ours", "the user''s"), ("our", "the user''s"),
]


def _pov_sql(x: str) -> str:
    for a, b in _POV:
        x = f"regexp_replace({x}, '\\b{a}\\b', '{b}', 'gi')"
    return x


def _clause_sql(x: str) -> str:
    """The clause in SQL; an inner query would read the text once, a nested call is enough here."""
    tidy = f"regexp_replace(regexp_replace({x}, '^\\s+|[.\\s]+$', '', 'g'), '\\s+', ' ', 'g')"
    return _pov_sql(tidy)


_SAID = "CASE part.p_size % 4 WHEN 0 THEN ' I love my ' WHEN 1 THEN 'has  ' WHEN 2 THEN 'We''ve said it is ours: ' ELSE 'this is US ' END || p_name || '. .'"
_VERBS = T.OPENING_VERBS.replace(" ", "|")
_SUBJECTS = "|".join(T.SUBJECTS)
_CANONICAL = f"""SELECT p_partkey, CASE WHEN regexp_matches(c, '^({_VERBS})\\b', 'i') AND NOT regexp_matches(c, '^({_SUBJECTS})\\b', 'i') THEN 'it ' || c ELSE c END AS clause, sentiment
  FROM (SELECT p_partkey, {_clause_sql(_SAID)} AS c, CASE p_size % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS sentiment FROM part)"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    opening = F.when(k == 0, " I love my ").when(k == 1, "has  ").when(k == 2, "We've said it is ours: ").otherwise("this is US ")
    v = vocabulary(spark, sf_dir).select("sid", "sentiment")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(opening, F.col("p_name"), F.lit(". .")).alias("said"))
    return p.join(v, F.col("p_partkey") == F.col("sid")).drop("sid")


@query(_CANONICAL)
def text_clause(spark, sf_dir):
    return _said(spark, sf_dir).select("p_partkey", T.clause(F.col("said")).alias("clause"), "sentiment")


@query(f"""SELECT p_partkey, CASE sentiment WHEN 'positive' THEN 'The user would appreciate this product because ' WHEN 'negative' THEN 'The user may dislike that '
  ELSE 'They seem indifferent to ' END || clause || '.' AS sentence FROM ({_CANONICAL})""")
def text_sentence(spark, sf_dir):
    return _said(spark, sf_dir).select("p_partkey", T.as_sentence(F.col("said"), F.col("sentiment")).alias("sentence"))


@query(f"SELECT doc_id, len(w) AS n_words, array_to_string(w[1:128], ' ') AS capped FROM (SELECT doc_id, {word_list('text')} AS w FROM documents)")
def text_words(spark, sf_dir):
    w = T.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("bigint").alias("n_words"), F.array_join(F.slice(w, 1, 128), " ").alias("capped"))


_SENTENCES = "string_split(regexp_replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))"


@query(f"""WITH s AS (SELECT doc_id, unnest({_SENTENCES.format('text')}) AS p, generate_subscripts({_SENTENCES.format('text')}, 1) AS k FROM documents),
 m AS (SELECT doc_id, k, p, lag(p) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM s WHERE trim(p) <> ''),
 g AS (SELECT doc_id, k, p, sum(CASE WHEN prev IS NULL OR NOT (lower(regexp_extract(prev, '[^ ]*$')) IN ('mr.','mrs.','ms.','dr.','prof.','sr.','jr.','vs.','etc.','e.g.','i.e.','no.','fig.','al.','inc.','ltd.')
   OR regexp_full_match(lower(regexp_extract(prev, '[^ ]*$')), '[a-z]\\.')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS sentence FROM m),
 j AS (SELECT doc_id, sentence, trim(lower(string_agg(p, ' ' ORDER BY k))) AS s FROM g GROUP BY ALL)
 SELECT doc_id, count(*) AS n, count(DISTINCT s) AS n_distinct, round(count(DISTINCT s) / count(*), 6) AS ratio FROM j GROUP BY doc_id""")
def text_unique_sentences(spark, sf_dir):
    s = T.sentences(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).filter(F.size("s") > 0)
    return d.select("doc_id", F.size("s").cast("bigint").alias("n"), F.size(F.array_distinct("s")).cast("bigint").alias("n_distinct"), r6(F.size(F.array_distinct("s")) / F.size("s")).alias("ratio"))


@query("""SELECT doc_id, CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS tokens,
  CAST(greatest(1, least(10, ceil(greatest(1, floor(length(text) / 4)) / 1024))) AS BIGINT) AS chunks FROM documents""")
def text_chunk_counts(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.approx_tokens(c).cast("bigint").alias("tokens"), T.chunk_count(c).cast("bigint").alias("chunks"))


@query(f"""SELECT doc_id, CAST(k - 1 AS BIGINT) AS chunk_id, array_to_string(w[(k - 1) * 350 + 1 : k * 350], ' ') AS chunk
  FROM (SELECT doc_id, w, unnest(range(1, CAST(ceil(len(w) / 350) AS BIGINT) + 1)) AS k FROM (SELECT doc_id, {word_list('text')} AS w FROM documents))""")
def text_word_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.word_chunks(F.col("text"))).alias("chunk_id", "chunk"))
    return d.select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "chunk")


@query("""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM documents),
 q AS (SELECT doc_id, list_transform(list_filter(list_transform(l, lambda s: trim(s, ' ')), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END) AS l FROM p)
 SELECT doc_id, CAST(k - 1 AS BIGINT) AS chunk_id, array_to_string(l[(k - 1) * 3 + 1 : k * 3], '. ') || '.' AS chunk FROM (SELECT doc_id, l, unnest(range(1, CAST(ceil(len(l) / 3) AS BIGINT) + 1)) AS k FROM q)""")
def text_sentence_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentence_chunks(F.col("text"), 3)).alias("chunk_id", "chunk"))
    return d.select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "chunk")


@query("""SELECT doc_id, CAST(len(list_filter(list_transform(CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10)) ELSE string_split(text, chr(10)) END,
  lambda p: trim(p)), lambda p: length(p) > 10)) AS BIGINT) AS n_paragraphs FROM documents""")
def text_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.paragraphs(F.col("text"))).cast("bigint").alias("n_paragraphs"))


_PUNCT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, ',,+', ',', 'g'), '\\.\\.+', '.', 'g'), '!!+', '!', 'g'), '\\?\\?+', '?', 'g'), '\\s+([,.!?;:])', '\\1', 'g')"


@query(f"""SELECT row_id, trim(regexp_replace(regexp_replace({_PUNCT.format("replace(prediction, chr(10), ' ')")}, '([,.!?;:])([^\\s])', '\\1 \\2', 'g'), ' +', ' ', 'g')) AS tidy FROM (WITH {OUTPUTS} SELECT * FROM o)""")
def text_punctuation(spark, sf_dir):
    return outputs(spark, sf_dir).select("row_id", T.tidy_punctuation(F.replace("prediction", F.lit("\n"), F.lit(" "))).alias("tidy"))


@query()
def text_cleaned(spark, sf_dir):
    return T.clean_column(outputs(spark, sf_dir), "prediction", "cleaned").select("row_id", "cleaned")


@query(f"""WITH {OUTPUTS} SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(prediction, ' ,', ',', 'g'), ' \\.', '.', 'g'), ' !', '!', 'g'), ' \\?', '?', 'g'), '\\s\\s+', ' ', 'g'),
  ' ' || chr(10)) AS text FROM o""")
def text_detokenized(spark, sf_dir):
    return outputs(spark, sf_dir).select("row_id", T.detokenized(F.col("prediction")).alias("text"))


@query("""SELECT p_partkey, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) + 1000 * p_partkey AS n, p_type || ' [' || p_name || '] x' AS raw, p_type || ' ' AS cut, lower(trim(translate(p_type || '-' || p_brand, '-_', '  '))) AS topic FROM part""")
def text_values(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    said = F.concat("p_brand", F.lit(" costs "), F.format_number(F.regexp_extract("p_brand", "[0-9]+", 0).cast("double") + 1000 * F.col("p_partkey"), 0))
    raw = F.concat("p_type", F.lit(" ["), "p_name", F.lit("] x"))
    return p.select("p_partkey", T.last_number(said).alias("n"), raw.alias("raw"), T.before_bracket(raw).alias("cut"), T.topic_name(F.concat_ws("-", "p_type", "p_brand")).alias("topic"))


@query(f"WITH {VOCABULARY} SELECT sid, statement, topic, sentiment, CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS sent FROM v")
def text_triplet_parsing(spark, sf_dir):
    v = vocabulary(spark, sf_dir)
    cell = F.concat(F.lit("Sure: [{'statement': \""), "statement", F.lit("\", 'topic': '"), "topic", F.lit("', 'sentiment': '"), "sentiment", F.lit("'}] done"))
    parsed = v.select("sid", F.inline(T.parse_triplets(T.first_json_array(cell))))
    name = T.sentiment_name(F.col("sentiment"))
    return parsed.select("sid", "statement", "topic", name.alias("sentiment"), T.sentiment_number(name).alias("sent"))


@query("""SELECT o_orderkey AS row_id, o_orderkey % 7 AS a, o_custkey AS b FROM orders""")
def text_list_parsing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cell = F.concat(F.lit("["), (F.col("o_orderkey") % 7).cast("string"), F.lit(", "), F.col("o_custkey").cast("string"), F.lit("]"))
    x = T.parse_numbers(cell)
    return o.select(F.col("o_orderkey").alias("row_id"), F.get(x, 0).alias("a"), F.get(x, 1).alias("b"))


@query("""SELECT p_partkey, 'a "' || p_name || '"' || chr(10) || p_type AS summary FROM part""")
def text_summary_value(spark, sf_dir):
    said = F.concat(F.lit('noise {"summarization" : "a \\"'), "p_name", F.lit('\\"\\n'), "p_type", F.lit('"} end'))
    return table(spark, sf_dir, "part").select("p_partkey", T.summary_value(said).alias("summary"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a0' WHEN 2 THEN 'a0, and a1' WHEN 3 THEN 'a0, a1, and a2' ELSE 'a0, a1, a2, and a3' END AS joined FROM orders")
def text_joined_clauses(spark, sf_dir):
    n = (F.col("o_orderkey") % 5).cast("int")
    items = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.concat(F.lit("a"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.join_clauses(items).alias("joined"))


@query("""SELECT vec_id, CAST(embedding[1] * 1000 AS BIGINT) AS first, len(list_filter(embedding, lambda x: x > 0)) AS positives, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm FROM embeddings""")
def vector_functions(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.bround(F.get(v, 0).cast("double") * 1000).cast("bigint").alias("first"), F.size(F.filter(v, lambda x: x > 0)).cast("bigint").alias("positives"), r6(T.dot(v, v)).alias("norm"))


@query(f"""WITH {OUTPUTS}, w AS (SELECT row_id, {word_list('prediction')} AS p, {word_list('reference')} AS r FROM o)
 SELECT row_id, round(len(list_filter(list_distinct(list_transform(r, lambda x: lower(x))), lambda x: list_contains(list_transform(p, lambda y: lower(y)), x))) / len(list_distinct(list_transform(r, lambda x: lower(x)))), 6) AS lexical,
  round(len(list_filter(p, lambda x: list_contains(r, x))) / len(p), 6) AS overlap FROM w""")
def lexical_scores(spark, sf_dir):
    o = outputs(spark, sf_dir)
    return o.select("row_id", r6(scorers.lexical_containment(F.col("prediction"), F.col("reference"))).alias("lexical"), r6(M.overlap_precision(F.col("prediction"), T.words(F.col("reference")))).alias("overlap"))


@query("SELECT round(count(DISTINCT text) / count(text), 6) AS unique_text_ratio FROM documents")
def unique_text_ratio(spark, sf_dir):
    return rounded(M.unique_text_ratio(table(spark, sf_dir, "documents"), "text"))


def _grams_sql(n: int) -> str:
    return f"SELECT {n} AS n, array_to_string(w[k : k + {n - 1}], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - {n - 2})) AS k FROM w)"


@query(f"""WITH {OUTPUTS}, w AS (SELECT {word_list('prediction')} AS w FROM o), g AS ({_grams_sql(1)} UNION ALL {_grams_sql(2)} UNION ALL {_grams_sql(3)}),
 c AS (SELECT n, g, count(*) AS c FROM g GROUP BY ALL), p AS (SELECT n, c / sum(c) OVER (PARTITION BY n) AS p FROM c), h AS (SELECT n, -sum(p * log2(p)) AS h FROM p GROUP BY n)
 SELECT round(max(h) FILTER (n = 1), 6) AS entropy_1, round(max(h) FILTER (n = 2), 6) AS entropy_2, round(max(h) FILTER (n = 3), 6) AS entropy_3, round(avg(h), 6) AS entropy_mean FROM h""")
def ngram_entropy(spark, sf_dir):
    return rounded(M.entropy(outputs(spark, sf_dir), "prediction"))


@query(f"""WITH {OUTPUTS}, w AS (SELECT row_id, {word_list('prediction')} AS w FROM o)
 SELECT row_id, round(len(list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) / len(w), 6) AS distinct_2 FROM w""")
def distinct_bigrams(spark, sf_dir):
    return outputs(spark, sf_dir).select("row_id", r6(M.distinct_n(F.col("prediction"), 2, "word")).alias("distinct_2"))


@query(f"""WITH {OUTPUTS}, c AS (SELECT row_id, list_transform(range(1, length(prediction) + 1), lambda k: substr(prediction, k, 1)) AS w FROM o)
 SELECT row_id, round(len(list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || w[k + 1] || w[k + 2]))) / len(w), 6) AS distinct_3 FROM c""")
def distinct_character_trigrams(spark, sf_dir):
    return outputs(spark, sf_dir).select("row_id", r6(M.distinct_n(F.col("prediction"), 3)).alias("distinct_3"))


def _match_sql(n: int, text: str = "{0}") -> str:
    side = lambda c: f"SELECT row_id, array_to_string(w[k : k + {n - 1}], ' ') AS g, count(*) AS c FROM (SELECT row_id, w, unnest(range(1, len(w) - {n - 2})) AS k FROM (SELECT row_id, {word_list(text.format(c))} AS w FROM o)) GROUP BY ALL"
    return f"SELECT coalesce(p.row_id, r.row_id) AS row_id, {n} AS n, sum(least(coalesce(p.c, 0), coalesce(r.c, 0))) AS m, sum(coalesce(p.c, 0)) AS tp, sum(coalesce(r.c, 0)) AS tr FROM ({side('prediction')}) p FULL JOIN ({side('reference')}) r ON p.row_id = r.row_id AND p.g = r.g GROUP BY ALL"


def _bleu_sql(order: int, smooth: int) -> str:
    union = " UNION ALL ".join(f"({_match_sql(n)})" for n in range(1, order + 1))
    return f"""WITH {OUTPUTS}, m AS ({union}), s AS (SELECT n, (sum(m) + {smooth}) / (sum(tp) + {smooth}) AS p FROM m GROUP BY n), l AS (SELECT sum(len({word_list('prediction')})) AS p, sum(len({word_list('reference')})) AS r FROM o)
 SELECT round(CASE WHEN min(s.p) > 0 THEN exp(avg(ln(CASE WHEN s.p > 0 THEN s.p END))) * max(CASE WHEN l.p > l.r THEN 1.0 ELSE exp(1 - l.r / l.p) END) ELSE 0.0 END, 6) AS bleu_{order} FROM s, l"""


@query(_bleu_sql(1, 0))
def bleu_1(spark, sf_dir):
    return rounded(M.bleu(outputs(spark, sf_dir), "prediction", "reference", "row_id", 1))


@query(_bleu_sql(4, 1))
def bleu_4_smoothed(spark, sf_dir):
    return rounded(M.bleu(outputs(spark, sf_dir), "prediction", "reference", "row_id", 4, True))


def _rouge_sql(n: int) -> str:
    return f"""WITH {OUTPUTS}, m AS ({_match_sql(n, 'lower({0})')}) SELECT o.row_id, round(coalesce(m / nullif(tp, 0), 0), 6) AS precision, round(coalesce(m / nullif(tr, 0), 0), 6) AS recall,
  round(coalesce(2 * m / nullif(tp + tr, 0), 0), 6) AS f FROM o LEFT JOIN m ON m.row_id = o.row_id"""


@query(_rouge_sql(1))
def rouge_1(spark, sf_dir):
    return rounded(M.rouge_n(outputs(spark, sf_dir), "prediction", "reference", "row_id", 1))


@query(_rouge_sql(2))
def rouge_2(spark, sf_dir):
    return rounded(M.rouge_n(outputs(spark, sf_dir), "prediction", "reference", "row_id", 2))


@query()
def rouge_lcs(spark, sf_dir):
    return outputs(spark, sf_dir).select("row_id", r6(M.rouge_l(F.col("prediction"), F.col("reference"))).alias("f"))


@query(f"""WITH w AS (SELECT doc_id, unnest({word_list('text')}) AS word, generate_subscripts({word_list('text')}, 1) AS pos FROM documents)
 SELECT word, count(*) AS freq, min(doc_id) AS first_doc FROM w GROUP BY word""")
def word_frequencies(spark, sf_dir):
    return M.word_frequencies(table(spark, sf_dir, "documents"), "text", "doc_id").select("word", "freq", F.col("first.doc_id").alias("first_doc"))


@query(f"""WITH w AS (SELECT conv_id * 1000 + turn AS k, unnest({word_list('text')}) AS word, generate_subscripts({word_list('text')}, 1) AS pos FROM conversations),
 f AS (SELECT word, count(*) AS freq, min(struct_pack(k := k, p := pos)) AS first FROM w WHERE word NOT IN ('<bos>','<eos>','<pad>','<unk>','|') GROUP BY word),
 r AS (SELECT word, freq, row_number() OVER (ORDER BY freq DESC, first) AS rn FROM f) SELECT word, freq, rn + 4 AS idx FROM r WHERE rn <= 500""")
def word_vocabulary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    return M.word_vocabulary(c, "text", "k", 500).withColumn("idx", F.col("idx").cast("bigint"))


@query(f"""WITH {OUTPUTS}, t AS (SELECT row_id, unnest({word_list('lower(prediction)')}) AS term FROM o), tf AS (SELECT row_id, term, count(*) AS tf FROM t GROUP BY ALL),
 d AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), w AS (SELECT row_id, term, tf * (ln((1 + (SELECT count(*) FROM o)) / (1 + df)) + 1) AS w FROM tf JOIN d USING (term)),
 n AS (SELECT row_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS weight FROM w),
 k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(weight, 9) DESC, term) AS rank FROM n) SELECT row_id, term, round(weight, 6) AS weight, rank FROM k WHERE rank <= 5""")
def keywords(spark, sf_dir):
    return rounded(M.keywords(outputs(spark, sf_dir), "prediction", "row_id").withColumn("rank", F.col("rank").cast("bigint")))


@query(f"""WITH {OUTPUTS}, v AS (SELECT word, row_number() OVER (ORDER BY freq DESC, first) + 4 AS idx FROM (SELECT word, count(*) AS freq, min(struct_pack(k := row_id, p := pos)) AS first
   FROM (SELECT row_id, unnest({word_list('reference')}) AS word, generate_subscripts({word_list('reference')}, 1) AS pos FROM o) GROUP BY word) QUALIFY idx <= 204),
 w AS (SELECT row_id, unnest({word_list('prediction')}) AS word, generate_subscripts({word_list('prediction')}, 1) AS pos FROM o)
 SELECT row_id, count(*) AS n, CAST(sum(coalesce(idx, 3)) AS BIGINT) AS id_sum, CAST(sum(pos * coalesce(idx, 3)) AS BIGINT) AS ordered_sum FROM w LEFT JOIN v USING (word) GROUP BY row_id""")
def token_ids(spark, sf_dir):
    o = outputs(spark, sf_dir)
    ids = M.token_ids(o, M.word_vocabulary(o, "reference", "row_id", 200), "prediction", "row_id")
    add = lambda s, x: s + x
    zero = F.lit(0).cast("bigint")
    return ids.select("row_id", F.size("ids").cast("bigint").alias("n"), F.aggregate("ids", zero, add).alias("id_sum"), F.aggregate(F.transform("ids", lambda x, i: x * (i + 1)), zero, add).alias("ordered_sum"))
