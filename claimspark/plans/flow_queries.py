"""Queries of cleaning, scoring, generation and ranking flows from end to end, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scorers
from ..functions import text as T
from ..operators import factuality, graph, pairs, ranking, retrieval, sampling, statements, tasks
from ..operators import textmetrics as M
from ..sources import tables as S
from .data_queries import _AUDIT, _audited
from .frames import INTERACTIONS, OUTPUTS, TRIPLETS, interactions, outputs, r6, rounded, table, triplets, word_list
from .metric_queries import _ASKED, _asked, _edges

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- statements -----------------------------------------------------------------------------


_SENTIMENTS = ("positive", "negative")
_TABLE = f"""tt AS (SELECT topic, {', '.join(f"count(*) FILTER (sentiment = '{s}') AS {s}_unique, CAST(coalesce(sum(freq) FILTER (sentiment = '{s}'), 0) AS BIGINT) AS {s}_total" for s in _SENTIMENTS)},
  count(*) FILTER (sentiment IN ('positive','negative')) AS "TOTAL_unique", CAST(coalesce(sum(freq) FILTER (sentiment IN ('positive','negative')), 0) AS BIGINT) AS "TOTAL_total" FROM a GROUP BY topic)"""
_COLUMNS = [f"{s}_{k}" for s in (*_SENTIMENTS, "TOTAL") for k in ("unique", "total")]


@query(f"WITH {_AUDIT}, {_TABLE} SELECT * FROM tt UNION ALL BY NAME SELECT 'TOTAL' AS topic, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _COLUMNS)} FROM tt")
def topic_totals(spark, sf_dir):
    return statements.with_total_row(statements.topic_table(_audited(spark, sf_dir), list(_SENTIMENTS)))


@query(f"WITH {TRIPLETS} SELECT row_id, count(*) AS n FROM t WHERE statement LIKE '%a%' GROUP BY row_id")
def nonempty_triplets(spark, sf_dir):
    """Rows that keep a triplet after the statements without the letter a have gone from their lists."""
    lists = triplets(spark, sf_dir).groupBy("row_id").agg(F.collect_list(F.struct("statement", "topic", "sentiment")).alias("statements"))
    kept = lists.withColumn("statements", F.filter("statements", lambda t: t["statement"].contains("a")))
    return statements.nonempty(kept).select("row_id", F.size("statements").cast("bigint").alias("n"))


_REPAIRS = "rp AS (SELECT * FROM (VALUES ('small brass', 'brass'), ('large steel', 'steel'), ('medium tin', 'tin')) v(w, r))"
_NORMAL = f"n AS (SELECT row_id, pos, statement, coalesce(r, topic) AS topic, sentiment FROM (SELECT row_id, pos, statement, trim(replace(replace(lower(topic), '-', ' '), '_', ' ')) AS topic, sentiment FROM t) LEFT JOIN rp ON w = topic)"


def _repairs(spark):
    return spark.createDataFrame([("small brass", "brass"), ("large steel", "steel"), ("medium tin", "tin")], "wrong_topic string, topic string")


def _normalised(spark, sf_dir, **accepted):
    repairs = _repairs(spark)
    raw = triplets(spark, sf_dir).withColumn("topic", F.upper(F.replace(F.col("topic"), F.lit(" "), F.lit("_")))).withColumn("sentiment", F.concat(F.lit(" "), F.upper("sentiment")))
    return statements.normalised(raw, repairs, **accepted)


@query(f"WITH {TRIPLETS}, {_REPAIRS}, {_NORMAL} SELECT row_id, pos, topic, sentiment FROM n WHERE topic IN ('economy', 'standard', 'brass', 'steel') AND sentiment IN ('positive', 'negative')")
def strict_triplets(spark, sf_dir):
    return _normalised(spark, sf_dir, topics=["economy", "standard", "brass", "steel"], sentiments=list(_SENTIMENTS)).select("row_id", "pos", "topic", "sentiment")


@query(f"WITH {TRIPLETS}, {_REPAIRS}, {_NORMAL} SELECT row_id, pos, topic, sentiment FROM n")
def lenient_triplets(spark, sf_dir):
    return _normalised(spark, sf_dir).select("row_id", "pos", "topic", "sentiment")


_CELLS = f"""f AS (SELECT row_id, pos, statement, CASE WHEN pos % 9 <> 0 THEN topic END AS topic, sentiment FROM n WHERE pos % 10 <> 1 AND row_id % 7 <> 0 AND row_id % 11 <> 0),
 v AS (SELECT statement, topic, sentiment, count(*) AS freq, row_number() OVER (ORDER BY min(struct_pack(r := row_id, p := pos))) - 1 AS sid FROM f GROUP BY statement, topic, sentiment)"""


def _processed(spark, sf_dir):
    """Triplets as a model may write them: JSON or literals, some cells broken or null, some topics and statements missing."""
    t = triplets(spark, sf_dir)
    mark = lambda c: F.upper(F.replace(c, F.lit(" "), F.lit("_")))
    said = F.struct(F.when(F.col("pos") % 10 != 1, mark("statement")).alias("statement"), F.when(F.col("pos") % 9 != 0, mark("topic")).alias("topic"), F.concat(F.lit(" "), F.upper("sentiment")).alias("sentiment"))
    lists = t.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", said.alias("t")))).alias("l"))
    json = F.to_json(F.transform("l", lambda x: x["t"]))
    k = F.col("row_id")
    cell = F.when(k % 11 == 0, None).when(k % 7 == 0, F.concat(F.lit("Sure: "), json)).when(k % 2 == 0, F.replace(json, F.lit('"'), F.lit("'"))).otherwise(json)
    return statements.processed(lists.select("row_id", cell.alias("statements")), repairs=_repairs(spark))


@query(f"""WITH {TRIPLETS}, {_REPAIRS}, {_NORMAL}, {_CELLS}, l AS (SELECT row_id, string_agg(sid, ',' ORDER BY pos) AS ids, string_agg(f.statement || '/' || coalesce(f.topic, '?'), '|' ORDER BY pos) AS said
   FROM f JOIN v ON f.statement = v.statement AND f.topic IS NOT DISTINCT FROM v.topic AND f.sentiment = v.sentiment GROUP BY row_id)
 SELECT row_id, CASE WHEN row_id % 7 <> 0 AND row_id % 11 <> 0 THEN coalesce(ids, '') END AS statement_ids, CASE WHEN row_id % 7 <> 0 AND row_id % 11 <> 0 THEN coalesce(said, '') END AS statements
 FROM (SELECT DISTINCT row_id FROM t) LEFT JOIN l USING (row_id)""")
def processed_triplets(spark, sf_dir):
    rows, _ = _processed(spark, sf_dir)
    said = F.transform("statements", lambda t: F.concat_ws("/", t["statement"], F.coalesce(t["topic"], F.lit("?"))))
    return rows.select("row_id", F.array_join(F.col("statement_ids").cast("array<string>"), ",").alias("statement_ids"), F.array_join(said, "|").alias("statements"))


@query(f"WITH {TRIPLETS}, {_REPAIRS}, {_NORMAL}, {_CELLS} SELECT sid, statement, topic, sentiment, freq FROM v")
def processed_vocabulary(spark, sf_dir):
    return _processed(spark, sf_dir)[1]


@query("""SELECT event_id % 97 AS index, count(*) FILTER (value > 35) AS hits FROM events WHERE event_type = 'click' GROUP BY 1""")
def checked_task(spark, sf_dir):
    """Labels of a task whose inputs have been checked."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click'").select((F.col("event_id") % 97).alias("index"), (F.col("value") > 35).cast("int").alias("label"))
    tasks.require("statement2explanation", {"predictions": e})
    return factuality.label_means(e).select("index", F.col("hits_precision").alias("hits"))


@query("""WITH g AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'statement2explanation' WHEN 1 THEN 'statement_ref2explanation_gen' WHEN 2 THEN 'statement2item_chunk' ELSE 'other' END AS task, o_custkey % 2 = 0 AS p, o_custkey % 3 = 0 AS r, o_custkey % 5 = 0 AS m FROM orders),
 l AS (SELECT o_orderkey, CASE WHEN task <> 'other' THEN concat_ws(',', CASE WHEN NOT p THEN 'predictions' END, CASE WHEN NOT r AND task <> 'statement2explanation' THEN 'references,reference_statements' END, CASE WHEN NOT m AND task = 'statement2item_chunk' THEN 'item_metadata' END) END AS lacking FROM g)
 SELECT o_orderkey, coalesce(lacking = '', false) AS accepted, lacking FROM l""")
def refused_tasks(spark, sf_dir):
    """Configurations of evaluation tasks, most of which lack inputs."""
    o = table(spark, sf_dir, "orders")
    task = F.element_at(F.array(*map(F.lit, ("statement2explanation", "statement_ref2explanation_gen", "statement2item_chunk", "other"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    has = lambda n, *names: F.when(F.col("o_custkey") % n == 0, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    given = F.concat(has(2, "predictions"), has(3, "references", "reference_statements"), has(5, "item_metadata"))
    asked = o.select(F.struct("o_orderkey", task.alias("task"), given.alias("given")).alias("c")).select("c.*")
    found = tasks.refusals(asked.select(F.col("task"), F.col("given")).distinct())
    known = found.select("task", "given", "accepted", F.array_join("lacking", ",").alias("lacking"))
    return asked.join(known, ["task", "given"]).select("o_orderkey", "accepted", "lacking")


_TURNS = "t AS (SELECT conv_id, list(text ORDER BY turn) AS said FROM conversations WHERE role = 'user' AND turn < 6 GROUP BY conv_id)"
_NUMBERED = "array_to_string(list_transform(said, lambda x, i: i || '. ' || coalesce(x, '')), chr(10))"


def _turns(spark, sf_dir):
    """What users said in the first turns of a conversation, in order: six texts at most."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user' and turn < 6")
    listed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("l"))
    return listed.select("conv_id", F.transform("l", lambda x: x["text"]).alias("said"))


@query(f"WITH {_TURNS} SELECT conv_id, 'Profile the item.' || chr(30) || 'Title: c' || conv_id || chr(10) || 'Description: talk' || chr(10) || 'Reviews:' || chr(10) || {_NUMBERED} AS prompt FROM t")
def item_profile_prompts(spark, sf_dir):
    title = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    made = T.profile_prompt("Profile the item.", title, F.lit("talk"), F.col("said"))
    return _turns(spark, sf_dir).select("conv_id", F.array_join(F.transform(made, lambda m: m["content"]), "\x1e").alias("prompt"))


@query(f"""WITH {INTERACTIONS}, n AS (SELECT user_id, count(DISTINCT item_id) AS items FROM i GROUP BY user_id),
 h AS (SELECT t.row_id, h.row_id AS x, row_number() OVER (PARTITION BY t.row_id ORDER BY h.row_id) AS k FROM i t JOIN i h ON h.item_id = t.item_id AND h.user_id <> t.user_id),
 s AS (SELECT row_id, CAST(sum(x) AS BIGINT) AS id_sum FROM h WHERE k <= 8 GROUP BY row_id)
 SELECT row_id, 1 + (items > 1)::INT AS samples, items > 1 AS other_item, coalesce(id_sum, 0) AS id_sum FROM i JOIN n USING (user_id) LEFT JOIN s USING (row_id)""")
def review_samples(spark, sf_dir):
    """Of each row: how many samples it has, whether its negative is its user's and about another item, and the item's history on all of them."""
    i = interactions(spark, sf_dir)
    made = sampling.review_samples(i, 8)
    of = i.select(F.col("row_id").alias("text_row"), F.col("user_id").alias("_u"), F.col("item_id").alias("_i"))
    total = F.aggregate(F.filter("history_ids", lambda x: x >= 0), F.lit(0).cast("bigint"), lambda s, x: s + x)
    each = made.withColumn("id_sum", total).join(of, "text_row").join(i.select("row_id", "user_id", "item_id"), "row_id")
    good = (F.col("label") == 0) & (F.col("_u") == F.col("user_id")) & (F.col("_i") != F.col("item_id"))
    same = F.when(F.min("id_sum") == F.max("id_sum"), F.max("id_sum"))
    return each.groupBy("row_id").agg(F.count("*").cast("int").alias("samples"), F.max(good).alias("other_item"), same.alias("id_sum"))


@query("""WITH p AS (SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id), r AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' AND value > 80 GROUP BY user_id)
 SELECT count(*) AS num_examples, round(count(*) / greatest((SELECT count(*) FROM p), (SELECT count(*) FROM r)), 6) AS common_ratio, CAST(sum(p.n) AS BIGINT) AS precision_total_statements, CAST(sum(r.n) AS BIGINT) AS recall_total_statements FROM p JOIN r USING (user_id)""")
def label_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("index"), "event_type", "value", (F.col("value") > 35).cast("int").alias("label"))
    return rounded(factuality.report(e.filter("event_type in ('click', 'purchase')"), e.filter("event_type = 'signup' and value > 80")))


@query("""WITH x AS (SELECT DISTINCT l_orderkey AS row_id, l_partkey AS p, p_type, p_size % 3 AS s FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT a.row_id, a.p AS ref_p, b.p AS pred_p FROM x a JOIN x b ON a.row_id = b.row_id AND a.p_type = b.p_type AND a.s = b.s""")
def matched_pairs(spark, sf_dir):
    """Pairs of a row's statements of equal topic and sentiment."""
    t = triplets(spark, sf_dir).select("row_id", "topic", "sentiment", F.col("pos").alias("p"))
    return pairs.bipartite(t, t, "row_id", ("topic", "sentiment")).select("row_id", "ref_p", "pred_p")


# --- generation and scoring -----------------------------------------------------------------


@query(f"WITH {OUTPUTS} SELECT row_id, coalesce(reference, '') AS reference, coalesce(prediction, '') AS prediction FROM o WHERE row_id % 2 = 0 UNION ALL SELECT row_id, '' AS reference, coalesce(prediction, '') AS prediction FROM o WHERE row_id % 2 = 1")
def prediction_scan(spark, sf_dir):
    place = S.new_scratch(spark, "predictions")
    S.write_csv(outputs(spark, sf_dir).withColumn("reference", F.when(F.col("row_id") % 2 == 0, F.col("reference"))), place)
    return S.read_predictions(spark, place)


def _load_echo():
    """A stand-in for a text generator: the prompt's last line, reversed words."""
    return lambda prompts: [" ".join(reversed(p.split("\n")[-1].split(" "))) for p in prompts]


@query(r"SELECT o_orderkey AS row_id, 'Say:' || chr(10) || o_orderpriority || ' ' || o_custkey AS prompt, o_custkey || ' ' || array_to_string(list_reverse(string_split(o_orderpriority, ' ')), ' ') AS output FROM orders")
def generated_texts(spark, sf_dir):
    """Prompts from JSON lines; a first run writes the even rows, a second one goes on with the others."""
    place, out = S.new_scratch(spark, "prompts"), S.new_scratch(spark, "generations")
    o = table(spark, sf_dir, "orders")
    S.append_json(o.select(F.col("o_orderkey").alias("row_id"), F.concat(F.lit("Say:\n"), "o_orderpriority", F.lit(" "), "o_custkey").alias("prompt")), place)
    prompts = S.read_prompts(spark, place)
    generate = lambda df: scorers.generate(df, F.col("prompt"), _load_echo)
    S.append_generations(prompts.filter("row_id % 2 = 0"), out, generate)
    return S.append_generations(prompts, out, generate)


def _load_verifier():
    """A stand-in for a verifying model: 1 if the document has every word of the statement."""

    def verify(prompts):
        out = []
        for p in prompts:
            document, rest = p.split("\nStatement: ")
            out.append(" 1\n" if set(rest.split("\nTopic: ")[0].split()) <= set(document.removeprefix("Document: ").split()) else "0")
        return out

    return verify


@query(f"""WITH {TRIPLETS} SELECT row_id, pos, CAST(list_has_all({word_list("'a ' || o_comment")}, {word_list('statement')}) AS INT) AS label FROM t JOIN (SELECT o_orderkey, o_orderpriority || ' ' || (SELECT string_agg(p_name, ' ' ORDER BY p_partkey) FROM part WHERE p_partkey <= 20) AS o_comment FROM orders) ON o_orderkey = row_id""")
def verified_statements(spark, sf_dir):
    names = table(spark, sf_dir, "part").filter("p_partkey <= 20").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), " ").alias("names"))
    documents = table(spark, sf_dir, "orders").crossJoin(F.broadcast(names)).select(F.col("o_orderkey").alias("row_id"), F.concat_ws(" ", F.lit("a"), "o_orderpriority", "names").alias("document"))
    asked = pairs.documents_of(triplets(spark, sf_dir), documents)
    prompt = F.get(T.verification_prompt("", F.col("document"), F.col("statement"), F.col("topic"), F.col("sentiment")), 1)["content"]
    return scorers.verified(scorers.generate(asked.select("row_id", "pos", prompt.alias("p")), F.col("p"), _load_verifier)).select("row_id", "pos", "label")


def _load_lengths():
    """A stand-in for an embedder: length, words, and share of letters a."""
    return lambda texts: [[float(len(t)), float(len(t.split(" "))), t.count("a") / len(t) if t else 0.0] for t in texts]


@query("SELECT c_custkey, CAST(length(c_name || ' ' || c_mktsegment) AS DOUBLE) AS length, CAST(len(string_split(c_name || ' ' || c_mktsegment, ' ')) AS DOUBLE) AS words FROM customer")
def embedded_texts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    return scorers.embed(c, "text", _load_lengths).select("c_custkey", F.get("vector", 0).cast("double").alias("length"), F.get("vector", 1).cast("double").alias("words"))


def _load_variety():
    """A stand-in for a scorer of single texts: distinct words over words."""
    return lambda texts: [len(set(w)) / len(w) if (w := t.split()) else 0.0 for t in texts]


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\v\f]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END, 6) AS score,
 CAST(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END > 0.6 AS INT) AS varied FROM w""")
def document_scores(spark, sf_dir):
    """A score of each whole document, and whether it is over a threshold."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scorers.score_texts(d, "text", _load_variety)
    return scored.select("doc_id", r6("score").alias("score"), ranking.over_threshold(F.col("score"), 0.6).alias("varied"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS place, c_name AS text FROM customer QUALIFY place < 100")
def text_lines(spark, sf_dir):
    """The first hundred lines of a file; the limit is the reader's."""
    place = S.new_scratch(spark, "lines")
    table(spark, sf_dir, "customer").coalesce(1).sortWithinPartitions("c_custkey").select("c_name").write.text(place)
    return S.read_lines(spark, place, 100).select(F.col("row_id").alias("place"), "text")


@query("SELECT round(count(DISTINCT text) / count(*), 6) AS unique_text_ratio FROM conversations WHERE text <> ''")
def csv_corpus(spark, sf_dir):
    """A column of CSV files, by its name, whole; texts have quotes, commas and line ends."""
    place = S.new_scratch(spark, "corpus")
    S.write_csv(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), place)
    return rounded(M.unique_text_ratio(S.read_corpus(spark, place, "text"), "text"))


@query("SELECT c_custkey, 'About ' || c_name || ' of ' || c_mktsegment || '.' AS prompt FROM customer")
def template_prompts(spark, sf_dir):
    place = S.new_scratch(spark, "template")
    spark.createDataFrame([("\n About {name} of {segment}.\n",)], "value string").write.text(place)
    parts = S.read_template(spark, place).replace("{name}", "\0name\0").replace("{segment}", "\0segment\0").split("\0")
    known = {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(*[known.get(p, F.lit(p)) for p in parts]).alias("prompt"))


# --- retrieval and inputs -------------------------------------------------------------------


@query(f"WITH {INTERACTIONS} SELECT p_partkey AS item_id, p_name AS title FROM part WHERE p_size % 5 <> 0 AND p_partkey IN (SELECT item_id FROM i WHERE rating > 30)")
def titled_train_items(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("title"))
    return retrieval.titled_train_items(p, interactions(spark, sf_dir).filter("rating > 30"))


@query(f"WITH {OUTPUTS} SELECT row_id, array_to_string(list_filter(list_transform(string_split(prediction, ','), lambda t: trim(t, ' ')), lambda t: list_contains({word_list('reference')}, t)), '|') AS topics FROM o")
def supported_topics(spark, sf_dir):
    found = retrieval.supported_terms(F.split("prediction", ","), F.array("reference"))
    return outputs(spark, sf_dir).select("row_id", F.array_join(found, "|").alias("topics"))


@query("SELECT o_orderkey AS row_id, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50")
def head_of_samples(spark, sf_dir):
    return sampling.head(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey"), 50)


@query("""WITH s AS (SELECT o_orderkey AS row_id, CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'eval' ELSE 'test' END AS split, o_custkey % 100 / 100 AS score FROM orders)
 SELECT row_id, split, row_number() OVER (PARTITION BY split ORDER BY CASE WHEN split = 'test' THEN 0 ELSE score END, row_id) - 1 AS place FROM s""")
def reranked_samples(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    split = F.element_at(F.array(*map(F.lit, ("train", "eval", "test"))), (F.col("o_orderkey") % 3).cast("int") + 1)
    s = o.select(F.col("o_orderkey").alias("row_id"), split.alias("split"), (F.col("o_custkey") % 100 / 100).alias("similarity_score"))
    return retrieval.reranked(s).select("row_id", "split", "place")


@query("""SELECT o_orderkey AS row_id, '<s>[INST] <<SYS>>Explain.<</SYS>>user record: <USER_EMBED> parts record: <ITEM_EMBED> parts name: ' || coalesce(CASE WHEN p_size % 2 = 0 THEN p_name END, 'parts') || ' user profile: '
 || coalesce(c_mktsegment, '') || ' parts profile: ' || coalesce(p_type, p_name) || ' <EXPLAIN_POS>[/INST]' AS prompt, x.embedding[1] AS user_first, y.embedding[1] AS item_first
 FROM (SELECT o_orderkey, o_custkey, o_orderkey % 150 + 1 AS item FROM orders) LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = item LEFT JOIN embeddings x ON x.vec_id = o_custkey LEFT JOIN embeddings y ON y.vec_id = item""")
def model_inputs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 150 + 1).alias("item_id"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("profile"))
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("title"), F.col("p_type").alias("profile"), F.col("p_name").alias("description"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    made = retrieval.model_inputs(o, users, items, "parts", "Explain.", v, v)
    return made.select("row_id", "prompt", F.get("user_vector", 0).alias("user_first"), F.get("item_vector", 0).alias("item_first"))


@query("SELECT n_nationkey AS k, 'q' || chr(10) || 'Paths:' || chr(10) || '1. ' || n_name || chr(10) || '### Explanation:' AS prompt FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'q' || chr(10) || 'Paths:' || chr(10) || '1. ' || n_name || chr(10) || 'Neighbours:' || chr(10) || '1. a' || chr(10) || '2. b' || chr(10) || '### Explanation:' FROM nation WHERE n_nationkey % 2 = 1")
def path_prompts(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    near = F.when(F.col("n_nationkey") % 2 == 1, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array().cast("array<string>"))
    return n.select(F.col("n_nationkey").alias("k"), T.path_prompt(F.lit("q"), F.array("n_name"), near, 2).alias("prompt"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 1 THEN 'zero' WHEN o_custkey % 3 = 0 THEN 'zero zero two' ELSE 'zero two two' END AS text FROM orders")
def words_of_ids(spark, sf_dir):
    k = (F.col("o_custkey") % 3).cast("bigint")
    ids = F.array(F.lit(0).cast("bigint"), k, F.lit(2).cast("bigint"), F.lit(1).cast("bigint"), F.lit(0).cast("bigint"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.words_of_ids(ids, F.array(*map(F.lit, ("zero", "<eos>", "two"))), 1), " ").alias("text"))


@query(f"""WITH {OUTPUTS}, v AS (SELECT word, count(*) AS freq, min(struct_pack(k := row_id, p := pos)) AS first FROM (SELECT row_id, unnest({word_list('reference')}) AS word, generate_subscripts({word_list('reference')}, 1) AS pos FROM o) GROUP BY word ORDER BY freq DESC, first LIMIT 200)
 SELECT row_id, array_to_string(list_transform(w, lambda x: CASE WHEN list_contains(known, x) THEN x ELSE '<unk>' END), ' ') AS text FROM (SELECT row_id, {word_list('prediction')} AS w FROM o), (SELECT list(word) AS known FROM v) WHERE len(w) > 0""")
def decoded_tokens(spark, sf_dir):
    """Texts as ids of a vocabulary of other texts, ended and padded, and back; words it lacks are marked."""
    o = outputs(spark, sf_dir)
    v = M.word_vocabulary(o, "reference", "row_id", 200)
    end = F.array(*[F.lit(M.RESERVED.index(m)).cast("bigint") for m in ("<eos>", "<pad>", "<pad>")])
    ids = M.token_ids(o, v, "prediction", "row_id").withColumn("ids", F.concat("ids", end))
    return M.words_of_ids(ids, v, "ids", "row_id").select("row_id", F.array_join("words", " ").alias("text"))


@query(f"""WITH {INTERACTIONS}, {_ASKED}, h AS (SELECT t.row_id, 0 AS k, h.row_id AS x FROM t JOIN i h ON h.user_id = t.user_id AND h.item_id <> t.item_id
 UNION ALL SELECT t.row_id, 1 AS k, h.row_id AS x FROM t JOIN i h ON h.item_id = t.item_id AND h.user_id <> t.user_id), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY k, x) AS n FROM h)
 SELECT row_id, CAST(sum(x) AS BIGINT) AS id_sum FROM r WHERE n <= 16 GROUP BY row_id""")
def samples_with_history(spark, sf_dir):
    """The positive samples of the queries, with the first 16 rows of their histories."""
    every, asked = _asked(spark, sf_dir)
    samples = sampling.with_history(asked.select("row_id", "user_id", "item_id"), retrieval.first_histories(every, asked, 16), 16)
    total = F.aggregate(F.filter("history_ids", lambda x: x >= 0), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return samples.select("row_id", total.alias("id_sum"))


@query(f"WITH {INTERACTIONS}, n AS (SELECT DISTINCT user_id AS id, 'user' AS ntype FROM i UNION SELECT DISTINCT item_id + 100000, 'item' FROM i) SELECT id, ntype, round(embedding[1], 5) AS first FROM n LEFT JOIN embeddings ON vec_id = id % 100000 AND ntype = 'item'")
def featured_nodes(spark, sf_dir):
    e = _edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("id"), F.lit("user").alias("ntype")).unionByName(e.select(F.col("dst").alias("id"), F.lit("item").alias("ntype"))).distinct()
    feats = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 100000).alias("id"), F.col("embedding").alias("feat"))
    return graph.with_features(nodes, feats).select("id", "ntype", F.round(F.get("feat", 0), 5).alias("first"))


# --- text metrics ---------------------------------------------------------------------------


@query(f"WITH {OUTPUTS}, w AS (SELECT {word_list('prediction')} AS w FROM o), g AS (SELECT len(w) AS n, CASE WHEN len(w) > 1 THEN len(list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || chr(1) || w[k + 1]))) ELSE 0 END AS d FROM w) SELECT round(avg(CASE WHEN n > 0 THEN d / n ELSE 0 END), 6) AS \"distinct\" FROM g")
def mean_distinct_bigrams(spark, sf_dir):
    return rounded(M.mean_distinct(outputs(spark, sf_dir), "prediction", 2))


@query()
def rouge_lcs_summary(spark, sf_dir):
    o = outputs(spark, sf_dir)
    cut = lambda c: F.regexp_replace(c, r"(?<=[.!?]) ", "\n")
    return o.select("row_id", r6(M.rouge_l_summary(cut("prediction"), cut("reference"))).alias("rouge_lsum"))
