"""Queries of splits, ids, statements, statistics and sources over events, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxonomy
from ..functions import text as T
from ..operators import ids, pairs, sampling, splits, statements, stats
from ..sources import tables as S
from .frames import INTERACTIONS, TRIPLETS, VOCABULARY, interactions, r6, rounded, row_parts, table, triplets, vocabulary

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_CUT = """n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", row_id) AS seat FROM i),
 c AS (SELECT *, floor(n * CAST(0.8 AS DOUBLE)) AS a0, floor(n * (CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE))) AS b0 FROM n WHERE n >= 5),
 d AS (SELECT *, CASE WHEN n = b0 THEN n - 2 ELSE a0 END AS a, CASE WHEN n = b0 THEN n - 1 ELSE b0 END AS b FROM c),
 sp AS (SELECT row_id, user_id, item_id, CASE WHEN seat <= a THEN 'train' WHEN seat <= b THEN 'eval' ELSE 'test' END AS split FROM d)"""


@query(f"WITH {INTERACTIONS}, {_CUT} SELECT row_id, user_id, item_id, split FROM sp WHERE split = 'train' OR item_id IN (SELECT item_id FROM sp WHERE split = 'train')")
def temporal_split(spark, sf_dir):
    s = splits.temporal_split(interactions(spark, sf_dir))
    return splits.without_cold_items(s.select("row_id", "user_id", "item_id", "split"))


@query(f"WITH {INTERACTIONS}, {_CUT} SELECT split, count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM sp GROUP BY split")
def split_sizes(spark, sf_dir):
    return splits.split_sizes(splits.temporal_split(interactions(spark, sf_dir)))


@query(f"WITH {INTERACTIONS} SELECT row_id, user_id FROM i WHERE user_id IN (SELECT user_id FROM i GROUP BY user_id HAVING count(*) >= 60)")
def active_users(spark, sf_dir):
    return splits.active_users(interactions(spark, sf_dir), 60).select("row_id", "user_id")


_FIRST = """f AS (SELECT user_id, row_number() OVER (ORDER BY min(struct_pack(t := "timestamp", r := row_id))) - 1 AS idx FROM i GROUP BY user_id)"""


@query(f"WITH {INTERACTIONS}, {_FIRST} SELECT user_id, idx FROM f")
def dense_user_ids(spark, sf_dir):
    return ids.dense_ids(interactions(spark, sf_dir), "user_id", ["timestamp", "row_id"])


@query(f"WITH {INTERACTIONS}, {_FIRST} SELECT row_id, idx, item_id FROM i JOIN f USING (user_id)")
def encoded_users(spark, sf_dir):
    i = interactions(spark, sf_dir)
    place = S.new_scratch(spark, "id-map")
    S.write_id_map(ids.dense_ids(i, "user_id", ["timestamp", "row_id"]), place)
    return ids.encoded(i, spark.read.parquet(place), "user_id").select("row_id", "idx", "item_id")


@query(f"""WITH {INTERACTIONS}, {_FIRST}, t AS (SELECT count(*) AS n FROM f) SELECT user_id, CASE WHEN idx < floor(n * CAST(0.1 AS DOUBLE)) THEN 'eval'
  WHEN idx < floor(n * CAST(0.1 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM f, t""")
def user_split(spark, sf_dir):
    u = ids.dense_ids(interactions(spark, sf_dir), "user_id", ["timestamp", "row_id"])
    return splits.user_split(u).select("user_id", "split")


@query(f"""WITH {INTERACTIONS}, c AS (SELECT user_id, count(*) AS n FROM i GROUP BY user_id), q AS (SELECT list_distinct([quantile_cont(n, 0.25), quantile_cont(n, 0.5), quantile_cont(n, 0.75)]) AS e, min(n) AS lo, max(n) AS hi FROM c),
 b AS (SELECT user_id, n, len(list_filter(e, lambda x: n > x AND x > lo AND x < hi)) AS bin FROM c, q),
 r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(user_id || '#42'), user_id) - 1 AS seat, count(*) OVER (PARTITION BY bin) AS m FROM b)
 SELECT user_id, n, bin, CASE WHEN seat < m - 2 * floor(m * CAST(0.1 AS DOUBLE)) THEN 'train' WHEN seat < m - floor(m * CAST(0.1 AS DOUBLE)) THEN 'eval' ELSE 'test' END AS split FROM r""")
def stratified_user_split(spark, sf_dir):
    s = splits.stratified_user_split(interactions(spark, sf_dir))
    place = S.new_scratch(spark, "users")
    S.write_user_lists(s, place)
    return spark.read.schema("user_id bigint, n bigint, bin int, split string").parquet(place).withColumn("bin", F.col("bin").cast("bigint"))


@query("""SELECT o_orderkey, CASE WHEN seat < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN seat < floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'eval' ELSE 'test' END AS split
 FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '#0'), o_orderkey) - 1 AS seat, count(*) OVER () AS n FROM orders)""")
def edge_split(spark, sf_dir):
    return splits.hash_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


_TOPICS = ["economy", "standard", "promo"]
_AUDIT = f"""a AS (SELECT CASE WHEN topic IN ('economy','standard','promo') AND sentiment IN ('positive','negative') THEN 'correct' WHEN sentiment IN ('positive','negative') THEN 'wrong_topic'
   WHEN topic IN ('economy','standard','promo') THEN 'wrong_sentiment' ELSE 'both_wrong' END AS class, topic, sentiment, statement, count(*) AS freq FROM (WITH {TRIPLETS} SELECT * FROM t) GROUP BY ALL)"""


def _audited(spark, sf_dir):
    return statements.audit(triplets(spark, sf_dir), _TOPICS, ["positive", "negative"])


@query(f"WITH {_AUDIT} SELECT class, topic, sentiment, statement, freq FROM a")
def triplet_audit(spark, sf_dir):
    return _audited(spark, sf_dir)


@query(f"""WITH {_AUDIT} SELECT topic, {', '.join(f"count(*) FILTER (sentiment = '{s}') AS {s}_unique, CAST(coalesce(sum(freq) FILTER (sentiment = '{s}'), 0) AS BIGINT) AS {s}_total" for s in ('positive', 'negative'))},
  count(*) FILTER (sentiment IN ('positive','negative')) AS "TOTAL_unique", CAST(coalesce(sum(freq) FILTER (sentiment IN ('positive','negative')), 0) AS BIGINT) AS "TOTAL_total" FROM a GROUP BY topic""")
def topic_table(spark, sf_dir):
    return statements.topic_table(_audited(spark, sf_dir), ["positive", "negative"])


@query(f"""WITH {_AUDIT} SELECT round(100.0 * sum(freq) FILTER (class = 'wrong_topic') / (sum(freq) FILTER (class IN ('wrong_topic', 'correct'))), 6) AS percent FROM a""")
def topic_error_share(spark, sf_dir):
    return rounded(statements.error_share(_audited(spark, sf_dir)))


_VOTES = """votes AS (SELECT lower(p_type) AS wrong_topic, labeler, CASE WHEN labeler = 2 AND count(*) % 3 = 0 THEN 'promo' WHEN labeler = 1 AND count(*) % 5 = 0 THEN NULL ELSE 'standard' END AS topic
  FROM part, range(0, 3) l(labeler) GROUP BY p_type, labeler)"""


@query(f"WITH {_VOTES} SELECT wrong_topic, min(topic) AS topic FROM votes GROUP BY wrong_topic HAVING count(topic) = 3 AND count(DISTINCT topic) = 1")
def unanimous_votes(spark, sf_dir):
    return statements.unanimous(_votes(spark, sf_dir))


def _votes(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n")).withColumn("labeler", F.explode(F.array(*map(F.lit, range(3)))))
    topic = F.when((F.col("labeler") == 2) & (F.col("n") % 3 == 0), "promo").when((F.col("labeler") == 1) & (F.col("n") % 5 == 0), None).otherwise("standard")
    return p.select(F.lower("p_type").alias("wrong_topic"), "labeler", topic.alias("topic"))


@query(f"""WITH {_AUDIT}, {_VOTES}, u AS (SELECT wrong_topic, min(topic) AS r FROM votes GROUP BY wrong_topic HAVING count(topic) = 3 AND count(DISTINCT topic) = 1)
 SELECT statement, coalesce(r, topic) AS topic, sentiment, CAST(sum(freq) AS BIGINT) AS freq FROM a LEFT JOIN u ON topic = wrong_topic GROUP BY ALL""")
def repaired_topics(spark, sf_dir):
    return statements.repaired(_audited(spark, sf_dir), statements.unanimous(_votes(spark, sf_dir)))


@query(f"WITH {_AUDIT} SELECT topic, CAST(sum(freq) AS BIGINT) AS freq FROM a GROUP BY topic HAVING sum(freq) >= 9000")
def frequent_topics(spark, sf_dir):
    return statements.frequent(_audited(spark, sf_dir), 9000)


@query(f"WITH {_AUDIT}, r AS (SELECT *, row_number() OVER (PARTITION BY topic, sentiment ORDER BY freq, statement) AS rank FROM a) SELECT topic, sentiment, statement, freq, rank FROM r WHERE rank <= 4")
def rare_statements(spark, sf_dir):
    return statements.rare_examples(_audited(spark, sf_dir)).select("topic", "sentiment", "statement", "freq", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {TRIPLETS} SELECT statement, topic, sentiment, count(*) AS freq, row_number() OVER (ORDER BY min(struct_pack(r := row_id, p := pos))) - 1 AS sid FROM t GROUP BY statement, topic, sentiment")
def statement_vocabulary(spark, sf_dir):
    return statements.vocabulary(triplets(spark, sf_dir))


@query(f"""WITH {TRIPLETS}, w AS (SELECT statement, topic, sentiment, row_number() OVER (ORDER BY min(struct_pack(r := row_id, p := pos))) - 1 AS sid FROM t GROUP BY statement, topic, sentiment),
 k AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS tid FROM (SELECT DISTINCT lower(p_type) AS topic FROM part))
 SELECT row_id, array_to_string(list(sid ORDER BY pos), ',') AS statement_ids, array_to_string(list(tid ORDER BY pos), ',') AS topic_ids,
  array_to_string(list(CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END ORDER BY pos), ',') AS sentiments FROM t JOIN w USING (statement, topic, sentiment) JOIN k USING (topic) GROUP BY row_id""")
def statement_id_lists(spark, sf_dir):
    t = triplets(spark, sf_dir)
    topic = table(spark, sf_dir, "part").select(F.lower("p_type").alias("topic")).distinct()
    names = tuple(r[0] for r in topic.collect())  # a taxonomy: a handful of names
    found = statements.with_ids(t, statements.vocabulary(t), taxonomy.topics(spark, {"parts": names}), parts=row_parts(spark, sf_dir))
    return found.select("row_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("statement_ids", "topic_ids", "sentiments")])


@query(f"""WITH {TRIPLETS}, d AS (SELECT row_id, sentiment, 'this is ' || statement AS c, min(pos) AS pos FROM t GROUP BY ALL),
 g AS (SELECT row_id, sentiment, list(c ORDER BY pos) AS l FROM d GROUP BY ALL), j AS (SELECT row_id, sentiment, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1 : len(l) - 1], ', ') || ', and ' || l[len(l)] END AS x FROM g),
 w AS (SELECT row_id, max(x) FILTER (sentiment = 'positive') AS p, max(x) FILTER (sentiment = 'negative') AS n, max(x) FILTER (sentiment = 'neutral') AS u FROM j GROUP BY row_id)
 SELECT row_id, concat_ws(' ', 'The user would appreciate this product because ' || p || '.', CASE WHEN p IS NULL THEN 'The user may dislike that ' ELSE 'However, they may dislike that ' END || n || '.',
  CASE WHEN p IS NULL AND n IS NULL THEN 'The user seems indifferent to ' ELSE 'They seem indifferent to ' END || u || '.') AS explanation FROM w""")
def explanations(spark, sf_dir):
    v = vocabulary(spark, sf_dir).withColumn("statement", F.concat(F.lit(" This is "), "statement", F.lit(". ")))
    v = v.withColumn("statement", F.replace("statement", F.lit("This"), F.lit("this")))
    t = triplets(spark, sf_dir).groupBy("row_id").agg(F.array_sort(F.collect_list("pos")).alias("statement_ids"))
    return statements.explanations(t, v, sentiments=None, parts=row_parts(spark, sf_dir))


@query(f"SELECT round(avg(length(statement)), 6) AS avg_length, max(length(statement)) AS max_length, min(length(statement)) AS min_length, round(median(length(statement)), 6) AS median_length FROM (WITH {VOCABULARY} SELECT * FROM v)")
def statement_lengths(spark, sf_dir):
    s = rounded(statements.length_summary(vocabulary(spark, sf_dir)))
    return s.withColumns({c: F.col(c).cast("bigint") for c in ("max_length", "min_length")})


@query("SELECT count(*) FILTER (json_extract(props, '$.k') IS NULL) AS failures, round(CAST(count(*) FILTER (json_extract(props, '$.k') IS NULL) AS DOUBLE) / count(*), 6) AS rate FROM events")
def extraction_failures(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("statements", F.get_json_object("props", "$.k"))
    return rounded(statements.extraction_failures(e))


def _summary_sql(x: str, p: str = "") -> str:
    return f"round(avg({x}), 6) AS {p}avg, max({x}) AS {p}max, min({x}) AS {p}min, round(median({x}), 6) AS {p}median, round(stddev_samp({x}), 6) AS {p}std"


@query(f"WITH {TRIPLETS}, c AS (SELECT row_id, count(DISTINCT statement) AS n FROM t GROUP BY row_id) SELECT {_summary_sql('n')} FROM c")
def statements_per_row(spark, sf_dir):
    return rounded(stats.count_stats(triplets(spark, sf_dir), ["row_id"], "statement"))


_GRID = " UNION ALL ".join(
    f"SELECT '{name}' AS facet, {value} AS value, count(*) AS entities, {_summary_sql('u', 'unique_')}, {_summary_sql('c', 'total_')} FROM (SELECT {sel} count(DISTINCT statement) AS u, count(statement) AS c FROM t GROUP BY row_id{grp}) GROUP BY value"
    for name, value, sel, grp in (("all", "''", "", ""), ("sentiment", "sentiment", "sentiment,", ", sentiment"), ("topic", "topic", "topic,", ", topic"))
).replace("GROUP BY value UNION", "GROUP BY ALL UNION")


@query(f"WITH {TRIPLETS} {_GRID.replace('GROUP BY value', 'GROUP BY ALL')}")
def statistics_grid(spark, sf_dir):
    return rounded(stats.grid(triplets(spark, sf_dir), "row_id"))


def _grid_of(entity: str) -> str:
    grid = _GRID.replace("GROUP BY value", "GROUP BY ALL").replace("GROUP BY row_id", "GROUP BY entity")
    return f"WITH {TRIPLETS.replace('t AS', 'b AS', 1)}, t AS (SELECT b.*, {entity} AS entity FROM b JOIN orders ON o_orderkey = row_id) {grid}"


def _with_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return triplets(spark, sf_dir).join(o, F.col("row_id") == F.col("o_orderkey"))


@query(_grid_of("o_custkey"))
def user_statistics(spark, sf_dir):
    return rounded(stats.grid(_with_order(spark, sf_dir), "o_custkey"))


@query(_grid_of("o_orderpriority || year(o_orderdate)"))
def item_statistics(spark, sf_dir):
    """Priority and year stand for an item."""
    named = _with_order(spark, sf_dir).withColumn("item", F.concat("o_orderpriority", F.year("o_orderdate").cast("string")))
    return rounded(stats.grid(named, "item"))


@query(f"WITH {TRIPLETS} SELECT count(*) AS rows, count(DISTINCT row_id) AS n_row_id, count(DISTINCT statement) AS n_statement, count(DISTINCT topic) AS n_topic FROM t")
def dataset_totals(spark, sf_dir):
    return stats.totals(triplets(spark, sf_dir), ["row_id", "statement", "topic"])


@query(f"""WITH {TRIPLETS}, a AS (SELECT count(*) AS t, count(DISTINCT statement) AS u FROM t) SELECT sentiment, count(*) AS total, count(DISTINCT statement) AS unique, round(100.0 * count(*) / max(a.t), 6) AS total_percent,
 round(100.0 * count(DISTINCT statement) / max(a.u), 6) AS unique_percent FROM t, a GROUP BY sentiment""")
def sentiment_distribution(spark, sf_dir):
    return rounded(stats.distribution(triplets(spark, sf_dir), "sentiment"))


@query(f"WITH {TRIPLETS} SELECT coalesce(sentiment, 'All') AS sentiment, coalesce(topic, 'All') AS topic, count(*) AS total, count(DISTINCT statement) AS unique FROM t GROUP BY CUBE (sentiment, topic)")
def cross_matrix(spark, sf_dir):
    return stats.cross_matrix(triplets(spark, sf_dir), "sentiment", "topic")


@query(f"WITH {TRIPLETS}, c AS (SELECT row_id, count(DISTINCT topic) AS a, count(DISTINCT sentiment) AS b FROM t GROUP BY row_id) SELECT {_summary_sql('a', 'topic_')}, {_summary_sql('b', 'sentiment_')} FROM c")
def row_diversity(spark, sf_dir):
    return rounded(stats.diversity(triplets(spark, sf_dir), "row_id"))


@query(f"WITH {TRIPLETS} SELECT row_id, count(statement) AS n FROM t GROUP BY row_id ORDER BY n DESC, row_id LIMIT 5")
def largest_rows(spark, sf_dir):
    return stats.largest(triplets(spark, sf_dir), "row_id")


@query(f"WITH {TRIPLETS} SELECT statement, count(*) AS freq, CASE WHEN length(statement) > 8 THEN substr(statement, 1, 8) || '...' ELSE statement END AS label FROM t GROUP BY statement ORDER BY freq DESC, statement LIMIT 10")
def top_statements(spark, sf_dir):
    return stats.top_labels(triplets(spark, sf_dir), width=8)


@query(f"""WITH {TRIPLETS}, s AS (SELECT p_partkey AS item_id, list_distinct([p_partkey, p_partkey % 7, p_partkey % 11]) AS l FROM part), e AS (SELECT item_id, unnest(l) AS sid FROM s)
 SELECT item_id, count(*) AS n, CAST(sum(length(p_name)) AS BIGINT) AS chars FROM e JOIN part ON sid = p_partkey GROUP BY item_id""")
def item_documents(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    said = p.select(F.col("p_partkey").alias("item_id"), F.explode(F.array("p_partkey", F.col("p_partkey") % 7, F.col("p_partkey") % 11)).alias("sid"))
    said = said.join(p.select(F.col("p_partkey").alias("sid"), F.col("p_name").alias("statement")), "sid")
    docs = pairs.item_documents(p.select(F.col("p_partkey").alias("item_id"), F.lit("").alias("title"), F.lit(None).cast("string").alias("description")), said)
    n = F.size(F.split("document", r"\. "))
    return docs.select("item_id", n.cast("bigint").alias("n"), (F.char_length("document") - 2 * (n - 1)).cast("bigint").alias("chars"))


@query("SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY md5(p_partkey || '#0'), p_partkey) AS r FROM part) WHERE r <= 50")
def capped_sources(spark, sf_dir):
    return sampling.capped(table(spark, sf_dir, "part"), "p_type", 50, "p_partkey").select("p_type", "p_partkey")


@query("SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part) WHERE r <= 50")
def first_of_sources(spark, sf_dir):
    return sampling.first_of_source(table(spark, sf_dir, "part"), "p_type", 50, "p_partkey").select("p_type", "p_partkey")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark, sf_dir):
    place = S.new_scratch(spark, "csv")
    S.write_csv(table(spark, sf_dir, "supplier"), place)
    return S.read_csv(spark, place, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


@query(f"WITH {VOCABULARY} SELECT sid, statement, topic, sentiment FROM v")
def statement_scan(spark, sf_dir):
    place = S.new_scratch(spark, "statements")
    v = vocabulary(spark, sf_dir)
    S.write_csv(v.select(F.col("sid").alias(""), "statement", F.concat(F.lit(" "), F.upper("topic")).alias("topic"), F.initcap("sentiment").alias("sentiment"), F.lit(1).alias("frequency")), place)
    return S.read_statements(spark, place)


@query("SELECT 'c' || c_custkey AS asin, c_name AS title, c_mktsegment || ' ''x' AS description FROM customer")
def metadata_scan(spark, sf_dir):
    place = S.new_scratch(spark, "metadata")
    c = table(spark, sf_dir, "customer")
    c.select(F.concat(F.lit("{'asin': 'c"), F.col("c_custkey").cast("string"), F.lit("', 'title': '"), "c_name", F.lit("', 'description': \""), "c_mktsegment", F.lit(" 'x\"}"))).write.text(place)
    return S.read_metadata(spark, place)


@query("SELECT o_orderkey AS row_id FROM orders WHERE o_orderkey % 3 <> 0")
def unprocessed_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    return S.unprocessed(o, o.filter("row_id % 3 = 0"))


@query("SELECT o_custkey AS user_id, l_partkey AS item_id, count(*) AS n, round(avg(l_quantity), 6) AS rating FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def order_interactions(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(F.count("*").alias("n"), r6(F.avg("l_quantity")).alias("rating"))


@query()
def negative_items(spark, sf_dir):
    i = interactions(spark, sf_dir)
    return sampling.negative_items(i, i.select("item_id"))


@query()
def negative_edges(spark, sf_dir):
    i = interactions(spark, sf_dir)
    return sampling.negative_edges(i, i.select("user_id"), i.select("item_id"))


@query()
def other_reviews(spark, sf_dir):
    return sampling.with_other_review(interactions(spark, sf_dir))


@query("SELECT conv_id, turn, 'Review: ' || text || chr(10) || 'Output:' AS content FROM conversations WHERE len(string_split_regex(trim(text), '\\s+')) <= 100000")
def extraction_prompts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.get(T.extraction_prompt("Extract.", F.col("text"), 100000), 1)["content"].alias("content"))
