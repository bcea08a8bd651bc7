"""Registered queries of retrieval, filters, pages and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import latin_tokens
from tessera.operators import filters, page, planner, retrieve
from tessera.plans.request import SearchRequest
from tessera.plans.search import Catalogue
from tessera.plans.search import search as run_search
from tessera.registry import query
from tessera.sources.readers import table as T

AS_OF = "1996-06-01 00:00:00"

# ---- shared SQL ----------------------------------------------------------------------------------------------------

_TOKENS = r"[x FOR x IN string_split(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}]+', ' ', 'g'), ' ') IF x <> '']"


def _tokens(c: str) -> str:
    return _TOKENS.format(c=c)


def _bm25_sql(source: str, key: str, text: str, words: list[str], name: str = "s") -> str:
    """CTEs up to ``name``(key, token, score) for the words over source."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""{name}_t AS (SELECT {key}, {_tokens(text)} AS toks FROM {source}),
{name}_l AS (SELECT {key}, unnest(toks) AS token, len(toks) AS dl FROM {name}_t),
{name}_p AS (SELECT {key}, token, count(*) AS tf, max(dl) AS dl FROM {name}_l WHERE token IN ({listed}) GROUP BY {key}, token),
{name}_d AS (SELECT token, count(*) AS df FROM {name}_p GROUP BY token),
{name}_n AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM {name}_t WHERE len(toks) > 0),
{name} AS (SELECT {key}, p.token, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score
  FROM {name}_p p JOIN {name}_d d USING (token) CROSS JOIN {name}_n)"""


def _clauses(spark: SparkSession, rows: list[tuple[str, float, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "token string, weight double, clause string")


# ---- retrieval -----------------------------------------------------------------------------------------------------

_SEARCH = ["the", "tion", "anin", "ing"]


@query(f"WITH {_bm25_sql('documents', 'doc_id', 'text', _SEARCH)} SELECT doc_id, round(sum(score), 6) AS score FROM s GROUP BY doc_id HAVING sum(score) >= 1.1 ORDER BY round(sum(score), 6) DESC, doc_id LIMIT 10")
def search_bm25_docs(spark, d):
    docs = T(spark, d, "documents")
    scores = retrieve.token_scores(docs, ["doc_id"], "text", _SEARCH)
    hits = retrieve.boolean_scores(scores, ["doc_id"], _clauses(spark, [(w, 1.0, "should") for w in _SEARCH]), 0, 1)
    return page.page(hits.withColumn("score", F.round("score", 6)), page.relevance(), size=10)


_MUST = ["inin", "onth", "erha", "eder", "thon"]
_W = "CASE token WHEN 'inin' THEN 3.0 WHEN 'onth' THEN 1.0 WHEN 'erha' THEN 1.5 WHEN 'thon' THEN 2.0 ELSE 0.5 END"


@query(f"""WITH {_bm25_sql('documents', 'doc_id', 'text', _MUST)} SELECT doc_id, round(sum(CASE WHEN token = 'eder' THEN 0 ELSE score * {_W} END), 6) AS score FROM s GROUP BY doc_id
HAVING count(*) FILTER (token = 'thon') >= 1 AND count(*) FILTER (token IN ('inin', 'onth', 'erha')) >= 1 AND count(*) FILTER (token = 'eder') = 0 AND sum(CASE WHEN token = 'eder' THEN 0 ELSE score * {_W} END) >= 1.1""")
def search_must_should(spark, d):
    scores = retrieve.token_scores(T(spark, d, "documents"), ["doc_id"], "text", _MUST)
    clauses = _clauses(spark, [("thon", 2.0, "must"), ("inin", 3.0, "should"), ("onth", 1.0, "should"), ("erha", 1.5, "should"), ("eder", 1.0, "must_not")])
    return retrieve.boolean_scores(scores, ["doc_id"], clauses, 1, 1).withColumn("score", F.round("score", 6))


@query(f"WITH {_bm25_sql('documents', 'doc_id', 'text', ['the', 'tion', 'and'])} SELECT doc_id, round(sum(score) * 7.5, 6) AS score FROM s GROUP BY doc_id HAVING count(DISTINCT token) = 3")
def search_full_query_and(spark, d):
    words = ["the", "tion", "and"]
    scores = retrieve.token_scores(T(spark, d, "documents"), ["doc_id"], "text", words)
    return retrieve.all_tokens_scores(scores, ["doc_id"], len(words), 7.5).withColumn("score", F.round("score", 6))


@query(f"WITH {_bm25_sql('documents', 'doc_id', 'text', ['the', 'of'])} SELECT doc_id, round(sum(score), 6) AS score FROM s GROUP BY doc_id HAVING sum(score) >= 0.3 ORDER BY round(sum(score), 6) DESC, doc_id LIMIT 10 OFFSET 23")
def search_min_score_page2(spark, d):
    scores = retrieve.token_scores(T(spark, d, "documents"), ["doc_id"], "text", ["the", "of"])
    hits = retrieve.boolean_scores(scores, ["doc_id"], _clauses(spark, [("the", 1.0, "should"), ("of", 1.0, "should")]), 0, 1, 0.3)
    return page.page(hits.withColumn("score", F.round("score", 6)), page.relevance(), number=2, size=10, offset=3)


_PART = ["red", "widget", "small", "blue", "hot", "gear", "economy"]


@query(f"""WITH {_bm25_sql('part', 'p_partkey', 'p_name', _PART, 'a')}, {_bm25_sql('part', 'p_partkey', 'p_type', _PART, 'b')},
u AS (SELECT p_partkey, token, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT p_partkey, round(sum(score) * 170, 5) AS score FROM u GROUP BY p_partkey HAVING sum(score) * 170 >= 1.1""")
def search_multi_field_weights(spark, d):
    scores = retrieve.multi_field_scores(T(spark, d, "part"), ["p_partkey"], ["p_name", "p_type"], _PART)
    clauses = _clauses(spark, [(w, retrieve.COURSE_WEIGHTS["title"], "should") for w in _PART])
    return retrieve.boolean_scores(scores, ["p_partkey"], clauses, 0, 1).withColumn("score", F.round("score", 5))


@query(rf"""WITH q AS (SELECT item_id AS query_id, unnest(list_slice(list_sort(list_distinct({_tokens('text')})), 1, 3)) AS token FROM benchmark),
t AS (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents), p AS (SELECT DISTINCT doc_id, token FROM t),
h AS (SELECT query_id, doc_id, count(*) AS n FROM q JOIN p USING (token) GROUP BY ALL),
strict AS (SELECT query_id, doc_id, n FROM h WHERE n >= 3),
r AS (SELECT query_id, doc_id, n FROM h WHERE query_id NOT IN (SELECT query_id FROM strict))
SELECT query_id, doc_id, n, false AS fallback FROM strict UNION ALL SELECT query_id, doc_id, n, true FROM r""")
def search_fallback_relaxed(spark, d):
    words = F.slice(F.array_sort(F.array_distinct(latin_tokens(F.col("text")))), 1, 3)
    asked = T(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(words).alias("token"))
    post = T(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(latin_tokens(F.col("text")))).alias("token"))
    hits = asked.join(post, "token").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    return retrieve.with_fallback(hits.where("n >= 3"), hits)


@query(f"""WITH {_bm25_sql('documents', 'doc_id', 'text', ['the', 'tion'], 'a')}, {_bm25_sql('(SELECT conv_id * 1000 + turn AS id, text FROM conversations)', 'id', 'text', ['the', 'tion'], 'b')}, {_bm25_sql('part', 'p_partkey', 'p_name', ['the', 'tion', 'red'], 'c')},
h AS (SELECT 'knowledge' AS item_type, doc_id AS id, sum(score) * 85 AS score FROM a GROUP BY doc_id UNION ALL SELECT 'live', id, sum(score) * 200 FROM b GROUP BY id UNION ALL SELECT 'course', p_partkey, sum(score) * 170 FROM c GROUP BY p_partkey),
k AS (SELECT item_type, count(*) AS total FROM h WHERE score >= 1.1 GROUP BY item_type) SELECT * FROM k UNION ALL SELECT 'all', sum(total)::BIGINT FROM k""")
def search_mixed_totals(spark, d):
    sources = {"knowledge": (T(spark, d, "documents"), "doc_id", "text", ["the", "tion"], 85.0), "live": (T(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "id", "text", ["the", "tion"], 200.0), "course": (T(spark, d, "part"), "p_partkey", "p_name", ["the", "tion", "red"], 170.0)}
    parts = {}
    for kind, (rows, key, text, words, share) in sources.items():
        scores = retrieve.token_scores(rows, [key], text, words)
        parts[kind] = scores.groupBy(F.col(key).alias("id")).agg((F.sum("score") * share).alias("score"))
    return page.totals(retrieve.mixed(parts, "id"))


@query(f"""WITH {_bm25_sql('(SELECT conv_id * 1000 + turn AS id, conv_id, text FROM conversations)', 'conv_id, id', 'text', ['the', 'heon', 'ing'])} SELECT conv_id, round(sum(score), 6) AS score FROM s GROUP BY conv_id""")
def search_has_child_sum(spark, d):
    rows = T(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    scores = retrieve.token_scores(rows, ["conv_id", "id"], "text", ["the", "heon", "ing"])
    return retrieve.has_child(scores, "conv_id").withColumn("score", F.round("score", 6))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 45 AND p_brand = (SELECT min(p_brand) FROM part))")
def search_has_parent_filter(spark, d):
    part = T(spark, d, "part")
    first = part.agg(F.min("p_brand").alias("p_brand"))
    parents = part.where("p_size >= 45").join(F.broadcast(first), "p_brand", "left_semi")  # one row
    return retrieve.has_parent(T(spark, d, "lineitem"), parents.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, round(avg(l_extendedprice), 4) AS score FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 25 GROUP BY l_orderkey")
def search_nested_exists(spark, d):
    items = F.collect_list(F.struct("l_returnflag", "l_quantity", "l_extendedprice"))
    nested = T(spark, d, "lineitem").groupBy("l_orderkey").agg(items.alias("items"))
    hits = retrieve.nested_average(nested, "l_orderkey", "items", lambda x: (x["l_returnflag"] == "R") & (x["l_quantity"] >= 25), lambda x: x["l_extendedprice"])
    return hits.withColumn("score", F.round("score", 4))


@query(f"""WITH {_bm25_sql('(SELECT conv_id * 1000 + turn AS id, conv_id, role, text FROM conversations)', 'conv_id, id, role', 'text', ['the', 'heon'])}, c AS (SELECT conv_id, role AS kind, id, sum(score) AS score FROM s GROUP BY ALL),
h AS (SELECT conv_id FROM c GROUP BY conv_id ORDER BY round(sum(score), 6) DESC, conv_id LIMIT 20)
SELECT conv_id, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY round(score, 6) DESC, id) AS n FROM c WHERE conv_id IN (SELECT conv_id FROM h) AND kind IN ('user', 'assistant')) WHERE n = 1""")
def enrich_best_child(spark, d):
    rows = T(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    scores = retrieve.token_scores(rows, ["conv_id", "id", "role"], "text", ["the", "heon"])
    children = scores.groupBy("conv_id", F.col("role").alias("kind"), "id").agg(F.sum("score").alias("score"))
    hits = page.page(retrieve.has_child(children, "conv_id").withColumn("score", F.round("score", 6)), page.relevance("conv_id"), size=20)
    return page.best_child(hits, children.withColumn("score", F.round("score", 6)), "conv_id", ["user", "assistant"], "id").select("conv_id", "kind", "id")


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50)
SELECT h.l_orderkey, h.l_linenumber, h.l_partkey, p_name, p_brand FROM h LEFT JOIN part ON p_partkey = l_partkey""")
def enrich_parent_fields(spark, d):
    hits = page.page(T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], size=50)
    return page.enrich(hits, T(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", "p_name", "p_brand").drop("l_extendedprice")


@query("""SELECT o_orderkey, min_by(p_name, p_partkey) AS first_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE lower(p_name) LIKE '%red%' GROUP BY o_orderkey""")
def enrich_first_nested(spark, d):
    names = T(spark, d, "lineitem").join(T(spark, d, "part").where(F.lower("p_name").contains("red")), F.col("l_partkey") == F.col("p_partkey"))
    found = names.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by("p_name", "p_partkey").alias("first_name"))
    return T(spark, d, "orders").select("o_orderkey").join(found, "o_orderkey")


# ---- filters -------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_brand FROM part WHERE (p_brand IS NULL OR p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#21')) AND p_type IN (SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 3)")
def filter_owner_org_others(spark, d):
    part = T(spark, d, "part")
    types = [r[0] for r in part.select("p_type").distinct().orderBy("p_type").limit(3).collect()]
    return filters.combine(part, filters.org("p_brand", "others", ["Brand#11", "Brand#12", "Brand#21"]), filters.one_or_many("p_type", types)).select("p_partkey", "p_brand")


_SPAN = "SELECT o_orderkey, o_orderdate AS start, o_orderdate + to_days((o_orderkey % 400)::INT) AS stop FROM orders"


def _span(spark, d) -> DataFrame:
    stop = F.col("o_orderdate") + F.make_interval(days=(F.col("o_orderkey") % 400).cast("int"))
    return T(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("start"), stop.alias("stop"))


@query(f"WITH s AS ({_SPAN}) SELECT o_orderkey, 1 AS phase FROM s WHERE start > TIMESTAMP '{AS_OF}' UNION ALL SELECT o_orderkey, 2 FROM s WHERE start <= TIMESTAMP '{AS_OF}' AND stop >= TIMESTAMP '{AS_OF}' UNION ALL SELECT o_orderkey, 3 FROM s WHERE stop < TIMESTAMP '{AS_OF}'")
def filter_process_phase(spark, d):
    rows = _span(spark, d)
    parts = [rows.where(filters.process("start", "stop", k, AS_OF)).select("o_orderkey", F.lit(k).alias("phase")) for k in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH s AS (SELECT o_orderkey, o_orderdate AS start, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate + to_days((o_orderkey % 400)::INT) END AS expire FROM orders) SELECT o_orderkey FROM s WHERE expire >= TIMESTAMP '{AS_OF}' OR (expire IS NULL AND start >= TIMESTAMP '{AS_OF}' - to_days(90))")
def filter_expiration(spark, d):
    rows = _span(spark, d).withColumn("expire", F.when(F.col("o_orderkey") % 3 > 0, F.col("stop")))
    return rows.where(filters.expiration("expire", "start", 90, AS_OF)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE (p_size % 2) = 1 AND (p_size % 3) = 0 AND p_size - 25 >= 0")
def filter_paid_type(spark, d):
    rows = T(spark, d, "part").withColumns({"course_type": F.col("p_size") % 2, "is_paid_only": F.col("p_size") % 3, "status": F.col("p_size") - 25})
    return filters.combine(rows, filters.three_way("course_type", 1), filters.three_way("is_paid_only", 2), filters.platform_status("status", 0), filters.three_way("p_size", 0)).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate > TIMESTAMP '1996-06-01'")
def filter_table_driven(spark, d):
    params = {"visible": ["O", "F"], "stage": ["1-URGENT", "2-HIGH"], "school": [], "unknown": [1]}
    found = filters.table_driven(params, {"visible": "o_orderstatus", "stage": "o_orderpriority", "school": "o_custkey"})
    return filters.combine(T(spark, d, "orders"), *found, filters.time_status("o_orderdate", "o_orderdate", 1, AS_OF)).select("o_orderkey")


@query(f"WITH s AS ({_SPAN}) SELECT o_orderkey FROM s JOIN orders USING (o_orderkey) WHERE o_orderstatus = 'O' AND start <= TIMESTAMP '{AS_OF}' AND stop >= TIMESTAMP '{AS_OF}'")
def filter_has_assistant(spark, d):
    rows = _span(spark, d).join(T(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    rows = rows.withColumn("owner", F.when(F.col("o_orderstatus") == "O", filters.OWN_PLATFORM))
    return rows.where(filters.has_assistant("owner", "start", "stop", AS_OF)).select("o_orderkey")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING list_has_any(list(DISTINCT o_orderpriority), ['1-URGENT', '5-LOW']) AND count(*) >= 12")
def filter_array_overlap(spark, d):
    rows = T(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("mode"), F.count("*").alias("serialized"))
    return filters.combine(rows, filters.any_of_array("mode", ["1-URGENT", "5-LOW"]), filters.at_least("serialized", 12)).select("o_custkey")


@query("WITH q AS (SELECT (i * 37) % 500 AS p_partkey, i AS pos FROM range(40) t(i)) SELECT pos, q.p_partkey, p_name, p_size FROM q LEFT JOIN part USING (p_partkey)")
def lookup_fields_by_ids(spark, d):
    asked = spark.range(40).select(((F.col("id") * 37) % 500).alias("p_partkey"), F.col("id").alias("pos"))
    return filters.lookup(asked, T(spark, d, "part"), "p_partkey", ["p_name", "p_size"])


@query("SELECT s_suppkey, length(s_name) > 1 AND NOT regexp_matches(s_name, '[#，123]') AS ok, (regexp_matches(s_name, '^[0-9A-Za-z]+$') AND length(s_name) <= 20) OR length(s_name) <= 8 AS gate FROM supplier")
def filter_names(spark, d):
    return T(spark, d, "supplier").select("s_suppkey", filters.staff_name_ok("s_name").alias("ok"), filters.request_gate("s_name").alias("gate"))


# ---- pages ---------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT p_brand, list(p_partkey ORDER BY p_partkey) AS ids, list(p_type ORDER BY p_partkey) AS names FROM part GROUP BY p_brand), e AS (SELECT unnest(ids) % 40 AS cid, unnest(names) AS cid_name FROM a)
SELECT cid, count(*) AS doc_count, min(cid_name) AS cid_name FROM e GROUP BY cid ORDER BY doc_count DESC, cid LIMIT 10 OFFSET 5""")
def facet_category_top(spark, d):
    lists = T(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))).alias("x"))
    rows = lists.select(F.transform("x", lambda v: v["p_partkey"] % 40).alias("ids"), F.transform("x", lambda v: v["p_type"]).alias("names"))
    return page.facet(rows, "ids", "names", offset=5)


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey DESC LIMIT 25")
def sort_natural_course(spark, d):
    rows = T(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return page.page(rows, page.natural("p_size", "p_retailprice", key="p_partkey"), size=25)


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 24")
def page_offset_limit(spark, d):
    return page.page(T(spark, d, "orders"), [F.desc("o_totalprice"), "o_orderkey"], number=3, size=7, offset=3).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey LIMIT 15")
def sort_credit_course(spark, d):
    return page.page(T(spark, d, "orders"), page.credit_order("o_orderkey", "o_orderdate", "o_totalprice"), size=15).select("o_orderkey")


@query("SELECT source, doc_id, n_chars, place FROM (SELECT source, doc_id, n_chars, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id))::INT AS place FROM documents) WHERE place <= 3")
def top_per_group(spark, d):
    return page.top_per_group(T(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 3)


@query(f"""WITH s AS ({_SPAN}) SELECT o_orderkey, CASE WHEN stop < TIMESTAMP '{AS_OF}' THEN -1 WHEN start <= TIMESTAMP '{AS_OF}' AND stop >= TIMESTAMP '{AS_OF}' THEN 0 ELSE 1 END AS time_status,
o_orderkey % 2 = 0 AND start < TIMESTAMP '{AS_OF}' AND stop > TIMESTAMP '{AS_OF}' AS "hasTA", o_orderkey % 97 AS accumulate_num FROM s""")
def shape_results(spark, d):
    rows = _span(spark, d).withColumns({"owner": F.when(F.col("o_orderkey") % 2 == 0, filters.OWN_PLATFORM).otherwise("other"), "accumulate_num": F.lit(0).cast("long"), "accumulate_num_v2": F.col("o_orderkey") % 97})
    rows = page.shape_courses(rows, AS_OF, "owner", "start", "stop").withColumn("time_status", page.time_status("start", "stop", AS_OF))
    return rows.select("o_orderkey", "time_status", "hasTA", "accumulate_num")


# ---- planning ------------------------------------------------------------------------------------------------------

_Q = f"q AS (SELECT item_id AS query_id, text AS query, unnest({_tokens('text')}) AS token FROM benchmark)"
_WEIGHTS = f"""{_Q}, w AS (SELECT query_id, query, token, count(*) AS freq, count(*) * CASE WHEN length(token) = 1 THEN 1.0 ELSE 3.0 * length(token) END::DOUBLE AS weight FROM q GROUP BY query_id, query, token)"""


def _weights(spark, d) -> DataFrame:
    rows = T(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.explode(latin_tokens(F.col("text"))).alias("token"))
    return planner.token_weights(rows)


@query(f"WITH {_WEIGHTS} SELECT query_id, token, freq, round(weight, 6) AS weight FROM w")
def token_weights(spark, d):
    return _weights(spark, d).select("query_id", "token", "freq", F.round("weight", 6).alias("weight"))


@query(f"WITH {_WEIGHTS} SELECT query_id, token, place FROM (SELECT query_id, token, (row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, token))::INT AS place FROM w) WHERE place <= 6")
def token_filter_top6(spark, d):
    return planner.keep_tokens(_weights(spark, d)).select("query_id", "token", "place")


@query(f"""WITH {_WEIGHTS}, t AS (SELECT *, count(*) OVER (PARTITION BY query_id, weight) > 1 AS tied, instr(query, token) AS first, length(replace(query, token, '')) = length(query) - length(token) AS once FROM w)
SELECT query_id, token, round(weight + CASE WHEN tied AND first > 0 AND once THEN ((first - 1) + 0.5 * length(token)) * 0.1 ELSE 0 END, 6) AS weight FROM t""")
def token_position_tiebreak(spark, d):
    return planner.tie_break(_weights(spark, d)).select("query_id", "token", F.round("weight", 6).alias("weight"))


@query(f"WITH {_WEIGHTS} SELECT query_id, token, round(CASE WHEN token IN ('the', 'of') THEN sum(weight) OVER (PARTITION BY query_id) ELSE weight END, 6) AS weight FROM w")
def token_core_word(spark, d):
    cores = spark.createDataFrame([("the",), ("of",)], "token string")
    return planner.core_word(_weights(spark, d), cores).select("query_id", "token", F.round("weight", 6).alias("weight"))


@query("""WITH p(query, clauses) AS (VALUES ('java programming', 'must:programming,should:java,should:java programming'), ('c++ basics', 'must:basics,should:c++,should:c++ basics'), ('a+b', 'should:a,should:b,should:a+b'), ('one two three four five six', 'must:three,should:five,should:four,should:one,should:two,should:six,should:one two three four five six'), ('solo', 'should:solo')) SELECT * FROM p""")
def must_should_plan(spark, d):
    cases = [
        ("java programming", {"programming": 9.0, "java": 4.0}),
        ("c++ basics", {"basics": 6.0, "c++": 3.0}),
        ("a+b", {"a": 2.0, "b": 1.0}),
        ("one two three four five six", {"three": 9.0, "five": 8.0, "four": 7.0, "one": 6.0, "two": 5.0, "six": 4.0}),
        ("solo", {"solo": 1.0}),
    ]
    rows = [(q, ",".join(f"{kind}:{t}" for t, _, kind in planner.plan_query(q, w).clauses())) for q, w in cases]
    return spark.createDataFrame(rows, "query string, clauses string")


@query(f"""WITH {_bm25_sql("(SELECT p_partkey, 'title' AS kind, p_partkey AS child_id, p_name AS text FROM part WHERE p_size >= 10 UNION ALL SELECT p_partkey, 'category', p_partkey + 1000000000, p_type FROM part WHERE p_size >= 10)", 'p_partkey, child_id, kind', 'text', ['red', 'widget', 'red widget'])},
k AS (SELECT p_partkey, token, sum(score * CASE kind WHEN 'title' THEN 170 ELSE 85 END) AS score FROM s GROUP BY ALL),
h AS (SELECT p_partkey, sum(score * CASE token WHEN 'red' THEN 3.0 ELSE 2.0 END) AS score FROM k GROUP BY p_partkey HAVING count(*) FILTER (token = 'red') >= 1)
SELECT 'course' AS item_type, p_partkey::VARCHAR AS id, round(score, 5) AS score FROM h WHERE score >= 1.1 ORDER BY round(score, 5) DESC, id LIMIT 10""")
def search_courses_end_to_end(spark, d):
    part = T(spark, d, "part")
    courses = part.select(F.col("p_partkey").alias("course_id"), F.col("p_size").alias("serialized"))
    children = part.select(F.col("p_partkey").alias("course_id"), F.col("p_partkey").alias("child_id"), F.lit("title").alias("kind"), F.col("p_name").alias("text"))
    children = children.unionByName(part.select(F.col("p_partkey").alias("course_id"), (F.col("p_partkey") + 1_000_000_000).alias("child_id"), F.lit("category").alias("kind"), F.col("p_type").alias("text")))
    request = SearchRequest.parse({"query": "red widget", "serialized": "10", "qt": "2"})
    hits, _ = run_search(Catalogue(courses, children, {}), request, {"red": 3.0, "widget": 2.0}, AS_OF)
    return hits.withColumn("score", F.round("score", 5))
