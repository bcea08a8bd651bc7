"""Registered queries of entity search, analyzers and the remaining readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import analyzers, text
from tessera.operators import page, retrieve
from tessera.plans import entities
from tessera.plans.search_queries import _bm25_sql, _clauses, _tokens
from tessera.registry import query
from tessera.sources import schemas
from tessera.sources.readers import table as T

AS_OF = "1996-06-01 00:00:00"


@query(f"SELECT o_orderkey AS course_id FROM orders WHERE o_orderdate > TIMESTAMP '{AS_OF}' AND o_orderstatus <> 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber IN (1, 3))")
def search_engineer(spark, d):
    orders = T(spark, d, "orders")
    courses = orders.select(F.col("o_orderkey").alias("course_id"), F.col("o_orderdate").alias("start"), F.col("o_orderdate").alias("end"), F.when(F.col("o_orderstatus") == "P", -1).otherwise(0).alias("status"))
    categories = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("course_id"), F.array("l_linenumber").alias("cid"), F.col("l_returnflag").alias("group"))
    return entities.engineer_search(courses, categories, [1, 3], "N", 1, AS_OF).select("course_id")


_KINDS = f"{_bm25_sql('documents', 'doc_id', 'text', ['the', 'tion'], 'a')}, {_bm25_sql('part', 'p_partkey', 'p_name', ['red', 'gear'], 'b')}, h AS (SELECT 'knowledge' AS item_type, doc_id AS id, round(sum(score), 6) AS score FROM a GROUP BY doc_id UNION ALL SELECT 'course', p_partkey, round(sum(score), 6) FROM b GROUP BY p_partkey)"


@query(f"WITH {_KINDS}, p AS (SELECT item_type, id, score FROM h WHERE item_type = 'course' ORDER BY score DESC, id LIMIT 10), t AS (SELECT item_type, count(*) AS n FROM h GROUP BY item_type) SELECT item_type, id AS value FROM p UNION ALL SELECT 'total ' || item_type, n FROM t UNION ALL SELECT 'total all', sum(n)::BIGINT FROM t")
def search_home_counts(spark, d):
    a = retrieve.token_scores(T(spark, d, "documents"), ["doc_id"], "text", ["the", "tion"])
    b = retrieve.token_scores(T(spark, d, "part"), ["p_partkey"], "p_name", ["red", "gear"])
    total = lambda s, key, kind: s.groupBy(F.col(key).alias("id")).agg(F.round(F.sum("score"), 6).alias("score")).withColumn("item_type", F.lit(kind))
    shown, counts = entities.home_counts(total(a, "doc_id", "knowledge").unionByName(total(b, "p_partkey", "course")), "course", page.relevance("id"))
    return shown.select("item_type", F.col("id").alias("value")).unionByName(counts.select(F.concat(F.lit("total "), "item_type").alias("item_type"), F.col("total").alias("value")))


@query(f"WITH k AS (SELECT * FROM part WHERE p_type IN ('SMALL', 'ECONOMY')), {_bm25_sql('k', 'p_partkey', 'p_name', ['red', 'gear'])}, h AS (SELECT p_partkey, sum(score) AS score FROM s GROUP BY p_partkey) SELECT k.p_partkey, round(coalesce(score, 0), 6) AS score FROM k LEFT JOIN h ON k.p_partkey = h.p_partkey")
def search_credit_course(spark, d):
    clauses = _clauses(spark, [("red", 1.0, "should"), ("gear", 1.0, "should")])
    found = entities.entity_search(T(spark, d, "part"), "credit_course", "p_partkey", "p_name", clauses, 0, 1, {"school": ["SMALL", "ECONOMY"]}, {"school": "p_type"})
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey), k AS (SELECT s_suppkey, s_name FROM supplier JOIN c ON l_suppkey = s_suppkey), {_bm25_sql('k', 's_suppkey', 's_name', ['supplier'])} SELECT s_suppkey, round(sum(score) * 900, 6) AS score FROM s GROUP BY s_suppkey HAVING sum(score) * 900 >= 1.1 UNION ALL SELECT s_suppkey, 1.0 FROM supplier WHERE lower(s_name) = 'supplier#000000003'")
def search_staff(spark, d):
    counts = T(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("staffinfo_course_num"))
    staff = T(spark, d, "supplier").join(counts, "s_suppkey", "left").withColumn("staffinfo_course_num", F.coalesce("staffinfo_course_num", F.lit(0)))
    hits = entities.entity_search(staff, "staff", "s_suppkey", "s_name", _clauses(spark, [("supplier", 900.0, "should")]), 0, 1)
    return hits.withColumn("score", F.round("score", 6)).unionByName(entities.whole_field(staff, "s_suppkey", "s_name", "SUPPLIER#000000003"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '{AS_OF}' THEN -1 WHEN o_orderdate = TIMESTAMP '{AS_OF}' THEN 0 ELSE 1 END AS time_status, o_orderstatus || ':1|' || o_orderpriority || ':2' AS stages FROM orders")
def credit_post_process(spark, d):
    rows = T(spark, d, "orders").select(F.col("o_orderkey").alias("cc_o_orderkey"), F.col("o_orderdate").alias("cc_start"), F.col("o_orderdate").alias("cc_end"), F.array("o_orderstatus", "o_orderpriority").alias("cc_stage"), F.array(F.lit(1), F.lit(2)).alias("cc_stage_weight"))
    out = entities.credit_rows(rows, AS_OF)
    return out.select("o_orderkey", "time_status", F.array_join(F.transform("stages", lambda x: F.concat_ws(":", x["name"], x["weight"].cast("string"))), "|").alias("stages"))


@query("WITH l AS (SELECT o_custkey, list(o_orderkey % 30 ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey), e AS (SELECT o_custkey, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM l) SELECT o_custkey, string_agg(coalesce(r_name, '-'), '|' ORDER BY pos) AS names FROM e LEFT JOIN nation ON id = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY o_custkey")
def etl_category_parent_names(spark, d):
    lists = T(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x % 30).alias("ids"))
    nation = T(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), F.col("n_name").alias("name"))
    region = T(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    out = entities.parent_names(lists, "o_custkey", "ids", nation.unionByName(region))
    return out.select("o_custkey", F.array_join(F.transform("first_category", lambda x: F.coalesce(x, F.lit("-"))), "|").alias("names"))


@query(f"""WITH q AS (SELECT l_orderkey AS query_id, string_agg(DISTINCT lower(substr(l_returnflag, 1, 1)), ' ') AS query FROM lineitem GROUP BY l_orderkey), t AS (SELECT DISTINCT doc_id, unnest({_tokens('text')}) AS token FROM documents),
a AS (SELECT query_id, unnest(list_distinct(string_split(query, ' '))) AS token FROM q), n AS (SELECT query_id, count(*) AS n FROM a GROUP BY query_id), m AS (SELECT query_id, doc_id, count(*) AS k FROM a JOIN t USING (token) GROUP BY ALL), h AS (SELECT m.query_id, count(*) AS hits FROM m JOIN n ON m.query_id = n.query_id AND k = n GROUP BY m.query_id)
SELECT query_id, coalesce(hits, 0) AS hits FROM q LEFT JOIN h USING (query_id)""")
def search_hits_per_query(spark, d):
    flags = F.array_join(F.array_sort(F.collect_set(F.lower(F.substring("l_returnflag", 1, 1)))), " ")
    queries = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(flags.alias("query"))
    return entities.hits_per_query(queries, T(spark, d, "documents"), "doc_id", "text")


@query("WITH p AS (SELECT p_partkey FROM part WHERE p_size >= 30) SELECT 'title' AS child_type, p_partkey AS course_id, p_name AS text FROM part WHERE p_size >= 30 UNION ALL SELECT 'category', p_partkey, p_type FROM part WHERE p_size >= 30 UNION ALL SELECT 'staff', l_partkey, s_name FROM (SELECT DISTINCT l_partkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) WHERE l_partkey IN (SELECT p_partkey FROM p)")
def source_union_children(spark, d):
    part = T(spark, d, "part").withColumnRenamed("p_partkey", "course_id")
    staff = T(spark, d, "lineitem").join(T(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("course_id"), "s_name").distinct()
    return entities.union_children(part.where("p_size >= 30"), {"title": (part, "p_name"), "category": (part, "p_type"), "staff": (staff, "s_name")})


@query("SELECT p_partkey, 'course_name' AS category, p_name AS value FROM part UNION ALL SELECT p_partkey, 'about', p_type FROM part UNION ALL SELECT l_partkey, 'chapter', l_returnflag FROM lineitem")
def suggest_text_dump(spark, d):
    part = T(spark, d, "part")
    return entities.text_dump({"course_name": (part, "p_name"), "about": (part, "p_type"), "chapter": (T(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), "l_returnflag")}, "p_partkey")


@query("""SELECT c_custkey, array_to_string(list_distinct([x FOR x IN string_split_regex(lower(c_name), '\\s+') IF x <> '']), '|') AS white, lower(c_name) AS keyword, array_to_string([lower(substr(c_name, 1, n::INT)) FOR n IN range(1, 11) IF n <= length(c_name)], '|') AS edge,
array_to_string([trim(x) FOR x IN string_split(c_mktsegment, ',') IF trim(x) <> ''], '|') AS comma FROM customer""")
def text_analyzers(spark, d):
    joined = lambda c, name: F.array_join(analyzers.analyze(F.col(c), name), "|")
    return T(spark, d, "customer").select("c_custkey", joined("c_name", "whitespace_lowercase").alias("white"), joined("c_name", "keyword_lowercase").alias("keyword"), joined("c_name", "edge_ngram").alias("edge"), joined("c_mktsegment", "comma").alias("comma"))


_IDS = "CASE p_size % 3 WHEN 0 THEN 'course-v1:' || p_brand || '+n' || p_partkey || '+2016' WHEN 1 THEN p_brand || '/n' || p_partkey || '/2016' ELSE p_name END"


@query(f"SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'old' ELSE 'none' END AS kind, CASE WHEN p_size % 3 < 2 THEN 'N' || p_partkey ELSE upper(p_name) END AS number FROM part")
def etl_course_ids(spark, d):
    key = F.col("p_partkey").cast("string")
    made = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("course-v1:"), "p_brand", F.lit("+n"), key, F.lit("+2016"))).when(F.col("p_size") % 3 == 1, F.concat("p_brand", F.lit("/n"), key, F.lit("/2016"))).otherwise(F.col("p_name"))
    return T(spark, d, "part").select("p_partkey", text.course_id_kind(made).alias("kind"), text.course_number(made).alias("number"))


@query(f"WITH {_bm25_sql('(SELECT DISTINCT p_name AS word, p_name AS body FROM part)', 'word', 'body', ['red', 'gear'])} SELECT word, round(sum(score), 6) AS score FROM s GROUP BY word ORDER BY round(sum(score), 6) DESC, word LIMIT 1")
def related_best_word(spark, d):
    words = T(spark, d, "part").select(F.col("p_name").alias("word")).distinct()
    out = entities.best_word(words, "red gear", ["red", "gear"], _clauses(spark, [("red", 1.0, "should"), ("gear", 1.0, "should")]))
    return out.withColumn("score", F.round("score", 6))


@query("SELECT p_partkey::VARCHAR AS course_id, p_name AS title, NULL::TIMESTAMP AS ut FROM part")
def source_conform(spark, d):
    rows = T(spark, d, "part").select(F.col("p_partkey").alias("course_id"), F.col("p_name").alias("title"), "p_brand")
    return schemas.conform(rows, "course_title")


@query("WITH q AS (SELECT DISTINCT (p_partkey * 3) AS k FROM part) SELECT k::VARCHAR AS course_id, CASE WHEN k IN (SELECT p_partkey FROM part) THEN 1 ELSE 0 END AS status FROM q")
def rebuild_status(spark, d):
    part = T(spark, d, "part").select(F.col("p_partkey").cast("string").alias("course_id"), "p_name")
    _, status = entities.rebuild(T(spark, d, "part").select((F.col("p_partkey") * 3).cast("string").alias("course_id")), part)
    return status
