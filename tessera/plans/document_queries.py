"""Registered queries of document assembly, updates, word statistics, monitors and streams."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import cdc, etl, monitor, wordstat
from tessera.plans.search_queries import _tokens
from tessera.registry import query
from tessera.sources import readers
from tessera.sources.readers import table as T
from tessera.streaming import incremental

# ---- assembly ------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'O' AND r_name IN ('ASIA', 'EUROPE')")
def etl_course_category_join(spark, d):
    on = ("c_custkey", "o_custkey", "c_nationkey", "n_nationkey", "n_regionkey", "r_regionkey")
    predicate = (F.col("o_orderstatus") == "O") & F.col("r_name").isin("ASIA", "EUROPE")
    return etl.course_categories(T(spark, d, "customer"), T(spark, d, "orders"), T(spark, d, "nation"), T(spark, d, "region"), on, predicate).select("c_custkey", "n_name", "r_name")


@query("SELECT DISTINCT l_partkey, s_suppkey, s_name, p_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size > 40")
def etl_staff_join(spark, d):
    links = T(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part = T(spark, d, "part").where("p_size > 40")
    return links.join(part, F.col("l_partkey") == F.col("p_partkey")).join(T(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "s_suppkey", "s_name", "p_name")


@query("SELECT d.doc_id, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def etl_fragment_left_join(spark, d):
    return T(spark, d, "documents").select("doc_id", "source").join(T(spark, d, "labels"), "doc_id", "left")


@query("SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def etl_group_concat(spark, d):
    return etl.group_concat(T(spark, d, "orders"), "o_custkey", "o_orderkey", "keys")


@query("SELECT p_partkey, p_name, coalesce(n, 0) AS enroll_num, greatest(coalesce(n, 0), p_size)::BIGINT AS accumulate_num FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey) ON p_partkey = l_partkey")
def etl_enrol_left_outer(spark, d):
    counts = etl.active_counts(T(spark, d, "lineitem"), "l_partkey", F.col("l_returnflag") == "N").withColumnRenamed("l_partkey", "p_partkey")
    rows = etl.with_counts(T(spark, d, "part"), counts, "p_partkey").withColumn("accumulate_num", F.col("p_size").cast("long"))
    return etl.monotone(rows, "accumulate_num", "accumulate_num", "enroll_num").select("p_partkey", "p_name", "enroll_num", "accumulate_num")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)")
def etl_in_subquery(spark, d):
    rich = T(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return T(spark, d, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT l_returnflag, count(l_orderkey) AS n_users, count(DISTINCT l_partkey) AS n_courses FROM lineitem GROUP BY l_returnflag")
def etl_count_distinct(spark, d):
    return T(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("l_orderkey").alias("n_users"), F.countDistinct("l_partkey").alias("n_courses"))


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ';') AS types, array_to_string(list_sort(list(DISTINCT p_size)), ';') AS sizes FROM part GROUP BY p_brand")
def etl_collect_distinct(spark, d):
    rows = etl.collect_distinct(T(spark, d, "part"), "p_brand", "p_type", "p_size")
    return rows.select("p_brand", F.array_join("p_type", ";").alias("types"), F.array_join(F.transform("p_size", lambda x: x.cast("string")), ";").alias("sizes"))


@query("WITH a AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ids, list(o_orderstatus ORDER BY o_orderkey) AS names FROM orders GROUP BY o_custkey) SELECT o_custkey, unnest(range(len(ids)))::INT AS pos, unnest(ids) AS ids, unnest(names) AS names FROM a")
def etl_arrays_zip(spark, d):
    lists = T(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x"))
    rows = lists.select("o_custkey", F.transform("x", lambda v: v["o_orderkey"]).alias("ids"), F.transform("x", lambda v: v["o_orderstatus"]).alias("names"))
    return etl.explode_zip(rows, ["o_custkey"], "ids", "names")


@query("""WITH n AS (SELECT conv_id, turn, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, greatest(0, least(i - 2, n - 5)) AS st FROM n), l AS (SELECT conv_id, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id)
SELECT s.conv_id, turn, array_to_string(turns[st + 1 : st + 5], '-') AS context FROM s JOIN l ON s.conv_id = l.conv_id""")
def etl_context_window(spark, d):
    rows = T(spark, d, "conversations").select("conv_id", "turn", F.col("turn").cast("string").alias("name"))
    return etl.context_window(rows, "conv_id", "turn", "name").select("conv_id", "turn", F.array_join("context", "-").alias("context"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_orderdate, max(o_orderdate > TIMESTAMP '1996-06-01') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders)
SELECT o_custkey, max_by(o_orderkey, o_orderkey) FILTER (NOT f) AS last_chapter FROM c GROUP BY o_custkey""")
def etl_last_started(spark, d):
    return etl.last_started(T(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderdate", "o_orderkey", "1996-06-01 00:00:00")


@query("SELECT o_custkey, o_orderkey, lpad((dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus))::VARCHAR, 2, '0') || '.' || lpad((row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey))::VARCHAR, 2, '0') AS order_num FROM orders")
def etl_order_num(spark, d):
    return etl.order_numbers(T(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey").select("o_custkey", "o_orderkey", "order_num")


@query("""WITH n AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)
SELECT a.node, a.node AS location FROM n a WHERE parent IS NULL UNION ALL SELECT b.node, a.node || '/' || b.node FROM n a JOIN n b ON b.parent = a.node WHERE a.parent IS NULL
UNION ALL SELECT c.node, a.node || '/' || b.node || '/' || c.node FROM n a JOIN n b ON b.parent = a.node JOIN n c ON c.parent = b.node WHERE a.parent IS NULL""")
def etl_location_path(spark, d):
    one = lambda df, p, key, q, up: df.select(F.concat(F.lit(p), key).alias("node"), (F.concat(F.lit(q), up) if up else F.lit(None).cast("string")).alias("parent"))
    nodes = one(T(spark, d, "region"), "r", "r_regionkey", "", None).unionByName(one(T(spark, d, "nation"), "n", "n_nationkey", "r", "n_regionkey")).unionByName(one(T(spark, d, "supplier"), "s", "s_suppkey", "n", "s_nationkey"))
    return etl.location_paths(nodes, "node", "parent").select("node", F.array_join("location", "/").alias("location"))


@query("SELECT page_id, md5(replace(replace(regexp_replace(html, '<.*?>', '', 'g'), '<', '&lt;'), '>', '&gt;')) AS body FROM pages")
def etl_strip_tags(spark, d):
    return T(spark, d, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("body"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS body FROM pages""")
def etl_html_text(spark, d):
    return T(spark, d, "pages").select("page_id", F.md5(text.html_text(F.col("html"))).alias("body"))


_NAMES = "SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS a, CASE WHEN p_size % 3 = 0 THEN p_type END AS b, CASE WHEN p_size % 5 > 0 THEN p_brand ELSE '' END AS c FROM part"


@query(f"WITH n AS ({_NAMES}), e AS (SELECT *, (coalesce(a, '') = '')::INT + (coalesce(b, '') = '')::INT + (coalesce(c, '') = '')::INT AS k FROM n) SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY k, p_partkey DESC) AS rn FROM e) WHERE rn = 1")
def etl_best_record(spark, d):
    size = F.col("p_size")
    rows = T(spark, d, "part").select("p_partkey", "p_name", F.when(size % 2 == 0, F.col("p_brand")).alias("a"), F.when(size % 3 == 0, F.col("p_type")).alias("b"), F.when(size % 5 > 0, F.col("p_brand")).otherwise("").alias("c"))
    return etl.best_record(rows, "p_name", "p_partkey", "a", "b", "c").select("p_name", "p_partkey")


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def etl_first_wins_dedupe(spark, d):
    return etl.first_wins(T(spark, d, "part").select("p_name", "p_partkey"), "p_name", "p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '2030-01-01 00:00:00' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS stop, o_orderdate::DATE::TIMESTAMP + INTERVAL 8 HOUR AS start, md5(o_orderkey::VARCHAR) AS id, sha1(o_orderstatus) AS h FROM orders")
def etl_timestamps_ids(spark, d):
    stop = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate"))
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    return T(spark, d, "orders").select("o_orderkey", etl.timestamp_text(stop).alias("stop"), etl.iso_timestamp(iso).alias("start"), F.md5(F.col("o_orderkey").cast("string")).alias("id"), F.sha1("o_orderstatus").alias("h"))


@query("SELECT l_orderkey AS course_id, l_linenumber AS ord, l_orderkey || '-' || l_linenumber AS block_id, 'c' || l_orderkey AS parent_id, l_shipdate::VARCHAR AS start FROM lineitem")
def etl_structure_blocks(spark, d):
    items = T(spark, d, "lineitem").withColumn("block_id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    leaf = F.struct(F.lit("sequential").alias("block_type"), "block_id", F.struct(F.lit("item").alias("display_name"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("start"), F.array().cast("array<array<string>>").alias("children")).alias("fields"))
    lists = items.groupBy(F.col("l_orderkey").alias("course_id")).agg(F.collect_list(leaf).alias("leaves"), F.array_sort(F.collect_list(F.struct("l_linenumber", "block_id"))).alias("ids"))
    children = F.concat(F.transform(F.sequence(F.lit(0), F.element_at("ids", -1)["l_linenumber"]), lambda i: F.array(F.lit("sequential"), F.concat_ws("-", F.col("course_id").cast("string"), i.cast("string")))))
    root = F.struct(F.lit("chapter").alias("block_type"), F.concat(F.lit("c"), F.col("course_id").cast("string")).alias("block_id"), F.struct(F.lit("chapter").alias("display_name"), F.lit(None).cast("string").alias("start"), children.alias("children")).alias("fields"))
    out = etl.structure_new(lists.select("course_id", F.concat(F.array(root), "leaves").alias("blocks")))
    return out.where("block_type = 'sequential'").select("course_id", "ord", "block_id", "parent_id", "start")


# ---- changes -------------------------------------------------------------------------------------------------------

_OLD, _NEW = "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey % 7 <> 0", "SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_partkey % 11 <> 0"


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    part = T(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    price = F.when(F.col("p_partkey") % 5 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    return part.where("p_partkey % 7 <> 0"), part.where("p_partkey % 11 <> 0").withColumn("p_retailprice", price)


_DIFF = f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'index' WHEN n.p_partkey IS NULL THEN 'delete' WHEN o.p_name = n.p_name AND o.p_retailprice = n.p_retailprice THEN 'same' ELSE 'update' END AS op,
CASE WHEN n.p_partkey IS NULL THEN o.p_name ELSE n.p_name END AS p_name, CASE WHEN n.p_partkey IS NULL THEN o.p_retailprice ELSE n.p_retailprice END AS p_retailprice FROM o FULL OUTER JOIN n ON o.p_partkey = n.p_partkey"""


@query(_DIFF)
def cdc_diff(spark, d):
    return cdc.diff(*_snapshots(spark, d), ["p_partkey"], ["p_name", "p_retailprice"])


@query(f"SELECT op, count(*) AS n FROM ({_DIFF}) WHERE op <> 'same' GROUP BY op")
def cdc_writes(spark, d):
    return cdc.writes(cdc_diff(spark, d)).groupBy("op").agg(F.count("*").alias("n"))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}), u AS (SELECT *, 0 AS late FROM o UNION ALL SELECT *, 1 FROM n) SELECT p_partkey, p_name, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY p_retailprice DESC, late DESC) AS k FROM u) WHERE k = 1")
def cdc_upsert(spark, d):
    return cdc.upsert(*_snapshots(spark, d), ["p_partkey"], "p_retailprice")


@query("WITH o AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 2 = 0), n AS (SELECT l_partkey, l_suppkey + 1000 AS l_suppkey FROM lineitem WHERE l_orderkey % 9 = 0) SELECT * FROM o WHERE l_partkey NOT IN (SELECT l_partkey FROM n) UNION ALL SELECT * FROM n")
def cdc_replace_children(spark, d):
    items = T(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return cdc.replace_children(items.where("l_orderkey % 2 = 0").drop("l_orderkey"), items.where("l_orderkey % 9 = 0").select("l_partkey", (F.col("l_suppkey") + 1000).alias("l_suppkey")), "l_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS p_size, CASE WHEN p_brand = 'Brand#3' THEN 'moved' ELSE p_type END AS p_type FROM part")
def cdc_field_update(spark, d):
    part = T(spark, d, "part")
    updates = part.where("p_partkey % 3 = 0").select("p_partkey", (F.col("p_size") + 100).alias("p_size"))
    rows = cdc.update_field(part, updates, "p_partkey", "p_size")
    return cdc.update_where(rows, F.col("p_brand") == "Brand#3", "p_type", "moved").select("p_partkey", "p_size", "p_type")


@query("WITH q AS (SELECT CASE WHEN i % 5 = 0 THEN ' ' ELSE (i * 97)::VARCHAR END AS course_id FROM range(50) t(i)) SELECT course_id, CASE WHEN trim(course_id) = '' THEN -1 WHEN course_id IN (SELECT p_partkey::VARCHAR FROM part) THEN 1 ELSE 0 END AS status FROM q")
def cdc_update_status(spark, d):
    asked = spark.range(50).select(F.when(F.col("id") % 5 == 0, F.lit(" ")).otherwise((F.col("id") * 97).cast("string")).alias("course_id"))
    return cdc.update_status(asked, T(spark, d, "part").select(F.col("p_partkey").cast("string").alias("course_id")), "course_id")


# ---- word statistics -----------------------------------------------------------------------------------------------

_COUNTS = f"c AS (SELECT lang, unnest({_tokens('text')}) AS word FROM documents), n AS (SELECT lang, word, count(*) AS n FROM c GROUP BY ALL)"


def _counts(spark, d) -> DataFrame:
    return wordstat.word_count(T(spark, d, "documents"), "lang", text.latin_tokens(F.col("text")))


@query(f"WITH {_COUNTS} SELECT lang, word, n FROM n")
def wordcount_by_subject(spark, d):
    return _counts(spark, d)


@query(f"WITH {_COUNTS} SELECT word, lang, sum(n)::BIGINT AS n FROM n GROUP BY GROUPING SETS ((word), (lang))")
def word_total_grouping_sets(spark, d):
    return wordstat.totals(_counts(spark, d), "lang")


@query(f"WITH {_COUNTS}, t AS (SELECT *, sum(n) OVER (PARTITION BY word) AS nw, sum(n) OVER (PARTITION BY lang) AS ns, sum(n) OVER () AS na FROM n) SELECT lang, word, n, round((n / ns) / (nw / na), 6) AS lift FROM t")
def word_lift(spark, d):
    return wordstat.lift(_counts(spark, d), "lang").withColumn("lift", F.round("lift", 6))


@query(r"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct FROM (SELECT doc_id, " + _tokens("text") + " AS t FROM documents)")
def text_tokens(spark, d):
    tokens = text.latin_tokens(F.col("text"))
    return T(spark, d, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_distinct"))


@query("""SELECT p_partkey, array_to_string(list_concat([substr(p_name, i::INT, 1) FOR i IN range(1, length(p_name) + 1)], [substr(p_name, i::INT, 2) FOR i IN range(1, length(p_name))]), '|') AS grams,
array_to_string([substr(p_name, 1, n::INT) FOR n IN range(2, 5) IF n <= length(p_name)], '|') AS edges FROM part""")
def text_grams(spark, d):
    c = F.col("p_name")
    return T(spark, d, "part").select("p_partkey", F.array_join(text.grams(c, 1, 2), "|").alias("grams"), F.array_join(text.edge_grams(c, 2, 4), "|").alias("edges"))


@query("SELECT url, array_to_string([array_to_string(p[1:n::INT], '/') FOR n IN range(1, len(p) + 1)], '|') AS paths FROM (SELECT url, string_split(url, '/') AS p FROM pages)")
def text_path_prefixes(spark, d):
    return T(spark, d, "pages").select("url", F.array_join(text.path_prefixes(F.col("url")), "|").alias("paths"))


# ---- monitors and streams ------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT ts::DATE AS day, count(*) AS n_sent FROM events GROUP BY day), b AS (SELECT ts::DATE AS day, count(*) AS n_received FROM events WHERE event_id % 500 <> 3 GROUP BY day)
SELECT day, coalesce(n_sent, 0) AS n_sent, coalesce(n_received, 0) AS n_received, coalesce(n_sent, 0) = coalesce(n_received, 0) AS equal FROM a FULL OUTER JOIN b USING (day)""")
def monitor_reconcile(spark, d):
    rows = T(spark, d, "events").select("event_id", F.to_date("ts").alias("day"))
    return monitor.reconcile(rows, rows.where("event_id % 500 <> 3"), "day")


@query("WITH n AS (SELECT p_partkey, p_retailprice AS a, p_retailprice * (0.8513 + (p_partkey % 30) / 100.0) AS b FROM part) SELECT p_partkey, abs(a - b) < 0.1 * a AS ok FROM n")
def monitor_relative_diff(spark, d):
    a, b = F.col("p_retailprice"), F.col("p_retailprice") * (0.8513 + (F.col("p_partkey") % 30) / 100.0)
    return T(spark, d, "part").select("p_partkey", monitor.close_enough(a, b).alias("ok"))


@query("SELECT event_type, max(ts) AS last_seen, max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 5 MINUTE AS stale FROM events GROUP BY event_type")
def monitor_freshness(spark, d):
    return monitor.stale_sources(T(spark, d, "events"), "event_type", "ts", "2024-01-31 00:00:00")


@query("SELECT count(*) AS n, count(*) >= 50 AS ok FROM events WHERE ts::DATE = DATE '2024-01-03'")
def monitor_row_count(spark, d):
    return monitor.enough_rows(T(spark, d, "events"), "ts", datetime(2024, 1, 5, 7, 30))


def _streamed(spark: SparkSession, rows: DataFrame, tag: str, build, out_schema: str) -> DataFrame:
    """Runs a stream over the rows as JSON files with all that is there, and reads what its batches wrote.

    Files, state and output lie in the folder that the cluster shares.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='tessera-stream-')}"
    root = f"{base.rstrip('/')}/stream-{tag}-{hashlib.md5(str(datetime.now()).encode()).hexdigest()}"
    rows.write.json(f"{root}/in")
    stream = incremental.json_source(spark, f"{root}/in", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
    build(stream, root).awaitTermination()
    return spark.read.schema(out_schema).parquet(f"{root}/out")


@query("SELECT DISTINCT user_id::VARCHAR AS course_id FROM events WHERE event_type IN ('click', 'purchase')")
def stream_dedupe_ids(spark, d):
    rows = T(spark, d, "events").select(F.col("event_type").alias("tableName"), F.array(F.struct(F.lit("id").alias("name"), F.col("event_id").cast("string").alias("value")), F.struct(F.lit("course_id").alias("name"), F.col("user_id").cast("string").alias("value"))).alias("afterColumns"))

    def build(stream, root):
        write = lambda ids, k: ids.write.mode("overwrite").parquet(f"{root}/out/batch={k}")
        return incremental.rebuild_stream(incremental.binlog_ids(stream, ["click", "purchase"]), write, f"{root}/state", available_now=True)

    return _streamed(spark, rows, "ids", build, "course_id string").select("course_id").distinct()


@query("""WITH e AS (SELECT DISTINCT user_id AS c, (user_id + 1) % 7 AS cur, (user_id + 3) % 7 AS pre FROM events), p AS (SELECT DISTINCT user_id AS c, user_id % 7 AS parent FROM events)
SELECT c::VARCHAR AS course_id FROM e UNION SELECT p.c::VARCHAR FROM p WHERE parent IN (SELECT cur FROM e UNION SELECT pre FROM e)""")
def stream_parent_expand(spark, d):
    events = T(spark, d, "events")
    own = lambda k: ((F.col("user_id") + k) % 7).cast("string")
    edits = events.select(F.col("user_id").cast("string").alias("course_id"), own(1).alias("parent_id_cur"), own(3).alias("parent_id_pre"))
    edits = edits.unionByName(spark.createDataFrame([("xxxx", None, None)], edits.schema))
    courses = events.select(F.col("user_id").cast("string").alias("course_id"), own(0).alias("parent_id")).distinct()

    def build(stream, root):
        write = lambda ids, k: ids.write.mode("overwrite").parquet(f"{root}/out/batch={k}")
        return incremental.rebuild_stream(stream, write, f"{root}/state", available_now=True, ids=lambda edits: incremental.parent_ids(edits, courses))

    return _streamed(spark, edits, "parents", build, "course_id string").select("course_id").distinct()


@query("SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY day")
def stream_daily_count(spark, d):
    return incremental.daily_counts(T(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts")


@query("""WITH l AS (SELECT user_id::VARCHAR AS uid, event_type || ' ' || event_id % 13 AS query, ts, event_id FROM events) SELECT uid, date_trunc('second', ts) AS ts, query FROM l WHERE NOT starts_with(query, 'click') AND ts >= TIMESTAMP '2024-01-02 00:00:01'""")
def source_search_log(spark, d):
    q = F.url_encode(F.concat_ws(" ", "event_type", (F.col("event_id") % 13).cast("string")))
    line = F.concat_ws("|||", F.col("user_id").cast("string"), F.lit("s"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("c"), q, F.lit("org"))
    rows = readers.parse_search_log(T(spark, d, "events").select(line.alias("value")), since="2024-01-02 00:00:00", blacklist=[f"click {k}" for k in range(13)])
    return rows.select("uid", "ts", "query")


@query("SELECT DISTINCT p_partkey::VARCHAR AS course_id FROM part")
def source_course_list(spark, d):
    part = T(spark, d, "part").select(F.col("p_partkey").cast("string").alias("course_id"), F.col("p_brand").alias("org"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("course_num"))
    own = part.where("cast(course_id as long) % 2 = 1").select(F.col("course_id").alias("value"))
    three = part.where("cast(course_id as long) % 2 = 0").select(F.concat_ws("\t", "org", "course_num", F.lit("2016")).alias("value"))
    return readers.course_list(own.unionByName(own).unionByName(three), part)


@query("SELECT lang || '_' || doc_id AS word, n_chars AS n FROM documents")
def source_word_counts(spark, d):
    line = F.concat(F.lit("(u'"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("', "), F.col("n_chars").cast("string"), F.lit(")"))
    return readers.word_counts_text(T(spark, d, "documents").select(line.alias("value")))


@query("SELECT p_name AS word, p_size::VARCHAR AS weight FROM part")
def source_delimited(spark, d):
    return readers.delimited(readers.to_delimited(T(spark, d, "part"), ["p_name", "p_size"]), ["word", "weight"])
