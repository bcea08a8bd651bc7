"""Registered queries of correction, suggestion, related searches, highlighting and pinyin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import pinyin, text
from tessera.functions.distance import damerau_column, lcs_column, remainder_column
from tessera.operators import correct, highlight, related, suggest
from tessera.plans.search_queries import _tokens
from tessera.registry import query
from tessera.sources.readers import table as T

# ---- correction ----------------------------------------------------------------------------------------------------

_NUMERALS = "0-9一二三四五六七八九十上中下"
_CLEAN = rf"""trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[(\[{{（【][{_NUMERALS}][^)\]}}）】]*[)\]}}）】]', '', 'g'), '[(\[{{（【)\]}}）】]', ' ', 'g'), '[^0-9a-zà-ÿ一-龥]+', ' ', 'g'))"""


@query(f"SELECT doc_id, md5({_CLEAN}) AS clean FROM documents")
def correct_clean(spark, d):
    return T(spark, d, "documents").select("doc_id", F.md5(text.clean_query(F.col("text"))).alias("clean"))


def _asked(spark, d) -> DataFrame:
    """Part names with one letter changed, as queries."""
    rows = T(spark, d, "part").select(F.translate("p_name", "i", "e").alias("query")).distinct()
    return rows.withColumn("clean", text.clean_query(F.col("query")))


_ASKED = "q AS (SELECT DISTINCT translate(p_name, 'i', 'e') AS query FROM part)"
_WORDS = "w AS (SELECT p_name AS word, max(p_size)::BIGINT AS weight FROM part GROUP BY p_name)"


def _words(spark, d) -> DataFrame:
    return T(spark, d, "part").groupBy(F.col("p_name").alias("word")).agg(F.max("p_size").cast("long").alias("weight"))


@query(f"WITH {_ASKED}, {_WORDS} SELECT query, word AS output, weight, 2 AS tier FROM q JOIN w ON query = word")
def correct_exact(spark, d):
    return correct.exact(_asked(spark, d), _words(spark, d))


@query(f"""WITH {_WORDS}, g(a, b) AS (VALUES ('e', 'i'), ('i', 'e'), ('o', 'u'), ('u', 'o')), p AS (SELECT word, weight, unnest(range(1, length(word) + 1)) AS i FROM w),
s AS (SELECT DISTINCT word, weight, substr(word, 1, i - 1) || b || substr(word, i + 1) AS other FROM p JOIN g ON substr(word, i, 1) = a)
SELECT word, other, weight FROM s""")
def correct_similar_form(spark, d):
    groups = spark.createDataFrame([(["e", "i"],), (["o", "u"],)], "members array<string>")
    words = _words(spark, d)
    return correct.similar_words(words, groups).join(words, "word").select("word", F.col("similar").alias("other"), "weight")


@query(f"""WITH {_ASKED}, {_WORDS}, a AS (SELECT DISTINCT query, substr(query, i, 2) AS gram FROM (SELECT query, unnest(range(1, length(query))) AS i FROM q)), b AS (SELECT DISTINCT word, weight, substr(word, i, 2) AS gram FROM (SELECT word, weight, unnest(range(1, length(word))) AS i FROM w)),
c AS (SELECT query, word AS output, weight, count(*) AS shared FROM a JOIN b USING (gram) GROUP BY ALL) SELECT query, output, weight, shared FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, weight DESC, output) AS k FROM c) WHERE k <= 10""")
def correct_ngram_topk(spark, d):
    asked = _asked(spark, d).select("query", F.col("query").alias("asked"))
    entries = _words(spark, d).select(F.col("word").alias("pinyin"), F.col("word").alias("output"), "weight")
    return correct.gram_candidates(asked, entries).select("query", "output", "weight", "shared")


_PAIRS = "p AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey)"


def _pairs(spark, d) -> DataFrame:
    """Pairs of the 25 nations' names."""
    n = T(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(b, F.col("i") < F.col("j")).select("a", "b")


@query(f"WITH {_PAIRS} SELECT a, b, damerau_levenshtein(a, b)::BIGINT AS damerau, levenshtein(a, b)::INT AS plain FROM p")
def correct_edit_distance(spark, d):
    return _pairs(spark, d).select("a", "b", damerau_column("a", "b").alias("damerau"), F.levenshtein("a", "b").alias("plain"))


@query("""WITH RECURSIVE p AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey),
r AS (SELECT a, b, 0 AS i, [0 FOR x IN range(length(b) + 1)] AS row FROM p
UNION ALL SELECT a, b, i + 1, list_reduce([[x] FOR x IN range(1, length(b) + 1)], lambda acc, y: list_append(CASE WHEN len(acc) = 1 AND y[1] = 2 THEN [0, CASE WHEN substr(a, i + 1, 1) = substr(b, 1, 1) THEN 1 ELSE row[2] END] ELSE acc END,
 CASE WHEN substr(a, i + 1, 1) = substr(b, y[1]::INT, 1) THEN row[y[1]] + 1 ELSE greatest(row[y[1] + 1], (CASE WHEN len(acc) = 1 AND y[1] = 2 THEN CASE WHEN substr(a, i + 1, 1) = substr(b, 1, 1) THEN 1 ELSE row[2] END ELSE acc[len(acc)] END)) END)) AS row FROM r WHERE i < length(a))
SELECT a, b, row[len(row)]::INT AS n, (length(a) + length(b) - 2 * row[len(row)])::INT AS rest FROM r WHERE i = length(a)""")
def correct_lcs(spark, d):
    return _pairs(spark, d).select("a", "b", F.length(lcs_column("a", "b")).alias("n"), F.length(remainder_column("a", "b")).alias("rest"))


@query(f"""WITH {_ASKED}, {_WORDS}, g(a, b) AS (VALUES ('e', 'i'), ('i', 'e')), p AS (SELECT word, weight, unnest(range(1, length(word) + 1)) AS i FROM w),
s AS (SELECT DISTINCT word, weight, substr(word, 1, i - 1) || b || substr(word, i + 1) AS other FROM p JOIN g ON substr(word, i, 1) = a),
t AS (SELECT query, word AS output, weight, 2 AS tier FROM q JOIN w ON query = word UNION ALL SELECT query, word, weight, 4 FROM q JOIN s ON query = other),
m AS (SELECT query, min(tier) AS tier FROM t GROUP BY query)
SELECT q.query, m.tier, coalesce(string_agg(t.output, '|' ORDER BY weight DESC, t.output), '') AS candidates FROM q LEFT JOIN m ON q.query = m.query LEFT JOIN t ON t.query = m.query AND t.tier = m.tier GROUP BY ALL""")
def correct_cascade(spark, d):
    queries, words = _asked(spark, d), _words(spark, d)
    groups = spark.createDataFrame([(["e", "i"],)], "members array<string>")
    similar = correct.similar_words(words, groups).join(words, "word").select(F.col("similar").alias("similar_word"), F.col("word").alias("output"), "weight")
    out = correct.cascade(queries, correct.exact(queries, words), correct.similar_form(queries, similar))
    return out.select("query", "tier", F.array_join("candidates", "|").alias("candidates"))


@query("""WITH r AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'course' ELSE 'org' END AS domain, p_name AS word, p_partkey AS num FROM part), s AS (SELECT domain, word, sum(num) AS n FROM r GROUP BY ALL), t AS (SELECT domain, max(n) AS most FROM s GROUP BY domain)
SELECT word, max(ceil(CASE domain WHEN 'course' THEN 2000.0 ELSE 20.0 END + CASE domain WHEN 'course' THEN 8000.0 ELSE 80.0 END * n / most))::BIGINT AS weight FROM s JOIN t USING (domain) GROUP BY word""")
def domain_weight_scaling(spark, d):
    rows = T(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, "course").otherwise("org").alias("domain"), F.col("p_name").alias("name"), F.col("p_partkey").alias("num"))
    return correct.domain_weights(rows)


@query()
def correct_chinese(spark, d):
    """The whole cascade over a small table of Chinese words; there is no Chinese text among the tables."""
    table = spark.createDataFrame([("计", "ji"), ("算", "suan"), ("机", "ji"), ("记", "ji"), ("基", "ji"), ("础", "chu"), ("物", "wu"), ("理", "li"), ("李", "li")], "char string, reading string")
    words = spark.createDataFrame([("计算机", 500), ("计算机基础", 300), ("物理", 200)], "word string, weight long")
    groups = spark.createDataFrame([(["物", "勿"],)], "members array<string>")
    by_sound, by_form = correct.expand_words(words, table, groups)
    forced = spark.createDataFrame([("电脑", "计算机")], "word string, output string")
    queries = spark.createDataFrame([("计算机",), ("记算机",), ("勿理",), ("计算基础",), ("电脑",), ("zzz",), ("",)], "query string")
    return correct.correct(queries, forced, words, by_sound, by_form, table).select("query", "status", "tier", F.array_join("candidates", "|").alias("candidates"))


# ---- suggestion ----------------------------------------------------------------------------------------------------


def _entries(spark, d) -> DataFrame:
    return T(spark, d, "part").select(F.lit("platform").alias("dict"), F.lower("p_name").alias("input"), F.col("p_name").alias("output"), F.col("p_partkey").alias("weight"))


@query("SELECT p_name AS output, max(p_partkey) AS weight FROM part WHERE starts_with(lower(p_name), 'bl') AND p_name <> 'bl' GROUP BY p_name ORDER BY weight DESC, output LIMIT 5")
def suggest_prefix_topk(spark, d):
    return suggest.complete(_entries(spark, d), "bl", 5, "platform")


@query("""WITH q AS (SELECT DISTINCT substr(p_name, 1, 2) AS query FROM part), h AS (SELECT query, p_name AS output, max(p_partkey) AS weight FROM q JOIN part ON starts_with(lower(p_name), lower(query)) GROUP BY ALL)
SELECT query, output, weight, k::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY weight DESC, output) AS k FROM h) WHERE k <= 3""")
def suggest_prefix_table(spark, d):
    asked = T(spark, d, "part").select(F.substring("p_name", 1, 2).alias("query")).distinct()
    return suggest.complete_many(_entries(spark, d), asked, 3).select("query", "output", "weight", "place")


@query(f"""WITH x AS (SELECT CASE lang WHEN 'en' THEN 'about' WHEN 'de' THEN 'chapter' ELSE 'sequential' END AS category, text AS value FROM documents UNION ALL SELECT 'course_name', p_name FROM part),
w AS (SELECT unnest({_tokens('value')}) AS input, CASE category WHEN 'course_name' THEN 10000 WHEN 'about' THEN 9995 WHEN 'chapter' THEN 9990 ELSE 9985 END AS weight FROM x UNION ALL SELECT lower(p_name), 10000 FROM part)
SELECT input, max(weight) AS weight FROM w WHERE length(input) BETWEEN 2 AND 50 AND input NOT IN ('the', 'of', 'and', 'der', 'die', 'les') GROUP BY input""")
def suggest_main_dict(spark, d):
    docs, part = T(spark, d, "documents"), T(spark, d, "part")
    category = F.when(F.col("lang") == "en", "about").when(F.col("lang") == "de", "chapter").otherwise("sequential")
    rows = docs.select(category.alias("category"), F.col("text").alias("value")).unionByName(part.select(F.lit("course_name").alias("category"), F.col("p_name").alias("value")))
    stop = spark.createDataFrame([(w,) for w in ("the", "of", "and", "der", "die", "les")], "word string")
    return suggest.main_dictionary(rows, text.latin_tokens(F.col("value")), stop)


@query("SELECT DISTINCT p_partkey, phrase FROM part JOIN (VALUES ('ed wid'), ('blue'), ('all ri'), ('zzz'), ('t gear')) v(phrase) ON contains(lower(p_name), phrase)")
def suggest_phrase_match(spark, d):
    phrases = spark.createDataFrame([(p,) for p in ("ed wid", "blue", "all ri", "zzz", "t gear")], "phrase string")
    return suggest.phrase_matches(T(spark, d, "part").select("p_partkey", F.col("p_name").alias("value")), phrases).select("p_partkey", "phrase")


@query(r"""SELECT lower(c_name) AS input, c_name AS output, c_custkey AS user_id, (10000 - 2 * length(c_name))::INT AS weight FROM (SELECT c_name, min(c_custkey) AS c_custkey FROM customer WHERE NOT regexp_matches(c_name, '[\t\n]') GROUP BY c_name)""")
def suggest_user_dict(spark, d):
    users = T(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("nickname"))
    return suggest.user_dictionary(users)


@query("SELECT p_name AS input, p_name AS output, p_partkey AS course_id, coalesce(n, 0) + 100 AS weight FROM (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name) LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey")
def suggest_course_dict(spark, d):
    counts = T(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return suggest.course_dictionary(T(spark, d, "part").join(counts, "p_partkey", "left"), "p_partkey", "p_name", "n")


@query("""WITH e AS (SELECT DISTINCT p_name AS output, string_split(p_name, ' ') AS s FROM part), b AS (SELECT output, output AS input, 1000.0 AS weight FROM e UNION ALL SELECT output, array_to_string(s, ''), 999 FROM e UNION ALL SELECT output, array_to_string([substr(x, 1, 1) FOR x IN s], ''), 998 FROM e)
SELECT input, output, max(weight)::DOUBLE AS weight FROM b WHERE length(input) BETWEEN 2 AND 50 GROUP BY ALL""")
def suggest_expand_weights(spark, d):
    rows = T(spark, d, "part").select(F.col("p_name").alias("input"), F.col("p_name").alias("output"), F.split("p_name", " ").alias("syllables"), F.lit(1000).alias("weight")).distinct()
    return suggest.expand(rows, "syllables", suggest.EXPANSIONS["forum_user"])


@query("SELECT DISTINCT p_name AS word, 'kept' AS state FROM part WHERE p_name NOT LIKE 'red%' UNION ALL SELECT DISTINCT p_name, 'new' FROM part WHERE p_name LIKE 'blue%'")
def suggest_offline_filter(spark, d):
    words = T(spark, d, "part").select(F.col("p_name").alias("word")).distinct()
    known = words.where("word not like 'blue%'").select("word", F.when(F.col("word").like("red%"), 0).otherwise(5).alias("num"))
    kept, new = suggest.offline_filter(words, known)
    return kept.select("word", F.lit("kept").alias("state")).unionByName(new.select("word", F.lit("new").alias("state")))


# ---- related searches ----------------------------------------------------------------------------------------------

_TERMS = f"""t AS (SELECT conv_id AS course_id, unnest({_tokens('text')}) AS term, CASE role WHEN 'user' THEN 10 ELSE 2 END AS weight FROM conversations),
n AS (SELECT course_id, term, max(weight) AS kind, count(*) AS num FROM t WHERE regexp_full_match(term, '[a-z][a-z]+') GROUP BY ALL), z AS (SELECT course_id, sum(num) AS size FROM n GROUP BY course_id),
s AS (SELECT n.course_id, term, kind, num, num / size * CASE WHEN size < 20 THEN 100.0 ELSE 1.0 END AS tf FROM n JOIN z USING (course_id)),
g AS (SELECT term, sum(tf) AS tf, count(*) AS df, min_by(kind, course_id) AS kind, min_by(num, course_id) AS num FROM s GROUP BY term)"""


def _stats(spark, d) -> DataFrame:
    rows = T(spark, d, "conversations").select(F.col("conv_id").alias("course_id"), F.explode(text.latin_tokens(F.col("text"))).alias("term"), F.when(F.col("role") == "user", 10).otherwise(2).alias("weight"))
    return related.term_stats(rows.where(F.col("term").rlike("^[a-z]{2,}$")))


@query(f"WITH {_TERMS} SELECT term, round(tf, 6) AS tf, df, kind, num FROM g")
def related_tfidf(spark, d):
    return related.nodes(_stats(spark, d)).withColumn("tf", F.round("tf", 6))


def _courses(spark, d) -> int:
    return T(spark, d, "conversations").select("conv_id").distinct().count()


_EDGES = f"""{_TERMS}, k AS (SELECT course_id, term FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY tf DESC, term) AS r FROM s) WHERE r <= 25), e AS (SELECT DISTINCT a.term AS src, b.term AS dst FROM k a JOIN k b ON a.course_id = b.course_id AND a.term <> b.term),
x AS (SELECT term, kind * tf / (df + 1) / (SELECT count(DISTINCT conv_id) FROM conversations) AS st, df FROM g), v AS (SELECT src, dst, a.st AS a, b.st AS b, b.df AS df, greatest(length(src), length(dst)) AS l FROM e JOIN x a ON src = a.term JOIN x b ON dst = b.term),
f AS (SELECT src, dst, df, CASE WHEN a = 0 OR b = 0 THEN 0 ELSE (20 * a + 50 * b + 0.4 * ((l - levenshtein(src, dst)) / l) + CASE WHEN contains(dst, src) THEN 0.3 ELSE 0 END - CASE WHEN contains(src, dst) THEN 100 ELSE 0 END) / 10 END AS score FROM v)"""


@query(f"WITH {_EDGES} SELECT src, dst, round(score, 6)::DOUBLE AS score FROM f")
def related_edges(spark, d):
    stats = _stats(spark, d)
    return related.edge_scores(related.edges(stats, 25), related.nodes(stats), _courses(spark, d)).withColumn("score", F.round("score", 6))


@query("""WITH RECURSIVE l AS (SELECT user_id, epoch(ts)::DOUBLE AS ts, event_type AS query, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS i FROM events),
r AS (SELECT user_id, i, query AS anchor, ts AS seen, NULL::VARCHAR AS hit, 0.0::DOUBLE AS t FROM l WHERE i = 1
UNION ALL SELECT l.user_id, l.i, CASE WHEN l.query = anchor OR l.ts - seen >= 20000 THEN l.query ELSE anchor END, CASE WHEN l.query = anchor THEN CASE WHEN l.ts - seen > 4 THEN l.ts ELSE seen END WHEN l.ts - seen >= 20000 THEN l.ts ELSE seen END,
 CASE WHEN l.query <> anchor AND l.ts - seen < 20000 THEN l.query END, greatest(1.0, l.ts - seen) FROM r JOIN l ON l.user_id = r.user_id AND l.i = r.i + 1),
e AS (SELECT anchor AS src, hit AS dst, 10 / t AS score FROM r WHERE hit IS NOT NULL UNION ALL SELECT hit, anchor, 2 / t FROM r WHERE hit IS NOT NULL)
SELECT src, dst, round(sum(score), 6) AS score FROM e GROUP BY ALL""")
def related_session_edges(spark, d):
    log = T(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_type").alias("query"))
    return related.session_edges(log, gap=20000).withColumn("score", F.round("score", 6))


@query(f"""WITH {_EDGES}, y AS (SELECT src, lower(dst) AS dst, sum(score * log10((SELECT count(DISTINCT conv_id) FROM conversations)::DOUBLE / (1 + df)) * (1 + log10(1 + CASE WHEN dst = 'the' THEN 3 WHEN dst = 'tion' THEN 1 ELSE 0 END))) AS score FROM f GROUP BY ALL)
SELECT src, dst, place FROM (SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst))::INT AS place FROM y) WHERE place <= 10""")
def related_scored_top10(spark, d):
    docs = _courses(spark, d)
    stats = _stats(spark, d)
    nodes = related.nodes(stats)
    edges = related.edge_scores(related.edges(stats, 25), nodes, docs)
    log = spark.createDataFrame([("the",)] * 3 + [("tion",)], "query string")
    rows = related.related(edges, nodes, related.search_counts(log, nodes), docs, most=10_000)
    place = F.row_number().over(_by_score())
    return rows.withColumn("place", place).where("place <= 10").select("src", "dst", "place")


def _by_score():
    from pyspark.sql import Window

    return Window.partitionBy("src").orderBy(F.desc(F.round("score", 9)), "dst")


@query("WITH e AS (SELECT o_custkey AS src, o_orderstatus AS dst, count(*) AS score FROM orders GROUP BY ALL) SELECT src::VARCHAR AS word, string_agg(dst, '|' ORDER BY score DESC, dst) AS result FROM e WHERE dst <> 'P' GROUP BY src")
def related_serve(spark, d):
    from pyspark.sql import Window

    edges = T(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("src"), F.col("o_orderstatus").alias("dst")).agg(F.count("*").alias("score"))
    terms = edges.select(F.col("dst").alias("term")).distinct()
    _, edges = related.delete_node(terms, edges, spark.createDataFrame([("P",)], "term string"))
    rows = edges.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst")))
    return related.serve(rows).select("word", F.array_join(F.transform("result", lambda x: x["word"]), "|").alias("result"))


# ---- highlighting and pinyin ---------------------------------------------------------------------------------------


@query("SELECT p_partkey, regexp_replace(p_name, '(widget|gear|red|ri|a)', '<span class=\"keyword\">\\1</span>', 'gi') AS marked FROM part")
def highlight_short(spark, d):
    return T(spark, d, "part").select("p_partkey", highlight.highlight_short(F.col("p_name"), ["a", "red", "widget", "gear", "ri"]).alias("marked"))


@query()
def highlight_window(spark, d):
    """Windows of long documents; the rule goes through a text segment by segment, which SQL does not express."""
    mark = highlight.highlight_column(["thon", "tion", "the"])
    return T(spark, d, "documents").select("doc_id", F.md5(mark("text")).alias("marked"))


@query("SELECT * FROM (VALUES ('chuang', 'chuan|cuan|cuang'), ('zhong', 'zong'), ('an', 'ang'), ('ba', '')) v(s, other)")
def pinyin_fuzzy(spark, d):
    rows = spark.createDataFrame([("chuang",), ("zhong",), ("an",), ("ba",)], "s string")
    return rows.select("s", F.array_join(pinyin.fuzzy_column(F.col("s"), every=True), "|").alias("other"))
