"""Related searches: a graph of terms from course texts and from sessions of queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import runs

# Fixed values of the service: weights of kinds of terms, terms of a short course, gaps in seconds, page sizes.
NAME_WEIGHT, STAFF_WEIGHT, STRUCTURE_WEIGHT, WORD_WEIGHT = 10, 3, 2, 1
SHORT, SHORT_FACTOR, GAP, SAME_GAP, TOP, HAS_RESULT = 20, 100.0, 90, 4, 10, 300.0
#: Parts of a course's terms, each of which is paired with all its terms by itself.
BLOCKS = 8


def bigrams(tokens: Column) -> Column:
    """Unigrams and neighbouring pairs."""
    return F.concat(tokens, runs(tokens, 2))


def term_stats(terms: DataFrame) -> DataFrame:
    """course_id, term, kind, num, tf from course_id, term, weight (a row for each occurrence).

    tf is a term's share of the course's occurrences, a hundredfold in courses
    with fewer than twenty.
    """
    by = terms.groupBy("course_id", "term").agg(F.max("weight").alias("kind"), F.count("*").alias("num"))
    sizes = by.groupBy("course_id").agg(F.sum("num").alias("size"))
    factor = F.when(F.col("size") < SHORT, F.lit(SHORT_FACTOR)).otherwise(1.0)
    return by.join(sizes, "course_id").select("course_id", "term", "kind", "num", (F.col("num") / F.col("size") * factor).alias("tf"))


def nodes(stats: DataFrame) -> DataFrame:
    """term, tf, df, kind, num: summed over courses; kind and number are those of the smallest course id."""
    first = F.min(F.struct("course_id", "kind", "num"))
    rows = stats.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"), first.alias("x"))
    return rows.select("term", "tf", "df", F.col("x.kind").alias("kind"), F.col("x.num").alias("num"))


def edges(stats: DataFrame, most: int | None = None) -> DataFrame:
    """src, dst: ordered pairs of different terms of one course; once for all courses.

    Of all terms of each course, or of its ``most`` terms by tf.  A course's
    pairs are as many as its terms squared: its terms stand on one side in
    BLOCKS parts, so that several tasks make the pairs of a large course.
    """
    kept = stats.select("course_id", "term")
    if most is not None:
        place = F.row_number().over(Window.partitionBy("course_id").orderBy(F.desc("tf"), "term"))
        kept = stats.withColumn("place", place).where(F.col("place") <= most).select("course_id", "term")
    part = F.pmod(F.xxhash64("term"), F.lit(BLOCKS))
    a = kept.select("course_id", F.col("term").alias("src"), part.alias("part"))
    b = kept.select("course_id", F.col("term").alias("dst"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))).alias("part"))
    return a.join(b, ["course_id", "part"]).where("src <> dst").select("src", "dst").distinct()


def edge_scores(pairs: DataFrame, terms: DataFrame, docs: int) -> DataFrame:
    """src, dst, score: both terms' strengths, edit similarity, and containment one way or the other."""
    strength = F.col("kind") * F.col("tf") / (F.col("df") + 1) / F.lit(docs)
    s = terms.select("term", strength.alias("s"))
    rows = pairs.join(s.withColumnsRenamed({"term": "src", "s": "a"}), "src").join(s.withColumnsRenamed({"term": "dst", "s": "b"}), "dst")
    longest = F.greatest(F.length("src"), F.length("dst"))
    similar = (longest - F.levenshtein("src", "dst")) / longest
    inside = F.when(F.instr("dst", F.col("src")) > 0, 1.0).otherwise(0.0)
    around = F.when(F.instr("src", F.col("dst")) > 0, 1.0).otherwise(0.0)
    score = (F.lit(20.0) * F.col("a") + F.lit(50.0) * F.col("b") + 0.4 * similar + 0.3 * inside - 100.0 * around) / 10
    return rows.select("src", "dst", F.when((F.col("a") == 0) | (F.col("b") == 0), 0.0).otherwise(score).alias("score"))


def clean_log_query(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("+"), F.lit(" ")))


def _session_pairs(gap: float, same_gap: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come piece by piece in order; the anchor stays while queries follow within the gap
        piece, anchor, at = None, None, 0.0
        for rows in batches:
            out = []
            for key, ts, query in zip(zip(rows["session"], rows["piece"]), rows["ts"], rows["query"]):
                t = ts - at
                if key != piece:
                    piece, anchor, at = key, query, ts
                elif query == anchor:
                    at = ts if t > same_gap else at
                elif t < gap:
                    t = max(1.0, t)
                    out += [(anchor, query, 10.0 / t), (query, anchor, 2.0 / t)]
                else:
                    anchor, at = query, ts
            yield pd.DataFrame(out, columns=["src", "dst", "score"])

    return run


def session_edges(log: DataFrame, gap: float = GAP, same_gap: float = SAME_GAP) -> DataFrame:
    """src, dst, score summed over sessions from session, ts (seconds), query.

    A session breaks where more than the gap lies between two rows, as no state
    reaches across it; the pieces are what tasks are dealt, so that a session
    of any length is never gathered whole unless its rows follow that closely.
    """
    rows = log.select("session", F.col("ts").cast("double").alias("ts"), clean_log_query(F.col("query")).alias("query"))
    before = F.lag("ts").over(Window.partitionBy("session").orderBy("ts", "query"))
    fresh = F.when(before.isNull() | (F.col("ts") - before >= max(gap, same_gap)), 1).otherwise(0)
    rows = rows.withColumn("fresh", fresh)
    piece = F.sum("fresh").over(Window.partitionBy("session").orderBy("ts", "query").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("piece", piece)
    dealt = rows.select("session", "piece", "ts", "query").repartition("session", "piece").sortWithinPartitions("session", "piece", "ts", "query")
    found = dealt.mapInPandas(_session_pairs(gap, same_gap), "src string, dst string, score double")
    return found.groupBy("src", "dst").agg(F.sum("score").alias("score"))


def merge_edges(*parts: DataFrame) -> DataFrame:
    rows = parts[0].select("src", "dst", "score")
    for p in parts[1:]:
        rows = rows.unionByName(p.select("src", "dst", "score"))
    return rows.groupBy("src", "dst").agg(F.sum("score").alias("score"))


def search_counts(log: DataFrame, terms: DataFrame) -> DataFrame:
    """term, search_num: how often a term was asked for; a query that is no term yet starts at one for its second."""
    asked = log.select(clean_log_query(F.col("query")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    known = terms.select("term", F.lit(1).alias("known"))
    return asked.join(known, "term", "left").select("term", (F.col("n") - F.when(F.col("known").isNull(), 1).otherwise(0)).alias("search_num"))


def normal_term(c: Column) -> Column:
    return F.when(c.rlike("^[一-龥]"), F.replace(c, F.lit(" "), F.lit(""))).otherwise(F.lower(c))


def related(edges_: DataFrame, terms: DataFrame, searches: DataFrame, docs: int, most: int = TOP) -> DataFrame:
    """src, dst, score, place: the best related terms, spellings of one term added up."""
    idf = F.log10(F.lit(float(docs)) / (1 + F.coalesce("df", F.lit(0))))
    popular = 1 + F.log10(1 + F.coalesce("search_num", F.lit(0)))
    rows = edges_.join(terms.select(F.col("term").alias("dst"), "df"), "dst", "left").join(searches.withColumnRenamed("term", "dst"), "dst", "left")
    rows = rows.select("src", normal_term(F.col("dst")).alias("dst"), (F.col("score") * idf * popular).alias("score")).groupBy("src", "dst").agg(F.sum("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def with_results(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Related terms whose own page of hits (dst, score) sums to enough."""
    enough = hits.groupBy("dst").agg(F.sum("score").alias("total")).where(F.col("total") > HAS_RESULT)
    return rows.join(enough.select("dst"), "dst", "left_semi")


def serve(result: DataFrame, most: int = 8) -> DataFrame:
    """word, result: an array of (word, score) for each source term."""
    rows = result.where(F.col("place") <= most).groupBy(F.col("src").alias("word"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "dst", "score"))), lambda x: F.struct(x["dst"].alias("word"), x["score"].alias("score"))).alias("result"))


def delete_node(terms: DataFrame, edges_: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms and edges without the given terms."""
    gone = gone.select("term").distinct()
    left = edges_.join(gone.withColumnRenamed("term", "src"), "src", "left_anti").join(gone.withColumnRenamed("term", "dst"), "dst", "left_anti")
    return terms.join(gone, "term", "left_anti"), left
