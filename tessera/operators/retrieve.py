"""Weighted-token boolean retrieval with BM25 over one or many fields and child documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import latin_tokens

K1, B = 1.2, 0.75
#: Fixed values of the service: least score of a hit, and the weight of each kind of document and field.
MIN_SCORE = 1.1
COURSE_WEIGHTS = {"title": 170.0, "about": 40.0, "structure": 8.0, "staff": 6.0, "category": 85.0}
OTHER_WEIGHTS = {"knowledge": 85.0, "live": 200.0, "microdegree": 370.0}
#: Nested microdegree fields: the whole share and each field's.
NESTED_SHARE, NESTED_FIELDS = 0.7, (1.0, 0.7, 0.5, 0.7, 0.7)


def child_weights(only_staff: bool = False) -> dict[str, float]:
    """The table of weights, or the variant that searches staff names alone."""
    return {"staff": COURSE_WEIGHTS["staff"]} if only_staff else dict(COURSE_WEIGHTS)


def postings(docs: DataFrame, key: list[str], text: str, tokens: DataFrame | list[str] | None = None, keep_digits: bool = False) -> DataFrame:
    """key columns, token, tf, dl: one row for each distinct token of each document.

    With ``tokens`` only their postings are kept, before anything is shuffled;
    lengths still count every token.  A list is one analysed query (at most six
    tokens and the query itself) and is looked for inside the array, so other
    tokens never become rows.  A table of tokens (column token) may be any size.
    """
    rows = docs.select(*key, latin_tokens(F.col(text), keep_digits).alias("_tokens")).withColumn("dl", F.size("_tokens"))
    if isinstance(tokens, list):
        rows = rows.withColumn("_tokens", F.filter("_tokens", lambda x: x.isin(tokens)))
    rows = rows.select(*key, "dl", F.explode("_tokens").alias("token"))
    if isinstance(tokens, DataFrame):
        rows = rows.join(tokens.select("token").distinct(), "token", "left_semi")
    return rows.groupBy(*key, "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def field_stats(docs: DataFrame, text: str, keep_digits: bool = False) -> DataFrame:
    """n_docs, avgdl of the documents that have any token in the field: one row."""
    size = F.size(latin_tokens(F.col(text), keep_digits))
    return docs.select(size.alias("dl")).where("dl > 0").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def bm25(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def token_scores(docs: DataFrame, key: list[str], text: str, tokens: DataFrame | list[str], keep_digits: bool = False, stats: DataFrame | None = None) -> DataFrame:
    """key columns, token, score: BM25 of each query token in each document that has it.

    ``stats`` is ``field_stats`` if it was stored before; else it costs a pass over the field.
    """
    post = postings(docs, key, text, tokens, keep_digits)
    df = post.groupBy("token").agg(F.count("*").alias("df"))
    stats = field_stats(docs, text, keep_digits) if stats is None else stats
    df = F.broadcast(df) if isinstance(tokens, list) else df  # a row for each token of one query
    joined = post.join(df, "token").join(F.broadcast(stats))  # one row
    return joined.select(*key, "token", bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avgdl")).alias("score"))


def multi_field_scores(docs: DataFrame, key: list[str], fields: list[str], tokens: DataFrame | list[str], best: bool = True) -> DataFrame:
    """A token's score over several fields of one row: the best field's, or with ``best`` off their sum."""
    parts = [token_scores(docs, key, f, tokens) for f in fields]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*key, "token").agg((F.max if best else F.sum)("score").alias("score"))


def boolean_scores(scores: DataFrame, key: list[str], clauses: DataFrame, must_p: int, should_p: int, min_score: float = MIN_SCORE) -> DataFrame:
    """key columns, score of the rows that satisfy the groups.

    ``clauses``: token, weight, clause (must, should or must_not), at most one
    row for each token; a token in two groups counts as must.  A group of
    should only filters if there is no must, and then asks for at least one.
    """
    joined = scores.join(F.broadcast(clauses), "token")  # a query has a handful of clauses
    n = lambda kind: F.count_if(F.col("clause") == kind)
    hits = joined.groupBy(*key).agg(
        F.sum(F.when(F.col("clause") != "must_not", F.col("score") * F.col("weight")).otherwise(0.0)).alias("score"), n("must").alias("_must"), n("should").alias("_should"), n("must_not").alias("_not")
    )
    passed = (F.col("_must") >= must_p) & (F.col("_not") == 0)
    passed &= (F.col("_should") >= max(should_p, 1 if not must_p else 0)) if not must_p or should_p else F.lit(True)
    return hits.where(passed & (F.col("score") >= min_score)).select(*key, "score")


def all_tokens_scores(scores: DataFrame, key: list[str], wanted: int, weight: float) -> DataFrame:
    """Rows that have all of the query's tokens, scored as one clause of this weight."""
    hits = scores.groupBy(*key).agg(F.sum("score").alias("score"), F.count_distinct("token").alias("n"))
    return hits.where(F.col("n") == wanted).select(*key, (F.col("score") * weight).alias("score"))


def has_child(child_scores: DataFrame, parent: str) -> DataFrame:
    """Parents with a matching child, the children's scores summed."""
    return child_scores.groupBy(parent).agg(F.sum("score").alias("score"))


def has_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is among the (filtered) parents; no score."""
    return children.join(parents.select(key), key, "left_semi")


def nested_average(rows: DataFrame, key: str, items: str, predicate, score) -> DataFrame:
    """Rows with a matching element in an array of structs, scored by the average over those elements."""
    hits = F.filter(F.col(items), predicate)
    total = F.aggregate(F.transform(hits, score), F.lit(0.0), lambda a, x: a + x)
    return rows.where(F.exists(F.col(items), predicate)).select(key, (total / F.size(hits)).alias("score"))


def mixed(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Scored hits of several kinds of documents in one list: item_type, key, score."""
    out = None
    for kind, hits in parts.items():
        part = hits.select(F.lit(kind).alias("item_type"), F.col(key), "score").where(F.col("score") >= MIN_SCORE)
        out = part if out is None else out.unionByName(part)
    return out


def with_fallback(strict: DataFrame, relaxed: DataFrame, query: str = "query_id") -> DataFrame:
    """For a table of queries: the relaxed hits of those queries that have no strict hit."""
    missed = relaxed.join(strict.select(query).distinct(), query, "left_anti")
    return strict.withColumn("fallback", F.lit(False)).unionByName(missed.withColumn("fallback", F.lit(True)))
