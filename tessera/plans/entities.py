"""Search by category, and of organisations, staff and credit courses; what the home page counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import latin_tokens
from tessera.operators import filters, page, retrieve


def engineer_search(courses: DataFrame, categories: DataFrame, cid=None, group: str | None = None, phase: int = 0, as_of="2016-01-01 00:00:00") -> DataFrame:
    """Courses with status >= 0 and a category child that matches, by phase; no score."""
    kept = filters.combine(courses, filters.at_least("status", 0), filters.process("start", "end", phase, as_of) if phase else None)
    children = filters.combine(categories, F.col("group") == group if group else None, filters.any_of_array("cid", cid) if cid else None)
    return kept.join(children.select("course_id"), "course_id", "left_semi")


def home_counts(hits: DataFrame, shown: str, order: list, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """The page of the kind that is shown, and the totals of every kind."""
    return page.page(hits.where(F.col("item_type") == shown), order, size=size), page.totals(hits)


#: For each kind of entity: least score, the count that must be at least one, and whether a match is required.
ENTITIES = {"org": (retrieve.MIN_SCORE, "course_num", True), "staff": (retrieve.MIN_SCORE, "staffinfo_course_num", True), "credit_course": (0.0, None, False)}


def entity_search(rows: DataFrame, kind: str, key: str, field: str, clauses: DataFrame, must_p: int, should_p: int, params: dict | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """key, score of entities; a query with a slash is one whole-field term.

    Credit courses keep every row that the filters leave, with score zero where
    nothing matches.
    """
    least, count, required = ENTITIES[kind]
    kept = filters.combine(rows, *filters.table_driven(params or {}, columns or filters.CREDIT_LISTS), filters.at_least(count, 1) if count and count in rows.columns else None)
    scores = retrieve.token_scores(kept, [key], field, clauses)
    hits = retrieve.boolean_scores(scores, [key], clauses, must_p, should_p, least)
    return hits if required else kept.select(key).join(hits, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def whole_field(rows: DataFrame, key: str, field: str, query: str) -> DataFrame:
    """Rows whose field is the query, whatever the case: how a query with a slash is taken."""
    return rows.where(F.lower(field) == query.lower()).select(key, F.lit(1.0).alias("score"))


def credit_rows(rows: DataFrame, as_of, prefix: str = "cc_") -> DataFrame:
    """Prefix off, stages and weights zipped, time_status added."""
    plain = page.without_prefix(rows, prefix)
    zipped = F.transform(F.arrays_zip("stage", "stage_weight"), lambda x: F.struct(x["stage"].alias("name"), x["stage_weight"].alias("weight")))
    return plain.withColumn("stages", zipped).withColumn("time_status", page.time_status("start", "end", as_of)).drop("stage", "stage_weight")


def parent_names(rows: DataFrame, key: str, ids: str, categories: DataFrame) -> DataFrame:
    """key, first_category: for each id in an array the name of its category's parent, null where unknown, in order."""
    at = rows.select(key, F.posexplode(ids).alias("pos", "id"))
    up = categories.select(F.col("id"), F.col("parent_id")).join(categories.select(F.col("id").alias("parent_id"), F.col("name").alias("up")), "parent_id", "left").select("id", "up")
    named = at.join(up, "id", "left")
    return named.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "up"))), lambda x: x["up"]).alias("first_category"))


#: So many tokens of queries at most are looked for inside the texts; where there are more, a join finds them.
FEW_TOKENS = 1000


def hits_per_query(queries: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """query_id, hits: documents that have all of a query's tokens, for a table of queries (query_id, query); rows of one key are one document.

    Queries of the same tokens are looked up once, and documents that have the
    same of the tokens asked for become one row with a count.  A query meets the
    documents of its rarest token; the others are looked for in those.
    """
    # tokens that depend on a count: no filter on them moves below it, so all that follows shares one exchange
    distinct = queries.where("query is not null").groupBy("query").agg(F.count("*").alias("n"))
    asked = distinct.select("query", F.when(F.col("n") > 0, F.array_sort(F.array_distinct(latin_tokens(F.col("query"))))).alias("t"))
    sets = asked.where("size(t) > 0").select("t").distinct()
    each = sets.select("t", F.explode("t").alias("token"))
    # one row; with more tokens than that the texts keep all of theirs
    few = each.select("token").distinct().limit(FEW_TOKENS + 1).agg(F.collect_list("token").alias("few"))
    texts = docs.select(F.col(key).alias("doc"), latin_tokens(F.col(text)).alias("has")).join(F.broadcast(few))
    inside = texts.select("doc", F.explode(F.when(F.size("few") > FEW_TOKENS, F.array_distinct("has")).otherwise(F.array_intersect("has", "few"))).alias("token"))
    alike = inside.groupBy("doc").agg(F.array_sort(F.collect_set("token")).alias("has")).groupBy("has").agg(F.count("*").alias("c"), F.min("doc").alias("doc"))
    post = alike.select("doc", "c", F.explode("has").alias("token"))
    df = post.groupBy("token").agg(F.sum("c").alias("df"))
    known = each.join(df, "token").groupBy("t").agg(F.count("*").alias("n"), F.min(F.struct("df", "token")).alias("rare")).where("n = size(t)")
    one = known.where("n = 1").select("t", F.col("rare.df").alias("hits"))
    met = known.where("n > 1").select("t", "n", F.col("rare.token").alias("token")).join(post, "token")
    rest = met.select("t", "n", "doc", "c", F.explode(F.array_remove("t", F.col("token"))).alias("token"))
    there = post.select(F.col("doc").alias("_doc"), F.col("token").alias("_token"))
    rest = rest.join(there, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("token") == F.col("_token")), "left_semi")
    full = rest.groupBy("t", "n", "doc", "c").agg(F.count("*").alias("k")).where("k = n - 1")
    found = one.unionByName(full.groupBy("t").agg(F.sum("c").alias("hits")))
    hits = asked.join(found, "t").select("query", "hits")
    # a query without an id has no hits, as in a join on it
    own = F.when(F.col("query_id").isNotNull(), F.col("hits"))
    return queries.select("query_id", "query").join(hits, "query", "left").select("query_id", F.coalesce(own, F.lit(0)).alias("hits"))


def best_word(words: DataFrame, query: str, tokens: list[str], clauses: DataFrame) -> DataFrame:
    """The entry whose word matches the query best."""
    hits = retrieve.boolean_scores(retrieve.token_scores(words, ["word"], "word", clauses), ["word"], clauses, 0, 1, 0.0)
    return page.page(hits, page.relevance("word"), size=1)


def union_children(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str = "course_id") -> DataFrame:
    """child_type, key, text of several kinds of children whose parent is among the parents."""
    out = None
    for kind, (rows, field) in children.items():
        part = retrieve.has_parent(rows, parents, key).select(F.lit(kind).alias("child_type"), key, F.col(field).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def text_dump(parts: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """key, category, value of every text there is, by category."""
    out = None
    for category, (rows, field) in parts.items():
        part = rows.where(F.col(field).isNotNull()).select(key, F.lit(category).alias("category"), F.col(field).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def rebuild(ids: DataFrame, sources: DataFrame, key: str = "course_id") -> tuple[DataFrame, DataFrame]:
    """(rows to write, key and status of every id asked for: 1 rebuilt, 0 unknown, -1 blank)."""
    from tessera.operators.cdc import update_status

    wanted = ids.select(key).distinct()
    return sources.join(wanted, key, "left_semi"), update_status(wanted, sources, key)
