"""From a request to a page of hits: plan, strict and relaxed search, totals, enrichment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import filters, page, planner, retrieve
from tessera.plans.request import LISTED_ORGS, QUERY_TYPES, SCORE, SearchRequest


@dataclass
class Catalogue:
    """courses (course_id and what filters read), children (course_id, child_id, kind, text), and stand-alone
    documents by kind (doc_id, text): knowledge, live, microdegree."""

    courses: DataFrame
    children: DataFrame
    others: dict[str, DataFrame]


def course_filter(courses: DataFrame, request: SearchRequest, as_of) -> DataFrame:
    """The courses that a request's filters leave, for semi joins before anything is scored."""
    r, has = request, set(courses.columns)
    given = {
        "owner": filters.one_or_many("owner", r.owner) if r.owner else None,
        "org": filters.org("org", r.org, LISTED_ORGS) if r.org else None,
        "cid": filters.any_of_array("cid", r.cid) if r.cid and not r.group else None,
        "serialized": filters.at_least("serialized", r.serialized) if r.serialized is not None else None,
        "course_type": filters.three_way("course_type", r.course_type),
        "is_paid_only": filters.three_way("is_paid_only", r.is_paid_only),
        "course_id": F.col("course_id") == r.course_id if r.course_id else None,
        "start": filters.process("start", "end", r.process, as_of),
        "mode": filters.any_of_array("mode", r.mode) if r.mode else None,
        "expire": filters.expiration("expire", "start", r.expiration, as_of) if r.expiration is not None else None,
        "status": filters.platform_status("status", r.platform),
    }
    if r.hasTA:
        courses = courses.where(filters.has_assistant("owner", "start", "end", as_of))
    return filters.combine(courses, *[p for c, p in given.items() if c in has])


def _clauses(spark: SparkSession, plan: planner.QueryPlan) -> DataFrame:
    return spark.createDataFrame(plan.clauses() or [("", 0.0, "should")], "token string, weight double, clause string")


def _names(plan: planner.QueryPlan) -> list[str]:
    return [t for t, _, _ in plan.clauses()]


def search_courses(catalogue: Catalogue, plan: planner.QueryPlan, kept: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """course_id, score: each token's child scores, by the kind's weight, summed over a course's children."""
    spark = kept.sparkSession
    clauses = _clauses(spark, plan)
    children = retrieve.has_parent(catalogue.children, kept, "course_id")
    scores = retrieve.token_scores(children, ["course_id", "child_id", "kind"], "text", _names(plan))
    table = spark.createDataFrame(list((weights or retrieve.child_weights()).items()), "kind string, share double")
    scores = scores.join(F.broadcast(table), "kind").groupBy("course_id", "token").agg(F.sum(F.col("score") * F.col("share")).alias("score"))
    return retrieve.boolean_scores(scores, ["course_id"], clauses, plan.must_p, plan.should_p)


def search_others(docs: DataFrame, kind: str, plan: planner.QueryPlan) -> DataFrame:
    clauses = _clauses(docs.sparkSession, plan)
    scores = retrieve.token_scores(docs, ["doc_id"], "text", _names(plan)).withColumn("score", F.col("score") * retrieve.OTHER_WEIGHTS[kind])
    return retrieve.boolean_scores(scores, ["doc_id"], clauses, plan.must_p, plan.should_p)


def search(catalogue: Catalogue, request: SearchRequest, weights: dict[str, float], as_of) -> tuple[DataFrame, DataFrame]:
    """(page of item_type, id, score; totals by type).  The query's token weights come from the planner's columns.

    Only whether a strict search has any hit is decided on the driver.
    """
    kept = course_filter(catalogue.courses, request, as_of)
    kind = QUERY_TYPES[request.qt]
    if request.st != SCORE:
        hits = kept.select(F.lit("course").alias("item_type"), F.col("course_id").cast("string").alias("id"), *[c for c in ("accumulate_num", "status") if c in kept.columns])
        order = page.natural(*[c for c in ("accumulate_num", "status") if c in kept.columns], key="id")
        return page.page(hits, order, request.pn, request.num, request.offset), page.totals(hits)
    plan = planner.plan_query(request.query, weights, request.persent)
    shares = retrieve.child_weights(request.fields_v == 1)

    def run(p: planner.QueryPlan) -> DataFrame:
        parts = {}
        if kind in ("mix", "course"):
            parts["course"] = search_courses(catalogue, p, kept, shares).select(F.col("course_id").cast("string").alias("id"), "score")
        for k, docs in catalogue.others.items():
            if kind in ("mix", k):
                parts[k] = search_others(docs, k, p).select(F.col("doc_id").cast("string").alias("id"), "score")
        return retrieve.mixed(parts, "id")

    hits = run(plan)
    if request.persent < 10 and (not request.home or kind == "mix") and not hits.take(1):
        hits = run(planner.relaxed(plan))
    return page.page(hits, page.relevance("id"), request.pn, request.num, request.offset), page.totals(hits)
