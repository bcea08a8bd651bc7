"""Orders, pages, totals, facets, enrichment and the shape of results."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.filters import OWN_PLATFORM


def page(rows: DataFrame, order: list, number: int = 0, size: int = 10, offset: int = 0) -> DataFrame:
    """Rows number * size + offset onward, in an order that ends with a unique key."""
    return rows.orderBy(*order).offset(number * size + offset).limit(size)


def relevance(key: str = "doc_id") -> list:
    return [F.desc("score"), F.asc(key)]


def natural(*columns: str, key: str) -> list:
    return [*(F.desc(c) for c in columns), F.desc(key)]


def credit_order(key: str, start: str | None = None, students: str | None = None) -> list:
    """Optional orders of credit courses: time first, then students."""
    return [F.desc(c) for c in (start, students) if c] + [F.asc(key)]


def totals(hits: DataFrame, kind: str = "item_type") -> DataFrame:
    """Hits of each kind, and all of them."""
    by = hits.groupBy(kind).agg(F.count("*").alias("total"))
    return by.unionByName(by.agg(F.lit("all").alias(kind), F.coalesce(F.sum("total"), F.lit(0)).alias("total")))


def facet(rows: DataFrame, ids: str, names: str, most: int = 500, offset: int = 0, size: int = 10) -> DataFrame:
    """cid, cid_name, doc_count of array facets, the frequent first, one page of at most ``most`` buckets."""
    pairs = rows.select(F.explode(F.arrays_zip(F.col(ids).alias("cid"), F.col(names).alias("cid_name"))).alias("x")).select("x.cid", "x.cid_name")
    counts = pairs.groupBy("cid").agg(F.count("*").alias("doc_count"), F.min("cid_name").alias("cid_name"))
    return counts.orderBy(F.desc("doc_count"), "cid").limit(most).offset(offset).limit(size)


def top_per_group(rows: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= most)


def best_child(hits: DataFrame, child_scores: DataFrame, parent: str, kinds: list[str], key: str) -> DataFrame:
    """For each hit on the page the best child of each kind; call it after the limit."""
    children = child_scores.join(hits.select(parent), parent, "left_semi").where(F.col("kind").isin(kinds))
    return top_per_group(children, [parent, "kind"], [F.desc("score"), F.asc(key)], 1).drop("place")


def enrich(hits: DataFrame, rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """A page of hits with columns of another table; the page is small, the table is not."""
    return hits.join(rows.select(key, *columns), key, "left")


def shape_courses(rows: DataFrame, as_of, owner: str, start: str, end: str, own: str = OWN_PLATFORM) -> DataFrame:
    """Adds hasTA (own courses that run now) and shows the newer count of learners under the older name."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    running = (F.col(owner) == own) & (F.col(start) < now) & (F.col(end).isNull() | (F.col(end) > now))
    return rows.withColumn("hasTA", F.coalesce(running, F.lit(False))).withColumn("accumulate_num", F.col("accumulate_num_v2")).drop("accumulate_num_v2")


def time_status(start: str, end: str, as_of):
    """-1 ended, 0 running, 1 future or unknown."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    return F.when(F.col(end) < now, -1).when((F.col(start) <= now) & (F.col(end) >= now), 0).otherwise(1)


def with_prefix(rows: DataFrame, prefix: str, *keep: str) -> DataFrame:
    return rows.withColumnsRenamed({c: prefix + c for c in rows.columns if c not in keep})


def without_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.withColumnsRenamed({c: c.removeprefix(prefix) for c in rows.columns})


@dataclass
class Envelope:
    """What a request answers: a page, totals and an error code (0: none)."""

    data: list = field(default_factory=list)
    total: dict = field(default_factory=dict)
    error_code: int = 0
    error_msg: str = ""

    @classmethod
    def of(cls, hits: DataFrame, counts: DataFrame, kind: str = "item_type") -> Envelope:
        """Collects one page and its totals, both small."""
        return cls([r.asDict(True) for r in hits.collect()], {r[kind]: r["total"] for r in counts.collect()})

    def as_dict(self) -> dict:
        return asdict(self)
