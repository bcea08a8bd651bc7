"""Assembling searchable documents from their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the service: stand-ins for missing ends and chapter starts.
NO_END, NO_START = "2030-01-01 00:00:00", "2099-12-31 00:00:00"


def timestamp_text(c: Column, missing: str = NO_END) -> Column:
    return F.date_format(F.coalesce(c, F.lit(missing).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")


def iso_timestamp(c: Column, hours: int = 8) -> Column:
    """ISO text to the minute, moved by hours; null if it does not parse."""
    plain = F.substring(F.regexp_replace(F.regexp_replace(c, "T", " "), "Z", ""), 1, 16)
    return F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz") + F.make_interval(hours=F.lit(hours))


def course_categories(courses: DataFrame, links: DataFrame, categories: DataFrame, groups: DataFrame, on: tuple[str, str, str, str, str, str], predicate: Column) -> DataFrame:
    """Inner joins course - link - category - group; ``on`` names the key pairs in that order."""
    a, b, c, d, e, f = on
    joined = courses.join(links, F.col(a) == F.col(b)).join(categories, F.col(c) == F.col(d)).join(groups, F.col(e) == F.col(f))
    return joined.where(predicate)


def active_counts(enrolments: DataFrame, key: str, active: Column, name: str = "enroll_num") -> DataFrame:
    return enrolments.where(active).groupBy(key).agg(F.count("*").alias(name))


def with_counts(rows: DataFrame, counts: DataFrame, key: str, name: str = "enroll_num") -> DataFrame:
    """Left outer join to an aggregate; missing counts are zero."""
    return rows.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def monotone(rows: DataFrame, name: str, *sources: str) -> DataFrame:
    """A counter that never falls: the greatest of its sources."""
    return rows.withColumn(name, F.greatest(*sources))


def group_concat(rows: DataFrame, key: str, value: str, name: str, separator: str = ",") -> DataFrame:
    """Values of a key in ascending order as one string."""
    ordered = F.array_sort(F.collect_list(value))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x.cast("string")), separator).alias(name))


def collect_distinct(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Each column's distinct values, sorted."""
    return rows.groupBy(key).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])


def explode_zip(rows: DataFrame, key: list[str], *columns: str) -> DataFrame:
    """Aligned arrays to rows, with their position."""
    zipped = rows.select(*key, F.posexplode(F.arrays_zip(*columns)).alias("pos", "x"))
    return zipped.select(*key, "pos", *[F.col(f"x.{c}").alias(c) for c in columns])


def context_window(items: DataFrame, key: str, pos: str, name: str, width: int = 5) -> DataFrame:
    """key, pos, name, context: the names around each item, clamped at both ends so that it is always as wide as can be.

    A structure is one document's list of items, so it is gathered in one row.
    """
    lists = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos, name))).alias("all"))
    n, half = F.size("all"), width // 2
    # 0-based start of the slice
    start = F.greatest(F.lit(0), F.least(F.col("i") - half, n - width))
    rows = lists.select(key, "all", F.posexplode("all").alias("i", "x"))
    context = F.transform(F.slice("all", start + 1, F.lit(width)), lambda x: x[name])
    return rows.select(key, F.col(f"x.{pos}").alias(pos), F.col(f"x.{name}").alias(name), context.alias("context"))


def last_started(chapters: DataFrame, key: str, pos: str, start: str, text: str, as_of) -> DataFrame:
    """key, last_chapter: going through the chapters with a start in order, the last before the first future one."""
    own = Window.partitionBy(key).orderBy(pos)
    future = F.col(start) > F.lit(str(as_of)).cast("timestamp_ntz")
    rows = chapters.where(F.col(start).isNotNull()).withColumn("_past", ~F.max(future).over(own))
    return rows.groupBy(key).agg(F.max_by(F.when(F.col("_past"), F.col(text)), F.when(F.col("_past"), F.col(pos))).alias("last_chapter"))


def order_numbers(items: DataFrame, key: str, chapter: str, pos: str) -> DataFrame:
    """order_num ``cc.ss``: number of the chapter and, anew in each chapter, of the item."""
    c = F.dense_rank().over(Window.partitionBy(key).orderBy(chapter))
    s = F.row_number().over(Window.partitionBy(key, chapter).orderBy(pos))
    return items.withColumn("order_num", F.concat_ws(".", F.lpad(c.cast("string"), 2, "0"), F.lpad(s.cast("string"), 2, "0")))


def location_paths(nodes: DataFrame, node: str, parent: str, depth: int = 3) -> DataFrame:
    """node, location: the ids from the root down, for trees of a fixed depth."""
    paths = nodes.where(F.col(parent).isNull()).select(node, F.array(node).alias("location"))
    level = out = paths
    for _ in range(depth - 1):
        up = level.select(F.col(node).alias("_up"), F.col("location").alias("_path"))
        level = nodes.join(up, F.col(parent) == F.col("_up")).select(node, F.concat("_path", F.array(node)).alias("location"))
        out = out.unionByName(level)
    return out


def best_record(rows: DataFrame, name: str, key: str, *columns: str) -> DataFrame:
    """Of rows with a name the one with the fewest empty fields, of equals the last."""
    empty = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", 1).otherwise(0) for c in columns), F.lit(0))
    best = Window.partitionBy(name).orderBy("_empty", F.desc(key))
    return rows.withColumn("_empty", empty).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_empty")


def first_wins(rows: DataFrame, name: str, key: str) -> DataFrame:
    """The row with the smallest key of each name."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(key))).where("_n = 1").drop("_n")


def structure_old(rows: DataFrame) -> DataFrame:
    """item_id, category, display_name, start, parent_id, ord from documents of the old course format."""
    own = F.concat_ws("/", "_id.org", "_id.course", "_id.category", "_id.name")
    items = rows.select(own.alias("item_id"), F.col("_id.category").alias("category"), F.col("metadata.display_name").alias("display_name"), F.col("metadata.start").alias("start"), F.col("definition.children").alias("children"))
    links = items.select(F.col("item_id").alias("parent_id"), F.posexplode("children").alias("ord", "item_id"))
    return items.drop("children").join(links, "item_id", "left")


def structure_new(rows: DataFrame, key: str = "course_id") -> DataFrame:
    """course_id, block_type, block_id, display_name, start, parent_id, ord from block lists of the new course format."""
    blocks = rows.select(key, F.explode("blocks").alias("b"))
    items = blocks.select(key, "b.block_type", "b.block_id", F.col("b.fields.display_name").alias("display_name"), F.col("b.fields.start").alias("start"), F.col("b.fields.children").alias("children"))
    links = items.select(key, F.col("block_id").alias("parent_id"), F.posexplode("children").alias("ord", "child"))
    links = links.select(key, "parent_id", "ord", F.element_at("child", 2).alias("block_id"))
    return items.drop("children").join(links, [key, "block_id"], "left")
