"""Change events as streams, and micro-batches that rebuild the documents they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BINLOG = "tableName string, afterColumns array<struct<name string, value string>>"
COURSE_EVENT = "course_id string"
EDIT_EVENT = "course_id string, parent_id_cur string, parent_id_pre string"
#: Fixed value: the id that an edit heartbeat carries.
HEARTBEAT = "xxxx"


def json_source(spark: SparkSession, folder: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """A stream of JSON files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).json(folder)


def kafka_source(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """A stream of JSON messages; offsets are kept in the query's checkpoint."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("x"), F.col("timestamp").alias("ts")).select("x.*", "ts")


def binlog_ids(events: DataFrame, tables: list[str], name: str = "course_id") -> DataFrame:
    """course_id of row changes of some tables."""
    hit = F.filter("afterColumns", lambda x: x["name"] == name)
    return events.where(F.col("tableName").isin(tables)).select(F.try_element_at(hit, F.lit(1))["value"].alias("course_id")).where("course_id is not null")


def event_ids(events: DataFrame) -> DataFrame:
    """course_id of messages that are not heartbeats."""
    return events.where(F.col("course_id").isNotNull() & (F.col("course_id") != HEARTBEAT)).select("course_id")


def parent_ids(events: DataFrame, courses: DataFrame) -> DataFrame:
    """course_id of the edited course and of all courses of its present and previous parent (courses: course_id, parent_id).

    For the rows of one micro-batch: each parent is expanded once, however many edits name it.
    """
    rows = events.where(F.col("course_id") != HEARTBEAT)
    parents = rows.select(F.explode(F.array("parent_id_cur", "parent_id_pre")).alias("parent_id")).where("parent_id is not null and parent_id <> ''").distinct()
    return rows.select("course_id").unionByName(courses.select("course_id", "parent_id").join(parents, "parent_id", "left_semi").select("course_id"))


def rebuild_stream(events: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, seconds: int = 10, ids: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Every micro-batch's distinct ids to ``rebuild(ids, batch_id)``, which has to be idempotent.

    ``ids`` makes course_id of a micro-batch's events; without it the events have it.
    """
    def each(df: DataFrame, k: int) -> None:
        rebuild((ids(df) if ids else df).dropDuplicates(["course_id"]), k)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def daily_counts(rows: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """day, n: tumbling days, rows later than the watermark left out of closed days.  Works on batches as well."""
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return rows.groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")
