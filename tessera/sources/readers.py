"""Readers of the engine's inputs and writers of its dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEARCH_LOG = "uid string, session string, ts timestamp_ntz, cid string, query string, org string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A partitioned scan of a database table; filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options)
    return reader.load()


def parse_search_log(lines: DataFrame, since: str | None = None, blacklist: list[str] | None = None) -> DataFrame:
    """Rows of ``uid|||session|||time|||cid|||query|||org`` lines with an acceptable query, decoded."""
    p = F.split("value", r"\|\|\|")
    rows = lines.where(F.size(p) == 6).select(
        p[0].alias("uid"), p[1].alias("session"), F.try_to_timestamp(p[2], F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("ts"), p[3].alias("cid"), F.try_url_decode(p[4]).alias("query"), p[5].alias("org")
    )
    ok = F.col("query").isNotNull() & (F.size(F.split(F.trim("query"), r"\s+")) < 10) & (F.length("query") > 3) & ~F.col("query").startswith("-")
    rows = rows.where(ok)
    if since:
        rows = rows.where(F.col("ts") > F.lit(since).cast("timestamp_ntz"))
    return rows.where(~F.col("query").isin(blacklist)) if blacklist else rows


def search_log(spark: SparkSession, path: str, since: str | None = None, blacklist: list[str] | None = None) -> DataFrame:
    return parse_search_log(spark.read.text(path), since, blacklist)


def word_counts_text(lines: DataFrame) -> DataFrame:
    """word, n from lines such as ``(u'word', 3)``."""
    pattern = r"^\(u?'(.*)', (\d+)\)$"
    rows = lines.select(F.regexp_extract("value", pattern, 1).alias("word"), F.regexp_extract("value", pattern, 2).alias("n"))
    return rows.where("n <> ''").select("word", F.col("n").cast("long").alias("n"))


def delimited(lines: DataFrame, names: list[str], separator: str = "\0") -> DataFrame:
    """Columns of lines with as many fields as there are names."""
    p = F.split("value", f"\\Q{separator}\\E")
    return lines.where(F.size(p) == len(names)).select(*[p[k].alias(c) for k, c in enumerate(names)])


def to_delimited(rows: DataFrame, names: list[str], separator: str = "\0") -> DataFrame:
    return rows.select(F.concat_ws(separator, *[F.col(c).cast("string") for c in names]).alias("value"))


def word_set(spark: SparkSession, *paths: str) -> DataFrame:
    """word: the distinct words of newline-separated lists."""
    return spark.read.text(list(paths)).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def glyph_groups(spark: SparkSession, path: str) -> DataFrame:
    """members: characters that look alike, a group to a line."""
    return spark.read.text(path).select(F.filter(F.transform(F.split("value", ","), F.trim), lambda x: x != "").alias("members"))


def suggest_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("input string, output string, weight double, user_id long, course_id string").json(path)


def course_list(lines: DataFrame, courses: DataFrame) -> DataFrame:
    """course_id of tab-separated lines with one column (an id) or three (org, number, run); numbers are resolved, ids once."""
    p = F.split("value", "\t")
    rows = lines.select(F.trim(p[0]).alias("a"), F.when(F.size(p) >= 3, F.trim(p[1])).alias("number"))
    direct = rows.where("number is null").select(F.col("a").alias("course_id"))
    found = rows.where("number is not null").join(courses.select("org", "course_num", "course_id"), (F.col("a") == F.col("org")) & (F.col("number") == F.col("course_num")))
    return direct.unionByName(found.select("course_id")).where("course_id <> ''").dropDuplicates()


def write_text(rows: DataFrame, path: str) -> None:
    rows.select("value").write.mode("overwrite").text(path)
