"""Schemas of the engine's tables, and making them as tables of a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "courses": "course_id string, org string, owner string, serialized int, mode array<string>, cid array<int>, cid_name array<string>, start timestamp_ntz, `end` timestamp_ntz, expire timestamp_ntz, status int, course_type int, is_paid_only int, enroll_num long, accumulate_num long, accumulate_num_v2 long, last_chapter string, ut timestamp_ntz",
    "course_title": "course_id string, title string, ut timestamp_ntz",
    "course_about": "course_id string, about string, ut timestamp_ntz",
    "course_category": "course_id string, cid array<int>, cid_name array<string>, `group` string",
    "course_staff": "course_id string, staff_id string, name string, company string, department string, position string",
    "course_structure": "course_id string, structure_id string, name string, structure array<string>, location array<string>, order_num string",
    "fragments": "course_id string, knowledge_id long, frag_title string, frag_desc string, status int, cover_image string, praise_number long, view_number long",
    "lives": "live_id long, live_title string, live_subtitle string, thumbnail string, start timestamp_ntz, `end` timestamp_ntz, status int",
    "microdegrees": "microdegree_id long, microdegree_title string, microdegree_subtitle string, picture string, status int, course_info_list array<struct<course_id string, course_name string, about string, staff string, status int>>",
    "orginfo": "org string, name string, about string, cover_image string, school_motto string, course_num long",
    "staffinfo": "staff_id string, name string, company string, department string, position string, avartar string, staffinfo_course_num long",
    "creditcourses": "plat_id long, course_name string, school string, stage array<string>, first_category array<string>, second_category array<string>, start timestamp_ntz, `end` timestamp_ntz, student_num long, visible int, is_enroll int, is_apply int",
    "qc_words": "word string, weight long",
    "qc_pinyin": "pinyin string, output string, weight long",
    "qc_similar": "similar_word string, output string, weight long",
    "sug": "dict string, input string, output string, weight double, payload map<string, string>",
    "related": "word string, result array<struct<word string, score double>>",
    "search_log": "uid string, session string, ts timestamp_ntz, cid string, query string, org string",
}


def create_tables(spark: SparkSession, *names: str, buckets: dict[str, tuple[str, int]] | None = None) -> None:
    """Make empty tables anew; ``buckets`` names a key and a number for tables that are joined on it again and again."""
    for name in names or SCHEMAS:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        writer = spark.createDataFrame([], SCHEMAS[name]).write.format("parquet")
        if buckets and name in buckets:
            key, n = buckets[name]
            writer = writer.bucketBy(n, key).sortBy(key)
        writer.saveAsTable(name)


def conform(rows: DataFrame, name: str, payload: str | None = None) -> DataFrame:
    """Rows in a table's schema: missing columns null, others dropped or, with ``payload``, put into that map."""
    fields = rows.sparkSession.createDataFrame([], SCHEMAS[name]).schema.fields
    has = set(rows.columns)
    wanted = [(F.col(f.name) if f.name in has else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields if f.name != payload]
    if payload:
        extra = sorted(has - {f.name for f in fields})
        pairs = [x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]
        wanted.append((F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias(payload))
    return rows.select(*wanted)
