"""Quotation linking: conversations in reply order, without their quotes.

Lines that begin with ``>`` marks are quotes, nested as deep as they have marks.
The quoted text of each level and every message's own text are cut into units:
the whole, its paragraphs and its lines, each normalised (lower case, runs of
white space as one space) and hashed.  A quote's units are joined to the earliest
message that has the unit as its own text, in the same conversation before the
quoting turn or else anywhere before.  The longest unit found of the outermost
level decides which message is answered.  Answers are followed up to the first
message of their thread by doubling.

Everything is DataFrame operations.  Originals are reduced to one row for each
unit before the join, so a line that every message has makes no pairs, and no
window is taken over a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, table

_MARKS = r"^(?:[ \t]*>)+"
_ATTRIBUTION = r"(?i)^.*\b(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
#: Turns and threads of a conversation are numbered in ranges of so many.
RANGE = 1024


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))


def _content(line: Column) -> Column:
    return F.regexp_replace(line, _MARKS + r"[ \t]?", "")


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _units(text: Column) -> Column:
    """Distinct normalised units of a text: the whole, paragraphs, lines."""
    parts = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n"))
    return F.array_distinct(F.filter(F.transform(parts, _normal), lambda x: x != ""))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each distinct message, with what it answers and its place in reply order.

    conv_id, turn, role, copies (equal rows), n_quoted lines, n_linked quote
    levels, reply_conv and reply_turn (null: it answers nothing that is known),
    thread_turn (turn of the first message of the thread), depth, position (in
    the conversation, from 1, by thread, turn, role and text) and body, the
    message without quotes and the lines that introduce them.

    Null texts are empty and roles null stay null.  A message answers only a
    smaller (conversation, turn); messages whose conversation or turn is null
    answer nothing and are not answered, and have no position.
    """
    spark = messages.sparkSession
    staged = Staged(spark, "quotes")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), text.alias("text"))
    key = F.md5(F.to_json(F.struct("conv_id", "turn", "role", F.sha2("text", 256).alias("text"))))
    rows = rows.withColumn("msg", key).groupBy("msg").agg(*[F.first(c).alias(c) for c in ("conv_id", "turn", "role", "text")], F.count("*").alias("copies"))
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.struct(_level(x).alias("level"), _content(x).alias("line")))
    rows = rows.withColumn("lines", lines)
    own = F.filter("lines", lambda x: (x["level"] == 0) & ~x["line"].rlike(_ATTRIBUTION))
    plain = F.filter("lines", lambda x: x["level"] == 0)
    quoted = F.filter("lines", lambda x: x["level"] > 0)
    # only where something is quoted does a line introduce a quote
    body = F.array_join(F.transform(F.when(F.size(quoted) > 0, own).otherwise(plain), lambda x: x["line"]), "\n")
    rows = rows.withColumn("n_quoted", F.size(quoted)).withColumn("body", F.trim(F.regexp_replace(body, r"^\s+|\s+$", "")))
    rows = staged(rows.drop("text"), "rows")

    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    units = rows.where(known).select("conv_id", "turn", "msg", F.explode(_units(F.col("body"))).alias("unit")).withColumn("unit", F.md5("unit"))
    first = units.groupBy("conv_id", "unit").agg(F.min(F.struct("turn", "msg")).alias("here"))
    first = staged(first, "first")
    ever = first.groupBy("unit").agg(F.min(F.struct("conv_id", "here")).alias("ever"))

    levels = rows.where(known & (F.col("n_quoted") > 0)).withColumn("level", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: x["level"]))))
    at = F.array_join(F.transform("lines", lambda x: F.when(x["level"] == F.col("level"), x["line"]).otherwise("")), "\n")
    asked = levels.select("msg", "conv_id", "turn", "level", F.explode(_units(at)).alias("text"))
    asked = asked.select("msg", "conv_id", "turn", "level", F.length("text").alias("size"), F.md5("text").alias("unit"))
    met = asked.join(first, ["conv_id", "unit"], "left").join(ever, "unit", "left")
    here = F.when(F.col("here.turn") < F.col("turn"), F.struct(F.col("conv_id").alias("conv"), F.col("here.turn").alias("turn"), F.col("here.msg").alias("msg")))
    # a struct of nulls would come before any other
    earlier = F.col("ever").isNotNull() & (F.struct("ever.conv_id", "ever.here.turn") < F.struct("conv_id", "turn"))
    there = F.when(earlier, F.struct(F.col("ever.conv_id").alias("conv"), F.col("ever.here.turn").alias("turn"), F.col("ever.here.msg").alias("msg")))
    met = met.withColumn("to", F.coalesce(here, there)).where("to is not null")
    best = F.max(F.struct((-F.col("level")).alias("level"), (F.col("to.conv") == F.col("conv_id")).alias("same"), "size", (-F.col("to.turn")).alias("early"), "to")).alias("best")
    replies = met.groupBy("msg").agg(best, F.countDistinct("level").alias("n_linked"))
    replies = staged(replies.select("msg", "n_linked", F.col("best.to.msg").alias("up"), F.col("best.to.conv").alias("reply_conv"), F.col("best.to.turn").alias("reply_turn")), "replies")

    # doubling: from each answering message to one further up, until all are at the top
    path = replies.select("msg", F.col("up").alias("top"), F.lit(1).cast("long").alias("depth"))
    k = 0
    while True:
        further = path.select(F.col("msg").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        joined = path.join(further, "top", "left")
        k += 1
        stepped = staged(joined.select("msg", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), f"path{k}")
        path = stepped.drop("moved")
        if not stepped.where("moved").take(1):
            break
    tops = rows.select(F.col("msg").alias("top"), F.col("conv_id").alias("top_conv"), F.col("turn").alias("top_turn"))
    path = path.join(tops, "top")
    out = rows.join(replies.drop("up"), "msg", "left").join(path.drop("top"), "msg", "left")
    # a thread that begins in another conversation begins here with the message itself
    thread = F.when(F.col("top_conv") == F.col("conv_id"), F.col("top_turn")).otherwise(F.col("turn"))
    out = out.withColumn("thread_turn", F.coalesce(thread, F.col("turn"))).withColumn("depth", F.coalesce("depth", F.lit(0)))
    out = staged(out.drop("lines"), "out")
    placed = positions(out.where(known).select("msg", "conv_id", "thread_turn", "turn", "role"))
    keep = ["conv_id", "turn", "role", "copies", "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_conv", "reply_turn", "thread_turn", "depth", "position", "body"]
    staged.done(*[x for x in staged.paths if x != "out"])
    return out.join(placed, "msg", "left").select(*keep)


def positions(rows: DataFrame) -> DataFrame:
    """msg, position: place in its conversation by thread_turn, turn, role, msg.

    Rows are counted by ranges of threads and in them by ranges of turns; running
    sums over the ranges and numbers inside a range give the place.
    """
    rows = rows.withColumn("threads", F.floor(F.col("thread_turn") / RANGE)).withColumn("turns", F.floor(F.col("turn") / RANGE))
    fine = rows.groupBy("conv_id", "threads", "thread_turn", "turns").agg(F.count("*").alias("n"))
    coarse = fine.groupBy("conv_id", "threads").agg(F.sum("n").alias("n"))
    before = lambda *order: Window.partitionBy(*order[:-1]).orderBy(*order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("base", F.coalesce(F.sum("n").over(before("conv_id", ["threads"])), F.lit(0))).drop("n")
    fine = fine.withColumn("shift", F.coalesce(F.sum("n").over(before("conv_id", "threads", ["thread_turn", "turns"])), F.lit(0))).drop("n")
    inner = F.row_number().over(Window.partitionBy("conv_id", "threads", "thread_turn", "turns").orderBy("turn", "role", "msg"))
    placed = rows.withColumn("inner", inner).join(fine, ["conv_id", "threads", "thread_turn", "turns"]).join(coarse, ["conv_id", "threads"])
    return placed.select("msg", (F.col("base") + F.col("shift") + F.col("inner")).alias("position"))


def op4_quote_threads(spark, sf_dir: str) -> DataFrame:
    """All of ``conversations`` in reply order without quotes."""
    return link_quotes(table(spark, sf_dir, "conversations"))
