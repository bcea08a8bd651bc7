"""Mixing sources to target weights by Pareto order sampling.

Each source gets a word target.  A document's expected copies are its source's
factor times a measure of its own, at most ``max_copies``; the whole copies are
certain and the remainder is an inclusion probability.  For the remainders the
documents of a source are ranked by Pareto's ratio, random odds over inclusion
odds, and the first of them are taken until the words still missing are reached.

No source is ever gathered in one task: words are summed by source and class of
length, and the rank at which a source's sample ends is found by narrowing an
interval of ranks with partial sums; only the few rows of the last interval are
put in order.  Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, table

WEIGHTS, MAX_COPIES = (5, 2, 1), 3
#: A rank is a 48-bit integer, narrowed by so many bits at a time, as often as this; the rest is ordered.
RANK_BITS, STEP_BITS, STEPS = 48, 12, 2


def words(column: str = "text") -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    spaced = F.translate(F.coalesce(F.col(column).cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda x: x != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """source, source_size, target from source, source_size: one row for each source.

    Sources in order of code points, null last, weigh ``weights`` in turn.  The
    targets share the total of all sizes by weight, at most ``cap`` times a
    source's size; what exceeds that is shared again by weight.  The level at
    which this settles is found at once from running sums over the sources in
    order of the share at which each is full.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(listed, (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    full = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    onward = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level)
    # the first source that its share does not fill sets the level for itself and all after it
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    rows = rows.withColumn("level", F.first(open_, ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("limit")), F.col("limit")).alias("target"))


def length_class(size: Column) -> Column:
    """Number of binary digits of the size."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(F.lit(0))


def measure(cls: Column) -> Column:
    """A document's share of its source's copies, by class: long ones repeat a little less."""
    return F.lit(16.0) / (F.lit(16.0) + cls)


def factors(classes: DataFrame, cap: float = MAX_COPIES) -> DataFrame:
    """source, target, source_size, factor: so that the expected words meet the target.

    ``classes``: source, cls, class_size, target, source_size.  Expected copies
    are least(cap, factor * measure); the factor is found as the level above is,
    from the classes of a source in order of measure (at most 64 of them).
    """
    same = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    rows = classes.withColumn("g", measure(F.col("cls")))
    most = Window.partitionBy(*same).orderBy(F.desc("g"))
    held = F.lit(float(cap)) * F.coalesce(F.sum("class_size").over(most.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("class_size") * F.col("g")).over(most.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("factor", F.when(rest > 0, (F.col("target") - held) / rest).otherwise(0.0))
    rows = rows.withColumn("fits", F.col("factor") * F.col("g") <= F.lit(float(cap)))
    best = F.struct((~F.col("fits")).alias("no"), (-F.col("g")).alias("by"), F.col("factor").alias("factor"))
    found = rows.groupBy("source").agg(F.min(best).alias("best"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    # if no class fits, every document is at the cap
    return found.select("source", "target", "source_size", F.when(F.col("best.no"), F.lit(1e300)).otherwise(F.col("best.factor")).alias("factor"))


def pareto_rank(p: Column, *keys: Column) -> Column:
    """Pareto's ratio (u/(1-u)) / (p/(1-p)) of a reproducible u, as an increasing 48-bit integer."""
    digest = F.md5(F.concat_ws("|", *keys))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    odds = (u / (1 - u)) / (p / (1 - p))
    return F.floor(odds / (1 + odds) * F.lit(float(1 << RANK_BITS))).cast("long")


def mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, digest: a row for each row of ``docs``.

    A null text has no words; rows without words are in no sample and have no
    copies counted.  Null is a source of its own, the last.  Rows with the same
    id, source and text share their draw, and so does a null id (by text); only
    where a source's sample ends between equal ranks are they told apart, by
    place.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "mix")
    digest = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), digest.alias("digest"))
    rows = staged(rows.withColumn("cls", length_class(F.col("size"))), "rows")
    classes = rows.groupBy("source", "cls").agg(F.sum("size").alias("class_size"))
    sizes = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    aims = targets(sizes, weights, cap).withColumnRenamed("source", "its")
    classes = classes.join(aims, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    found = staged(factors(classes, cap), "factors")

    expected = F.least(F.lit(float(cap)), F.col("factor") * measure(F.col("cls")))
    draws = rows.join(found.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).drop("its")
    draws = draws.withColumn("expected", F.when(F.col("size") > 0, expected).otherwise(0.0))
    # a remainder within rounding of 0 or 1 is none
    draws = draws.withColumn("whole", F.floor(F.col("expected") + 1e-9)).withColumn("p", F.col("expected") - F.col("whole"))
    drawn = F.col("p") > 1e-9
    keys = F.lit(seed).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.col("digest").cast("string"))
    draws = draws.withColumn("rank", F.when(drawn, pareto_rank(F.col("p"), *keys)))
    draws = staged(draws.select("doc_id", "source", "size", "source_size", "target", "digest", "whole", "rank"), "draws")

    same = F.coalesce(F.col("source"), F.lit("")).alias("name"), F.col("source").isNull().alias("none")
    sure = draws.groupBy(*same).agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("sure"))
    state = staged(sure.select("name", "none", (F.col("target") - F.col("sure")).alias("left"), F.lit(0).cast("long").alias("low")), "state0")
    ranked = draws.where("rank is not null").select(*same, "rank", "size")
    for k in range(1, STEPS + 1):
        shift = RANK_BITS - STEP_BITS * k
        part = F.shiftright("rank", shift)
        bins = ranked.join(state, ["name", "none"]).where(F.shiftright("rank", shift + STEP_BITS) == F.col("low"))
        bins = bins.groupBy("name", "none", "left", "low", part.alias("bin")).agg(F.sum("size").alias("bin_size"))
        upto = F.sum("bin_size").over(Window.partitionBy("name", "none").orderBy("bin"))
        bins = bins.withColumn("upto", upto)
        hit = F.min(F.when(F.col("upto") >= F.col("left"), F.struct("bin", (F.col("left") - F.col("upto") + F.col("bin_size")).alias("left"))))
        # a source whose ranks are all taken ends past its last one
        past = F.struct((F.max("bin") + 1).alias("bin"), F.lit(0.0).alias("left"))
        hits = bins.groupBy("name", "none").agg(F.coalesce(hit, past).alias("x")).select("name", "none", F.col("x.left").alias("left"), F.col("x.bin").alias("low"))
        state = staged(hits, f"state{k}")
    shift = RANK_BITS - STEP_BITS * STEPS
    last = draws.where("rank is not null").select("*", *same).join(state, ["name", "none"])
    part = F.shiftright("rank", shift)
    inside = last.where(part == F.col("low"))
    upto = F.sum("size").over(Window.partitionBy("name", "none").orderBy("rank", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the row at which the words are reached is taken if that comes nearer
    inside = inside.withColumn("extra", (upto - F.col("size") / 2 <= F.col("left")).cast("long"))
    outside = last.where(part != F.col("low")).withColumn("extra", (part < F.col("low")).cast("long"))
    sure = draws.where("rank is null").withColumn("extra", F.lit(0).cast("long"))
    keep = ["doc_id", "source", "size", "source_size", "target", "digest", (F.col("whole") + F.col("extra")).alias("copies")]
    return inside.select(*keep).unionByName(outside.select(*keep)).unionByName(sure.select(*keep))


def repeat_rows(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows without words, which no target counts, once.

    Columns may have any names: rows are carried as one struct.  Rows equal in id,
    source and text have equal copies, except where a source's sample ends among
    them; only such a group is numbered, so repeated rows do not meet in a task.
    An empty table gives an empty one.
    """
    mixed = mix(docs, seed, weights, cap, id_col, text_col, source_col)
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(1)
    keyed = lambda i, s: [F.coalesce(i, F.lit(0)).alias("i"), i.isNull().alias("no_i"), F.coalesce(s, F.lit("")).alias("s"), s.isNull().alias("no_s")]
    keys = ["i", "no_i", "s", "no_s", "digest"]
    taken = mixed.select(*keyed(F.col("doc_id"), F.col("source")), "digest", copies.alias("copies"))
    taken = taken.groupBy(*keys).agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.sum("copies").alias("all"), F.count("*").alias("rows")).where("most > 0")
    digest = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("digest")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *keyed(F.col(id_col).cast("long"), F.col(source_col).cast("string")), digest).join(taken, keys)
    even = rows.where("least = most").select("row", F.col("least").alias("copies"))
    border = rows.where("least < most").withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    border = border.select("row", (F.col("least") + (F.col("n") <= F.col("all") - F.col("least") * F.col("rows")).cast("long")).alias("copies"))
    out = even.unionByName(border).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("n")).select("row.*")


def op7_pareto_mix(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for all of ``documents``."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))
