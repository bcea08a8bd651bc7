"""Snapshot differences and keyed updates of document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """key, op (index, update, delete or same) and the values to keep, from one full outer join."""
    o = old.select(*key, F.struct(*compare).alias("_old"))
    n = new.select(*key, F.struct(*compare).alias("_new"))
    op = F.when(F.col("_old").isNull(), "index").when(F.col("_new").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("update")
    kept = F.coalesce("_new", "_old")
    return o.join(n, key, "full_outer").select(*key, op.alias("op"), *[kept.getField(c).alias(c) for c in compare])


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: the last by ``order``, of equals the one from ``new``."""
    both = old.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("_late"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_late")


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All old rows of the parents in ``new`` go, then ``new`` is added."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def update_field(rows: DataFrame, updates: DataFrame, key: str, name: str) -> DataFrame:
    """Rows with the field replaced where an update has a value."""
    new = updates.select(key, F.col(name).alias("_new"))
    return rows.join(new, key, "left").withColumn(name, F.coalesce("_new", name)).drop("_new")


def update_status(updates: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key, status of each requested update: 1 done, 0 no such row, -1 blank id."""
    known = rows.select(key, F.lit(1).alias("_there")).distinct()
    blank = F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == ""
    return updates.join(known, key, "left").select(key, F.when(blank, -1).when(F.col("_there") == 1, 1).otherwise(0).alias("status"))


def update_where(rows: DataFrame, condition: Column, name: str, value) -> DataFrame:
    return rows.withColumn(name, F.when(condition, F.lit(value)).otherwise(F.col(name)))


def writes(changes: DataFrame) -> DataFrame:
    """What a sink has to do: rows that stay the same are left out."""
    return changes.where(F.col("op") != "same")
