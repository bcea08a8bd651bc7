"""Checks of counts and freshness."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(sent: DataFrame, received: DataFrame, day: str) -> DataFrame:
    """day, n_sent, n_received, equal: counts by day on both sides; a day missing on one side counts zero there."""
    a = sent.groupBy(day).agg(F.count("*").alias("n_sent"))
    b = received.groupBy(day).agg(F.count("*").alias("n_received"))
    both = a.join(b, day, "full_outer").select(day, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sent", "n_received")])
    return both.withColumn("equal", F.col("n_sent") == F.col("n_received"))


def close_enough(a: Column, b: Column, share: float = 0.1) -> Column:
    return F.abs(a - b) < share * a


def stale_sources(beats: DataFrame, source: str, ts: str, as_of, minutes: int = 5) -> DataFrame:
    """source, last_seen, stale: whether a source's last sign of life is older than so many minutes."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    rows = beats.groupBy(source).agg(F.max(ts).alias("last_seen"))
    return rows.withColumn("stale", F.col("last_seen") < now - F.make_interval(mins=F.lit(minutes)))


def checked_day(as_of: datetime) -> str:
    """Yesterday; before eight in the morning the day before."""
    return str((as_of - timedelta(days=2 if as_of.hour < 8 else 1)).date())


def enough_rows(rows: DataFrame, ts: str, as_of: datetime, least: int = 50) -> DataFrame:
    """n, ok for the day that is checked at ``as_of``."""
    n = rows.where(F.to_date(ts) == F.lit(checked_day(as_of)).cast("date")).agg(F.count("*").alias("n"))
    return n.withColumn("ok", F.col("n") >= least)
