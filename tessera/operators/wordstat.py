"""Word counts by subject, totals at two grains, and lift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_count(docs: DataFrame, subject: str, tokens) -> DataFrame:
    return docs.select(subject, F.explode(tokens).alias("word")).groupBy(subject, "word").agg(F.count("*").alias("n"))


def totals(counts: DataFrame, subject: str) -> DataFrame:
    """Totals of each word and of each subject in one pass: the other column is null."""
    return counts.groupingSets([["word"], [subject]], "word", subject).agg(F.sum("n").alias("n"))


def lift(counts: DataFrame, subject: str) -> DataFrame:
    """(n_ws / N_s) / (n_w / N) for each subject and word.

    Words are joined to their totals rather than gathered in a window, so a
    frequent word is summed before the shuffle; there is a row for each subject.
    """
    by_word = counts.groupBy("word").agg(F.sum("n").alias("n_word"))
    by_subject = counts.groupBy(subject).agg(F.sum("n").alias("n_subject"))
    everything = by_subject.agg(F.sum("n_subject").alias("n_all"))
    joined = counts.join(by_word, "word").join(by_subject, subject).crossJoin(F.broadcast(everything))  # one row
    return joined.select(subject, "word", "n", ((F.col("n") / F.col("n_subject")) / (F.col("n_word") / F.col("n_all"))).alias("lift"))
