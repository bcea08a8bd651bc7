"""Spelling correction in tiers: forced, exact, homophone, similar glyph, n-gram with edit distance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.distance import damerau, lcs, remainder
from tessera.functions.pinyin import readings
from tessera.functions.text import CJK, clean_query, grams

# Fixed values of the service: digits of remainders, weight bands of the four domains, word lengths.
DIGITS = set("0123456789零一二三四五六七八九十")
BANDS = {"org": (20, 100), "staff": (200, 1000), "course": (2000, 10000), "category": (20000, 100000)}
SHORTEST, LONGEST, READINGS, PER_PINYIN = 2, 50, 10, 10
SERIES = r"第[0-9一二三四五六七八九十]*[讲场课期册]|第[0-9i一二三四五六七八九十]*部分|第[0-9 ]*小时|[0-9]+[春夏秋]|第$|之[一二三四五六七八九十]+"
SUFFIXES = "(微慕课|自主模式)$"


def clean_words(c: Column) -> Column:
    """A name's words for the dictionary: cut at dashes, cleaned, without series words and suffixes."""
    parts = F.transform(F.split(c, "——"), clean_query)
    parts = F.flatten(F.transform(parts, lambda x: F.split(x, SERIES, 2)))
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, SUFFIXES, ""))), lambda x: x != "")


def domain_weights(rows: DataFrame) -> DataFrame:
    """word, weight from domain, name, num: sums by cleaned word, scaled into the domain's band, the best domain's.

    A domain's largest sum is aggregated and joined back, one row a domain.
    """
    sums = rows.select("domain", F.explode(clean_words(F.col("name"))).alias("word"), "num").groupBy("domain", "word").agg(F.sum("num").alias("n"))
    top = sums.groupBy("domain").agg(F.max("n").alias("most"))
    low = F.create_map(*[F.lit(x) for k, v in BANDS.items() for x in (k, float(v[0]))])
    high = F.create_map(*[F.lit(x) for k, v in BANDS.items() for x in (k, float(v[1]))])
    a, b = F.element_at(low, F.col("domain")), F.element_at(high, F.col("domain"))
    scaled = sums.join(F.broadcast(top), "domain").withColumn("weight", F.ceil(a + (b - a) * F.col("n") / F.greatest("most", F.lit(1))))
    return scaled.groupBy("word").agg(F.max("weight").alias("weight"))


def similar_words(words: DataFrame, groups: DataFrame) -> DataFrame:
    """word, similar: each character exchanged for a member of one of its groups (array ``members``); never itself."""
    members = groups.select(F.explode("members").alias("char"), "members")
    chars = words.select("word", F.posexplode(F.split("word", "")).alias("pos", "char")).where("char <> ''")
    swapped = chars.join(members, "char").select("word", "pos", F.explode("members").alias("other"))
    similar = F.concat(F.substr("word", F.lit(1), F.col("pos")), "other", F.substr("word", F.col("pos") + 2))
    return swapped.select("word", similar.alias("similar")).where("similar <> word").distinct()


def expand_words(words: DataFrame, table: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dictionaries (pinyin, output, weight) and (similar_word, output, weight) of words with a usable length."""
    words = words.where(F.length("word").between(SHORTEST, LONGEST))
    pinyin = readings(words, table, None).join(words, "word").groupBy("pinyin", F.col("word").alias("output")).agg(F.max("weight").alias("weight"))
    similar = similar_words(words, groups).join(words, "word").groupBy(F.col("similar").alias("similar_word"), F.col("word").alias("output")).agg(F.max("weight").alias("weight"))
    return pinyin, similar


def exact(queries: DataFrame, words: DataFrame) -> DataFrame:
    return queries.join(words, F.col("clean") == F.col("word")).select("query", F.col("word").alias("output"), "weight", F.lit(2).alias("tier"))


def homophones(queries: DataFrame, pinyin: DataFrame, table: DataFrame) -> DataFrame:
    """query, output, weight: dictionary words with a reading of the query; digits are no part of readings."""
    bare = F.regexp_replace("clean", "[0-9]", "")
    asked = queries.select("query", bare.alias("word"))
    read = readings(asked.select("word").distinct(), table, READINGS)
    found = asked.join(read, "word").join(pinyin, "pinyin").groupBy("query", "output").agg(F.max("weight").alias("weight"))
    return found.withColumn("tier", F.lit(3))


def similar_form(queries: DataFrame, similar: DataFrame) -> DataFrame:
    return queries.join(similar, F.col("clean") == F.col("similar_word")).select("query", "output", "weight", F.lit(4).alias("tier"))


def gram_candidates(queries: DataFrame, entries: DataFrame, key: str = "pinyin", most: int = PER_PINYIN) -> DataFrame:
    """query, asked, entry, output, weight, shared: the entries that share most bigrams with each spelling asked for.

    ``queries``: query, asked; ``entries``: key, output, weight.  Bigrams are
    counted as sets; equal counts go by weight and then output.
    """
    left = queries.select("query", "asked", F.explode(F.array_distinct(grams(F.col("asked"), 2, 2))).alias("gram"))
    right = entries.select(F.col(key).alias("entry"), "output", "weight", F.explode(F.array_distinct(grams(F.col(key), 2, 2))).alias("gram"))
    counts = left.join(right, "gram").groupBy("query", "asked", "entry", "output", "weight").agg(F.count("*").alias("shared"))
    place = F.row_number().over(Window.partitionBy("query", "asked").orderBy(F.desc("shared"), F.desc("weight"), "output", "entry"))
    return counts.withColumn("place", place).where(F.col("place") <= most).drop("place")


def _chinese(s: str) -> int:
    return sum("一" <= c <= "龥" for c in s)


def gram_verdict(query: str, asked: str, output: str, entry: str, letters: tuple[list[str], list[str]] = ((), ())) -> str:
    """right, accept or reject for one n-gram candidate.

    ``asked`` and ``entry`` are the spellings of query and output, ``letters``
    their first-letter spellings.
    """
    if not query or not output:
        return "reject"
    rest = remainder(query, output)
    if all(c in DIGITS for c in rest):
        return "right"
    n = _chinese(query)
    if n == _chinese(output) and damerau(asked, entry) <= 2:
        if query[0] == output[0] or (n and len(rest) / n / 2 < 0.3):
            return "accept"
    if query[0] != output[0] and query[0] != entry[:1]:
        return "reject"
    shorter = min(len(asked), len(entry))
    if len(lcs(asked, entry)[0]) == shorter:
        return "accept"
    a, b = letters
    if len(a) <= 1 or len(b) <= 1:
        return "reject"
    return "accept" if any(len(lcs(x, y)[0]) in (len(x), len(y)) for x in a for y in b) else "reject"


def _verdicts(query: pd.Series, asked: pd.Series, output: pd.Series, entry: pd.Series) -> pd.Series:
    return pd.Series([gram_verdict(q or "", a or "", o or "", e or "") for q, a, o, e in zip(query, asked, output, entry)], dtype=object)


verdict_column = F.pandas_udf(_verdicts, T.StringType())


def homophone_verdict(query: str, output: str) -> str:
    """right if the two differ by digits alone, keep if they share a character or the query is ASCII, else drop."""
    if query.isascii():
        return "keep"
    if not lcs(query, output)[0]:
        return "drop"
    rest = remainder(query, output)
    return "right" if rest and all(c in DIGITS for c in rest) else "keep"


def _homophone_verdicts(query: pd.Series, output: pd.Series) -> pd.Series:
    return pd.Series([homophone_verdict(q, o) for q, o in zip(query, output)], dtype=object)


homophone_column = F.pandas_udf(_homophone_verdicts, T.StringType())


def cascade(queries: DataFrame, *tiers: DataFrame) -> DataFrame:
    """query, tier, candidates (by weight, then word): those of the lowest tier that found any; 0 for an empty query, null for none."""
    found = tiers[0].select("query", "output", "weight", "tier")
    for t in tiers[1:]:
        found = found.unionByName(t.select("query", "output", "weight", "tier"))
    by = found.groupBy("query", "tier").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("output").alias("o")))).alias("x"))
    low = by.groupBy("query").agg(F.min(F.struct("tier", F.transform("x", lambda v: v["o"]).alias("candidates"))).alias("best"))
    asked = queries.select("query", "clean").distinct().join(low, "query", "left")
    tier = F.when(F.col("clean") == "", F.lit(0)).otherwise(F.col("best.tier"))
    return asked.select("query", tier.alias("tier"), F.coalesce("best.candidates", F.array().cast("array<string>")).alias("candidates"))


def correct(queries: DataFrame, forced: DataFrame, words: DataFrame, pinyin: DataFrame, similar: DataFrame, table: DataFrame) -> DataFrame:
    """query, status (right, candidates, no_solution), tier, candidates for a table of queries."""
    queries = queries.select("query").distinct().withColumn("clean", clean_query(F.col("query")))
    first = queries.join(forced, F.col("clean") == F.col("word")).select("query", "output", F.lit(0).cast("long").alias("weight"), F.lit(1).alias("tier"))
    phones = homophones(queries, pinyin, table).join(queries, "query")
    phones = phones.withColumn("verdict", homophone_column("clean", "output"))
    asked = queries.select("query", F.regexp_replace("clean", "[0-9]", "").alias("word"))
    spelled = asked.join(readings(asked.select("word").distinct(), table, None), "word").select("query", F.col("pinyin").alias("asked"))
    grams_ = gram_candidates(spelled, pinyin).join(queries, "query").withColumn("verdict", verdict_column("clean", "asked", "output", "entry"))
    grams_ = grams_.where("verdict <> 'reject'").groupBy("query", "output").agg(F.max("weight").alias("weight"), F.max("verdict").alias("verdict")).withColumn("tier", F.lit(5))
    tiers = [first, exact(queries, words), phones.where("verdict <> 'drop'"), similar_form(queries, similar), grams_]
    out = cascade(queries, *tiers)
    # a verdict of right in the tier that answers means that the query stands as it is
    right = phones.where("verdict = 'right'").select("query", F.lit(3).alias("tier")).unionByName(grams_.where("verdict = 'right'").select("query", "tier")).distinct().withColumn("_right", F.lit(True))
    out = out.join(right, ["query", "tier"], "left")
    stands = (F.col("tier") == 0) | (F.col("tier") == 2) | F.coalesce("_right", F.lit(False))
    status = F.when(F.coalesce(stands, F.lit(False)), "right").when(F.col("tier").isNull(), "no_solution").otherwise("candidates")
    return out.select("query", status.alias("status"), "tier", F.when(status == "candidates", F.col("candidates")).otherwise(F.array().cast("array<string>")).alias("candidates"))


def part_chinese(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    chinese = F.col("word").rlike(f"[{CJK}]")
    return words.where(chinese), words.where(~chinese)
