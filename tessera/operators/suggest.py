"""Suggestions: weighted prefix completion and the dictionaries behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.pinyin import first_letters, fuzzy_column, initials
from tessera.functions.text import cut_words, half_width, runs, squeeze, windows

# Fixed values of the service: dictionaries by number, lengths, weights.
DICTIONARIES = {1: "platform", 2: "forum_user", 3: "course_name"}
SHORTEST, LONGEST, TOP = 2, 50, 10_000
CATEGORY_DROP = {"course_name": 0, "about": 5, "chapter": 10, "sequential": 15}
EXPANSIONS = {"platform": ("full", "first", "initials", "fuzzy", "mixed"), "forum_user": ("full", "first"), "course_name": ("full", "first", "initials", "fuzzy")}


def complete(entries: DataFrame, query: str, most: int = 5, dictionary: str | None = None) -> DataFrame:
    """The heaviest entries whose input starts with the query; the query itself is left out."""
    asked = query.lower()[:LONGEST]
    rows = entries.where(F.col("dict") == dictionary) if dictionary else entries
    hits = rows.where(F.col("input").startswith(asked) & (F.col("output") != query))
    best = hits.groupBy("output").agg(F.max("weight").alias("weight"))
    return best.orderBy(F.desc("weight"), "output").limit(most)


def complete_many(entries: DataFrame, queries: DataFrame, most: int = 5) -> DataFrame:
    """The same for a table of queries: inputs' prefixes meet the queries in an equi-join.

    Only prefixes as long as some query are made.
    """
    asked = queries.select("query", F.lower(F.substring("query", 1, LONGEST)).alias("prefix"))
    sizes = asked.select(F.length("prefix").alias("n")).distinct()
    prefixes = entries.join(F.broadcast(sizes), F.length("input") >= F.col("n")).select("output", "weight", F.substr("input", F.lit(1), F.col("n")).alias("prefix"))  # at most LONGEST sizes
    hits = prefixes.join(asked, "prefix").where("output <> query").groupBy("query", "output").agg(F.max("weight").alias("weight"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("weight"), "output"))
    return hits.withColumn("place", place).where(F.col("place") <= most)


def usable(c: Column) -> Column:
    return F.length(c).between(SHORTEST, LONGEST) & ~c.rlike(r"^第?[0-9一二三四五六七八九十]")


def main_dictionary(texts: DataFrame, tokens: Column, stopwords: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """input, weight from category, value: tokens by category, parts of course names at full weight, known phrases."""
    drop = F.create_map(*[F.lit(x) for kv in CATEGORY_DROP.items() for x in kv])
    rows = texts.withColumn("weight", F.lit(TOP) - F.try_element_at(drop, F.col("category"))).where("weight is not null")
    words = rows.select(F.explode(tokens).alias("input"), "weight")
    parts = F.split(squeeze(F.lower(half_width(F.col("value")))), r"[\p{Punct}]+")
    names = texts.where(F.col("category") == "course_name").select(F.explode(parts).alias("input"), F.lit(TOP).alias("weight"))
    found = words.unionByName(names.withColumn("input", F.trim("input")))
    if phrases is not None:
        found = found.unionByName(phrase_matches(rows, phrases).select(F.col("phrase").alias("input"), "weight"))
    found = found.where(usable(F.col("input"))).join(F.broadcast(stopwords.select(F.col("word").alias("input"))), "input", "left_anti")  # a list of some hundred words
    return found.groupBy("input").agg(F.max("weight").alias("weight"))


def phrase_matches(rows: DataFrame, phrases: DataFrame, text: str = "value", longest: int = 40) -> DataFrame:
    """rows with each phrase that occurs anywhere in the text.

    Substrings are made only in the lengths that phrases have and meet the
    phrases in an equi-join.
    """
    sizes = sorted(r.n for r in phrases.select(F.length("phrase").alias("n")).where(f"n between 1 and {longest}").distinct().collect())
    body = F.lower(F.col(text))
    cut = [windows(body, n) for n in sizes]
    subs = F.array_distinct(F.concat(*cut)) if cut else F.array().cast("array<string>")
    return rows.withColumn("phrase", F.explode(subs)).join(phrases.select("phrase").distinct(), "phrase", "left_semi")


def word_phrases(rows: DataFrame, phrases: DataFrame, tokens: Column, longest: int = 8) -> DataFrame:
    """The same by whole words: runs of up to ``longest`` tokens that are a phrase."""
    spelled = rows.withColumn("_t", tokens)
    spans = F.concat(*[runs(F.col("_t"), n) for n in range(1, longest + 1)])
    return spelled.withColumn("phrase", F.explode(F.array_distinct(spans))).drop("_t").join(phrases.select("phrase").distinct(), "phrase", "left_semi")


def clean_nickname(c: Column) -> Column:
    return squeeze(F.lower(half_width(c)))


def user_dictionary(users: DataFrame, key: str = "user_id", name: str = "nickname") -> DataFrame:
    """input, output, user_id, weight: acceptable nicknames, the first user of each."""
    rows = users.where(~F.col(name).rlike("[\t\n \u0085]"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(key))).where("_n = 1")
    entry = cut_words(clean_nickname(F.col(name)), LONGEST)
    return rows.select(entry.alias("input"), F.col(name).alias("output"), F.col(key).alias("user_id"), (F.lit(TOP) - 2 * F.length(entry)).alias("weight"))


def course_dictionary(courses: DataFrame, key: str, name: str, enrolled: str) -> DataFrame:
    """input, output, course_id, weight: cleaned names, enrolments + 100, the first course of each input."""
    clean = F.translate(F.col(name), "（）—–：、，*•\"\n\t《》®", "()--:,,   ")
    entry = cut_words(F.trim(squeeze(F.lower(half_width(clean)))), LONGEST)
    rows = courses.select(entry.alias("input"), F.trim(squeeze(clean)).alias("output"), F.col(key).alias("course_id"), (F.coalesce(enrolled, F.lit(0)) + 100).alias("weight"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("input").orderBy("course_id"))).where("_n = 1").drop("_n")


def expand(entries: DataFrame, syllables: str, kinds: tuple[str, ...]) -> DataFrame:
    """input, output, weight: an entry's spellings, each a little lighter than the word (array ``syllables``)."""
    s, w = F.col(syllables), F.col("weight")
    full = F.array_join(s, "")
    fuzzy = F.transform(s, lambda x: F.concat(F.array(x), fuzzy_column(x)))
    product = F.aggregate(fuzzy, F.array(F.lit("")), lambda acc, o: F.flatten(F.transform(acc, lambda a: F.transform(o, lambda x: F.concat(a, x)))))
    few = (F.size(s) < 5) & (F.length("output") < 6)
    mixed = F.aggregate(F.when(few, s).otherwise(F.slice(s, 1, 0)), F.array(F.lit("")), lambda acc, x: F.flatten(F.transform(acc, lambda a: F.array(F.concat(a, x), F.concat(a, F.substring(x, 1, 1))))))
    branches = {
        "full": F.array(F.struct(full.alias("input"), (w - 1).cast("double").alias("weight"))),
        "first": F.array(F.struct(first_letters(s).alias("input"), (w - 2).cast("double").alias("weight"))),
        "initials": F.array(F.struct(initials(s).alias("input"), (w - 3).cast("double").alias("weight"))),
        "fuzzy": F.transform(F.filter(product, lambda x: x != full), lambda x: F.struct(x.alias("input"), (w / 2).cast("double").alias("weight"))),
        "mixed": F.when(few, F.transform(F.filter(mixed, lambda x: x != full), lambda x: F.struct(x.alias("input"), (w / 2 - 100).cast("double").alias("weight")))).otherwise(F.array().cast("array<struct<input:string,weight:double>>")),
    }
    own = F.array(F.struct(F.col("input").alias("input"), w.cast("double").alias("weight")))
    all_ = F.concat(own, *[branches[k] for k in kinds])
    rows = entries.select("output", F.explode(all_).alias("x")).select(F.col("x.input").alias("input"), "output", F.col("x.weight").alias("weight"))
    return rows.where(F.length("input").between(SHORTEST, LONGEST)).groupBy("input", "output").agg(F.max("weight").alias("weight"))


def offline_filter(words: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words whose known count is not zero (unknown ones stay), and the unknown ones with count 0 to look up."""
    joined = words.join(known, "word", "left")
    return joined.where(F.coalesce(F.col("num") != 0, F.lit(True))).drop("num"), joined.where("num is null").select("word", F.lit(0).alias("num"))
