"""Pinyin: readings by table, fuzzy syllables, mixed spellings.  The table of readings is an input."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Initials and finals that are easily confused, both ways.
INITIALS = {"c": "ch", "s": "sh", "z": "zh"}
FINALS = {"an": "ang", "en": "eng", "in": "ing", "ian": "iang", "uan": "uang"}
_INITIAL = r"^(zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?"
#: Spellings of a word beyond which mixing is not tried.
MAX_MIXED = 64


def _other(pairs: dict[str, str]) -> dict[str, str]:
    return pairs | {b: a for a, b in pairs.items()}


def split_syllable(s: str) -> tuple[str, str]:
    n = 2 if s[:2] in ("zh", "ch", "sh") else 1 if s[:1] in set("bpmfdtnlgkhjqxrzcsyw") else 0
    return s[:n], s[n:]


def fuzzy_syllable(s: str, every: bool = False) -> list[str]:
    """Other spellings of a syllable: one part exchanged, or with ``every`` both as well; never itself."""
    a, b = split_syllable(s)
    x, y = _other(INITIALS).get(a), _other(FINALS).get(b)
    out = ([x + b] if x else []) + ([a + y] if y else []) + ([x + y] if every and x and y else [])
    return sorted(set(out))


def fuzzy_column(c: Column, every: bool = False) -> Column:
    """The same as a column expression."""
    entry = lambda pairs: F.create_map(*[F.lit(x) for kv in _other(pairs).items() for x in kv])
    a = F.regexp_extract(c, _INITIAL, 0)
    b = F.regexp_replace(c, _INITIAL, "")
    x, y = F.try_element_at(entry(INITIALS), a), F.try_element_at(entry(FINALS), b)
    options = [F.concat(x, b), F.concat(a, y)] + ([F.concat(x, y)] if every else [])
    return F.array_sort(F.array_distinct(F.filter(F.array(*options), lambda v: v.isNotNull())))


def fuzzy_word(syllables: list[str]) -> list[list[str]]:
    """Each syllable with its single exchanges."""
    return [sorted({s, *fuzzy_syllable(s)}) for s in syllables]


def readings(words: DataFrame, table: DataFrame, most: int | None = 10) -> DataFrame:
    """word, pinyin: every reading of a word from (char, reading), at most ``most`` by order of the spelling.

    Characters without a reading stand for themselves.  The product is built
    from left to right and cut at each step, so it stays small; None takes all.
    """
    chars = words.select("word").distinct().select("word", F.posexplode(F.split("word", "")).alias("pos", "char")).where("char <> ''")
    by_char = table.groupBy("char").agg(F.array_sort(F.collect_set("reading")).alias("options"))
    held = chars.join(by_char, "char", "left").withColumn("options", F.coalesce("options", F.array("char")))
    lists = held.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "options"))), lambda x: x["options"]).alias("lists"))
    longer = lambda acc, options: F.flatten(F.transform(acc, lambda a: F.transform(options, lambda o: F.concat(a, o))))
    step = longer if most is None else lambda acc, options: F.slice(longer(acc, options), 1, most)
    return lists.select("word", F.explode(F.aggregate("lists", F.array(F.lit("")), step)).alias("pinyin"))


def mixed_spellings(syllables: list[str]) -> list[str]:
    """Full and first-letter spellings of each syllable, mixed; none if there would be too many."""
    if not syllables or 2 ** len(syllables) > MAX_MIXED:
        return []
    return sorted({"".join(p) for p in product(*[{s, s[:1]} for s in syllables])})


def cut_pinyin(syllables: list[str], most: int) -> list[str]:
    """Leading syllables whose total length stays below ``most``."""
    out, size = [], 0
    for s in syllables:
        size += len(s)
        if size >= most:
            break
        out.append(s)
    return out


def first_letters(syllables: Column) -> Column:
    return F.array_join(F.transform(syllables, lambda s: F.substring(s, 1, 1)), "")


def initials(syllables: Column) -> Column:
    return F.array_join(F.transform(syllables, lambda s: F.when(F.regexp_extract(s, _INITIAL, 0) != "", F.regexp_extract(s, _INITIAL, 0)).otherwise(F.substring(s, 1, 1))), "")
