"""Text functions as column expressions: normalising, tokens, grams, tags, width, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms U+FF01 to U+FF5E and the ideographic space stand for ASCII.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
CJK = r"一-龥"


def squeeze(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, r"\s+", " ")


def half_width(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def strip_tags(c: Column) -> Column:
    """Drop ``<...>`` inside a line, then escape what angle brackets are left."""
    return F.replace(F.replace(F.regexp_replace(c, "<.*?>", ""), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def problem_text(c: Column) -> Column:
    """Tags dropped and brackets escaped, without the word Explanation, squeezed."""
    return F.trim(squeeze(F.replace(strip_tags(c), F.lit("Explanation"), F.lit(""))))


def html_text(c: Column) -> Column:
    """Script and style bodies and all tags as spaces, squeezed; a regular-expression approximation."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    return F.trim(squeeze(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")))


def latin_tokens(c: Column, keep_digits: bool = False) -> Column:
    """Lower-case runs of letters (and digits if asked); null gives no tokens."""
    other = r"[^\p{L}\p{N}]+" if keep_digits else r"[^\p{L}]+"
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), other, " "), " ")
    return F.filter(parts, lambda x: x != "")


def windows(c: Column, n: int) -> Column:
    """All substrings of n characters, from left to right."""
    none = F.array().cast("array<string>")
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))).otherwise(none)


def runs(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by spaces."""
    none = F.array().cast("array<string>")
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(none)


def grams(c: Column, least: int, most: int) -> Column:
    """Character n-grams for n from least to most, by length and then place."""
    return F.concat(*[windows(c, n) for n in range(least, most + 1)])


def edge_grams(c: Column, least: int, most: int) -> Column:
    """Prefixes of the lengths asked for that the text has."""
    return F.transform(F.filter(F.array(*[F.lit(n) for n in range(least, most + 1)]), lambda n: n <= F.length(c)), lambda n: F.substr(c, F.lit(1), n))


def path_prefixes(c: Column, separator: str = "/") -> Column:
    """Every ancestor path of a path, the shortest first."""
    parts = F.split(c, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def pattern_tokens(c: Column, separator: str) -> Column:
    """Trimmed parts between a separator (a regular expression) that are not empty."""
    return F.filter(F.transform(F.split(c, separator), F.trim), lambda x: x != "")


def cut_words(c: Column, most: int) -> Column:
    """At least five words: whole words in fewer than ``most`` characters; else the first most - 1 characters."""
    words = F.split(c, " ")
    fits = F.filter(F.sequence(F.lit(1), F.size(words)), lambda n: F.length(F.array_join(F.slice(words, F.lit(1), n), " ")) < most)
    by_word = F.array_join(F.slice(words, F.lit(1), F.coalesce(F.array_max(fits), F.lit(1))), " ")
    return F.when(F.length(c) < most, c).when(F.size(words) >= 5, by_word).otherwise(F.substring(c, 1, most - 1))


# Chapter ordinals, homework and exams in course titles.
ORDINALS = (r"\(?[第]?[一二三四五六七八九十零1234567890]+[\.]?[一二三四五六七八九十零1234567890]*[章节春秋]?\)?", "作业|习题", "期[中末]考试")


def ordinals_removed(c: Column) -> Column:
    """A title without chapter ordinals and words for homework and exams."""
    for pattern in ORDINALS:
        c = F.regexp_replace(c, pattern, "")
    return F.trim(c)


def latin_removed(c: Column) -> Column:
    """Only what is neither ASCII letter, digit, white space nor punctuation."""
    return F.regexp_replace(c, r"[A-Za-z0-9\s\p{Punct}\p{P}]+", "")


def course_id_kind(c: Column) -> Column:
    """new for scheme:org+number+run, old for org/number/run, none for anything else."""
    return F.when(c.rlike(r"^[^:+/]+:[^+/]+\+[^+/]+\+[^+/]+$"), "new").when(c.rlike(r"^[^/+]+/[^/+]+/[^/+]+$"), "old").otherwise("none")


def course_number(c: Column) -> Column:
    """The number part of a course id of either kind, in upper case."""
    new = F.regexp_extract(c, r"^[^:+/]+:[^+/]+\+([^+/]+)\+", 1)
    old = F.regexp_extract(c, r"^[^/+]+/([^/+]+)/", 1)
    return F.upper(F.when(course_id_kind(c) == "new", new).when(course_id_kind(c) == "old", old).otherwise(c))


def staff_word(c: Column) -> Column:
    """A staff name without titles if it can be a dictionary word, else null."""
    name = F.trim(F.regexp_replace(c, r"(副?教授|博士|老师|讲师|院士|先生|女士|等)", ""))
    return F.when(F.length(name).between(2, 4) & name.rlike(f"^[{CJK}].*[{CJK}]$") & ~name.rlike(r"^\d+$"), name)


def is_chinese(c: Column) -> Column:
    return c.rlike(f"[{CJK}]")


def chinese_only(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{CJK}]", "")


def digits_removed(c: Column) -> Column:
    return F.regexp_replace(c, r"[0-9]", "")


def clean_query(c: Column) -> Column:
    """Correction's cleaner: lower case, half width, bracketed remarks dropped if they begin with a number
    word and unpacked otherwise, other marks as spaces, spaces kept only between Latin words."""
    c = F.lower(half_width(F.coalesce(c, F.lit(""))))
    c = F.regexp_replace(c, r"[(\[{（【][0-9一二三四五六七八九十上中下][^)\]}）】]*[)\]}）】]", "")
    c = F.regexp_replace(c, r"[(\[{（【)\]}）】]", " ")
    c = F.regexp_replace(c, rf"[^0-9a-zà-ÿ{CJK}]+", " ")
    c = F.regexp_replace(c, rf"(?<=[{CJK}]) +| +(?=[{CJK}])", "")
    return F.trim(squeeze(c))
