"""Named analyzers: each turns a text column into an array of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text

Analyzer = Callable[[Column], Column]


def _unique(c: Column) -> Column:
    return F.array_distinct(F.filter(c, lambda x: x != ""))


def dictionary_tokens(c: Column, words: list[str]) -> Column:
    """All dictionary words in the text, overlapping ones too, and its single CJK characters; Latin runs as they are.

    ``words`` is a dictionary of a bounded size; larger ones go through ``suggest.phrase_matches``.
    """
    low = F.lower(c)
    found = F.filter(F.array(*[F.lit(w) for w in sorted(set(words))]), lambda w: F.contains(low, w)) if words else F.array().cast("array<string>")
    single = F.filter(F.split(low, ""), lambda x: x.rlike(f"[{text.CJK}]"))
    latin = F.filter(F.split(F.regexp_replace(low, r"[^a-z0-9à-ÿ]+", " "), " "), lambda x: x != "")
    return F.array_distinct(F.concat(found, single, latin))


def _table_converter(source: str, target: str) -> Analyzer:
    return lambda c: F.array(F.translate(c, source, target))


def character_conversion(pairs: dict[str, str]) -> Analyzer:
    """Characters by a table, such as simplified for traditional; the table is an input."""
    return _table_converter("".join(pairs), "".join(pairs.values()))


#: Analyzers by name; those that need a table are made by the functions above.
ANALYZERS: dict[str, Analyzer] = {
    "simple": lambda c: text.latin_tokens(c),
    "standard": lambda c: text.latin_tokens(c, keep_digits=True),
    "keyword_lowercase": lambda c: F.array(F.lower(c)),
    "whitespace_lowercase": lambda c: _unique(F.split(F.lower(c), r"\s+")),
    "ngram_1_2": lambda c: _unique(text.grams(F.lower(c), 1, 2)),
    "ngram_1_3": lambda c: _unique(text.grams(F.lower(c), 1, 3)),
    "ngram_1_10": lambda c: _unique(text.grams(F.lower(c), 1, 10)),
    "ngram_2_10": lambda c: _unique(text.grams(F.lower(c), 2, 10)),
    "ngram_3_10": lambda c: _unique(text.grams(F.lower(c), 3, 10)),
    "edge_ngram": lambda c: text.edge_grams(F.lower(c), 1, 10),
    "comma": lambda c: text.pattern_tokens(c, ","),
    "semicolon": lambda c: text.pattern_tokens(c, ";"),
    "percent": lambda c: text.pattern_tokens(c, "%"),
    "path": lambda c: text.path_prefixes(c),
}


def analyze(c: Column, name: str) -> Column:
    if name not in ANALYZERS:
        raise ValueError(f"no such analyzer: {name}")
    return ANALYZERS[name](F.coalesce(c, F.lit("")))
