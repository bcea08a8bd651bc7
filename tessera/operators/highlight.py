"""Marking query tokens in texts, with the best window of a long one."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the service.
OPEN, CLOSE, WINDOW = '<span class="keyword">', "</span>", 56


def highlight_short(c: Column, tokens: list[str]) -> Column:
    """All tokens marked, the longest first at each place, whatever the case; for texts that need no window."""
    tokens = sorted({t for t in tokens if t}, key=lambda t: (-len(t), t))
    if not tokens:
        return c
    pattern = "(?i)(" + "|".join(re.escape(t) for t in tokens) + ")"
    return F.regexp_replace(c, pattern, f"{OPEN}$1{CLOSE}")


def segments(text: str, tokens: set[str]) -> list[tuple[str, int]]:
    """The text as tokens (with their length) and single characters (with 0), by longest match."""
    low, out, i = text.lower(), [], 0
    sizes = sorted({len(t) for t in tokens if t}, reverse=True)
    while i < len(text):
        n = next((n for n in sizes if low[i : i + n] in tokens), 0)
        out.append((text[i : i + max(n, 1)], n))
        i += max(n, 1)
    return out


def highlight(text: str, tokens: set[str], window: int = WINDOW) -> str:
    """Marked text; of a long one the window of segments with the largest sum of cubed token lengths.

    Without tokens the text is returned whole.  The first window is the shortest prefix wide enough, and it is shown with
    one segment more than it was weighed by.  A later one must be wide enough
    and weigh strictly more.
    """
    tokens = {t.lower() for t in tokens if t}
    if not tokens:
        return text
    parts = segments(text, tokens)
    shown = lambda ps: "".join(f"{OPEN}{s}{CLOSE}" if n else s for s, n in ps)
    if len(text) <= window:
        return shown(parts)
    width = [max(n, 1) for _, n in parts]
    cubes = [n**3 for _, n in parts]
    j = size = 0
    while j < len(parts) and size < window:
        size += width[j]
        j += 1
    weight = best = sum(cubes[:j])
    first, last = 0, j
    i = 0
    for k in range(j, len(parts)):
        size += width[k] - width[i]
        weight += cubes[k] - cubes[i]
        i += 1
        if size >= window and weight > best:
            best, first, last = weight, i, k
    body = shown(parts[first : last + 1])
    if first == 0:
        return body + "..."
    # a segment's number is compared with a number of characters, as the service does
    return "..." + body if len(text) == last + 1 else "..." + body + "..."


def highlight_column(tokens: list[str], window: int = WINDOW):
    """The same as an Arrow-batched function; for the rows of one page."""
    wanted = set(tokens)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else highlight(t, wanted, window) for t in texts], dtype=object)

    return run


#: Fields that are marked, by kind of document.
PLANS = {
    "course": ["title", "about", "staff", "structure"],
    "knowledge": ["frag_title", "frag_desc"],
    "live": ["live_title", "live_subtitle"],
    "microdegree": ["microdegree_title", "microdegree_subtitle"],
}


def highlight_rows(rows: DataFrame, kind: str, tokens: list[str]) -> DataFrame:
    """Marks the fields that the kind's plan names and the rows have."""
    mark = highlight_column(tokens)
    return rows.withColumns({f"{c}_highlight": mark(F.col(c)) for c in PLANS[kind] if c in rows.columns})
