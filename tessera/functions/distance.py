"""Common subsequences and edit distances that Spark lacks, as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> tuple[list[int], list[int]]:
    """Places in a and b of a longest common subsequence; on a tie a's later character is dropped first."""
    n, m = len(a), len(b)
    size = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            size[i][j] = size[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(size[i - 1][j], size[i][j - 1])
    x, y, i, j = [], [], n, m
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            x.append(i)
            y.append(j)
        elif size[i - 1][j] >= size[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return x[::-1], y[::-1]


def lcs_string(a: str, b: str) -> str:
    return "".join(a[i] for i in lcs(a, b)[0])


def remainder(a: str, b: str) -> str:
    """Characters of a and then of b that are outside their common subsequence."""
    x, y = map(set, lcs(a, b))
    return "".join(c for i, c in enumerate(a) if i not in x) + "".join(c for i, c in enumerate(b) if i not in y)


def damerau(a: str, b: str) -> int:
    """Damerau-Levenshtein distance, unrestricted: a swap of neighbours counts one, also around other edits."""
    last: dict[str, int] = {}
    n, m = len(a), len(b)
    far = n + m
    d = [[far] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        seen = 0
        for j in range(1, m + 1):
            row, col = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[row][col] + (i - row - 1) + 1 + (j - col - 1))
        last[a[i - 1]] = i
    return d[n + 1][m + 1]


def _pairs(f, kind: T.DataType):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(run, kind)


lcs_column = _pairs(lcs_string, T.StringType())
remainder_column = _pairs(remainder, T.StringType())
damerau_column = _pairs(damerau, T.LongType())
