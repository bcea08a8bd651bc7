import math

import numpy as np

from tessera.llm import embedding_dedup as e


def slow(rows):
    def unit(x):
        if x is None or any(v is None or not math.isfinite(v) for v in x) or not any(x):
            return None
        x = np.array(x, float)
        return x / np.linalg.norm(x)

    units = [unit(r[1]) for r in rows]
    n = len(rows)
    link = [[j for j in range(n) if j != i and rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98] for i in range(n)]
    seen, out = {}, []
    for i in range(n):
        stack, group = [i], {i}
        while stack:
            for j in link[stack.pop()]:
                if j not in group:
                    group.add(j)
                    stack.append(j)
        low = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(link[i]), low, rows[i][0] is not None and rows[i][0] == low))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(260):
        x = centres[i % 6] + rng.normal(size=12) * (0.06 if i % 3 else 0.5)
        rows.append((i, [float(np.float32(v)) for v in x], i % 3 if i % 17 else None))
    rows += [(300 + k, rows[1][1], rows[1][2]) for k in range(5)] + [(400, rows[1][1], rows[1][2]), (400, rows[1][1], rows[1][2])]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 12, 1), (503, [float("nan")] + [1.0] * 11, 1), (504, [None] + [1.0] * 11, 1), (505, [float("inf")] + [1.0] * 11, 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1), (None, rows[4][1], rows[4][2])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, low string")
    got = [tuple(r) for r in e.embedding_components(df, block=16).collect()]
    assert sorted(got, key=str) == sorted(slow(rows), key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert e.embedding_components(df).count() == 0
    one = spark.createDataFrame([(1, [3.0, 4.0], 1)], df.schema)
    assert [tuple(r) for r in e.embedding_components(one).collect()] == [(1, 0, 1, True)]
