import pytest

from tessera.llm import pareto_mix


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full = {}
    while True:
        rest = [s for s in names if s not in full]
        left = sum(sizes.values()) - sum(full.values())
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return {**full, **{s: left * weight[s] / total for s in rest}}
        full |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70}, {"x": 3}, {"a": 0, "b": 40, "é": 7, "z": 900, "zz": 1}])
def test_targets_fill_up(spark, sizes):
    out = pareto_mix.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = slow_targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in out} == want


def test_repeated_rows_are_told_apart_where_the_sample_ends(make, words):
    text = words(40, 8)
    docs = make([(1, text, "a")] * 90 + [(2, words(50, 9), "b")] * 30 + [(None, words(10, 7), None)] * 7)
    want = {}
    for r in pareto_mix.mix(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {}
    for r in pareto_mix.repeat_rows(docs).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_mix(spark, make, words):
    rows = [(i, words(20 + i % 60, i), f"s{i % 4}") for i in range(800)] + [(900, None, None), (901, "", "s1"), (902, words(30, 9), None), (3, words(23, 3), "s3")]
    docs = make(rows)
    out = pareto_mix.mix(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert r.size == len(next(t for i, t, *_ in rows if i == r.doc_id) or "") * 0 + len((next(t for i, t, *_ in rows if i == r.doc_id) or "").split())
        assert 0 <= r.copies <= 3
        x = by.setdefault(r.source, [0, r.target, r.source_size])
        x[0] += r.size * r.copies
    assert {s: pytest.approx(x[1]) for s, x in by.items()} == slow_targets({s: x[2] for s, x in by.items()})
    assert all(abs(x[0] - x[1]) <= 100 for x in by.values())
    again = pareto_mix.mix(docs.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.copies) for r in out) == sorted((str(r.doc_id), r.copies) for r in again)
    repeated = pareto_mix.repeat_rows(docs)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r.copies for r in out if r.size) + sum(1 for r in out if not r.size)
    wide = docs.selectExpr("*", *[f"'{x}' as {x}" for x in ("row", "i", "no_i", "s", "no_s", "digest", "copies", "n", "least", "most", "rows", "_id", "_digest")])
    assert pareto_mix.repeat_rows(wide).columns == wide.columns
    assert sorted((str(r.doc_id), r.text or "") for r in pareto_mix.repeat_rows(wide).collect()) == sorted((str(r.doc_id), r.text or "") for r in repeated.collect())
    assert pareto_mix.mix(make([])).count() == 0 and pareto_mix.repeat_rows(make([])).count() == 0
