"""Hits of a table of queries and the courses of an edit's parents, against brute force."""

import random
import time

import pytest

from tessera.plans import entities
from tessera.streaming import incremental

DOCS, QUERIES = "doc_id long, text string", "query_id long, query string"


def _hits(spark, queries, docs):
    rows = entities.hits_per_query(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(docs, DOCS), "doc_id", "text")
    return sorted(((r.query_id, r.hits) for r in rows.collect()), key=str)


def _expected(queries, docs):
    words = {}
    for key, text in docs:
        words.setdefault(key, set()).update((text or "").split())
    asked = [(k, set((q or "").split())) for k, q in queries]
    return sorted(((k, sum(q <= w for w in words.values()) if q and k is not None else 0) for k, q in asked), key=str)


@pytest.mark.parametrize("few", [1000, 1])
def test_hits_per_query(spark, monkeypatch, few):
    monkeypatch.setattr(entities, "FEW_TOKENS", few)
    rng = random.Random(5)
    words = [c * n for c in "abcdef" for n in (1, 2)]
    some = lambda most: " ".join(rng.choices(words, [2.0**-i for i in range(12)], k=rng.randint(0, most)))
    docs = [(k, some(12)) for k in range(60)] + [(None, "a b"), (None, "c"), (61, None)]
    queries = [(k, some(4)) for k in range(80)] + [(80, None), (None, "a"), (81, "zz"), (82, "a zz"), (83, "c a b")]
    assert _hits(spark, queries, docs) == _expected(queries, docs)


def test_hits_of_a_document_in_two_rows(spark):
    queries, docs = [(1, "a"), (2, "a b")], [(1, "a"), (1, "a"), (2, "b"), (2, "a")]
    assert _hits(spark, queries, docs) == _expected(queries, docs) == [(1, 2), (2, 1)]


def test_equal_queries_are_looked_up_once(spark):
    """2,000 queries of the same word over 2,000 documents that have it shuffle rows, not pairs."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    time.sleep(1)  # what ran before is counted with a delay
    start = written()
    got = _hits(spark, [(k, "a b"[: 1 + k % 2 * 2]) for k in range(2000)], [(k, f"a b {k}") for k in range(2000)])
    time.sleep(1)
    assert got == sorted([(k, 2000) for k in range(2000)], key=str)
    assert written() - start < 1_000_000


EDIT = incremental.EDIT_EVENT


def test_a_parent_is_expanded_once(spark):
    """300 edits of the same two parents name each of their courses once, not 300 times."""
    courses = spark.createDataFrame([(f"c{k}", f"p{k % 3}") for k in range(300)] + [("none", None)], "course_id string, parent_id string")
    edits = spark.createDataFrame([(f"e{k}", "p0", "p1" if k % 2 else "") for k in range(300)] + [("xxxx", "p2", "p2"), ("last", None, None)], EDIT)
    got = [r.course_id for r in incremental.parent_ids(edits, courses).collect()]
    assert sorted(got) == sorted([f"e{k}" for k in range(300)] + ["last"] + [f"c{k}" for k in range(300) if k % 3 < 2])


def test_every_batch_expands_its_own_parents(spark, tmp_path):
    """A parent that an earlier batch named is expanded again."""
    courses = spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("c3", "p2")], "course_id string, parent_id string")
    for k, row in enumerate([("e1", "p1", None), ("e2", "p1", "p2"), ("xxxx", None, None)]):
        spark.createDataFrame([row], EDIT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = incremental.json_source(spark, str(tmp_path / "in"), EDIT, per_batch=1)
    batches = []
    write = lambda ids, k: batches.append(sorted(r.course_id for r in ids.collect()))
    assert incremental.rebuild_stream(stream, write, str(tmp_path / "state"), available_now=True, ids=lambda df: incremental.parent_ids(df, courses)).awaitTermination(60)
    assert sorted(batches) == [[], ["c1", "c2", "c3", "e2"], ["c1", "c2", "e1"]]
