"""Truth tables of the planner, requests, groups of clauses and structures."""

import pytest

from tessera.operators import cdc, etl, filters, page, planner, retrieve
from tessera.plans.request import AppRequest, RelatedRequest, SearchRequest, SuggestRequest
from tessera.plans.search import Catalogue, search

CASES = [
    ("a b", {"a": 2, "b": 1}, [], ["b", "a", "a b"], 0, 1),
    ("xx yy", {"xx": 2, "yy": 1}, ["xx"], ["yy", "xx yy"], 1, 0),
    ("data database", {"database": 2, "data": 1}, ["data"], ["database", "data database"], 1, 0),
    ("a ab", {"ab": 2, "a": 1}, ["ab"], ["a", "a ab"], 1, 0),
    ("x+y", {"x": 2, "y": 1}, [], ["x", "y", "x+y"], 0, 1),
    ("c++ x", {"c++": 2, "xx": 1}, ["c++"], ["xx", "c++ x"], 1, 0),
    ("only", {"only": 1}, [], ["only"], 0, 1),
    ("none", {}, [], ["none"], 0, 0),
    ("", {}, [], [], 0, 0),
    ("abcd", {"abcd": 3, "ab": 2, "cd": 1}, ["ab"], ["abcd", "cd"], 1, 0),
    ("p q r", {"pp": 3, "qq": 2, "rr": 1}, ["pp"], ["qq", "rr", "p q r"], 1, 0),
    ("t", {"tuv": 3, "xx": 2, "uv": 1}, ["uv"], ["tuv", "xx", "t"], 1, 0),
    ("w", {"aa": 6, "bb": 5, "cc": 4, "dd": 3}, ["aa"], ["bb", "cc", "dd", "w"], 1, 0),
    ("w", {"aa": 6, "bb": 5, "cc": 4, "dd": 3, "ee": 2, "ff": 1}, ["aa"], ["bb", "cc", "dd", "ee", "ff", "w"], 1, 2),
    ("aa", {"aa": 6, "bb": 5, "cc": 4, "dd": 3}, ["bb"], ["aa", "cc", "dd"], 1, 0),
]


@pytest.mark.parametrize("query,weights,must,should,must_p,should_p", CASES)
def test_plan(query, weights, must, should, must_p, should_p):
    plan = planner.plan_query(query, weights)
    assert (plan.must, plan.should, plan.must_p, plan.should_p) == (must, should, must_p, should_p)


def test_strict_and_relaxed():
    assert planner.plan_query("a b c", {"a": 1}, 10).clauses() == [("a b c", 1.0, "should")]
    plan = planner.relaxed(planner.plan_query("xx yy", {"xx": 2, "yy": 1}))
    assert (plan.must, plan.should, plan.must_p, plan.should_p) == ([], ["yy", "xx yy", "xx"], 0, 0)


@pytest.mark.parametrize("must_p,should_p,want", [(1, 0, {1, 2}), (1, 1, {1}), (0, 0, {1, 3}), (0, 2, set())])
def test_groups_of_clauses(spark, must_p, should_p, want):
    scores = spark.createDataFrame([(1, "m", 2.0), (1, "s", 2.0), (2, "m", 2.0), (3, "s", 2.0), (4, "s", 2.0), (4, "n", 9.0), (5, "s", 0.5)], "id int, token string, score double")
    clauses = spark.createDataFrame([("m", 1.0, "must"), ("s", 1.0, "should"), ("n", 1.0, "must_not")], "token string, weight double, clause string")
    assert {r.id for r in retrieve.boolean_scores(scores, ["id"], clauses, must_p, should_p).collect()} == want


def test_requests():
    r = SearchRequest.parse({"query": " a/b ", "owner": "ABC;d", "cid": "1;2", "org": "others", "num": "5", "unknown": "1"})
    assert (r.query, r.owner, r.cid, r.org, r.num, r.st) == ("a b", ["abc", "d"], [1, 2], "others", 5, 1)
    assert SearchRequest.parse({}).qt == 2
    for bad in ({"qt": "13"}, {"home": "1", "version": "2"}, {"version": "3"}, {"num": "x"}):
        with pytest.raises(ValueError):
            SearchRequest.parse(bad)
    assert AppRequest(13, num=50).checked().num == 10
    for bad in (AppRequest(1), SuggestRequest("a", 9), RelatedRequest("a", 9)):
        with pytest.raises(ValueError):
            bad.checked()


def test_search_falls_back(spark):
    courses = spark.createDataFrame([(1, "o"), (2, "o")], "course_id long, owner string")
    children = spark.createDataFrame([(1, 1, "title", "machine learning"), (2, 2, "title", "deep systems")], "course_id long, child_id long, kind string, text string")
    request = SearchRequest.parse({"query": "quantum deep", "qt": "2"})
    hits, totals = search(Catalogue(courses, children, {}), request, {"quantum": 9.0, "deep": 1.0}, "2020-01-01 00:00:00")
    assert [(r.item_type, r.id) for r in hits.collect()] == [("course", "2")]
    assert {r.item_type: r.total for r in totals.collect()} == {"course": 1, "all": 1}
    assert page.Envelope.of(hits, totals).as_dict()["total"]["all"] == 1


def test_null_orgs_are_others(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "org string")
    assert [r.org for r in rows.where(filters.org("org", "others", ["a"])).collect()] == [None, "b"]


def test_diff_counts_add_up(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, None)], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (4, None), (5, "e")], "k int, v string")
    ops = {r.k: r.op for r in cdc.diff(old, new, ["k"], ["v"]).collect()}
    assert ops == {1: "delete", 2: "same", 3: "update", 4: "same", 5: "index"}


def test_windows_of_short_lists(spark):
    rows = spark.createDataFrame([(n, i, str(i)) for n in (1, 3, 5, 7) for i in range(n)], "k int, pos int, name string")
    got = {(r.k, r.pos): r.context for r in etl.context_window(rows, "k", "pos", "name").collect()}
    assert got[1, 0] == ["0"] and got[3, 2] == ["0", "1", "2"] and got[7, 0] == list("01234") and got[7, 3] == list("12345") and got[7, 6] == list("23456")


def test_old_structure(spark):
    schema = "_id struct<org:string,course:string,category:string,name:string>, definition struct<children:array<string>>, metadata struct<display_name:string,start:string>"
    rows = spark.createDataFrame([(("o", "c", "course", "r"), (["o/c/chapter/x"],), ("C", None)), (("o", "c", "chapter", "x"), ([],), ("X", "2016"))], schema)
    got = {r.item_id: (r.parent_id, r.ord) for r in etl.structure_old(rows).collect()}
    assert got == {"o/c/course/r": (None, None), "o/c/chapter/x": ("o/c/course/r", 0)}
