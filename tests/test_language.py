"""Golden cases of text, pinyin, edit distances, highlighting and correction."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import pinyin, text
from tessera.functions.distance import damerau, lcs_string, remainder
from tessera.operators import correct, highlight, related, suggest


def test_common_subsequence():
    assert lcs_string("我爱北京天安门", "我在公司北门") == "我北门"
    assert remainder("我爱北京天安门", "我在公司北门") == "爱京天安在公司"


@given(st.text("abc我", max_size=8), st.text("abc我", max_size=8))
@settings(max_examples=80, deadline=None)
def test_distance_properties(a, b):
    assert len(lcs_string(a, b)) == len(lcs_string(b, a))
    assert damerau(a, b) == damerau(b, a) <= max(len(a), len(b))
    assert len(remainder(a, b)) == len(a) + len(b) - 2 * len(lcs_string(a, b))


def test_swaps_count_once():
    assert damerau("ab", "ba") == 1 and damerau("ca", "abc") == 2 and damerau("", "xy") == 2


def test_pinyin():
    assert pinyin.cut_pinyin(["welcome to", "zhong", "guo"], 16) == ["welcome to", "zhong"]
    assert pinyin.fuzzy_syllable("chuang") == ["chuan", "cuang"]
    assert pinyin.fuzzy_syllable("chuang", every=True) == ["chuan", "cuan", "cuang"]
    assert pinyin.fuzzy_word(["guang", "cai"]) == [["guan", "guang"], ["cai", "chai"]]
    assert pinyin.mixed_spellings(["zhong", "yao"]) == ["zhongy", "zhongyao", "zy", "zyao"]


def test_readings(spark):
    table = spark.createDataFrame([("重", "zhong"), ("重", "chong"), ("要", "yao")], "char string, reading string")
    words = spark.createDataFrame([("重要",), ("重x",)], "word string")
    assert sorted(map(tuple, pinyin.readings(words, table).collect())) == [("重x", "chongx"), ("重x", "zhongx"), ("重要", "chongyao"), ("重要", "zhongyao")]


def column(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_cleaning(spark):
    assert column(spark, text.clean_query, "数学(2016春)", "编程(2)", "物理(上)", "导论(计算机)", "Java  EE，入门", None) == ["数学", "编程", "物理", "导论计算机", "java ee入门", ""]
    assert column(spark, text.course_id_kind, "course-v1:A+B+C", "A/B/C", "x") == ["new", "old", "none"]
    assert column(spark, text.course_number, "course-v1:A+b1+C", "A/b2/C") == ["B1", "B2"]
    assert column(spark, text.half_width, "ＡＢ１　！") == ["AB1 !"]
    assert column(spark, text.strip_tags, "a<b>c</b> 1 < 2") == ["ac 1 &lt; 2"]
    assert column(spark, text.staff_word, "王小明教授", "Smith", "李") == ["王小明", None, None]
    assert column(spark, text.ordinals_removed, "第一章 绪论", "期末考试") == ["绪论", ""]
    long = "one two three four five six seven eight nine ten eleven"
    assert column(spark, lambda c: text.cut_words(c, 20), long, "x" * 30, "short") == ["one two three four", "x" * 19, "short"]


def test_highlight():
    assert highlight.highlight("Big data", {"big"}) == '<span class="keyword">Big</span> data'
    body = "a" * 80 + "乐山大佛" + "b" * 80
    out = highlight.highlight(body, {"乐山大佛", "创"})
    assert out.startswith("...") and out.endswith("...") and '<span class="keyword">乐山大佛</span>' in out
    assert highlight.highlight("x" * 100, {"y"}).endswith("...")
    assert highlight.highlight("x" * 120, set()) == "x" * 120


@given(st.text("ab ", max_size=56))
@settings(max_examples=60, deadline=None)
def test_short_texts_keep_their_characters(s):
    assert highlight.highlight(s, {"ab", "b "}).replace(highlight.OPEN, "").replace(highlight.CLOSE, "") == s


def test_gram_rules():
    assert correct.gram_verdict("数学1", "shuxue", "数学2", "shuxue") == "right"
    assert correct.gram_verdict("计算基", "jisuanji", "计算机", "jisuanji") == "accept"
    assert correct.gram_verdict("abc", "abc", "xyz", "xyz") == "reject"
    assert correct.homophone_verdict("记算机", "计算机") == "keep" and correct.homophone_verdict("甲", "乙") == "drop"


def test_cascade_of_tiers(spark):
    from tessera.plans.language_queries import correct_chinese

    got = {r.query: (r.status, r.tier, r.candidates) for r in correct_chinese(spark, "").collect()}
    assert got["计算机"] == ("right", 2, "") and got["记算机"][:2] == ("candidates", 3) and got["记算机"][2].startswith("计算机")
    assert got["电脑"] == ("candidates", 1, "计算机") and got["zzz"] == ("no_solution", None, "") and got[""] == ("right", 0, "")
    assert got["勿理"] == ("candidates", 4, "物理")


def test_phrases(spark):
    rows = spark.createDataFrame([(1, "我们的测试用例。")], "id int, value string")
    phrases = spark.createDataFrame([(p,) for p in ("测试", "试用", "用例", "测试用例", "没有")], "phrase string")
    assert sorted(r.phrase for r in suggest.phrase_matches(rows, phrases).collect()) == sorted(["测试", "试用", "用例", "测试用例"])
    words = spark.createDataFrame([(1, "big data science")], "id int, value string")
    found = suggest.word_phrases(words, spark.createDataFrame([("data science",), ("big science",)], "phrase string"), text.latin_tokens(F.col("value")))
    assert [r.phrase for r in found.collect()] == ["data science"]


def test_expansion(spark):
    rows = spark.createDataFrame([("重要", "重要", ["zhong", "yao"], 100)], "input string, output string, syllables array<string>, weight int")
    got = {r.input: r.weight for r in suggest.expand(rows, "syllables", suggest.EXPANSIONS["platform"]).collect()}
    assert got == {"重要": 100, "zhongyao": 99, "zy": 98, "zhy": 97, "zongyao": 50, "zhongy": -50, "zyao": -50}


def slow_edges(log, gap, same):
    out, last = {}, {}
    for session, ts, q in sorted(log):
        if session not in last:
            last[session] = (q, ts)
            continue
        anchor, at = last[session]
        t = ts - at
        if q == anchor:
            if t > same:
                last[session] = (q, ts)
        elif t < gap:
            t = max(1.0, t)
            out[anchor, q] = out.get((anchor, q), 0) + 10 / t
            out[q, anchor] = out.get((q, anchor), 0) + 2 / t
        else:
            last[session] = (q, ts)
    return out


def test_session_edges(spark):
    import random

    rng = random.Random(3)
    log = [(f"s{rng.randrange(4)}", float(rng.randrange(3000)), rng.choice("abcd")) for _ in range(150)]
    log = list({(s, t): (s, t, q) for s, t, q in log}.values())
    got = {(r.src, r.dst): r.score for r in related.session_edges(spark.createDataFrame(log, "session string, ts double, query string")).collect()}
    assert {k: pytest.approx(v) for k, v in slow_edges(log, 90, 4).items()} == got


def test_served_terms_need_results(spark):
    rows = spark.createDataFrame([("a", "b", 2.0, 1), ("a", "c", 1.0, 2)], "src string, dst string, score double, place int")
    hits = spark.createDataFrame([("b", 200.0), ("b", 150.0), ("c", 10.0)], "dst string, score double")
    assert [(r.word, [tuple(x) for x in r.result]) for r in related.serve(related.with_results(rows, hits)).collect()] == [("a", [("b", 2.0)])]


def test_edges_pair_all_terms_of_a_course(spark):
    """A course of more terms than any list of its heaviest, and one that shares some of them."""
    courses = {1: [f"t{i}" for i in range(260)], 2: ["t0", "t1", "x"], 3: ["alone"]}
    stats = related.term_stats(spark.createDataFrame([(c, t, 1) for c, terms in courses.items() for t in terms], "course_id long, term string, weight int"))
    found = related.edges(stats).collect()
    want = {(a, b) for terms in courses.values() for a in terms for b in terms if a != b}
    assert len(found) == len(want) and {(r.src, r.dst) for r in found} == want


def test_all_spellings_and_readings_of_long_words(spark):
    rows = spark.createDataFrame([("k", "k", ["an"] * 8, 1000)], "input string, output string, syllables array<string>, weight int")
    got = {r.input for r in suggest.expand(rows, "syllables", ("fuzzy",)).collect()}
    assert got == {"".join(x) for x in itertools.product(["an", "ang"], repeat=8)} - {"an" * 8} | ({"k"} if suggest.SHORTEST <= 1 else set())
    table = spark.createDataFrame([(c, c + str(k)) for c in "abcde" for k in range(2)], "char string, reading string")
    pinyin, _ = correct.expand_words(spark.createDataFrame([("abcde", 3)], "word string, weight long"), table, spark.createDataFrame([(["x", "y"],)], "members array<string>"))
    assert pinyin.count() == 2**5
