import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.functions import answers as AN
from lamina.functions import rewrite as RW
from lamina.functions import text as T
from lamina.operators import corpus as C
from lamina.streaming.hold_back import feed


def test_chunk_counts(spark):
    d = spark.createDataFrame([(n, "x" * n) for n in (9, 512, 513, 960, 961)], "doc_id int, text string")
    got = {r.doc_id: r.n for r in C.chunks(d).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {512: 1, 513: 2, 960: 2, 961: 3}
    last = C.chunks(d).where("doc_id = 961").orderBy(F.desc("chunk_idx")).first()
    assert len(last.chunk) == 961 - 2 * 448


def test_citations(spark):
    d = spark.createDataFrame([(1, "A [1] b [1,3] c [2-4] d [7] e [9-1] f [1-99]")], "id int, t string")
    c = AN.citations(d, "id", "t")
    assert [r.source_id for r in c.orderBy("mark", "i").collect()] == [1, 1, 3, 2, 3, 4, 7]
    src = spark.createDataFrame([(1, i, i == 2) for i in (1, 2, 3)], "id int, source_id int, risky boolean")
    m = AN.citation_metrics(c, src, "id").first()
    assert (m.invalid, m.coverage, m.risky) == (2, 1.0, True)


def test_citation_spans(spark):
    t = "First. Second claim [1]! 第三句[2]。end"
    s = spark.createDataFrame([(t,)], "t string").select(AN.citation_spans(F.col("t")).alias("s")).first().s
    assert [t[x.start:x.end] for x in s] == ["[1]", "[2]"]
    assert [x.sentence for x in s] == ["Second claim [1]!", "第三句[2]"]


def test_followups(spark):
    a = "答案。\n" + X.FOLLOWUP_MARKER + "\n上半年增长多少\n它的增速呢？\n" + "很" * 41 + "？\n三次产业的构成\n1. 第二产业增速是多少？\n- 第二产业增速是多少"
    r = spark.createDataFrame([(a, "上半年增长多少")], "a string, q string").select(AN.split_followups(F.col("a"), F.col("q")).alias("f")).first().f
    assert r.body == "答案。" and r.followups == ["第二产业增速是多少？"] and r.raw_count == 6


def test_judge_numbers_stand_alone(spark):
    rows = [("it is 21 years", "21", True), ("it is 121", "21", False), ("21.5", "21", False), ("The Paris answer", "paris", True), ("", "x", False), ("x", "", False)]
    for r in spark.createDataFrame(rows, "a string, g string, w boolean").select("a", "g", "w", AN.judge(F.col("a"), F.col("g")).alias("k")).collect():
        assert r.k == r.w, r


def test_shorten_and_drift(spark):
    d = spark.createDataFrame([("want cheap parts, but skip red widget",)], "q string").select(RW.shorten(F.col("q")).alias("s")).first()
    assert d.s == "cheap parts -red -widget"
    v = spark.createDataFrame([("price of tea", "coffee beans", "coffee")], "q string, r string, h string").select(RW.drift("q", "r", "h") if False else RW.drift(F.col("q"), F.col("r"), F.col("h")).alias("d")).first().d
    assert v.severe and v.suspicious == ["coffee"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["###FOLLOWUP###", "###", "#", "FOLLOW", "text ", "UP###", "\n"]), max_size=12), st.integers(1, 9))
def test_hold_back_shows_the_same_text_for_every_chunking(parts, size):
    answer = "".join(parts)
    pending, cut, seen = "", False, ""
    for i in range(0, len(answer), size):
        out, pending, cut = feed(pending, cut, answer[i:i + size])
        seen += out
    seen += "" if cut else pending
    assert seen == answer.split(X.FOLLOWUP_MARKER)[0]


def test_fixed_patterns_compile():
    for p in (X.CONTROL_CHARS, X.FAKE_DELIM, X.CITATION, X.QA_PUNCT, X.JUDGE_PUNCT, X.CLAUSE_SPLIT, *(p for _, p in X.INJECTIONS)):
        re.compile(p)


def test_strip_takes_off_what_the_pattern_would(spark):
    rows = [(f"{c}{c}a {c}b{c}\n{c}", c) for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)])] + [("", ""), (None, None)]
    d = spark.createDataFrame(rows, "t string, u string")
    for c in (F.col("t"), F.col("u")):
        both, end = F.regexp_replace(c, T.U + r"^\s+|\s+$", ""), F.regexp_replace(c, T.U + r"\s+$", "")
        assert d.where(~(T.strip(c).eqNullSafe(both) & T.rstrip(c).eqNullSafe(end))).count() == 0
    assert "regexp" not in d.select(T.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
