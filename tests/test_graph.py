from collections import deque

from pyspark.sql import functions as F

from lamina.operators import kg as K
from lamina.operators import linking as L

ENT = "qid string, label_zh string, label_en string, description string, article_rank int, popularity long"
TRI = "s string, p string, o string, v string, t string"
MEN = "mention string, qid string, weight double, source string"


def test_generic_names_are_classes(spark):
    tri = [(f"X{i}", "P31", "city", None, "entity") for i in range(9)] + [(f"Y{i}", "P279", "place", None, "entity") for i in range(4)] + [("Z", "P31", "europe", None, "entity")]
    ents = [(q, q, None, None, None, 1) for q in ("city", "place", "europe")]
    men = [(q, q, 1.0, "label") for q in ("city", "place", "europe")]
    g = K.generic_mentions(spark.createDataFrame(men, MEN), spark.createDataFrame(ents, ENT), spark.createDataFrame(tri, TRI))
    assert {r.mention: r.generic for r in g.collect()} == {"city": True, "place": True, "europe": False}
    found = spark.createDataFrame([(1, 0, "city"), (1, 1, "europe"), (2, 0, "city")], "query_id int, pos int, mention string")
    assert [(r.query_id, r.mention) for r in K.specific_first(found, g).orderBy("query_id", "pos").collect()] == [(1, "europe"), (1, "city"), (2, "city")]
    assert [(r.query_id, r.mention) for r in K.specific_first(found, g, drop=True).orderBy("query_id", "pos").collect()] == [(1, "europe"), (2, "city")]


def plain_bfs(seeds, adj, known, max_hops, expand):
    visited, queue, out = set(seeds), deque((s, 1) for s in seeds), []
    while queue:
        q, hop = queue.popleft()
        if hop >= max_hops:
            continue
        n = 0
        for o in adj.get(q, [])[: expand * 3]:
            if o in visited:
                continue
            visited.add(o)
            if o not in known:
                continue
            out.append((hop + 1, o, q))
            queue.append((o, hop + 1))
            n += 1
            if n >= expand:
                break
    return out


def test_capped_expansion_equals_the_queue(spark):
    import random

    r = random.Random(11)
    names = [f"e{i:02d}" for i in range(40)]
    edges = sorted({(r.choice(names), r.choice(names)) for _ in range(260)})
    adj = {}
    for s, o in edges:
        adj.setdefault(s, []).append(o)
    known = set(names[:34])
    tri = spark.createDataFrame([(s, "P1", o, None, "entity") for s, o in edges], TRI)
    ents = spark.createDataFrame([(n, n, None, None, None, 0) for n in known], ENT)
    seeds = {q: r.sample(names, 2) for q in range(8)}
    d = spark.createDataFrame([(q, p, s) for q, ss in seeds.items() for p, s in enumerate(ss)], "query_id int, pos int, qid string")
    got = {}
    for x in K.bfs_capped(d, tri, ents, 3, 3).orderBy("query_id", "hop", "pos").collect():
        got.setdefault(x.query_id, []).append((x.hop, x.qid, x.via))
    for q, ss in seeds.items():
        assert got.get(q, []) == plain_bfs(ss, adj, known, 3, 3), q


def test_one_hop_limit_of_one_level_is_empty(spark):
    tri = spark.createDataFrame([("a", "P1", "b", None, "entity")], TRI)
    assert K.bfs(spark.createDataFrame([("a",)], "seed string"), tri, 1).count() == 1


def test_link_falls_back_to_prefixes(spark):
    ents = spark.createDataFrame([("q1", "small ring", None, "Wikimedia page", None, 5000), ("q2", "small ring of iron", None, "a ring", None, 50), ("q3", "ring", None, "x", None, 9)], ENT)
    men = spark.createDataFrame([("small ring", "q1", 1.0, "label"), ("small ring of iron", "q2", 1.0, "label"), ("ring", "q3", 1.0, "label")], MEN)
    got = K.link(spark.createDataFrame([("small ring",), ("ring",)], "mention string"), K.scored_mentions(men, ents)).orderBy("mention", "pos").collect()
    small = [(r.qid, r.source) for r in got if r.mention == "small ring"]
    assert small == [("q2", "fts:label"), ("q1", "label")]  # pages about pages go last
    assert {r.qid for r in got if r.mention == "ring"} == {"q1", "q2", "q3"}


def test_link_retries_the_simplified_spelling(spark):
    ents = spark.createDataFrame([("q1", "總統", None, "a", None, 5000), ("q2", "总统", None, "b", None, 4000), ("q3", "总统", None, "c", None, 3000)], ENT)
    men = spark.createDataFrame([("總統", "q1", 1.0, "label"), ("总统", "q1", 1.0, "label"), ("总统", "q2", 1.0, "label"), ("总统", "q3", 0.6, "alias")], MEN)
    t2s = spark.createDataFrame([("總", "总"), ("統", "统")], "traditional string, simple string")
    asked = spark.createDataFrame([("總統",), ("总统",)], "mention string")
    got = K.link(asked, K.scored_mentions(men, ents), spelling=t2s).orderBy("mention", "pos").collect()
    old = [(r.qid, r.source, round(r.weight, 6)) for r in got if r.mention == "總統" and not r.source.startswith("fts:")]
    assert old == [("q1", "label", 1.0), ("q2", "t2s:label", 0.9), ("q3", "t2s:alias", 0.54)]
    assert {r.source for r in got if r.mention == "总统"} == {"label", "alias"}
    assert [r.qid for r in K.link(asked, K.scored_mentions(men, ents)).where("mention = '總統'").collect()] == ["q1"]


def test_ngrams_prefer_longer_names(spark):
    q = spark.createDataFrame([(1, "abcdef ab")], "query_id int, query string")
    m = spark.createDataFrame([("abcd", "x", 1.0, "label"), ("cdef", "y", 1.0, "label"), ("ab", "z", 1.0, "label")], MEN)
    assert [(r.mention, r.start) for r in K.mention_ngrams(q, m).orderBy("pos").collect()] == [("abcd", 1), ("ab", 8)]


def test_hybrid_keeps_all_when_nothing_is_trusted(spark):
    f = spark.createDataFrame([(1, 0, "ab"), (1, 1, "abc"), (2, 0, "xy")], "query_id int, pos int, mention string")
    t = spark.createDataFrame([(1, ["zz"]), (2, ["q"])], "query_id int, words array<string>")
    assert sorted((r.query_id, r.mention) for r in K.mention_hybrid(f, t).collect()) == [(1, "abc"), (2, "xy")]


def test_unescape_is_idempotent(spark):
    d = spark.createDataFrame([("\\u5BA2 \\U0001F600 \\uD83D",)], "v string").select(K.unescape(F.col("v")).alias("a")).select("a", K.unescape(F.col("a")).alias("b")).first()
    assert d.a == "客 😀 \\uD83D" and d.b == d.a


def test_opposite_contexts_choose_different_entities(spark):
    c = spark.createDataFrame([("n", "p", 1.0, "label", "N", "物理学家 科学家", 100, 5.0, 1), ("n", "u", 1.0, "label", "N", "力的单位", 100, 5.0, 2)],
                              "mention string, qid string, weight double, source string, label_zh string, description string, popularity long, score double, pos int")
    tri = spark.createDataFrame([("p", "P31", "Q5", None, "entity")], TRI)
    a = spark.createDataFrame([(1, "n", "谁提出了定律的科学家"), (2, "n", "一个单位等于多少")], "query_id int, mention string, query string")
    got = {r.query_id: r.qid for r in L.disambiguate(a, c, tri, 1).collect()}
    assert got == {1: "p", 2: "u"}


def test_triples_without_object_are_dealt_out(spark):
    rows = [(f"s{i}", "P577", None, f"v{i}", "time") for i in range(400)] + [("s1", "P31", "Q5", None, "entity"), ("s2", "P31", "Q9", None, "entity"), ("s3", "P9", None, None, "time")]
    t = spark.createDataFrame(rows, "s string, p string, o string, v string, t string")
    e = spark.createDataFrame([("Q5", "human"), ("Q5", "person"), (None, "nothing")], "qid string, label_zh string")
    p = spark.createDataFrame([("P31", "is")], "pid string, label_zh string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = K.labelled(t, e, p).select("s", "p", "p_label", "o", "object_label", F.spark_partition_id().alias("at")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    at = [r["at"] for r in got if r["p"] == "P577"]
    assert len(at) == 400 and max(at.count(x) for x in set(at)) < 200
    want = [("s1", "P31", "is", "Q5", "human"), ("s1", "P31", "is", "Q5", "person"), ("s2", "P31", "is", "Q9", None), ("s3", "P9", None, None, None)]
    assert sorted((tuple(r)[:5] for r in got if r["p"] != "P577"), key=str) == sorted(want, key=str)
    assert sorted(r["object_label"] for r in got if r["p"] == "P577") == sorted(f"v{i}" for i in range(400))
