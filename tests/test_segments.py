import math
import random

from lamina.operators import kg as K


def plain(text, names, max_span):
    """All splits, by recursion; the cheapest, then the one whose last words are longest."""
    known = {}
    for name, n in names:
        if name and len(name) <= max_span and n > 0:
            known[name] = known.get(name, 0) + n
    total = sum(known.values()) or 1
    cost = lambda w: int(math.floor(1000 * math.log(total / known[w]) + 0.5)) if w in known else int(math.floor(1000 * math.log(total) + 0.5)) + 1000
    best = [(0, 0, [])]
    for e in range(1, len(text) + 1):
        options = [(best[s][0] + cost(text[s:e]), s, best[s][2] + ([(text[s:e], s + 1)] if text[s:e] in known else [])) for s in range(max(0, e - max_span), e) if text[s:e] in known or s == e - 1]
        best.append(min(options, key=lambda x: x[:2]))
    return best[-1][2]


def test_segments_equal_a_plain_search(spark):
    r = random.Random(6)
    names = [("".join(r.choice("abc城市") for _ in range(r.randint(1, 5))), r.choice([1, 1, 2, 50, 1000])) for _ in range(60)] + [("", 5), (None, 5), ("zero", 0), ("abcabcabcabc", 9)]
    texts = [(i, "".join(r.choice("abc城市x ") for _ in range(r.randint(0, 40)))) for i in range(150)] + [(900, None), (901, "x"), (902, "")]
    got = {}
    for row in K.segments(spark.createDataFrame(texts, "query_id int, query string"), spark.createDataFrame(names, "name string, n long"), 6).orderBy("query_id", "pos").collect():
        got.setdefault(row.query_id, []).append((row.name, row.start))
    assert got == {i: want for i, t in texts if t and (want := plain(t, names, 6))}


def test_common_names_win_over_chance_ones(spark):
    names = [("南京市", 100), ("长江大桥", 100), ("市长", 80), ("南京", 90), ("江大桥", 1)]
    rows = K.segments(spark.createDataFrame([(1, "南京市长江大桥")], "query_id int, query string"), spark.createDataFrame(names, "name string, n long")).collect()
    assert [r.name for r in sorted(rows, key=lambda r: r.pos)] == ["南京市", "长江大桥"]


def test_nothing_known(spark):
    none = spark.createDataFrame([], "name string, n long")
    assert K.segments(spark.createDataFrame([(1, "abc")], "query_id int, query string"), none).count() == 0
