import random

from pyspark.sql import functions as F

from lamina.operators.ranking import first_per_key, neighbour, ranked, top_k
from lamina.operators.reports import order_statistics


def rows(n=3000):
    r = random.Random(7)
    return [("hot" if r.random() < 0.4 else f"k{r.randrange(20)}", r.randrange(50), i) for i in range(n)]


def test_ranked_matches_brute_force_with_a_hot_key(spark):
    data = rows()
    d = spark.createDataFrame(data, "k string, v int, id int")
    want = {}
    for k in {x[0] for x in data}:
        for p, x in enumerate(sorted((x for x in data if x[0] == k), key=lambda x: (x[1], x[2])), 1):
            want[x[2]] = p
    got = {r.id: r.rank for r in ranked(d, [F.asc("v"), F.asc("id")], "rank", ["k"]).collect()}
    assert got == want
    glob = {r.id: r.rank for r in ranked(d, [F.desc("v"), F.asc("id")], "rank", start=0).collect()}
    assert glob == {x[2]: p for p, x in enumerate(sorted(data, key=lambda x: (-x[1], x[2])))}


def test_neighbour_first_and_top(spark):
    data = rows(500)
    d = spark.createDataFrame(data, "k string, v int, id int")
    got = {r.id: r.nxt for r in neighbour(d, ["k"], [F.asc("id")], {"nxt": "id"}).collect()}
    for k in {x[0] for x in data}:
        ids = sorted(x[2] for x in data if x[0] == k)
        assert [got[i] for i in ids] == [*ids[1:], None]
    first = {r.k: r.id for r in first_per_key(d, ["k"], ["v", "id"]).collect()}
    assert first == {k: min((x[1], x[2]) for x in data if x[0] == k)[1] for k in first}
    assert top_k(d, ["k"], [F.asc("id")], 3).count() == sum(min(3, sum(x[0] == k for x in data)) for k in first)


def test_top_k_is_limited_before_the_shuffle(spark):
    d = spark.createDataFrame(rows(100), "k string, v int, id int")
    plan = top_k(d, ["k"], [F.asc("id")], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_order_statistics(spark):
    import statistics

    data = rows(801)
    d = spark.createDataFrame(data, "k string, v int, id int").withColumn("v", F.col("v").cast("double"))
    for r in order_statistics(d, ["k"], "v", "id").collect():
        vs = sorted(x[1] for x in data if x[0] == r.k)
        assert r.median == statistics.median(vs)
        assert r.p90 == vs[min(int(len(vs) * 0.9), len(vs) - 1)]
