from collections import Counter

import numpy as np
import pyarrow as pa
from fixtures import documents, spaces, texts
from pyspark.sql import functions as F

from lamina.llm import near_dup
from lamina.llm.graph import components


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in spaces(text)]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, parent = [shingles(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, *_) in enumerate(rows):
        c = least.get(find(i))
        out.append((d, len(sets[i]), c, c is None or d == c))
    return Counter(out)


def test_against_all_pairs(docs):
    got = Counter(tuple(r) for r in near_dup.near_duplicates(docs).collect())
    assert got == brute(texts())


def test_divided_buckets_and_blocks_lose_nothing(docs):
    got = Counter(tuple(r) for r in near_dup.near_duplicates(docs, block=2, crowd=3).collect())
    assert got == brute(texts())


def test_empty_table(none):
    assert near_dup.near_duplicates(none).count() == 0
    assert near_dup.deduplicated(none).count() == 0


def test_one_document_of_each_group_stays(docs):
    got = near_dup.deduplicated(docs)
    assert got.columns == docs.columns
    ids = [(r.doc_id, r.text) for r in got.collect()]
    kept = {k[0] for k in brute(texts()) if k[3]}
    assert {d for d, _ in ids} == kept and len(ids) == len(set(ids))


def test_every_coordinate_fills_and_estimates_similarity():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 63, 900).astype(np.uint64)
    sk = near_dup.sketches([x[:600], x[150:750], x[:3], x[:4], x[:0]])
    assert (sk[:4] != np.iinfo(np.uint64).max).all()
    assert abs((sk[0] == sk[1]).mean() - 450 / 750) < 0.15
    assert abs((sk[2] == sk[3]).mean() - 3 / 4) < 0.15


def test_sets_are_those_of_the_words():
    t = [x[1] for x in texts()]
    assert [len(s) for s in near_dup.shingle_sets(pa.array(t))] == [len(shingles(x)) for x in t]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 50 + k) for k in range(20)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{50 + k: 50 for k in range(20)}, 100: 50}


def test_buckets_are_joined_once(spark):
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(30)], "doc_id long, text string")
    sig = near_dup.signatures(docs)
    members = sig.select(F.pmod("row", F.lit(3)).alias("key"), "row", "n", F.col("row").alias("label"))
    for crowd in (4000, 2):
        plan = near_dup._across(members, sig, 1000, crowd)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 2  # the sets of the rows, and the rows with their sets


def sharing_one_band(docs):
    """Signatures as if all rows shared one band and no other."""
    return signatures_of(docs).withColumn("bands", F.array(F.lit(1).cast("long"), F.col("row") + 2))


signatures_of = near_dup.signatures
ONE_BAND = [(k, " ".join(f"w{k}x{i}" for i in range(40))) for k in range(8)] + [(100 + k, " ".join([f"w{k}x{i}" for i in range(39)] + ["end"])) for k in range(1, 8)]


def test_rows_of_a_large_bucket_that_share_no_other_band_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "signatures", sharing_one_band)
    docs = spark.createDataFrame(ONE_BAND, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, block=2, crowd=3).collect()}
    assert got == {d: d % 100 for d, _ in ONE_BAND}
