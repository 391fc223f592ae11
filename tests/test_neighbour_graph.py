import numpy as np
import pyarrow as pa
import pytest

from lamina.operators import neighbour_graph as N

DIM = 16


def clustered(n, seed=1, dim=DIM, centres=40, rank=6):
    """Unit vectors around centres that share a few directions, as text vectors do."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(rank, dim))
    points = (r.normal(size=(centres, rank))[r.integers(0, centres, n)] + 0.7 * r.normal(size=(n, rank))) @ base + 0.05 * r.normal(size=(n, dim))
    return (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, ids, m, key="id", value="cv"):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], f"{key} long, {value} array<float>").repartition(4)


def exact(m, ids, q, qids, k, same):
    s = np.round(q.astype(np.float64) @ m.astype(np.float64).T, 6)
    out = {}
    for row, i in zip(s, qids):
        order = [j for j in np.lexsort((ids, -row)) if not (same and ids[j] == i)][:k]
        out[int(i)] = [(int(ids[j]), float(row[j])) for j in order]
    return out


def recall(rows, want):
    """A vector as good as the last exact one counts."""
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    good = sum(min(len(want[q]), sum(r.score >= want[q][-1][1] - 1e-9 for r in got.get(q, []))) for q in want)
    return good / sum(map(len, want.values()))


@pytest.fixture(scope="module")
def big(spark):
    m = clustered(6000)
    return m, N.build(frame(spark, range(6000), m), k=12)


def test_recall_and_distances(spark, big):
    m, graph = big
    ids = np.arange(6000)
    some = ids[::20]
    rows = N.search(graph, frame(spark, some, m[some], "query_id", "qv"), 8, ef=32, width=8, exclude_same=True).collect()
    assert recall(rows, exact(m, ids, m[some], some, 8, True)) >= 0.95
    assert max(r.n_distances for r in rows) < 600  # a tenth of the vectors
    for r in rows:
        assert r.score == round(float(m[r.query_id].astype(float) @ m[r.id].astype(float)), 6)
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    for some in by.values():
        some.sort(key=lambda r: r.rank)
        assert [r.rank for r in some] == list(range(1, 9)) and [(-r.score, r.id) for r in some] == sorted((-r.score, r.id) for r in some)


def test_vectors_are_added_without_a_build(spark, big):
    m, _ = big
    old, new = np.arange(0, 3000), np.arange(3000, 3600)
    graph = N.build(frame(spark, old, m[old]), k=12)
    more = N.add(graph, frame(spark, np.concatenate([new, old[:5]]), np.concatenate([m[new], m[old[:5]]])), k=12)
    ids = np.arange(3600)
    assert sorted(r.id for r in more.copies.collect()) == ids.tolist()
    some = np.concatenate([ids[::30], new[::10]])
    some = np.unique(some)
    rows = N.search(more, frame(spark, some, m[some], "query_id", "qv"), 8, ef=48, width=8).collect()
    assert recall(rows, exact(m[:3600], ids, m[some], some, 8, False)) >= 0.95


def test_saved_index_gives_the_same_rows(spark, tmp_path):
    m = clustered(400, 3)
    graph = N.build(frame(spark, range(400), m), k=8)
    graph.save(str(tmp_path / "index"))
    again = N.Graph.load(spark, str(tmp_path / "index"))
    q = frame(spark, range(0, 400, 10), m[::10], "query_id", "qv")
    key = lambda g: sorted(map(tuple, N.search(g, q, 5).collect()))
    assert key(graph) == key(again) and again.dim == DIM


def test_large_groups_of_copies(spark):
    """Two thirds of the vectors are the same; the others are still found, and copies come by id."""
    m = clustered(600, 5)
    m[100:500] = m[100]
    graph = N.build(frame(spark, range(600), m), k=8)
    assert graph.nodes.count() == 201
    some = np.array([0, 50, 100, 499, 550])
    rows = N.search(graph, frame(spark, some, m[some], "query_id", "qv"), 6, ef=64, exclude_same=True).collect()
    want = exact(m, np.arange(600), m[some], some, 6, True)
    for q in (100, 499):
        assert [r.id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)] == [i for i, _ in want[q]]
    assert recall(rows, want) >= 0.95


def test_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [1.0, 0.0, 0.0]), (None, [1.0, 1.0])]
    graph = N.build(spark.createDataFrame(rows, "id long, cv array<float>"), k=4)
    q = spark.createDataFrame([(9, [1.0, 0.5]), (8, None), (7, [1.0]), (6, [])], "query_id long, qv array<float>")
    assert sorted(tuple(r)[:4] for r in N.search(graph, q, 4).collect()) == [(9, 1, 1.0, 1), (9, 2, 0.5, 2)]
    one = N.build(spark.createDataFrame(rows[:1], "id long, cv array<float>"))
    assert [r.id for r in N.search(one, q, 4).collect()] == [1]
    none = N.build(spark.createDataFrame([], "id long, cv array<float>"))
    assert N.search(none, q, 4).count() == 0


def test_query_finds_nine_of_ten(spark):
    import __spark_entry__ as E

    rows = E.queries()["graph_recall"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 5 and sum(r.n_found for r in rows) >= 0.9 * sum(r.n_exact for r in rows) > 0


def test_few_groups_are_introduced_at_a_time():
    r = np.random.default_rng(5)
    groups = [[{"m": int(i), "fresh": True, "floor": -2.0e9, "cv": v.tolist()} for i, v in zip(r.choice(1000, 6, replace=False), r.normal(size=(6, 4)).astype(np.float32))] for _ in range(3 * N.MEET + 1)]
    kind = pa.list_(pa.struct([("m", pa.int64()), ("fresh", pa.bool_()), ("floor", pa.float64()), ("cv", pa.list_(pa.float32()))]))
    out = list(N._met(iter([pa.RecordBatch.from_pydict({"g": pa.array(groups, kind)})]), 4, 6))
    assert len(out) == 4 and max(b.num_rows for b in out) <= N.MEET * 6 * 5
    want = [(a["m"], b["m"], round(float(np.dot(np.float64(a["cv"]), np.float64(b["cv"]))), 6)) for g in groups for a in g for b in g if a["m"] != b["m"]]
    got = [(x["id"], x["nid"], x["score"]) for b in out for x in b.to_pylist()]
    assert [w[:2] for w in want] == [g[:2] for g in got]
    assert np.allclose([w[2] for w in want], [g[2] for g in got], atol=2e-6)
