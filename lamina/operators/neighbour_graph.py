"""A graph index for vectors: built by rounds of joins, searched best first for a
whole batch of questions.

Build. A first graph comes from cells of random hyperplanes, compared inside
bounded blocks. Then rounds look at neighbours of neighbours: a vector's
neighbours (both directions) are introduced to each other, and everyone keeps
the ``k`` best. Only pairs with a new edge are compared, so rounds get cheaper,
and they end when few edges change.

Search. Each question has a pool of its ``ef`` best vectors so far. A round
follows the links of the best ``width`` of them that were not followed yet; the
questions end when nothing in their pools is left to follow. A question costs
as many distances as it saw vectors, which are counted.

Vectors that are equal stand as one in the graph, under their smallest id, and
are put back at the end, so a large group of copies is no hub. A reverse list
is cut to the ``k`` best links; it only adds ways into a vector, whose own
links stay. Scores are inner products rounded to ``digits``; ties go to the
smaller id. Null and empty vectors, and those of another length than
most have, are not indexed; a question of such a kind finds nothing.

``vectors`` (id long, cv array<float>), ``queries`` (query_id long, qv array<float>).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.ranking import top_k
from lamina.session import cut

#: Vectors compared at once when the first graph is made.
CELL = 256
#: Vectors every question is compared with to find its first places, and how many of them it starts from.
PIVOTS, STARTS = 64, 8
#: Groups of vectors whose products a task holds at once when neighbours are introduced.
MEET = 200
_EDGE = "id long, nid long, score double"


@dataclass
class Graph:
    """``nodes`` (id, cv), one per distinct vector; ``links`` (id, links array<long>); ``copies`` (rep, id), every indexed
    vector under its node; ``dim``. All three are files, so whatever reads them again reads the same."""

    nodes: DataFrame
    links: DataFrame
    copies: DataFrame
    dim: int

    def save(self, path: str) -> None:
        for name in ("nodes", "copies", "links"):  # links last: a folder without them is no index
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        nodes, links, copies = (spark.read.parquet(f"{path}/{n}") for n in ("nodes", "links", "copies"))
        first = nodes.select(F.size("cv").alias("d")).first()
        return Graph(nodes, links, copies, first.d if first else 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column of ``dim`` numbers each."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def common_length(vectors: DataFrame) -> int:
    sizes = vectors.where(F.size("cv") > 0).groupBy(F.size("cv").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max_by("dim", F.struct("n", -F.col("dim"))).alias("dim")).first()
    return row.dim or 0


def distinct_vectors(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and copies. The key of a vector is two hashes of it, which are combined before the shuffle."""
    keyed = vectors.where((F.size("cv") == dim) & F.col("id").isNotNull()).select(
        F.col("id").cast("long"), F.col("cv").cast("array<float>"), F.struct(F.xxhash64("cv"), F.xxhash64(F.lit(1), "cv")).alias("key"))
    nodes = keyed.groupBy("key").agg(F.min(F.struct("id", "cv")).alias("n")).select("key", "n.id", "n.cv")
    nodes = cut(nodes)
    copies = keyed.select("key", F.col("id").alias("copy")).join(nodes.select("key", F.col("id").alias("rep")), "key").select("rep", F.col("copy").alias("id")).distinct()
    return nodes.drop("key"), cut(copies)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and columns of the ``k`` best of each row."""
    for i, row in enumerate(scores):
        if len(row) > k:
            some = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
        else:
            some = np.flatnonzero(row > -np.inf)
        yield i, some[np.lexsort((ids[some], -row[some]))][:k]


def first_edges(nodes: DataFrame, dim: int, k: int, tables: int, seed: int, digits: int) -> DataFrame:
    """Neighbours inside cells of random hyperplanes; ``tables`` independent sets of cells."""
    n = nodes.count()
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / CELL))))
    planes = np.random.default_rng(seed).normal(size=(dim, tables * bits)) if bits else None

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signs = matrix(b.column("cv"), dim) @ planes > 0 if bits else np.zeros((b.num_rows, 0), bool)
            for t in range(tables if bits else 1):
                code = signs[:, t * bits : (t + 1) * bits] @ (1 << np.arange(bits)) + t * (1 << bits) if bits else np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(code.astype(np.int64)), "id": b.column("id"), "cv": b.column("cv")})

    celled = nodes.select("id", "cv").mapInArrow(cells, "cell long, id long, cv array<float>")
    sizes = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (4 * CELL)).alias("parts"))  # a crowded cell splits
    blocks = celled.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def compare(group: pa.Table) -> pa.Table:
        ids, m = group.column("id").to_numpy(), matrix(group.column("cv"), dim)
        scores = np.round(m @ m.T, digits)
        np.fill_diagonal(scores, -np.inf)
        found = [(ids[i], ids[some], scores[i, some]) for i, some in _best(scores, ids, k)]
        return pa.table({
            "id": np.concatenate([np.full(len(s), i) for i, s, _ in found]).astype(np.int64), "nid": np.concatenate([s for _, s, _ in found]).astype(np.int64),
            "score": np.concatenate([x for _, _, x in found]).astype(np.float64)})

    return blocks.groupBy("cell", "part").applyInArrow(compare, _EDGE)


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best edges of each id in one row: ``nbrs`` array<struct<score, nid, fresh>>."""
    best = top_k(edges, ["id"], [F.desc("score"), F.asc("nid")], k)
    return best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "nid", "fresh"))).alias("l")).select(
        "id", F.transform("l", lambda x: F.struct((-x.neg).alias("score"), x.nid.alias("nid"), x.fresh.alias("fresh"))).alias("nbrs"))


def introduced(nodes: DataFrame, lists: DataFrame, dim: int, k: int, digits: int) -> DataFrame:
    """Pairs of neighbours of the same vector that are better than what one of them has. A vector introduces at most
    2 k others, whose products are one small matrix."""
    out = lists.select(F.col("id").alias("v"), F.explode("nbrs").alias("e")).select("v", F.col("e.nid").alias("m"), F.col("e.score").alias("score"), F.col("e.fresh").alias("fresh"))
    back = top_k(out.select(F.col("m").alias("v"), F.col("v").alias("m"), "score", "fresh"), ["v"], [F.desc("score"), F.asc("m")], k)
    members = out.unionByName(back).groupBy("v", "m").agg(F.max("fresh").alias("fresh"))
    floor = lists.select(F.col("id").alias("m"), F.when(F.size("nbrs") >= k, F.element_at("nbrs", -1)["score"]).otherwise(F.lit(-2.0e9)).alias("floor"))
    known = nodes.select(F.col("id").alias("m"), "cv").join(floor, "m", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0e9)))
    groups = members.join(known, "m").groupBy("v").agg(F.collect_list(F.struct("m", "fresh", "floor", "cv")).alias("g"), F.max("fresh").alias("any")).where("any").select("g")

    return groups.mapInArrow(lambda batches: _met(batches, dim, digits), _EDGE)


def _met(batches: Iterator[pa.RecordBatch], dim: int, digits: int) -> Iterator[pa.RecordBatch]:
    """The better pairs of each group ``g``, of ``MEET`` groups at a time."""
    for col in (b.column("g").slice(i, MEET) for b in batches for i in range(0, b.num_rows, MEET)):
        ends = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
        flat = col.flatten()
        ids, fresh, floors = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("m", "fresh", "floor"))
        m = matrix(flat.field("cv"), dim)
        left, right, values = [], [], []
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist()):
            s = np.round(m[a:z] @ m[a:z].T, digits)
            ok = (fresh[a:z, None] | fresh[None, a:z]) & (s > floors[a:z, None])
            np.fill_diagonal(ok, False)
            i, j = np.nonzero(ok)
            left.append(ids[a:z][i]), right.append(ids[a:z][j]), values.append(s[i, j])
        yield pa.RecordBatch.from_pydict({"id": pa.array(np.concatenate(left), pa.int64()), "nid": pa.array(np.concatenate(right), pa.int64()), "score": pa.array(np.concatenate(values), pa.float64())})


def build(vectors: DataFrame, k: int = 16, rounds: int = 8, tables: int = 3, change: float = 0.005, seed: int = 42, digits: int = 6) -> Graph:
    """At most ``rounds`` rounds; they end when less than ``change`` of the edges are new."""
    dim = common_length(vectors)
    nodes, copies = distinct_vectors(vectors, dim)
    lists = cut(_lists(first_edges(nodes, dim, k, tables, seed, digits).distinct().withColumn("fresh", F.lit(True)), k))
    for _ in range(rounds):
        new = introduced(nodes, lists, dim, k, digits).withColumn("fresh", F.lit(True))
        old = lists.select("id", F.explode("nbrs").alias("e")).select("id", F.col("e.nid").alias("nid"), F.col("e.score").alias("score"), F.lit(False).alias("fresh"))
        both = old.unionByName(new).groupBy("id", "nid").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
        lists = cut(_lists(both, k))
        got = lists.agg(F.sum(F.size(F.filter("nbrs", lambda x: x.fresh))).alias("new"), F.sum(F.size("nbrs")).alias("all")).first()
        if not got["all"] or got["new"] < change * got["all"]:
            break
    return Graph(nodes, cut(_links(lists, nodes, k)), copies, dim)


def _links(lists: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The ways out of each vector: its neighbours, and the ``k`` best it is a neighbour of. A vector without either keeps an empty list."""
    out = lists.select("id", F.explode("nbrs").alias("e")).select("id", F.col("e.nid").alias("nid"), F.col("e.score").alias("score"))
    back = top_k(out.select(F.col("nid").alias("id"), F.col("id").alias("nid"), "score"), ["id"], [F.desc("score"), F.asc("nid")], k)
    both = out.unionByName(back).groupBy("id").agg(F.array_sort(F.collect_set("nid")).alias("links"))
    return nodes.select("id").join(both, "id", "left").withColumn("links", F.coalesce("links", F.array().cast("array<long>")))


# ---- search ---------------------------------------------------------------------------------

_POOL = "array<struct<neg:double,id:long,open:boolean>>"


def _scored(pairs: DataFrame, dim: int, digits: int) -> DataFrame:
    """``pairs`` (query_id, id, qv, cv) -> query_id, id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("ij,ij->i", matrix(b.column("qv"), dim), matrix(b.column("cv"), dim))
            yield pa.RecordBatch.from_pydict({"query_id": b.column("query_id"), "id": b.column("id"), "score": pa.array(np.round(s, digits))})

    return pairs.select("query_id", "id", "qv", "cv").mapInArrow(run, "query_id long, id long, score double")


def _started(queries: DataFrame, graph: Graph, digits: int) -> DataFrame:
    """Pools of the best pivots: ``PIVOTS`` vectors by the order of their ids' hashes, a bounded table."""
    rows = graph.nodes.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    ids, m, dim = np.array([r.id for r in rows], np.int64), np.array([r.cv for r in rows], np.float64).reshape(len(rows), graph.dim), graph.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.round(matrix(b.column("qv"), dim) @ m.T, digits)
            pool = [[{"neg": -float(scores[i, j]), "id": int(ids[j]), "open": True} for j in some] for i, some in _best(scores, ids, STARTS)]
            kind = pa.list_(pa.struct([("neg", pa.float64()), ("id", pa.int64()), ("open", pa.bool_())]))
            yield pa.RecordBatch.from_pydict({"query_id": b.column("query_id"), "qv": b.column("qv"), "pool": pa.array(pool, kind)})

    fit = queries.where((F.size("qv") == graph.dim) & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long"), F.col("qv").cast("array<float>"))
    if not rows:
        return fit.where(F.lit(False)).select("query_id", "qv", F.array().cast(_POOL).alias("pool"), F.array().cast("array<long>").alias("seen"), F.lit(0).cast("long").alias("n"))
    out = fit.mapInArrow(run, f"query_id long, qv array<float>, pool {_POOL}")
    return out.select("*", F.lit(ids.tolist()).cast("array<long>").alias("seen"), F.lit(len(rows)).cast("long").alias("n"))


def _open(pool: Column) -> Column:
    return F.filter(pool, lambda x: x.open)


def search(graph: Graph, queries: DataFrame, k: int, ef: int = 64, width: int = 16, digits: int = 6, exclude_same: bool = False) -> DataFrame:
    """``query_id``, ``id``, ``score``, ``rank`` and ``n_distances``: how many vectors the question was compared with.
    With ``exclude_same`` a vector under the question's own id is no answer."""
    state = cut(_started(queries, graph, digits))
    done = None
    while True:
        going = state.where(F.exists("pool", lambda x: x.open))
        over = state.where(~F.exists("pool", lambda x: x.open)).drop("qv", "seen")
        done = over if done is None else done.unionByName(over)
        if going.isEmpty():
            break
        asked = going.select("query_id", F.explode(F.slice(_open(F.col("pool")), 1, width)).alias("x")).select("query_id", F.col("x.id").alias("id"))
        ways = asked.join(graph.links, "id").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("ways"))  # width lists of 2 k links
        fresh = going.join(ways, "query_id").select("query_id", "qv", F.explode(F.array_except("ways", "seen")).alias("id"))
        scores = _scored(fresh.join(graph.nodes, "id"), graph.dim, digits)
        new = scores.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "id", F.lit(True).alias("open")))).alias("new"))
        followed = F.transform("pool", lambda x, i: F.struct(x.neg.alias("neg"), x.id.alias("id"), (x.open & ~F.array_contains("ids", x.id)).alias("open")))
        step = going.withColumn("ids", F.transform(F.slice(_open(F.col("pool")), 1, width), lambda x: x.id)).withColumn("pool", followed).drop("ids")
        step = step.join(new, "query_id", "left").withColumn("new", F.coalesce("new", F.array().cast(_POOL)))
        state = cut(step.select(
            "query_id", "qv", F.slice(F.array_sort(F.concat("pool", "new")), 1, ef).alias("pool"),
            F.concat("seen", F.transform("new", lambda x: x.id)).alias("seen"), (F.col("n") + F.size("new")).alias("n")))
    rows = done.select("query_id", "n", F.explode("pool").alias("x")).select("query_id", "n", F.col("x.id").alias("rep"), (-F.col("x.neg")).alias("score"))
    wanted = graph.copies.join(rows.select("rep").distinct(), "rep", "left_semi")
    few = top_k(wanted, ["rep"], [F.asc("id")], k + 1)  # more copies of one vector than that are no answer
    found = rows.join(few, "rep")
    if exclude_same:
        found = found.where(F.col("id") != F.col("query_id"))
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("id")], k, rank="rank").select("query_id", "id", "score", "rank", F.col("n").alias("n_distances"))


def add(graph: Graph, vectors: DataFrame, k: int = 16, ef: int = 64, width: int = 16, digits: int = 6) -> Graph:
    """The graph with more vectors, without a new build: new ones are searched for in the graph and compared with each
    other in a graph of their own; links go both ways. Ids that the index has are not added again."""
    fresh = vectors.where(F.size("cv") == (graph.dim or common_length(vectors))).join(graph.copies.select("id"), "id", "left_anti")
    if graph.dim == 0:
        return build(fresh, k, digits=digits)
    keyed = graph.nodes.select(F.struct(F.xxhash64("cv"), F.xxhash64(F.lit(1), "cv")).alias("key"), F.col("id").alias("rep"))
    nodes, copies = distinct_vectors(fresh, graph.dim)
    twins = cut(nodes.select("id", "cv", F.struct(F.xxhash64("cv"), F.xxhash64(F.lit(1), "cv")).alias("key")).join(keyed, "key", "left").drop("key"))
    known = twins.where("rep IS NOT NULL").select(F.col("id").alias("old"), F.col("rep").alias("node"))
    more = cut(twins.where("rep IS NULL").select("id", "cv"))
    copies = copies.join(known, F.col("rep") == F.col("old"), "left").select(F.coalesce("node", "rep").alias("rep"), "id")
    own = build(more, k, digits=digits).links.select("id", F.explode("links").alias("nid"))
    # every pool holds nodes, so copies don't take up places
    plain = Graph(graph.nodes, graph.links, graph.nodes.select(F.col("id").alias("rep"), "id"), graph.dim)
    near = cut(search(plain, more.select(F.col("id").alias("query_id"), F.col("cv").alias("qv")), k, ef, width, digits).select(F.col("query_id").alias("id"), F.col("id").alias("nid"), "score"))
    back = top_k(near.select(F.col("nid").alias("id"), F.col("id").alias("nid"), "score"), ["id"], [F.desc("score"), F.asc("nid")], k).select("id", "nid")
    fresh_links = own.unionByName(near.select("id", "nid")).unionByName(back).groupBy("id").agg(F.collect_set("nid").alias("add"))
    every = graph.nodes.unionByName(more)
    links = every.select("id").join(graph.links, "id", "left").join(fresh_links, "id", "left").select(
        "id", F.array_union(F.coalesce("links", F.array().cast("array<long>")), F.coalesce("add", F.array().cast("array<long>"))).alias("links"))
    return Graph(cut(every), cut(links), cut(graph.copies.unionByName(copies)), graph.dim)
