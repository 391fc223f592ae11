"""Similarity search.

Exact inner-product search needs every query against every vector, so the work
is cut into a grid of (query block, corpus block) cells joined on the block
numbers. One task multiplies two bounded blocks and hands on at most ``k``
rows per query; the pairs themselves never become rows. The inverted-file form
uses the same grid inside each list, which also splits an oversized list.

Every block travels once per block of the other side, so blocks are as large as
``FLOATS`` allows once there are ``SIDE`` of them. Products are looked at a few
queries at a time: maxima of stretches of the corpus give a floor that at least
``k`` ids reach, and only stretches that reach it are looked at, rounded and sorted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.operators.ranking import top_k

BLOCK = 8192        # rows per side of a grid cell, at least
MOST = 131_072      # and at most
FLOATS = 1 << 22    # floats of a block that is larger than ``BLOCK`` rows
SIDE = 8            # blocks per side from which on these grow
PRODUCTS = 1 << 21  # products held at a time


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    size = np.diff(lists.offsets.to_numpy())
    if lists.null_count or (len(size) and (size != size[0]).any()):
        raise ValueError("vectors must not be null and have one length")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(size), -1)


def _score_cell(k: int, exclude_same: bool, digits: int, best_per_id: bool = False):
    slack = 10.0 ** -digits  # more than rounding moves two scores against each other

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and c.num_rows:
            ids = c.column("id").to_pandas().to_numpy()
            by_id = np.argsort(ids, kind="stable")
            ids = ids[by_id]
            mat = np.ascontiguousarray(_matrix(c.column("cv"))[by_id].T, np.float64)
            qids, qmat = q.column("query_id").to_pandas().to_numpy(), _matrix(q.column("qv"))
            n = len(ids)
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if best_per_id else np.arange(n)
            width = max(1, n // max(256, 8 * k))
            starts = first[np.unique(np.searchsorted(first, np.arange(0, n, width)).clip(max=len(first) - 1))]  # no id is in two stretches
            sizes = np.diff(np.r_[starts, n])
            lo, hi = np.searchsorted(ids, qids, "left"), np.searchsorted(ids, qids, "right")
            own = (hi > lo) & (qids == qids) if exclude_same else np.zeros(len(qids), bool)  # an id that is null equals none
            odd = not np.isfinite(mat).all()
            step = max(1, min(512, len(qids), PRODUCTS // n))
            products = np.empty((step, n))
            for i in range(0, len(qids), step):
                some = qmat[i:i + step].astype(np.float64)
                s = np.matmul(some, mat, out=products[:len(some)])
                if odd:
                    s[np.isnan(s)] = -np.inf
                for r in np.flatnonzero(own[i:i + step]):
                    s[r, lo[i + r]:hi[i + r]] = -np.inf
                top = np.maximum.reduceat(s, starts, axis=1)
                floor = np.partition(top, len(starts) - k, axis=1)[:, len(starts) - k] - slack if len(starts) >= k else np.full(len(s), -np.inf)
                r, stretch = np.nonzero(top >= floor[:, None])
                long = sizes[stretch]
                col = np.arange(long.sum()) + np.repeat(starts[stretch] - (np.cumsum(long) - long), long)
                r = np.repeat(r, long)
                v = s[r, col]
                some = (v >= floor[r]) & np.isfinite(v)
                r, at, v = r[some], ids[col[some]], np.round(v[some], digits)
                if best_per_id:
                    order = np.lexsort((-v, at, r))
                    r, at, v = r[order], at[order], v[order]
                    one = np.r_[True, (r[1:] != r[:-1]) | (at[1:] != at[:-1])][:len(r)]
                    r, at, v = r[one], at[one], v[one]
                order = np.lexsort((at, -v, r))
                r, at, v = r[order], at[order], v[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
                parts.append((qids[i + r[keep]], at[keep], v[keep]))
        columns = [np.concatenate(x) for x in zip(*parts)]
        return pa.table({n: pa.array(x, t, from_pandas=True) for n, x, t in zip(("query_id", "id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()))})

    return run


def cell_topk(queries: DataFrame, corpus: DataFrame, k: int, exclude_same: bool = False,
              block: int | None = None, digits: int = 6, best_per_id: bool = False) -> DataFrame:
    """``queries`` (query_id, qv, cell) against ``corpus`` (id, cv, cell). With
    ``best_per_id`` the rows of an id count as one with the best of their
    scores; they share a block, since blocks are dealt by id. ``block``: rows
    per side of a grid cell, by default after the vectors' length.

    Sizes are counted per cell, so both a crowded cell and a crowded query side
    split into more blocks. The grid has one row per cell, not per vector."""

    def size(d: DataFrame, vec: str, n: str) -> DataFrame:
        rows = F.count(F.lit(1))
        if block:
            return d.groupBy("cell").agg(F.ceil(rows / block).cast("int").alias(n))
        most = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST), F.floor(F.lit(FLOATS) / F.greatest(F.max(F.size(vec)), F.lit(1)))))
        return d.groupBy("cell").agg(F.greatest(F.ceil(rows / most), F.least(F.ceil(rows / BLOCK), F.lit(SIDE))).cast("int").alias(n))

    grid = F.broadcast(size(queries, "qv", "nq").join(size(corpus, "cv", "nc"), "cell"))  # one row per cell: at most the number of lists
    q = (queries.join(grid, "cell")
         .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("nq")))
         .withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nc").cast("long") - 1)))
         .select("cell", "qb", "cb", "query_id", "qv"))
    c = (corpus.join(grid, "cell")
         .withColumn("cb", F.pmod(F.xxhash64("id"), F.col("nc")))
         .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq").cast("long") - 1)))
         .select("cell", "qb", "cb", "id", "cv"))
    part = (q.groupBy("cell", "qb", "cb").cogroup(c.groupBy("cell", "qb", "cb"))
            .applyInArrow(_score_cell(k, exclude_same, digits, best_per_id), "query_id long, id long, score double"))
    return top_k(part, ["query_id"], [F.desc("score"), F.asc("id")], k, rank="rank")


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int, **kw) -> DataFrame:
    """``queries`` (query_id, qv), ``corpus`` (id, cv) -> query_id, id, score, rank."""
    one = lambda c: F.pmod(F.xxhash64(c), F.lit(1))  # a single cell, but not a constant the planner folds into a product
    return cell_topk(queries.withColumn("cell", one("query_id")), corpus.withColumn("cell", one("id")), k, **kw)


# ---- inverted file ------------------------------------------------------------


def train_lists(corpus: DataFrame, nlist: int, seed: int = 42) -> np.ndarray:
    """Centroids by k-means over all vectors; fewer than ``nlist`` when there are
    fewer different vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = corpus.select(array_to_vector(F.col("cv").cast("array<double>")).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=10).fit(v)
    return np.array(model.clusterCenters())


def nearest_lists(vec: Column, centroids: np.ndarray, n: int) -> Column:
    """Numbers of the ``n`` closest lists; the centroid table has nlist rows."""
    c2 = (centroids ** 2).sum(1)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def probe(s: pd.Series) -> pd.Series:
        if len(s) == 0:
            return pd.Series([], dtype=object)
        m = np.stack(s.to_numpy()).astype(np.float64)
        d = c2[None, :] - 2.0 * (m @ centroids.T)
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return probe(vec)


def ivf_topk(queries: DataFrame, corpus: DataFrame, k: int, nlist: int, nprobe: int, **kw) -> DataFrame:
    cent = train_lists(corpus, nlist)
    q = queries.withColumn("cell", F.explode(nearest_lists(F.col("qv"), cent, nprobe)))
    c = corpus.withColumn("cell", F.element_at(nearest_lists(F.col("cv"), cent, 1), 1))
    return cell_topk(q, c, k, **kw)


def modal_dimension(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Vectors per length; the most frequent length is the one to keep."""
    sizes = df.groupBy(F.size(vec).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max_by("dim", F.struct("n", -F.col("dim"))).alias("dim"), F.sum("n").alias("vectors"),
                     F.max("n").alias("kept"))
