"""Answer cache: exact and similar hits, layers, upserts, statistics.

An entry is (key, namespace, query, answer, write_ts, ttl); ``ttl`` null never
expires. Times are epoch seconds and always a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.functions import slots as S
from lamina.operators import vectors as V
from lamina.operators.ranking import first_per_key, top_k


def latest(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The last write of a key; equal times go to the lower ``seq``."""
    d = entries.withColumn("_neg", -F.col("write_ts"))
    return first_per_key(d, keys, ["_neg", "seq"]).drop("_neg")


def live(now: int) -> Column:
    return (F.col("write_ts") <= now) & (F.col("ttl").isNull() | (F.lit(now) < F.col("write_ts") + F.col("ttl")))


def exact(asks: DataFrame, entries: DataFrame, now: int) -> DataFrame:
    """``asks`` (ask_id, key, ...): the live answer under the same key. Entries
    are one per key, so a popular question only repeats on the asking side."""
    e = latest(entries.where(F.col("write_ts") <= now), ["key"]).where(live(now))
    return asks.join(e.select("key", F.col("answer"), F.col("seq").alias("entry")), "key", "left")


def with_fallback(asks: DataFrame, entries: DataFrame, now: int) -> DataFrame:
    """Own namespace first (``key``), then the global one (``global_key``)."""
    own = exact(asks, entries, now).select("ask_id", "key", "global_key", "query", F.col("answer").alias("own"), F.col("entry").alias("own_entry"))
    glob = exact(own.withColumnRenamed("key", "own_key").withColumnRenamed("global_key", "key"), entries, now)
    return glob.select("ask_id", "query", F.coalesce("own", "answer").alias("answer"), F.coalesce("own_entry", "entry").alias("entry"))


def nearest_shared(asks: DataFrame, entries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``asks`` (query_id, vec_id) and ``entries`` (id, vec_id) that name rows of ``vectors`` (vec_id, embedding): the k
    most similar entries of each ask (query_id, id, score, rank). A vector is searched once however many name it. It
    is found under its smallest entry, so that of equal vectors none is left out whose entries come before others',
    and of its entries no more than the first k can be found. An entry's id has one vector."""
    used = lambda d: vectors.join(d.select("vec_id"), "vec_id", "left_semi")
    lead = entries.groupBy("vec_id").agg(F.min("id").alias("lead"))
    near = V.exact_topk(used(asks).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")),
                        vectors.join(lead, "vec_id").select(F.col("lead").alias("id"), F.col("embedding").alias("cv")), k)
    first = top_k(entries, ["vec_id"], [F.asc("id")], k).join(lead, "vec_id").select("lead", "id")
    rows = near.select(F.col("query_id").alias("vec_id"), F.col("id").alias("lead"), "score").join(first, "lead")
    best = top_k(rows.select("vec_id", "id", "score"), ["vec_id"], [F.desc("score"), F.asc("id")], k)
    return top_k(asks.join(best, "vec_id").drop("vec_id"), ["query_id"], [F.desc("score"), F.asc("id")], k, rank="rank")


def fuzzy(asks: DataFrame, entries: DataFrame, now: int, threshold: float = X.FUZZY_THRESHOLD, k: int = X.FUZZY_CANDIDATES,
          hits: DataFrame | None = None) -> DataFrame:
    """``asks`` (query_id, query, namespace, qv), ``entries`` (id, query,
    namespace, answer, cv, write_ts, ttl). The first of the k most similar
    entries that is close enough, of the same tenant, about the same thing and
    still live. ``hits`` (query_id, id, score, rank): the k most similar, if they are known."""
    hits = V.exact_topk(asks.select("query_id", "qv"), entries.select("id", "cv"), k) if hits is None else hits
    a = asks.select("query_id", F.col("namespace").alias("ns"), S.slots(F.col("query")).alias("sa"))
    e = entries.select("id", "namespace", "answer", "write_ts", "ttl", S.slots(F.col("query")).alias("se"))
    j = hits.where(F.col("score") >= threshold).join(a, "query_id").join(e, "id")
    ok = j.where(F.col("namespace").eqNullSafe(F.col("ns")) & live(now)).where(S.gate(F.col("se"), F.col("sa")).isNull())
    return ok.groupBy("query_id").agg(F.min_by(F.struct("id", "score", "answer"), "rank").alias("b")).select("query_id", "b.*")


def read_through(asks: DataFrame, layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """First layer that holds the key, and the layers above it to fill."""
    d = asks
    for name, t in layers:
        d = d.join(t.select("key", F.col("answer").alias(f"a_{name}")), "key", "left")
    hit = reduce(lambda acc, n: acc.when(F.col(f"a_{n}").isNotNull(), n), [n for n, _ in layers[1:]],
                 F.when(F.col(f"a_{layers[0][0]}").isNotNull(), layers[0][0]))
    fill = F.when(hit.isNotNull(), F.array_position(F.array(*[F.lit(n) for n, _ in layers]), hit).cast("int") - 1).otherwise(0)
    return d.withColumn("layer", hit).withColumn("backfill", fill).withColumn("answer", F.coalesce(*[f"a_{n}" for n, _ in layers]))


def backfill_ttl(left: Column) -> Column:
    return F.when(left > 0, left).otherwise(F.lit(X.BACKFILL_TTL)).cast("long")


def upsert(base: DataFrame, changes: DataFrame, deletes: DataFrame) -> DataFrame:
    """Changes replace rows of the same key, deletes remove them."""
    kept = base.join(changes.select("key"), "key", "left_anti").unionByName(changes)
    return kept.join(deletes.select("key"), "key", "left_anti")


def stats(log: DataFrame, keys: list[str]) -> DataFrame:
    """``log.outcome`` in exact, fuzzy, miss, gate_reject."""
    n = lambda v: F.count_if(F.col("outcome") == v)
    g = log.groupBy(*keys).agg(n("exact").alias("exact"), n("fuzzy").alias("fuzzy"), n("miss").alias("misses"), n("gate_reject").alias("rejects"))
    rate = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    e, f, m, r = (F.col(c) for c in ("exact", "fuzzy", "misses", "rejects"))
    return g.select(*keys, "exact", "fuzzy", "misses", "rejects", rate(e + f, e + f + m).alias("hit_rate"),
                    rate(f, e + f).alias("fuzzy_rate"), rate(r, r + f).alias("reject_rate"))


def first_provider(results: DataFrame, key: str, priority: str) -> DataFrame:
    """Rows of the best provider that returned anything, per question."""
    best = results.groupBy(key).agg(F.min(priority).alias("_best"))
    return results.join(best, key).where(F.col(priority) == F.col("_best")).drop("_best")
