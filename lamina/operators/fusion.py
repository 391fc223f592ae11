"""Rank fusion, quotas and reranking over per-query candidate lists.

A fused pool never exceeds a few dozen rows per query, because every list is
cut to its layer's k first; only such pools are packed into arrays for the
order-dependent folds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lamina import fixed as X
from lamina.operators.ranking import top_k
from lamina.session import cut


def passage_key(url: Column, title: Column, text: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return F.when(url != "", F.concat(F.lit("url::"), url)).otherwise(
        F.concat(F.lit("txt::"), F.substring(title, 1, 40), F.lit("|"), F.substring(text, 1, 80)))


def rrf(df: DataFrame, k: int = X.RRF_K) -> DataFrame:
    """``df``: query_id, list_no, rank (from 1 in its list), layer, title, text,
    url, calibrated and any payload. Copies of a passage add up 1/(k+rank); the
    first seen one (list order, then rank) stays as representative."""
    d = df.withColumn("pkey", passage_key(F.col("url"), F.col("title"), F.col("text")))
    seen = F.struct("list_no", "rank")
    keep = [c for c in d.columns if c not in ("query_id", "pkey", "list_no", "rank", "calibrated")]
    # summing in list order keeps the floating point result independent of task order
    parts = F.transform(F.array_sort(F.collect_list(F.struct("list_no", "rank"))), lambda r: 1.0 / (k + r["rank"]))
    g = d.groupBy("query_id", "pkey").agg(
        F.aggregate(parts, F.lit(0.0), lambda s, x: s + x).alias("rrf"),
        F.min_by(F.struct(*keep), seen).alias("rep"),
        F.max("calibrated").alias("calibrated"),
        F.min(seen).alias("first"),
        F.array_sort(F.collect_list(F.struct("list_no", "rank", "layer"))).alias("hits"),
    )
    return g.select(
        "query_id", "pkey", *[F.col(f"rep.{c}").alias(c) for c in keep if c != "rrf"], "calibrated", "rrf",
        F.col("first.list_no").alias("first_list"), F.col("first.rank").alias("first_rank"),
        F.array_distinct(F.transform("hits", lambda h: h["layer"])).alias("layers"),
    )




def rrf_order() -> list[Column]:
    return [F.desc("rrf"), F.asc("first_list"), F.asc("first_rank")]


def rrf_top(df: DataFrame, k: int, pos: str = "pos") -> DataFrame:
    return top_k(rrf(df), ["query_id"], rrf_order(), k, rank=pos)


def pack(df: DataFrame, fields: list[str], order: list[str], name: str = "pool", key: str = "query_id") -> DataFrame:
    """One row per key with its bounded pool as an ordered array of structs."""
    rest = [f for f in fields if f not in order]
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))


def quota_pick(pool: Column, owners: Callable[[Column], Column], n_entities: Column, top: int, per_entity: int) -> Column:
    """Positions (0-based) taken from an rrf-ordered pool so that every entity
    with evidence gets up to its quota, then filled in pool order.

    ``owners(item)`` gives the indexes of the entities an item speaks for."""
    quota = F.greatest(F.lit(1), F.least(F.lit(per_entity), F.floor(F.lit(top) / n_entities).cast("int")))
    idx = F.sequence(F.lit(0), F.size(pool) - 1)
    zero = F.struct(F.array_repeat(F.lit(0), n_entities).alias("filled"), F.array().cast("array<int>").alias("taken"))

    def step(acc, i):
        mine = owners(pool[i])
        hungry = F.exists(mine, lambda e: F.get(acc["filled"], e) < quota)
        take = hungry & (F.size(acc["taken"]) < top)
        return F.struct(
            F.when(take, F.transform(acc["filled"], lambda v, j: v + F.when(F.array_contains(mine, j), 1).otherwise(0)))
            .otherwise(acc["filled"]).alias("filled"),
            F.when(take, F.array_append(acc["taken"], i)).otherwise(acc["taken"]).alias("taken"))

    first = F.aggregate(idx, zero, step)["taken"]
    rest = F.array_except(idx, first)
    return F.array_sort(F.slice(F.concat(first, rest), 1, top))


def quota_fuse(df: DataFrame, entities: DataFrame, top: int, per_entity: int = X.PER_ENTITY) -> DataFrame:
    """``entities`` (query_id, entities array): any number per query, and the
    pool grows with it. Fewer than two entities leave plain rank fusion. Rows of
    ``df`` with ``named``, the entities their text mentions, may hold less than their text."""
    fused = rrf(df)
    ranked = fused.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(*rrf_order())))  # a question's lists, cut by the layers before
    rows = ranked.join(entities, "query_id", "left").withColumn(
        "entities", F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: e != ""))
    n = F.size("entities")
    size = F.when(n < 2, F.lit(top)).otherwise(F.greatest(F.lit(top), n * per_entity * 2, F.lit(top * 3)))
    doc = F.concat("text", F.lit(" "), "title")

    def speaks(i):
        e = F.get("entities", i)
        return F.when(F.col("named").isNull(), F.contains(doc, e)).otherwise(F.array_contains("named", e)) if "named" in df.columns else F.contains(doc, e)

    rows = rows.where(F.col("pos") <= size).withColumn("owners", F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), speaks))
    rows = cut(rows)  # a few dozen rows per question, read by the fold and by the final join
    small = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "owners"))).alias("pool"), F.first("entities").alias("ents"))
    picked = small.select("query_id", F.when(F.size("ents") < 2, F.expr(f"slice(transform(pool, (x, i) -> i), 1, {top})")).otherwise(
        quota_pick(F.col("pool"), lambda it: it["owners"], F.greatest(F.size("ents"), F.lit(1)), top, per_entity)).alias("picks"))
    chosen = picked.select("query_id", F.posexplode("picks").alias("new_pos", "i")).select(
        "query_id", (F.col("new_pos") + 1).alias("new_pos"), (F.col("i") + 1).alias("pos"))
    return rows.join(chosen, ["query_id", "pos"]).drop("pos", "owners", "entities").withColumnRenamed("new_pos", "pos")


def rank_in_source(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return top_k(df, keys, order, k, rank="rank_in_source")


def rerank_rrf(df: DataFrame, k: int = X.RRF_K) -> DataFrame:
    """Add 1/(k + rank in source) to whatever rerank score a row already has."""
    return df.withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)) + 1.0 / (k + F.col("rank_in_source")))


def rerank_cascade(df: DataFrame, scorer: Callable[[Column, Column], Column], coarse: int = 20) -> DataFrame:
    """Coarse rank fusion to ``coarse`` rows, then ``scorer(query, text)``,
    which may be a cross-encoder behind a pandas UDF."""
    few = top_k(rerank_rrf(df), ["query_id"], [F.desc("rerank_score"), F.asc("id")], coarse)
    return few.withColumn("rerank_score", scorer(F.col("query"), F.substring("text", 1, 512)))
