"""Layered retrieval: every question is answered from several layers at once.

A layer is a DataFrame of passages (query_id, rank, layer, id, title, text,
url, score, hop). Layers are computed for the whole batch of questions, so the
conditional web layer is a filtered branch rather than a second round.

Long texts that many questions find may be kept apart, as ``texts`` (ref, title,
text): passages then carry the first characters and ``ref``, and questions bring
what they look for to the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.operators import calibration as P
from lamina.operators import coverage as V
from lamina.operators import diversify as D
from lamina.operators import fusion as U
from lamina.operators.ranking import top_k
from lamina.functions.vectors import hash_embed8
from lamina.session import cut

PASSAGE = ["query_id", "list_no", "rank", "layer", "id", "title", "text", "url", "score", "calibrated"]
LIST_NO = {"L2_wiki": 1, "L3_history": 2, "L5_kg": 3, "L4_web": 4}
#: Characters of a text that fusion looks at, and those that are made into a vector.
HEAD, ENCODED = 80, 512


def referred(texts: DataFrame, name: str) -> DataFrame:
    """``texts`` (id, title, text, ...) with a name for each, ``ref``."""
    return texts.withColumn("ref", F.concat_ws(":", F.lit(name), F.col("id").cast("string"), F.hex(F.xxhash64("title", "text"))))


def named(passages: DataFrame, entities: DataFrame, texts: DataFrame) -> DataFrame:
    """``passages`` with ``named``: the entities of their question that the text behind their ``ref`` mentions, null without
    one. ``entities`` (query_id, entities array) travel to the texts, a pair of question and text once."""
    asked = entities.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("entities"))).alias("entities"))
    pairs = passages.where("ref IS NOT NULL").select("query_id", "ref").distinct().join(asked, "query_id")
    met = pairs.join(texts.select("ref", F.concat("text", F.lit(" "), "title").alias("doc")), "ref")
    own = met.select("query_id", "ref", F.filter("entities", lambda e: F.contains("doc", e)).alias("named")).dropDuplicates(["query_id", "ref"])
    return passages.join(own, ["query_id", "ref"], "left")


def passages(df: DataFrame, layer: str, hop: Column | None = None) -> DataFrame:
    d = df.withColumn("layer", F.lit(layer)).withColumn("list_no", F.lit(LIST_NO[layer]))
    if "url" not in d.columns:
        d = d.withColumn("url", F.lit(""))
    cal = F.round(P.calibrate(F.lit(layer), F.col("score"), hop), 4)
    return d.withColumn("calibrated", cal).select(*PASSAGE, *(["ref"] if "ref" in d.columns else []))


def history_search(hits: DataFrame, history: DataFrame, queries: DataFrame, k: int, admissible: Column) -> DataFrame:
    """``hits`` are the k·4 nearest history rows of each question; other
    tenants' rows and rows today's rules reject drop out, the rest is cut to k."""
    j = hits.join(history, "id").join(queries.select("query_id", F.col("namespace").alias("q_ns")), "query_id")
    j = j.where(F.col("namespace").eqNullSafe(F.col("q_ns")) & admissible)
    j = top_k(j.withColumnRenamed("rank", "hit_rank"), ["query_id"], [F.asc("hit_rank")], k, rank="rank")
    return j.withColumn("title", F.substring("query", 1, 40)).withColumn(
        "text", F.concat(F.lit("历史问答：\nQ: "), "query", F.lit("\nA: "), "answer"))


def within_budget(df: DataFrame, elapsed: Column, layer: Column) -> Column:
    """A layer counts when it returns inside its budget plus grace."""
    limit = F.when(layer == "L4_web", X.WEB_BUDGET_S + X.WEB_GRACE_S).otherwise(X.LAYER_BUDGET_S + X.LAYER_GRACE_S)
    return elapsed <= limit


def retrieve(queries: DataFrame, offline: list[DataFrame], web: DataFrame, entities: DataFrame | None = None,
             encoder=hash_embed8, k: int = X.FUSED_K, near_dup: float = X.NEAR_DUP,
             fuse: bool = True, texts: DataFrame | None = None, web_texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``queries`` (query_id, query, forced, routed_web). Returns the summary
    (one row per question) and, with ``fuse``, the passages (query_id, pos, ...).
    Offline passages that have a ``ref`` come with the first ``HEAD`` characters
    of one of ``texts`` (ref, title, text), web passages with the first
    ``ENCODED`` of one of ``web_texts``, and so they are returned."""
    if texts is not None or web_texts is not None:
        offline = [o if "ref" in o.columns else o.withColumn("ref", F.lit(None).cast("string")) for o in offline]
        web = web if "ref" in web.columns else web.withColumn("ref", F.lit(None).cast("string"))
    off = offline[0]
    for o in offline[1:]:
        off = off.unionByName(o)
    off = cut(off)  # read by confidence, coverage and fusion; a few rows per question
    conf = P.noisy_or(off)
    cov = V.term_coverage(queries, off.select("query_id", F.struct("list_no", "rank").alias("pos"), "title", "text", *([] if texts is None else ["ref"])), texts)
    any_off = off.select("query_id").distinct().withColumn("some", F.lit(True))
    flags = (queries.join(conf, "query_id", "left").join(cov, "query_id", "left").join(any_off, "query_id", "left")
             .withColumn("offline_confidence", F.coalesce("confidence", F.lit(0.0)))
             .withColumn("coverage", F.when(F.col("some"), F.col("coverage")).otherwise(0.0))
             .withColumn("missing", F.when(F.col("some"), F.col("missing")).otherwise(F.array().cast("array<string>")))
             .withColumn("web_fallback", ~F.col("routed_web") & V.needs_web(F.col("offline_confidence"), F.col("coverage"), F.col("forced")))
             .drop("confidence", "some"))
    flags = cut(flags)
    called = flags.where(F.col("web_fallback") | F.col("routed_web")).select("query_id")
    allp = off.unionByName(web.join(called, "query_id", "left_semi"))
    final = P.noisy_or(allp)
    hits = allp.groupBy("query_id").agg(*[F.count_if(F.col("layer") == n).alias(f"n_{n}") for n in LIST_NO])
    summary = (flags.join(final, "query_id", "left").join(hits, "query_id", "left")
               .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
               .withColumn("low_evidence", F.col("confidence") < X.ABSTAIN_CONFIDENCE)
               .fillna(0, [f"n_{n}" for n in LIST_NO]))
    if not fuse:
        return summary, None
    cand = k * X.CANDIDATE_MULTIPLIER
    whole = [t.select("ref", "title", "text") for t in (texts, web_texts) if t is not None]
    if whole and entities is not None:
        allp = named(allp, entities, reduce(DataFrame.unionByName, whole))
    fused = U.quota_fuse(allp, entities, cand) if entities is not None else U.rrf_top(allp, cand)
    fused = fused.withColumn("embedding", F.when(F.col("layer") == "L4_web", encoder(
        F.substring(F.concat_ws(" ", "title", "text"), 1, ENCODED))).otherwise(F.array().cast("array<double>")))
    best = D.diversify(fused.drop("named"), k, threshold=near_dup)
    return summary, best
