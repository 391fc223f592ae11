"""Corpus build: page views, title ranks, article selection, chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.functions.text import strip
from lamina.operators.ranking import ranked


def parse_views(lines: DataFrame, project: str = "zh") -> DataFrame:
    """``project title count bytes`` lines; malformed ones are skipped."""
    p = F.split("line", " ")
    return lines.where((F.size(p) >= 3) & (p[0] == project)).select(
        F.replace(p[1], F.lit("_"), F.lit(" ")).alias("title"), p[2].try_cast("bigint").alias("views")).where(F.col("views").isNotNull())


def total_views(lines: DataFrame, project: str = "zh") -> DataFrame:
    return parse_views(lines, project).groupBy("title").agg(F.sum("views").alias("views"))


def title_rank(titles: DataFrame, simplify: Callable[[Column], Column] = lambda c: c, top: int | None = None) -> DataFrame:
    """Rank titles by views from 0; spellings that simplify to the same title
    share the rank of the best one."""
    t = titles.withColumn("norm", simplify(F.col("title")))
    best = t.groupBy("norm").agg(F.min(F.struct(-F.col("views"), "title")).alias("b")).select(
        "norm", F.col("b.col1").alias("neg"), F.col("b.title").alias("lead"))
    r = ranked(best, [F.asc("neg"), F.asc("lead")], "rank", start=0)
    if top is not None:
        r = r.where(F.col("rank") < top)
    return t.join(r.select("norm", "rank"), "norm").select("title", "norm", "views", "rank")


def longest_per_key(docs: DataFrame, key: str, text: str, tie: str) -> DataFrame:
    """Keep the longest text of each key; equal lengths go to the lowest ``tie``."""
    rest = [c for c in docs.columns if c not in (key, tie)]
    g = docs.groupBy(key).agg(F.min(F.struct((-F.length(text)).alias("neg"), tie, *rest)).alias("b"))
    return g.select(key, F.col(f"b.{tie}").alias(tie), *[F.col(f"b.{c}").alias(c) for c in rest])


def select_articles(docs: DataFrame, ranks: DataFrame, min_len: int = X.MIN_TEXT_LEN) -> DataFrame:
    """``docs`` (doc_id, title, text) with a ranked title and enough text; one
    per rank, the longest."""
    d = docs.where(F.length("text") >= min_len).join(ranks.select("title", "rank"), "title")
    return longest_per_key(d, "rank", "text", "doc_id")


def paragraphs(text: Column, min_len: int = X.MIN_PARA) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda p: F.length(p) >= min_len)


def chunks(docs: DataFrame, size: int = X.CHUNK_SIZE, overlap: int = X.CHUNK_OVERLAP, min_para: int = X.MIN_PARA) -> DataFrame:
    """``docs`` (doc_id, text) -> overlapping windows over the kept paragraphs.
    The last window ends exactly at the text's end."""
    step = size - overlap
    d = docs.select("doc_id", F.array_join(paragraphs(F.col("text"), min_para), "\n").alias("full"))
    n = F.when(F.length("full") <= size, F.lit(1)).otherwise(F.ceil((F.length("full") - size) / step).cast("int") + 1)
    # one pass over the text: a substring would look for its start from the front
    windows = F.slice(F.regexp_extract_all("full", F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1)), F.lit(1), n)
    d = d.select("doc_id", F.posexplode(windows).alias("chunk_idx", "chunk"))
    return d.select("doc_id", "chunk_idx", F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("chunk_idx").cast("string")).alias("chunk_id"), "chunk")


def line_ranges(items: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Split N ordered lines into ``n`` contiguous ranges of ceil(N/n) lines."""
    r = ranked(items, order, "line", start=0)
    total = r.agg(F.count(F.lit(1)).alias("total"))  # one row
    r = r.join(F.broadcast(total))
    per = F.ceil(F.col("total") / n)
    return r.withColumn("part", F.floor(F.col("line") / per).cast("int")).drop("total")
