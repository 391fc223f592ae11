"""Reading an answer: citations, follow-up questions, judging, JSON."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lamina import fixed as X
from lamina.functions.text import U, let, rstrip, strip


def _ids(group: Column) -> Column:
    """``1,3-5`` -> 1 3 4 5; a range that is too wide or upside down is no range."""
    parts = F.filter(F.transform(F.split(group, "[,，、]"), strip), lambda p: p != "")

    def expand(p):
        lo, hi = (F.regexp_extract(p, r"^(\d+)\s*-\s*(\d+)$", i).try_cast("int") for i in (1, 2))
        ok = (lo > 0) & (lo <= hi) & (hi - lo < X.CITATION_RANGE_MAX)
        one = F.filter(F.array(p.try_cast("int")), lambda v: v.isNotNull())
        return F.when(F.contains(p, F.lit("-")), F.when(ok, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))).otherwise(one)

    return F.flatten(F.transform(parts, expand))


def citations(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per cited number, in reading order."""
    groups = F.regexp_extract_all(F.col(text), F.lit(X.CITATION), F.lit(1))
    d = df.select(key, F.posexplode(groups).alias("mark", "g"))
    return d.select(key, "mark", F.posexplode(_ids(F.col("g"))).alias("i", "source_id"))


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("sentence", T.StringType())]))
_SENT = re.compile(r"[。！？；\n]|(?<=[.!?])\s+")


def _spans(text: str | None) -> list[dict]:
    text = text or ""
    breaks = [(m.start(), m.end()) for m in _SENT.finditer(text)]
    out = []
    for m in re.finditer(X.CITATION, text):
        lo = max((e for _, e in breaks if e <= m.start()), default=0)
        hi = next((s for s, _ in breaks if s >= m.start()), len(text))
        out.append({"start": m.start(), "end": m.end(), "sentence": text[lo:hi].strip()[:X.SENTENCE_CHARS]})
    return out


@F.pandas_udf(_SPAN)
def citation_spans(text: pd.Series) -> pd.Series:
    """Offsets and sentence of every mark; Spark's regex functions return none."""
    return text.map(_spans)


def validate(cites: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """``sources`` (key, source_id): which cited numbers exist."""
    s = sources.select(key, "source_id").distinct().withColumn("valid", F.lit(True))
    return cites.join(s, [key, "source_id"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def citation_metrics(cites: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """``sources`` (key, source_id, risky)."""
    v = validate(cites, sources, key)
    inv = v.groupBy(key).agg(F.count_if(~F.col("valid")).alias("invalid"))
    used = v.where("valid").select(key, "source_id").distinct().withColumn("cited", F.lit(True))
    g = sources.join(used, [key, "source_id"], "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("cited")).alias("n_cited"), F.max("risky").alias("risky"))
    return g.join(inv, key, "left").withColumn("invalid", F.coalesce("invalid", F.lit(0))).withColumn(
        "coverage", F.round(F.col("n_cited") / F.col("n_sources"), 4))


def dedup_sources(df: DataFrame, keys: list[str]) -> DataFrame:
    """Same address (or layer and title) is one source: the most confident copy
    takes the place of the first, and places are renumbered."""
    k = F.when(F.coalesce("url", F.lit("")) != "", F.col("url")).otherwise(F.concat("layer", F.lit("::"), F.substring("title", 1, 40)))
    d = df.withColumn("skey", k)
    rest = [c for c in df.columns if c not in (*keys, "pos")]
    g = d.groupBy(*keys, "skey").agg(F.min("pos").alias("first"), F.min_by(F.struct(*rest), F.struct(-F.col("confidence"), "pos")).alias("r"))
    g = g.select(*keys, "first", *[F.col(f"r.{c}").alias(c) for c in rest])
    return g.withColumn("source_id", F.row_number().over(W.partitionBy(*keys).orderBy("first")))


def split_followups(answer: Column, question: Column) -> Column:
    """struct(body, followups, raw_count)."""
    marker = F.lit(X.FOLLOWUP_MARKER)
    at = F.instr(answer, X.FOLLOWUP_MARKER)
    body = F.when(at > 0, rstrip(F.substring(answer, F.lit(1), at - 1))).otherwise(answer)
    tail = F.when(at > 0, F.substring(answer, at + F.length(marker), F.length(answer))).otherwise("")
    raw = F.filter(F.split(tail, "\r?\n"), lambda ln: strip(ln) != "")
    norm = lambda s: F.lower(F.regexp_replace(s, U + X.FOLLOWUP_NORM, ""))
    orig = norm(F.coalesce(question, F.lit("")))

    def clean(ln):
        return strip(F.regexp_replace(F.regexp_replace(strip(ln), U + X.FOLLOWUP_DECOR, ""), X.FOLLOWUP_QUOTES, ""))

    def good(q):
        n = norm(q)
        asks = F.endswith(q, F.lit("?")) | F.endswith(q, F.lit("？")) | q.rlike(X.FOLLOWUP_ASKS)
        same = (n == orig) | ((F.length(n) > 6) & (F.contains(orig, n) | F.contains(n, orig)))
        return (q != "") & (F.length(q) <= X.FOLLOWUP_CHARS) & asks & ~same & ~q.rlike(U + X.FOLLOWUP_PRONOUN)

    def distinct(qs):
        keys = F.transform(qs, lambda q: F.lower(F.regexp_replace(q, U + X.FOLLOWUP_KEY, "")))
        return let(keys, lambda ks: F.filter(qs, lambda q, i: F.array_position(ks, F.get(ks, i)) == i + 1))

    picked = F.slice(let(F.filter(F.transform(raw, clean), good), distinct), 1, X.FOLLOWUP_MAX)
    return F.struct(body.alias("body"), picked.alias("followups"), F.size(raw).alias("raw_count"))


def judge(answer: Column, gold: Column) -> Column:
    """Loose match; a number must stand alone, so it is compared with the
    answer's runs of digits and dots."""
    norm = lambda c: F.lower(F.regexp_replace(c, U + X.JUDGE_PUNCT, ""))
    g, t = norm(gold), norm(F.coalesce(answer, F.lit("")))
    number = F.array_contains(F.regexp_extract_all(t, F.lit(r"[\d.]+"), F.lit(0)), g)
    return F.when((g == "") | (t == ""), False).when(g.rlike(r"^[\d.]+$"), number).otherwise(F.contains(t, g))


def judge_keys(answer: Column, keys: Column) -> Column:
    """``keys``: array of alternatives; how many groups are answered."""
    norm = lambda c: F.lower(F.regexp_replace(c, U + X.JUDGE_PUNCT, ""))
    t = norm(F.coalesce(answer, F.lit("")))
    return F.size(F.filter(keys, lambda alts: F.exists(alts, lambda a: F.contains(t, norm(a)))))


def first_json(text: Column) -> Column:
    """The JSON object in model output, after any thinking part."""
    rest = F.element_at(F.split(text, "</think>"), -1)
    found = F.regexp_extract(F.regexp_replace(strip(rest), "^`+|`+$", ""), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)
