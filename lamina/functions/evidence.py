"""Turning passages into evidence text that cannot give orders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina import fixed as X
from lamina.functions.text import U, once, rstrip, strip


@F.pandas_udf(T.StringType())
def two_digits(s: pd.Series) -> pd.Series:
    """Two decimals, halves decided on the binary value."""
    return s.map(lambda v: None if v is None or pd.isna(v) else f"{v:.2f}")


def escape_delimiters(c: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(c, F.lit("(?i)" + X.FAKE_DELIM), F.lit(0)))
    return F.aggregate(found, c, lambda acc, m: F.replace(acc, m, F.translate(m, "<>", "＜＞")))


def annotate(c: Column) -> Column:
    for flags, p in X.INJECTIONS:
        c = F.regexp_replace(c, U + (f"(?{flags})" if flags else "") + p, X.FLAG_OPEN + "$0" + X.FLAG_CLOSE)
    return c


def sanitize(df: DataFrame, text: str, limit: int | None, out: str = "clean", risks: str = "risks") -> DataFrame:
    """Adds the harmless text and the list of what was found in it. Each stage
    is computed once, since later ones compare against it."""
    d = once(df, "_c0", F.coalesce(F.col(text), F.lit("")))
    d = once(d, "_c1", F.regexp_replace("_c0", X.CONTROL_CHARS, ""))
    d = once(d, "_c2", escape_delimiters(F.col("_c1")))
    d = once(d, "_c3", annotate(F.col("_c2")))
    cut = F.length("_c3") > limit if limit is not None else F.lit(False)
    d = d.withColumn(out, F.when(cut, F.concat(rstrip(F.substring("_c3", 1, limit or 0)), F.lit("…"))).otherwise(F.col("_c3")))
    found = F.array(F.when(F.col("_c1") != F.col("_c0"), "control_chars"), F.when(F.col("_c2") != F.col("_c1"), "fake_delimiter"),
                    F.when(F.col("_c3") != F.col("_c2"), "injection"), F.when(cut, "truncated"))
    return d.withColumn(risks, F.filter(found, lambda r: r.isNotNull())).drop("_c0", "_c1", "_c2", "_c3")


def safe_attr(c: Column, limit: int = 200) -> Column:
    v = F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), X.CONTROL_CHARS, ""), 1, limit)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def layer_label(layer: Column) -> Column:
    out = None
    for k, v in X.LAYER_LABELS.items():
        out = F.when(layer == k, v) if out is None else out.when(layer == k, v)
    return out.otherwise(F.when(layer == "", "未知").otherwise(layer))


def evidence_docs(df: DataFrame, doc_chars: int = X.DOC_CHARS, texts: DataFrame | None = None) -> DataFrame:
    """Per passage: sanitised text and the attributes behind the document id. With
    ``texts`` (ref, text), passages that have a ``ref`` get that text, which is
    sanitised once for all of them and travels cut to ``doc_chars``."""

    def cleaned(d):
        return sanitize(d.where(strip(F.coalesce("text", F.lit(""))) != ""), "text", doc_chars, "clean", "risks")

    if texts is None:
        d = cleaned(df)
    else:
        used = texts.select("ref", "text").join(df.select("ref").distinct(), "ref", "left_semi")
        once_each = cleaned(used).select("ref", "clean", "risks").distinct()
        d = cleaned(df.where("ref IS NULL")).unionByName(df.where("ref IS NOT NULL").join(once_each, "ref"))
    d = d.where(strip(F.col("clean")) != "")
    d = sanitize(d, "title", X.TITLE_CHARS, "safe_title", "title_risks")
    d = d.withColumn("risks", F.array_union("risks", "title_risks")).drop("title_risks")
    conf = F.coalesce("calibrated", "score", F.lit(0.0))
    d = d.withColumn("conf", conf).withColumn("conf2", two_digits(conf))
    attrs = F.concat(
        F.lit(' type="'), safe_attr(layer_label(F.col("layer"))), F.lit('"'),
        F.when(F.col("safe_title") != "", F.concat(F.lit(' title="'), safe_attr(F.col("safe_title")), F.lit('"'))).otherwise(""),
        F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit(' url="'), safe_attr(F.col("url"), 500), F.lit('"'))).otherwise(""),
        F.lit(' conf="'), "conf2", F.lit('"'),
        F.when(F.size("risks") > 0, F.concat(F.lit(' risk="'), F.array_join("risks", ","), F.lit('"'))).otherwise(""))
    return d.withColumn("attrs", attrs)


def evidence_block(df: DataFrame, total: int = X.EVIDENCE_CHARS, doc_chars: int = X.DOC_CHARS, texts: DataFrame | None = None) -> DataFrame:
    """``df``: passages with ``pos``, a handful per question. The first document
    is always in; the first one that does not fit ends the block. ``texts``: see ``evidence_docs``."""
    d = evidence_docs(df, doc_chars, texts)
    packed = d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "attrs", "clean", "id", "layer", "conf"))).alias("docs"))
    zero = F.struct(F.lit(0).alias("total"), F.lit(False).alias("stop"), F.array().cast("array<string>").alias("out"))

    def add(acc, x):
        n = F.size(acc["out"]) + 1
        doc = F.concat(F.lit('<doc id="'), n.cast("string"), F.lit('"'), x["attrs"], F.lit(">\n"), x["clean"], F.lit("\n</doc>"))
        stop = acc["stop"] | ((acc["total"] + F.length(doc) > total) & (n > 1))
        return F.struct(F.when(stop, acc["total"]).otherwise(acc["total"] + F.length(doc)).alias("total"), stop.alias("stop"),
                        F.when(stop, acc["out"]).otherwise(F.array_append(acc["out"], doc)).alias("out"))

    d = once(packed, "r", F.aggregate("docs", zero, add))
    block = F.array_join(F.concat(F.array(F.lit("<evidence>"), F.lit(X.GUARD_HINT)), F.col("r.out"), F.array(F.lit("</evidence>"))), "\n")
    src = F.transform(F.slice("docs", F.lit(1), F.greatest(F.size("r.out"), F.lit(0))), lambda x: x["id"].cast("string"))
    return d.select("query_id", block.alias("block"), src.alias("source_ids"))


def user_message(question: Column, block: Column, low: Column, forced: Column) -> Column:
    q = F.regexp_replace(F.coalesce(question, F.lit("")), X.CONTROL_CHARS, "")
    return F.concat_ws("\n\n", F.when(block != "", block), F.when(forced, F.lit(X.SEARCH_NOTE)), F.when(low, F.lit(X.RETRIEVAL_NOTE)),
                       F.concat(F.lit("<question>\n"), q, F.lit("\n</question>")))
