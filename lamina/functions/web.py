"""Plain extraction from HTML and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape_html(c: Column) -> Column:
    for k, v in ENTITIES.items():  # the ampersand last, so that nothing is decoded twice
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def tag_text(html: Column, tag: str) -> Column:
    return F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)


def visible_text(html: Column) -> Column:
    body = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(unescape_html(F.regexp_replace(body, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def result_items(pages: DataFrame) -> DataFrame:
    """List items of a result page: position, link and its text."""
    item = r"(?is)<li[^>]*>\s*<a href=\"([^\"]*)\"[^>]*>(.*?)</a>\s*</li>"
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(item), F.lit(1)).alias("href"),
                         F.regexp_extract_all("html", F.lit(item), F.lit(2)).alias("body"))
    return pages.select("page_id", F.posexplode(pairs).alias("pos", "it")).select(
        "page_id", "pos", F.col("it.href").alias("href"), F.trim(unescape_html(F.regexp_replace("it.body", "<[^>]*>", ""))).alias("title"))
