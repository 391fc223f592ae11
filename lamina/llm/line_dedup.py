"""Line deduplication by site-relative frequency: a line that more than a given
share of a host's pages carry is boilerplate there and goes.

A page counts once for each distinct line. Lines are compared by 64-bit hash.
Counts combine before the shuffle, so a common line or host is only a number.
What a host drops is at most (lines per page / ratio) hashes; they meet the
pages under (host, salt), so that a host with a third of all pages is dealt out.
A page of which less than half (in characters) would stay is a copy, not a page
in a frame: it keeps its lines and is left to deduplication of documents.

Blank lines stay. Null or empty texts have no lines and stay as they are; a null
host is a host of its own; repeated rows count as pages each; an empty table
gives an empty result; other columns are handed on. All steps are DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import carrying

RATIO, LEAST_PAGES, SALTS = 0.1, 3, 16
#: Parts of a page without text, and tags, each of which ends a line.
_HIDDEN, _TAG = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", r"(?s)<[^>]*>"
_EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_BLANK = r"^[\x20\x09-\x0D]*$"


def url_host(url: Column) -> Column:
    """Host in lower case, without user and port; null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def page_lines(html: Column) -> Column:
    """Visible lines of a page, trimmed of spaces, blank ones left out."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "\n"), _TAG, "\n")
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, _EDGES, "")), lambda x: x != "")


def _hash(line: Column) -> Column:
    return F.when(~line.rlike(_BLANK), F.xxhash64(line))


def boilerplate(pages: DataFrame, host: str, lines: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host`` and ``line``, the hash, of each line on more than ``ratio`` of the
    host's pages and on at least ``least_pages`` of them."""
    hashed = pages.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(lines, _hash))).alias("line")).where("line is not null")
    counts = hashed.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    totals = pages.groupBy(F.col(host).alias("h")).agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, F.expr("host <=> h")).where(F.col("n") > ratio * F.col("total")).select("host", "line")


def without_boilerplate(pages: DataFrame, host: str, lines: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES, salts: int = SALTS) -> DataFrame:
    """``pages`` with ``kept_lines``: the array ``lines`` without its host's boilerplate."""
    dropped = boilerplate(pages, host, lines, ratio, least_pages).groupBy("host").agg(F.collect_set("line").alias("_dropped"))
    dropped = dropped.select(F.col("host").alias("_host"), "_dropped", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = pages.withColumn("_s", F.pmod(F.xxhash64(lines), F.lit(salts)).cast("int"))
    joined = salted.join(dropped, F.col(host).eqNullSafe(F.col("_host")) & (F.col("_s") == F.col("_salt")), "left")
    rest = F.filter(lines, lambda x: F.coalesce(~F.array_contains("_dropped", _hash(x)), F.lit(True)))
    chars = lambda c: F.length(F.array_join(c, ""))
    out = joined.withColumn("_rest", F.when(F.col("_dropped").isNull(), F.col(lines)).otherwise(rest))
    return out.withColumn("kept_lines", F.when(chars("_rest") * 2 >= chars(lines), F.col("_rest")).otherwise(F.col(lines))).drop("_s", "_host", "_dropped", "_salt", "_rest")


@carrying
def dedup_documents(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Documents with boilerplate lines of their ``host`` column taken out of ``text`` and ``n_chars`` brought up to date."""
    lined = docs.withColumn("_lines", F.split("text", "\n", -1))
    out = without_boilerplate(lined, host, "_lines", ratio, least_pages)
    text = F.when(F.size("kept_lines") == F.size("_lines"), F.col("text")).otherwise(F.array_join("kept_lines", "\n"))
    out = out.withColumn("text", text)
    return out.select(*[(F.length("text").cast("long") if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def dedup_pages(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Per page its host, how many visible lines it has, how many go, and the text that stays."""
    lined = pages.select("page_id", url_host(F.col("url")).alias("host"), page_lines(F.col("html")).alias("lines"))
    out = without_boilerplate(lined, "host", "lines", ratio, least_pages)
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"),
                      (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_dropped"), F.array_join("kept_lines", "\n").alias("text"))
