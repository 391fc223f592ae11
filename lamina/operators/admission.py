"""Rules that decide what may be cached, routed, retried or kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.functions.text import U, any_of, has_any, head, once, strip, strs, tail


def time_sensitive(q: Column, as_of_year: int) -> Column:
    years = [str(as_of_year + d) for d in (-1, 0, 1)]
    return F.coalesce(has_any(F.lower(q), (*X.TIME_CUES, *years)), F.lit(False))


def volatile_slot(q: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [q.rlike(U + p) for p in X.VOLATILE_PATTERNS]), F.lit(False))


def low_quality(a: Column) -> Column:
    opening = F.lower(head(strip(a), X.LOW_QUALITY_HEAD))
    return F.when(a.isNull() | (a == ""), True).otherwise(has_any(opening, X.LOW_QUALITY_CUES))


def partial_refusal(a: Column) -> Column:
    s = strip(a)
    ending = has_any(F.lower(tail(s, X.PARTIAL_TAIL)), X.PARTIAL_TAIL_CUES)
    opening = has_any(F.lower(head(s, X.PARTIAL_HEAD)), X.PARTIAL_HEAD_CUES)
    return F.when(a.isNull() | (a == ""), True).otherwise(ending | opening)


def cache_tier(q: Column, a: Column, web_hits: Column, as_of_year: int) -> Column:
    """First rule that applies, from rejecting to admitting."""
    short = a.isNull() | (F.length(strip(a)) < X.MIN_ANSWER_LEN)
    return (
        F.when(short, "reject_too_short")
        .when(low_quality(a), "reject_low_quality")
        .when(partial_refusal(a), "reject_partial_refusal")
        .when(time_sensitive(q, as_of_year), "reject_time_sensitive")
        .when(F.coalesce(web_hits, F.lit(0)) > 0, "web_backed")
        .when(volatile_slot(q), "volatile")
        .otherwise("stable")
    )


def tier_ttl(tier: Column) -> Column:
    return (
        F.when(tier == "web_backed", X.TTL_WEB)
        .when(tier == "volatile", X.TTL_VOLATILE)
        .when(tier == "stable", X.TTL_STABLE)
    ).cast("int")


def with_cacheability(df: DataFrame, as_of_year: int, web_hits: str | None = "web_hits") -> DataFrame:
    hits = F.col(web_hits) if web_hits else F.lit(0)
    tier = cache_tier(F.col("query"), F.col("answer"), hits, as_of_year)
    return (once(df, "tier", tier)
            .withColumn("ttl", tier_ttl(F.col("tier")))
            .withColumn("cacheable", F.col("ttl").isNotNull()))


def admissible(q: Column, a: Column, as_of_year: int) -> Column:
    """Read-side recheck: the admission rules without any web evidence."""
    return ~F.startswith(cache_tier(q, a, F.lit(0), as_of_year), F.lit("reject"))


def archive_targets(df: DataFrame, as_of_year: int) -> DataFrame:
    """A turn goes to the answer cache when cacheable and not forced, and to
    history unless the answer itself is unusable."""
    unusable = ("reject_low_quality", "reject_too_short", "reject_partial_refusal")
    d = with_cacheability(df, as_of_year)
    return (d.withColumn("to_l1", F.col("cacheable") & ~F.col("forced"))
            .withColumn("to_l3", ~F.col("tier").isin(*unusable)))


def route_layers(q: Column, strategy: str, as_of_year: int) -> Column:
    if strategy == "offline_only":
        return strs(("L2_wiki", "L3_history", "L5_kg"))
    if strategy == "web_only":
        return strs(("L4_web",))
    base = ("L2_wiki", "L3_history", "L5_kg")
    return F.when(time_sensitive(q, as_of_year), strs((*base, "L4_web"))).otherwise(strs(base))


# ---- web intent -------------------------------------------------------------


def _norm(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), U + X.WEB_NORM, "")


def _norm_words(words) -> tuple[str, ...]:
    import re

    return tuple(re.sub(X.WEB_NORM, "", w.lower()) for w in words)


def wants_web(q: Column) -> Column:
    raw = F.lower(strip(q))
    asks = raw.rlike("^(?:" + any_of(X.WEB_INTERROGATIVE) + ")")
    n = _norm(q)
    strong = has_any(n, _norm_words(X.WEB_STRONG))
    both = has_any(n, _norm_words(X.WEB_CHANNEL)) & has_any(n, _norm_words(X.WEB_ACTION))
    return F.coalesce((raw != "") & ~asks & (strong | both), F.lit(False))


def strip_directive(q: Column) -> Column:
    raw = strip(q)
    quoted = [
        F.regexp_extract(raw, "[“\"']([^”\"']{2,})[”\"']", 1),
        F.regexp_extract(raw, "「([^」]{2,})」", 1),
        F.regexp_extract(raw, "『([^』]{2,})』", 1),
    ]
    words = sorted(dict.fromkeys(X.WEB_STRONG + X.WEB_ACTION + X.WEB_CHANNEL), key=len, reverse=True)
    c = raw
    for w in words:  # one pass per word: an earlier removal can expose a later word
        c = F.regexp_replace(c, "(?iu)" + any_of([w]), " ")
    for w in X.WEB_FILLERS:
        c = F.replace(c, F.lit(w), F.lit(" "))
    c = F.trim(F.regexp_replace(c, U + X.WEB_TRIM, " "))
    out = F.when(F.length(c) >= 3, c).otherwise(raw)
    for hit in reversed(quoted):
        out = F.when(hit != "", strip(hit)).otherwise(out)
    return out


# ---- tools --------------------------------------------------------------------


def tool_rule(q: Column) -> Column:
    s = F.coalesce(strip(q), F.lit(""))
    return F.when(s == "", "NO_TOOL").when(s.isin(*X.CLOCK_QUESTIONS), "get_current_time")


def tool_outcome(name: Column, args_ok: Column, raised: Column, payload: Column) -> Column:
    """Classify one call; ``payload`` is the JSON the tool returned, or null."""
    error = F.coalesce(F.get_json_object(payload, "$.error"), F.get_json_object(payload, "$[0].error"))
    return (
        F.when(~name.isin(*X.TOOLS), "unknown_tool")
        .when(~args_ok, "bad_args")
        .when(raised, "exec_error")
        .when(payload.isNull(), "empty")
        .when(F.coalesce(error, F.lit("")) != "", "exec_error")
        .when(F.regexp_replace(payload, r"\s", "") == "[]", "empty")
        .otherwise("ok")
    )


def retryable(status: Column, body: Column) -> Column:
    transient = (status == 429) | (status >= 500)
    return transient & ~F.contains(F.lower(F.coalesce(body, F.lit(""))), F.lit("location not found"))


# ---- maintenance -----------------------------------------------------------------


def stale_entries(cache: DataFrame, as_of_year: int, tier: str | None = None) -> DataFrame:
    """Cached rows today's rules would refuse. ``key`` holds the normalised
    question, with its namespace in front of ``::``."""
    q = F.when(F.contains("key", F.lit("::")), F.expr("substring(key, instr(key, '::') + 2)")).otherwise(F.col("key"))
    verdict = F.when(wants_web(F.col("_q")), "web_directive_key").otherwise(
        cache_tier(F.col("_q"), F.col("answer"), F.lit(0), as_of_year))
    d = once(once(cache, "_q", q), "stale_tier", verdict).drop("_q")
    d = d.where((F.col("stale_tier") == "web_directive_key") | F.startswith("stale_tier", F.lit("reject")))
    return d.where(F.col("stale_tier") == tier) if tier else d


def without_stale(cache: DataFrame, as_of_year: int, tier: str | None = None) -> DataFrame:
    return cache.join(stale_entries(cache, as_of_year, tier).select("key"), "key", "left_anti")


def refusal_kind(a: Column) -> Column:
    a = F.coalesce(a, F.lit(""))
    return F.when(partial_refusal(a), "partial").when(low_quality(a), "plain")
