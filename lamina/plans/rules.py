"""Queries over routing, admission, intent and slot rules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.functions import slots as S
from lamina.operators import admission as A
from lamina.functions.text import any_of, once
from lamina.plans.inputs import load, with_clause
from lamina.plans.registry import arr, lit, query, tup

YEAR = 1997  # reference year of the time rules for the given order dates

# ---- check SQL pieces ---------------------------------------------------------


def rx(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {lit(pattern)})"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def any_sql(c: str, words) -> str:
    return f"len(list_filter({arr(words)}, lambda w: contains({c}, w))) > 0"


def sql_time(q: str) -> str:
    return any_sql(f"lower({q})", (*X.TIME_CUES, *[str(YEAR + d) for d in (-1, 0, 1)]))


def sql_volatile(q: str) -> str:
    b0, b1 = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
    pats = [r"\d{4}\s*年", b0 + r"v?\d+\.\d+(\.\d+)?" + b1, r"第\s*\d+\s*[届次期代版]",
            r"\d+\s*(元|块|美元|万|亿|美金|USD|RMB)", r"排[名行]第?\s*\d+", b0 + r"20\d{2}" + b1]
    return "(" + " OR ".join(rx(q, p) for p in pats) + ")"


def sql_low(a: str) -> str:
    return f"({a} IS NULL OR {a} = '' OR {any_sql(f'lower(left({sql_strip(a)}, {X.LOW_QUALITY_HEAD}))', X.LOW_QUALITY_CUES)})"


def sql_partial(a: str) -> str:
    s = sql_strip(a)
    return (f"({a} IS NULL OR {a} = '' OR {any_sql(f'lower(right({s}, {X.PARTIAL_TAIL}))', X.PARTIAL_TAIL_CUES)}"
            f" OR {any_sql(f'lower(left({s}, {X.PARTIAL_HEAD}))', X.PARTIAL_HEAD_CUES)})")


def sql_tier(q: str, a: str, web: str) -> str:
    return (f"CASE WHEN {a} IS NULL OR length({sql_strip(a)}) < {X.MIN_ANSWER_LEN} THEN 'reject_too_short' "
            f"WHEN {sql_low(a)} THEN 'reject_low_quality' WHEN {sql_partial(a)} THEN 'reject_partial_refusal' "
            f"WHEN {sql_time(q)} THEN 'reject_time_sensitive' WHEN {web} > 0 THEN 'web_backed' "
            f"WHEN {sql_volatile(q)} THEN 'volatile' ELSE 'stable' END")


def sql_ttl(t: str) -> str:
    return f"CAST(CASE {t} WHEN 'web_backed' THEN {X.TTL_WEB} WHEN 'volatile' THEN {X.TTL_VOLATILE} WHEN 'stable' THEN {X.TTL_STABLE} END AS INTEGER)"


def sql_wants(q: str) -> str:
    raw = f"lower({sql_strip(q)})"
    norm = f"regexp_replace(lower({q}), {lit(X.WEB_NORM)}, '', 'g')"
    n = lambda ws: [re.sub(X.WEB_NORM, "", w.lower()) for w in ws]
    starts = f"len(list_filter({arr(X.WEB_INTERROGATIVE)}, lambda w: starts_with({raw}, w))) > 0"
    return (f"({raw} <> '' AND NOT ({starts}) AND ({any_sql(norm, n(X.WEB_STRONG))} OR "
            f"({any_sql(norm, n(X.WEB_CHANNEL))} AND {any_sql(norm, n(X.WEB_ACTION))})))")


# ---- routing ---------------------------------------------------------------------


@query("route_layers", with_clause("questions") + f"""
SELECT query_id, strategy, unnest(CASE strategy WHEN 'offline_only' THEN ['L2_wiki','L3_history','L5_kg'] WHEN 'web_only' THEN ['L4_web']
  ELSE CASE WHEN {sql_time('query')} THEN ['L2_wiki','L3_history','L5_kg','L4_web'] ELSE ['L2_wiki','L3_history','L5_kg'] END END) AS layer
FROM questions, (VALUES ('auto'), ('offline_only'), ('web_only')) s(strategy)""")
def route_layers(spark, sf):
    q = load(spark, sf, "questions")
    by = F.create_map(*[x for s in ("auto", "offline_only", "web_only")
                        for x in (F.lit(s), A.route_layers(F.col("query"), s, YEAR))])
    return q.select("query_id", F.explode(by).alias("strategy", "ls")).select(
        "query_id", "strategy", F.explode("ls").alias("layer"))


@query("time_sensitive", with_clause("questions") + f"SELECT query_id, {sql_time('query')} AS hit FROM questions")
def time_sensitive(spark, sf):
    return load(spark, sf, "questions").select("query_id", A.time_sensitive(F.col("query"), YEAR).alias("hit"))


@query("volatile_slot", with_clause("questions", "answers") + f"""
SELECT 'q' AS kind, query_id AS id, {sql_volatile('query')} AS hit FROM questions
UNION ALL SELECT 'd', doc_id, {sql_volatile('answer')} FROM answers""")
def volatile_slot(spark, sf):
    q = load(spark, sf, "questions").select(F.lit("q").alias("kind"), F.col("query_id").alias("id"), F.col("query").alias("x"))
    d = load(spark, sf, "answers").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.col("answer").alias("x"))
    return q.unionByName(d).select("kind", "id", A.volatile_slot(F.col("x")).alias("hit"))


@query("low_quality", with_clause("answers") + f"SELECT doc_id, {sql_low('answer')} AS hit FROM answers")
def low_quality(spark, sf):
    return load(spark, sf, "answers").select("doc_id", A.low_quality(F.col("answer")).alias("hit"))


@query("partial_refusal", with_clause("answers") + f"SELECT doc_id, {sql_partial('answer')} AS hit FROM answers")
def partial_refusal(spark, sf):
    return load(spark, sf, "answers").select("doc_id", A.partial_refusal(F.col("answer")).alias("hit"))


@query("cacheability", with_clause("turns", extra=f"g AS (SELECT turn_id, {sql_tier('query', 'answer', 'web_hits')} AS tier FROM turns)") +
       f"SELECT turn_id, tier, {sql_ttl('tier')} AS ttl, tier NOT LIKE 'reject%' AS cacheable FROM g")
def cacheability(spark, sf):
    return A.with_cacheability(load(spark, sf, "turns"), YEAR).select("turn_id", "tier", "ttl", "cacheable")


@query("hit_admissible", with_clause("turns") + f"SELECT turn_id, {sql_tier('query', 'answer', '0')} NOT LIKE 'reject%' AS admissible FROM turns")
def hit_admissible(spark, sf):
    return load(spark, sf, "turns").select(
        "turn_id", A.admissible(F.col("query"), F.col("answer"), YEAR).alias("admissible"))


@query("archive_targets", with_clause("turns", extra=f"g AS (SELECT *, {sql_tier('query', 'answer', 'web_hits')} AS tier FROM turns)") + """
SELECT turn_id, tier, tier NOT LIKE 'reject%' AND NOT forced AS to_l1,
  tier NOT IN ('reject_low_quality','reject_too_short','reject_partial_refusal') AS to_l3 FROM g""")
def archive_targets(spark, sf):
    return A.archive_targets(load(spark, sf, "turns"), YEAR).select("turn_id", "tier", "to_l1", "to_l3")


@query("web_intent", with_clause("questions") + f"SELECT query_id, {sql_wants('query')} AS wants FROM questions")
def web_intent(spark, sf):
    return load(spark, sf, "questions").select("query_id", A.wants_web(F.col("query")).alias("wants"))


def _directive_sql() -> str:
    c = sql_strip("query")
    for w in sorted(dict.fromkeys(X.WEB_STRONG + X.WEB_ACTION + X.WEB_CHANNEL), key=len, reverse=True):
        c = f"regexp_replace({c}, {lit(any_of([w]))}, ' ', 'gi')"
    for w in X.WEB_FILLERS:
        c = f"replace({c}, {lit(w)}, ' ')"
    return f"trim(regexp_replace({c}, {lit(X.WEB_TRIM)}, ' ', 'g'))"


@query("strip_directive", with_clause("questions", extra=f"""s AS (SELECT query_id, {sql_strip('query')} AS raw, {_directive_sql()} AS cleaned,
  regexp_extract(query, {lit('[“"' + chr(39) + ']([^”"' + chr(39) + ']{2,})[”"' + chr(39) + ']')}, 1) AS q1,
  regexp_extract(query, '「([^」]{{2,}})」', 1) AS q2 FROM questions)""") + """
SELECT query_id, CASE WHEN q1 <> '' THEN trim(q1) WHEN q2 <> '' THEN trim(q2) WHEN length(cleaned) >= 3 THEN cleaned ELSE raw END AS target FROM s""")
def strip_directive(spark, sf):
    return load(spark, sf, "questions").select("query_id", A.strip_directive(F.col("query")).alias("target"))


@query("tool_rule_route", with_clause("questions") + f"""
SELECT query_id, CASE WHEN trim(query) = '' THEN 'NO_TOOL' WHEN trim(query) IN {tup(X.CLOCK_QUESTIONS)} THEN 'get_current_time' END AS tool FROM questions""")
def tool_rule_route(spark, sf):
    return load(spark, sf, "questions").select("query_id", A.tool_rule(F.col("query")).alias("tool"))


# one call per event: the event type names the tool, the props are its payload
CALLS = """calls AS (SELECT event_id,
  CASE event_type WHEN 'signup' THEN 'search_arxiv' WHEN 'error' THEN 'fly_rocket' WHEN 'click' THEN 'get_weather'
    WHEN 'view' THEN 'get_repo_info' ELSE 'get_current_time' END AS tool,
  event_id % 11 <> 0 AS args_ok, event_id % 13 = 0 AS raised,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '[]' WHEN event_id % 7 = 2 THEN '{"error": "down"}'
    WHEN event_id % 7 = 3 THEN '[{"error": "bad"}]' ELSE props END AS payload,
  CASE WHEN event_id % 4 = 0 THEN 429 WHEN event_id % 4 = 1 THEN 500 WHEN event_id % 4 = 2 THEN 404 ELSE 200 END AS status,
  CASE WHEN event_id % 5 = 0 THEN 'Location not found: x' ELSE props END AS body FROM events)"""


def _calls(spark, sf):
    load(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql(f"WITH {CALLS} SELECT * FROM calls")


@query("tool_outcome", f"""WITH {CALLS} SELECT event_id, CASE WHEN tool NOT IN {tup(X.TOOLS)} THEN 'unknown_tool' WHEN NOT args_ok THEN 'bad_args'
  WHEN raised THEN 'exec_error' WHEN payload IS NULL THEN 'empty' WHEN payload LIKE '%"error"%' THEN 'exec_error'
  WHEN payload = '[]' THEN 'empty' ELSE 'ok' END AS kind FROM calls""")
def tool_outcome(spark, sf):
    return _calls(spark, sf).select(
        "event_id", A.tool_outcome(F.col("tool"), F.col("args_ok"), F.col("raised"), F.col("payload")).alias("kind"))


@query("retryable", f"""WITH {CALLS} SELECT event_id, (status = 429 OR status >= 500) AND body NOT ILIKE '%location not found%' AS retry FROM calls""")
def retryable(spark, sf):
    return _calls(spark, sf).select("event_id", A.retryable(F.col("status"), F.col("body")).alias("retry"))


# ---- slots ------------------------------------------------------------------------------


def _longest_sql(words) -> str:
    hit = f"list_filter({arr(words)}, lambda w: contains(lower(query), w))"
    return f"list_filter({hit}, lambda t: len(list_filter({hit}, lambda o: o <> t AND contains(o, t))) = 0)"


def _prefix_sql() -> str:
    # RE2 has no look-ahead: take the two characters and keep the first
    return (f"list_transform(regexp_extract_all(query, '[{X.ROLE_PREFIXES}][{X.ROLE_NOUNS}]'), lambda m: left(m, 1))")


SLOTS_SQL = "sl AS (SELECT query_id, query, " + ", ".join([
    "list_sort(list_distinct(list_concat(regexp_extract_all(query, '\\d+(?:\\.\\d+)?%?'), list_filter(list_concat("
    f"regexp_extract_all(query, '第\\s*([{X.CN_DIGITS}]{{1,6}})', 1), regexp_extract_all(query, '([{X.CN_DIGITS}]{{1,6}})\\s*(?:{X.CN_UNITS})', 1)), "
    f"lambda v: v NOT IN {tup(X.CN_VAGUE)})))) AS numbers",
    "list_sort(list_distinct(regexp_extract_all(query, '(?:19|20)\\d{2}'))) AS years",
    f"list_sort(list_distinct({_longest_sql(X.NEGATIONS)})) AS negations",
    f"list_sort(list_distinct({_longest_sql(X.COMPARATIVES)})) AS comparatives",
    f"list_sort(list_distinct(list_concat({_longest_sql(X.QUALIFIERS)}, {_prefix_sql()}))) AS qualifiers",
    "list_sort(list_filter([" + ", ".join(
        f"CASE WHEN {any_sql('lower(query)', v)} THEN {lit(k)} END" for k, v in X.FOCUS.items()) + "], lambda v: v IS NOT NULL)) AS focus",
    "list_sort(list_distinct(list_transform(regexp_extract_all(query, '[A-Za-z][A-Za-z0-9\\-\\.]{1,}'), lambda w: upper(w)))) AS entities",
]) + " FROM questions)"

_KEYS = ("numbers", "years", "negations", "comparatives", "qualifiers", "focus", "entities")


@query("query_slots", with_clause("questions", extra=SLOTS_SQL) + "SELECT query_id, " +
       ", ".join(f"array_to_string({k}, '|') AS {k}" for k in _KEYS) + " FROM sl")
def query_slots(spark, sf):
    q = load(spark, sf, "questions").select("query_id", S.slots(F.col("query")).alias("s"))
    return q.select("query_id", *[F.array_join(f"s.{k}", "|").alias(k) for k in _KEYS])


def _slot_pairs(spark, sf):
    """A question next to the following one of the same template, or of the one before."""
    q = load(spark, sf, "questions").select("query_id", S.slots(F.col("query")).alias("s"))
    shifts = F.explode(F.array(F.lit(36), F.lit(35), F.lit(0)))
    a = q.select(F.col("query_id").alias("id_a"), F.col("s").alias("a"), shifts.alias("gap"))
    b = q.select(F.col("query_id").alias("id_b"), F.col("s").alias("b"))
    return a.join(b, F.col("id_b") == F.col("id_a") + F.col("gap"))


_PAIR = "FROM (SELECT *, unnest([36, 35, 0]) AS gap FROM sl) a JOIN sl b ON b.query_id = a.query_id + a.gap"


@query("slot_gate", with_clause("questions", extra=SLOTS_SQL) + f"""
SELECT a.query_id AS id_a, b.query_id AS id_b, CASE WHEN a.numbers <> b.numbers THEN 'numbers' WHEN a.years <> b.years THEN 'years'
  WHEN a.negations <> b.negations THEN 'negations' WHEN a.comparatives <> b.comparatives THEN 'comparatives'
  WHEN a.qualifiers <> b.qualifiers THEN 'qualifiers'
  WHEN NOT (CASE WHEN len(a.focus) = 0 AND len(b.focus) = 0 THEN true
     WHEN len(a.focus) = 0 OR len(b.focus) = 0 THEN list_has_all(['WHO','WHICH'], list_concat(a.focus, b.focus))
     ELSE list_has_any(a.focus, b.focus) OR list_has_all(['WHO','WHICH'], list_concat(a.focus, b.focus)) END) THEN 'focus'
  WHEN a.entities <> b.entities THEN 'entities' END AS blocked_by {_PAIR}""")
def slot_gate(spark, sf):
    return _slot_pairs(spark, sf).select("id_a", "id_b", S.gate(F.col("a"), F.col("b")).alias("blocked_by"))


@query("slot_setops", with_clause("questions", extra=SLOTS_SQL) + f"""
SELECT a.query_id AS id_a, b.query_id AS id_b, CAST(len(list_intersect(a.entities, b.entities)) AS INTEGER) AS shared,
  CAST(len(list_distinct(list_concat(a.entities, b.entities))) AS INTEGER) AS either,
  array_to_string(list_sort(list_filter(a.entities, lambda v: NOT list_contains(b.entities, v))), '|') AS only_a,
  list_has_all(b.entities, a.entities) AS subset {_PAIR}""")
def slot_setops(spark, sf):
    a, b = F.col("a.entities"), F.col("b.entities")
    return _slot_pairs(spark, sf).select(
        "id_a", "id_b", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_union(a, b)).alias("either"),
        F.array_join(F.array_sort(F.array_except(a, b)), "|").alias("only_a"),
        (F.size(F.array_except(a, b)) == 0).alias("subset"))


# ---- maintenance ----------------------------------------------------------------------------

CACHE_SQL = "cache AS (SELECT coalesce(namespace || '::', '') || query || '#' || CAST(turn_id AS STRING) AS key, answer FROM turns)"


def cache_rows(spark, sf):
    return load(spark, sf, "turns").select(
        F.concat(F.coalesce(F.concat("namespace", F.lit("::")), F.lit("")), "query", F.lit("#"),
                 F.col("turn_id").cast("string")).alias("key"), "answer")


@query("purge_stale", with_clause("turns", extra=CACHE_SQL + f""", k AS (SELECT *, CASE WHEN contains(key, '::') THEN substring(key, instr(key, '::') + 2) ELSE key END AS q FROM cache),
 v AS (SELECT key, CASE WHEN {sql_wants('q')} THEN 'web_directive_key' ELSE {sql_tier('q', 'answer', '0')} END AS stale_tier FROM k)""") +
       "SELECT key, stale_tier FROM v WHERE stale_tier = 'web_directive_key' OR stale_tier LIKE 'reject%'")
def purge_stale(spark, sf):
    return A.stale_entries(cache_rows(spark, sf), YEAR).select("key", "stale_tier")


@query("clean_refusals", with_clause("answers") + f"""
SELECT doc_id, CAST(length(answer) AS BIGINT) AS len FROM answers WHERE NOT ({sql_low('answer')} OR {sql_partial('answer')})""")
def clean_refusals(spark, sf):
    d = once(load(spark, sf, "answers").select("doc_id", "answer"), "kind", A.refusal_kind(F.col("answer")))
    return d.where(F.col("kind").isNull()).select("doc_id", F.length("answer").cast("long").alias("len"))
