"""Queries over corpus build, caches, sessions, reports, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.functions import vectors as VF
from lamina.operators import admission as A
from lamina.operators import cache as CA
from lamina.operators import corpus as C
from lamina.operators import coverage as V
from lamina.operators import diversify as D
from lamina.operators import entities as EN
from lamina.operators import fusion as U
from lamina.operators import reports as RP
from lamina.operators import sessions as SE
from lamina.operators import vectors as VS
from lamina.operators.ranking import ranked, top_k
from lamina.plans import graph as G
from lamina.plans import retrieval as R
from lamina.plans.inputs import load, with_clause
from lamina.plans.registry import lit, query
from lamina.plans.rules import SLOTS_SQL, YEAR, sql_tier, sql_ttl
from lamina.plans.texts import qa_norm, sql_norm
from lamina.session import cut
from lamina.sources import readers, sinks
from lamina.streaming import archive as AR
from lamina.streaming import hold_back as HB

# ---- corpus ------------------------------------------------------------------------


@query("hour_range", """SELECT CAST(h AS TIMESTAMP) AS hour, 'pageviews-' || strftime(h, '%Y%m%d-%H') || '0000.gz' AS file FROM
 (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS h FROM events)""")
def hour_range(spark, sf):
    span = load(spark, sf, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))  # one row
    h = span.select(F.explode(F.sequence(F.date_trunc("day", "a").cast("timestamp_ntz"), F.date_trunc("day", "b").cast("timestamp_ntz") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return h.select("hour", F.concat(F.lit("pageviews-"), F.date_format("hour", "yyyyMMdd-HH"), F.lit("0000.gz")).alias("file"))


VIEWS = """vw AS (SELECT replace(string_split(line, ' ')[2], '_', ' ') AS title, TRY_CAST(string_split(line, ' ')[3] AS BIGINT) AS v FROM view_lines WHERE len(string_split(line, ' ')) >= 3 AND string_split(line, ' ')[1] = 'zh')"""


@query("pageviews_agg", with_clause("view_lines", extra=VIEWS) + "SELECT title, CAST(sum(v) AS BIGINT) AS views FROM vw WHERE v IS NOT NULL GROUP BY title")
def pageviews_agg(spark, sf):
    """The hourly files: gzip, one split each."""
    path = sinks.scratch_table(spark, "views")
    sinks.write_lines(load(spark, sf, "view_lines"), path, "gzip")
    return C.total_views(readers.page_views(spark, path))


@query("json_props_scan", """SELECT event_id, CASE WHEN event_id % 19 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events WHERE event_id % 19 <> 0""")
def json_props_scan(spark, sf):
    """JSON lines in files, every 19th of them broken."""
    whole = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(", "), F.expr("substring(props, 2)"))
    path = sinks.scratch_table(spark, "props")
    sinks.write_lines(load(spark, sf, "events").select(F.when(F.col("event_id") % 19 == 0, F.lit("{broken")).otherwise(whole).alias("line")), path)
    return readers.json_lines(spark, path, "event_id long, k int")


@query("title_rank", with_clause("titles", extra=G.RANK) + "SELECT title, norm, views, rank FROM ranks")
def title_rank(spark, sf):
    return G.ranks(spark, sf)


def art_sql(top: int | None = None) -> str:
    return f"""{G.RANK}, sel AS (SELECT a.doc_id, a.title, a.text, r.rank FROM articles a JOIN ranks r USING (title) WHERE length(a.text) >= 200{'' if top is None else f' AND r.rank < {top}'}),
 art AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY length(text) DESC, doc_id) AS d FROM sel) WHERE d = 1)"""


def articles(spark, sf, top=None):
    r = C.title_rank(load(spark, sf, "titles"), F.lower, top)
    return C.select_articles(load(spark, sf, "articles"), r)


@query("topn_articles", with_clause("titles", "articles", extra=art_sql(X.TOP_ARTICLES)) + "SELECT rank, doc_id, title, CAST(length(text) AS INTEGER) AS n FROM art")
def topn_articles(spark, sf):
    return articles(spark, sf, X.TOP_ARTICLES).select("rank", "doc_id", "title", F.length("text").alias("n"))


@query("dedup_longest", "SELECT source, lang, doc_id, n FROM (SELECT source, lang, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) AS d FROM documents) WHERE d = 1")
def dedup_longest(spark, sf):
    d = load(spark, sf, "documents").withColumn("k", F.struct("source", "lang")).select("k", "doc_id", "text")
    return C.longest_per_key(d, "k", "text", "doc_id").select("k.source", "k.lang", "doc_id", F.length("text").cast("long").alias("n"))


CHO = """cf AS (SELECT rank, doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: length(p) >= 10), chr(10)) AS f FROM art),
 cn AS (SELECT *, unnest(range(0, CASE WHEN length(f) <= 512 THEN 1 ELSE CAST(ceil((length(f) - 512) / 448.0) AS BIGINT) + 1 END)) AS i FROM cf WHERE f <> '')"""


@query("chunk_order", with_clause("titles", "articles", extra=art_sql() + ", " + CHO) + "SELECT doc_id || '_' || i AS chunk_id, row_number() OVER (ORDER BY rank, i) - 1 AS ord FROM cn")
def chunk_order(spark, sf):
    a = articles(spark, sf)
    ch = C.chunks(a.select("doc_id", "text")).select("doc_id", "chunk_idx", "chunk_id").join(a.select("doc_id", "rank"), "doc_id")
    return ranked(ch.select("rank", "chunk_idx", "chunk_id"), [F.asc("rank"), F.asc("chunk_idx")], "ord", start=0).select("chunk_id", "ord")


@query("line_ranges", """SELECT doc_id, line, CAST(line // CAST(ceil((SELECT count(*) FROM documents) / 8.0) AS BIGINT) AS INTEGER) AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents)""")
def line_ranges(spark, sf):
    return C.line_ranges(load(spark, sf, "documents").select("doc_id"), [F.asc("doc_id")], 8)


@query("eval_cases_filter", f"""SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS level FROM documents WHERE doc_id % 4 IN (1, 2, 3) AND doc_id % 11 <> 0 AND NOT regexp_matches(text, {lit('(?i)' + X.FILE_HINT)})""")
def eval_cases_filter(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % 4).cast("int").alias("level"),
                                            F.when(F.col("doc_id") % 11 == 0, "a.xlsx").otherwise("").alias("file_name"))
    return d.where(F.col("level").isin(1, 2, 3) & (F.trim("file_name") == "") & ~F.col("text").rlike("(?i)" + X.FILE_HINT)).select("doc_id", "level")


# ---- cache ------------------------------------------------------------------------------------

NOW = 1704067200 + 900 * 60
ENTRY = f"""g AS (SELECT *, {sql_tier('query', 'answer', 'web_hits')} AS tier, {sql_norm('query')} AS nq FROM turns),
 ent0 AS (SELECT turn_id AS seq, coalesce(namespace || '::', '') || nq AS key, nq AS gkey, namespace, query, answer, write_ts, {sql_ttl('tier')} AS ttl FROM g WHERE tier NOT LIKE 'reject%'),
 lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY write_ts DESC, seq) AS d FROM ent0 WHERE write_ts <= {NOW}) WHERE d = 1 AND {NOW} < write_ts + ttl),
 asks AS (SELECT turn_id AS ask_id, coalesce(namespace || '::', '') || nq AS key, nq AS gkey, query, namespace FROM g)"""


def entries(spark, sf):
    d = A.with_cacheability(load(spark, sf, "turns"), YEAR).where("cacheable").withColumn("gkey", qa_norm(F.col("query")))
    key = F.concat(F.coalesce(F.concat("namespace", F.lit("::")), F.lit("")), "gkey")
    return d.select(F.col("turn_id").alias("seq"), key.alias("key"), "gkey", "namespace", "query", "answer", "write_ts", "ttl")


def asks(spark, sf):
    d = load(spark, sf, "turns").withColumn("global_key", qa_norm(F.col("query")))
    return d.select(F.col("turn_id").alias("ask_id"), F.concat(F.coalesce(F.concat("namespace", F.lit("::")), F.lit("")), "global_key").alias("key"), "global_key", "query", "namespace")


@query("cache_exact", with_clause("turns", extra=ENTRY) + "SELECT ask_id, lat.seq AS entry FROM asks LEFT JOIN lat USING (key)")
def cache_exact(spark, sf):
    return CA.exact(asks(spark, sf), entries(spark, sf), NOW).select("ask_id", "entry")


@query("l1_lookup", with_clause("turns", extra=ENTRY + f""", lk AS (SELECT a.ask_id, a.query, coalesce(o.answer, w.answer) AS answer, coalesce(o.seq, w.seq) AS entry
  FROM asks a LEFT JOIN lat o ON o.key = a.key LEFT JOIN lat w ON w.key = a.gkey)""") + f"SELECT ask_id, entry FROM lk WHERE answer IS NOT NULL AND {sql_tier('query', 'answer', '0')} NOT LIKE 'reject%'")
def l1_lookup(spark, sf):
    d = CA.with_fallback(asks(spark, sf), entries(spark, sf), NOW).where(F.col("answer").isNotNull())
    return d.where(A.admissible(F.col("query"), F.col("answer"), YEAR)).select("ask_id", "entry")


FUZ = f"""{ENTRY}, ve AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 en AS (SELECT e.*, ve.v FROM (SELECT *, seq % (SELECT count(*) FROM embeddings) AS vec_id FROM ent0) e JOIN ve USING (vec_id)),
 qs AS (SELECT t.turn_id AS query_id, t.query, t.namespace, ve.v FROM turns t JOIN ve ON ve.vec_id = t.turn_id % (SELECT count(*) FROM embeddings)),
 sc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM (SELECT q.query_id, q.query AS q1, q.namespace AS n1, e.seq, e.query AS q2, e.namespace AS n2,
   e.write_ts, e.ttl, round(list_dot_product(q.v, e.v), 6) AS score FROM qs q, en e)),
 questions_ AS (SELECT DISTINCT query FROM turns), {SLOTS_SQL.replace('FROM questions)', 'FROM (SELECT query AS query_id, query FROM questions_))')},
 okf AS (SELECT s.* FROM sc s JOIN sl a ON a.query = s.q1 JOIN sl b ON b.query = s.q2 WHERE rank <= 10 AND score >= 0.3 AND n1 IS NOT DISTINCT FROM n2 AND write_ts <= {NOW} AND {NOW} < write_ts + ttl
   AND a.numbers = b.numbers AND a.years = b.years AND a.negations = b.negations AND a.comparatives = b.comparatives AND a.qualifiers = b.qualifiers AND a.entities = b.entities
   AND CASE WHEN len(a.focus) = 0 AND len(b.focus) = 0 THEN true ELSE list_has_any(a.focus, b.focus) OR list_has_all(['WHO','WHICH'], list_concat(a.focus, b.focus)) END)"""


@query("cache_fuzzy", with_clause("turns", extra=FUZ) + "SELECT query_id, arg_min(seq, rank) AS id, arg_min(score, rank) AS score FROM okf GROUP BY query_id")
def cache_fuzzy(spark, sf):
    """Questions and entries have the vectors of their numbers; each vector is searched once, and its questions share what was found."""
    e = load(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.count(F.lit(1)).alias("n_vec"))  # one row
    en = entries(spark, sf).join(F.broadcast(n)).withColumn("vec_id", F.col("seq") % F.col("n_vec"))
    en = cut(en.select("vec_id", F.col("seq").alias("id"), "query", "namespace", "answer", "write_ts", "ttl"))
    q = load(spark, sf, "turns").join(F.broadcast(n)).withColumn("vec_id", F.col("turn_id") % F.col("n_vec")).select("vec_id", F.col("turn_id").alias("query_id"), "query", "namespace")
    hits = CA.nearest_shared(q.select("query_id", "vec_id"), en.select("id", "vec_id"), e, X.FUZZY_CANDIDATES)
    return CA.fuzzy(q, en, NOW, threshold=0.3, hits=hits).select("query_id", "id", "score")


UPS = """b AS (SELECT turn_id, 'k' || turn_id AS key, answer FROM turns), c AS (SELECT 'k' || turn_id AS key, 'v2 ' || answer FROM turns WHERE turn_id % 4 = 0
  UNION ALL SELECT 'new' || turn_id, answer FROM turns WHERE turn_id % 10 = 1), d AS (SELECT 'k' || turn_id AS key FROM turns WHERE turn_id % 7 = 0)"""


@query("cache_upsert", with_clause("turns", extra=UPS) + """
SELECT key, md5(answer) AS h FROM (SELECT key, answer FROM b WHERE key NOT IN (SELECT key FROM c) UNION ALL SELECT * FROM c) WHERE key NOT IN (SELECT key FROM d)""")
def cache_upsert(spark, sf):
    t = load(spark, sf, "turns").withColumn("key", F.concat(F.lit("k"), F.col("turn_id").cast("string")))
    ch = t.where("turn_id % 4 = 0").select("key", F.concat(F.lit("v2 "), "answer").alias("answer")).unionByName(
        t.where("turn_id % 10 = 1").select(F.concat(F.lit("new"), F.col("turn_id").cast("string")).alias("key"), "answer"))
    return CA.upsert(t.select("key", "answer"), ch, t.where("turn_id % 7 = 0")).select("key", F.md5(F.col("answer").cast("binary")).alias("h"))


@query("cache_multilevel_read", with_clause("turns") + """
SELECT turn_id, CASE WHEN turn_id % 3 = 0 THEN 'mem' WHEN turn_id % 2 = 0 THEN 'disk' WHEN turn_id % 5 = 0 THEN 'redis' END AS layer,
  CAST(CASE WHEN turn_id % 3 = 0 THEN 0 WHEN turn_id % 2 = 0 THEN 1 WHEN turn_id % 5 = 0 THEN 2 ELSE 0 END AS INTEGER) AS backfill FROM turns""")
def cache_multilevel_read(spark, sf):
    t = load(spark, sf, "turns").select("turn_id", F.col("turn_id").cast("string").alias("key"), "answer")
    layers = [(n, t.where(f"turn_id % {m} = 0").select("key", "answer")) for n, m in (("mem", 3), ("disk", 2), ("redis", 5))]
    return CA.read_through(t.select("turn_id", "key"), layers).select("turn_id", "layer", "backfill")


@query("backfill_ttl", with_clause("turns", extra=ENTRY) + f"SELECT seq, CASE WHEN write_ts + ttl - {NOW} > 0 THEN CAST(write_ts + ttl - {NOW} AS BIGINT) ELSE 300 END AS ttl FROM ent0")
def backfill_ttl(spark, sf):
    return entries(spark, sf).select("seq", CA.backfill_ttl(F.col("write_ts") + F.col("ttl") - NOW).alias("ttl"))


@query("cache_stats", """WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS e, count(*) FILTER (WHERE event_type = 'click') AS f, count(*) FILTER (WHERE event_type = 'purchase') AS m,
  count(*) FILTER (WHERE event_type = 'error') AS r FROM events GROUP BY user_id)
SELECT user_id, e AS exact, f AS fuzzy, m AS misses, r AS rejects, round(CASE WHEN e + f + m > 0 THEN (e + f) / CAST(e + f + m AS DOUBLE) ELSE 0 END, 4) AS hit_rate,
  round(CASE WHEN e + f > 0 THEN f / CAST(e + f AS DOUBLE) ELSE 0 END, 4) AS fuzzy_rate, round(CASE WHEN r + f > 0 THEN r / CAST(r + f AS DOUBLE) ELSE 0 END, 4) AS reject_rate FROM s""")
def cache_stats(spark, sf):
    kind = F.create_map(*[F.lit(x) for x in ("view", "exact", "click", "fuzzy", "purchase", "miss", "error", "gate_reject", "signup", "write")])
    return CA.stats(load(spark, sf, "events").withColumn("outcome", kind[F.col("event_type")]), ["user_id"])


PROV = """pv AS (SELECT user_id * 100 + CAST(day(ts) AS BIGINT) AS query_id, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS prio FROM events)"""


@query("provider_fallback", f"WITH {PROV} SELECT p.query_id, event_id, prio FROM pv p JOIN (SELECT query_id, min(prio) AS b FROM pv GROUP BY 1) m ON m.query_id = p.query_id AND m.b = p.prio")
def provider_fallback(spark, sf):
    load(spark, sf, "events").createOrReplaceTempView("events")
    return CA.first_provider(spark.sql(f"WITH {PROV} SELECT query_id, event_id, prio FROM pv"), "query_id", "prio")


@query("format_results", with_clause("web_log", extra="pt AS (SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages)") + """
SELECT query_id, string_agg('[' || (pos + 1) || '] ' || title || chr(10) || 'URL: ' || url || chr(10) || '摘要: ' || title, chr(10) || chr(10) ORDER BY pos) AS text FROM web_log JOIN pt USING (page_id) GROUP BY query_id""")
def format_results(spark, sf):
    w = R.web_list(spark, sf)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit("\nURL: "), "url", F.lit("\n摘要: "), "text")
    g = w.select("query_id", "rank", line.alias("line")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return g.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("text"))


@query("slim_sources")
def slim_sources(spark, sf):
    p = R.three_lists(spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("list_no", "rank", "title", "url", "layer", "score", "text"))).alias("sources"))
    slim = F.transform("sources", lambda s: F.struct(s["title"].alias("title"), s["url"].alias("url"), s["layer"].alias("layer"), s["score"].alias("score")))
    return p.select("query_id", F.to_json(slim).alias("sources"))


@query("history_record", with_clause("turns") + "SELECT turn_id, left(query || chr(10) || answer, 2000) AS record FROM turns")
def history_record(spark, sf):
    return AR.history_record(load(spark, sf, "turns")).select("turn_id", "record")


# ---- sessions --------------------------------------------------------------------------------------


@query("qa_pairs", with_clause("pairs") + "SELECT conv_id, turn, query, answer FROM pairs")
def qa_pairs(spark, sf):
    return SE.qa_pairs(load(spark, sf, "conversations"))


@query("memory_window", "SELECT conv_id, turn, CAST(back AS INTEGER) AS back FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4")
def memory_window(spark, sf):
    return SE.memory_window(load(spark, sf, "conversations"), 2).select("conv_id", "turn", "back")


@query("recent_summary", """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS summary FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6 GROUP BY conv_id""")
def recent_summary(spark, sf):
    return SE.recent_summary(load(spark, sf, "conversations"))


@query("session_evict", "SELECT user_id, min(ts) AS first_seen FROM events GROUP BY user_id ORDER BY first_seen DESC, user_id DESC LIMIT 100")
def session_evict(spark, sf):
    return SE.surviving_sessions(load(spark, sf, "events"), "user_id", "ts", 100)


@query("step_elapsed", """SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000.0) AS BIGINT) AS elapsed_ms FROM events""")
def step_elapsed(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_id", "ts")
    return SE.step_elapsed(e, "user_id", [F.asc("ts"), F.asc("event_id")], "ts").select("event_id", F.col("elapsed_ms").cast("long").alias("elapsed_ms"))


# ---- reports -------------------------------------------------------------------------------------------


@query("eval_report", with_clause("trace") + """SELECT arm, src, level, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, round(count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE), 4) AS accuracy,
  count(*) FILTER (WHERE timeout) AS timeouts, round(avg(ms), 4) AS mean_ms, max(ms) AS max_ms, round(avg(hops), 4) AS hops, round(avg(calls), 4) AS calls, median(ms) AS median,
  list_sort(list(ms))[least(CAST(floor(count(*) * 0.9) AS BIGINT), count(*) - 1) + 1] AS p90 FROM trace GROUP BY arm, src, level""")
def eval_report(spark, sf):
    return RP.eval_report(load(spark, sf, "trace"), ["arm", "src", "level"])


@query("eval_rollup", with_clause("trace") + """SELECT arm, src, level, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, round(count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE), 4) AS accuracy
FROM trace GROUP BY GROUPING SETS ((arm), (arm, src), (arm, src, level))""")
def eval_rollup(spark, sf):
    return RP.eval_rollup(load(spark, sf, "trace"))


@query("eval_fixed_broke", with_clause("trace", extra="""o AS (SELECT cid, arm, arg_min(ok, event_id) AS ok FROM trace GROUP BY 1, 2)""") + """
SELECT a.cid, a.arm, CASE WHEN a.ok THEN 'fixed' ELSE 'broke' END AS change FROM o a LEFT JOIN o b ON b.cid = a.cid AND b.arm = 'view' WHERE a.arm <> 'view' AND a.ok <> coalesce(b.ok, false)""")
def eval_fixed_broke(spark, sf):
    return RP.fixed_and_broken(load(spark, sf, "trace"), "view")


@query("regression_diff", """WITH f AS (SELECT DISTINCT user_id * 100 + CAST(day(ts) AS BIGINT) AS case_id, event_type AS run FROM events WHERE value > 60)
SELECT coalesce(a.case_id, b.case_id) AS case_id, CASE WHEN a.case_id IS NULL THEN 'new' ELSE 'gone' END AS change FROM (SELECT case_id FROM f WHERE run = 'view') a
FULL JOIN (SELECT case_id FROM f WHERE run = 'click') b ON a.case_id = b.case_id WHERE a.case_id IS NULL OR b.case_id IS NULL""")
def regression_diff(spark, sf):
    """Cases that fail (a value above 60) in one run and not in the other."""
    f = load(spark, sf, "events").where(F.col("value") > 60).select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("case_id"), F.col("event_type").alias("run"))
    return RP.failed_diff(f.where("run = 'view'").select("case_id"), f.where("run = 'click'").select("case_id"))


RUNS = """rl AS (SELECT user_id, CASE WHEN event_id % 9 = 0 THEN concat('collected ', event_type) ELSE concat(repeat('.', CAST(event_id % 6 AS INT)), CASE WHEN event_id % 4 = 0 THEN 'F' WHEN event_id % 5 = 0 THEN 'Es' ELSE '.x' END, ' [ ', CAST(event_id % 100 AS STRING), '%]') END AS line FROM events)"""


@query("pass_rate", f"WITH {RUNS}" + r""", c AS (SELECT user_id, regexp_extract(line, '^([.FEsxX]+)\s+\[\s*\d+%\]', 1) AS ch FROM rl),
 n AS (SELECT user_id, CAST(sum(length(ch) - length(replace(ch, '.', ''))) AS BIGINT) AS passed, CAST(sum(length(ch) - length(replace(ch, 'F', ''))) AS BIGINT) AS failed, CAST(sum(length(ch) - length(replace(ch, 'E', ''))) AS BIGINT) AS error,
   CAST(sum(length(ch) - length(replace(ch, 's', ''))) AS BIGINT) AS skipped, CAST(sum(length(ch) - length(replace(replace(ch, 'x', ''), 'X', ''))) AS BIGINT) AS xfail FROM c GROUP BY user_id)
SELECT *, round(CASE WHEN passed + failed + error > 0 THEN passed / CAST(passed + failed + error AS DOUBLE) END, 4) AS pass_rate FROM n""")
def pass_rate(spark, sf):
    load(spark, sf, "events").createOrReplaceTempView("events")
    return RP.progress_counts(spark.sql(f"WITH {RUNS} SELECT * FROM rl"), ["user_id"])


HEALTH = {"documents": "doc_id", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "embeddings": "vec_id", "pages": "page_id"}


@query("table_health", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, min({k}) AS min_key, max({k}) AS max_key, count(*) FILTER (WHERE {k} IS NULL) AS null_keys FROM {t}" for t, k in HEALTH.items()))
def table_health(spark, sf):
    return RP.table_health({t: (load(spark, sf, t), k) for t, k in HEALTH.items()})


# ---- expansion -------------------------------------------------------------------------------------------------

_E8 = R.EMB8
SUBQ = f"""{R.ENT}, sq AS (SELECT e.query_id, i, es[i] || ' ' || q.query AS sub FROM (SELECT query_id, list_filter(entities, lambda e: e <> '') AS es, unnest(range(1, len(list_filter(entities, lambda e: e <> '')) + 1)) AS i FROM ent) e
   JOIN rq q USING (query_id) WHERE len(es) >= 2),
 cfd AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: length(p) >= 1), chr(10)) AS f FROM documents),
 cnd AS (SELECT doc_id, f, unnest(range(0, CASE WHEN length(f) <= 512 THEN 1 ELSE CAST(ceil((length(f) - 512) / 448.0) AS BIGINT) + 1 END)) AS c FROM cfd WHERE f <> ''),
 dv AS (SELECT doc_id, {_E8.format(t='chunk')} AS v FROM (SELECT doc_id, substring(f, c * 448 + 1, 512) AS chunk FROM cnd)), sv AS (SELECT *, {_E8.format(t='sub')} AS v FROM sq),
 dn AS (SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM dv), sn AS (SELECT query_id, i, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM sv),
 sh AS (SELECT r.*, d.text FROM (SELECT *, row_number() OVER (PARTITION BY query_id, i ORDER BY score DESC, doc_id) AS rank FROM
   (SELECT s.query_id, s.i, d.doc_id, max(round(list_dot_product(s.v, d.v), 6)) AS score FROM sn s, dn d GROUP BY ALL)) r JOIN documents d USING (doc_id) WHERE rank <= 3)"""


def chunk_vectors(docs):
    """A vector of every chunk of ``docs`` (doc_id, text), short paragraphs included, under the document's id."""
    return C.chunks(docs, min_para=1).select(F.col("doc_id").alias("id"), VF.hash_embed8(F.col("chunk")).alias("cv"))


def chunk_hits(vectors, subs):
    """``subs`` (sid, sub): the three documents with the nearest chunks to each sub-question."""
    q = subs.select(F.col("sid").alias("query_id"), VF.hash_embed8(F.col("sub")).alias("qv"))
    return VS.exact_topk(q, vectors, 3, best_per_id=True)


@query("subquery_expand", with_clause("rq", extra=SUBQ) + "SELECT query_id, min(i * 10 + rank) AS first, arg_min(doc_id, i * 10 + rank) AS doc_id FROM sh GROUP BY query_id, left(text, 120)")
def subquery_expand(spark, sf):
    e = R.ents(spark, sf).withColumn("es", F.filter("entities", lambda x: x != "")).where(F.size("es") >= 2)
    s = e.join(load(spark, sf, "rq").select("query_id", "query"), "query_id").select("query_id", "query", F.posexplode("es").alias("p", "e"))
    s = s.select((F.col("query_id") * 10 + F.col("p") + 1).alias("sid"), F.concat("e", F.lit(" "), "query").alias("sub"))
    vectors = chunk_vectors(load(spark, sf, "documents").select("doc_id", "text"))
    h = chunk_hits(vectors, s).join(load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 120).alias("k")), "id")
    order = (F.col("query_id") % 10) * 10 + F.col("rank")
    g = h.groupBy(F.floor(F.col("query_id") / 10).alias("query_id"), "k").agg(F.min(order).alias("first"), F.min_by("id", order).alias("doc_id"))
    return g.select("query_id", F.col("first").cast("long").alias("first"), "doc_id")


@query("iterative_retrieve")
def iterative_retrieve(spark, sf):
    """Search again for what the evidence lacks, at most three hops; the
    missing terms stand in for a planner's next question."""
    q = load(spark, sf, "rq").select("query_id", "query")
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("ref"), F.col("source").alias("title"), "text")
    open_q = q.select(F.col("query_id").alias("sid"), F.col("query").alias("sub"))
    vectors = cut(chunk_vectors(load(spark, sf, "documents").select("doc_id", "text")))
    found = None
    for hop in range(1, 4):
        h = chunk_hits(vectors, open_q).select("query_id", F.lit(hop).alias("hop"), "rank", "id")
        found = cut(h if found is None else found.unionByName(h.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")))
        ev = found.select("query_id", (F.col("hop") * 10 + F.col("rank")).alias("pos"), F.col("id").alias("ref"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"))
        cov = V.term_coverage(q, ev, docs).where(V.insufficient(F.col("coverage")))
        open_q = cut(cov.where(F.size("missing") > 0).select(F.col("query_id").alias("sid"), F.array_join("missing", " ").alias("sub")))
    return found


@query("parallel_entities")
def parallel_entities(spark, sf):
    q = load(spark, sf, "questions").select("query_id", "query")
    words = F.regexp_extract_all("query", F.lit(r"[A-Za-z_0-9#]+|分别|[和与、]|."), F.lit(0))
    toks = F.transform(words, lambda w: F.struct(w.alias("word"), F.when(w.rlike("^[A-Z]"), "eng").otherwise("x").alias("pos")))
    return q.select("query_id", EN.parallel_entities(F.col("query"), toks).alias("e")).where(F.size("e") > 0).select("query_id", F.array_join("e", "|").alias("entities"))


DIV = f"""f18 AS (SELECT * FROM fr WHERE pos <= 18), w4 AS (SELECT query_id, pos, rrf, url, {_E8.format(t="left(title || ' ' || text, 512)")} AS v FROM f18 WHERE layer = 'L4_web'),
 p4 AS (SELECT query_id, list({{'pos': pos, 's': rrf, 'v': list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), 'd': regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '')}} ORDER BY pos) AS p FROM w4 GROUP BY query_id),
 m4 AS (SELECT query_id, p, list_transform(p, lambda a: list_transform(p, lambda b: round(list_dot_product(a.v, b.v), 9))) AS m FROM p4),
 k4(query_id, p, m, i, kept) AS (SELECT query_id, p, m, 1, [1] FROM m4 UNION ALL SELECT query_id, p, m, i + 1, CASE WHEN len(list_filter(kept, lambda j: m[i + 1][j] >= CASE WHEN p[i + 1].d <> '' AND p[i + 1].d = p[j].d THEN 0.93 ELSE 0.95 END)) > 0 THEN kept ELSE list_append(kept, i + 1) END FROM k4 WHERE i < len(p)),
 r4 AS (SELECT query_id, p, m, kept, list_transform(kept, lambda j: p[j].s) AS ss FROM k4 WHERE i = len(p)),
 rl AS (SELECT query_id, p, m, kept, list_transform(ss, lambda s: CASE WHEN list_max(ss) - list_min(ss) < 1e-9 THEN 1.0::DOUBLE ELSE (s - list_min(ss)) / (list_max(ss) - list_min(ss)) END) AS rel FROM r4),
 o4(query_id, p, m, kept, rel, ch) AS (SELECT query_id, p, m, kept, rel, [list_position(rel, list_max(rel))] FROM rl UNION ALL SELECT query_id, p, m, kept, rel, list_append(ch, -list_max(list_transform(list_filter(CAST(range(1, len(kept) + 1) AS INTEGER[]), lambda i: NOT list_contains(ch, i)),
    lambda i: {{'s': round(0.7::DOUBLE * rel[i] - 0.3::DOUBLE * list_max(list_transform(ch, lambda j: m[kept[i]][kept[j]])), 9), 'n': -i}})).n) FROM o4 WHERE len(ch) < len(kept)),
 mv AS (SELECT query_id, unnest(list_transform(range(1, len(ch) + 1), lambda t: p[t].pos)) AS slot, unnest(list_transform(ch, lambda j: p[kept[j]].pos)) AS pos FROM o4 WHERE len(ch) = len(kept)),
 al AS (SELECT mv.query_id, mv.slot, f.id, f.layer FROM mv JOIN f18 f ON f.query_id = mv.query_id AND f.pos = mv.pos UNION ALL SELECT query_id, pos, id, layer FROM f18 WHERE layer <> 'L4_web')"""


@query("diversify_slots", with_clause(*R.NAMES, extra=R.PASS + ", " + DIV) + "SELECT query_id, CAST(pos AS INTEGER) AS pos, id, layer FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY slot) AS pos FROM al) WHERE pos <= 12")
def diversify_slots(spark, sf):
    f = U.rrf_top(R.three_lists(spark, sf), X.FUSED_K * X.CANDIDATE_MULTIPLIER)
    f = f.withColumn("embedding", VF.hash_embed8(F.substring(F.concat_ws(" ", "title", "text"), 1, 512)))
    return D.diversify(f, 12).select("query_id", "pos", "id", "layer")


# ---- sinks and streams ---------------------------------------------------------------------------------------------


@query("vector_append")
def vector_append(spark, sf):
    path = sinks.scratch_table(spark, "vectors")
    e = load(spark, sf, "embeddings")
    sinks.append_vectors(e.where("label < 5"), path, 64)
    sinks.append_vectors(e.where("label >= 5"), path, 64)
    return spark.read.parquet(path).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _archived(spark, sf, layer):
    base = sinks.scratch_table(spark, "archive")
    load(spark, sf, "turns").select("turn_id", "namespace", "query", "answer", "web_hits", "forced").repartition(4).write.parquet(f"{base}/in")
    AR.archive_stream(spark, f"{base}/in", f"{base}/out", f"{base}/state", YEAR).awaitTermination()
    return AR.archived(spark, f"{base}/out", layer)


TIER = f"tg AS (SELECT *, {sql_tier('query', 'answer', 'web_hits')} AS tier FROM turns)"


@query("stream_archive", with_clause("turns", extra=TIER) + "SELECT turn_id, namespace, left(query || chr(10) || answer, 2000) AS record FROM tg WHERE tier NOT IN ('reject_low_quality','reject_too_short','reject_partial_refusal')")
def stream_archive(spark, sf):
    return _archived(spark, sf, "l3").select("turn_id", "namespace", "record")


@query("async_archive", with_clause("turns", extra=TIER) + f"SELECT turn_id, tier, {sql_ttl('tier')} AS ttl FROM tg WHERE tier NOT LIKE 'reject%' AND NOT forced")
def async_archive(spark, sf):
    return _archived(spark, sf, "l1").select("turn_id", "tier", "ttl")


def pieces(spark, sf, size: int):
    """An answer is cut in one pass: looking for the start of each piece would read it from the front again."""
    cut_up = F.regexp_extract_all("answer", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    d = load(spark, sf, "answers").select("doc_id", cut_up.alias("l")).where("l IS NOT NULL")
    d = d.select("doc_id", F.size("l").alias("n"), F.posexplode_outer("l").alias("pos", "piece"))
    return d.select("doc_id", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("piece", F.lit("")).alias("piece"), (F.coalesce("pos", F.lit(0)) >= F.col("n") - 1).alias("last"))


@query("stream_chunks", with_clause("answers") + "SELECT doc_id, CAST(i AS INTEGER) AS pos, substring(answer, i * 2 + 1, 2) AS piece FROM (SELECT doc_id, answer, unnest(range(0, CAST(ceil(length(answer) / 2.0) AS BIGINT))) AS i FROM answers)")
def stream_chunks(spark, sf):
    return pieces(spark, sf, 2).where("piece <> ''").select("doc_id", "pos", "piece")


VISIBLE = with_clause("answers") + "SELECT doc_id, md5(CASE WHEN instr(answer, '###FOLLOWUP###') > 0 THEN left(answer, instr(answer, '###FOLLOWUP###') - 1) ELSE answer END) AS visible FROM answers"


@query("stream_filter_batch", VISIBLE)
def stream_filter_batch(spark, sf):
    """Put the pieces of each answer together again, then cut at the marker."""
    g = pieces(spark, sf, 40).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("l"))
    whole = g.select("doc_id", F.array_join(F.transform("l", lambda x: x["piece"]), "").alias("answer"))
    return whole.select("doc_id", F.md5(HB.visible_text(F.col("answer")).cast("binary")).alias("visible"))


@query("stream_filter", VISIBLE)
def stream_filter(spark, sf):
    """The same answers through the stateful stream, in three waves of pieces."""
    base = sinks.scratch_table(spark, "pieces")
    p = pieces(spark, sf, 7).select(F.col("doc_id").alias("stream_id"), "pos", "piece", "last")
    p = p.withColumn("wave", F.least(F.floor(F.col("pos") / 30), F.lit(2)).cast("int"))
    p.write.partitionBy("wave").parquet(f"{base}/in")
    for wave in range(3):  # each run of the query takes up the state where the last one stopped
        spark.read.parquet(f"{base}/in").where(f"wave = {wave}").drop("wave").write.mode("append").parquet(f"{base}/feed")
        stream = spark.readStream.schema("stream_id long, pos int, piece string, last boolean").parquet(f"{base}/feed")
        (HB.hold_back(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    g = spark.read.parquet(f"{base}/out").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("part", "visible"))).alias("l"))
    return g.select(F.col("stream_id").alias("doc_id"), F.md5(F.array_join(F.transform("l", lambda x: x["visible"]), "").cast("binary")).alias("visible"))
