"""The whole run from questions to archive as a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.functions import web as H
from lamina.operators.engine import Engine, Layer
from lamina.plans import retrieval as R
from lamina.plans.inputs import load, with_clause
from lamina.plans.registry import lit, query
from lamina.plans.rules import YEAR, sql_tier, sql_time, sql_wants
from lamina.plans.stores import ENTRY, NOW, entries
from lamina.plans.texts import qa_norm

# questions are those of the turns; the even ones have been answered before. A turn's vector is that of its number, modulo their count.
CLOCK = ", ".join(lit(x) for x in X.CLOCK_QUESTIONS)


def vector_of(spark, sf, questions):
    n = load(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n_vec"))  # one row
    return questions.join(F.broadcast(n)).withColumn("vec", F.col("query_id") % F.col("n_vec")).drop("n_vec")


def engine(spark, sf):
    def by_vector(rows):
        """A layer whose rows are known per vector."""
        return lambda questions: vector_of(spark, sf, questions.select("query_id")).join(rows.withColumnRenamed("query_id", "vec"), "vec")

    docs = load(spark, sf, "vec_docs").select("id", "title", "text")
    wiki = R.doc_knn(spark, sf).select("query_id", "rank", "id", "score")
    old = R.history(spark, sf).select("query_id", "rank", "id", "title", "text", "score")
    pages = load(spark, sf, "pages").select("page_id", "url", F.trim(H.tag_text(F.col("html"), "title")).alias("title"))
    web = load(spark, sf, "web_log").join(pages, "page_id").select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("page_id").alias("id"), "title", F.col("title").alias("text"), "url", (1.0 - X.RANK_STEP * F.col("pos")).alias("score"))
    layers = [Layer("L2_wiki", 1, by_vector(wiki), texts=docs), Layer("L3_history", 2, by_vector(old), k=X.L3_K), Layer("L4_web", 4, by_vector(web), online=True)]
    return Engine(layers, entries(spark, sf).where("seq % 2 = 0"), NOW, YEAR, qa_norm)


ENGINE = f"""{R.DOC_KNN}, {R.HIST}, {ENTRY.replace('lat AS (', 'lat_ AS (').replace('WHERE write_ts <=', 'WHERE seq % 2 = 0 AND write_ts <=')},
 q0 AS (SELECT turn_id AS query_id, query, coalesce(namespace || '::', '') || nq AS key, nq AS gkey, trim(query) IN ({CLOCK}) AS clock, {sql_wants('query')} AS forced, {sql_time('query')} AS fresh,
   turn_id % (SELECT count(*) FROM embeddings) AS vec FROM g),
 q1 AS (SELECT q.*, coalesce(o.seq, w.seq) AS seq, coalesce(o.answer, w.answer) AS cached FROM q0 q LEFT JOIN lat_ o ON o.key = q.key LEFT JOIN lat_ w ON w.key = q.gkey),
 q2 AS (SELECT *, CASE WHEN clock THEN 'tool' WHEN NOT forced AND cached IS NOT NULL AND {sql_tier('query', 'cached', '0')} NOT LIKE 'reject%' THEN 'cache' ELSE 'search' END AS route FROM q1),
 sq AS (SELECT * FROM q2 WHERE route = 'search'),
 off AS (SELECT s.query_id, 1 AS list_no, k.rank, 'L2_wiki' AS layer, CAST(k.id AS VARCHAR) AS id, d.title, d.text, '' AS url, k.score FROM sq s JOIN dk k ON k.query_id = s.vec JOIN vec_docs d ON d.id = k.id
   UNION ALL SELECT s.query_id, 2, h.rank, 'L3_history', CAST(h.id AS VARCHAR), left(h.query, 40), '历史问答：' || chr(10) || 'Q: ' || h.query || chr(10) || 'A: ' || h.answer, '', h.score FROM sq s JOIN l3h h ON h.query_id = s.vec),
 offc AS (SELECT *, round({R.cal('layer', 'score')}, 4) AS calibrated FROM off),
 oc AS (SELECT query_id, round(1 - list_reduce(list_prepend(1.0::DOUBLE, list(1 - calibrated ORDER BY calibrated DESC)[1:3]), lambda a, x: a * x), 4) AS conf FROM offc GROUP BY query_id),
 stripped AS (SELECT query_id, query FROM sq WHERE NOT forced), bd AS (SELECT query_id, list_no * 100 + rank AS ord, title, text FROM off), {R.cov_sql('stripped', 'bd')},
 flg AS (SELECT s.query_id, s.forced, CASE WHEN conf IS NULL THEN 0 ELSE coverage END AS coverage,
   s.fresh OR s.forced OR coalesce(conf, 0) < {X.WEB_FALLBACK_CONFIDENCE} OR CASE WHEN conf IS NULL THEN 0 ELSE coverage END < {X.MIN_COVERAGE} AS online FROM sq s LEFT JOIN oc USING (query_id) LEFT JOIN cov USING (query_id)),
 page_text AS (SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages),
 pas AS (SELECT *, CASE WHEN url <> '' THEN 'url::' || url ELSE 'txt::' || left(title, 40) || '|' || left(text, 80) END AS pkey FROM (SELECT * FROM offc
   UNION ALL SELECT s.query_id, 4, w.pos + 1, 'L4_web', CAST(p.page_id AS VARCHAR), p.title, p.title, p.url, CAST(1 - 0.05 * w.pos AS DOUBLE), round({R.cal("'L4_web'", '(1 - 0.05 * w.pos)')}, 4)
     FROM sq s JOIN flg f ON f.query_id = s.query_id AND f.online JOIN web_log w ON w.query_id = s.vec JOIN page_text p USING (page_id))),
 fc AS (SELECT query_id, round(1 - list_reduce(list_prepend(1.0::DOUBLE, list(1 - calibrated ORDER BY calibrated DESC)[1:3]), lambda a, x: a * x), 4) AS conf,
   count(*) FILTER (WHERE layer = 'L2_wiki') AS n2, count(*) FILTER (WHERE layer = 'L3_history') AS n3, count(*) FILTER (WHERE layer = 'L4_web') AS n4 FROM pas GROUP BY query_id),
 fus AS (SELECT query_id, pkey, list_reduce(list_prepend(0.0::DOUBLE, list(1.0::DOUBLE / (60 + rank) ORDER BY list_no, rank)), lambda a, x: a + x) AS rrf, min(list_no * 100 + rank) AS first, arg_min(title, list_no * 100 + rank) AS title FROM pas GROUP BY query_id, pkey),
 fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first) AS pos FROM fus),
 ans AS (SELECT query_id, string_agg(title || '[' || pos || ']', chr(10) ORDER BY pos) AS made, count(*) AS n FROM fr WHERE pos <= {X.FUSED_K} GROUP BY query_id),
 fin AS (SELECT q.query_id, q.query, q.route, q.seq, q.cached, q.forced, f.coverage, f.online, c.conf, c.n2, c.n3, c.n4, a.made, a.n FROM q2 q LEFT JOIN flg f USING (query_id) LEFT JOIN fc c USING (query_id) LEFT JOIN ans a USING (query_id)),
 tie AS (SELECT *, {sql_tier('query', 'made', 'coalesce(n4, 0)')} AS tier FROM fin)"""


@query("engine_run", with_clause("turns", "pairs", "vec_docs", "web_log", extra=ENGINE) + """
SELECT query_id, route, CASE WHEN route = 'cache' THEN seq END AS entry, CAST(coalesce(n2, 0) AS BIGINT) AS n_wiki, CAST(coalesce(n3, 0) AS BIGINT) AS n_history, CAST(coalesce(n4, 0) AS BIGINT) AS n_web,
  CASE WHEN route = 'search' THEN coalesce(conf, 0) END AS confidence, CASE WHEN forced THEN NULL ELSE CAST(coverage AS DOUBLE) END AS coverage, online,
  md5(CASE WHEN route = 'cache' THEN cached ELSE made END) AS answer, CAST(coalesce(n, 0) AS BIGINT) AS n_cited,
  CASE WHEN route = 'search' THEN tier END AS tier, route = 'search' AND tier NOT LIKE 'reject%' AND NOT forced AS to_l1,
  route = 'search' AND tier NOT IN ('reject_low_quality', 'reject_too_short', 'reject_partial_refusal') AS to_l3 FROM tie""")
def engine_run(spark, sf):
    """Coverage of questions that ask for the web is left out of the check, since it is that of their shortened form."""
    questions = load(spark, sf, "turns").select(F.col("turn_id").alias("query_id"), "query", "namespace")
    e = engine(spark, sf)
    d = e.run(questions).join(e.parts["routed"].select("query_id", "forced"), "query_id")
    return d.select(
        "query_id", "route", "entry", F.col("n_L2_wiki").alias("n_wiki"), F.col("n_L3_history").alias("n_history"), F.col("n_L4_web").alias("n_web"), "confidence",
        F.when(~F.col("forced"), F.col("coverage")).alias("coverage"), "online", F.md5(F.col("answer").cast("binary")).alias("answer"), "n_cited", "tier", "to_l1", "to_l3")
