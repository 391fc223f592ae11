"""Queries over text rules: normalising, chunking, cleaning, evidence, answers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.functions import answers as AN
from lamina.functions import cleaning as CL
from lamina.functions import evidence as EV
from lamina.functions import rewrite as RW
from lamina.functions import web as H
from lamina.functions.text import U, nfkc, once, strip
from lamina.operators import calibration as P
from lamina.operators import corpus as C
from lamina.operators import fusion as FU
from lamina.plans import retrieval as R
from lamina.plans.inputs import load, with_clause
from lamina.plans.registry import arr, lit, query, tup
from lamina.session import cut

STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def st(c: str) -> str:
    return STRIP.format(c=c)


def sql_norm(c: str) -> str:
    return f"regexp_replace(lower({c}), {lit(X.QA_PUNCT)}, '', 'g')"


# ---- keys --------------------------------------------------------------------------


def qa_norm(c):
    return F.regexp_replace(F.lower(nfkc(c)), U + X.QA_PUNCT, "")


@query("qa_normalize", with_clause("questions") + f"SELECT query_id, {sql_norm('query')} AS norm FROM questions")
def qa_normalize(spark, sf):
    return load(spark, sf, "questions").select("query_id", qa_norm(F.col("query")).alias("norm"))


@query("cache_key", with_clause("turns", extra=f"k AS (SELECT turn_id, coalesce(namespace || '::', '') || {sql_norm('query')} AS key FROM turns)") + """
SELECT turn_id, key, CASE WHEN instr(key, '::') > 1 THEN left(key, instr(key, '::') - 1) END AS ns FROM k""")
def cache_key(spark, sf):
    k = load(spark, sf, "turns").select("turn_id", F.concat(F.coalesce(F.concat("namespace", F.lit("::")), F.lit("")), qa_norm(F.col("query"))).alias("key"))
    return k.select("turn_id", "key", F.when(F.instr("key", "::") > 1, F.substring_index("key", "::", 1)).alias("ns"))


@query("namespace", with_clause("turns") + """
SELECT turn_id, CASE WHEN turn_id % 3 = 0 THEN 'u:' || cust WHEN turn_id % 3 = 1 AND source <> 'src1' THEN 's:' || source END AS ns FROM turns""")
def namespace(spark, sf):
    t = load(spark, sf, "turns")
    user = F.when(F.col("turn_id") % 3 == 0, F.col("cust"))
    session = F.when(F.col("turn_id") % 3 == 1, F.col("source"))
    return t.select("turn_id", F.when(F.coalesce(user, F.lit("")) != "", F.concat(F.lit("u:"), user))
                    .when((F.coalesce(session, F.lit("")) != "") & (session != "src1"), F.concat(F.lit("s:"), session)).alias("ns"))


@query("hash_keys", with_clause("questions") + f"SELECT query_id, 'emb::' || sha1('bge-m3::' || {sql_norm('query')}) AS emb_key, 'web_search:' || md5(query || '|5') AS web_key FROM questions")
def hash_keys(spark, sf):
    q = load(spark, sf, "questions")
    return q.select("query_id", F.concat(F.lit("emb::"), F.sha1(F.concat(F.lit("bge-m3::"), qa_norm(F.col("query"))).cast("binary"))).alias("emb_key"),
                    F.concat(F.lit("web_search:"), F.md5(F.concat("query", F.lit("|5")).cast("binary"))).alias("web_key"))


@query("t2s_map", with_clause("questions") + "SELECT query_id, translate(query, '總統訂單額', '总统订单额') AS simple FROM (SELECT query_id, replace(query, '总', '總') AS query FROM questions)")
def t2s_map(spark, sf):
    q = load(spark, sf, "questions").select("query_id", F.replace("query", F.lit("总"), F.lit("總")).alias("query"))
    return q.select("query_id", F.translate("query", "總統訂單額", "总统订单额").alias("simple"))


# ---- chunks and cleaning -----------------------------------------------------------------

CHUNK = f"""fu AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda p: {st('p')}), lambda p: length(p) >= 10), chr(10)) AS f FROM documents),
 nn AS (SELECT doc_id, f, CASE WHEN length(f) <= 512 THEN 1 ELSE CAST(ceil((length(f) - 512) / 448.0) AS BIGINT) + 1 END AS n FROM fu WHERE f <> ''),
 ch AS (SELECT doc_id, f, unnest(range(0, n)) AS i FROM nn)"""


@query("chunk_text", f"WITH {CHUNK} SELECT doc_id, CAST(i AS INTEGER) AS chunk_idx, doc_id || '_' || i AS chunk_id, substring(f, i * 448 + 1, 512) AS chunk FROM ch")
def chunk_text(spark, sf):
    return C.chunks(load(spark, sf, "documents"))


def rx(c: str, p: str, flags: str = "") -> str:
    p = CL.pattern(p)
    return f"regexp_matches({c}, {lit((f'(?{flags})' if flags else '') + p)})"


def noise_sql(s: str) -> str:
    toks = f"list_filter(string_split_regex({s}, '[\\s|/、,，]+'), lambda t: t <> '')"
    cells = f"list_filter(list_transform(string_split(trim({s}, '|'), '|'), lambda c: {st('c')}), lambda c: c <> '')"
    mark = rx(s, X.SENTENCE_MARK)
    rules = [rx(s, X.TABLE_SKELETON), rx(s, X.SYMBOLS_ONLY), rx(s, X.BARE_NUMBER), f"({rx(s, X.DIGIT_RUN)} AND {rx(s, X.DIGIT_LINE)})",
             rx(s, X.ATTRIBUTION, "i"), rx(s, X.PRICE_CTA), rx(s, X.RATING_BLOCK, "i"), rx(s, X.IMAGE_ASSET, "i"), f"{s} IN {tup(X.UI_TAGS)}",
             f"({rx(s, X.NAV_ARROW)} AND NOT {rx(s, X.SENTENCE_END)})",
             f"(len({toks}) > 0 AND len(list_filter({toks}, lambda t: NOT list_contains({arr(X.UI_WORDS)}, lower(t)))) = 0)",
             f"(starts_with({s}, '|') AND len({cells}) > 0 AND len(list_filter({cells}, lambda c: length(c) >= 12)) = 0 AND NOT {mark})",
             f"(length({s}) < 12 AND NOT {mark})", f"(NOT {rx(s, X.HAS_CJK)} AND NOT {rx(s, X.HAS_WORD)})"]
    return f"CASE WHEN {s} = '' THEN true WHEN starts_with({s}, '#') THEN false ELSE {' OR '.join(rules)} END"


LINES = f"ln AS (SELECT doc_id, answer, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, answer, list_transform(string_split(replace(answer, '[...]', chr(10)), chr(10)), lambda p: {st('p')}) AS ls FROM answers)), nl AS (SELECT *, {noise_sql('line')} AS noise FROM ln)"
CLEAN = LINES + r""", k1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, regexp_replace(line, '\s+', '', 'g') ORDER BY pos) AS rn FROM nl WHERE NOT noise),
 j1 AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS o FROM k1 WHERE rn = 1 GROUP BY doc_id),
 cl AS (SELECT a.doc_id, a.answer, CASE WHEN length(answer) < 200 OR o IS NULL OR length(o) < length(answer) * 0.3 THEN answer ELSE o END AS clean FROM answers a LEFT JOIN j1 USING (doc_id))"""


@query("noise_lines", with_clause("answers", extra=LINES) + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, noise FROM nl")
def noise_lines(spark, sf):
    d = load(spark, sf, "answers").select("doc_id", F.posexplode(CL.lines(F.col("answer"))).alias("pos", "line"))
    return d.select("doc_id", "pos", CL.noise(F.col("line")).alias("noise"))


def cleaned(spark, sf):
    return once(load(spark, sf, "answers"), "clean", CL.clean_snippet(F.col("answer")))


@query("clean_snippet", with_clause("answers", extra=CLEAN) + "SELECT doc_id, clean FROM cl")
def clean_snippet(spark, sf):
    return cleaned(spark, sf).select("doc_id", "clean")


@query("clean_stats", with_clause("answers", extra=CLEAN) + f"""
SELECT doc_id, CAST(length(answer) AS INTEGER) AS raw_len, CAST(length(clean) AS INTEGER) AS clean_len, round(1 - CAST(length(clean) AS DOUBLE) / greatest(length(answer), 1), 4) AS removed_ratio,
  CAST(len(list_filter(string_split(replace(answer, '[...]', chr(10)), chr(10)), lambda p: {st('p')} <> '')) AS INTEGER) AS raw_lines,
  CAST(len(list_filter(string_split(clean, chr(10)), lambda p: {st('p')} <> '')) AS INTEGER) AS kept_lines, clean = answer AND length(answer) >= 200 AS fell_back FROM cl""")
def clean_stats(spark, sf):
    d = cleaned(spark, sf)
    full = lambda a: F.size(F.filter(a, lambda p: strip(p) != ""))
    return d.select("doc_id", F.length("answer").alias("raw_len"), F.length("clean").alias("clean_len"),
                    F.round(1.0 - F.length("clean") / F.greatest(F.length("answer"), F.lit(1)), 4).alias("removed_ratio"),
                    full(CL.lines(F.col("answer"))).alias("raw_lines"), full(F.split("clean", "\n")).alias("kept_lines"),
                    ((F.col("clean") == F.col("answer")) & (F.length("answer") >= X.MIN_LEN_TO_CLEAN)).alias("fell_back"))


@query("html_extract", r"""WITH m AS (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>\s*<a href="([^"]*)"[^>]*>(.*?)</a>\s*</li>', 1) AS h,
  regexp_extract_all(html, '(?is)<li[^>]*>\s*<a href="([^"]*)"[^>]*>(.*?)</a>\s*</li>', 2) AS b FROM pages),
 u AS (SELECT page_id, unnest(range(0, len(h))) AS pos, unnest(h) AS href, unnest(b) AS b FROM m)
SELECT page_id, CAST(pos AS INTEGER) AS pos, href, trim(replace(replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS title FROM u""")
def html_extract(spark, sf):
    return H.result_items(load(spark, sf, "pages"))


# ---- evidence ----------------------------------------------------------------------------------


def san_sql(src: str, key: str, col: str, limit: int, tag: str = "") -> str:
    ann = "c2"
    for flags, p in X.INJECTIONS:
        ann = f"regexp_replace({ann}, {lit((f'(?{flags})' if flags else '') + p)}, {lit(X.FLAG_OPEN + chr(92) + '0' + X.FLAG_CLOSE)}, 'g')"
    return f"""s0{tag} AS (SELECT {key}, coalesce({col}, '') AS c0 FROM {src}), s1{tag} AS (SELECT *, regexp_replace(c0, {lit(X.CONTROL_CHARS)}, '', 'g') AS c1 FROM s0{tag}),
 s2{tag} AS (SELECT *, list_reduce(list_prepend(c1, list_distinct(regexp_extract_all(c1, {lit('(?i)' + X.FAKE_DELIM)}))), lambda a, m: replace(a, m, translate(m, '<>', '＜＞'))) AS c2 FROM s1{tag}),
 s3{tag} AS (SELECT *, {ann} AS c3 FROM s2{tag}),
 san{tag} AS (SELECT {key}, CASE WHEN length(c3) > {limit} THEN rtrim(regexp_replace(left(c3, {limit}), '\\s+$', '')) || '…' ELSE c3 END AS clean,
   list_filter([CASE WHEN c1 <> c0 THEN 'control_chars' END, CASE WHEN c2 <> c1 THEN 'fake_delimiter' END, CASE WHEN c3 <> c2 THEN 'injection' END,
     CASE WHEN length(c3) > {limit} THEN 'truncated' END], lambda r: r IS NOT NULL) AS risks FROM s3{tag})"""


@query("sanitize_evidence", with_clause("answers", extra=san_sql("answers", "doc_id", "answer", 1500)) + "SELECT doc_id, clean, array_to_string(risks, ',') AS risks FROM san")
def sanitize_evidence(spark, sf):
    d = EV.sanitize(load(spark, sf, "answers"), "answer", X.DOC_CHARS)
    return d.select("doc_id", "clean", F.array_join("risks", ",").alias("risks"))


def attr_sql(c: str, n: int = 200) -> str:
    v = f"left(regexp_replace(coalesce({c}, ''), {lit(X.CONTROL_CHARS)}, '', 'g'), {n})"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        v = f"replace({v}, {lit(a)}, {lit(b)})"
    return v


@query("safe_attr", f"SELECT page_id, {attr_sql('url', 500)} AS url, {attr_sql('html')} AS head FROM pages")
def safe_attr(spark, sf):
    return load(spark, sf, "pages").select("page_id", EV.safe_attr(F.col("url"), 500).alias("url"), EV.safe_attr(F.col("html")).alias("head"))


LABEL = "CASE layer " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in X.LAYER_LABELS.items()) + " ELSE layer END"
EVID = f"""f6 AS (SELECT query_id * 100 + pos AS k, * FROM fr WHERE pos <= 6 AND trim(text) <> ''), {san_sql('f6', 'k', 'text', 1500, 'a')}, {san_sql('f6', 'k', 'title', 120, 'b')},
 dd AS (SELECT f.query_id, f.pos, f.id, ' type="' || {attr_sql(LABEL)} || '"' || CASE WHEN b.clean <> '' THEN ' title="' || {attr_sql('b.clean')} || '"' ELSE '' END
   || CASE WHEN f.url <> '' THEN ' url="' || {attr_sql('f.url', 500)} || '"' ELSE '' END || ' conf="' || printf('%.2f', f.calibrated) || '"'
   || CASE WHEN len(a.risks) + len(b.risks) > 0 THEN ' risk="' || array_to_string(list_concat(a.risks, list_filter(b.risks, lambda r: NOT list_contains(a.risks, r))), ',') || '"' ELSE '' END AS attrs, a.clean
   FROM f6 f JOIN sana a USING (k) JOIN sanb b USING (k) WHERE trim(a.clean) <> ''),
 nd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM dd),
 dc AS (SELECT *, '<doc id="' || n || '"' || attrs || '>' || chr(10) || clean || chr(10) || '</doc>' AS doc FROM nd),
 rs AS (SELECT *, sum(length(doc)) OVER (PARTITION BY query_id ORDER BY n) AS run FROM dc),
 bad AS (SELECT query_id, min(n) AS stop FROM rs WHERE n > 1 AND run > 8000 GROUP BY query_id),
 evi AS (SELECT r.query_id, '<evidence>' || chr(10) || {lit(X.GUARD_HINT)} || chr(10) || string_agg(doc, chr(10) ORDER BY n) || chr(10) || '</evidence>' AS block,
   string_agg(id, ',' ORDER BY n) AS source_ids FROM rs r LEFT JOIN bad USING (query_id) WHERE stop IS NULL OR n < stop GROUP BY r.query_id)"""


def blocks(spark, sf):
    best = cut(FU.rrf_top(R.three_lists(spark, sf, heads=True), X.FUSED_K))  # read three times
    return EV.evidence_block(best, texts=R.doc_texts(spark, sf))


@query("evidence_block", with_clause(*R.NAMES, extra=R.PASS + ", " + EVID) + "SELECT query_id, block, source_ids FROM evi")
def evidence_block(spark, sf):
    return blocks(spark, sf).withColumn("source_ids", F.array_join("source_ids", ","))


@query("context_budget", with_clause("answers") + """
SELECT source, doc_id FROM (SELECT *, min(CASE WHEN run > 8000 AND rn > 1 THEN rn END) OVER (PARTITION BY source) AS stop FROM
  (SELECT source, doc_id, rn, sum(n) OVER (PARTITION BY source ORDER BY rn) AS run FROM
    (SELECT source, doc_id, length(answer) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM answers))) WHERE stop IS NULL OR rn < stop""")
def context_budget(spark, sf):
    """Documents of a source in order until the budget breaks. Every kept text
    but the first has at least one character, so no source keeps more than the
    budget's number of rows, and longer lists are cut before they are summed."""
    from pyspark.sql import Window as W

    from lamina.operators.ranking import top_k

    d = load(spark, sf, "answers").select("source", "doc_id", F.length("answer").alias("n")).where(F.col("n") > 0)
    d = top_k(d, ["source"], [F.asc("doc_id")], X.EVIDENCE_CHARS + 1, rank="rn")
    w = W.partitionBy("source").orderBy("rn")
    run = d.withColumn("over", (F.sum("n").over(w) > X.EVIDENCE_CHARS) & (F.col("rn") > 1))
    return run.withColumn("broke", F.max("over").over(w)).where(~F.col("broke")).select("source", "doc_id")


@query("user_message", with_clause("rq", *R.NAMES, extra=R.PASS + ", " + EVID) + f"""
SELECT query_id, coalesce(block || chr(10) || chr(10), '') || CASE WHEN query_id % 3 = 0 THEN {lit(X.SEARCH_NOTE)} || chr(10) || chr(10) ELSE '' END
  || CASE WHEN query_id % 4 = 0 THEN {lit(X.RETRIEVAL_NOTE)} || chr(10) || chr(10) ELSE '' END || '<question>' || chr(10) || query || chr(10) || '</question>' AS message
FROM rq LEFT JOIN evi USING (query_id)""")
def user_message(spark, sf):
    q = load(spark, sf, "rq").select("query_id", "query").join(blocks(spark, sf), "query_id", "left")
    return q.select("query_id", EV.user_message(F.col("query"), F.coalesce("block", F.lit("")), F.col("query_id") % 4 == 0, F.col("query_id") % 3 == 0).alias("message"))


@query("wrap_evidence", with_clause("web_log") + f"""
SELECT query_id, pos, 'L4_web' AS layer, round({R.cal("'L4_web'", '(1 - 0.05 * pos)')}, 4) AS confidence FROM web_log
UNION ALL SELECT vec_id, -1, 'tool', 0.95 FROM embeddings""")
def wrap_evidence(spark, sf):
    w = load(spark, sf, "web_log").select("query_id", "pos", F.lit("L4_web").alias("layer"),
                                          F.round(P.calibrate(F.lit("L4_web"), 1.0 - X.RANK_STEP * F.col("pos")), 4).alias("confidence"))
    t = load(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.lit(-1).alias("pos"), F.lit("tool").alias("layer"), F.lit(0.95).alias("confidence"))
    return w.unionByName(t)


# ---- citations -------------------------------------------------------------------------------------

CITE = r"""g AS (SELECT doc_id, unnest(range(0, len(gs))) AS mark, unnest(gs) AS grp FROM (SELECT doc_id, regexp_extract_all(answer, '\[\s*(\d+(?:\s*[-,，、]\s*\d+)*)\s*\]', 1) AS gs FROM answers)),
 pt AS (SELECT doc_id, mark, unnest(range(0, len(ps))) AS k, trim(unnest(ps)) AS part FROM (SELECT doc_id, mark, string_split_regex(grp, '[,，、]') AS ps FROM g)),
 ex0 AS (SELECT doc_id, mark, k, CASE WHEN contains(part, '-') THEN range(CAST(regexp_extract(part, '^(\d+)\s*-', 1) AS BIGINT), CAST(regexp_extract(part, '-\s*(\d+)$', 1) AS BIGINT) + 1) ELSE [CAST(part AS BIGINT)] END AS ids FROM pt),
 cit AS (SELECT doc_id, mark, k, unnest(ids) AS source_id FROM ex0)"""
SRCS = "src AS (SELECT doc_id, unnest(range(1, CAST(doc_id % 4 + 2 AS BIGINT))) AS source_id FROM answers)"


def cites(spark, sf):
    return AN.citations(load(spark, sf, "answers"), "doc_id", "answer")


def cite_sources(spark, sf):
    d = load(spark, sf, "answers").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 4 + 1).cast("int"))).alias("source_id"))
    return d.withColumn("risky", (F.col("doc_id") + F.col("source_id")) % 5 == 0)


@query("citations_parse", with_clause("answers", extra=CITE) + "SELECT doc_id, CAST(mark AS INTEGER) AS mark, CAST(source_id AS INTEGER) AS source_id FROM cit")
def citations_parse(spark, sf):
    return cites(spark, sf).select("doc_id", "mark", "source_id")


@query("citation_spans")
def citation_spans(spark, sf):
    d = load(spark, sf, "answers").select("doc_id", F.posexplode(AN.citation_spans(F.col("answer"))).alias("mark", "s"))
    return d.select("doc_id", "mark", "s.start", "s.end", "s.sentence")


@query("citations_validate", with_clause("answers", extra=CITE + ", " + SRCS) + """
SELECT c.doc_id, CAST(mark AS INTEGER) AS mark, CAST(c.source_id AS INTEGER) AS source_id, s.source_id IS NOT NULL AS valid FROM cit c LEFT JOIN src s ON s.doc_id = c.doc_id AND s.source_id = c.source_id""")
def citations_validate(spark, sf):
    return AN.validate(cites(spark, sf), cite_sources(spark, sf), "doc_id").select("doc_id", "mark", "source_id", "valid")


@query("citation_metrics", with_clause("answers", extra=CITE + ", " + SRCS + """, us AS (SELECT DISTINCT doc_id, source_id FROM cit)""") + """
SELECT s.doc_id, count(*) AS n_sources, count(u.source_id) AS n_cited, bool_or((s.doc_id + s.source_id) % 5 = 0) AS risky,
  (SELECT count(*) FROM cit c WHERE c.doc_id = s.doc_id AND (c.doc_id, c.source_id) NOT IN (SELECT (doc_id, source_id) FROM src)) AS invalid,
  round(count(u.source_id) / CAST(count(*) AS DOUBLE), 4) AS coverage
FROM src s LEFT JOIN us u ON u.doc_id = s.doc_id AND u.source_id = s.source_id GROUP BY s.doc_id""")
def citation_metrics(spark, sf):
    return AN.citation_metrics(cites(spark, sf), cite_sources(spark, sf), "doc_id")


@query("dedup_sources", with_clause(*R.NAMES, extra=R.PASS + """, sk AS (SELECT *, list_no * 100 + rank AS pos, CASE WHEN url <> '' THEN url ELSE layer || '::' || left(title, 40) END AS skey FROM pas),
 sg AS (SELECT query_id, skey, min(pos) AS first, arg_min(id, (1 - calibrated) * 1e9 + pos) AS id, max(calibrated) AS confidence FROM sk GROUP BY query_id, skey)""") + """
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) AS INTEGER) AS source_id, id, confidence FROM sg""")
def dedup_sources(spark, sf):
    d = R.three_lists(spark, sf).withColumn("pos", F.col("list_no") * 100 + F.col("rank")).withColumn("confidence", F.col("calibrated"))
    return AN.dedup_sources(d.select("query_id", "pos", "id", "layer", "title", "url", "confidence"), ["query_id"]).select("query_id", "source_id", "id", "confidence")


@query("render_sources")
def render_sources(spark, sf):
    d = R.three_lists(spark, sf).withColumn("pos", F.col("list_no") * 100 + F.col("rank")).withColumn("confidence", F.col("calibrated"))
    s = AN.dedup_sources(d.select("query_id", "pos", "id", "layer", "title", "url", "confidence"), ["query_id"])
    s = s.withColumn("c2", EV.two_digits(F.col("confidence")))
    domain = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    name = F.when(F.col("url").rlike("^https?://"), F.concat(F.lit("["), "title", F.lit(" — "), domain, F.lit("]("), "url", F.lit(")"))).otherwise(F.col("title"))
    line = F.concat(F.col("source_id").cast("string"), F.lit(". "), name, F.lit(" · "), EV.layer_label(F.col("layer")), F.lit(" · 置信度 "), "c2")
    g = s.select("query_id", "source_id", line.alias("line")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "line"))).alias("l"))
    return g.select("query_id", F.concat(F.lit("**来源**\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("markdown"))


# ---- follow-ups, rewriting, judging --------------------------------------------------------------------

FUP = f"""f0 AS (SELECT turn_id, query, answer, instr(answer, '###FOLLOWUP###') AS mp FROM turns),
 f1 AS (SELECT turn_id, query, CASE WHEN mp > 0 THEN regexp_replace(left(answer, mp - 1), '\\s+$', '') ELSE answer END AS body,
   CASE WHEN mp > 0 THEN list_filter(string_split(substring(answer, mp + 14), chr(10)), lambda l: {st('l')} <> '') ELSE [] END AS raw FROM f0),
 f2 AS (SELECT turn_id, query, unnest(range(0, len(raw))) AS i, regexp_replace(regexp_replace({st('unnest(raw)')}, {lit(X.FOLLOWUP_DECOR)}, ''), {lit(X.FOLLOWUP_QUOTES)}, '', 'g') AS q0 FROM f1),
 f3 AS (SELECT turn_id, i, trim(q0) AS q, lower(regexp_replace(trim(q0), {lit(X.FOLLOWUP_NORM)}, '', 'g')) AS n, lower(regexp_replace(query, {lit(X.FOLLOWUP_NORM)}, '', 'g')) AS o FROM f2),
 f4 AS (SELECT *, row_number() OVER (PARTITION BY turn_id, lower(regexp_replace(q, {lit(X.FOLLOWUP_KEY)}, '', 'g')) ORDER BY i) AS d FROM f3
   WHERE q <> '' AND length(q) <= 40 AND (ends_with(q, '?') OR ends_with(q, '？') OR regexp_matches(q, {lit(X.FOLLOWUP_ASKS)}))
     AND NOT (n = o OR (length(n) > 6 AND (contains(o, n) OR contains(n, o)))) AND NOT regexp_matches(q, {lit(X.FOLLOWUP_PRONOUN)})),
 f5 AS (SELECT turn_id, q, row_number() OVER (PARTITION BY turn_id ORDER BY i) AS rn FROM f4 WHERE d = 1),
 f6 AS (SELECT turn_id, string_agg(q, '|' ORDER BY rn) AS fu FROM f5 WHERE rn <= 3 GROUP BY turn_id)"""


@query("followups_parse", with_clause("turns", extra=FUP) + "SELECT turn_id, CAST(length(body) AS INTEGER) AS body_len, coalesce(fu, '') AS followups, CAST(len(raw) AS INTEGER) AS raw_count FROM f1 LEFT JOIN f6 USING (turn_id)")
def followups_parse(spark, sf):
    d = once(load(spark, sf, "turns"), "f", AN.split_followups(F.col("answer"), F.col("query")))
    return d.select("turn_id", F.length("f.body").alias("body_len"), F.array_join("f.followups", "|").alias("followups"), F.col("f.raw_count").alias("raw_count"))


DROP = arr(tuple(dict.fromkeys(X.SHORTEN_STOPWORDS + X.SHORTEN_NEGATIONS + X.SHORTEN_CONTRAST)))
PUNCT = "^[" + re.escape(X.SHORTEN_PUNCT) + "]+$"


def toks_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> '')"


def kw_sql(toks: str) -> str:
    return f"list_filter({toks}, lambda t: NOT regexp_matches(t, {lit(PUNCT)}) AND NOT list_contains({DROP}, lower(t)))"


_ASC = "regexp_matches(a.cur, '[\\x00-\\x7f]$') AND regexp_matches(w.w, '^[\\x00-\\x7f]')"
SHORT = f"""h0 AS (SELECT query_id, {st('query')} AS q FROM questions),
 h1 AS (SELECT query_id, q, unnest(range(0, len(cs))) AS i, unnest(cs) AS c FROM (SELECT *, list_filter(list_transform(string_split_regex(q, {lit(X.CLAUSE_SPLIT)}), lambda p: {st('p')}), lambda p: p <> '') AS cs FROM h0)),
 h2 AS (SELECT query_id, q, i, list_reduce(list_prepend({{'w': '', 'done': []::VARCHAR[], 'cur': ''}}, list_transform({toks_sql('c')}, lambda t: {{'w': t, 'done': []::VARCHAR[], 'cur': ''}})),
   lambda a, w: CASE WHEN list_contains({arr(X.SHORTEN_CONTRAST)}, lower(w.w)) AND a.cur <> '' THEN {{'w': '', 'done': list_append(a.done, a.cur), 'cur': ''}}
     WHEN a.cur = '' THEN {{'w': '', 'done': a.done, 'cur': w.w}} WHEN {_ASC} THEN {{'w': '', 'done': a.done, 'cur': a.cur || ' ' || w.w}}
     ELSE {{'w': '', 'done': a.done, 'cur': a.cur || w.w}} END) AS r FROM h1),
 h3 AS (SELECT query_id, q, i, unnest(range(0, len(cl))) AS j, unnest(cl) AS c FROM (SELECT query_id, q, i, CASE WHEN r.cur <> '' THEN list_append(r.done, r.cur) ELSE r.done END AS cl FROM h2)),
 h4 AS (SELECT query_id, q, i, j, len(list_filter({arr(X.SHORTEN_NEGATIONS)}, lambda w: contains(lower(c), w))) > 0 AS neg, {kw_sql(toks_sql('c'))} AS kw FROM h3),
 h5 AS (SELECT query_id, q, neg, i, j, unnest(range(0, len(kw))) AS k, unnest(kw) AS w FROM h4),
 h6 AS (SELECT *, row_number() OVER (PARTITION BY query_id, neg, lower(w) ORDER BY i, j, k) AS d FROM h5),
 h7 AS (SELECT p.*, row_number() OVER (PARTITION BY query_id, neg ORDER BY i, j, k) AS rn FROM h6 p WHERE d = 1 AND (neg OR NOT EXISTS (SELECT 1 FROM h6 n WHERE n.query_id = p.query_id AND n.neg AND lower(n.w) = lower(p.w)))),
 h8 AS (SELECT query_id, string_agg(CASE WHEN neg THEN '-' || w ELSE w END, ' ' ORDER BY neg, rn) AS s FROM h7 WHERE neg OR rn <= 8 GROUP BY query_id)"""


@query("shorten_query", with_clause("questions", extra=SHORT) + "SELECT query_id, coalesce(s, q) AS short FROM h0 LEFT JOIN h8 USING (query_id)")
def shorten_query(spark, sf):
    return load(spark, sf, "questions").select("query_id", RW.shorten(F.col("query")).alias("short"))


CORE = "list_distinct(list_transform(list_filter({k}, lambda w: length(w) > 1), lambda w: lower(w)))"


def core_sql(c: str) -> str:
    return CORE.format(k=kw_sql(toks_sql(c)))


@query("history_drift", with_clause("pairs", extra=f"""d0 AS (SELECT conv_id, turn, {core_sql('query')} AS q, {core_sql('left(answer, 60)')} AS r, {core_sql('answer')} AS h FROM pairs)""") + """
SELECT conv_id, turn, len(q) > 0 AND len(r) > 0 AND NOT list_has_any(r, q) AS severe,
  CASE WHEN len(q) = 0 OR len(r) = 0 THEN '' ELSE array_to_string(list_sort(list_filter(r, lambda w: list_contains(h, w) AND NOT list_contains(q, w))), '|') END AS suspicious FROM d0""")
def history_drift(spark, sf):
    d = once(load(spark, sf, "pairs"), "d", RW.drift(F.col("query"), F.substring("answer", 1, 60), F.col("answer")))
    return d.select("conv_id", "turn", "d.severe", F.array_join("d.suspicious", "|").alias("suspicious"))


RAWJ = """lt AS (SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN concat('<think>maybe {"tool": 1}</think> ```', '{"tool": "', event_type, '", "args": ', props, '}', '```')
  WHEN 1 THEN concat('Sure: {"tool": "get_weather", "args": ', props, '} done') WHEN 2 THEN 'no json here' ELSE concat('{"tool": "', event_type) END AS raw FROM events)"""


@query("json_extract", f"WITH {RAWJ}" + r""", x AS (SELECT event_id, regexp_extract(regexp_replace(raw, '(?s)^.*</think>', ''), '(?s)(\{.*\})', 1) AS j FROM lt)
SELECT event_id, CASE WHEN j <> '' THEN json_extract_string(j, '$.tool') END AS tool, CASE WHEN j <> '' THEN CAST(json_extract_string(j, '$.args.k') AS INTEGER) END AS k FROM x""")
def json_extract(spark, sf):
    load(spark, sf, "events").createOrReplaceTempView("events")
    d = spark.sql(f"WITH {RAWJ} SELECT event_id, raw FROM lt").withColumn("j", AN.first_json(F.col("raw")))
    return d.select("event_id", F.get_json_object("j", "$.tool").alias("tool"), F.get_json_object("j", "$.args.k").cast("int").alias("k"))


JN = "lower(regexp_replace({c}, " + lit(X.JUDGE_PUNCT) + ", '', 'g'))"
JUDGE = f"""jd AS (SELECT doc_id, {JN.format(c="answer || ' total: ' || n_chars")} AS t, {JN.format(c="CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) WHEN doc_id % 3 = 0 THEN CAST(n_chars // 10 AS VARCHAR) ELSE left(text, 12) END")} AS g FROM answers)"""


@query("answer_judge", with_clause("answers", extra=JUDGE) + r"""
SELECT doc_id, CASE WHEN g = '' THEN false WHEN regexp_matches(g, '^[\d.]+$') THEN regexp_matches(t, '(^|[^\d.])' || replace(g, '.', '\.') || '($|[^\d.])') ELSE contains(t, g) END AS ok FROM jd""")
def answer_judge(spark, sf):
    d = load(spark, sf, "answers")
    gold = F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string")).when(
        F.col("doc_id") % 3 == 0, F.floor(F.col("n_chars") / 10).cast("string")).otherwise(F.substring("text", 1, 12))
    return d.select("doc_id", AN.judge(F.concat("answer", F.lit(" total: "), F.col("n_chars").cast("string")), gold).alias("ok"))


@query("multi_key_recall", with_clause("answers", extra=f"mk AS (SELECT doc_id, {JN.format(c='answer')} AS t FROM answers)") + """
SELECT doc_id, CAST(CAST(contains(t, 'ion') OR contains(t, 'xyzzy') AS INTEGER) + CAST(contains(t, 'claim') AS INTEGER) + CAST(contains(t, 'ou') OR contains(t, 'sch') AS INTEGER) AS INTEGER) AS hit,
  (contains(t, 'ion') OR contains(t, 'xyzzy')) AND contains(t, 'claim') AND (contains(t, 'ou') OR contains(t, 'sch')) AS all_ok FROM mk""")
def multi_key_recall(spark, sf):
    keys = F.array(*[F.array(*[F.lit(a) for a in alts]) for alts in (("ION", "xyzzy"), ("claim",), ("o-u", "sch"))])
    d = load(spark, sf, "answers").select("doc_id", AN.judge_keys(F.col("answer"), keys).alias("hit"))
    return d.select("doc_id", "hit", (F.col("hit") == 3).alias("all_ok"))


# ---- tools -------------------------------------------------------------------------------------------------

DATE_CLAUSE = "submittedDate:[199701010000 TO 199701070000]"


def paper_queries(q, clause: str):
    ops = "(?i)" + U + r"(?<!\w)(?:" + "|".join(X.PAPER_OPERATORS) + r")(?!\w)"
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(q, X.PAPER_RESERVED, " "), ops, " "), r"\s+", " "))
    words = F.split(norm, " ")
    kept0 = F.filter(words, lambda w: ~F.array_contains(F.array(*[F.lit(s) for s in X.PAPER_STOPWORDS]), F.lower(w)))
    kept = F.when(F.size(kept0) > 0, kept0).otherwise(words)
    cands = F.array(F.concat(F.lit('all:"'), norm, F.lit('"')),
                    F.when((F.size(words) > 1) & (F.size(kept) > 1), F.array_join(F.transform(kept, lambda w: F.concat(F.lit("all:"), w)), " AND ")),
                    F.when(F.size(words) > 1, F.concat(F.lit("all:"), norm)))
    cands = F.filter(cands, lambda c: c.isNotNull())
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(cands, lambda c: F.concat(F.lit("("), c, F.lit(f") AND {clause}")) if clause else c)))


_PW = f"list_filter(w, lambda x: NOT list_contains({arr(X.PAPER_STOPWORDS)}, lower(x)))"


@query("query_candidates", with_clause("questions", extra=rf"""p0 AS (SELECT query_id, trim(regexp_replace(regexp_replace(regexp_replace(query, '["()\[\]]', ' ', 'g'),
  '(^|[^\p{{L}}\p{{N}}_])(?:ANDNOT|AND|OR|NOT)($|[^\p{{L}}\p{{N}}_])', '\1 \2', 'gi'), '\s+', ' ', 'g')) AS n FROM questions), p1 AS (SELECT *, string_split(n, ' ') AS w FROM p0),
 p2 AS (SELECT *, CASE WHEN len({_PW}) > 0 THEN {_PW} ELSE w END AS k FROM p1)""") + f"""
SELECT query_id, array_to_string(list_transform(list_filter(['all:"' || n || '"', CASE WHEN len(w) > 1 AND len(k) > 1 THEN array_to_string(list_transform(k, lambda x: 'all:' || x), ' AND ') END,
  CASE WHEN len(w) > 1 THEN 'all:' || n END], lambda c: c IS NOT NULL), lambda c: '(' || c || ') AND {DATE_CLAUSE}'), ' ## ') AS cands FROM p2""")
def query_candidates(spark, sf):
    return load(spark, sf, "questions").select("query_id", F.array_join(paper_queries(F.col("query"), DATE_CLAUSE), " ## ").alias("cands"))


@query("xml_entries", """SELECT page_id, CAST(i AS INTEGER) AS i, 'Page ' || page_id || ' part ' || i AS title, url, CAST(2 AS INTEGER) AS author_count FROM pages, (VALUES (0), (1)) v(i)""")
def xml_entries(spark, sf):
    """Feed entries: built from the pages, read back with XPath."""
    p = load(spark, sf, "pages")
    entry = lambda i: F.concat(F.lit("<entry><title> Page  "), F.col("page_id").cast("string"), F.lit(f"\n part {i} </title><id>"), EV.safe_attr(F.col("url"), 500),
                               F.lit("</id><author><name>A</name></author><author><name>B</name></author></entry>"))
    x = p.select("page_id", F.concat(F.lit("<feed>"), entry(0), entry(1), F.lit("</feed>")).alias("x"))
    get = lambda path: F.xpath("x", F.lit(path))
    e = x.select("page_id", F.posexplode(F.arrays_zip(get("feed/entry/title/text()").alias("t"), get("feed/entry/id/text()").alias("u"))).alias("i", "e"), F.xpath_int("x", F.lit("count(feed/entry[1]/author)")).alias("author_count"))
    return e.select("page_id", "i", F.trim(F.regexp_replace("e.t", r"\s+", " ")).alias("title"), F.col("e.u").alias("url"), "author_count")


ASKS = """tzq AS (SELECT event_id, ts, CASE CAST(user_id % 7 AS INT) WHEN 0 THEN 'New York?' WHEN 1 THEN '现在东京几点' WHEN 2 THEN 'the london office' WHEN 3 THEN 'Nowhere land' WHEN 4 THEN 'UTC' WHEN 5 THEN '请问上海的时间' ELSE '' END AS place FROM events)"""
PLACE_NOISE = r"(现在|当前|此刻|今天|今日|当地|本地|时间|日期|几号|几点|是多少|是几点|星期几|周几|礼拜几|请问|帮我查|查一下|告诉我|的|\?|？|!|！|。|，|,)"


def resolve_zone(place):
    """Exact name, then the first listed name the text contains as a word (or,
    outside ASCII, at all)."""
    loc = F.lower(F.trim(F.regexp_replace(F.regexp_replace(place, PLACE_NOISE, ""), r"\s+", " ")))
    zones = F.create_map(*[F.lit(x) for kv in X.CITY_ZONES.items() for x in kv])
    names = F.array(*[F.lit(k) for k in X.CITY_ZONES])
    padded = F.concat(F.lit(" "), F.regexp_replace(loc, U + r"[^\w]+", " "), F.lit(" "))
    inside = F.filter(names, lambda n: F.when(n.rlike(r"^[\x00-\x7f]+$"), F.contains(padded, F.concat(F.lit(" "), n, F.lit(" ")))).otherwise(F.contains(loc, n)))
    return F.when(loc == "", None).otherwise(F.coalesce(F.try_element_at(zones, loc), F.try_element_at(zones, F.get(inside, 0))))


@query("tz_convert", f"WITH {ASKS}, z AS (SELECT *, CASE place WHEN 'New York?' THEN 'America/New_York' WHEN '现在东京几点' THEN 'Asia/Tokyo' WHEN 'the london office' THEN 'Europe/London' WHEN 'UTC' THEN 'UTC' WHEN '请问上海的时间' THEN 'Asia/Shanghai' END AS zone FROM tzq)" + """
SELECT event_id, zone, strftime(CASE zone WHEN 'America/New_York' THEN ts - INTERVAL 5 HOUR WHEN 'Asia/Tokyo' THEN ts + INTERVAL 9 HOUR WHEN 'Asia/Shanghai' THEN ts + INTERVAL 8 HOUR ELSE ts END, '%Y-%m-%d %H:%M:%S') AS local_time,
  (['一','二','三','四','五','六','日'])[isodow(CASE zone WHEN 'America/New_York' THEN ts - INTERVAL 5 HOUR WHEN 'Asia/Tokyo' THEN ts + INTERVAL 9 HOUR WHEN 'Asia/Shanghai' THEN ts + INTERVAL 8 HOUR ELSE ts END)] AS weekday FROM z""")
def tz_convert(spark, sf):
    load(spark, sf, "events").createOrReplaceTempView("events")
    q = spark.sql(f"WITH {ASKS} SELECT * FROM tzq")
    zones = q.select("place").distinct().withColumn("zone", resolve_zone(F.col("place")))  # one row per asked place
    d = q.join(zones, "place").withColumn("t", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.coalesce("zone", F.lit("UTC"))))
    day = F.element_at(F.array(*[F.lit(c) for c in "一二三四五六日"]), F.weekday("t") + 1)
    return d.select("event_id", "zone", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("local_time"), day.alias("weekday"))


@query("format_tool_result")
def format_tool_result(spark, sf):
    e = load(spark, sf, "events")
    ok = F.col("event_id") % 3 != 0
    body = F.to_json(F.struct("event_type", "value", F.struct("user_id").alias("args")), {"pretty": "true"})
    return e.select("event_id", F.when(ok, F.concat(F.lit("[工具调用] "), "event_type", F.lit("("), "props", F.lit(")\n"), body)).otherwise("").alias("text"))


@query("result_json")
def result_json(spark, sf):
    f = FU.rrf_top(R.three_lists(spark, sf), X.FUSED_K)
    g = f.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "layer", "title", "url", "rrf"))).alias("results"))
    return g.select("query_id", F.to_json(F.struct("query_id", "results")).alias("json"))
