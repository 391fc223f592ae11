"""Queries over the knowledge graph and mention linking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.operators import corpus as C
from lamina.operators import kg as K
from lamina.operators import linking as L
from lamina.operators.name_index import NameIndex
from lamina.operators.ranking import ranked
from lamina.sources.readers import text_lines, triples_tsv
from lamina.sources.sinks import scratch_table, write_lines
from lamina.functions.vectors import doubles
from lamina.plans.inputs import built, load, with_clause
from lamina.plans.registry import arr, lit, query, tup

MIN_POP = 20  # the given graph is small: its places have tens of in-links, not thousands
CAND_K = 2

# ---- tables on the Spark side ---------------------------------------------------


def properties(spark):
    """The predicate whitelist: a fixed table, joined by broadcast."""
    return spark.createDataFrame(list(X.PREDICATE_LABELS.items()), "pid string, label_zh string")


def triples(spark, sf):
    return load(spark, sf, "kg_triples")


def ranks(spark, sf):
    return C.title_rank(load(spark, sf, "titles"), F.lower)


def entities(spark, sf):
    return built(spark, sf, "entities", lambda: _entities(spark, sf))


def _entities(spark, sf):
    raw = load(spark, sf, "kg_raw_entities").drop("alias")
    r = ranks(spark, sf).select(F.col("title").alias("label_zh"), F.col("rank").alias("article_rank"))
    return K.with_popularity(raw.join(r, "label_zh", "left"), triples(spark, sf))


def mentions(spark, sf):
    return built(spark, sf, "mentions", lambda: K.mentions_of(load(spark, sf, "kg_mention_rows")))


def scored(spark, sf):
    return built(spark, sf, "scored", lambda: K.scored_mentions(mentions(spark, sf), entities(spark, sf)))


WANTED = """wanted AS (SELECT n_name AS mention FROM nation UNION SELECT c_mktsegment FROM customer UNION SELECT p_name FROM part
  UNION SELECT p_brand FROM part UNION SELECT r_name FROM region UNION SELECT c_name FROM customer UNION SELECT 'part of' FROM region)"""


def wanted(spark, sf):
    for t in ("nation", "customer", "part", "region"):
        load(spark, sf, t).createOrReplaceTempView(t)
    return spark.sql(f"WITH {WANTED} SELECT * FROM wanted")


# ---- the same tables in check SQL ------------------------------------------------------

RANK = """tb AS (SELECT lower(title) AS norm, min((-views, title)) AS b FROM titles GROUP BY 1),
 tr AS (SELECT norm, row_number() OVER (ORDER BY b[1], b[2]) - 1 AS rank FROM tb),
 ranks AS (SELECT t.title, lower(t.title) AS norm, t.views, tr.rank FROM titles t JOIN tr ON tr.norm = lower(t.title))"""
RANK = RANK.replace("min((-views, title)) AS b", "min({'v': -views, 't': title}) AS b").replace("b[1], b[2]", "b.v, b.t")
POP = "pop AS (SELECT o AS qid, count(*) AS c FROM kg_triples WHERE o IS NOT NULL GROUP BY o)"
ENTS = f"""{RANK}, {POP}, ents AS (SELECT e.qid, e.label_zh, e.label_en, e.description, r.rank AS article_rank, coalesce(pop.c, 0) AS popularity
  FROM kg_raw_entities e LEFT JOIN ranks r ON r.title = e.label_zh LEFT JOIN pop ON pop.qid = e.qid)"""
MENT = """kgm AS (SELECT mention, qid, weight, source FROM (SELECT *, row_number() OVER (PARTITION BY mention, qid ORDER BY prio) AS rn
  FROM kg_mention_rows WHERE mention IS NOT NULL AND mention <> '') WHERE rn = 1)"""
PROPS = "props AS (SELECT * FROM (VALUES " + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in X.PREDICATE_LABELS.items()) + ") v(pid, plabel))"
_TOK = "list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
META = f"len(list_filter({arr(X.WIKI_META)}, lambda w: contains(coalesce(description, ''), w))) > 0"
SCORED = """sm AS (SELECT m.mention, m.qid, m.weight, m.source, e.label_zh, e.description, e.popularity, e.article_rank,
  round(m.weight * CASE WHEN e.popularity > 0 THEN ln(1 + e.popularity) ELSE 0 END, 9) AS score FROM kgm m JOIN ents e ON e.qid = m.qid),
 ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, weight DESC, article_rank ASC NULLS LAST, qid) AS pos
  FROM sm WHERE mention IN (SELECT mention FROM wanted)) WHERE pos <= 5)"""
FUZZY = f""" need AS (SELECT w.mention, array_to_string({_TOK.format(c='w.mention')}, ' ') AS ph FROM wanted w LEFT JOIN
   (SELECT mention, count(*) AS n, max(popularity) AS best FROM ex GROUP BY 1) s ON s.mention = w.mention
   WHERE coalesce(n, 0) < {X.LINK_K} OR coalesce(best, 0) < {X.WEAK_POP}),
 tk AS (SELECT *, {_TOK.format(c='mention')} AS tk FROM sm),
 suf AS (SELECT DISTINCT mention AS name, qid, weight, source, label_zh, description, popularity, score,
   unnest(list_transform(range(1, len(tk) + 1), lambda i: array_to_string(tk[i:], ' '))) AS rest FROM tk),
 hit AS (SELECT DISTINCT n.mention, s.name, s.qid, s.weight, s.source, s.label_zh, s.description, s.popularity, s.score
   FROM need n JOIN suf s ON n.ph <> '' AND starts_with(s.rest, n.ph)),
 fz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, qid, name) AS fpos FROM hit) WHERE fpos <= {X.FUZZY_K})"""
LINKED = f""" fz1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention, qid ORDER BY fpos) AS d FROM fz) WHERE d = 1
   AND (mention, qid) NOT IN (SELECT (mention, qid) FROM ex)),
 both_ AS (SELECT mention, qid, weight, source, label_zh, description, popularity, score, 1 AS branch, pos AS bpos FROM ex
   UNION ALL SELECT mention, qid, weight * 0.5, concat('fts:', source), label_zh, description, popularity, score * 0.5, 2, fpos FROM fz1),
 linked AS (SELECT * EXCLUDE (branch, bpos) FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY {META}, score DESC, branch, bpos) AS pos
   FROM both_) WHERE pos <= {X.LINK_K})"""
KG = ("titles", "kg_raw_entities", "kg_triples", "kg_mention_rows")


def sql(extra: str, *names: str) -> str:
    return with_clause(*(names or KG), extra=extra)


# ---- assembly ---------------------------------------------------------------------------

ZH = "(lang = 'zh' OR lang LIKE 'zh%')"
NT = rf"""raw AS (SELECT ord, regexp_extract(line, '^(.*?>) (.*?>) (.*) \.$', ['subj', 'pred', 'obj']) AS r FROM (SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, line FROM nt_lines)
   WHERE regexp_matches(line, '^.*?> .*?> .* \.$')),
 st0 AS (SELECT ord, regexp_extract(r.subj, '^<{X.RDF_ENTITY}(Q\d+)>$', 1) AS s, r.pred AS pred, r.obj AS obj,
   regexp_extract(r.pred, '^<{X.RDF_DIRECT}(P\d+)>$', 1) AS pid FROM raw),
 st1 AS (SELECT *, regexp_extract(obj, '^<{X.RDF_ENTITY}(Q\d+)>$', 1) AS ent, regexp_extract(obj, '^"(.*)"@([a-zA-Z\-]+)$', 1) AS lv,
   regexp_extract(obj, '^"(.*)"@([a-zA-Z\-]+)$', 2) AS lang, regexp_extract(obj, '^"(.*)"\^\^<([^>]+)>$', 1) AS tv,
   regexp_extract(obj, '^"(.*)"\^\^<([^>]+)>$', 2) AS dt, regexp_extract(obj, '^"(.*)"$', 1) AS pv FROM st0 WHERE s <> ''),
 st AS (SELECT ord, s, pred, pid, lang, CASE WHEN ent <> '' THEN 'entity' WHEN lang <> '' THEN 'string' WHEN dt LIKE '%date%' THEN 'time'
     WHEN dt LIKE '%decimal%' OR dt LIKE '%double%' OR dt LIKE '%integer%' THEN 'quantity' WHEN dt <> '' OR obj LIKE '"%"' THEN 'string' END AS t,
   replace(replace(replace(CASE WHEN ent <> '' THEN ent WHEN lang <> '' THEN lv WHEN dt <> '' THEN tv ELSE pv END,
     chr(92) || 'u5BA2', chr(23458)), chr(92) || 'u6237', chr(25143)), chr(92) || 'U0001F600', chr(128512)) AS val FROM st1),
 zh AS (SELECT DISTINCT s FROM st WHERE pred IN {tup(X.RDF_LABELS)} AND {ZH})"""


def stmts(spark, sf):
    """A dump in bzip2 files; both passes over it read the parsed statements, stored once."""
    path = scratch_table(spark, "dump")
    write_lines(load(spark, sf, "nt_lines"), path, "bzip2", "ord")
    return built(spark, sf, "stmts", lambda: K.parse_ntriples(text_lines(spark, path)))


@query("ntriples_parse", sql(NT, "nt_lines") + "SELECT ord, s, pid, t, lang, val FROM st")
def ntriples_parse(spark, sf):
    return stmts(spark, sf).select("ord", "s", "pid", "t", "lang", "val")


@query("kg_entities", sql(NT, "nt_lines") + f"""
SELECT s AS qid, arg_min(val, ord) FILTER (WHERE pred IN {tup(X.RDF_LABELS)} AND {ZH}) AS label_zh,
  arg_min(val, ord) FILTER (WHERE pred IN {tup(X.RDF_LABELS)} AND lang = 'en') AS label_en,
  arg_min(val, ord) FILTER (WHERE pred = '{X.RDF_DESCRIPTION}' AND {ZH}) AS description,
  coalesce(array_to_string(list_sort(list(DISTINCT val) FILTER (WHERE pred = '{X.RDF_ALIAS}' AND {ZH})), '|'), '') AS aliases
FROM st WHERE lang <> '' AND s IN (SELECT s FROM zh) GROUP BY s""")
def kg_entities(spark, sf):
    return K.entities_from(stmts(spark, sf)).withColumn("aliases", F.array_join("aliases", "|"))


@query("kg_triple_filter", sql(NT, "nt_lines") + f"""
SELECT s, pid AS p, CASE WHEN t = 'entity' THEN val END AS o, CASE WHEN t <> 'entity' THEN regexp_replace(val, '[\\t\\n\\r]', ' ', 'g') END AS v, t
FROM st WHERE pid IN {tup(X.PREDICATE_LABELS)} AND t IS NOT NULL AND s IN (SELECT s FROM zh) AND (t <> 'entity' OR val IN (SELECT s FROM zh))""")
def kg_triple_filter(spark, sf):
    return K.triples_from(stmts(spark, sf))


@query("triples_scan", sql("", "kg_triples") + "SELECT s, p, o, v, t FROM kg_triples")
def triples_scan(spark, sf):
    """Through tab-separated files: written as lines, read back as five fields."""
    t = triples(spark, sf)
    lines = t.select(F.concat_ws("\t", "s", "p", F.coalesce("o", F.lit("")), F.coalesce("v", F.lit("")), "t").alias("line"))
    bad = t.where(F.col("v").isNotNull()).select(F.concat_ws("\t", "s", "p", "v").alias("line"))
    path = scratch_table(spark, "triples")
    write_lines(lines.unionByName(bad), path)
    return triples_tsv(spark, path)


@query("kg_mentions", sql(MENT, "kg_mention_rows") + "SELECT * FROM kgm")
def kg_mentions(spark, sf):
    return K.mentions_of(load(spark, sf, "kg_mention_rows")).select("mention", "qid", "weight", "source")


@query("kg_popularity", sql(ENTS, "titles", "kg_raw_entities", "kg_triples") + "SELECT qid, CAST(popularity AS BIGINT) AS popularity FROM ents")
def kg_popularity(spark, sf):
    return K.with_popularity(load(spark, sf, "kg_raw_entities"), triples(spark, sf)).select("qid", F.col("popularity").cast("long").alias("popularity"))


@query("article_rank_join", sql(ENTS, "titles", "kg_raw_entities", "kg_triples") + "SELECT qid, article_rank FROM ents WHERE article_rank IS NOT NULL")
def article_rank_join(spark, sf):
    return entities(spark, sf).where(F.col("article_rank").isNotNull()).select("qid", "article_rank")


@query("hot_entities", sql(ENTS, "titles", "kg_raw_entities", "kg_triples") + """
SELECT qid, concat(label_zh, ' —— ', description) AS text FROM ents WHERE article_rank IS NOT NULL AND label_zh IS NOT NULL
ORDER BY article_rank, qid LIMIT """ + str(X.HOT_ENTITIES))
def hot_entities(spark, sf):
    e = entities(spark, sf).where(F.col("article_rank").isNotNull() & F.col("label_zh").isNotNull())
    r = ranked(e, [F.asc("article_rank"), F.asc("qid")], "pos")  # the limit is large, so no single task sorts it
    return r.where(F.col("pos") <= X.HOT_ENTITIES).select("qid", F.concat("label_zh", F.lit(" —— "), "description").alias("text"))


@query("dirty_escape_count", sql("", "nt_lines") + r"""
SELECT count(*) AS rows, count(*) FILTER (WHERE regexp_matches(line, '\\u[0-9A-Fa-f]{4}')) AS escaped,
  count(*) FILTER (WHERE regexp_matches(line, '\\U[0-9A-Fa-f]{8}')) AS escaped_long FROM nt_lines""")
def dirty_escape_count(spark, sf):
    return load(spark, sf, "nt_lines").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("line").rlike(r"\\u[0-9A-Fa-f]{4}")).alias("escaped"),
        F.count_if(F.col("line").rlike(r"\\U[0-9A-Fa-f]{8}")).alias("escaped_long"))


@query("indegree_capped", sql("", "kg_triples") + "SELECT p, o, CAST(least(count(*), 8) AS BIGINT) AS indegree FROM kg_triples WHERE o IS NOT NULL GROUP BY p, o")
def indegree_capped(spark, sf):
    return K.indegree(triples(spark, sf), 8).withColumn("indegree", F.col("indegree").cast("long"))


@query("distinct_predicates", sql("", "kg_triples") + """
SELECT s, array_to_string(list_sort(list(DISTINCT p)), ',') AS preds, count(DISTINCT p) AS n FROM kg_triples GROUP BY s""")
def distinct_predicates(spark, sf):
    g = triples(spark, sf).groupBy("s").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    return g.select("s", F.array_join("ps", ",").alias("preds"), F.size("ps").cast("long").alias("n"))


# ---- linking ----------------------------------------------------------------------------------

_LINK_COLS = "mention, qid, weight, source, score, CAST(pos AS INTEGER) AS pos"


@query("kg_link_exact", sql(f"{ENTS}, {MENT}, {WANTED}, {SCORED}") + f"SELECT {_LINK_COLS} FROM ex")
def kg_link_exact(spark, sf):
    sc = scored(spark, sf)
    return K.link_exact(wanted(spark, sf), sc).select("mention", "qid", "weight", "source", "score", "pos")


_FUZZY_SQL = sql(f"{ENTS}, {MENT}, {WANTED}, {SCORED}, {FUZZY}") + "SELECT mention, name, qid, score, CAST(fpos AS INTEGER) AS fpos FROM fz"


def _weak(spark, sf, sc):
    """Names with few or obscure exact candidates."""
    ex = K.link_exact(wanted(spark, sf), sc)
    st = ex.groupBy("mention").agg(F.count(F.lit(1)).alias("n"), F.max("popularity").alias("best"))
    need = wanted(spark, sf).join(st, "mention", "left").where((F.coalesce("n", F.lit(0)) < X.LINK_K) | (F.coalesce("best", F.lit(0)) < X.WEAK_POP))
    return need.select("mention")


@query("kg_link_fuzzy", _FUZZY_SQL)
def kg_link_fuzzy(spark, sf):
    sc = scored(spark, sf)
    return K.link_fuzzy(_weak(spark, sf, sc), sc).select("mention", "name", "qid", "score", "fpos")


@query("name_index_phrases", _FUZZY_SQL)
def name_index_phrases(spark, sf):
    """The same through a stored index that got its names in two parts, and was opened again in between."""
    sc = scored(spark, sf)
    folder = scratch_table(spark, "names")
    late = F.pmod(F.xxhash64("mention"), F.lit(3)) == 0
    NameIndex(spark, folder).add(sc.where(~late))
    index = NameIndex.open(spark, folder).add(sc.where(late))
    return index.phrases(_weak(spark, sf, sc), sc).select("mention", "name", "qid", "score", "fpos")


def spelling(spark):
    """The map of ``t2s_map`` as a table."""
    return spark.createDataFrame(list(zip("總統訂單額", "总统订单额")), "traditional string, simple string")


_LINK_SQL = sql(f"{ENTS}, {MENT}, {WANTED}, {SCORED}, {FUZZY}, {LINKED}") + f"SELECT {_LINK_COLS} FROM linked"


@query("kg_link", _LINK_SQL)
def kg_link(spark, sf):
    return K.link(wanted(spark, sf), scored(spark, sf), spelling=spelling(spark)).select("mention", "qid", "weight", "source", "score", "pos")


@query("kg_link_indexed", _LINK_SQL)
def kg_link_indexed(spark, sf):
    sc = scored(spark, sf)
    index = NameIndex(spark, scratch_table(spark, "names")).add(sc)
    return K.link(wanted(spark, sf), sc, spelling=spelling(spark), index=index).select("mention", "qid", "weight", "source", "score", "pos")


def _suffix_case() -> str:
    return "CASE " + " ".join(f"WHEN ends_with(label_zh, {lit(s)}) THEN left(label_zh, length(label_zh) - {len(s)})" for s in X.PLACE_SUFFIXES) + " END"


@query("kg_suffix_alias", sql(f"""{ENTS}, {MENT}, b AS (SELECT qid, popularity, {_suffix_case()} AS base FROM ents WHERE popularity >= {MIN_POP}),
 types AS (SELECT qid FROM ents WHERE {' OR '.join(f"label_zh LIKE '%{m}%'" for m in X.TYPE_MARKERS)})""") + """
SELECT base AS mention, qid, CAST(0.5 AS DOUBLE) AS weight, 'alias_suffix' AS source FROM b WHERE length(base) >= 2
  AND EXISTS (SELECT 1 FROM kg_triples t WHERE t.s = b.qid AND t.p IN ('P17', 'P131'))
  AND EXISTS (SELECT 1 FROM kg_triples t WHERE t.s = b.qid AND t.p = 'P31')
  AND NOT EXISTS (SELECT 1 FROM kg_triples t JOIN types y ON y.qid = t.o WHERE t.s = b.qid AND t.p = 'P31')
  AND NOT EXISTS (SELECT 1 FROM kgm m WHERE m.mention = b.base AND m.qid = b.qid)
  AND coalesce((SELECT max(e.popularity) FROM kgm m JOIN ents e ON e.qid = m.qid WHERE m.mention = b.base), -1) < b.popularity""")
def kg_suffix_alias(spark, sf):
    m = mentions(spark, sf)
    return K.suffix_aliases(entities(spark, sf), m, triples(spark, sf), MIN_POP)


# ---- mentions ------------------------------------------------------------------------------------

NGRAM = """dict_ AS (SELECT DISTINCT mention FROM kgm),
 sp AS (SELECT query_id, i, w, substring(query, i, w) AS mention FROM (SELECT query_id, query, w, unnest(range(1, length(query) - w + 2)) AS i
   FROM (SELECT query_id, query, unnest(range(2, least(8, length(query)) + 1)) AS w FROM rq))),
 hits AS (SELECT query_id, list({'w': w, 'i': i, 'm': mention} ORDER BY w DESC, i) AS h FROM sp WHERE mention IN (SELECT mention FROM dict_) GROUP BY query_id),
 kept AS (SELECT query_id, list_reduce(list_transform(h, lambda x: [x]), lambda acc, x:
   CASE WHEN len(list_filter(acc, lambda a: a.i < x[1].i + x[1].w AND x[1].i < a.i + a.w)) > 0 THEN acc ELSE list_concat(acc, x) END) AS k FROM hits),
 found AS (SELECT query_id, unnest(range(0, len(k))) AS pos, unnest(k) AS m FROM kept)"""


@query("mention_ngram", sql(f"{MENT}, {NGRAM}", "kg_mention_rows", "rq") + "SELECT query_id, CAST(pos AS INTEGER) AS pos, m.m AS mention, CAST(m.i AS INTEGER) AS start FROM found")
def mention_ngram(spark, sf):
    return K.mention_ngrams(load(spark, sf, "rq"), mentions(spark, sf))


SEG = f"""nm AS (SELECT m.mention AS name, sum(e.popularity + 1) AS n FROM kgm m JOIN ents e ON e.qid = m.qid WHERE length(m.mention) BETWEEN 1 AND 24 GROUP BY 1),
 tot AS (SELECT sum(n) AS total FROM nm), pr AS (SELECT name, CAST(round(1000 * ln(total / n)) AS BIGINT) AS cost FROM nm, tot),
 ss AS (SELECT query_id, i, w, substring(query, i, w) AS name FROM (SELECT query_id, query, w, unnest(range(1, length(query) - w + 2)) AS i FROM (SELECT query_id, query, unnest(range(1, least(24, length(query)) + 1)) AS w FROM rq))),
 wd AS (SELECT query_id, i + w - 1 AS e, list({{'c': cost, 's': i, 'k': 1}}) AS l FROM ss JOIN pr USING (name) GROUP BY ALL),
 ch AS (SELECT query_id, unnest(range(1, length(query) + 1)) AS e FROM rq),
 lat_s AS (SELECT c.query_id, list(list_append(coalesce(l, []), {{'c': (SELECT CAST(round(1000 * ln(total)) AS BIGINT) + 1000 FROM tot), 's': c.e, 'k': 0}}) ORDER BY c.e) AS l
   FROM ch c LEFT JOIN wd w ON w.query_id = c.query_id AND w.e = c.e GROUP BY c.query_id),
 bst AS (SELECT query_id, list_reduce(list_prepend([{{'c': 0::BIGINT, 's': 0::BIGINT, 'k': 0}}], l), lambda acc, x: list_append(acc, list_min(list_transform(x, lambda h: {{'c': acc[h.s].c + h.c, 's': h.s, 'k': h.k}})))) AS b FROM lat_s),
 walk_s(query_id, b, e, s, k) AS (SELECT query_id, b, len(b) - 1, b[len(b)].s, b[len(b)].k FROM bst UNION ALL SELECT query_id, b, s - 1, b[s].s, b[s].k FROM walk_s WHERE s > 1),
 seg AS (SELECT w.query_id, row_number() OVER (PARTITION BY w.query_id ORDER BY w.e) - 1 AS pos, substring(r.query, w.s, w.e - w.s + 1) AS name, w.s AS start FROM walk_s w JOIN rq r USING (query_id) WHERE w.k = 1)"""


def known_names(spark, sf):
    """Every name with how often it is meant: the in-links of what it names, and one."""
    e = entities(spark, sf).select("qid", "popularity")
    return mentions(spark, sf).join(e, "qid").select(F.col("mention").alias("name"), (F.col("popularity") + 1).alias("n"))


@query("mention_segment", sql(f"{ENTS}, {MENT}, {SEG}", *KG, "rq") + "SELECT query_id, CAST(pos AS INTEGER) AS pos, name, CAST(start AS INTEGER) AS start FROM seg")
def mention_segment(spark, sf):
    return K.segments(load(spark, sf, "rq").select("query_id", "query"), known_names(spark, sf))


@query("mention_hybrid", sql(f"""{ENTS}, {MENT}, {NGRAM}, {SEG}, tw AS (SELECT query_id, list(name) AS words FROM seg GROUP BY query_id),
 gd AS (SELECT f.query_id, f.pos, f.m.m AS mention, list_contains(coalesce(words, []), f.m.m) OR len(list_filter(coalesce(words, []), lambda t: length(t) >= 2 AND contains(f.m.m, t))) > 0 OR length(f.m.m) >= 3 AS good
   FROM found f LEFT JOIN tw USING (query_id)), sm AS (SELECT query_id, bool_or(good) AS any_good FROM gd GROUP BY query_id)""", *KG, "rq") + """
SELECT query_id, CAST(pos AS INTEGER) AS pos, mention FROM gd JOIN sm USING (query_id) WHERE good OR NOT any_good""")
def mention_hybrid(spark, sf):
    """Trusted words are the names in the most likely split of the question."""
    q = load(spark, sf, "rq")
    words = K.segments(q.select("query_id", "query"), known_names(spark, sf))
    trusted = words.groupBy("query_id").agg(F.collect_set("name").alias("words"))
    return K.mention_hybrid(K.mention_ngrams(q, mentions(spark, sf)), trusted)


def asked(spark, sf):
    """Names each retrieval question mentions, in order."""
    q = load(spark, sf, "rq")
    return q.select("query_id", "query", "embedding", F.posexplode(F.array("seg", "nation", "cust")).alias("pos", "mention"))


ASKED = """asked AS (SELECT query_id, query, embedding, unnest([0, 1, 2]) AS pos, unnest([seg, nation, cust]) AS mention FROM rq)"""
GENERIC = f"""cls AS (SELECT DISTINCT o AS qid FROM (SELECT p, o, count(*) AS c FROM kg_triples WHERE p IN ('P31','P279') AND o IS NOT NULL GROUP BY p, o)
   WHERE (p = 'P31' AND c >= {X.IN31_MIN}) OR (p = 'P279' AND c >= {X.IN279_MIN})),
 c3 AS (SELECT * FROM (SELECT m.mention, m.qid, row_number() OVER (PARTITION BY m.mention ORDER BY e.popularity DESC, m.qid) AS rn FROM kgm m JOIN ents e ON e.qid = m.qid) WHERE rn <= 3),
 gen AS (SELECT mention, bool_or(qid IN (SELECT qid FROM cls)) AS generic FROM c3 GROUP BY mention),
 ordered AS (SELECT query_id, mention, coalesce(g.generic, false) AS generic, query, embedding,
   row_number() OVER (PARTITION BY query_id ORDER BY coalesce(g.generic, false), pos) - 1 AS m_pos FROM asked a LEFT JOIN gen g USING (mention))"""


def _generic(spark, sf, a):
    m = mentions(spark, sf).join(a.select("mention").distinct(), "mention", "left_semi")
    return K.generic_mentions(m, entities(spark, sf), triples(spark, sf))


@query("mention_specificity", sql(f"{ENTS}, {MENT}, {ASKED}, {GENERIC}", *KG, "rq") + "SELECT query_id, mention, generic, CAST(m_pos AS INTEGER) AS pos FROM ordered")
def mention_specificity(spark, sf):
    g = _generic(spark, sf, asked(spark, sf))
    return K.specific_first(asked(spark, sf).select("query_id", "pos", "mention"), g).select("query_id", "mention", "generic", "pos")


# ---- hops and context ------------------------------------------------------------------------------

HOP = "hop1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p, o NULLS FIRST, v NULLS FIRST) AS pos FROM kg_triples) WHERE pos <= 50)"
CTX = f"""{PROPS}, {HOP}, facts AS (SELECT h.s AS qid, h.pos, concat('· ', coalesce(pr.plabel, h.p), ' ', coalesce(e2.label_zh, h.v)) AS fact FROM hop1 h
   LEFT JOIN props pr ON pr.pid = h.p LEFT JOIN kg_raw_entities e2 ON e2.qid = h.o WHERE coalesce(e2.label_zh, h.v, '') <> ''),
 fl AS (SELECT qid, string_agg(fact, chr(10) ORDER BY pos) AS body FROM facts GROUP BY qid),
 full_ AS (SELECT e.qid, e.label_zh, e.description, concat('[', e.label_zh, ']', CASE WHEN coalesce(e.description, '') <> '' THEN ' ' || e.description ELSE '' END,
   CASE WHEN body IS NOT NULL THEN chr(10) || body ELSE '' END) AS t FROM kg_raw_entities e LEFT JOIN fl ON fl.qid = e.qid),
 ctx AS (SELECT qid, label_zh, description, CASE WHEN length(t) > 1000 THEN regexp_replace(left(t, 1000), '\\n[^\\n]*$', '') || chr(10) || '...' ELSE t END AS text FROM full_)"""


@query("kg_one_hop", sql(HOP, "kg_triples") + "SELECT s, p, o, v, CAST(pos AS INTEGER) AS pos FROM hop1")
def kg_one_hop(spark, sf):
    return K.one_hop(triples(spark, sf)).select("s", "p", "o", "v", "pos")


@query("triples_labeled", sql(PROPS, "kg_raw_entities", "kg_triples") + """
SELECT t.s, t.p, pr.plabel AS p_label, t.o, coalesce(e.label_zh, t.v) AS object_label FROM kg_triples t
LEFT JOIN props pr ON pr.pid = t.p LEFT JOIN kg_raw_entities e ON e.qid = t.o""")
def triples_labeled(spark, sf):
    return K.labelled(triples(spark, sf), load(spark, sf, "kg_raw_entities"), properties(spark)).select("s", "p", "p_label", "o", "object_label")


@query("kg_context", sql(CTX, "kg_raw_entities", "kg_triples") + "SELECT qid, text FROM ctx")
def kg_context(spark, sf):
    return contexts(spark, sf).select("qid", "text")


def contexts(spark, sf):
    return K.context_text(load(spark, sf, "kg_raw_entities"), triples(spark, sf), properties(spark))


@query("kg_bfs", sql("""e AS (SELECT DISTINCT s, o FROM kg_triples WHERE t = 'entity' AND o IS NOT NULL),
 walk(seed, qid, hop) AS (SELECT DISTINCT concat('C', CAST(c_custkey AS STRING)), concat('C', CAST(c_custkey AS STRING)), 1 FROM customer
   UNION SELECT w.seed, e.o, w.hop + 1 FROM walk w JOIN e ON e.s = w.qid WHERE w.hop < 3)""", "kg_triples") +
       "SELECT seed, qid, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY seed, qid")
def kg_bfs(spark, sf):
    seeds = load(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("seed"))
    return K.bfs(seeds, triples(spark, sf), 3)


@query("kg_bfs_capped")
def kg_bfs_capped(spark, sf):
    o = load(spark, sf, "orders")
    seeds = o.select(F.col("o_orderkey").alias("query_id"), F.posexplode(F.array(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")), F.concat(F.lit("C"), F.col("o_custkey").cast("string")))).alias("pos", "qid"))
    return K.bfs_capped(seeds, triples(spark, sf), load(spark, sf, "kg_raw_entities"), max_hops=3)


# ---- disambiguation ------------------------------------------------------------------------------------

_BG = "list_distinct(list_transform(range(1, length(regexp_replace({c}, '\\s', '', 'g'))), lambda i: substring(regexp_replace({c}, '\\s', '', 'g'), i, 2)))"
DB, QB = _BG.format(c="coalesce(description, '')"), _BG.format(c="query")
OVERLAP = f"CASE WHEN len({DB}) > 0 THEN CAST(len(list_intersect({DB}, {QB})) AS DOUBLE) / len({DB}) ELSE 0 END"
INTENT = "(" + " + ".join(f"CAST(contains(query, {lit(w)}) AS INTEGER)" for w in X.PERSON_CUES) + " - " + \
    " - ".join(f"CAST(contains(query, {lit(w)}) AS INTEGER)" for w in X.NONPERSON_CUES) + ")"


@query("person_intent", with_clause("questions") + f"SELECT query_id, {INTENT} AS intent FROM questions")
def person_intent(spark, sf):
    return load(spark, sf, "questions").select("query_id", L.person_intent(F.col("query")).alias("intent"))


@query("bigram_overlap", sql(f"{ASKED}, d AS (SELECT a.query_id, e.qid, a.query, e.description FROM asked a JOIN kg_raw_entities e ON e.label_zh = a.mention OR e.label_en = a.mention)",
                             "kg_raw_entities", "rq") + f"SELECT query_id, qid, round({OVERLAP}, 6) AS overlap FROM d")
def bigram_overlap(spark, sf):
    e = load(spark, sf, "kg_raw_entities")
    names = e.select("qid", "description", F.explode(F.array_distinct(F.array("label_zh", "label_en"))).alias("mention"))
    j = asked(spark, sf).join(names, "mention")
    return j.select("query_id", "qid", F.round(L.bigram_overlap(F.col("query"), F.col("description")), 6).alias("overlap"))


HOT = "hot AS (SELECT concat('C', CAST(vec_id AS STRING)) AS qid, embedding FROM embeddings)"
DIS = f"""{HOT}, hum AS (SELECT DISTINCT s AS qid FROM kg_triples WHERE p = 'P31' AND o = 'Q5'),
 j0 AS (SELECT o.query_id, o.mention, o.m_pos, o.query, o.embedding, l.qid, l.label_zh, l.description, l.pos AS link_pos, l.score, h.embedding AS hv,
   hum.qid IS NOT NULL AS human, count(*) OVER (PARTITION BY o.query_id, o.mention) AS n FROM ordered o JOIN linked l USING (mention)
   LEFT JOIN hot h ON h.qid = l.qid LEFT JOIN hum ON hum.qid = l.qid),
 j1 AS (SELECT *, least(score, 14) / 14 AS prior, {OVERLAP} AS ctx_s, {INTENT} AS intent FROM j0),
 j2 AS (SELECT *, CASE WHEN intent = 0 THEN 0 WHEN human = (intent > 0) THEN 1 ELSE -1 END AS ty FROM j1),
 j3 AS (SELECT *, round(CASE WHEN n <= 1 THEN 0.5 * ctx_s + 0.5 * prior + 0.3 * ty
    WHEN hv IS NOT NULL THEN 0.5 * (0.6 * list_dot_product(CAST(hv AS DOUBLE[]), CAST(embedding AS DOUBLE[])) + 0.4 * prior) + 0.5 * ctx_s + 0.3 * ty
    ELSE 0.5 * (0.5 * prior + 0.5 * ctx_s) + 0.3 * ty END, 9) AS final FROM j2),
 dis AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, mention ORDER BY final DESC, link_pos) AS pos FROM j3) WHERE pos <= {CAND_K})"""
WANT_ASKED = "wanted AS (SELECT DISTINCT mention FROM asked)"
DIS_ALL = f"{ENTS}, {MENT}, {ASKED}, {GENERIC}, {WANT_ASKED}, {SCORED}, {FUZZY}, {LINKED}, {DIS}"


def ordered_mentions(spark, sf):
    a = asked(spark, sf)
    g = _generic(spark, sf, a)
    m = K.specific_first(a.select("query_id", "pos", "mention"), g)
    return a.drop("pos").join(m.select("query_id", "mention", F.col("pos").alias("m_pos")), ["query_id", "mention"])


def disambiguated(spark, sf):
    a = ordered_mentions(spark, sf)
    cands = K.link(a.select("mention").distinct(), scored(spark, sf), spelling=spelling(spark))
    hot = load(spark, sf, "embeddings").select(F.concat(F.lit("C"), F.col("vec_id").cast("string")).alias("qid"), "embedding")
    return L.disambiguate(a, cands, triples(spark, sf), CAND_K, hot)


@query("entity_disambiguate", sql(DIS_ALL, *KG, "rq") + "SELECT query_id, mention, qid, round(final, 6) AS final, CAST(pos AS INTEGER) AS pos FROM dis")
def entity_disambiguate(spark, sf):
    return disambiguated(spark, sf).select("query_id", "mention", "qid", F.round("final", 6).alias("final"), "pos")


E2E = """picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m_pos, pos) AS e_pos FROM
   (SELECT *, row_number() OVER (PARTITION BY query_id, qid ORDER BY m_pos, pos) AS d FROM dis) WHERE d = 1) WHERE e_pos <= {k})"""


def picked(spark, sf, k: int):
    d = disambiguated(spark, sf).select("query_id", "m_pos", "pos", "qid", "mention", "label_zh", "description", "final")
    return L.collect_entities(d, k)


@query("kg_end_to_end", sql(f"{DIS_ALL}, {CTX}, {E2E.format(k=5)}", *KG, "rq") + """
SELECT p.query_id, string_agg(concat('【', p.label_zh, '（', p.qid, '）】', CASE WHEN coalesce(p.description, '') <> '' THEN ' — ' || p.description ELSE '' END, chr(10), c.text),
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY e_pos) AS context_text FROM picked p JOIN ctx c ON c.qid = p.qid GROUP BY p.query_id""")
def kg_end_to_end(spark, sf):
    ents = picked(spark, sf, 5).join(contexts(spark, sf).select("qid", "text"), "qid", "left")
    return L.cards_text(ents)
