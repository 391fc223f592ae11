"""Knowledge graph: assembly, popularity, linking, expansion, context text.

Frames: entities (qid, label_zh, label_en, description, article_rank,
popularity), mentions (mention, qid, weight, source), triples (s, p, o, v, t).
Triples of one subject are ordered by (p, o, v), which replaces the insertion
order of a single writer.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina import fixed as X
from lamina.functions.text import U, any_of, has_any
from lamina.operators.ranking import first_per_key, top_k
from lamina.session import cut



def triple_order() -> list[Column]:
    return [F.asc("p"), F.asc_nulls_first("o"), F.asc_nulls_first("v")]


# ---- N-Triples ----------------------------------------------------------------


def unescape(c: Column) -> Column:
    r"""Decode \uXXXX and \UXXXXXXXX in place; surrogates stay as written. Only
    rows that hold an escape go through Python."""
    pat = re.compile(r"\\U([0-9A-Fa-f]{8})|\\u([0-9A-Fa-f]{4})")

    def one(m):
        cp = int(m.group(1) or m.group(2), 16)
        return m.group(0) if 0xD800 <= cp <= 0xDFFF or cp > 0x10FFFF else chr(cp)

    @F.pandas_udf(T.StringType())
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v if v is None or "\\" not in v else pat.sub(one, v))

    return decode(c)


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """``lines`` (ord, line) -> one row per well-formed statement about an entity."""
    shape = r"^(.*?>) (.*?>) (.*) \.\r?$"
    d = lines.where(F.col("line").rlike(shape)).select(
        "ord", *[F.regexp_extract("line", shape, i).alias(n) for i, n in ((1, "subj"), (2, "pred"), (3, "obj"))])
    d = d.withColumn("s", F.regexp_extract("subj", f"^<{X.RDF_ENTITY}(Q[0-9]+)>$", 1)).where(F.col("s") != "")
    obj = F.col("obj")
    ent = F.regexp_extract(obj, f"^<{X.RDF_ENTITY}(Q[0-9]+)>$", 1)
    lang_val, lang = (F.regexp_extract(obj, r'^"(.*)"@([a-zA-Z\-]+)$', i) for i in (1, 2))
    typed_val, dtype = (F.regexp_extract(obj, r'^"(.*)"\^\^<([^>]+)>$', i) for i in (1, 2))
    plain = F.regexp_extract(obj, r'^"(.*)"$', 1)
    kind = (
        F.when(ent != "", "entity").when(lang != "", "string")
        .when(F.contains(dtype, F.lit("date")), "time")
        .when(has_any(dtype, ("decimal", "double", "integer")), "quantity")
        .when((dtype != "") | obj.rlike(r'^".*"$'), "string")
    )
    raw = F.when(ent != "", ent).when(lang != "", lang_val).when(dtype != "", typed_val).otherwise(plain)
    d = d.select("ord", "s", "pred", F.regexp_extract("pred", f"^<{X.RDF_DIRECT}(P[0-9]+)>$", 1).alias("pid"),
                 kind.alias("t"), lang.alias("lang"), raw.alias("raw"))
    plain_rows = d.where(~F.contains("raw", F.lit("\\")))
    escaped = d.where(F.contains("raw", F.lit("\\"))).withColumn("raw", unescape(F.col("raw")))
    return plain_rows.unionByName(escaped).withColumnRenamed("raw", "val")


def is_zh(lang: Column) -> Column:
    return F.startswith(lang, F.lit("zh"))


def zh_subjects(stmts: DataFrame) -> DataFrame:
    return stmts.where(F.col("pred").isin(*X.RDF_LABELS) & is_zh(F.col("lang"))).select("s").distinct()


def entities_from(stmts: DataFrame) -> DataFrame:
    """First zh label, first en label, first zh description, all zh aliases."""
    st = stmts.join(zh_subjects(stmts), "s", "left_semi")
    lab, zh = F.col("pred").isin(*X.RDF_LABELS), is_zh(F.col("lang"))
    first = lambda cond: F.min(F.when(cond, F.struct("ord", "val")))["val"]
    return st.where(F.col("lang") != "").groupBy(F.col("s").alias("qid")).agg(
        first(lab & zh).alias("label_zh"), first(lab & (F.col("lang") == "en")).alias("label_en"),
        first((F.col("pred") == X.RDF_DESCRIPTION) & zh).alias("description"),
        F.array_sort(F.collect_set(F.when((F.col("pred") == X.RDF_ALIAS) & zh, F.col("val")))).alias("aliases"))


def triples_from(stmts: DataFrame, predicates=tuple(X.PREDICATE_LABELS)) -> DataFrame:
    """Whitelisted statements of zh subjects; entity objects must be zh too."""
    zh = zh_subjects(stmts)
    st = stmts.where(F.col("pid").isin(*predicates) & F.col("t").isNotNull()).join(zh, "s", "left_semi")
    ents = st.where(F.col("t") == "entity").join(zh.withColumnRenamed("s", "val"), "val", "left_semi")
    lits = st.where(F.col("t") != "entity").withColumn("val", F.regexp_replace("val", "[\t\n\r]", " "))
    none = F.lit(None).cast("string")
    return ents.select("s", F.col("pid").alias("p"), F.col("val").alias("o"), none.alias("v"), "t").unionByName(
        lits.select("s", F.col("pid").alias("p"), none.alias("o"), F.col("val").alias("v"), "t"))


# ---- tables --------------------------------------------------------------------


def popularity(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("o").isNotNull()).groupBy(F.col("o").alias("qid")).agg(F.count(F.lit(1)).alias("popularity"))


def with_popularity(entities: DataFrame, triples: DataFrame) -> DataFrame:
    return entities.join(popularity(triples), "qid", "left").withColumn("popularity", F.coalesce("popularity", F.lit(0)))


def mentions_of(rows: DataFrame) -> DataFrame:
    """One row per (mention, qid): the strongest kind of name wins."""
    return first_per_key(rows.where(F.col("mention").isNotNull() & (F.col("mention") != "")), ["mention", "qid"], ["prio"]).drop("prio")


def link_score(weight: Column, pop: Column) -> Column:
    return F.round(weight * F.when(pop > 0, F.log(1 + pop)).otherwise(0.0), 9)


def scored_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    e = entities.select("qid", "label_zh", "description", "popularity", "article_rank")
    return mentions.join(e, "qid").withColumn("score", link_score(F.col("weight"), F.col("popularity")))


def exact_order() -> list[Column]:
    return [F.desc("score"), F.desc("weight"), F.asc_nulls_last("article_rank"), F.asc("qid")]


def link_exact(wanted: DataFrame, scored: DataFrame, k: int = X.LINK_K) -> DataFrame:
    """``wanted`` (mention). The semi join only drops rows, and a name shared by
    millions is cut to k rows on the map side."""
    asked = scored.join(wanted.distinct(), "mention", "left_semi")
    return top_k(asked, ["mention"], exact_order(), k, rank="pos")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), U + r"[^\p{L}\p{N}]+"), lambda t: t != "")


def phrase(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def link_fuzzy(wanted: DataFrame, scored: DataFrame, k: int = X.FUZZY_K) -> DataFrame:
    """Names that contain the mention as a phrase whose last word may be cut
    short. Every prefix from a token start is a join key; prefixes nobody asks
    for leave at the semi join, and each keeps its k best rows before joining."""
    q = wanted.distinct().withColumn("prefix", phrase(F.col("mention"))).where(F.col("prefix") != "")
    toks = tokens(F.col("mention"))
    starts = F.transform(F.sequence(F.lit(1), F.size(toks)), lambda i: F.array_join(F.slice(toks, i, F.size(toks)), " "))
    rows = scored.where(F.size(toks) > 0).select("*", F.explode(starts).alias("rest"))
    lens = q.agg(F.collect_set(F.length("prefix")).alias("lens"))  # one row, as many numbers as the longest phrase has letters
    # most names share no beginning with anything asked for and leave before they are expanded
    head = lambda c: F.substring(F.col(c), F.lit(1), F.array_min("lens"))
    heads = q.join(F.broadcast(lens)).select(head("prefix").alias("head")).distinct()
    rows = rows.join(F.broadcast(lens)).withColumn("head", head("rest")).join(heads, "head", "left_semi").drop("head")
    rows = rows.withColumn("prefix", F.explode(F.transform(
        F.filter("lens", lambda n: n <= F.length("rest")), lambda n: F.substring(F.col("rest"), F.lit(1), n)))).drop("rest", "lens")
    rows = rows.join(q.select("prefix").distinct(), "prefix", "left_semi")
    rows = first_per_key(rows.withColumnRenamed("mention", "name"), ["prefix", "name", "qid"], ["score"])
    best = top_k(rows, ["prefix"], [F.desc("score"), F.asc("qid"), F.asc("name")], k, rank="fpos")
    return best.join(q, "prefix").drop("prefix")


def is_meta(desc: Column) -> Column:
    return F.coalesce(has_any(desc, X.WIKI_META), F.lit(False))


def simplified(wanted: DataFrame, spelling: DataFrame) -> DataFrame:
    """The mentions that ``spelling`` (traditional, simple: one character each)
    changes, with their new form. The map has one row per character."""
    first = spelling.groupBy("traditional").agg(F.min("simple").alias("simple"))
    whole = first.agg(F.map_from_entries(F.collect_list(F.struct("traditional", "simple"))).alias("map"))
    chars = F.transform(F.split("mention", ""), lambda x: F.coalesce(F.try_element_at("map", x), x))
    out = wanted.select("mention").distinct().join(F.broadcast(whole)).select("mention", F.array_join(chars, "").alias("simple"))
    return out.where(F.col("simple") != F.col("mention"))


def link_simplified(wanted: DataFrame, scored: DataFrame, spelling: DataFrame, exact: DataFrame, k: int = X.LINK_K) -> DataFrame:
    """Exact names of the simplified mentions at 0.9 of their weight and score, without the ids that ``exact`` has."""
    s = cut(simplified(wanted, spelling))
    found = link_exact(s.select(F.col("simple").alias("mention")), scored, k).withColumnRenamed("mention", "simple").join(s, "simple")
    new = found.join(exact.select("mention", "qid"), ["mention", "qid"], "left_anti")
    new = first_per_key(new.select("mention", "qid", "pos", "weight", "source", "label_zh", "description", "popularity", "score"), ["mention", "qid"], ["pos"])
    return new.withColumns({"weight": F.col("weight") * 0.9, "score": F.col("score") * 0.9, "source": F.concat(F.lit("t2s:"), "source")})


def link(wanted: DataFrame, scored: DataFrame, k: int = X.LINK_K, weak: int = X.WEAK_POP, spelling: DataFrame | None = None, index=None) -> DataFrame:
    """Candidates per mention: exact names first, with those of its simplified
    spelling when a map is given (``spelling``: traditional, simple); names found
    by prefix at half weight when these are few or obscure; pages about pages go
    last. ``scored`` is the stored output of ``scored_mentions``; ``index``, a
    ``NameIndex`` of its names, spares expanding them."""
    cols = ["mention", "qid", "weight", "source", "label_zh", "description", "popularity", "score"]
    ex = cut(link_exact(wanted, scored, k))  # k rows per asked name, read four times below
    ex = ex.select(*cols, F.lit(0).alias("retry"), "pos")
    if spelling is not None:
        again = link_simplified(wanted, scored, spelling, ex, k)
        ex = cut(ex.unionByName(again.select(*cols, F.lit(1).alias("retry"), "pos")))  # at most 2 k rows per asked name
    stats = ex.groupBy("mention").agg(F.count(F.lit(1)).alias("n"), F.max("popularity").alias("best"))
    need = wanted.distinct().join(stats, "mention", "left").where(
        (F.coalesce("n", F.lit(0)) < k) | (F.coalesce("best", F.lit(0)) < weak)).select("mention")
    fz = link_fuzzy(need, scored) if index is None else index.phrases(need, scored)
    fz = first_per_key(fz.select("mention", "qid", "fpos", "weight", "source", "label_zh", "description", "popularity", "score"),
                       ["mention", "qid"], ["fpos"])
    fz = fz.join(ex.select("mention", "qid"), ["mention", "qid"], "left_anti").select(
        "mention", "qid", (F.col("weight") * 0.5).alias("weight"), F.concat(F.lit("fts:"), "source").alias("source"),
        "label_zh", "description", "popularity", (F.col("score") * 0.5).alias("score"), F.lit(2).alias("branch"), F.lit(0).alias("retry"), F.col("fpos").alias("bpos"))
    both = ex.select(*cols, F.lit(1).alias("branch"), "retry", F.col("pos").alias("bpos")).unionByName(fz)
    order = [is_meta(F.col("description")).asc(), F.desc("score"), F.asc("branch"), F.asc("retry"), F.asc("bpos")]
    return top_k(both, ["mention"], order, k, rank="pos").select(*cols, "pos")


# ---- suffix aliases -----------------------------------------------------------------


def suffix_aliases(entities: DataFrame, mentions: DataFrame, triples: DataFrame, min_pop: int = X.SUFFIX_MIN_POP) -> DataFrame:
    """Short names of well-known places: the label without its first matching
    administrative suffix, unless a stronger entity already owns that name."""
    label, out = F.col("label_zh"), None
    for s in X.PLACE_SUFFIXES:
        hit = F.endswith(label, F.lit(s))
        out = F.when(hit, F.expr(f"left(label_zh, length(label_zh) - {len(s)})")) if out is None else \
            out.when(hit, F.expr(f"left(label_zh, length(label_zh) - {len(s)})"))
    base = entities.where(F.col("popularity") >= min_pop).withColumn("base", out).where(F.length("base") >= 2)
    base = base.select("qid", "base", "popularity")
    types = entities.where(has_any(label, X.TYPE_MARKERS)).select(F.col("qid").alias("o"))
    placed = triples.where(F.col("p").isin("P17", "P131")).select(F.col("s").alias("qid"))
    p31 = triples.where(F.col("p") == "P31").select(F.col("s").alias("qid"), "o")
    ok = base.join(placed, "qid", "left_semi").join(p31.select("qid"), "qid", "left_semi")
    ok = ok.join(p31.join(types, "o", "left_semi").select("qid"), "qid", "left_anti")
    ok = ok.join(mentions.select(F.col("mention").alias("base"), "qid"), ["base", "qid"], "left_anti")
    names = mentions.join(ok.select(F.col("base").alias("mention")).distinct(), "mention", "left_semi")
    rival = names.join(entities.select("qid", "popularity"), "qid").groupBy(F.col("mention").alias("base")).agg(
        F.max("popularity").alias("rival"))
    ok = ok.join(rival, "base", "left").where(F.col("rival").isNull() | (F.col("rival") < F.col("popularity")))
    return ok.select(F.col("base").alias("mention"), "qid", F.lit(X.SUFFIX_WEIGHT).alias("weight"), F.lit("alias_suffix").alias("source"))


# ---- mentions in a question ----------------------------------------------------------


def mention_ngrams(queries: DataFrame, mentions: DataFrame, max_span: int = 8) -> DataFrame:
    """Longest known names first, left to right, without overlap."""
    n = F.length("query")
    spans = F.flatten(F.transform(F.sequence(F.least(F.lit(max_span), n), F.lit(2), F.lit(-1)), lambda w: F.transform(
        F.sequence(F.lit(1), n - w + 1), lambda i: F.struct((-w).alias("neg"), i.alias("i"), F.substring(F.col("query"), i, w).alias("mention")))))
    rows = queries.where(n >= 2).select("query_id", F.explode(spans).alias("x")).select("query_id", "x.*")
    known = rows.join(mentions.select("mention").distinct(), "mention", "left_semi")
    hits = known.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("neg", "i", "mention"))).alias("hits"))
    empty = F.filter("hits", lambda h: F.lit(False))
    clash = lambda a, b: (a["i"] < b["i"] - b["neg"]) & (b["i"] < a["i"] - a["neg"])
    kept = F.aggregate("hits", empty, lambda acc, h: F.when(F.exists(acc, lambda a: clash(a, h)), acc).otherwise(F.array_append(acc, h)))
    return hits.select("query_id", F.posexplode(kept).alias("pos", "h")).select(
        "query_id", "pos", F.col("h.mention").alias("mention"), F.col("h.i").alias("start"))


def segments(queries: DataFrame, names: DataFrame, max_span: int = 24) -> DataFrame:
    """The most likely split of each question into known names and single characters. ``queries`` (query_id, query), ``names``
    (name, n: how often it is meant). A name costs 1000 ln(total / n), a character that is no name 1000 ln(total) + 1000,
    and the split of least cost is found from left to right: each place keeps the cost of its best split and where that
    one's last word begins, the longer word on a tie. Returns the names in it: query_id, pos, name, start (from 1).

    A question is one row, with its lattice of at most ``max_span`` words per place."""
    n = F.length("query")
    known = names.where(F.coalesce(F.length("name"), F.lit(0)).between(1, max_span) & (F.col("n") > 0)).groupBy("name").agg(F.sum("n").alias("n"))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total"))  # one row
    cost = F.round(1000 * F.log(F.col("total") / F.col("n"))).cast("long")
    priced = known.join(F.broadcast(total)).select("name", cost.alias("cost"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(max_span), n)), lambda w: F.transform(
        F.sequence(F.lit(1), n - w + 1), lambda i: F.struct(i.alias("start"), (i + w - 1).alias("end"), F.substring(F.col("query"), i, w).alias("name")))))
    asked = queries.where(n >= 1)
    words = asked.select("query_id", F.explode(spans).alias("x")).select("query_id", "x.*").join(priced, "name")
    lattice = words.groupBy("query_id").agg(F.collect_list(F.struct("start", "end", "cost")).alias("words"))
    rows = asked.select("query_id", "query").join(lattice, "query_id").join(F.broadcast(total)).withColumn("plain", F.round(1000 * F.log("total")).cast("long") + 1000)

    def place(best, e):
        """The best split that ends with character ``e``; ``best`` has those before it, the empty one first."""
        ends = F.transform(F.filter("words", lambda w: w.end == e), lambda w: F.struct((best[w.start - 1].cost + w.cost).alias("cost"), w.start.alias("start"), F.lit(True).alias("known")))
        alone = F.struct((best[e - 1].cost + F.col("plain")).alias("cost"), e.alias("start"), F.lit(False).alias("known"))
        return F.array_append(best, F.array_min(F.array_append(ends, alone)))

    zero = F.array(F.struct(F.lit(0).cast("long").alias("cost"), F.lit(0).alias("start"), F.lit(False).alias("known")))
    split = rows.select("query_id", "query", F.aggregate(F.sequence(F.lit(1), n), zero, place).alias("best"))
    item = "array<struct<start:int,end:int>>"
    back = F.aggregate(F.sequence(n, F.lit(1)), F.struct(n.alias("at"), F.array().cast(item).alias("out")), lambda a, e: F.when(
        a.at != e, a).otherwise(F.struct(
            (F.col("best")[e].start - 1).alias("at"),
            F.when(F.col("best")[e].known, F.array_append(a.out, F.struct(F.col("best")[e].start.alias("start"), e.alias("end")))).otherwise(a.out).alias("out"))))
    return split.select("query_id", "query", F.posexplode(F.reverse(back.out)).alias("pos", "x")).select(
        "query_id", "pos", F.expr("substring(query, x.start, x.end - x.start + 1)").alias("name"), F.col("x.start").alias("start"))


def mention_hybrid(found: DataFrame, trusted: DataFrame) -> DataFrame:
    """``trusted`` (query_id, words): names a tagger vouches for. Short names
    it does not know are dropped, unless that would leave nothing."""
    j = found.join(trusted, "query_id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    m = F.col("mention")
    good = (F.array_contains("words", m) | F.exists("words", lambda t: (F.length(t) >= 2) & F.contains(m, t)) | (F.length("mention") >= 3))
    j = j.withColumn("good", good)
    some = j.groupBy("query_id").agg(F.max("good").alias("some"))
    return j.join(some, "query_id").where(F.col("good") | ~F.col("some")).select("query_id", "pos", "mention")


def indegree(triples: DataFrame, cap: int | None = None) -> DataFrame:
    n = F.count(F.lit(1))
    return triples.where(F.col("o").isNotNull()).groupBy("p", "o").agg((F.least(n, F.lit(cap)) if cap else n).alias("indegree"))


def generic_mentions(mentions: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """mention -> generic: one of its three most popular readings is a class."""
    cap = max(X.IN31_MIN, X.IN279_MIN)
    d = indegree(triples.where(F.col("p").isin("P31", "P279")), cap)
    cls = d.where(((F.col("p") == "P31") & (F.col("indegree") >= X.IN31_MIN)) | ((F.col("p") == "P279") & (F.col("indegree") >= X.IN279_MIN)))
    cls = cls.select(F.col("o").alias("qid")).distinct().withColumn("class", F.lit(True))
    cands = top_k(mentions.join(entities.select("qid", "popularity"), "qid"), ["mention"], [F.desc("popularity"), F.asc("qid")], X.GENERIC_PROBE)
    return cands.join(cls, "qid", "left").groupBy("mention").agg(F.max(F.coalesce("class", F.lit(False))).alias("generic"))


def specific_first(found: DataFrame, generic: DataFrame, drop: bool = False) -> DataFrame:
    """``found`` (query_id, pos, mention) with generic names moved to the back."""
    j = found.join(generic, "mention", "left").withColumn("generic", F.coalesce("generic", F.lit(False)))
    if drop:
        keep = j.groupBy("query_id").agg(F.min("generic").alias("all_generic"))
        j = j.join(keep, "query_id").where(~F.col("generic") | F.col("all_generic")).drop("all_generic")
    packed = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("generic", "pos", "mention"))).alias("l"))
    return packed.select("query_id", F.posexplode("l").alias("pos", "m")).select("query_id", "pos", "m.mention", "m.generic")


# ---- one hop, context, expansion --------------------------------------------------------


def labelled(triples: DataFrame, entities: DataFrame, properties: DataFrame) -> DataFrame:
    """Predicate and object labels; the predicate table is the fixed whitelist.
    Triples without an object, a large part of all, are dealt out by their other columns."""
    names = entities.select(F.col("qid").alias("_qid"), F.col("label_zh").alias("o_label"))
    key = F.coalesce("o", F.concat(F.lit("\0"), F.xxhash64("s", "p", "v").cast("string")))
    return (triples.join(F.broadcast(properties.select(F.col("pid").alias("p"), F.col("label_zh").alias("p_label"))), "p", "left")
            .join(names, (key == F.col("_qid")) & F.col("o").isNotNull(), "left").drop("_qid")
            .withColumn("object_label", F.coalesce("o_label", "v")))


def one_hop(triples: DataFrame, limit: int = X.TRIPLES_PER_ENTITY) -> DataFrame:
    return top_k(triples, ["s"], triple_order(), limit, rank="pos")


def context_text(entities: DataFrame, triples: DataFrame, properties: DataFrame,
                 limit: int = X.TRIPLES_PER_ENTITY, chars: int = X.CONTEXT_CHARS) -> DataFrame:
    """Entity card: a heading and one line per fact, cut at a line end. Facts
    are limited per subject before labels are joined on."""
    facts = labelled(one_hop(triples, limit), entities, properties)
    facts = facts.where(F.coalesce("object_label", F.lit("")) != "").select(
        F.col("s").alias("qid"), "pos", F.concat(F.lit("· "), F.coalesce("p_label", "p"), F.lit(" "), "object_label").alias("fact"))
    lines = facts.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fact"))), lambda x: x["fact"]).alias("facts"))
    desc = F.coalesce("description", F.lit(""))
    title = F.concat(F.lit("["), F.coalesce(F.when(F.col("label_zh") != "", F.col("label_zh")), F.col("qid")), F.lit("]"),
                     F.when(desc != "", F.concat(F.lit(" "), desc)).otherwise(""))
    d = entities.join(lines, "qid", "left").select("qid", "label_zh", "description", F.array_join(
        F.concat(F.array(title), F.coalesce("facts", F.array().cast("array<string>"))), "\n").alias("text"))
    cut = F.concat(F.regexp_replace(F.substring("text", 1, chars), "\n[^\n]*$", ""), F.lit("\n..."))
    return d.withColumn("text", F.when(F.length("text") > chars, cut).otherwise(F.col("text")))


def bfs(seeds: DataFrame, triples: DataFrame, max_hops: int) -> DataFrame:
    """``seeds`` (seed): every entity within ``max_hops`` levels, seed = level 1."""
    edges = triples.where((F.col("t") == "entity") & F.col("o").isNotNull()).select(F.col("s").alias("qid"), "o").distinct()
    if max_hops > 2:
        edges = cut(edges)  # made once, read at every hop
    level = seeds.select("seed", F.col("seed").alias("qid")).distinct().withColumn("hop", F.lit(1))
    seen = level
    for h in range(2, max_hops + 1):
        nxt = level.select("seed", "qid").join(edges, "qid").select("seed", F.col("o").alias("qid")).distinct()
        level = nxt.join(seen.select("seed", "qid"), ["seed", "qid"], "left_anti").withColumn("hop", F.lit(h))
        if h < max_hops:
            level = cut(level)  # the next hop starts from the frontier, not from the seeds
        seen = seen.unionByName(level)
    return seen


def bfs_capped(seeds: DataFrame, triples: DataFrame, entities: DataFrame, max_hops: int = 2, expand: int = 3) -> DataFrame:
    """``seeds`` (query_id, pos, qid), a handful per query. Each node looks at
    3·expand facts and adds up to ``expand`` unseen entities; the visited set
    is shared by the whole query, in breadth-first order."""
    adj = one_hop(triples, expand * 3).where((F.col("t") == "entity") & F.col("o").isNotNull()).join(
        entities.select(F.col("qid").alias("o"), F.lit(True).alias("known")), "o", "left")
    adj = adj.groupBy(F.col("s").alias("qid")).agg(F.array_sort(F.collect_list(
        F.struct("pos", "o", "p", F.coalesce("known", F.lit(False)).alias("known")))).alias("facts"))
    if max_hops > 2:
        adj = cut(adj)
    item = "array<struct<qid:string,via:string,p:string>>"
    state = seeds.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "qid"))), lambda x: x["qid"]).alias("frontier"))
    state = state.withColumn("visited", F.col("frontier"))
    out = None
    for hop in range(2, max_hops + 1):
        nodes = state.select("query_id", F.posexplode("frontier").alias("pos", "qid")).join(adj, "qid").groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.struct("pos", "qid", "facts"))).alias("nodes"))
        cur = state.select("query_id", "visited").join(nodes, "query_id")
        zero = F.struct(F.col("visited").alias("seen"), F.array().cast(item).alias("got"))

        def node(acc, nd):
            start = F.struct(acc["seen"].alias("seen"), acc["got"].alias("got"), F.lit(0).alias("n"))

            def fact(a, f):
                stay = (a["n"] >= expand) | F.array_contains(a["seen"], f["o"])
                took = F.struct(
                    F.array_append(a["seen"], f["o"]).alias("seen"),
                    F.when(f["known"], F.array_append(a["got"], F.struct(f["o"].alias("qid"), nd["qid"].alias("via"), f["p"].alias("p"))))
                    .otherwise(a["got"]).alias("got"),
                    (a["n"] + f["known"].cast("int")).alias("n"))
                return F.when(stay, a).otherwise(took)

            return F.aggregate(nd["facts"], start, fact, lambda r: F.struct(r["seen"].alias("seen"), r["got"].alias("got")))

        res = cur.select("query_id", F.aggregate("nodes", zero, node).alias("r"))
        if hop < max_hops:
            res = cut(res)
        found = res.select("query_id", F.posexplode("r.got").alias("pos", "g")).select(
            "query_id", F.lit(hop).alias("hop"), "pos", "g.qid", "g.via", "g.p")
        out = found if out is None else out.unionByName(found)
        state = res.select("query_id", F.transform("r.got", lambda g: g["qid"]).alias("frontier"), F.col("r.seen").alias("visited"))
    return out
