"""Queries over indexes that are built once, kept and added to."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.operators import graph_store as GS
from lamina.operators import neighbour_graph as N
from lamina.operators import vectors as VS
from lamina.operators.graph_store import GraphStore
from lamina.plans import graph as G
from lamina.plans.inputs import load
from lamina.plans.registry import query
from lamina.sources.sinks import scratch_table

# ---- neighbour graph ------------------------------------------------------------------

#: The given vectors are random in 64 dimensions, the hardest kind for any index, so pools are large.
GRAPH = {"k": 24, "rounds": 5, "ef": 256, "width": 64}


def graph_hits(spark, sf):
    """Every vector is indexed; those whose number divides by 100 are asked for."""
    e = load(spark, sf, "embeddings")
    vectors = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("cv"))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    graph = N.build(vectors, GRAPH["k"], GRAPH["rounds"])
    return vectors, asked, N.search(graph, asked, X.L2_K, GRAPH["ef"], GRAPH["width"], exclude_same=True)


@query("graph_topk")
def graph_topk(spark, sf):
    return graph_hits(spark, sf)[2]


@query("graph_recall")
def graph_recall(spark, sf):
    """How many of the exact neighbours the graph found, and how many vectors it looked at, per question."""
    vectors, asked, hits = graph_hits(spark, sf)
    exact = VS.exact_topk(asked, vectors, X.L2_K, exclude_same=True).select("query_id", "id", F.lit(1).alias("exact"))
    both = exact.join(hits.select("query_id", "id", F.lit(1).alias("found")), ["query_id", "id"], "left")
    seen = hits.groupBy("query_id").agg(F.max("n_distances").alias("n_distances"))
    return both.groupBy("query_id").agg(F.count("exact").alias("n_exact"), F.count("found").alias("n_found")).join(seen, "query_id", "left")


# ---- graph store -------------------------------------------------------------------------

_ENTITY = ["qid", "label_zh", "label_en", "description", "article_rank", "popularity"]


def stored_graph(spark, sf):
    store = GraphStore(spark, scratch_table(spark, "graph"))
    store.write(G.entities(spark, sf).select(*_ENTITY), G.mentions(spark, sf), G.triples(spark, sf))
    return store


@query("kg_store_write", G.sql(f"""{G.ENTS}, changed AS (SELECT qid, concat('v2 ', description) AS description, popularity FROM ents WHERE qid LIKE 'C%' AND TRY_CAST(substring(qid, 2) AS BIGINT) % 4 = 0
   UNION ALL SELECT concat('X', CAST(n_nationkey AS VARCHAR)), concat('new ', n_name), 0 FROM nation),
 ent2 AS (SELECT * FROM changed UNION ALL SELECT qid, description, popularity FROM ents WHERE qid NOT IN (SELECT qid FROM changed) AND NOT (qid LIKE 'S%' AND TRY_CAST(substring(qid, 2) AS BIGINT) % 7 = 0)),
 tri2 AS (SELECT s, p, coalesce(o, v) AS value FROM kg_triples WHERE NOT (p = 'P577' AND TRY_CAST(substring(s, 2) AS BIGINT) % 5 = 0)
   UNION ALL SELECT concat('C', CAST(c_custkey AS VARCHAR)), 'P999', 'Q1' FROM customer WHERE c_custkey % 10 = 1)""", "titles", "kg_raw_entities", "kg_triples") + """
SELECT 'entity' AS kind, qid AS key, description AS value, CAST(popularity AS BIGINT) AS n FROM ent2 UNION ALL SELECT 'triple', s, concat(p, ' ', value), count(*) FROM tri2 GROUP BY ALL""")
def kg_store_write(spark, sf):
    """A store after a first version, an upsert with removals, and a change of triples: what its newest version holds."""
    store = stored_graph(spark, sf)
    e, t = G.entities(spark, sf).select(*_ENTITY), G.triples(spark, sf)
    number = F.expr("try_cast(substring(qid, 2) AS bigint)")
    changed = e.where(F.startswith("qid", F.lit("C")) & (number % 4 == 0)).withColumn("description", F.concat(F.lit("v2 "), "description"))
    new = load(spark, sf, "nation").select(
        F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("qid"), F.col("n_name").alias("label_zh"), F.col("n_name").alias("label_en"),
        F.concat(F.lit("new "), "n_name").alias("description"), F.lit(None).cast("long").alias("article_rank"), F.lit(0).cast("long").alias("popularity"))
    store.upsert("entities", changed.unionByName(new.select(*[F.col(c).cast(e.schema[c].dataType) for c in _ENTITY])), e.where(F.startswith("qid", F.lit("S")) & (number % 7 == 0)).select("qid"))
    added = load(spark, sf, "customer").where("c_custkey % 10 = 1").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("s"), F.lit("P999").alias("p"), F.lit("Q1").alias("o"), F.lit(None).cast("string").alias("v"), F.lit("entity").alias("t"))
    store.change_triples(added, t.where((F.col("p") == "P577") & (F.expr("try_cast(substring(s, 2) AS bigint)") % 5 == 0)))
    kept = store.table("entities").select(F.lit("entity").alias("kind"), F.col("qid").alias("key"), F.col("description").alias("value"), F.col("popularity").cast("long").alias("n"))
    facts = GS.unpacked(store.table("adjacency")).groupBy(F.lit("triple").alias("kind"), F.col("s").alias("key"), F.concat_ws(" ", "p", F.coalesce("o", "v")).alias("value"))
    return kept.unionByName(facts.agg(F.count(F.lit(1)).alias("n")))


@query("kg_store_hop", G.sql(G.HOP, "kg_triples") + "SELECT s, p, o, v, CAST(pos AS INTEGER) AS pos FROM hop1")
def kg_store_hop(spark, sf):
    return GS.hop(stored_graph(spark, sf).table("adjacency")).select("s", "p", "o", "v", "pos")


_FIX = "replace({c}, concat(chr(92), 'u5BA2', chr(92), 'u6237'), '客户')"


@query("kg_repair", G.sql(f"""m AS (SELECT *, contains(mention, chr(92)) AS was FROM dirty_mentions), m2 AS (SELECT {_FIX.format(c='mention')} AS mention, qid, arg_max(weight, was) AS weight FROM m GROUP BY ALL)""",
                          "dirty_entities", "dirty_mentions", "dirty_triples") + f"""
SELECT 'entity' AS kind, qid AS key, {_FIX.format(c='description')} AS value, CAST(1 AS DOUBLE) AS weight FROM dirty_entities
UNION ALL SELECT 'mention', qid, mention, weight FROM m2 UNION ALL SELECT 'triple', s, concat(p, ' ', {_FIX.format(c='coalesce(o, v)')}), 1 FROM dirty_triples
UNION ALL SELECT 'changed', 'entities', CAST((SELECT count(*) FROM dirty_entities WHERE contains(description, 'u5BA2')) AS VARCHAR), 0
UNION ALL SELECT 'changed', 'mentions', CAST((SELECT count(*) FROM m WHERE was) AS VARCHAR), 0
UNION ALL SELECT 'changed', 'adjacency', CAST((SELECT count(*) FROM dirty_triples WHERE contains(v, 'u5BA2')) AS VARCHAR), 0
UNION ALL SELECT 'again', 'all', '0', 0""")
def kg_repair(spark, sf):
    """A store filled with escaped texts, after its repair; a second repair finds nothing to do."""
    store = GraphStore(spark, scratch_table(spark, "graph"))
    store.write(*[load(spark, sf, f"dirty_{n}") for n in ("entities", "mentions", "triples")])
    done = store.repair()
    again = store.repair()
    facts = [("changed", n, str(v), 0.0) for n, v in done.items()] + [("again", "all", str(sum(again.values())), 0.0)]
    row = lambda kind, key, value, weight: [F.lit(kind).alias("kind"), F.col(key).alias("key"), value.alias("value"), weight.cast("double").alias("weight")]
    return (store.table("entities").select(*row("entity", "qid", F.col("description"), F.lit(1)))
            .unionByName(store.table("mentions").select(*row("mention", "qid", F.col("mention"), F.col("weight"))))
            .unionByName(GS.unpacked(store.table("adjacency")).select(*row("triple", "s", F.concat_ws(" ", "p", F.coalesce("o", "v")), F.lit(1))))
            .unionByName(spark.createDataFrame(facts, "kind string, key string, value string, weight double")))
