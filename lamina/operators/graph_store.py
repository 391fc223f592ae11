"""The graph's tables in buckets, with a manifest per version.

A table's rows are dealt to buckets by the hash of a key; a bucket is a folder
of Parquet files that is never changed. A version is a small table of the
folders that belong to it, written last: readers take the newest one that is
whole, so they see all of a change or nothing of it, and a write that fails
leaves the version before. A change reads and writes only the buckets its keys
fall into; the others are named again in the new manifest.

Triples are stored as adjacency: one row per subject and ``CHUNK`` facts, in
``kg.triple_order``, so the facts of an entity are read without grouping them
again, and an entity with very many facts is many rows.

Writers take turns: two changes at the same time would not see each other.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lamina import fixed as X
from lamina.operators import kg as K
from lamina.operators.ranking import ranked
from lamina.session import cut
from lamina.sources.sinks import whole_folders

#: Facts in a row of the adjacency; at least what a hop shows of an entity.
CHUNK = X.TRIPLES_PER_ENTITY
#: Facts of a subject that are put in order in one group; more are ranked over many tasks.
GROUP = 200 * CHUNK
#: The tables, the columns that name a row, and the one that deals rows to buckets.
KEYS = {"entities": ["qid"], "mentions": ["mention", "qid"], "adjacency": ["s", "chunk"]}
#: Columns whose text may hold escapes.
TEXTS = {"entities": ["label_zh", "label_en", "description"], "mentions": ["mention"], "adjacency": ["v"]}
_ESCAPE = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
_MANIFEST = "name string, bucket int, path string, schema string"


def packed(triples: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Triples (s, p, o, v, t) as rows of (s, chunk, facts); repeated triples stay repeated. With ``bucket``, an expression
    over ``s``, rows have it as ``bucket_`` and lie in ranges of (bucket_, s), to which triples move once.

    The few subjects with more than ``GROUP`` facts are found first and take the way of ``ranked``."""
    t = triples.select("s", "p", "o", "v", "t")
    sizes = t.groupBy(F.col("s").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    large = cut(sizes.where(F.col("_n") > GROUP).select("_s"))
    if large.isEmpty():
        return _grouped(t, bucket)
    same = F.col("s").eqNullSafe(F.col("_s"))
    placed = ranked(t.join(large, same, "left_semi"), K.triple_order() + [F.asc_nulls_first("t")], "pos", ["s"])
    rows = placed.withColumn("chunk", F.expr(f"cast((pos - 1) div {CHUNK} as int)"))
    spread = rows.groupBy("s", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "p", "o", "v", "t"))).alias("facts"))  # a chunk at most
    if bucket is not None:
        spread = spread.withColumn("bucket_", bucket)
    return _grouped(t.join(large, same, "left_anti"), bucket).unionByName(spread)


def _grouped(t: DataFrame, bucket: Column | None) -> DataFrame:
    """``packed`` for subjects of at most ``GROUP`` facts."""
    keys = ["s"]
    if bucket is not None:
        keys = ["bucket_", "s"]
        t = t.withColumn("bucket_", bucket).repartitionByRange(*keys)
    g = t.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("p", "o", "v", "t"))).alias("f"))  # nulls first, as in ``triple_order``
    g = g.select(*keys, F.transform("f", lambda f, i: F.struct((i + 1).cast("long").alias("pos"), f.p.alias("p"), f.o.alias("o"), f.v.alias("v"), f.t.alias("t"))).alias("f"))
    chunks = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(f) - 1) div {CHUNK} as int)")), lambda c: F.slice("f", c * CHUNK + 1, CHUNK))
    return g.select(*keys, F.posexplode(chunks).alias("chunk", "facts"))


def unpacked(adjacency: DataFrame) -> DataFrame:
    return adjacency.select("s", F.explode("facts").alias("f")).select("s", "f.p", "f.o", "f.v", "f.t")


def hop(adjacency: DataFrame, limit: int = CHUNK) -> DataFrame:
    """``kg.one_hop`` from stored rows: nothing is shuffled."""
    first = adjacency.where(F.col("chunk") <= (limit - 1) // CHUNK).select("s", F.explode("facts").alias("f"))
    return first.select("s", "f.p", "f.o", "f.v", "f.t", F.col("f.pos").cast("int").alias("pos")).where(F.col("pos") <= limit)


@dataclass
class GraphStore:
    spark: SparkSession
    folder: str
    buckets: int = 16

    # ---- versions

    def versions(self) -> list[str]:
        return whole_folders(self.spark, f"{self.folder}/versions")

    def manifest(self, version: int | None = None) -> list[tuple]:
        """(name, bucket, path, schema) of a version, by default the newest; a row per table and bucket."""
        all_ = self.versions()
        if not all_:
            return []
        path = all_[-1] if version is None else all_[version]
        return sorted(tuple(r) for r in self.spark.read.schema(_MANIFEST).parquet(path).collect())

    def _publish(self, rows: list[tuple]) -> None:
        name = f"{len(self.versions()):08d}-{uuid.uuid4().hex[:8]}"
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{self.folder}/versions/{name}")

    def table(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of a version, or only some of its buckets."""
        rows = [r for r in self.manifest(version) if r[0] == name]
        schema = StructType.fromJson(json.loads(rows[0][3]))
        paths = [r[2] for r in rows if buckets is None or r[1] in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # ---- writing

    def _bucket(self, name: str):
        return F.pmod(F.xxhash64(KEYS[name][0]), F.lit(self.buckets)).cast("int")

    def _dealt(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` in ranges of its buckets and keys."""
        return df.withColumn("bucket_", self._bucket(name)).repartitionByRange("bucket_", *KEYS[name])

    def _write(self, name: str, df: DataFrame, buckets: list[int]) -> list[tuple]:
        """Files of ``df`` for these buckets; an empty bucket has no folder. A bucket is written by several tasks, one
        range of its key each, so a key with very many rows is no single task's. Rows that have their ``bucket_`` already
        lie in such ranges and stay there."""
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        dealt = df if "bucket_" in df.columns else self._dealt(name, df)
        dealt.sortWithinPartitions("bucket_", *KEYS[name]).write.partitionBy("bucket_").parquet(path)
        there = {int(p.rsplit("=", 1)[1]): p for p in whole_folders(self.spark, path, ".") if "bucket_=" in p}
        schema = df.drop("bucket_").schema.json()
        return [(name, b, there[b], schema) for b in buckets if b in there]

    def write(self, entities: DataFrame, mentions: DataFrame, triples: DataFrame) -> None:
        """A first version, or one that replaces everything. Of rows with the same key one stays: any of the entities'
        equal ids must be the same row already; of mentions the strongest."""
        every = list(range(self.buckets))
        tables = {"entities": self._dealt("entities", entities).dropDuplicates(["bucket_", "qid"]), "mentions": mentions, "adjacency": packed(triples, self._bucket("adjacency"))}
        self._publish([r for n, df in tables.items() for r in self._write(n, df, every)])

    def _change(self, name: str, touched: list[int], rows: DataFrame) -> None:
        old = [r for r in self.manifest() if r[0] != name or r[1] not in touched]
        self._publish(old + self._write(name, rows, touched))

    def _touched(self, name: str, keys: DataFrame) -> list[int]:
        return sorted(r.b for r in keys.select(self._bucket(name).alias("b")).distinct().collect())  # at most the number of buckets

    def upsert(self, name: str, changes: DataFrame, removed: DataFrame | None = None, replace: bool = True) -> list[int]:
        """Rows of ``changes`` take the place of those with the same key, or only fill gaps when not ``replace``; the keys of
        ``removed`` go. Returns the buckets that were written."""
        keys = KEYS[name]
        all_keys = changes.select(*keys) if removed is None else changes.select(*keys).unionByName(removed.select(*keys))
        touched = self._touched(name, all_keys)
        if not touched:
            return []
        old = self.table(name, buckets=touched)
        new = changes.select(*old.columns)
        rows = old.join(new.select(*keys), keys, "left_anti").unionByName(new) if replace else old.unionByName(new.join(old.select(*keys), keys, "left_anti"))
        if removed is not None:
            rows = rows.join(removed.select(*keys), keys, "left_anti")
        self._change(name, touched, rows)
        return touched

    def change_triples(self, added: DataFrame, removed: DataFrame | None = None) -> list[int]:
        """Triples to add, and triples (s, p, o, v, t) to take out, every copy of them. Of the buckets they fall into, the
        rows of other subjects are written again as they are."""
        subjects = added.select("s") if removed is None else added.select("s").unionByName(removed.select("s"))
        touched = self._touched("adjacency", subjects)
        if not touched:
            return []
        stored, subjects = self.table("adjacency", buckets=touched), subjects.distinct().withColumnRenamed("s", "_s")
        of_them = F.col("s").eqNullSafe(F.col("_s"))
        rows = unpacked(stored.join(subjects, of_them, "left_semi"))
        if removed is not None:
            gone = removed.select(*[F.col(c).alias(f"_{c}") for c in rows.columns]).distinct()
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in rows.columns]
            for c in same[1:]:
                same[0] = same[0] & c
            rows = rows.join(gone, same[0], "left_anti")
        changed = packed(cut(rows.unionByName(added.select(*rows.columns))))  # read twice
        self._change("adjacency", touched, stored.join(subjects, of_them, "left_anti").unionByName(changed))
        return touched

    # ---- repair

    def _dirty(self, name: str) -> DataFrame:
        """Rows with an escape in one of their texts; of the adjacency, their triples."""
        rows = self.table(name) if name != "adjacency" else unpacked(self.table(name))
        bad = F.lit(False)
        for c in TEXTS[name]:
            bad = bad | F.coalesce(F.col(c).rlike(_ESCAPE), F.lit(False))
        return rows.where(bad)

    def repair(self) -> dict[str, int]:
        """Escapes left in stored texts become the characters they stand for. Where a repaired row gets the key of another
        one, the repaired one stays. Returns the number of changed rows per table; a second run changes nothing."""
        done = {}
        for name, texts in TEXTS.items():
            dirty = self._dirty(name)
            differs = F.lit(False)
            for c in texts:
                differs = differs | ~F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}"))
            keyed = dirty.select(F.struct(*dirty.columns).alias("d"))
            both = cut(keyed.select("d", F.struct(*[K.unescape(F.col(f"d.{c}")).alias(c) if c in texts else F.col(f"d.{c}").alias(c) for c in dirty.columns]).alias("p")).where(differs))
            done[name] = both.count()
            if not done[name]:
                continue
            if name == "adjacency":
                self.change_triples(both.select("p.*"), both.select("d.*"))
                continue
            keys = KEYS[name]
            new = K.first_per_key(both.select("p.*"), keys, [c for c in dirty.columns if c not in keys][:1])
            old = both.select(*[F.col(f"d.{c}").alias(c) for c in keys]).join(new.select(*keys), keys, "left_anti")
            self.upsert(name, new, old)
        return done
