"""A stored positional index of names, for phrases whose last word may be cut short.

A segment has three tables, each sorted by token, so that a read for some tokens
skips most row groups:

* ``dictionary`` (token, names): every token and how many names have it;
* ``postings`` (token, name, pos): where a token stands in a name;
* ``best``: per token the ``k`` best rows of names that have it.

A phrase of one word is a range of the dictionary (the tokens that begin with
it), and its best rows are among the best of these tokens. A longer phrase goes
to the postings of its rarest word, the last one standing for its range; the
place there says where the phrase would begin in that name, and the words around
it are compared. The postings
answer every phrase exactly, however frequent its words.

New names are a new segment: nothing that stands is written again. A phrase is
looked up in all segments, whose answers are merged. A segment counts once its
``_SUCCESS`` file in ``best``, the table written last, is there; one that was
interrupted is not read.

Rows are those of ``kg.scored_mentions``; a name without a token is not indexed.
Scores are kept as they were when a row was added: after they have changed,
segments are written anew.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.operators.ranking import top_k
from lamina.session import cut
from lamina.sources.sinks import whole_folders

ROW = ["name", "qid", "weight", "source", "label_zh", "description", "popularity", "score"]


def tokens(c: Column) -> Column:
    """Words of letters and digits in lower case."""
    from lamina.operators.kg import tokens as split

    return split(c)


def order() -> list[Column]:
    return [F.desc("score"), F.asc("qid"), F.asc("name")]


def _sorted(df: DataFrame, path: str) -> None:
    df.repartitionByRange("token", "name" if "name" in df.columns else "token").sortWithinPartitions("token").write.parquet(path)


@dataclass
class NameIndex:
    spark: SparkSession
    folder: str
    k: int = X.FUZZY_K
    segments: list[str] = field(default_factory=list)

    @staticmethod
    def open(spark: SparkSession, folder: str, k: int = X.FUZZY_K) -> NameIndex:
        """All whole segments below ``folder``, through Spark's own file system."""
        return NameIndex(spark, folder, k, whole_folders(spark, folder, "best/_SUCCESS"))

    def add(self, scored: DataFrame) -> NameIndex:
        """One more segment, of the rows of ``scored`` (mention, qid, ...)."""
        path = f"{self.folder.rstrip('/')}/{len(self.segments):06d}-{uuid.uuid4().hex[:8]}"
        rows = scored.withColumnRenamed("mention", "name")
        names = rows.select("name").distinct().select("name", F.posexplode(tokens(F.col("name"))).alias("pos", "token"))
        _sorted(names.select("token", "name", "pos"), f"{path}/postings")
        postings = self.spark.read.parquet(f"{path}/postings")
        held = postings.select("token", "name").distinct()
        _sorted(held.groupBy("token").agg(F.count(F.lit(1)).alias("names")), f"{path}/dictionary")
        own = rows.select(*ROW, F.explode(F.array_distinct(tokens(F.col("name")))).alias("token"))
        _sorted(top_k(own, ["token"], order(), self.k).select("token", *ROW), f"{path}/best")
        self.segments.append(path)
        return self

    def table(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{s}/{name}" for s in self.segments]) if self.segments else None

    def phrases(self, wanted: DataFrame, scored: DataFrame, k: int | None = None) -> DataFrame:
        """``wanted`` (mention): the ``k`` best rows of names that hold it as a phrase, and their place ``fpos``. ``scored``
        has the rows of all indexed names; ``k`` is at most that of the index."""
        k = min(k or self.k, self.k)
        asked = wanted.select("mention").distinct().withColumn("words", tokens(F.col("mention"))).where(F.size("words") > 0)
        asked = asked.withColumn("phrase", F.array_join("words", " "))
        each = asked.select("phrase", "words").distinct().withColumn("last", F.element_at("words", -1))
        ends = cut(self._ends(each.select("last").distinct()))
        short = each.where(F.size("words") == 1).join(ends, "last").join(self.table("best"), "token").select("phrase", *ROW).distinct()
        long = self._long(each.where(F.size("words") > 1), ends, scored)
        found = top_k(short.unionByName(long), ["phrase"], order(), k, rank="fpos")
        return found.join(asked.select("mention", "phrase"), "phrase").drop("phrase")

    def _ends(self, lasts: DataFrame) -> DataFrame:
        """The range of the dictionary that begins with each last word: last, token, names."""
        lengths = lasts.agg(F.collect_set(F.length("last")).alias("lengths"))  # one row, a number per length asked for
        known = self.table("dictionary").groupBy("token").agg(F.sum("names").alias("names")).join(F.broadcast(lengths))
        begins = known.select("token", "names", F.explode(F.transform(
            F.filter("lengths", lambda n: n <= F.length("token")), lambda n: F.substring(F.col("token"), F.lit(1), n))).alias("last"))
        return begins.join(lasts, "last")

    def _long(self, each: DataFrame, ends: DataFrame, scored: DataFrame) -> DataFrame:
        """Rows of names that hold a phrase of several words, by the postings of its rarest word; the last word counts
        as all words of its range together."""
        heads = each.select("phrase", F.size("words").alias("m"), F.posexplode(F.slice("words", F.lit(1), F.size("words") - 1)).alias("at", "token"))
        sizes = self.table("dictionary").groupBy("token").agg(F.sum("names").alias("names"))
        rare = heads.join(sizes, "token").groupBy("phrase", "m").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("names", "at", "token")).alias("r"))
        ranges = ends.groupBy("last").agg(F.sum("names").alias("range"))
        way = cut(rare.where(F.col("known") == F.col("m") - 1).join(each, "phrase").join(ranges, "last").select(
            "phrase", "words", "last", "m", "r", (F.col("range") <= F.col("r.names")).alias("by_last")))
        by_head = way.where("NOT by_last").select("phrase", "words", "r.at", "r.token")
        by_last = way.where("by_last").join(ends.select("last", "token"), "last").select("phrase", "words", (F.col("m") - 1).alias("at"), "token")
        places = by_head.unionByName(by_last).join(self.table("postings"), "token").where(F.col("pos") >= F.col("at"))
        have = tokens(F.col("name"))
        begin = F.col("pos") - F.col("at") + 1
        whole = F.size("words") - 1
        here = places.withColumn("have", have).where(
            (F.slice("have", begin, whole) == F.slice("words", F.lit(1), whole)) & F.startswith(F.try_element_at("have", (begin + whole).cast("int")), F.element_at("words", -1)))
        return here.select("phrase", "name").distinct().join(scored.withColumnRenamed("mention", "name").select(*ROW), "name").select("phrase", *ROW).distinct()
