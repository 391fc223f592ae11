"""From a batch of questions to answers and what is archived of them, in stages that
questions leave as soon as they are answered.

1. A question a rule sends to a tool leaves with the tool's name.
2. One that the answer cache holds leaves with the cached answer, unless it asks
   for the web itself; today's rules look at the answer again.
3. The others are searched for in the offline layers, each of which sees only
   these questions. What they find decides who also goes to the online layers:
   questions that depend on the day, that ask for the web, or whose evidence is
   thin.
4. Passages of all layers are calibrated, fused, and written as evidence into a
   message; ``answer`` turns messages into answers.
5. Citations are checked against the passages, and the admission rules say what
   goes to the answer cache and to history.

A layer is a ``Layer``: a function from questions to passages with its list
number, calibration and time budget. A new kind of layer needs nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.functions import answers as AN
from lamina.functions import evidence as EV
from lamina.operators import admission as A
from lamina.operators import cache as CA
from lamina.operators import calibration as P
from lamina.operators import coverage as V
from lamina.operators import diversify as D
from lamina.operators import fusion as U
from lamina.operators.layers import HEAD, PASSAGE, referred
from lamina.session import cut

#: Columns of questions that layers get, and of what they return (``url``, ``hop`` and ``elapsed`` may be missing).
QUESTION = ["query_id", "query", "search", "namespace"]
FOUND = ["query_id", "rank", "id", "title", "text", "score"]


@dataclass(frozen=True)
class Layer:
    """``search``: questions (``QUESTION``) to passages (``FOUND``), at most ``k`` a question by ``rank``. ``number``: its
    place among lists of equal rank. ``curve``: slope and middle of its calibration, by default those fixed for its name.
    ``budget_s``: passages with a greater ``elapsed`` don't count. ``online`` layers are asked only when needed.
    ``texts`` (id, title, text and perhaps url): a layer of long texts that many questions find gives them here, and
    ``search`` returns rows without them. Passages then carry the first characters and meet the text where it is used."""

    name: str
    number: int
    search: Callable[[DataFrame], DataFrame]
    online: bool = False
    k: int = 8
    curve: tuple[float, float] | None = None
    budget_s: float | None = None
    texts: DataFrame | None = None

    def referred(self) -> DataFrame:
        """``texts`` with a name for each, ``ref``."""
        return referred(self.texts, self.name)

    def passages(self, questions: DataFrame) -> DataFrame:
        d = self.search(questions)
        if self.texts is not None:
            d = d.where(F.col("rank") <= self.k).join(self.referred().withColumn("text", F.substring("text", 1, HEAD)), "id")
        if self.budget_s is not None and "elapsed" in d.columns:
            d = d.where(F.col("elapsed") <= self.budget_s)
        a, b = (F.lit(float(x)) for x in self.curve) if self.curve else (None, None)
        p = P.calibrate(F.lit(self.name), F.col("score"), F.col("hop") if "hop" in d.columns else None, a, b)
        d = d.where(F.col("rank") <= self.k).withColumns({
            "layer": F.lit(self.name), "list_no": F.lit(self.number), "id": F.col("id").cast("string"), "score": F.col("score").cast("double"), "rank": F.col("rank").cast("int"),
            "url": F.coalesce("url", F.lit("")) if "url" in d.columns else F.lit(""), "calibrated": F.round(p, 4),
            "ref": F.col("ref") if self.texts is not None else F.lit(None).cast("string")})
        return d.select(*PASSAGE, "ref")


def quoting(evidence: DataFrame) -> DataFrame:
    """The plainest answerer: the titles of the first passages, each cited. ``evidence`` has a row per passage."""
    lines = F.array_sort(F.collect_list(F.struct("pos", F.concat("title", F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("line"))))
    return evidence.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("answer"))


@dataclass
class Engine:
    layers: list[Layer]
    entries: DataFrame                      # answer cache: key, seq, answer, write_ts, ttl
    now: int
    as_of_year: int
    normalise: Callable[[Column], Column]   # question to cache key
    answer: Callable[[DataFrame, DataFrame], DataFrame] | None = None  # messages, evidence -> query_id, answer
    k: int = X.FUSED_K
    diversify: bool = False
    parts: dict = field(default_factory=dict)  # frames of the last run, by name

    def register(self, layer: Layer) -> Engine:
        """One more layer; a name or number that is taken raises."""
        if any(x.name == layer.name or x.number == layer.number for x in self.layers):
            raise ValueError(f"layer {layer.name} ({layer.number}) is there already")
        self.layers.append(layer)
        return self

    # ---- stages

    def routed(self, questions: DataFrame) -> DataFrame:
        """``questions`` (query_id, query, namespace) with tool, cache answer and route."""
        q = questions.withColumns({
            "tool": A.tool_rule(F.col("query")), "forced": A.wants_web(F.col("query")), "fresh": A.time_sensitive(F.col("query"), self.as_of_year),
            "global_key": self.normalise(F.col("query"))}).withColumn("key", F.concat(F.coalesce(F.concat("namespace", F.lit("::")), F.lit("")), "global_key"))
        asks = q.where("(tool IS NULL OR tool = 'NO_TOOL') AND NOT forced").select(F.col("query_id").alias("ask_id"), "key", "global_key", "query")
        hits = CA.with_fallback(asks, self.entries, self.now).where(F.col("answer").isNotNull())
        hits = hits.where(A.admissible(F.col("query"), F.col("answer"), self.as_of_year)).select(F.col("ask_id").alias("query_id"), "entry", F.col("answer").alias("cached"))
        route = F.when(F.col("tool") != "NO_TOOL", "tool").when(F.col("entry").isNotNull(), "cache").otherwise("search")
        search = F.when(F.col("forced"), A.strip_directive(F.col("query"))).otherwise(F.col("query"))
        return cut(q.join(hits, "query_id", "left").withColumn("route", route).withColumn("search", search).drop("key", "global_key"))

    def texts(self) -> DataFrame | None:
        """``ref``, ``title`` and ``text`` of all layers that keep them apart."""
        some = [x.referred().select("ref", "title", "text") for x in self.layers if x.texts is not None]
        return reduce(DataFrame.unionByName, some) if some else None

    def whole(self, passages: DataFrame) -> DataFrame:
        """``passages`` with their whole texts."""
        texts = self.texts()
        if texts is None:
            return passages.drop("ref")
        t = texts.dropDuplicates(["ref"]).select("ref", F.col("text").alias("_text"))
        return passages.join(t, "ref", "left").withColumn("text", F.coalesce("_text", "text")).drop("ref", "_text")

    def found(self, questions: DataFrame, online: bool) -> DataFrame:
        some = [x.passages(questions) for x in self.layers if x.online == online]
        return cut(reduce(DataFrame.unionByName, some))  # a few rows per question

    def run(self, questions: DataFrame) -> DataFrame:
        """``query_id``, ``route``, ``tool``, ``entry``, hits per layer (``n_NAME``), ``confidence``, ``coverage``, ``online``,
        ``low_evidence``, ``message``, ``answer``, ``n_cited``, ``n_invalid``, ``tier``, ``to_l1``, ``to_l3``; one row per question."""
        routed = self.routed(questions)
        asked = routed.where("route = 'search'")
        seen = asked.select(*QUESTION)
        off = self.found(seen, online=False)
        sure = P.noisy_or(off).withColumnRenamed("confidence", "offline")
        cov = V.term_coverage(seen.select("query_id", F.col("search").alias("query")), off.select("query_id", F.struct("list_no", "rank").alias("pos"), "title", "text", "ref"), self.texts())
        some = off.select("query_id").distinct().withColumn("some", F.lit(True))
        flags = asked.select("query_id", "forced", "fresh").join(sure, "query_id", "left").join(cov, "query_id", "left").join(some, "query_id", "left")
        flags = flags.withColumn("coverage", F.when(F.col("some"), F.col("coverage")).otherwise(0.0)).withColumn("offline", F.coalesce("offline", F.lit(0.0)))
        flags = cut(flags.withColumn("online", F.col("fresh") | V.needs_web(F.col("offline"), F.col("coverage"), F.col("forced"))).select("query_id", "coverage", "online"))
        called = seen.join(flags.where("online").select("query_id"), "query_id", "left_semi")
        passages = off.unionByName(self.found(called, online=True)) if any(x.online for x in self.layers) else off
        best = U.rrf_top(passages, self.k if not self.diversify else self.k * X.CANDIDATE_MULTIPLIER)
        if self.diversify:
            best = D.diversify(best.withColumn("embedding", F.array().cast("array<double>")), self.k)
        best = cut(best)
        evidence = self.whole(best)
        self.parts = {"routed": routed, "offline": self.whole(off), "passages": self.whole(passages), "evidence": evidence, "flags": flags}
        counts = passages.groupBy("query_id").agg(*[F.count_if(F.col("layer") == x.name).alias(f"n_{x.name}") for x in self.layers])
        state = flags.join(P.noisy_or(passages), "query_id", "left").join(counts, "query_id", "left").fillna(0, [f"n_{x.name}" for x in self.layers]).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        state = state.withColumn("low_evidence", F.col("confidence") < X.ABSTAIN_CONFIDENCE)
        blocks = EV.evidence_block(best, texts=self.texts()) if self.texts() is not None else EV.evidence_block(evidence)  # a text is cleaned once, not per question
        messages = asked.select("query_id", "query", "forced").join(state.select("query_id", "low_evidence"), "query_id").join(blocks, "query_id", "left").select(
            "query_id", EV.user_message(F.col("query"), F.coalesce("block", F.lit("")), F.col("low_evidence"), F.col("forced")).alias("message"))
        made = cut((self.answer or (lambda m, e: quoting(e)))(messages, evidence).select("query_id", F.col("answer").alias("made")))
        cites = AN.validate(AN.citations(made, "query_id", "made"), best.select("query_id", F.col("pos").alias("source_id")), "query_id")
        audit = cites.groupBy("query_id").agg(F.countDistinct(F.when(F.col("valid"), F.col("source_id"))).alias("n_cited"), F.count_if(~F.col("valid")).alias("n_invalid"))
        online = [f"n_{x.name}" for x in self.layers if x.online]
        whole = (routed.join(state, "query_id", "left").join(messages, "query_id", "left").join(made, "query_id", "left").join(audit, "query_id", "left")
                 .withColumn("answer", F.coalesce("cached", "made")).withColumn("web_hits", reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in online], F.lit(0))))
        whole = A.archive_targets(whole, self.as_of_year)
        own = F.col("route") == "search"  # what came from the cache or a tool isn't archived again
        return whole.select(
            "query_id", "route", "tool", "entry", *[F.coalesce(f"n_{x.name}", F.lit(0)).alias(f"n_{x.name}") for x in self.layers], "confidence", "coverage", "online", "low_evidence",
            "message", "answer", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_cited", "n_invalid")], F.when(own, F.col("tier")).alias("tier"), (own & F.col("to_l1")).alias("to_l1"), (own & F.col("to_l3")).alias("to_l3"))
