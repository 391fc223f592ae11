"""Periodic runs of words, by string synchronising sets.

A run is a stretch of consecutive words with smallest period q, at least
max(6, 4 q) words long, that neither neighbouring word extends. At each scale
t = 4, 8, 16, ... those with t <= q < 2 t are found so:

* Every window of t words has a hash. Place i is *synchronising* when the least
  hash among the windows that begin in [i, i + t] is that of i or of i + t.
  Whether it is depends on the 2 t words after i alone, so equal contexts are
  chosen alike, and every t places hold a chosen one, unless the words there
  have a period of t / 4 or less.
* Such highly periodic windows are left out of the choice. Their runs are known
  already: periods 1 to 3 by comparing words directly, longer ones from the
  scales before.
* A run of period q holds two chosen places q apart with equal contexts of 2 t
  words, and none in between (else q weren't the smallest period). So
  neighbours among equal contexts, t to 2 t apart, propose their distance as a
  period, and comparing words to both sides gives the run, or refuses it.

Documents of a slice are laid end to end, a mark of its own after each, and
handled together; a scale keeps only documents of 4 t words or more. Nothing is
shuffled.

A null or empty text has no words and no runs; its collapsed text is empty.
Words are separated by \\x20 and \\x09-\\x0D and compared as they are. Repeated
rows are handled each; columns other than those named are not read. A whole
text is held by its task, about 150 bytes a word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import let, mix, slices, strings

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Periods below are found by direct comparison; the first scale.
FIRST_SCALE = 4
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_M = np.uint64(0x9E3779B97F4A7C15)


def _moved(a: np.ndarray, by: int, fill: int) -> np.ndarray:
    """``a[i + by]`` at i."""
    out = np.full_like(a, fill)
    if by < len(a):
        out[:-by] = a[by:]
    return out


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def _first_difference(words: np.ndarray, at: int, d: int, step: int) -> int:
    """The place where words d apart first differ, from ``at`` on in direction ``step``; the table's border differs."""
    size, n = 32, len(words) - d
    while True:
        low, high = (at, min(at + size, n)) if step > 0 else (max(at - size + 1, 0), at + 1)
        differ = np.flatnonzero(words[low:high] != words[low + d : high + d])
        if len(differ):
            return low + int(differ[0] if step > 0 else differ[-1])
        at = high if step > 0 else low - 1
        if not 0 <= at < n:
            return at
        size *= 2


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and smallest period of every maximal stretch of ``LEAST_PERIODS`` periods or more. ``words``: numbers of
    words, each document closed by a number that no other place has; ``sizes``: words of each document with that mark."""
    begins, ends, periods = [], [], []
    for q in range(1, FIRST_SCALE):
        a, b = _stretches(words[:-q] == words[q:])
        b = b + q
        long = b - a >= LEAST_PERIODS * q
        a, b = a[long], b[long]
        if q > 1:  # 2 and 3 have no other divisor than 1
            own = words[a] != words[a + 1]
            for k in range(1, q - 1):
                own |= words[a + k] != words[a + k + 1]
            a, b = a[own], b[own]
        begins.append(a), ends.append(b), periods.append(np.full(len(a), q))
    place = np.arange(len(words))
    hashes = mix((words.astype(np.uint64) + np.uint64(1)) * _M)
    size_of = np.repeat(sizes, sizes)
    for step in (1, 2):  # windows of 4 words
        hashes = mix(hashes * _M + _moved(hashes, step, 0))
    t = FIRST_SCALE
    while True:
        keep = size_of > LEAST_PERIODS * t
        if not keep.all():
            place, hashes, size_of = place[keep], hashes[keep], size_of[keep]
        if not len(place):
            break
        context = mix(hashes * _M + _moved(hashes, t, 0))
        known = [np.concatenate(x) for x in (begins, ends, periods)]
        low = (known[2] * 4 <= t) & (known[1] - known[0] >= t)
        least = hashes
        if low.any():  # windows inside runs of short periods don't take part
            marks = np.zeros(len(words) + 1, np.int64)
            np.add.at(marks, known[0][low], 1)
            np.add.at(marks, known[1][low] - t + 1, -1)
            least = np.where(np.cumsum(marks)[place] > 0, _NONE, hashes)
        chosen, span = least, 1
        while span < t:
            chosen = np.minimum(chosen, _moved(chosen, span, int(_NONE)))
            span *= 2
        last = _moved(least, t, int(_NONE))
        chosen = np.minimum(chosen, last)
        sync = np.flatnonzero((chosen != _NONE) & ((chosen == least) | (chosen == last)))
        order = sync[np.argsort(context[sync], kind="stable")]
        far = np.diff(order)
        pairs = np.flatnonzero((context[order[1:]] == context[order[:-1]]) & (far >= t) & (far < 2 * t))
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for s, d in sorted(zip(place[order[pairs]].tolist(), far[pairs].tolist())):
            if found[d] and s < found[d][-1][1] - d:
                continue  # inside the stretch that was compared last
            begin = _first_difference(words, s, d, -1) + 1
            end = _first_difference(words, s, d, 1) + d
            found[d].append((begin, end))
        for d, some in found.items():
            some = np.array([x for x in some if x[1] - x[0] >= LEAST_PERIODS * d], np.int64).reshape(-1, 2)
            begins.append(some[:, 0]), ends.append(some[:, 1]), periods.append(np.full(len(some), d))
        hashes, t = context, 2 * t
    return np.concatenate(begins), np.concatenate(ends), np.concatenate(periods)


def _of_slice(texts: list[str]) -> tuple[list[list[dict]], list[str]]:
    """Runs and collapsed texts."""
    split = [t.encode().split() for t in texts]  # bytes.split() cuts at exactly these six characters
    number: dict[bytes, int] = defaultdict(count(len(split)).__next__)
    flat: list[int] = []
    for k, some in enumerate(split):
        flat += map(number.__getitem__, some)
        flat.append(k)
    sizes = np.array([len(s) + 1 for s in split])
    starts = np.cumsum(sizes) - sizes
    a, b, q = find_runs(np.array(flat, np.int64), sizes)
    long = b - a >= LEAST_WORDS
    order = np.lexsort((q[long], a[long]))
    a, b, q = a[long][order], b[long][order], q[long][order]
    runs: list[list[dict]] = [[] for _ in texts]
    for k, x, y, p in zip((np.searchsorted(starts, a, "right") - 1).tolist(), a.tolist(), b.tolist(), q.tolist()):
        runs[k].append({"start": x - int(starts[k]), "length": y - x, "period": p})
    out = []
    for some, found in zip(split, runs):
        if found:
            gone = np.zeros(len(some) + 1, np.int64)
            for r in found:
                gone[r["start"] + r["period"]] += 1
                gone[r["start"] + r["length"]] -= 1
            some = [some[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        out.append(b" ".join(some).decode())
    return runs, out


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``runs`` (array of start, length and period in words, by start, then period) and
    ``collapsed``, the text without the words that a run holds after its first period, one space between words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                runs, texts = _of_slice(strings(some.column("text")))
                yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id"), "runs": pa.array(runs, _RUNS), "collapsed": pa.array(texts, pa.string())})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where a tenth of the documents repeat a stretch of words to their end: with
    h = crc32(doc_id) and g = h div 10, those with h % 10 = 0. A null ``doc_id`` plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeat(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n == 0, "").otherwise(F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " "))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, repeat)).otherwise(F.col("text")).alias("text"))


def summarised(found: DataFrame) -> DataFrame:
    """The number of runs, the greatest one (ties: smallest start, then period), and hashes of runs and collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    base = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return base.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat("lines", F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")
