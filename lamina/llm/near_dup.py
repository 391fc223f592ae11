"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's set holds the 64-bit hashes of its distinct shingles. The sketch
places every element in a hashed bin, round after round, and a bin keeps the
least value of the first round that reached it; in later rounds element after
element meets one fixed bin, so that every coordinate fills, and the share of
equal coordinates concentrates around the similarity. Bands of coordinates name
buckets. Then, without ever listing the pairs of a bucket:

1. documents with the same set are one class from here on;
2. each bucket links its members with its first (a star), and these links are
   verified on the full sets, which gives components;
3. buckets whose members still lie in different components compare these, in
   blocks of bounded size that bring the full sets with them: a pair from two
   components whose sketches don't rule it out is verified at once, and if it
   holds, its components are one for the rest of the block. So a block hands on
   a forest of links, fewer than it has rows, however many pairs it looked at.

A pair of similarity 0.75 shares one of the 40 bands of 4 coordinates but for
3 in 10 million, and agrees in fewer than 92 of its 160 coordinates with less
than that. All rows of a bucket meet, however many they are: the blocks of a
large one grow to ``crowd`` rows, since each row travels once per block.

Texts that are null or without words have an empty set and are linked with
nothing. Each row counts by itself: repeated rows fall in one class. A row
without ``doc_id`` gets no ``component_id`` of its own unless its text is that of
a row with one; ``kept`` is then false, else null ids are kept. An empty table
gives an empty result. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import carrying, mix, raw_texts, slices, stored, word_hashes
from lamina.llm.graph import components, extended

WORDS, BANDS, ROWS = 5, 40, 4
SIZE = BANDS * ROWS
#: Least equal coordinates for a pair to be verified; rows of a block, and of one in a bucket of more than ``SIDE`` blocks.
LEAST_EQUAL, BLOCK, CROWD, SIDE = 92, 1000, 4000, 4
#: Shingles of a block, so that long texts make smaller blocks; a set with more is a block's worth by itself.
BLOCK_SHINGLES = 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * _STEP
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Of each text, the sorted hashes of its distinct runs of ``words`` words; of all words as one run if there are fewer."""
    hashes, counts = word_hashes(*raw_texts(column))
    runs = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        runs = runs * _STEP + hashes[k : k + len(runs)]
    runs = mix(runs)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(runs[at : at + n - words + 1]))
        elif n:
            one = np.uint64(n)
            for h in hashes[at : at + n].tolist():
                one = np.uint64((int(one) * int(_STEP) + h) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([one])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def sketches(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """One row of ``size`` coordinates per set; an empty set's row stays at the largest value."""
    sk = np.full(len(sets) * size, np.iinfo(np.uint64).max, np.uint64)
    lengths = np.array([len(s) for s in sets], np.int64)
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), lengths)
    for r in range(2 * size):
        if not len(x):
            break
        h = mix(x + _SEEDS[r])
        at = of * size + (((h >> _32) * np.uint64(size)) >> _32).astype(np.int64) if r < size else of * size + (r - size)
        np.minimum.at(sk, at, (np.uint64(r) << _32) | (h & _LOW))
        empty = (sk.reshape(-1, size) == np.iinfo(np.uint64).max).any(axis=1)
        keep = empty[of]
        x, of = x[keep], of[keep]
    return sk.reshape(-1, size)


def band_keys(sk: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sk), 1))
    for k in range(ROWS):
        keys = mix(keys * _STEP + sk.reshape(-1, BANDS, ROWS)[:, :, k])
    return keys.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """Per row a number, set size and 128-bit set identity, band keys, 8 bits of each coordinate, and the text, for verification."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                sets = shingle_sets(some.column("text"))
                sk = sketches(sets)
                keys = band_keys(sk)
                low = [int(mix(s + _STEP).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
                high = [int(np.bitwise_xor.reduce(mix(s ^ _STEP)).view(np.int64)) if len(s) else 0 for s in sets]
                bands = pa.ListArray.from_arrays(np.arange(0, len(sets) * BANDS + 1, BANDS, dtype=np.int32), keys.reshape(-1))
                small = mix(sk).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({
                    "row": some.column("row"), "doc_id": some.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "low": pa.array(low, pa.int64()),
                    "high": pa.array(high, pa.int64()), "bands": bands, "sk": pa.array([v.tobytes() for v in small], pa.binary()), "text": some.column("text")})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = rows.mapInArrow(run, "row long, doc_id long, n long, low long, high long, bands array<long>, sk binary, text string")
    return stored(made, "signatures")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, SIZE)


def _sets(rows: DataFrame, sig: DataFrame) -> DataFrame:
    """``row``, ``sk`` and the set's hashes, for the given rows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                sets = pa.array([s.tobytes() for s in shingle_sets(some.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("row"), some.column("sk"), sets], ["row", "sk", "shingles"])

    return sig.select("row", "sk", "text").join(rows.hint("merge"), "row", "left_semi").mapInArrow(run, "row long, sk binary, shingles binary")


def _likely(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sketches agree in enough coordinates and whose sizes allow the similarity."""
    of = lambda c: sig.select(F.col("row").alias(c), F.col("sk").alias(f"sk_{c}"), F.col("n").alias(f"n_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_matrix(batch.column(c).to_pylist()) for c in ("sk_a", "sk_b"))
                yield batch.filter(pa.array((a == b).sum(axis=1) >= LEAST_EQUAL)).select(["a", "b"])

    both = pairs.join(of("b"), "b").join(of("a"), "a").where("least(n_a, n_b) * 100 >= greatest(n_a, n_b) * 75")
    return both.select("a", "b", "sk_a", "sk_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sig: DataFrame, percent: int = 75) -> DataFrame:
    """Of the pairs (a, b), those with 100 * shared >= percent * all shingles, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text_b"):
                first: dict[int, np.ndarray] = {}
                ids, keep = some.column("a").to_pylist(), []
                for k, (a, b) in enumerate(zip(ids, shingle_sets(some.column("text_b")))):
                    if a not in first:
                        first = {a: shingle_sets(some.column("text_a").slice(k, 1))[0]}
                    shared = len(np.intersect1d(first[a], b, assume_unique=True))
                    keep.append(100 * shared >= percent * (len(first[a]) + len(b) - shared))
                yield some.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    texts = sig.select("row", "text").join(wanted, "row", "left_semi")
    of = lambda c: texts.select(F.col("row").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _mixed(members: DataFrame) -> DataFrame:
    """Buckets whose members have more than one label, with their rows and shingles."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return sizes.where("lo <> hi").select("key", "size", "shingles")


def _links_in(row: np.ndarray, n: np.ndarray, label: np.ndarray, blk: np.ndarray, sk: np.ndarray, shingles: np.ndarray, one: bool,
              percent: int = 75) -> list[tuple[int, int]]:
    """Links between rows of different labels with 100 * shared >= percent * all shingles, each joining what the ones
    before it have not. Rows of one block are compared only if the group holds ``one`` block."""
    label, start, codes = label.copy(), np.concatenate([[0], np.cumsum(n)]), np.unique(shingles, return_inverse=True)[1]
    mine, found = np.zeros(len(shingles), np.uint8), []
    for k in range(len(row) - 1):
        later = slice(k + 1, None)
        other = np.flatnonzero((label[later] != label[k]) & ((blk[later] != blk[k]) | one)
                               & (np.minimum(n[later], n[k]) * 100 >= np.maximum(n[later], n[k]) * percent)) + k + 1
        other = other[(sk[other] == sk[k]).sum(axis=1) >= LEAST_EQUAL]
        if not len(other):
            continue
        size = n[other]
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(start[other] - first, size)
        mine[codes[start[k] : start[k + 1]]] = 1
        shared = np.add.reduceat(mine[codes[at]], first, dtype=np.int64)
        mine[codes[start[k] : start[k + 1]]] = 0
        for j in other[100 * shared >= percent * (n[k] + size - shared)].tolist():
            if label[j] != label[k]:
                found.append((row[k], row[j]))
                label[label == label[j]] = label[k]
    return found


def _across(members: DataFrame, sig: DataFrame, block: int, crowd: int) -> DataFrame:
    """Verified links (a, b) of one bucket between different labels, a forest of
    each group. A bucket of any size is laid out in blocks, and each pair of
    blocks is one group of at most two blocks, so that every pair of rows meets."""

    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("row")
        found = _links_in(*(frame[c].to_numpy() for c in ("row", "n", "label", "blk")), _matrix(frame["sk"]),
                          np.frombuffer(b"".join(frame["shingles"]), np.uint64), key[1] == key[2])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    by_rows = F.least(F.ceil(F.col("size") / block), F.greatest(F.ceil(F.col("size") / crowd), F.lit(SIDE)))
    blocks = F.greatest(by_rows, F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    sized = stored(members.join(_mixed(members), "key").withColumn("blocks", blocks), "sized")  # read twice below
    dealt = sized.withColumn("blk", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "row", "n", "label")
    dealt = dealt.hint("merge").join(_sets(sized.select("row").distinct(), sig), "row")  # rows grow with the input
    return dealt.groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest
    ``doc_id`` that links reach) and ``kept`` (whether that is its own)."""
    return _grouped(docs, block, crowd).drop("key")


@carrying
def deduplicated(docs: DataFrame, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """``docs`` with one row of each group, that of its smallest ``doc_id``; rows that repeat id and text count once."""
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    gone = _grouped(docs, block, crowd).where("not kept").select(F.col("key").alias("_gone")).distinct()
    return keyed.join(gone, F.col("_key") == F.col("_gone"), "left_anti").dropDuplicates(["_key"]).select(*docs.columns)


def _grouped(docs: DataFrame, block: int, crowd: int) -> DataFrame:
    """The result of ``near_duplicates`` with a ``key`` made of id and text."""
    sig = signatures(docs)
    classes = stored(sig.where("n > 0").groupBy("n", "low", "high").agg(F.min("row").alias("row"), F.min("doc_id").alias("least")), "classes")
    one = sig.join(classes.select("row"), "row", "left_semi")
    rows = one.select("row", "n", F.explode("bands").alias("key"))
    heads = rows.groupBy("key").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(rows.join(heads, "key").select("key", "row", "n", "head", "size"), "members")
    star = stored(_likely(members.where("row <> head").select(F.col("head").alias("a"), F.col("row").alias("b")).distinct(), sig), "star")
    parts = stored(components(stored(_verified(star, sig), "links")), "parts")
    label = F.coalesce("label", "row").alias("label")
    crowded = members.where("size > 2").select("key", "row", "n")
    labelled = stored(crowded.join(parts.withColumnRenamed("node", "row"), "row", "left").select("key", "row", "n", label), "labelled")
    links = stored(_across(labelled, sig, block, crowd), "across")
    if not links.isEmpty():
        parts = stored(extended(parts, links), "parts")
    labels = classes.join(parts.withColumnRenamed("node", "row"), "row", "left").select("n", "low", "high", "least", label)
    least = labels.groupBy("label").agg(F.min("least").alias("component_id"))
    found = labels.join(least, "label").select("n", "low", "high", "component_id")
    rows = sig.select("doc_id", "n", "low", "high", F.xxhash64("doc_id", "text").alias("key"))
    return rows.join(found, ["n", "low", "high"], "left").select(
        "key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.col("component_id").isNull()).alias("kept"))
