"""Concatenate and cut: documents stand end to end, windows of fixed length are
cut out of the whole, and only the last window may need padding.

First pass: each task encodes its documents and notes where each begins inside
its partition. Prefix sums over one total per partition give global places.
Second pass: each document is cut where windows end; a piece is a boundary
record (document, place in it, window, place there). Nothing is shuffled but
one row per partition.

A null or empty text is its end id alone. Documents stand in the order in which
their partitions are read; repeated rows are packed as often as they occur. An
empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import running_base, scratch, slices, strings
from lamina.llm.tokens import TOKENIZER, encoder


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = 0) -> DataFrame:
    """The first pass, written to the shared folder: ids (unsigned 32-bit,
    little-endian) with the end id, their partition and place in it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, "text"):
                raw = [x + end for x in enc.encode(strings(some.column("text")))]
                n = np.array([len(x) // 4 for x in raw], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(raw), part, np.int64)), "doc_id": some.column("doc_id").cast(pa.int64()),
                    "at": pa.array(starts), "n": pa.array(n), "ids": pa.array(raw, pa.binary())})

    out = docs.select("doc_id", "text").mapInArrow(encode, "part long, doc_id long, at long, n long, ids binary")
    path = scratch(docs.sparkSession, "encoded")
    out.write.option("compression", "zstd").parquet(path)  # partition numbers and places come from this one run
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def pack(docs: DataFrame, length: int = 1024, tokenizer: str = TOKENIZER, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (in its document), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset`` (in its
    sequence), and with ``keep_ids`` the ids themselves."""
    table = encoded(docs, tokenizer, end_id)
    totals = table.groupBy("part").agg(F.sum("n").alias("n"))
    bases = running_base(totals, "part", {"n": "base"})
    placed = table.join(F.broadcast(bases), "part").withColumn("g", F.col("base") + F.col("at"))  # one row per partition

    def piece(w):
        begin = F.greatest(w * length, F.col("g")) - F.col("g")
        end = F.least((w + 1) * length, F.col("g") + F.col("n")) - F.col("g")
        ids = F.substring(F.col("ids"), (begin * 4 + 1).cast("int"), ((end - begin) * 4).cast("int"))
        fields = [begin.alias("start"), (end - begin).alias("length"), F.crc32(ids).alias("ids_crc32"), w.alias("sequence_id"),
                  (F.col("g") + begin - w * length).alias("offset")]
        return F.struct(*fields, *([ids.alias("ids")] if keep_ids else []))

    first, last = F.expr(f"g div {length}"), F.expr(f"(g + n - 1) div {length}")
    cut = placed.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return cut.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", *(["p.ids"] if keep_ids else []))


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """The windows themselves, from pieces with ids: ``sequence_id``, ``ids``
    (``length`` of them, the last window padded) and ``n_tokens`` without
    padding. A group never holds more than one window."""
    joined = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    whole = F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    pad = F.lit(np.full(length, pad_id, "<u4").tobytes())
    return joined.select("sequence_id", "n_tokens", F.substring(F.concat(whole, pad), 1, 4 * length).alias("ids"))
