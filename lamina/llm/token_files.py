"""Token-ID files: flat unsigned integers, 64-bit document offsets, and a
manifest whose bases come from prefix sums over the parts.

A part is three files in one folder: ``NAME.bin`` (ids, little-endian, 16 bits
wide when the vocabulary fits, else 32), ``NAME.off`` (int64 offsets in ids, one
more than documents) and ``NAME.doc`` (int64 document ids). The manifest has
one row per part: its name, sizes, and the ids and documents before it. A task
that runs twice writes under another name, and only names in the manifest
count, so lost executors and speculative copies leave no trace in the result.

Documents stand in ascending ``doc_id`` order (null first), equal ids by text.
A null or empty text is only its end id. An empty table has an empty manifest.
Columns other than the two named are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import file_system, running_base, scratch, slices, strings
from lamina.llm.tokens import TOKENIZER, encoder

#: Stands for a null doc_id in the .doc file.
NO_ID = np.iinfo(np.int64).min
#: Bytes of ids handed on in one batch when files are read.
READ_BYTES = 4 << 20


def id_type(tokenizer: str, end_id: int) -> str:
    return "<u2" if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encode every text, append ``end_id`` and write the files; returns the manifest."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    dtype = id_type(tokenizer, end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        sizes, ids = [], []
        with store.open_output_stream(f"{root}/{name}.bin") as out:
            for batch in batches:
                for some in slices(batch, "text"):
                    for raw in enc.encode(strings(some.column("text"))):
                        out.write(np.frombuffer(raw + end, "<u4").astype(dtype).tobytes())
                        sizes.append(len(raw) // 4 + 1)
                    ids += [NO_ID if x is None else x for x in some.column("doc_id").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype("<i8")
        for kind, values in (("off", offsets), ("doc", np.array(ids, "<i8"))):
            with store.open_output_stream(f"{root}/{name}.{kind}") as out:
                out.write(values.tobytes())
        if ids:
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_docs": [len(ids)], "n_tokens": [int(offsets[-1])]})

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(order[0]).sortWithinPartitions(*order)
    parts = ordered.mapInArrow(write, "part long, name string, n_docs long, n_tokens long")
    path = f"{folder}/parts"
    parts.write.parquet(path)  # once: the names of the attempts that count
    parts = spark.read.schema(parts.schema).parquet(path)
    bases = running_base(parts, "part", {"n_docs": "first_doc", "n_tokens": "first_token"})
    return parts.join(F.broadcast(bases), "part").select(  # one row per part on either side
        "part", F.lit(folder).alias("folder"), "name", F.lit(dtype).alias("dtype"), "n_docs", "n_tokens", "first_doc", "first_token")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The documents of the files, one row each: ``doc_id``, ``start`` (ids of
    all documents before it), ``n_tokens`` and ``ids`` (unsigned 32-bit,
    little-endian). Files are memory-mapped where the store allows it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, root = file_system(row["folder"])
                base = f"{root}/{row['name']}"
                local = store.type_name == "local"

                def numbers(kind: str, dtype: str) -> np.ndarray:
                    if local:
                        return np.memmap(f"{base}.{kind}", dtype, "r")  # noqa: B023
                    return np.frombuffer(store.open_input_file(f"{base}.{kind}").read(), dtype)  # noqa: B023

                ids, offsets, docs = numbers("bin", row["dtype"]), np.array(numbers("off", "<i8")), np.array(numbers("doc", "<i8"))
                k = 0
                while k < len(docs):
                    stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + READ_BYTES // 4, "right")) - 1)
                    here = docs[k:stop]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(here, pa.int64(), mask=here == NO_ID),
                        "start": pa.array(offsets[k:stop] + row["first_token"]),
                        "n_tokens": pa.array(np.diff(offsets[k : stop + 1])),
                        "ids": pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(offsets[k:stop].tolist(), offsets[k + 1 : stop + 1].tolist())], pa.binary())})
                    k = stop

    files = manifest.repartition(max(1, manifest.count()), "part")  # a task per part, about
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
