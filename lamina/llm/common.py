"""What several operators share: tables in the shared folder, files there, and
words over Arrow buffers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lamina.session import ensure_checkpoint_dir

#: Characters that separate words everywhere in this package: \x20 and \x09-\x0D.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that numpy code handles at once inside a task.
SLICE = 1 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files:
    cuts the lineage, and the rows stay the same however often they are read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, to size a number of blocks."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path (file, hdfs, s3, gs, or a mounted folder) and the path in it."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (fs.LocalFileSystem(), uri)


def running_base(totals: DataFrame, part: str, sizes: dict[str, str]) -> DataFrame:
    """Exclusive prefix sums over one row per partition (or file); the number
    of rows follows the number of partitions, not of documents."""
    w = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(part, *[F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long").alias(out) for c, out in sizes.items()])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, though it is used often."""
    return F.transform(F.array(value), use)[0]


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; one long text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, have = 0, 0
    for k, n in enumerate(size.tolist()):
        if have and have + n > most:
            yield batch.slice(start, k - start)
            start, have = k, 0
        have += n
    if start < batch.num_rows:
        yield batch.slice(start)


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column end to end, and the offsets of each row; null is empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])
_LOW_TABLE = _TABLE[_LOWER]
_POW = {"up": _powers(2, _BASE), "down": _powers(2, pow(_BASE, -1, 1 << 64))}


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, A-Z in lower case, and how many
    each text has. A word's hash is a polynomial over its bytes, taken as a
    difference of running sums, so that no word becomes a Python object."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    if len(_POW["up"]) < n + 1:
        size = 1 << int(n + 1).bit_length()
        _POW.update(up=_powers(size, _BASE), down=_powers(size, pow(_BASE, -1, 1 << 64)))
    inside = ~_IS_SPACE[data]
    first = np.zeros(n + 1, bool)  # a text's first byte never continues a word of the text before
    first[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:]))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOW_TABLE[data] * _POW["up"][:n], out=sums[1:])
    words = mix((sums[ends + 1] - sums[starts]) * _POW["down"][starts])
    return words, np.diff(np.searchsorted(starts, offsets))


def coalesce_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, whatever else the table carries; a column it
    lacks is null."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).alias(n) for n in names])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


#: Columns of documents that operators name; any other is carried along under a name that can't clash.
OWN_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For ``fn(docs, ...)`` that returns rows with the columns of ``docs``: extra columns may have any name, also one
    that ``fn`` uses itself or one with a dot. Columns that are named in the arguments keep theirs."""
    @wraps(fn)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        kept = {*OWN_COLUMNS, *[a for a in (*args, *kwargs.values()) if isinstance(a, str)]}
        safe = [n if n in kept else f"carried_{i}" for i, n in enumerate(docs.columns)]
        back = dict(zip(safe, docs.columns))
        out = fn(docs.toDF(*safe), *args, **kwargs)
        return out.toDF(*[back.get(c, c) for c in out.columns])

    return run
