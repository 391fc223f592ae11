"""Conversation structure repair by weighted CYK interval parsing.

The roles of a conversation must read ``(s?(ua)+)?``: perhaps a system turn, then
user and assistant in turn. Rows are kept (0, ``K``), given another role (2, ``R``)
or deleted (3, ``D``); empty turns are inserted (2, ``I``). Blank and duplicate
rows must go; a truncated row that stays costs 1. Of the cheapest edits the ones
whose initials are least in ASCII order count.

The grammar is in Chomsky normal form. Its nonterminals are ``X[p, q]``: what leads
from state p of the pattern to state q. ``X[p, q] -> X[p, r] X[r, q]`` for all r,
and one row gives ``X[p, q]`` by its edits, with any insertions before and after
it (the insertion closure). A cell holds the least (cost, audit) of each
nonterminal over a span of rows, and cells are combined bottom-up by span
length. Two audits of the same span and cost are never one the beginning of the
other (that would need free insertions), so the least audit of a whole is made
of least audits of its parts.

Spans of up to ``SPAN`` rows are parsed over all their splits. A cell depends on
the rows' initials and faults alone, so it is kept by that string and shared by
all conversations. Every state lies between two rows, so any one split gives the
cell of a longer span; a conversation of any length is cut into blocks, whose
cells are joined level by level, ``FAN`` neighbours at a time, in Spark. Places
in a conversation come from a range sort, so that one conversation with a third
of all rows is spread over many tasks. Only the result itself, the audit and the
hash of the repaired text, is one value per conversation: its rows pass through
one task as a stream that holds one row at a time.

Nulls in any column read as one space. Rows are taken by turn (null first), then
role and text. ``initial`` of a role is its first character; roles that don't
begin with s, u or a can't be kept, nor can an empty role. A conversation
without rows has zeros, an empty audit and the hash of the empty text. A null
conversation id is an id of its own. Repeated rows are duplicates. An empty
table gives an empty table. Columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lamina.llm.common import running_base, stored

#: Rows of a span that is parsed over all splits, and cells joined by one task of a level.
SPAN, FAN = 8, 64
#: Costs of the edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a. The text may end in the first or the last.
STATES, STEPS = range(4), {(0, 1): "s", (0, 2): "u", (1, 2): "u", (2, 3): "a", (3, 2): "u"}
FINAL = (0, 3)
#: A row in a span: its initial (s, u, a or another) and its fault (none, blank, duplicate, truncated), one letter.
INITIALS, FAULTS = "sua?", "-bdt"
SYMBOLS = {i + f: chr(65 + 4 * x + y) for x, i in enumerate(INITIALS) for y, f in enumerate(FAULTS)}
_MEANING = {v: k for k, v in SYMBOLS.items()}
#: Most cells kept by a Python worker.
KEPT = 100_000

Cell = dict[tuple[int, int], tuple[int, str]]


def join(left: Cell, right: Cell) -> Cell:
    """The binary rules: the least of X[p, r] X[r, q] over r."""
    out: Cell = {}
    for (p, r), (c, x) in left.items():
        for q in STATES:
            other = right.get((r, q))
            if other is not None:
                new = (c + other[0], x + other[1])
                if (p, q) not in out or new < out[p, q]:
                    out[p, q] = new
    return out


def least(cells: list[Cell]) -> Cell:
    out: Cell = {}
    for cell in cells:
        for k, v in cell.items():
            if k not in out or v < out[k]:
                out[k] = v
    return out


def closure() -> Cell:
    """Insertions alone: the cell of no rows."""
    one = {k: (INSERT, "I") for k, role in STEPS.items() if role != "s"}
    out: Cell = {(p, p): (0, "") for p in STATES}
    while (more := least([out, join(out, one)])) != out:
        out = more
    return out


_EMPTY = closure()


@lru_cache(maxsize=64)
def row_cell(symbol: str) -> Cell:
    initial, fault = _MEANING[symbol]
    edits: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if fault not in "bd":
        stays = TRUNCATED if fault == "t" else 0
        for k, role in STEPS.items():
            if role == initial:
                edits[k] = (stays, "K")
            elif role != "s":
                edits[k] = (REROLE + stays, "R")
    return join(join(_EMPTY, edits), _EMPTY)


_CELLS: dict[str, Cell] = {}


def span_cell(symbols: str) -> Cell:
    """The cell of a span of rows; shorter spans first, all splits up to ``SPAN`` rows."""
    if not symbols:
        return _EMPTY
    if len(symbols) == 1:
        return row_cell(symbols)
    if len(symbols) > SPAN:
        cells = [span_cell(symbols[k : k + SPAN]) for k in range(0, len(symbols), SPAN)]
        return join_all(cells)
    cell = _CELLS.get(symbols)
    if cell is None:
        for n in range(1, len(symbols)):
            span_cell(symbols[:n]), span_cell(symbols[n:])
        cell = least([join(span_cell(symbols[:k]), span_cell(symbols[k:])) for k in range(1, len(symbols))])
        if len(_CELLS) >= KEPT:
            _CELLS.clear()
        _CELLS[symbols] = cell
    return cell


def join_all(cells: list[Cell]) -> Cell:
    """Neighbours in pairs, so that span lengths double."""
    while len(cells) > 1:
        cells = [join(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0]


_PAIRS = [(p, q) for p in STATES for q in STATES if (p, q) in _EMPTY or any((p, q) in row_cell(s) for s in _MEANING)]


def _packed(cell: Cell) -> list[dict | None]:
    return [None if k not in cell else {"cost": cell[k][0], "audit": cell[k][1]} for k in _PAIRS]


def _unpacked(cells: list[dict | None]) -> Cell:
    return {k: (v["cost"], v["audit"]) for k, v in zip(_PAIRS, cells) if v is not None}


_CELL = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))


def _cell_column(df: DataFrame, source: str, make) -> DataFrame:
    """``df`` (conv_id, block, ``source``) with the cell that ``make`` gives of each value of ``source``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [_packed(make(x)) for x in batch.column(source).to_pylist()]
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id"), "block": batch.column("block"), "cell": pa.array(cells, _CELL)})

    return df.select("conv_id", "block", source).mapInArrow(run, "conv_id long, block long, cell array<struct<cost:long,audit:string>>")


def _in_order(value: str) -> Column:
    """The values of a group by ``place``; a group holds one block."""
    return F.transform(F.array_sort(F.collect_list(F.struct("place", value))), lambda x: x[value])


def parsed(symbols: DataFrame) -> DataFrame:
    """``conv_id``, ``cost`` and ``audit`` of rows (conv_id, place from 0, symbol)."""
    blocks = symbols.groupBy("conv_id", F.expr(f"place div {FAN}").alias("block")).agg(F.array_join(_in_order("symbol"), "").alias("s"))
    cells = stored(_cell_column(blocks, "s", span_cell), "cells")
    while (cells.agg(F.max("block")).first()[0] or 0) > 0:
        level = cells.select("conv_id", F.expr(f"block div {FAN}").alias("block"), F.col("block").alias("place"), "cell")
        groups = level.groupBy("conv_id", "block").agg(_in_order("cell").alias("cells"))
        cells = stored(_cell_column(groups, "cells", lambda some: join_all([_unpacked(c) for c in some])), "cells")
    ends = F.filter(F.array(*[F.col("cell")[_PAIRS.index((0, q))] for q in FINAL if (0, q) in _PAIRS]), lambda x: x.isNotNull())
    return cells.select("conv_id", F.array_min(ends).alias("best")).select("conv_id", "best.cost", "best.audit")


def placed(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with ``place`` from 0 in their conversation; a range sort, so that a large
    conversation is spread over many tasks, and one count per task and conversation it begins with."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    local = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    local = stored(local, "turns")  # places come from this one run
    totals = local.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    bases = F.broadcast(running_base(totals, "part", {"n": "base"}))  # one row per partition
    global_ = local.join(bases, "part").withColumn("at", F.col("base") + F.col("at")).drop("part", "base")
    firsts = global_.groupBy("conv_id").agg(F.min("at").alias("first")).withColumnRenamed("conv_id", "c")
    return global_.join(firsts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "turn", "role", "text", (F.col("at") - F.col("first")).alias("place"))


def with_symbols(rows: DataFrame) -> DataFrame:
    """Placed rows with ``initial``, ``fault`` (blank, duplicate, truncated: the first that holds) and ``symbol``, without
    the text. Copies are found by a count per distinct turn, not by looking back through the conversation."""
    marked = rows.select(
        "conv_id", "turn", "place", F.sha2(F.concat_ws("", F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256).alias("same"),
        F.substring("role", 1, 1).alias("initial"),
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "b").when(~F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?"), "t").otherwise("-").alias("seen"))
    firsts = marked.groupBy("conv_id", "same").agg(F.min("place").alias("first")).select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first")
    found = marked.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")))
    fault = F.when(F.col("seen") == "b", "b").when(F.col("place") > F.col("first"), "d").otherwise(F.col("seen"))
    known = F.when(F.col("initial").isin(*"sua"), F.col("initial")).otherwise("?")
    symbol = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])[F.concat(known, "fault")]
    return found.withColumn("fault", fault).select("conv_id", "turn", "place", "initial", "fault", symbol.alias("symbol"))


def counted(symbols: DataFrame) -> DataFrame:
    """Per conversation: gaps between turns, faults, and neighbours whose initials don't go together."""
    before = symbols.select(F.col("conv_id").alias("c"), (F.col("place") + 1).alias("p"), F.col("initial").alias("left"))
    pairs = symbols.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "left")
    is_ = lambda f: F.count(F.when(F.col("fault") == f, 1))
    faults = pairs.groupBy("conv_id").agg(
        is_("b").alias("blank"), is_("d").alias("duplicate"), is_("t").alias("truncated"),
        F.count(F.when(F.col("p").isNotNull() & ~F.concat("left", "initial").isin("su", "ua", "au"), 1)).alias("illegal"))
    turns = symbols.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")).withColumnRenamed("conv_id", "c")
    return faults.join(turns, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id``, ``n`` (from 0), ``role``, ``text``. An audit gives each row's new role, since
    the pattern leaves none open: only a first system turn that is kept reads s."""
    lines = audits.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.select("conv_id", "place", "role", "text").unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"conv_id": None, "audit": "", "at": 0, "n": 0, "system": False}
        for batch in batches:
            out: list[tuple] = []

            def put(role: str, text: str) -> None:
                out.append((state["conv_id"], state["n"], role, text))  # noqa: B023
                state["n"] += 1

            def inserted() -> None:
                while state["audit"][state["at"] : state["at"] + 1] == "I":
                    put(next_role(), "")
                    state["at"] += 1

            def next_role() -> str:
                return ("user", "assistant")[(state["n"] - state["system"]) % 2]

            for conv_id, place, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")]):
                if place < 0:
                    state = {"conv_id": conv_id, "audit": text, "at": 0, "n": 0, "system": False}
                else:
                    edit = state["audit"][state["at"]]
                    state["at"] += 1
                    if edit == "K":
                        if state["n"] == 0 and role[0] == "s":
                            state["system"] = True
                        put(role, text)
                    elif edit == "R":
                        put(next_role(), text)
                inserted()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "n", "role", "text"])

    return both.mapInArrow(run, "conv_id long, n long, role string, text string")


def hashed(turns: DataFrame) -> DataFrame:
    """sha256 of ``role:text`` lines of each conversation, joined by newlines. ``turns`` come in order from ``repaired``;
    the hash goes on from row to row, so a task holds no conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = conv = None
        for batch in batches:
            out = []
            for conv_id, n, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "n", "role", "text")]):
                if n == 0:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    digest, conv = hashlib.sha256(), conv_id
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out])], ["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def spaced(conversations: DataFrame) -> DataFrame:
    """The four columns, null role and text as one space."""
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def damaged(conversations: DataFrame) -> DataFrame:
    """Faults planted by crc32("conv_id:turn") % 20: 0 drops the row, 1 empties its text, 2 takes its [.!?] away, 3 repeats it, 4 makes it a user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = spaced(conversations).withColumn("kind", F.crc32(key.cast("binary")) % 20).where("kind != 0")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
    return copies.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"))


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit`` and ``repaired_sha256``. ``ids`` (conv_id) may name conversations that have no rows left."""
    rows = stored(placed(spaced(conversations)), "placed")
    symbols = stored(with_symbols(rows), "symbols")
    audits = stored(parsed(symbols), "audits")
    hashes = hashed(repaired(rows, audits))
    every = (ids if ids is not None else rows).select(F.col("conv_id").cast("long")).distinct()
    out = every
    for k, part in enumerate((counted(symbols), audits, hashes)):
        out = out.join(part.withColumnRenamed("conv_id", f"c{k}"), F.col("conv_id").eqNullSafe(F.col(f"c{k}")), "left").drop(f"c{k}")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
