import hashlib
import itertools
import random
import re
import zlib

from lamina.llm import turn_repair
from lamina.llm.queries import QUERIES

LEGAL = re.compile("(s?(ua)+)?")
COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
SCHEMA = "conv_id long, turn long, role string, text string, place long, key string, n long"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not last else "d" if (role, text) in seen else "t" if last[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def exhaustive(rows, faults, most=2):
    """The cheapest edits by trying all of them, up to ``most`` insertions at a place."""
    inserts = ["".join(x) for k in range(most + 1) for x in itertools.product("ua", repeat=k)]
    choices = [[("D", 3, "")] + ([] if f in "bd" else [("K", f == "t", role[:1] or "?"), ("R", 2 + (f == "t"), "u"), ("R", 2 + (f == "t"), "a")]) for (role, _), f in zip(rows, faults)]
    best = None
    for edits in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            word = gaps[0] + "".join(e[2] + g for e, g in zip(edits, gaps[1:]))
            if LEGAL.fullmatch(word):
                new = (sum(e[1] for e in edits) + 2 * sum(map(len, gaps)), "I" * len(gaps[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, gaps[1:])))
                best = min(best or new, new)
    return best


def by_rows(rows, faults):
    """The cheapest edits row by row, state by state, and the repaired turns."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def closed(states):
        for _ in range(4):
            for p, (c, audit, out) in list(states.items()):
                for role in "ua":
                    q = step.get((p, role))
                    new = (c + 2, audit + "I", out + [({"u": "user", "a": "assistant"}[role], "")])
                    if q and (q not in states or new[:2] < states[q][:2]):
                        states[q] = new
        return states

    states = closed({"": (0, "", [])})
    for (role, text), f in zip(rows, faults):
        after = {}
        for p, (c, audit, out) in states.items():
            options = [(p, 3, "D", [])]
            if f not in "bd":
                options += [(step.get((p, role[:1])), f == "t", "K", [(role, text)])] if role else []
                options += [(step.get((p, x[0])), 2 + (f == "t"), "R", [(x, text)]) for x in ("user", "assistant")]
            for q, cost, letter, turn in options:
                new = (c + cost, audit + letter, out + turn)
                if q is not None and (q not in after or new[:2] < after[q][:2]):
                    after[q] = new
        states = closed(after)
    return min((states[q] for q in ("", "a") if q in states), key=lambda x: x[:2])


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    return out


def expected(rows, ids):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for conv in ids:
        some = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns, pairs = [r[1] for r in some if r[1] is not None], [(r[2], r[3]) for r in some]
        faults = faults_of(pairs)
        cost, audit, turns_out = by_rows(pairs, faults)
        initials = [role[:1] for role, _ in pairs]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(x) for x in "bdt"], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                    cost, audit, sha("\n".join(f"{r}:{t}" for r, t in turns_out))))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def as_rows(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in df.collect()], key=lambda r: (r[0] is not None, r[0] or 0))


def made(n, longest, seed):
    r = random.Random(seed)
    roles, ends = ["system", "user", "assistant", "user", "assistant", "tool", "", None], [".", "!", "", " ", "?\n", "…"]
    rows = []
    for conv in range(n):
        for k in range(r.randint(1, longest)):
            text = r.choice([None, "", " \t", *[f"{r.choice('ab')}{r.choice(ends)}" for _ in range(8)], f"text {k}."])
            rows.append((conv if conv % 11 else None, r.choice([k, k, k, k + r.randint(0, 3), None]), r.choice(roles), text))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "key", 9) for r in rows], SCHEMA).repartition(5)


def test_cells_equal_exhaustive_edits():
    r = random.Random(2)
    for _ in range(60):
        rows = [(r.choice(["system", "user", "assistant", "tool"]), r.choice(["", "a.", "b", "c."])) for _ in range(r.randint(0, 3))]
        faults = faults_of(rows)
        symbols = "".join(turn_repair.SYMBOLS[(role[0] if role[0] in "sua" else "?") + f] for (role, _), f in zip(rows, faults))
        cell = turn_repair.span_cell(symbols)
        assert min(cell[0, q] for q in turn_repair.FINAL if (0, q) in cell) == exhaustive(rows, faults) == by_rows(rows, faults)[:2]


def test_any_split_gives_the_cell_of_a_span():
    r, letters = random.Random(5), list(turn_repair.SYMBOLS.values())
    for _ in range(50):
        s = "".join(r.choice(letters) for _ in range(r.randint(2, 40)))
        assert {repr(sorted(turn_repair.join(turn_repair.span_cell(s[:k]), turn_repair.span_cell(s[k:])).items())) for k in range(1, len(s))} == {repr(sorted(turn_repair.span_cell(s).items()))}


def test_short_conversations(spark):
    rows = made(120, 9, 1)
    assert as_rows(turn_repair.repair(table(spark, rows))) == expected([(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows], {r[0] for r in rows})


def test_long_conversations_are_joined_by_levels(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "FAN", 4)
    rows = made(3, 400, 7) + made(20, 3, 8)
    assert as_rows(turn_repair.repair(table(spark, rows))) == expected([(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows], {r[0] for r in rows})


def test_damage_and_conversations_without_rows(spark):
    rows = made(300, 3, 4) + [(None, None, None, None), (7, 0, "user", "very " * 20_000 + "long")]
    conversations = table(spark, rows)
    got = as_rows(turn_repair.repair(turn_repair.damaged(conversations), conversations))
    assert got == expected(damaged(rows), {r[0] for r in rows})
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)


def test_repaired_turns_follow_the_pattern(spark):
    rows = turn_repair.placed(turn_repair.spaced(table(spark, made(60, 12, 3))))
    turns = turn_repair.repaired(rows, turn_repair.parsed(turn_repair.with_symbols(rows))).collect()
    by_conv = {}
    for t in turns:
        by_conv.setdefault(t.conv_id, []).append((t.n, t.role[0]))
    assert all(LEGAL.fullmatch("".join(x for _, x in sorted(some))) for some in by_conv.values())


def test_empty_table(spark):
    assert turn_repair.repair(table(spark, [(1, 1, "user", "a")]).where("conv_id = 2")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(QUERIES["op12_turn_repair"](spark, sf)) == expected(damaged(rows), {r[0] for r in rows})
