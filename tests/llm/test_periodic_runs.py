import hashlib
import random
import zlib

from fixtures import DOCS, spaces, texts

from lamina.llm import periodic_runs
from lamina.llm.queries import QUERIES


def brute_runs(w):
    """Every maximal stretch of at least max(6, 4 q) words, for its smallest period q."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, text):
    w = spaces(text)
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = planted(doc_id, text)
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def key(row):
    return tuple((x is not None, x) for x in row)


def made():
    r = random.Random(3)
    for _ in range(900):
        letters, w = "abcdefgh"[: r.choice([1, 2, 2, 3, 6])], []
        for _ in range(r.randint(0, 8)):
            unit = [r.choice(letters) for _ in range(r.randint(1, 40))]
            w += unit[: r.randint(0, 30)] if r.random() < 0.5 else (unit * 8)[: len(unit) * r.randint(2, 7) - r.randint(0, len(unit))]
        yield w


def test_runs_equal_brute_force():
    some = list(made())
    for k in range(0, len(some), 30):
        runs, out = periodic_runs._of_slice([" ".join(w) for w in some[k : k + 30]])
        for w, found, text in zip(some[k : k + 30], runs, out):
            want = brute_runs(w)
            assert [(x["start"], x["length"], x["period"]) for x in found] == want, w
            assert text == collapsed(w, want)


def test_long_periods():
    r = random.Random(9)
    for q in (4, 7, 8, 15, 16, 17, 63, 64, 100, 1000):
        unit = [str(r.randint(0, 3)) for _ in range(q - 1)] + ["end"]
        around = [str(r.randint(10, 99999)) for _ in range(50)]
        for n in (4 * q - 1, 4 * q, 5 * q + 3):
            w = around + (unit * 6)[:n] + around
            found = [(x["start"], x["length"], x["period"]) for x in periodic_runs._of_slice([" ".join(w)])[0][0]]
            assert ((50, n, q) in found) == (n >= 4 * q)
            assert all(x in found for x in brute_runs(w) if q <= 64)


def test_nested_periods():
    """A run of short runs: the windows inside the short ones take no part in the long scale."""
    w = ((["a"] * 40 + ["b"]) * 5 + ["c"]) * 5
    found = [(x["start"], x["length"], x["period"]) for x in periodic_runs._of_slice([" ".join(w)])[0][0]]
    assert found == brute_runs(w)


def test_table(spark, docs):
    got = periodic_runs.summarised(periodic_runs.periodic_runs(periodic_runs.planted(docs))).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=key) == sorted([expected(i, t) for i, t, *_ in texts()], key=key)


def test_awkward_texts(spark):
    rows = [(1, None, None, None, 0, 1, 1, "p", "w"), (2, "", None, None, 0, 1, 1, "p", "w"), (3, " \t\n", None, None, 0, 1, 1, "p", "w"), (4, "a a a a a a", None, None, 0, 1, 1, "p", "w"),
            (5, "a a a a a a a a a a A", None, None, 0, 1, 1, "p", "w"), (6, "  é\té  é é\r\né é x", None, None, 0, 1, 1, "p", "w"), (6, "  é\té  é é\r\né é x", None, None, 0, 1, 1, "p", "w")]
    found = {r.doc_id: r for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, DOCS)).collect()}
    assert [len(found[k].runs) for k in range(1, 7)] == [0, 0, 0, 1, 0, 1]
    assert [found[k].collapsed for k in range(1, 7)] == ["", "", "", "a", "a a a a a a a a a a A", "é x"]


def test_empty_table(none):
    assert periodic_runs.summarised(periodic_runs.periodic_runs(periodic_runs.planted(none))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert got == {r.doc_id: expected(r.doc_id, r.text) for r in docs}
    assert sum(x[1] for x in got.values()) > 0
