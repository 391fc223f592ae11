import hashlib
import re
from collections import Counter

import pytest
from fixtures import spaces, texts

from lamina.llm import line_dedup, order_minhash, quality


def counts(text):
    w = spaces(text)
    runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if spaces(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_counts(docs):
    got = Counter(tuple(r)[:7] for r in quality.judged(docs).collect())
    assert got == Counter((d, *counts(t)) for d, t, *_ in texts())


def test_limits_adapt_to_the_group(spark):
    plain, odd = "this is an ordinary line of words that goes on for a while and says nothing much at all here now", "##"
    rows = [(k, f"{plain} {k}", "en", "a") for k in range(150)] + [(1000 + k, f"{plain} {k} " + f"{odd} " * 4, "en", "b") for k in range(150)]
    rows += [(2000, f"{plain} " + "#### " * 12, "en", "a"), (2001, f"{plain} x " + f"{odd} " * 4, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.judged(docs, least_rows=100).where("kept").collect()}
    assert 2000 not in kept and 2001 not in kept and len(kept) == 300  # what is usual in b is not in a
    assert {r.doc_id for r in quality.filtered(docs).collect()} == kept


def test_sketch_cells_keep_order_and_error(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 200_000, 37).withColumn("c", quality.cell(F.col("id"))).withColumn("v", quality.cell_value(F.col("c")))
    assert rows.where("v > id or id - v > id / 64.0").count() == 0


def test_empty_tables(none):
    assert quality.judged(none).count() == 0 and quality.filtered(none).count() == 0
    assert line_dedup.dedup_documents(none).count() == 0
    assert order_minhash.edited_fingerprints(none).count() == 0


def lines_brute(rows, ratio, least):
    pages, seen = Counter(s for *_, s in rows), Counter()
    blank = lambda x: not spaces(x)
    for _, t, _, s in rows:
        seen.update({(s, x) for x in (t or "").split("\n") if not blank(x)})
    out = []
    for d, t, _, s in rows:
        if t is None:
            out.append((d, None))
            continue
        all_ = t.split("\n")
        rest = [x for x in all_ if blank(x) or not (seen[s, x] > ratio * pages[s] and seen[s, x] >= least)]
        out.append((d, "\n".join(rest) if 2 * len("".join(rest)) >= len("".join(all_)) else t))
    return Counter(out)


def test_lines_by_host(spark):
    frame = "All rights reserved"
    rows = [(k, f"own line number {k} with some words\n\n{frame}\nmore of {k} to read", "en", "h" if k % 3 else None) for k in range(40)]
    rows += [(50, frame, "en", "h"), (51, None, "en", "h"), (52, "", "en", "h"), (53, f"own line\n{frame} ", "en", "h"), (0, rows[0][1], "en", None)]
    docs = spark.createDataFrame([(d, t, lang, s, 0) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = line_dedup.dedup_documents(docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert Counter((r.doc_id, r.text) for r in found) == lines_brute(rows, line_dedup.RATIO, line_dedup.LEAST_PAGES)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
    assert not any(frame in (r.text or "").split("\n") for r in found if r.doc_id not in (50,))


def test_pages(spark):
    html = '<html><script>var a = "<p>";</script><body><nav>Menu</nav><p>Text of {k}, <b>bold</b></p><!-- x --></body>'
    rows = [(k, f"http://User@Host.example:80/{k}", html.format(k=k)) for k in range(5)] + [(9, None, None), (10, "no url", "")]
    got = {r.page_id: r for r in line_dedup.dedup_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].host == "host.example" and got[1].text == "Text of 1," and got[1].n_dropped == 2
    assert got[9].host is None and got[9].n_lines == 0 and got[10].text == ""


@pytest.fixture(scope="module")
def prints(docs):
    return order_minhash.edited_fingerprints(docs).collect()


def test_edited_texts(prints):
    rows = texts()
    least = {}
    for d, t, *_ in rows:
        least.setdefault(d, []).append(t or "")
    order = sorted(least, key=lambda d: (d is not None, d or 0), reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    want = Counter()
    for d, t, *_ in rows:
        t, follower = t or "", min(least[after[d]])
        q = len(t) // 3
        want[d, len(t), hashlib.sha256((t[: len(t) - q] + follower[:q]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in prints) == want


def test_likeness(prints):
    by_text = {}
    ids = {d: t for d, t, *_ in texts() if d not in (303,)}
    for r in prints:
        if r.doc_id in ids:
            by_text.setdefault(ids[r.doc_id] or "", set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    body = [r for r in prints if r.doc_id is not None and r.doc_id < 30]
    assert sum(r.near_edited > r.near_next for r in body) >= 28


def test_order_counts(spark):
    from pyspark.sql import functions as F

    w = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(w)), (1, " ".join(w[100:] + w[:100])), (2, " ".join(w[:190])), (3, " ".join(reversed(w))), (4, " ".join(["la"] * 150)), (5, " ".join(["la"] * 140))]
    f = {r.id: r.f for r in spark.createDataFrame(rows, "id long, t string").select("id", order_minhash.fingerprint(F.col("t")).alias("f")).collect()}
    like = lambda a, b: sum(x == y for x, y in zip(f[a], f[b])) / len(f[a])
    assert like(0, 2) > 0.7 > like(0, 1) > like(0, 3)  # the halves exchanged share k-mers but not all of their order
    assert like(4, 5) > 0.5 and len(f[4]) == order_minhash.ENTRIES
