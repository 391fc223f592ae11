import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import texts

from lamina.llm import lm_score, toxicity, warc


@pytest.fixture(scope="module")
def scored(docs):
    return lm_score.scores(docs).collect()


def tokens(text):
    return (text or "").encode().lower().split() + [b" end"]


def test_base_scores(scored):
    rows = [(d, t, zlib.crc32(str(d if d is not None else "").encode()) % 10 == 0) for d, t, *_ in texts()]
    c = Counter(w for _, t, out in rows if not out for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t, out in rows:
        w = tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[d, out, len(w), sum(c[x] > 0 for x in w), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored) == want


def test_scores_are_probabilities(scored):
    assert all(r.score < 0 for r in scored)
    assert all((r.bits_per_byte is None) == (not t) for r, t in [(r, 0) for r in scored if r.n_tokens == 1 and r.bits_per_byte is None])


def test_spelling_sums_to_one():
    m = lm_score.Model()
    r = np.random.default_rng(3)
    for slots, bit, _, _ in lm_score.Bits([bytes([97 + int(k) % 3]) * (1 + int(k) % 4) for k in r.integers(0, 99, 300)]).steps():
        for v, n in ((0, m.n0), (1, m.n1)):
            for k in range(lm_score.K):
                np.add.at(n, slots[bit == v, k], 1.0)
    one = sum(10 ** x for x in m.log10_words([bytes([b]) for b in range(256) if b != 32]))
    assert 0 < one < 1  # words of one byte have part of the whole
    first = lm_score.Bits([b"a"]).data
    assert first.tolist() == [97, 32]


def test_lengths_sum_to_one():
    m = lm_score.Model()
    m.ends[:6] = [[5, 1], [6, 2], [9, 3], [20, 4], [30, 5], [7, 7]]
    assert abs((10 ** m.log10_length(np.arange(3000))).sum() - 1) < 1e-3


def test_no_training_rows_and_empty(docs, none):
    assert lm_score.scores(none).count() == 0
    held = docs.where("doc_id is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 10) = 0")
    rows = lm_score.scores(held).collect()
    assert rows and all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in rows)


def test_trained_text_is_likelier(spark):
    r = random.Random(4)
    words = ["".join(r.choice(["ba", "ko", "ti", "mu", "le"]) for _ in range(r.randint(1, 3))) for _ in range(300)]
    rows = [(k, " ".join(r.choice(words) for _ in range(80))) for k in range(150)]
    rows += [(1000 + k, "".join(r.choice("qxzwvj ") for _ in range(400))) for k in range(20)]
    got = lm_score.scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    usual = [x.bits_per_byte for x in got if x.doc_id < 1000]
    assert max(usual) < min([x.bits_per_byte for x in got if x.doc_id >= 1000] or [9])


@pytest.fixture(scope="module")
def marked(spark):
    r = random.Random(6)
    plain = ["".join(r.choice(["an", "er", "tion", "the", "ing", "st"]) for _ in range(r.randint(1, 3))) for _ in range(800)]
    bad = ["worthless", "idiot", "disgusting", "pathetic"]
    rows, labels = [], []
    for k in range(400):
        w = [r.choice(plain) for _ in range(r.randint(20, 120))]
        toxic = int(k % 5 == 0)
        for _ in range(4 * toxic):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((k, " ".join(w), k))
        labels.append((k, 1, toxic))
    rows += [(900, None, 1), (901, "", 1), (901, "", 1), (902, "x" * 9000, 1), (None, "no id", 1)]
    labels += [(None, 1, 1), (5, None, None), (0, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(marked):
    docs, labels = marked
    model = toxicity.train(docs, toxicity.training_rows(labels))
    rows = toxicity.with_score(docs, model, "s").collect()
    assert len(rows) == docs.count()
    held = [(r.doc_id % 5 == 0, r.s) for r in rows if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum((s >= 0.7) == t for t, s in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.s < 0.5 for r in rows if r.doc_id is None or r.doc_id >= 900)


def test_no_labels(marked):
    docs, labels = marked
    assert toxicity.train(docs, labels.where("false")) is None
    assert toxicity.train(docs.where("false"), labels) is None
    assert toxicity.with_score(docs, None).where("score <> 0").count() == 0


PAGES = "page_id long, url string, html string, digest string, segment int"


def pages(spark):
    long = "<p>ünï " + "x y z " * 9000
    rows = [(3, "http://a/3", "<p>one"), (1, "http://a/1", "<p>one"), (7, None, long), (8, "http://a\r\n/8", long + "!"), (9, "http://a/9", long), (4, "u", None), (5, "u", ""),
            (6, "u", "a\r\n\r\n0\r\n\r\nb"), (1, "http://a/1", "<p>one"), (8, "http://a\r\n/8", long + "!"), (None, "n", "<p>one"), (None, "n", "alone")]
    return rows, spark.createDataFrame([(*r, "d", 2) for r in rows], PAGES).repartition(3)


def test_warc_round_trip(spark):
    rows, table = pages(spark)
    got = warc.read_archives(spark, warc.write_archives(table, segment_bytes=2000, archive_bytes=4000)).collect()
    least = {}
    for i, _, h in rows:
        h = h or ""
        least[h] = i if least.get(h) is None else least[h] if i is None else min(i, least[h])
    want = Counter()
    for i, _, h in rows:
        h = h or ""
        first = i == least[h]
        want[i, len(h.encode()), warc.digest_of(h.encode()), "response" if first else "revisit", None if first else least[h], h if first else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.html) for r in got) == want
    assert warc.read_records(warc.write_archives(table, segment_bytes=2000), True).count() > 20


def test_small_payloads_are_not_revisits(spark):
    _, table = pages(spark)
    got = warc.read_archives(spark, warc.write_archives(table, least_bytes=1000), with_html=False)
    assert {r.page_id for r in got.where("record_type = 'revisit'").collect()} == {9}


def test_missing_segment_is_noticed(spark):
    _, table = pages(spark)
    segments = warc.read_records(warc.write_archives(table, segment_bytes=2000), True)
    with pytest.raises(Exception, match="add up"):
        warc.reassembled(segments.where("segment <> 2")).collect()


def test_chunked_framing():
    for n in (0, 1, 10, 4096, 9999):
        p = bytes(k % 251 for k in range(n))
        assert warc.unchunked(warc.chunked(p, 100)) == p
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_empty_pages(spark):
    _, table = pages(spark)
    assert warc.read_archives(spark, warc.write_archives(table.where("false"))).count() == 0


def test_successors_are_summed_over_blocks(spark):
    r = random.Random(8)
    rows = [(k, " ".join("a " + r.choice(["b", "b", "c"]) for _ in range(20)) + f" x{k}") for k in range(60)]
    rows += [(100 + k, "a c a c a c a c a c a c") for k in range(3)]  # more of one successor than any other block has of the usual one
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = Counter()
    for d, t in rows:
        w = t.encode().split()
        if zlib.crc32(str(d).encode()) % 10:
            pairs.update(zip(w, w[1:]))
    entries = lm_score.numbered(docs.repartition(20), 10, 0).where("word is not null")
    assert entries.select("block").distinct().count() > 5
    got = {bytes(x.word): (x.after >> 31, x.after & 0x7FFFFFFF) for x in lm_score.words_and_successors(entries).collect()}
    usual = max((b for a, b in pairs if a == b"a"), key=lambda b: pairs[b"a", b])
    assert got[b"a"] == (pairs[b"a", usual], int(lm_score.hash31([usual])[0]))


def test_scores_do_not_depend_on_the_split(spark):
    docs = spark.createDataFrame([(k, t) for k, t, *_ in texts() if k is not None and k < 250], "doc_id long, text string")
    one, many = ({r.doc_id: r.score for r in lm_score.scores(docs.repartition(n, "doc_id")).collect()} for n in (1, 12))
    assert one.keys() == many.keys()
    assert all(abs(one[k] - many[k]) <= 1e-3 * abs(one[k]) for k in one)


def test_counts_of_all_occurrences(spark):
    words = [["the", "cat"], ["the", "dog", "the", "cat"], ["the"]] * 3
    docs = spark.createDataFrame([(" ".join(w),) for w in words], "text string").repartition(2)
    m = lm_score.Model(lm_score.slots_for(100))
    lm_score._count(docs, m)
    want = np.zeros((2, len(m.n0)))
    for text in words:
        for before, word in zip([None, *text], text):
            after = None if before is None else lm_score.hash64([before.encode()])
            for slots, bit, _, _ in lm_score.Bits([word.encode()], after, m.slots).steps():
                for row, b in zip(slots, bit):
                    want[b, row] += 1
    assert (m.n0 == want[0]).all() and (m.n1 == want[1]).all()


def test_word_before_counts_beyond_the_usual_successor(spark):
    r = random.Random(5)
    after = {"la": ["mi", "mi", "mi", "ko", "ko"], "du": ["ne", "ne", "ne", "ra", "ra"]}
    texts_ = [" ".join(f"{w} {r.choice(after[w])}" for w in r.choices(["la", "du"], k=40)) for _ in range(120)]
    train = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 10]
    held = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [*zip(train, texts_), (held[0], "la ko " * 10), (held[1], "la ra " * 10)]
    got = {x.doc_id: x.score for x in lm_score.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 3  # neither is the usual successor, both words are equally frequent
