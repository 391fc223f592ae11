import os
import random

from lamina.operators import name_index as NI
from lamina.operators.name_index import NameIndex

SCORED = "mention string, qid string, weight double, source string, label_zh string, description string, popularity long, article_rank int, score double"


def split(s):
    out, word = [], ""
    for c in s.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute(wanted, rows, k):
    out = []
    for m in sorted(set(wanted)):
        w = split(m)
        if not w:
            continue
        hits = [r for r in rows if any(split(r[0])[i : i + len(w) - 1] == w[:-1] and split(r[0])[i + len(w) - 1 :][:1] and split(r[0])[i + len(w) - 1].startswith(w[-1]) for i in range(len(split(r[0]))))]
        hits.sort(key=lambda r: (-r[8], r[1], r[0]))
        out += [(m, r[0], r[1], r[8], pos) for pos, r in enumerate(hits[:k], 1)]
    return sorted(out)


def made(n, seed=3):
    r = random.Random(seed)
    words = ["new", "york", "Yorkshire", "news", "state", "of", "Of", "é", "北京", "a", "ab", "abc", "x1", "city"]
    rows = {(" ".join(r.choice(words) for _ in range(r.randint(1, 4))) + r.choice(["", "!", " -"]), f"Q{r.randint(1, 60)}") for _ in range(n)}
    rows |= {("---", "Q1"), ("", "Q2"), ("of of of", "Q3")}
    return [(m, q, 1.0, "label", m, None, 5, None, float(r.randint(0, 6))) for m, q in sorted(rows)]


WANTED = ["new", "ne", "new y", "new york", "york state of", "of of", "of o", "a", "ab a", "北", "é c", "zzz", "new zzz", "zzz new", "", " - ", "New York!", "of of of of", "city of new yorkshire n"]


def found(index, spark, wanted, scored, k=None):
    rows = index.phrases(spark.createDataFrame([(w,) for w in wanted], "mention string"), scored, k).collect()
    return sorted((r.mention, r.name, r.qid, r.score, r.fpos) for r in rows)


def test_phrases_equal_a_scan_of_all_names(spark, tmp_path):
    rows = made(400)
    scored = spark.createDataFrame(rows, SCORED)
    index = NameIndex(spark, str(tmp_path), k=5).add(scored)
    assert found(index, spark, WANTED, scored) == brute(WANTED, rows, 5)
    assert found(index, spark, WANTED * 2, scored, 2) == brute(WANTED, rows, 2)


def test_names_are_added_without_a_rebuild(spark, tmp_path):
    rows = made(300, 5)
    scored = spark.createDataFrame(rows, SCORED)
    index = NameIndex(spark, str(tmp_path), k=4).add(scored.where("qid < 'Q3'"))
    before = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path) for f in fs}
    NameIndex.open(spark, str(tmp_path), k=4).add(scored.where("qid >= 'Q3'"))
    again = NameIndex.open(spark, str(tmp_path), k=4)
    assert len(again.segments) == 2 and index.segments[0].split("/")[-1] == again.segments[0].split("/")[-1]
    after = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path) for f in fs}
    assert before.items() <= after.items()
    assert found(again, spark, WANTED, scored) == brute(WANTED, rows, 4)


def test_an_interrupted_segment_is_not_read(spark, tmp_path):
    rows = made(60, 7)
    scored = spark.createDataFrame(rows, SCORED)
    NameIndex(spark, str(tmp_path)).add(scored)
    half = tmp_path / "000001-half" / "postings"
    half.mkdir(parents=True)
    assert len(NameIndex.open(spark, str(tmp_path)).segments) == 1
    assert NameIndex.open(spark, str(tmp_path / "nothing")).segments == []


def test_a_frequent_word_does_not_list_its_names_for_every_phrase(spark, tmp_path):
    """All names share a word; each phrase goes by its last one."""
    rows = [(f"Customer {i:05d}", f"Q{i}", 1.0, "label", "", None, 1, None, 1.0) for i in range(3000)]
    scored = spark.createDataFrame(rows, SCORED)
    index = NameIndex(spark, str(tmp_path)).add(scored)
    wanted = [r[0] for r in rows]
    places = []
    keep = NI.top_k

    def seen(df, keys, *a, **kw):
        if keys == ["phrase"]:
            places.append(df.count())
        return keep(df, keys, *a, **kw)

    NI.top_k = seen
    try:
        assert len(found(index, spark, wanted, scored)) == 3000
    finally:
        NI.top_k = keep
    assert places == [3000]
