import pytest
from pyspark.sql import functions as F

from lamina import fixed as X
from lamina.functions import evidence as EV
from lamina.operators.engine import Engine, Layer

NOW = 1_700_000_000
ENTRY = "key string, seq long, answer string, write_ts long, ttl int"
LONG = "The answer has more than enough characters to be kept. " * 3


def cache(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def norm(c):
    return F.lower(F.trim(c))


def layer(spark, name, number, rows, seen=None, **kw):
    """rows: (query_id, rank, title, text, score)"""
    table = spark.createDataFrame([(q, r, f"{name}{r}", t, x, float(s)) for q, r, t, x, s in rows], "query_id long, rank int, id string, title string, text string, score double")

    def search(questions):
        if seen is not None:
            seen.setdefault(name, set()).update(r.query_id for r in questions.select("query_id").collect())
        return questions.select("query_id").join(table, "query_id")

    return Layer(name, number, search, **kw)


QUESTIONS = [(1, "capital of france", None), (2, "capital of spain", "u:1"), (3, X.CLOCK_QUESTIONS[0], None), (4, "capital of peru lima quito", None), (5, "what is the latest price", None)]
ENTRIES = [("capital of france", 10, LONG, NOW - 60, 3600), ("u:1::capital of spain", 11, LONG, NOW - 7200, 3600), ("what is the latest price", 12, LONG, NOW - 60, 3600)]


def questions(spark, rows=QUESTIONS):
    return spark.createDataFrame(rows, "query_id long, query string, namespace string")


@pytest.fixture
def run(spark):
    seen = {}
    wiki = [(q, 1, f"title {q}", f"capital of peru lima quito text {q}", 0.9) for q in (1, 2, 4)] + [(4, 2, "title b", "another", 0.8)]
    e = Engine([layer(spark, "L2_wiki", 1, wiki, seen), layer(spark, "L4_web", 4, [(q, 1, f"web {q}", "found", 1.0) for q in range(1, 6)], seen, online=True)], cache(spark, ENTRIES), NOW, 2023, norm)
    return e, seen


def test_questions_leave_early(spark, run):
    e, seen = run
    rows = {r.query_id: r for r in e.run(questions(spark)).collect()}
    assert {q: r.route for q, r in rows.items()} == {1: "cache", 2: "search", 3: "tool", 4: "search", 5: "search"}
    assert rows[1].answer == LONG and rows[1].entry == 10 and rows[1].message is None and not rows[1].to_l1 and not rows[1].to_l3
    assert rows[3].tool == "get_current_time"
    assert seen["L2_wiki"] == {2, 4, 5}  # neither the hit nor the tool's question was searched for
    assert 4 not in seen["L4_web"] and 5 in seen["L4_web"]  # good evidence needs no web, a question of the day does
    assert rows[5].entry is None and rows[5].n_L4_web == 1  # today's rules refuse the cached price


def test_evidence_message_and_audit(spark, run):
    e, _ = run
    r = next(x for x in e.run(questions(spark)).collect() if x.query_id == 4)
    assert "capital of peru lima quito text 4" in r.message and r.message.endswith("<question>\ncapital of peru lima quito\n</question>")
    assert r.answer == "title 4[1]\ntitle b[2]" and (r.n_cited, r.n_invalid) == (2, 0) and r.coverage == 1.0

    def wrong(messages, evidence):
        return messages.select("query_id", F.lit(LONG + " [1] [1] [7]").alias("answer"))

    e.answer = wrong
    r = next(x for x in e.run(questions(spark)).collect() if x.query_id == 4)
    assert (r.n_cited, r.n_invalid, r.tier, r.to_l1, r.to_l3) == (1, 1, "stable", True, True)


def test_a_fifth_layer(spark, run):
    e, seen = run
    notes = layer(spark, "L6_notes", 6, [(2, 1, "note", "a note about spain", 7.0), (4, 1, "note", "a note", 7.0), (4, 2, "cut", "off", 6.0)], seen, curve=(2.0, 7.0), k=1)
    e.register(notes)
    rows = {r.query_id: r for r in e.run(questions(spark)).collect()}
    assert (rows[2].n_L6_notes, rows[4].n_L6_notes, rows[1].n_L6_notes) == (1, 1, 0) and seen["L6_notes"] == {2, 4, 5}
    assert {(p.query_id, p.calibrated) for p in e.parts["passages"].where("layer = 'L6_notes'").collect()} == {(2, 0.5), (4, 0.5)}
    assert "note[" in rows[2].answer
    with pytest.raises(ValueError, match="there already"):
        e.register(notes)


def test_a_layer_that_is_slow_does_not_count(spark, run):
    e, _ = run
    late = Layer("L7_slow", 7, lambda q: q.select("query_id", F.lit(1).alias("rank"), F.lit("x").alias("id"), F.lit("t").alias("title"), F.lit("x").alias("text"), F.lit(1.0).alias("score"), (F.col("query_id") * 2.0).alias("elapsed")), budget_s=4.0)
    rows = {r.query_id: r for r in e.register(late).run(questions(spark)).collect()}
    assert (rows[2].n_L7_slow, rows[4].n_L7_slow) == (1, 0)


def test_awkward_questions(spark, run):
    e, _ = run
    rows = e.run(questions(spark, [(1, None, None), (2, "", None), (3, "  ", "u:1"), (4, "capital of peru lima quito", None), (None, "nobody", None)])).collect()
    assert len(rows) == 5 and {r.query_id: r.route for r in rows if r.query_id == 4} == {4: "search"}
    assert e.run(questions(spark, [])).count() == 0


def test_long_texts_are_met_by_reference(spark):
    """A layer that keeps its texts apart gives the same run, and its passages carry only their beginnings."""
    long = "capital of peru lima " + "x " * 400 + "quito"
    rows = [(q, r, f"title {r}", long + str(r), 0.9) for q in (2, 4, 5) for r in (1, 2)]
    asked = questions(spark, [(2, "capital of peru lima quito", None), (4, "capital of peru lima quito", None), (5, "bogota or caracas or sucre", None)])
    inline = layer(spark, "L2_wiki", 1, rows)
    texts = spark.createDataFrame([(f"L2_wiki{r}", f"title {r}", long + str(r)) for r in (1, 2)], "id string, title string, text string")
    apart = Layer("L2_wiki", 1, lambda q: inline.search(q).drop("title", "text"), texts=texts)
    runs = [Engine([x], cache(spark, []), NOW, 2023, norm) for x in (inline, apart)]
    got = [sorted(map(tuple, e.run(asked).collect()), key=lambda r: r[0]) for e in runs]
    assert got[0] == got[1] and len(got[0]) == 3
    assert max(len(r.text) for r in apart.passages(asked).collect()) == 80
    assert {r.text for r in runs[1].parts["evidence"].collect()} == {long + "1", long + "2"}


def test_a_text_that_many_questions_find_is_cleaned_once(spark, monkeypatch):
    cleaned, sanitize = [], EV.sanitize

    def counting(df, text, *args, **kw):
        if text == "text":
            cleaned.append(df.count())
        return sanitize(df, text, *args, **kw)

    monkeypatch.setattr(EV, "sanitize", counting)
    texts = spark.createDataFrame([("a", "title", "capital of peru " + "lima " * 60)], "id string, title string, text string")
    found = lambda q: q.select("query_id", F.lit(1).alias("rank"), F.lit("a").alias("id"), F.lit(0.9).alias("score"))
    rows = [(k, f"capital of peru {k}", None) for k in range(3)]
    got = Engine([Layer("L2_wiki", 1, found, texts=texts)], cache(spark, []), NOW, 2023, norm).run(questions(spark, rows)).collect()
    assert sum(cleaned) == 1
    assert len(got) == 3 and all("lima " * 50 in r.message for r in got)
