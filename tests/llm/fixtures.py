"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, part string, word string"


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, lang, src, None if t is None else len(t), 7, 3, "p", "w") for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


def texts():
    r = random.Random(5)
    vocabulary = ["the", "of", "Haus", "été", "niño", "stone", "river", "light", "paper", "grün", "a", "blue"]
    word = lambda: r.choice(vocabulary) + (str(r.randint(0, 400)) if r.random() < 0.6 else "")
    body = lambda n: " ".join(word() for _ in range(n))
    base = body(60).split()
    rows = [(i, body(r.randint(25, 90)) + ".\n" + body(5), ["en", "de", None][i % 3], f"s{i % 2}") for i in range(30)]
    rows += [(100 + i, " ".join(base[: 60 - i] + [f"edit{i}"] * (i % 3)), "en", "s0") for i in range(12)]  # a chain of near copies
    rows += [(200 + i, rows[3][1], "en", "s1") for i in range(4)]  # copies
    rows += [(300, None, "en", "s0"), (301, "", "en", None), (302, " \n\t ", None, None), (303, "one", "en", "s0"), (304, "one two three", "en", "s0"),
             (305, "One  TWO\tthree", "en", "s0"), (306, "漢字 かな　x ​ y", "ja", "s0"), (307, "x" * 5000, "en", "s1"), (308, body(6000), "en", "s1"),
             (309, "la la la la la la la la la la " * 20, "en", "s1"), (310, "<|endoftext|> a<|endoftext|>  b\r\n\r\n c ▁d", "en", "s0"),
             (None, "no id at all here", "en", "s0"), (303, "one", "en", "s0"), (303, "another text under the same id", "en", "s0")]
    return rows


def spaces(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
