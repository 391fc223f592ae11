import bz2
import gzip

import pytest

from lamina.sources import readers, sinks


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "4096")
    yield
    spark.conf.set(name, before)


def lines(n, tag):
    return [f"{tag} line {i} " + "x" * (i * 7 % 90) for i in range(n)]


def test_numbers_follow_the_files_across_splits(spark, tmp_path, small_splits):
    plain, packed, pressed = lines(900, "plain"), lines(300, "gz"), lines(400, "bz2")
    (tmp_path / "a.txt").write_text("\n".join(plain) + "\n", newline="")
    with gzip.open(tmp_path / "b.txt.gz", "wt", newline="") as f:
        f.write("\n".join(packed) + "\n")
    with bz2.open(tmp_path / "c.txt.bz2", "wt", newline="") as f:
        f.write("\n".join(pressed))
    (tmp_path / "d.txt").write_text("")
    d = readers.text_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
    rows = sorted((r.ord, r.line, r.file.rsplit("/", 1)[1]) for r in d.collect())
    assert [r[0] for r in rows] == list(range(1600)) and [r[1] for r in rows] == plain + packed + pressed
    assert {r[2] for r in rows} == {"a.txt", "b.txt.gz", "c.txt.bz2"}


@pytest.mark.parametrize("codec", ["none", "gzip", "bzip2"])
def test_lines_come_back_in_the_order_they_were_written(spark, tmp_path, small_splits, codec):
    rows = [(i * 3, x) for i, x in enumerate(lines(1000, "w"))]
    sinks.write_lines(spark.createDataFrame(rows[::-1], "ord long, line string").repartition(5), str(tmp_path / "out"), codec, "ord")
    got = sorted((r.ord, r.line) for r in readers.text_lines(spark, str(tmp_path / "out")).collect())
    assert [x for _, x in got] == [x for _, x in rows]


def test_triples_and_json(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("Q1\tP1\tQ2\t\tentity\nQ1\tP2\t\tv\tstring\nshort\tline\n\n")
    assert sorted(map(tuple, readers.triples_tsv(spark, str(tmp_path / "t.tsv")).collect())) == [("Q1", "P1", "Q2", None, "entity"), ("Q1", "P2", None, "v", "string")]
    (tmp_path / "j.json").write_text('{"a": 1}\n{broken\n{"a": 2, "b": 3}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "j.json"), "a int").collect()) == [1, 2]


def test_no_lines(spark, tmp_path):
    (tmp_path / "e.txt").write_text("")
    assert readers.text_lines(spark, str(tmp_path / "e.txt")).count() == 0
