"""CSV files with line ends in quotes, read by many tasks, against Python's own reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from plumbline import read_table
from plumbline.sources import csv_records as C


@pytest.fixture(params=[60, 1 << 27])
def split(request, spark):
    """Bytes of a split; the smallest ones have fields over many splits."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], request.param), spark.conf.set(keys[1], 0)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def put(path, text, end="\n"):
    path.write_bytes(text.replace("\n", end).encode())
    return str(path)


def made(n, end="\n"):
    pick = random.Random(n)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    rows = []
    for i in range(n):
        text = "".join(pick.choice(['"', ",", end, "a", "bc", " ", "é", ";", '""', "x" * 30]) for _ in range(pick.randrange(9)))
        rows.append((i, text, pick.choice(["", "plain", "two words", 'q"uote'])))
    writer.writerows([("id", "te,xt", "kind"), *rows])
    return out.getvalue(), rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_quoting(spark, tmp_path, split, end):
    text, rows = made(25, end)
    path = str(tmp_path / "a.csv")
    open(path, "wb").write(text.encode())
    df = read_table(spark, path)
    assert df.dtypes == [("id", "bigint"), ("te,xt", "string"), ("kind", "string")]
    found = {r.id: (r["te,xt"] or "", r.kind or "") for r in df.collect()}
    assert found == {i: (t, k) for i, t, k in rows}


def test_many_tasks(spark, tmp_path):
    """One odd quote at the start of a file doesn't make it one task."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], 20_000), spark.conf.set(keys[1], 0)
    try:
        path = put(tmp_path / "b.csv", 'n,t\n0,"one\ntwo"\n' + "".join(f"{i},line {i}\n" for i in range(1, 20_000)))
        lines = C._lines(spark, path)
        assert lines.rdd.getNumPartitions() > 8 and C.split_states(lines, ",").where("open").count() == 0
        df = read_table(spark, path)
        assert df.agg(F.count("*"), F.sum("n"), F.countDistinct("t")).first() == (20_000, 199_990_000, 20_000)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_states(spark, tmp_path, split):
    """A field over the whole file; quotes that mean nothing; several files."""
    put(tmp_path / "a.csv", 'a,b\n1,"' + "x\n" * 50 + '"\n2,y\n')
    put(tmp_path / "b.csv", 'a,b\n3,5" pipe\n4,"z"" z\n"\n5,"open to the end\nof the file\n')
    found = {r.a: r.b for r in read_table(spark, str(tmp_path), "csv").collect()}
    assert found[1] == "x\n" * 50 and found[2] == "y" and found[3] == '5" pipe' and found[4] == 'z" z\n'
    assert found[5].startswith("open to the end\nof the file")


def test_headers(spark, tmp_path, split):
    assert read_table(spark, put(tmp_path / "h.csv", '\ufeff"two\nlines",b\n')).columns == ["two\nlines", "b"]
    df = read_table(spark, put(tmp_path / "i.csv", 'a,b\n1,"x\n"\na,b\n\n2,""\n'))
    assert [(r.a, r.b) for r in df.orderBy("a").collect()] == [("1", "x\n"), ("2", ""), ("a", "b")]
    df = read_table(spark, put(tmp_path / "s.csv", 'a;b\n1.5;"x\n;y"\n'), separator=";")
    assert [tuple(r) for r in df.collect()] == [(1.5, "x\n;y")]


def test_scanner():
    scan = C.line_scanner(",")
    for line, ends in {"": (False, True), "a,b": (False, True), '"a': (True, False), 'a"b': (False, False), '"a""': (True, False), '"a",b"': (False, False),
                       '","': (False, True), '"a"x,"': (True, True), 'a,""': (False, True), '"""': (True, False), '",,"': (False, True)}.items():
        assert (scan(line, False), scan(line, True)) == ends, line
