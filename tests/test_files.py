import datetime as dt
import decimal
import os
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline import (OperatorError, as_table, check_files, format_of, list_files, materialise, read_table, records_of_text,
                       records_to_table, table_to_records, with_row_number, write_table)


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding) if isinstance(text, str) else text)
    return str(path)


def test_format_of():
    assert [format_of(p) for p in ("a.csv", "a.TXT", "b/c.parquet")] == ["csv", "csv", "parquet"]
    assert format_of("a.dat", "csv") == "csv"
    for wrong in (("a.dat", "auto"), ("a", "auto"), ("a.csv", "excel")):
        with pytest.raises(OperatorError):
            format_of(*wrong)


def test_csv_types(spark, tmp_path):
    path = put(tmp_path / "s.csv", '﻿id,day,amount,ok,name\r\n1,2026-01-02,1.5,true,"a, ""b"""\r\n2,,2,false,\r\n3,2026-01-04,,,""\r\n')
    df = read_table(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "day": "string", "amount": "double", "ok": "boolean", "name": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "2026-01-02", 1.5, True, 'a, "b"'), (2, None, 2.0, False, None), (3, "2026-01-04", None, None, "")]
    assert dict(read_table(spark, path, parse_dates=True).dtypes)["day"] == "date"


def test_csv_late_misfit_and_separator(spark, tmp_path):
    path = put(tmp_path / "codes.txt", "code;n\n" + "".join(f"{i};{i}\n" for i in range(12_000)) + "A-17;1\n")
    df = read_table(spark, path, separator=";")
    assert dict(df.dtypes) == {"code": "string", "n": "bigint"} and df.where("code = 'A-17'").count() == 1
    with pytest.raises(OperatorError, match="one character"):
        read_table(spark, path, separator=";;")


def test_csv_line_ends_in_quotes(spark, tmp_path):
    path = put(tmp_path / "lines.csv", 'a,b\n1,"x\ny"\n2,z\n')
    assert [tuple(r) for r in read_table(spark, path).orderBy("a").collect()] == [(1, "x\ny"), (2, "z")]
    assert [tuple(r) for r in read_table(spark, put(tmp_path / "lines [1].csv", 'a,b\n1,"x\ny"\n')).collect()] == [(1, "x\ny")]


def test_csv_name_is_no_pattern(spark, tmp_path):
    put(tmp_path / "sales E.csv", "a\n1\n")
    assert read_table(spark, put(tmp_path / "sales [EU].csv", "a\n7\n")).first()[0] == 7


def test_csv_header_only_and_errors(spark, tmp_path):
    df = read_table(spark, put(tmp_path / "head.csv", "a,b\n"))
    assert df.columns == ["a", "b"] and df.count() == 0
    with pytest.raises(OperatorError, match="is empty"):
        read_table(spark, put(tmp_path / "none.csv", ""))
    with pytest.raises(OperatorError, match="not UTF-8"):
        read_table(spark, put(tmp_path / "latin.csv", "a\ncafé\n", "latin-1"))
    with pytest.raises(OperatorError, match="file not found"):
        read_table(spark, str(tmp_path / "gone.csv"))


TYPED = [(dt.date(2026, 1, 2), dt.datetime(2026, 1, 2, 3, 4, 5, 60), 7, 1.25, "x, \"y\"", True, None, decimal.Decimal("1.50")),
         (None, None, None, None, "", None, 3, None)]
SCHEMA = "day date, at timestamp_ntz, n bigint, x double, city string, ok boolean, missing bigint, total decimal(10,2)"


def test_parquet_keeps_everything(spark, tmp_path):
    df = spark.createDataFrame(TYPED, SCHEMA)
    back = read_table(spark, write_table(df, str(tmp_path / "deep" / "t.parquet")))
    assert back.schema.simpleString() == df.schema.simpleString() and set(back.collect()) == set(df.collect())


def test_csv_written_and_read(spark, tmp_path):
    df = spark.createDataFrame(TYPED, SCHEMA)
    back = read_table(spark, write_table(df, str(tmp_path / "t.csv"))).orderBy("n").collect()
    assert [tuple(r) for r in back][1] == ("2026-01-02", "2026-01-02T03:04:05.000060", 7, 1.25, 'x, "y"', True, None, 1.5)
    assert back[0].city == "" and back[0].day is None and back[0].missing == 3
    empty = read_table(spark, write_table(df.limit(0), str(tmp_path / "empty.csv")))
    assert empty.columns == df.columns and empty.count() == 0
    with pytest.raises(OperatorError, match="l: a CSV file holds no lists"):
        write_table(spark.sql("select array(1) as l"), str(tmp_path / "l.csv"))


def test_write_back_over_itself(spark, tmp_path):
    path = write_table(spark.range(5), str(tmp_path / "t.parquet"))
    write_table(read_table(spark, path).withColumn("id", F.col("id") * 10), path)
    assert sorted(r.id for r in read_table(spark, path).collect()) == [0, 10, 20, 30, 40]
    assert not [n for n in os.listdir(tmp_path) if ".part" in n]


def test_dated_path_and_partitions(spark, tmp_path):
    from plumbline import render_path

    path = render_path(str(tmp_path) + "/sales_{{day:%Y-%m-%d}}.parquet", {"day": dt.date(2026, 1, 2)})
    write_table(spark.range(4).withColumn("d", F.col("id") % 2), path, partition_by=["d"], max_records_per_file=1)
    assert path.endswith("sales_2026-01-02.parquet") and read_table(spark, path).where("d = 1").count() == 2


def test_row_numbers(spark, tmp_path):
    path = write_table(spark.range(1000, numPartitions=4), str(tmp_path / "t.parquet"))
    found = with_row_number(spark.read.parquet(path)).collect()
    assert sorted(r.row_number for r in found) == list(range(1, 1001))
    assert all(b.id - a.id == 1 for a, b in zip(sorted(found, key=lambda r: r.row_number), sorted(found, key=lambda r: r.row_number)[1:]))
    by_value = with_row_number(spark.range(1000).select((-F.col("id")).alias("v")), order_by=["v"]).collect()
    assert all(r.row_number == r.v + 1000 for r in by_value)
    with pytest.raises(OperatorError, match="order_by"):
        with_row_number(spark.range(3).groupBy("id").count())


def test_materialise(spark, tmp_path):
    kept = materialise(spark.range(10).withColumn("r", F.rand()))
    assert kept.collect() == kept.collect()
    assert materialise(spark.range(3), str(tmp_path / "m.parquet")).count() == 3
    assert materialise(spark.sql("select 1 as a, null as nothing")).count() == 1


def test_as_table(spark):
    assert as_table(spark, pd.DataFrame({"a": [1, 2]})).count() == 2
    assert as_table(spark, pa.table({"a": [1]})).first().a == 1
    df = spark.range(1)
    assert as_table(spark, df) is df
    with pytest.raises(OperatorError, match="got int"):
        as_table(spark, 5)


def test_list_and_check_files(spark, tmp_path):
    put(tmp_path / "a.csv", "12345678"), put(tmp_path / "b.csv", ""), put(tmp_path / "c.txt", "x" * 3000), put(tmp_path / "d [1].csv", "y")
    (tmp_path / "e.csv").mkdir()
    put(tmp_path / "e.csv" / "inside", "z")
    files = list_files(spark, str(tmp_path / "*.csv"))
    assert sorted((os.path.basename(r.path.replace("%20", " ")), r.size) for r in files.collect()) == [
        ("a.csv", 8), ("b.csv", 0), ("d [1].csv", 1)]
    assert list_files(spark, str(tmp_path / "d [1].csv")).count() == 1
    nothing = check_files(list_files(spark, str(tmp_path / "z*")), not_empty=True)
    assert [tuple(r) for r in nothing.results.collect()] == [("It is there", "failed", "nothing here"),
                                                            ("Not empty", "passed", "there was nothing to look at")]
    found = check_files(files, not_empty=True, minimum="1 KB", warn=("size",), modified_since=dt.date(2000, 1, 1))
    outcomes = {r.check: (r.outcome, r.details) for r in found.results.collect()}
    assert outcomes["Not empty"][0] == "failed" and outcomes["Not empty"][1].endswith("b.csv holds nothing")
    assert outcomes["Size"][0] == "warned" and "under 1 KB" in outcomes["Size"][1]
    assert outcomes["Modified since"][0] == "passed" and not found.passed
    late = check_files(files, modified_since=dt.datetime.now() + dt.timedelta(days=1))
    assert "older than" in late.failures[0]
    with pytest.raises(OperatorError, match="not a size"):
        check_files(files, maximum="big")


def test_records(spark):
    df = records_of_text(spark, '[{"a": 1, "b": "x"}, {"b": "y", "c": [1.5]}, {"a": null}]')
    assert [tuple(r) for r in df.collect()] == [(1, "x", None), (None, "y", [1.5]), (None, None, None)]
    assert records_of_text(spark, "[]").columns == []
    for wrong in ("{", '{"a": 1}', "[1]"):
        with pytest.raises(OperatorError):
            records_of_text(spark, wrong)
    lists = spark.createDataFrame([(1, '[{"a": 1}]'), (2, "[]"), (3, None), (4, '[{"a": 5}, {"a": 6}]')], "k int, j string")
    assert [tuple(r) for r in records_to_table(lists, "j", ["k"]).orderBy("a").collect()] == [(1, 1), (4, 5), (4, 6)]
    for wrong in ('[{"a": 1}, 2]', '{"a": 1}', "nothing", '[{"a": 1}, {"a": "x"}]'):
        with pytest.raises(OperatorError):
            records_to_table(spark.createDataFrame([(wrong,)], "j string"), "j")
    assert [r.record for r in table_to_records(spark.sql("select 1 as a, cast(null as string) as b")).collect()] == ['{"a":1,"b":null}']
