import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline import OperatorError, bind, coerce, query_options, render, resolve, run_sql, sql_literal, transform, with_literals
from plumbline.functions import scalars as X
from plumbline.operators.sql import dedupe_columns, source_names
from plumbline.sources.jdbc import normalise_jdbc_types


def test_binds():
    sql = "select :a, ':a', \"x:a\", `:a`, b::int -- :c\n/* :d */ from t where r in (:regions) or q in (:regions)"
    text, args = bind(sql, {"a": 1, "regions": ["x", "y"], "unused": 2})
    assert args == {"a": 1, "regions_0": "x", "regions_1": "y"}
    assert text.count(":regions_0, :regions_1") == 2 and "':a'" in text and "b::int" in text and "-- :c" in text
    with pytest.raises(OperatorError, match=":nope"):
        bind("select :nope", {"a": 1})
    with pytest.raises(OperatorError, match="empty list"):
        bind("select 1 where 1 in (:a)", {"a": []})


def test_run_sql(spark):
    sales = spark.createDataFrame([("EU", dt.date(2026, 1, 1), 5.0), ("US", dt.date(2026, 1, 1), 7.0)], "region string, day date, amount double")
    found = run_sql(spark, "select region, :day as d, it's.amount from sales it's".replace("it's", "s") + " where day = :day and region in (:r);",
                    {"sales": sales}, {"day": dt.date(2026, 1, 1), "r": ["EU", "it's"]})
    assert [tuple(r) for r in found.collect()] == [("EU", dt.date(2026, 1, 1), 5.0)]
    assert run_sql(spark, "select count(*) as n from input", sales).first().n == 2
    assert not spark.catalog.tableExists("sales")
    with pytest.raises(OperatorError):
        run_sql(spark, "selec 1", sales)
    with pytest.raises(OperatorError, match="gives a table"):
        run_sql(spark, "drop view if exists nothing_there", sales)


def test_views_of_the_session_are_put_back(spark):
    spark.range(3).createOrReplaceTempView("mine")
    assert run_sql(spark, "select count(*) as n from mine", {"mine": spark.range(7)}).first().n == 7
    assert spark.table("mine").count() == 3
    spark.catalog.dropTempView("mine")


def test_exact_sum_and_overflow(spark):
    big = spark.createDataFrame([(2 ** 53,), (1,)], "n bigint")
    assert run_sql(spark, "select sum(n) as s from input", big).first().s == 2 ** 53 + 1
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        run_sql(spark, "select sum(n) as s from input", spark.createDataFrame([(2 ** 63 - 1,), (1,)], "n bigint")).collect()


def test_same_names_after_a_join(spark):
    a, b = spark.createDataFrame([(1, "x", 2)], "id int, n string, v int"), spark.createDataFrame([(1, "y", 3)], "id int, n string, v int")
    assert run_sql(spark, "select * from a join b on a.id = b.id", {"a": a, "b": b}).columns == ["id", "n", "v", "id_1", "n_1", "v_1"]
    assert dedupe_columns(a.toDF("x", "X", "x_1")).columns == ["x", "X_2", "x_1"]


def test_any_join_and_cross_join(spark):
    a, b = spark.range(3), spark.range(2, 5)
    counts = [run_sql(spark, f"select count(*) as n from a {how} join b {on}", {"a": a, "b": b}).first().n for how, on in
              (("left", "using (id)"), ("right", "using (id)"), ("full", "using (id)"), ("cross", ""), ("left semi", "using (id)"),
               ("left anti", "using (id)"))]
    assert counts == [3, 3, 5, 9, 1, 2]


def test_transform(spark):
    assert transform(spark.range(5), lambda df: df.where("id > 2")).count() == 2
    with pytest.raises(OperatorError, match="got int"):
        transform(spark.range(5), lambda df: 3)


def test_source_names():
    assert source_names([("a", "table"), ("a", "results"), ("b", "table"), ("a", "results")]) == ["a", "a_results", "b", "a_results_2"]


def test_literals():
    assert [sql_literal(v) for v in (None, True, 3, Decimal("1.20"), "it's", dt.date(2026, 1, 2), dt.datetime(2026, 1, 2, 3, 4, 5, 6))] == [
        "NULL", "TRUE", "3", "1.20", "'it''s'", "DATE '2026-01-02'", "TIMESTAMP '2026-01-02 03:04:05.000006'"]
    assert with_literals("a = :x and b in (:y) and c = ':x'", {"x": "'; drop", "y": [1, 2]}) == "a = '''; drop' and b in (1, 2) and c = ':x'"
    assert with_literals("k = :key", {"key": "hush"}, {"key": "CARD.key"}) == "k = <hidden: secret CARD.key>"


def test_templates():
    values = {"day": dt.date(2026, 1, 2), "n": 3.14159, "l": [1]}
    assert render("out/{{day:%Y%m%d}}_{{ n : .2f }}.csv {{{{n}} {n} }}", values) == "out/20260102_3.14.csv {{n}} {n} }}"
    for wrong in ("{{nope}}", "{{n", "{{}}", "{{a b}}", "{{l}}"):
        with pytest.raises(OperatorError):
            render(wrong, values)


def test_parameters():
    specs = {"day": ("date", "2026-10-05"), "key": ("int", lambda p: f"{p['day']:%Y%m%d}"), "regions": ("list", "a, b,, c"),
             "ok": ("bool", "Yes"), "note": ("text", None)}
    assert resolve(specs) == {"day": dt.date(2026, 10, 5), "key": 20261005, "regions": ["a", "b", "c"], "ok": True, "note": ""}
    assert resolve(specs, {"day": dt.datetime(2026, 1, 1, 5)})["key"] == 20260101
    with pytest.raises(OperatorError, match="unknown parameters: nope"):
        resolve(specs, {"nope": 1})
    for kind, wrong in (("int", 1.5), ("int", True), ("bool", "maybe"), ("date", "2026-13-01"), ("float", "x")):
        with pytest.raises(OperatorError):
            resolve({"p": (kind, wrong)})
    assert coerce("datetime", dt.date(2026, 1, 1)) == dt.datetime(2026, 1, 1) and coerce("int", 4.0) == 4


def test_jdbc_options():
    o = query_options("jdbc:x", "select * from t where a = :a and b in (:b);", {"a": 1, "b": ["x"]}, {"a": 2}, user="me")
    assert o["query"] == "select * from t where a = 2 and b in ('x')" and o["fetchsize"] == "50000" and o["user"] == "me"
    p = query_options("jdbc:x", "select 1", partition={"column": "id", "lower": 0, "upper": 9, "count": 4})
    assert p["dbtable"] == "(select 1) t" and p["numPartitions"] == "4" and "query" not in p
    with pytest.raises(OperatorError, match="lower"):
        query_options("jdbc:x", "select 1", partition={"column": "id", "upper": 9, "count": 4})


def test_jdbc_types(spark):
    df = spark.sql("""select cast(1 as smallint) s, 2 i, cast(1.5 as float) f, cast(2.50 as decimal(10,3)) d, X'0AFF' b, true ok,
                      timestamp'2026-01-02 03:04:05' ts, date'2026-01-02' day, 'x' t, array(1) l""")
    found = normalise_jdbc_types(df)
    assert dict(found.dtypes) == {"s": "bigint", "i": "bigint", "f": "double", "d": "decimal(10,3)", "b": "string", "ok": "boolean",
                                  "ts": "timestamp_ntz", "day": "date", "t": "string", "l": "string"}
    assert found.first().b == "0aff"


def test_scalars(spark):
    def value(c):
        return spark.range(1).select(c.alias("v")).first().v

    L = F.lit
    assert [value(X.floor_div(L(a), L(b))) for a, b in ((7, 2), (-7, 2), (7, -2))] == [3, -4, -4]
    assert [value(X.modulo(L(a), L(b))) for a, b in ((7, 3), (-7, 3), (7, -3), (-7, -3), (6, 3))] == [1, 2, -2, -1, 0]
    assert [value(X.rounded(L(x))) for x in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0] and value(X.truncated(L(-1.9))) == -1
    assert value(X.shift_months(L(dt.date(2024, 1, 31)), 1)) == dt.date(2024, 2, 29)
    assert value(X.start_of_week(L(dt.date(2026, 10, 4)))) == dt.date(2026, 9, 28)
    assert value(X.format_date(L(dt.date(2026, 1, 5)), "%A %d.%m.%Y at")) == "Monday 05.01.2026 at"
    assert [value(X.size_bytes(L(t))) for t in ("1 KB", "1.5mb", "7 B", "x", "5")] == [1024, 1572864, 7, None, None]
    assert [value(X.size_text(L(n))) for n in (1, 7, 2048, 1536, 3 << 30)] == [
        "1 byte", "7 bytes", "2 KB (2,048 bytes)", "1.5 KB (1,536 bytes)", "3 GB (3,221,225,472 bytes)"]
    assert [value(X.duration_seconds(L(t))) for t in ("500ms", "30s", "10m", "2h", "30", "x")] == [0.5, 30, 600, 7200, 30, None]
    assert [value(X.number_text(L(x))) for x in (1234.5, -0.001, 100.0, 0.126)] == ["1,234.5", "0", "100", "0.13"]
    assert value(X.split_list(L(" a, ,b "))) == ["a", "b"]
    assert [value(X.read_bool(L(t))) for t in (" YES ", "0", "maybe")] == [True, False, None]
    assert [value(X.read_number(L(t))) for t in ("12", " 2.5e3", "abc", "1,5")] == [12.0, 2500.0, None, None]
    assert value(X.format_value(L(1234.5), ",.2f", spark.range(1).select(L(1.0)).schema[0].dataType)) == "1,234.50"
    with pytest.raises(OperatorError):
        X.java_pattern("%Q")
