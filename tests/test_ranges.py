"""Totals over ranges against all pairs."""

import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F

from plumbline.errors import OperatorError
from plumbline.operators.ranges import range_totals, threshold_totals

D = decimal.Decimal


def tables(spark):
    pick = random.Random(5)
    points = [(pick.choice("abc") if i % 9 else None, pick.randrange(50) if i % 11 else None, D(pick.randrange(-500, 500)) / 100 if i % 7 else None, i) for i in range(300)]
    spans = [(i, pick.choice("abcd") if i % 6 else None, pick.randrange(55) if i % 13 else None, pick.randrange(60) if i % 17 else None) for i in range(120)]
    spans += [(500 + i, "a", 10, 30) for i in range(4)]
    return (points, spans, spark.createDataFrame(points, "k string, at int, v decimal(9,2), w int").repartition(5),
            spark.createDataFrame(spans, "id int, k string, lo long, hi long").repartition(3))


def inside(x, lo, hi, closed):
    if None in (x, lo, hi) or lo > hi:
        return False
    return (lo <= x if closed in ("left", "both") else lo < x) and (x <= hi if closed in ("right", "both") else x < hi)


@pytest.mark.parametrize("closed", ["left", "right", "both", "neither"])
@pytest.mark.parametrize("rows", [1_000_000, 40])
def test_spans(spark, closed, rows):
    points, spans, p, s = tables(spark)
    found = {r.id: (r.n, r.total, r.numbers) for r in range_totals(
        p, s, "at", "lo", "hi", {"total": "v", "numbers": "w"}, "k", closed, rows=rows).collect()}
    assert len(found) == len(spans)
    for i, k, lo, hi in spans:
        held = [q for q in points if q[0] == k and inside(q[1], lo, hi, closed)]
        values = [q[2] for q in held if q[2] is not None]
        assert found[i] == (len(held), sum(values) if values else None, sum(q[3] for q in held) if held else None)


@pytest.mark.parametrize("comparison", ["<", "<=", ">", ">="])
@pytest.mark.parametrize("rows", [1_000_000, 40])
def test_thresholds(spark, comparison, rows):
    points, spans, p, s = tables(spark)
    compare = {"<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__}[comparison]
    for by in ((), ["k"]):
        found = {r.id: (r.n, r.total) for r in threshold_totals(s, p, "lo", comparison, "at", {"total": "v"}, by, rows=rows).collect()}
        for i, k, limit, _ in spans:
            held = [q for q in points if (not by or q[0] == k) and q[1] is not None and limit is not None and compare(q[1], limit)]
            values = [q[2] for q in held if q[2] is not None]
            assert found[i] == (len(held), sum(values) if values else None), (i, by)


def test_times_and_binary_numbers(spark):
    day = dt.datetime(2024, 3, 1)
    points = spark.createDataFrame([(day + dt.timedelta(hours=i), i / 4) for i in range(100)], "ts timestamp, x double")
    spans = spark.createDataFrame([(1, dt.date(2024, 3, 1), dt.date(2024, 3, 2)), (2, dt.date(2024, 3, 2), dt.date(2030, 1, 1))], "id int, a date, b date")
    assert [tuple(r)[3:] for r in range_totals(points, spans, "ts", "a", "b", {"s": "x"}).orderBy("id").collect()] == [(24, 69.0), (76, 1168.5)]


def test_no_pairs(spark):
    """Every span holds every point: the plan has no join on ranges and no nested loop."""
    points, spans = spark.range(3000).selectExpr("id as at", "id % 2 as k"), spark.range(3000).selectExpr("id", "-id - 1 as lo", "5000 + id as hi", "id % 2 as k")
    made = range_totals(points, spans, "at", "lo", "hi")
    assert made.agg(F.min("n"), F.max("n"), F.count("*")).first() == (3000, 3000, 3000)
    above = threshold_totals(spans, points, "lo", ">", "at", by="k")
    assert above.agg(F.sum("n")).first()[0] == 4_500_000
    for plan in (made._jdf.queryExecution().toString(), above._jdf.queryExecution().toString()):
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_and_wrong(spark):
    points, spans = spark.createDataFrame([], "at int, v int"), spark.createDataFrame([(1, 2)], "lo int, hi int")
    assert [tuple(r) for r in range_totals(points, spans, "at", "lo", "hi", {"s": "v"}).collect()] == [(1, 2, 0, None)]
    assert range_totals(points, spans.limit(0), "at", "lo", "hi").count() == 0
    assert [tuple(r) for r in threshold_totals(spans, points, "lo", ">=", "at").collect()] == [(1, 2, 0)]
    for wrong in (lambda: range_totals(points, spans, "at", "lo", "hi", closed="open"), lambda: threshold_totals(spans, points, "lo", "!=", "at"),
                  lambda: range_totals(points, spans, "at", "lo", "hi", count="hi"), lambda: range_totals(points, spans, "at", "lo", "nowhere"),
                  lambda: range_totals(points.selectExpr("at", "'x' as v"), spans, "at", "lo", "hi", {"s": "v"})):
        with pytest.raises(OperatorError):
            wrong()
