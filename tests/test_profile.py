import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline import OperatorError, custom_statistics, finite_or_null, histograms, profile, top_values
from plumbline.operators.profile import rows_over_time
from plumbline.plans.ordered import KEY
from plumbline.functions.bits import from_order_bits, order_bits
from plumbline.plans import ranked
from plumbline.plans.lineage import cut
from plumbline.plans.ranked import percentiles, values_at_ranks


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("north", 10.0, 1, dt.date(2026, 1, 1)), ("north", 20.0, 0, dt.date(2026, 1, 2)), ("south", None, -2, None),
            (None, 40.0, 3, dt.date(2026, 1, 4)), ("south", 50.5, 0, dt.date(2026, 1, 5)), ("north", 10.0, 1, dt.date(2026, 1, 1))]
    return spark.createDataFrame(rows, "region string, amount double, qty bigint, day date")


def stats(p, *keys):
    return {tuple(r[k] for k in (*keys, "column")): r for r in p.stats.collect()}


def test_whole_table(sales):
    found = stats(profile(sales))
    amount, region, day = found[("amount",)], found[("region",)], found[("day",)]
    assert (amount["count"], amount["missing"], round(amount["missing %"], 4), amount["distinct"]) == (5, 1, 16.6667, 4)
    values = [10.0, 20.0, 40.0, 50.5, 10.0]
    assert amount["mean"] == pytest.approx(statistics.fmean(values)) and amount["std"] == pytest.approx(statistics.stdev(values))
    assert (amount["25%"], amount["median"], amount["75%"], amount["min"], amount["max"]) == (10.0, 20.0, 40.0, "10.0", "50.5")
    assert (found[("qty",)]["zeros"], found[("qty",)]["negatives"], found[("qty",)]["sum"]) == (2, 1, 3.0)
    assert (region["most common"], region["shortest"], region["longest"]) == ("north (3), south (2)", 5, 5)
    assert (day["first"], day["last"], day["type"]) == ("2026-01-01", "2026-01-05", "date")
    assert "estimated" not in found[("day",)].asDict()


def test_groups_null_last(sales):
    p = profile(sales, ["amount"], ["region"])
    rows = p.stats.collect()
    assert [r.region for r in rows] == ["north", "south", None]
    assert [r["median"] for r in rows] == [10.0, 50.5, 40.0]
    assert rows[2]["std"] is None and p.stats.columns[:3] == ["region", "column", "type"]
    assert [r["rows"] for r in p.group_sizes.collect()] == [3, 2, 1]


def test_estimated(sales):
    rows = stats(profile(sales, exact=False))
    assert rows[("amount",)]["estimated"] == "distinct, 25%, median, 75%" and rows[("day",)]["estimated"] == "distinct"
    assert rows[("amount",)]["distinct"] == 4


def test_parts_left_out(sales):
    assert profile(sales, parts=("text",)).stats.columns == [
        "column", "type", "count", "missing", "missing %", "distinct", "min", "max", "shortest", "longest", "most common"]


def test_odd_types(spark):
    df = spark.sql("""select map('a', 1) as m, array(1, 2) as l, interval '50' hour as span, cast(1.5 as decimal(5,2)) as d, true as b
                      union all select map('a', 1), array(3), interval '1 02:03:04.5' day to second, null, false""")
    found = stats(profile(df))
    assert (found[("span",)]["min"], found[("span",)]["max"]) == ("26:03:04.5", "50:00:00")
    assert found[("m",)]["distinct"] == 1 and found[("m",)]["min"] is None and found[("l",)]["distinct"] == 2
    assert (found[("d",)]["mean"], found[("b",)]["max"]) == (1.5, "true")
    assert profile(df).repeated_rows.first()[0] == 0


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double")
    assert stats(profile(df))[("x",)]["distinct"] == 2


def test_nonfinite_refused(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")
    with pytest.raises(OperatorError, match=r"x \(1 NaN, 1 infinite\)"):
        profile(df)
    assert stats(profile(finite_or_null(df)))[("x",)]["count"] == 1


def test_overview(sales):
    p = profile(sales)
    r = p.overview.first()
    assert (r.rows, r.columns, r.missing_cells, r.repeated_rows) == (6, 4, 3, 1)
    assert {x.column: x.missing for x in p.overview_columns.collect()} == {"region": 1, "amount": 1, "qty": 0, "day": 1}
    assert profile(sales, exact=False).repeated_rows.first()[0] == 1


def test_custom(sales):
    found = custom_statistics(sales, {"p50": "quantile_cont(amount, 0.5)", "big": "count_if(amount > 15)"}, ["region"])
    assert {r.region: (r.p50, r.big) for r in found.collect()} == {"north": (10.0, 1), "south": (50.5, 1), None: (40.0, 1)}
    for wrong in ({"x": "amount"}, {"x": "sum("}, {"x": " "}, {"region": "count(*)"}, {"x": "nothing(amount)"}):
        with pytest.raises(OperatorError, match="Custom statistics"):
            custom_statistics(sales, wrong, ["region"]).schema
    with pytest.raises(OperatorError, match="more than one column"):
        custom_statistics(sales, [("a", "count(*)"), ("a", "max(qty)")])
    with pytest.raises(OperatorError):
        custom_statistics(sales, {"x": "amount + 1"})


def test_custom_percentiles(spark):
    df = spark.range(1001).select(F.col("id").alias("x"), (F.col("id") % 2).alias("g"), F.lit(None).cast("double").alias("none"))
    custom = {"a": "percentile(x + 1, 0.25)", "n": "count(*)", "b": "quantile_cont(-x, 0.9)", "c": "quantile_cont(x, 0.5) - min(x)",
              "d": "QUANTILE_CONT(x, 0.75) - quantile_cont(x, 0.25)", "e": "quantile_cont(x, 0.5) filter (where x > 500) + 0", "f": "coalesce(quantile_cont(none, 0.5), -1)",
              "h": "concat('quantile_cont(x, 0.5)', max(x))", "i": "percentile(x, array(0.5, 1.0))[1]", "k": "quantile_cont(if(x in (1, 2), null, x), 0)"}
    whole = custom_statistics(df, custom).first()
    assert tuple(whole) == (251.0, 1001, -100.0, 500.0, 500.0, 750.5, -1.0, "quantile_cont(x, 0.5)1000", 1000.0, 0.0)
    even, odd = custom_statistics(df, custom, ["g"]).orderBy("g").collect()
    assert tuple(even)[:6] == (0, 251.0, 501, -100.0, 500.0, 500.0) and tuple(odd)[:3] == (1, 251.5, 500) and odd.b == pytest.approx(-100.8) and (odd.c, odd.d) == (499.0, 499.0)
    assert (even.e, odd.e, even.f, odd.h, odd.k) == (751.0, 750.0, -1.0, "quantile_cont(x, 0.5)999", 3.0)
    none = custom_statistics(df.limit(0), custom).first()
    assert none.n == 0 and none.a is None and none.d is None and none.f == -1.0
    assert custom_statistics(df.limit(0), custom, ["g"]).count() == 0


def test_percentiles_of_nan_are_refused_everywhere(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (3.0, 3), (float("nan"), 4), (float("inf"), 5)], "x double, y int")
    for text in ("quantile_cont(x, 0.5)", "quantile_cont(x, 0.5) + 0", "sum(y) / percentile(x, 0.5)", "quantile_cont(x, 0.9) - quantile_cont(y, 0.5)"):
        with pytest.raises(OperatorError, match="Custom statistics: p: .*NaN"):
            custom_statistics(df, {"p": text, "q": "quantile_cont(y, 0.5)"})
    assert tuple(custom_statistics(df, {"p": "quantile_cont(x, 0.5) filter (where y < 4)", "q": "quantile_cont(y, 0.5)"}).first()) == (2.0, 3.0)


def test_order_bits(spark):
    """The numbers' own order, there and back, for every power of two and its neighbours."""
    import math

    values = {0.0, 1.7976931348623157e308, 5e-324}
    for e in range(-1074, 1024):
        x = math.ldexp(1.0, e)
        values |= {x, math.nextafter(x, 0), math.nextafter(x, math.inf)}
    values = sorted(values | {-v for v in values})
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", order_bits(F.col("x")).alias("b")).withColumn("y", from_order_bits(F.col("b"))).collect()
    made = {r.x: r for r in rows}
    assert all(made[v].y == v for v in values)
    bits = [made[v].b for v in values]
    assert bits == sorted(set(bits)) and made[0.0].b == 0 and made[5e-324].b == 1 and made[-5e-324].b == -1


def test_few_passes_whatever_the_numbers(spark, monkeypatch):
    """Moments of one minute and ids far from zero, in one group that holds them all."""
    passes = []
    monkeypatch.setattr(ranked, "cut", lambda df: passes.append(1) or cut(df))
    for base in (0, 10 ** 15, 1_704_067_200_000_000):
        passes.clear()
        counts = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") * 300 + base).cast("double").alias("x"), F.lit(2).cast("bigint").alias("n"))
        found = {r.r: r.x for r in values_at_ranks(counts, ["g"], lambda total: F.array(F.lit(0), F.lit(100_001), total - 1)).collect()}
        assert found == {0: float(base), 100_001: base + 300.0 * 50_000, 399_999: base + 300.0 * 199_999} and len(passes) <= 4


def test_histograms(spark, sales):
    bins = histograms(sales, ["qty"]).orderBy("bin").collect()
    assert [(b.low, b.high, b["rows"]) for b in bins] == [(-2.5, -1.5, 1), (-1.5, -0.5, 0), (-0.5, 0.5, 2), (0.5, 1.5, 2),
                                                         (1.5, 2.5, 0), (2.5, 3.5, 1)]
    assert [b["rows"] for b in histograms(sales.withColumn("c", F.lit(4.2)), ["c"]).collect()] == [6]
    even = histograms(spark.range(100).select(F.col("id").cast("double").alias("x")), ["x"]).orderBy("bin").collect()
    assert len(even) == 20 and all(b["rows"] == 5 for b in even)
    assert histograms(sales.withColumn("n", F.lit(None).cast("double")), ["n"]).count() == 0


def test_rows_over_time_units(spark):
    def unit(days):
        df = spark.createDataFrame([(dt.date(2000, 1, 1) + dt.timedelta(days=d),) for d in (0, days)], "d date")
        return rows_over_time(df, "d").first().unit

    assert [unit(d) for d in (731, 732, 18300, 18301)] == ["day", "month", "month", "year"]


def test_top_values(sales):
    assert [(r.value, r["rows"]) for r in top_values(sales, "qty", 2).orderBy("rank").collect()] == [(0, 2), (1, 2)]
    long = sales.withColumn("t", F.repeat(F.lit("x"), 50))
    r = profile(long, ["t"]).top_values("t").first()
    assert r.value == "x" * 39 + "…" and r.of_distinct == 1


def test_refused(sales):
    with pytest.raises(OperatorError, match="nope is not a column"):
        profile(sales, ["nope"])
    with pytest.raises(OperatorError, match="also a column of stats"):
        profile(sales.withColumnRenamed("region", "count"), group_by=["count"])


def test_values_at_ranks_of_hard_numbers(spark):
    """Numbers of every size and sign, many of one value, and close together."""
    rng = random.Random(11)
    groups = {1: [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(400)] + [0.0] * 50 + [-5e-324, 5e-324],
              2: [1.7e9 + i for i in range(300)], 3: [7.0] * 100, 4: [float(-i) for i in range(257)],
              5: [2.0 ** e for e in range(-50, 50)] + [-2.0 ** e for e in range(-50, 50)]}
    rows = [(g, v) for g, values in groups.items() for v in values]
    counts = spark.createDataFrame(rows, "g int, x double").groupBy("g", "x").agg(F.count("*").alias("n"))
    ranks = values_at_ranks(counts, ["g"], lambda total: F.sequence(F.lit(0), total - 1, F.lit(7)))
    found = {(r.g, r.r): r.x for r in ranks.collect()}
    assert found == {(g, r): sorted(values)[r] for g, values in groups.items() for r in range(0, len(values), 7)}


def test_percentiles_interpolate(spark):
    counts = spark.createDataFrame([(1.0, 1), (2.0, 2), (10.0, 1)], "x double, n bigint").withColumn(KEY, F.lit(1))
    r = percentiles(counts, [KEY], {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert (r.a, r.b, r.c) == (1.75, 2.0, pytest.approx(7.6))
