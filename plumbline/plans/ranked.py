"""Top-k and values at exact ranks, for groups of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.kinds import col
from .lineage import cut

GROUP_LIMIT = 1_000  # spark.sql.optimizer.windowGroupLimitThreshold as Spark has it
PARTS = 64
CELLS = 1 << 12  # parts that a pass over a percentile's values cuts a stretch into


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. `row_number() <= k` lets Spark cut every map task's share of a group to k rows
    before the shuffle, so a group that holds most of the table costs no more than the others. Spark does so for a k of
    up to 1,000; for a larger one each group is cut to k rows in parts first."""
    if k > GROUP_LIMIT:
        part = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(PARTS))
        in_parts = W.partitionBy(*keys, "__part").orderBy(*order)
        df = df.withColumn("__part", part).withColumn(rank, F.row_number().over(in_parts)).where(
            F.col(rank) <= k).drop("__part", rank)
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def _cell(x: Column, lo: Column, hi: Column) -> Column:
    """The part of a stretch that a number falls in, of CELLS parts: by value, or by its logarithm where the stretch has
    numbers of very different sizes. It never falls as the number rises (differences, quotients and ln don't), and differs
    for the stretch's two ends."""
    wide = F.when(lo > 0, hi / lo > CELLS).otherwise((hi < 0) & (lo / hi > CELLS))
    by_size = F.when(lo > 0, (F.ln(x) - F.ln(lo)) / (F.ln(hi) - F.ln(lo))).otherwise((F.ln(-lo) - F.ln(-x)) / (F.ln(-lo) - F.ln(-hi)))
    return F.floor(F.when(wide, by_size).otherwise((x - lo) / (hi - lo)) * float(CELLS)).cast("int")


def values_at_ranks(counts: DataFrame, keys: list[str], ranks: Callable[[Column], Column], value: str = "x", n: str = "n") -> DataFrame:
    """The exact values at some ranks (from 0) of each group in ascending order, with no group sorted in one task:
    (keys, r, value, total). `counts` has a row per group and finite double with how many rows hold it (one number may have
    several rows); `ranks` gives the wanted ranks, as an array, from a group's total.

    Each pass cuts the stretches of numbers in which wanted ranks fall into CELLS parts and counts the rows in each; a part
    becomes the next pass's stretch, from its least number to its greatest, until these are one. A pass takes 12 bits off
    what a stretch's numbers can differ in, after one that brings them to a like size: two or three passes are usual, seven the most,
    and a window sees at most CELLS rows."""
    rows = counts.select(*keys, F.col(value).alias("__x"), F.col(n).alias("__n"))
    sign = F.signum("__x").cast("int")  # (stretches to begin with, so that none has numbers of both signs)
    begin = rows.groupBy(*keys, sign.alias("__sign")).agg(F.sum("__n").alias("__n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    whole = W.partitionBy(*keys)
    begin = begin.withColumns({"total": F.sum("__n").over(whole), "__upto": F.sum("__n").over(whole.orderBy("__sign").rowsBetween(W.unboundedPreceding, 0))})

    def wanted(parts: DataFrame, sought: Column) -> DataFrame:
        """Stretches with the ranks that they cover, from `start` up to but without __upto, where they cover any."""
        parts = parts.withColumn("start", F.col("__upto") - F.col("__n"))
        covered = F.filter(sought, lambda r: (r >= F.col("start")) & (r < F.col("__upto")))
        return parts.withColumn("sought", covered).where(F.size("sought") > 0).select(*keys, "lo", "hi", "start", "sought", "total")

    found, level = None, cut(wanted(begin, ranks(F.col("total"))))
    while True:
        single = level.where("lo = hi").select(*keys, F.explode("sought").alias("r"), F.col("lo").alias(value), "total")
        found = single if found is None else found.unionByName(single)
        if level.where("lo < hi").isEmpty():
            return found
        # (a group's stretches are as many as its wanted ranks at most, and do not overlap)
        stretches = level.where("lo < hi").select(*keys, F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), "start", "sought", "total")
        met = rows.join(stretches.select(*keys, "__lo", "__hi"), keys).where("__x >= __lo AND __x <= __hi")
        counted = met.groupBy(*keys, "__lo", _cell(F.col("__x"), F.col("__lo"), F.col("__hi")).alias("__cell")).agg(
            F.sum("__n").alias("__n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
        counted = counted.join(stretches.drop("__hi").withColumnsRenamed({"start": "__start", "sought": "__sought"}), [*keys, "__lo"])
        within = W.partitionBy(*keys, "__lo").orderBy("__cell").rowsBetween(W.unboundedPreceding, 0)
        level = cut(wanted(counted.withColumn("__upto", F.col("__start") + F.sum("__n").over(within)), F.col("__sought")))


def percentiles(counts: DataFrame, keys: list[str], at: dict[str, float], value: str = "x", n: str = "n") -> DataFrame:
    """Exact percentiles with linear interpolation between neighbours: a row per group, a column per name in `at`."""
    def place(p: float, total: Column) -> Column:
        return F.lit(p) * (total - 1)

    found = values_at_ranks(counts, keys, lambda total: F.array_distinct(F.array(
        *[f(place(p, total)) for p in at.values() for f in (F.floor, F.ceil)])), value, n)
    total = F.col("total")
    ends = [F.max(F.when(F.col("r") == f(place(p, total)), F.col(value))).alias(f"{name}:{side}")
            for name, p in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    wide = found.groupBy(*keys).agg(F.max("total").alias("total"), *ends)
    made = {}
    for name, p in at.items():
        low, high = F.col(f"`{name}:lo`"), F.col(f"`{name}:hi`")
        # (as Spark's own percentile weighs the two neighbours, so both give the same number to the last bit)
        at_, below, above = place(p, total), F.floor(place(p, total)), F.ceil(place(p, total))
        made[name] = F.when(below == above, low).otherwise((above - at_) * low + (at_ - below) * high)
    return wide.select(*keys, *[c.alias(name) for name, c in made.items()])
