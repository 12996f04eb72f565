"""Ordered work over groups of any size.

A window over one group puts the group in one task. Where a group can hold a large share of the table, the plans here
cut it into chunks of its order, do the window inside each chunk, and carry one small row per chunk across the chunks. A
chunk is a function of a row's own values, or stored, so that a task done again cuts the table the same way."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.kinds import col
from ..functions.readers import whole_part
from .lineage import cut

KEY, CHUNK = "__key", "__chunk"
CHUNK_ROWS = 1_000_000  # rows a chunk of a table in order aims to hold


def key_of(names) -> Column:
    """The group columns as one struct: never null itself, and equal where the same fields are null."""
    return F.struct(*[col(n).alias(n) for n in names]) if names else F.struct(F.lit(0).alias("all"))


def chunk_of(order: Column, width: int | None) -> Column:
    """The chunk a whole number falls in, by its value alone; None: all in one."""
    return F.lit(0).cast("bigint") if width is None else whole_part(order, F.lit(width).cast("bigint"))


def consecutive_pairs(df: DataFrame, key: str, first: str, last: str, widths: list[int]) -> DataFrame:
    """Each two neighbours of a group in order: (key, prev, next).

    `df` has stretches [first, last] that do not overlap within their group (points: first = last, no repeats). They
    are paired inside chunks of the first width; each chunk then becomes one stretch and the chunks are paired with
    the next width, so no window sees more than a chunk."""
    before = F.lag(last)
    if not widths:
        over = W.partitionBy(key).orderBy(first)
        return df.select(key, before.over(over).alias("prev"), F.col(first).alias("next")).where("prev IS NOT NULL")
    chunked = df.select(key, first, last, chunk_of(F.col(first), widths[0]).alias(CHUNK))
    over = W.partitionBy(key, CHUNK).orderBy(first)
    inside = chunked.select(key, before.over(over).alias("prev"), F.col(first).alias("next")).where("prev IS NOT NULL")
    whole = chunked.groupBy(key, CHUNK).agg(F.min(first).alias(first), F.max(last).alias(last))
    return inside.unionByName(consecutive_pairs(whole, key, first, last, widths[1:]))


# How a running value is totalled per chunk and how what was carried in joins what was found inside.
_RUNNING = {
    "sum": (F.sum, lambda carried, inside: F.coalesce(carried, F.lit(0)) + F.coalesce(inside, F.lit(0))),
    "max": (F.max, lambda carried, inside: F.greatest(carried, inside)),
    "last": (None, lambda carried, inside: F.coalesce(inside, carried)),
}


def in_chunks(df: DataFrame, key: str, order: list[str], rows: int = CHUNK_ROWS,
              most: int | None = None) -> tuple[DataFrame, bool]:
    """The table with a chunk number, and whether it is all one chunk. A table of more than `rows` rows is range
    partitioned by group and order, so that chunks are of like size whatever a group or a moment holds, and stored, so
    that every later use sees the same chunks. (Rows equal in group and order stay together: order by something unique.) `most`:
    how many rows there are at most, where that is known; else the table is stored first and counted there, so that what
    makes it runs once."""
    if most is None:
        df = cut(df)
        most = df.count()  # (from the files' footers)
    parts = math.ceil(most / rows)
    if parts <= 1:
        return df.withColumn(CHUNK, F.lit(0)), True
    ranged = df.repartitionByRange(parts, key, *order).withColumn(CHUNK, F.spark_partition_id())
    return cut(ranged), False


def running(df: DataFrame, key: str, order: list[str], wanted: dict[str, tuple[str, str]], before: bool = False,
            rows: int = CHUNK_ROWS, most: int | None = None) -> DataFrame:
    """Running values in order within each group: {name: ("sum" | "max" | "last", column)} ("last" passes over nulls).
    `before`: up to the row before this one. A window sees one chunk of a group, and one row per chunk for what is
    carried from the chunks before."""
    chunked, one = in_chunks(df, key, order, rows, most)
    upto = W.partitionBy(key, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)

    def over_rows(op, name, window):
        return (F.last(name, ignorenulls=True) if op == "last" else _RUNNING[op][0](name)).over(window)

    inside = chunked.withColumns({name: over_rows(op, c, upto) for name, (op, c) in wanted.items()})
    if one:
        return inside.drop(CHUNK)
    totals = []
    for name, (op, c) in wanted.items():
        at = F.when(F.col(c).isNotNull(), F.struct(*order))
        totals.append((F.max_by(c, at) if op == "last" else _RUNNING[op][0](c)).alias(f"__in_{name}"))
    earlier = W.partitionBy(key).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carried = chunked.groupBy(key, CHUNK).agg(*totals).select(
        key, CHUNK, *[over_rows(op, f"__in_{name}", earlier).alias(f"__in_{name}") for name, (op, _) in wanted.items()])
    joined = inside.join(carried, [key, CHUNK], "left")
    return joined.withColumns({name: _RUNNING[op][1](F.col(f"__in_{name}"), F.col(name))
                               for name, (op, _) in wanted.items()}).drop(CHUNK, *[f"__in_{n}" for n in wanted])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)
