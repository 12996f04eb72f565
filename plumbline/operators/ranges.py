"""Counts and sums over ranges of a second table, without pairs.

What a span of [start, end) holds is what lies before its end less what lies before its start. So the points are brought to
a row per key and place, put in one order with the asked places, and totalled as they go (in chunks, whatever one key
holds); a span then looks up two totals. The work is that of sorting both tables, however many points a span holds and
however many spans a point lies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import OperatorError
from ..functions.kinds import BINARY_FLOAT, col, need_columns
from ..plans.ordered import CHUNK_ROWS, KEY, key_of, running

# Which ends of a span belong to it, by name.
CLOSED = {"left": (True, False), "right": (False, True), "both": (True, True), "neither": (False, False)}
# The comparisons of threshold_totals, as (from above, with equal values).
COMPARISONS = {"<": (False, False), "<=": (False, True), ">": (True, False), ">=": (True, True)}
BEFORE, HERE, AFTER = 0, 1, 2  # of places that are the same: asked without them, points, asked with them


def _measures(points: DataFrame, sums: dict[str, str]) -> dict[str, Column]:
    """What is totalled: all points, and of each column its values and how many there are."""
    found = {"__n": F.lit(1).cast("bigint")}
    for i, column in enumerate(sums.values()):
        dtype = points.schema[column].dataType
        if not isinstance(dtype, T.NumericType):
            raise OperatorError(f"{column} is {dtype.simpleString()}: only numbers have sums")
        wide = dtype if isinstance(dtype, BINARY_FLOAT) else T.DecimalType(38, getattr(dtype, "scale", 0))
        found[f"__s{i}"] = col(column).cast(T.DoubleType() if isinstance(wide, BINARY_FLOAT) else wide)
        found[f"__c{i}"] = col(column).isNotNull().cast("bigint")
    return found


def _totals_at(points: DataFrame, by: list[str], point: str, measures: dict[str, Column], asked: DataFrame, rows: int) -> DataFrame:
    """The totals of the points before each asked place (KEY, __t, __side), for BEFORE without and for AFTER with those at
    it, as columns named like `measures`; all null where there are none before."""
    placed = points.where(col(point).isNotNull()).groupBy(key_of(by).alias(KEY), col(point).alias("__t")).agg(
        *[F.sum(c).alias(f"{name}_here") for name, c in measures.items()]).withColumn("__side", F.lit(HERE))
    both = asked.distinct().unionByName(placed, allowMissingColumns=True)
    found = running(both, KEY, ["__t", "__side"], {name: ("sum", f"{name}_here") for name in measures}, rows=rows)
    return found.where(F.col("__side") != HERE).select(KEY, "__t", "__side", *measures)


def _named(df: DataFrame, names) -> None:
    if clash := [n for n in names if n in df.columns]:
        raise OperatorError(f"the table already has {', '.join(clash)}: name the totals otherwise")


def _results(sums: dict[str, str], count: str, difference) -> list[Column]:
    """The count, and each sum: null where none of its points has a value, as SQL's is."""
    made = [F.coalesce(difference("__n"), F.lit(0)).cast("bigint").alias(count)]
    return made + [F.when(difference(f"__c{i}") > 0, difference(f"__s{i}")).alias(name) for i, name in enumerate(sums)]


def range_totals(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, sums: dict[str, str] | None = None, by=(),
                 closed: str = "left", count: str = "n", rows: int = CHUNK_ROWS) -> DataFrame:
    """The spans, each with how many points lie in it (`count`; 0 if none) and the sums {name: column of points} of those.

    `by` columns must be equal, nulls among them. A span with a null end, or that ends before it starts, holds nothing; a
    null point lies nowhere. Sums of whole numbers and decimals are exact (decimals); those of binary numbers are differences
    of running totals: cast such a column to a decimal where every digit matters."""
    by, sums = [by] if isinstance(by, str) else list(by), sums or {}
    need_columns(points, [*by, point, *sums.values()], "Points")
    need_columns(spans, [*by, start, end], "Spans")
    _named(spans, [count, *sums])
    if closed not in CLOSED:
        raise OperatorError(f"closed: {closed} is none of {', '.join(CLOSED)}")
    with_start, with_end = CLOSED[closed]
    sides = {"lo": (col(start), BEFORE if with_start else AFTER), "hi": (col(end), AFTER if with_end else BEFORE)}
    asked = None
    for place, side in sides.values():
        one = spans.where(place.isNotNull()).select(key_of(by).alias(KEY), place.alias("__t"), F.lit(side).alias("__side"))
        asked = one if asked is None else asked.unionByName(one)
    measures = _measures(points, sums)
    totals = _totals_at(points, by, point, measures, asked, rows)
    kind = totals.schema["__t"].dataType
    made = spans.withColumn(KEY, key_of(by).cast(totals.schema[KEY].dataType))
    for name, (place, side) in sides.items():
        of = totals.where(F.col("__side") == side).select(KEY, F.col("__t").alias(f"__{name}"), *[F.col(m).alias(f"__{name}{m}") for m in measures])
        made = made.withColumn(f"__{name}", place.cast(kind)).join(of, [KEY, f"__{name}"], "left")
    holds = col(start) <= col(end)

    def difference(measure: str) -> Column:
        none = F.lit(0).cast(totals.schema[measure].dataType)
        return F.when(holds, F.greatest(F.coalesce(F.col(f"__hi{measure}"), none) - F.coalesce(F.col(f"__lo{measure}"), none), none) if measure == "__n"
                      else F.coalesce(F.col(f"__hi{measure}"), none) - F.coalesce(F.col(f"__lo{measure}"), none))

    return made.select(*[col(c) for c in spans.columns], *_results(sums, count, difference))


def threshold_totals(table: DataFrame, points: DataFrame, limit: str, comparison: str, point: str, sums: dict[str, str] | None = None,
                     by=(), count: str = "n", rows: int = CHUNK_ROWS) -> DataFrame:
    """The table, each row with how many points compare so with its `limit` (point `comparison` limit, one of < <= > >=),
    and their sums; as in range_totals. A null limit has none."""
    by, sums = [by] if isinstance(by, str) else list(by), sums or {}
    need_columns(points, [*by, point, *sums.values()], "Points")
    need_columns(table, [*by, limit], "Table")
    _named(table, [count, *sums])
    if comparison not in COMPARISONS:
        raise OperatorError(f"{comparison} is none of {', '.join(COMPARISONS)}")
    above, equal = COMPARISONS[comparison]
    side = AFTER if above != equal else BEFORE  # (what is above is all but what is not)
    measures = _measures(points, sums)
    asked = table.where(col(limit).isNotNull()).select(key_of(by).alias(KEY), col(limit).alias("__t"), F.lit(side).alias("__side"))
    below = _totals_at(points, by, point, measures, asked, rows)
    made = table.withColumns({KEY: key_of(by).cast(below.schema[KEY].dataType), "__t": col(limit).cast(below.schema["__t"].dataType)})
    made = made.join(below.select(KEY, "__t", *measures), [KEY, "__t"], "left")
    if above:
        whole = points.where(col(point).isNotNull()).groupBy(key_of(by).alias(KEY)).agg(*[F.sum(c).alias(f"__all{m}") for m, c in measures.items()])
        made = made.join(whole.withColumn(KEY, F.col(KEY).cast(below.schema[KEY].dataType)), KEY, "left")

    def found(measure: str) -> Column:
        none = F.lit(0).cast(below.schema[measure].dataType)
        under = F.coalesce(F.col(measure), none)
        return F.when(F.col("__t").isNotNull(), F.coalesce(F.col(f"__all{measure}"), none) - under if above else under)

    return made.select(*[col(c) for c in table.columns], *_results(sums, count, found))
