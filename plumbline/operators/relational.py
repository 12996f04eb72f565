"""Joins and row work beyond plain SQL: as-of and range joins, per-item queries, lines, routing, scrubbing."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import OperatorError
from ..functions.kinds import col, need_columns
from ..functions.readers import micros
from ..plans.ordered import CHUNK_ROWS, KEY, key_of, running
from ..sources.files import with_row_number
from .sql import run_sql

LINE = "line"


def _number(df: DataFrame, name: str) -> Column:
    """An order column as a whole number to cut chunks by."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return micros(col(name))
    return F.floor(col(name)).cast("bigint")


def asof_join(left: DataFrame, right: DataFrame, by, left_time: str, right_time: str, values, strict: bool = False,
              right_order=(), rows: int = CHUNK_ROWS) -> DataFrame:
    """Each left row with the right side's `values` at the latest right_time at or before (strict: before) its own.
    `right_order`: columns that say which of several right rows at one time is the latest.

    Each side is first brought to a row per key and time, however many rows share one. Those are put in one order, and
    a left time takes the last right row before it: no pair is formed but the one kept, and a key that holds most of a
    table is cut into chunks. Only then do the left rows, whole, look up their time."""
    by = [by] if isinstance(by, str) else list(by)
    need_columns(left, [*by, left_time], "Left")
    need_columns(right, [*by, right_time, *values, *right_order], "Right")
    taken = [v for v in values if v in left.columns]
    if taken:
        raise OperatorError(f"both tables have {', '.join(taken)}: rename it on one side")
    ours = left.withColumns({KEY: key_of(by), "__t": col(left_time)})
    asked = ours.where("__t IS NOT NULL").select(KEY, "__t", F.lit(0 if strict else 1).alias("__side")).distinct()
    # (of right rows equal in order too, the one whose values come last)
    payload = F.struct(*[col(v) for v in values])
    order = F.struct(*[col(c) for c in right_order], F.xxhash64(*[col(v) for v in values]).alias("__tie"))
    known = right.where(col(right_time).isNotNull()).groupBy(
        key_of(by).alias(KEY), col(right_time).alias("__t")).agg(
        F.max_by(payload, order).alias("__r")).withColumn("__side", F.lit(1 if strict else 0))
    both = asked.unionByName(known, allowMissingColumns=True)
    # (keys and times of two types meet in the wider one, which the union gives)
    ours = ours.withColumns({c: F.col(c).cast(both.schema[c].dataType) for c in (KEY, "__t")})
    found = running(both, KEY, ["__t", "__side"], {"__found": ("last", "__r")}, rows=rows)
    answers = found.where("__r IS NULL").select(KEY, "__t", "__found")
    return ours.join(answers, [KEY, "__t"], "left").select(
        *[col(c) for c in left.columns], *[F.col("__found")[v].alias(v) for v in values])


def range_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, by=()) -> DataFrame:
    """Points with the spans they lie in: start <= point < end, and equal `by` columns.

    A span of 2^k < length <= 2^(k+1) covers at most three cells of that size, so it is listed once per cell, and a
    point is looked up in its own cell of each size there is. Rows meet by an equal cell, never by trying all pairs."""
    by = [by] if isinstance(by, str) else list(by)
    need_columns(points, [*by, point], "Points")
    need_columns(spans, [*by, start, end], "Spans")
    clash = [c for c in spans.columns if c in points.columns and c not in by]
    if clash:
        raise OperatorError(f"both tables have {', '.join(clash)}: rename it on one side")
    lo, hi = _number(spans, start), _number(spans, end)
    real = spans.where(col(end) > col(start)).withColumns({"__lo": lo, "__hi": hi})
    size = F.ceil(F.log2(F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1)).cast("double"))).cast("int")
    sized = real.withColumn("__size", size)
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__size"))
    cells = F.sequence(F.floor(F.col("__lo") / width), F.floor(F.col("__hi") / width))
    listed = sized.select(key_of(by).alias(KEY), "__size", F.explode(cells).alias("__cell"),
                          *[col(c) for c in spans.columns if c not in by])
    sizes = [r[0] for r in sized.select("__size").distinct().collect()]  # (at most 64)
    if not sizes:
        sizes = [0]
    own = points.withColumns({KEY: key_of(by), "__p": _number(points, point)})
    looked = own.withColumn("__size", F.explode(F.array(*[F.lit(s) for s in sizes]))).withColumn(
        "__cell", F.floor(F.col("__p") / width))
    met = looked.join(listed, [KEY, "__size", "__cell"])
    inside = met.where((col(start) <= col(point)) & (col(point) < col(end)))
    return inside.select(*[col(c) for c in points.columns], *[col(c) for c in spans.columns if c not in by])


def attach(df: DataFrame, added: DataFrame, key: str = "row_id") -> DataFrame:
    """New columns beside a table's, row by row: both have the row's number in `key`."""
    need_columns(df, [key], "Table")
    need_columns(added, [key], "Added columns")
    clash = [c for c in added.columns if c in df.columns and c != key]
    if clash:
        raise OperatorError(f"the table already has {', '.join(clash)}")
    return df.join(added, key, "left")


def for_each_row(spark: SparkSession, items: DataFrame, body: str, inputs: dict[str, DataFrame] | None = None,
                 order_by=(), params: dict | None = None) -> DataFrame:
    """A query run for each row of an items table: `body` is a SELECT that names the item's columns as item.column.
    Gives the item's place from 1 (item_index, in the order of `order_by`), the item's columns and the query's.
    Spark turns the correlated query into one join."""
    if "item_index" not in items.columns:
        items = with_row_number(items, "item_index", order_by)
    items = items.select("item_index", *[col(c) for c in items.columns if c != "item_index"])
    name = f"items_{uuid.uuid4().hex}"
    return run_sql(spark, f"SELECT * FROM {name} AS item, LATERAL ({body.strip().rstrip(';')}\n) AS result", {name: items, **(inputs or {})}, params)


def merge_lines(lines: dict[str, DataFrame], failed=()) -> DataFrame:
    """The outputs of parallel lines in one table, each row with its line. A line that failed, or gave nothing (None),
    is an error that names it."""
    if failed:
        raise OperatorError(f"these lines failed: {', '.join(failed)}")
    nothing = [n for n, df in lines.items() if df is None]
    if nothing:
        raise OperatorError(f"these lines delivered nothing: {', '.join(nothing)}")
    if not lines:
        raise OperatorError("there is no line to merge")
    merged = None
    for name, df in lines.items():
        if LINE in df.columns:
            raise OperatorError(f"{name} already has a column named {LINE}")
        one = df.select(F.lit(name).alias(LINE), "*")
        merged = one if merged is None else merged.unionByName(one, allowMissingColumns=True)
    return merged


def route(df: DataFrame, condition) -> tuple[DataFrame | None, DataFrame | None]:
    """The whole table down one of two ways: `condition` is a bool, a function of the table, or an SQL condition on
    aggregates (count(*) > 0). Gives (table, None) or (None, table)."""
    if isinstance(condition, str):
        yes = df.agg(F.expr(condition).alias("yes")).first()["yes"]
    else:
        yes = condition(df) if callable(condition) else condition
    return (df, None) if yes else (None, df)


def route_rows(df: DataFrame, predicate) -> tuple[DataFrame, DataFrame]:
    """Each row down one of two ways; an unknown condition is not met."""
    met = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.where(met), df.where(~F.coalesce(met, F.lit(False)))


SHORTEST_SECRET, HIDDEN = 4, "***"
FOLDED = 200  # forms of secrets that are replaced one after another


def _escaped(text: str, quoted_by: str, plain) -> str:
    """A text as source code writes it between quotes: `plain` tells which characters stand for themselves."""
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f", "\\": "\\\\", quoted_by: "\\" + quoted_by}
    wide = lambda c: "".join(f"\\u{unit:04x}" for unit in memoryview(c.encode("utf-16-le", "surrogatepass")).cast("H"))
    return "".join(short.get(c) or (c if plain(c) else wide(c)) for c in text)


def _percent(text: str, plain: str, space: str = "%20") -> str:
    """A text as a web address writes it: `plain` has the marks that stand for themselves besides letters and digits."""
    return "".join(c if c.isascii() and c.isalnum() or c in plain else space if c == " " else
                   "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def secret_forms(secrets) -> list[str]:
    """Every way a secret of 4 characters or more may stand in a text, longest first: as it is; between single or double
    quotes in source code or JSON, other letters than ASCII as they are or as codes; in a web address, with all marks
    encoded, all but those of a path, all but those an address may hold, and as a form sends it."""
    unreserved = "-._~"  # (fixed values of web addresses: marks never encoded, and those that part an address)
    parting = ":/?#[]@!$&'()*+,;="
    ways = [lambda s: s]
    ways += [lambda s, q=q, p=p: _escaped(s, q, p) for q in "'\"" for p in (str.isprintable, lambda c: " " <= c <= "~")]
    ways += [lambda s, p=p: _percent(s, unreserved + p) for p in ("", "/", parting, parting + "%")]
    ways.append(lambda s: _percent(s, unreserved, "+"))
    forms = {way(s) for s in secrets if len(s) >= SHORTEST_SECRET for way in ways}
    return sorted(forms, key=lambda f: (-len(f), f))


def scrub(df: DataFrame, secrets, folded: int = FOLDED) -> DataFrame:
    """Known secrets in text columns as ***, the longest forms first.

    Up to `folded` forms are one fold of replacements. More are found by an index of their first characters: a text's own
    stretches of that length tell which few forms it can hold, so a clean text costs the same however many secrets there
    are. (Replacing one form can only bring up another that holds a star of it; those are always tried.)"""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    forms = secret_forms(secrets)
    if not texts or not forms:
        return df
    if len(forms) > folded:
        clean = _by_index(df.sparkSession, forms)
        return df.withColumns({c: clean(col(c)) for c in texts})
    listed = F.array(*[F.lit(f) for f in forms])

    def fold(c: Column) -> Column:
        return F.aggregate(listed, c, lambda text, form: F.replace(text, form, F.lit(HIDDEN)))

    return df.withColumns({c: fold(col(c)) for c in texts})


def _by_index(spark: SparkSession, forms: list[str]):
    heads: dict[str, list[int]] = {}
    for place, form in enumerate(forms):
        heads.setdefault(form[:SHORTEST_SECRET], []).append(place)
    starred = [place for place, form in enumerate(forms) if HIDDEN[0] in form]
    shared = spark.sparkContext.broadcast((forms, heads, starred))  # (the caller's own list of secrets)

    def hide(text: str | None) -> str | None:
        forms, heads, starred = shared.value
        if text is None:
            return None
        met = {text[i:i + SHORTEST_SECRET] for i in range(len(text) - SHORTEST_SECRET + 1)}.intersection(heads)
        if not met and not starred:
            return text
        for place in sorted({place for head in met for place in heads[head]}.union(starred)):
            text = text.replace(forms[place], HIDDEN)
        return text

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([hide(t) for t in texts.to_pylist()], pa.string())

    return clean


def head(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def showing(df: DataFrame, n: int) -> tuple[DataFrame, str]:
    """The first n rows and the line that says so ("" when that is all of them)."""
    total = df.count()
    return df.limit(n), f"Showing {n:,} of {total:,} rows." if total > n else ""


def chart_points(df: DataFrame, n: int = 5_000) -> tuple[DataFrame, str]:
    total = df.count()
    return df.limit(n), f"charting the first {n:,} of {total:,} rows" if total > n else ""


def preview(df: DataFrame, order_by, ends: int = 5) -> DataFrame:
    """A table of up to twice `ends` rows whole; of a longer one its first and last rows in that order. Two top-k
    plans: neither sorts the table."""
    down = [F.desc_nulls_last(c) for c in order_by]
    up = [F.asc_nulls_first(c) for c in order_by]
    if df.limit(2 * ends + 1).count() <= 2 * ends:
        return df.orderBy(*up)
    return df.orderBy(*up).limit(ends).union(df.orderBy(*down).limit(ends)).orderBy(*up)


def status_rollup(df: DataFrame, by, status: str = "status") -> DataFrame:
    """How each group's items ended, as ✓ 4 ✕ 1, and the worst of their statuses."""
    # The order statuses are told in, their marks, and the order from worst to best.
    marks = {"success": "✓", "failed": "✕", "skipped": "skipped", "cancelled": "cancelled"}
    worst = ["failed", "cancelled", "success", "skipped"]
    counts = {s: F.count_if(col(status) == s) for s in marks}
    told = [F.when(n > 0, F.concat(F.lit(f"{marks[s]} "), n.cast("string"))) for s, n in counts.items()]
    first = F.coalesce(*[F.when(counts[s] > 0, F.lit(s)) for s in worst])
    return df.groupBy(*[col(b) for b in by]).agg(F.concat_ws(" ", *told).alias("ended"), first.alias("status"))
