"""Column functions: date arithmetic, rounding and division as a calculator does them, and written forms."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from ..errors import OperatorError
from .bits import order_bits
from .readers import FALSE_WORDS, NUMBER_FORM, TRUE_WORDS

# Units a size or a duration is written in.
SIZE_UNITS = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}
DURATION_UNITS = {"ms": 0.001, "": 1.0, "s": 1.0, "m": 60.0, "h": 3600.0}
# The types of whole numbers.
WHOLE = ("tinyint", "smallint", "int", "bigint")
# Strptime codes and the patterns Spark has for them.
DATE_CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy",
              "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%I": "hh", "%p": "a", "%%": "%"}


@dataclass(frozen=True)
class Clock:
    """One moment for a whole run: every query sees the same today and now, however long the run takes."""

    moment: dt.datetime

    def today(self) -> Column:
        return F.lit(self.moment.date())

    def now(self) -> Column:
        return F.lit(self.moment.replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")


def _days(n) -> Column:
    """A whole number of days: a date moved by it is a date, a timestamp keeps its time."""
    return (n if isinstance(n, Column) else F.lit(n)).cast("int").cast("interval day")


def add_days(moment: Column, n) -> Column:
    """A date n days on; a timestamp keeps its time."""
    return moment + _days(n)


shift_days = add_days


def shift_weeks(moment: Column, n) -> Column:
    return moment + _days(7 * n)


def shift_months(moment: Column, n) -> Column:
    """The same day n months on, or that month's last; a timestamp keeps its time."""
    return moment + F.make_ym_interval(F.lit(0), n if isinstance(n, Column) else F.lit(n))


def start_of_month(moment: Column) -> Column:
    """The month's first day; a timestamp keeps its time."""
    return moment - _days(F.dayofmonth(moment) - 1)


def end_of_month(moment: Column) -> Column:
    return moment + _days(F.dayofmonth(F.last_day(moment)) - F.dayofmonth(moment))


def start_of_week(moment: Column) -> Column:
    """The Monday on or before the day; a timestamp keeps its time."""
    return moment - _days(F.weekday(moment))


def java_pattern(codes: str) -> str:
    """A strptime format as Spark's date pattern; letters that are no code are quoted."""
    made = []
    for part in re.findall(r"%.|[^%]+|%$", codes):
        if part.startswith("%"):
            if part not in DATE_CODES:
                raise OperatorError(f"the date format {codes!r} has {part!r}, which has no counterpart in Spark")
            made.append(DATE_CODES[part])
        else:
            made.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", part.replace("'", "''")))
    return "".join(made)


def parse_date(text: Column, codes: str = "%Y-%m-%d") -> Column:
    return F.to_date(text, java_pattern(codes))


def format_date(moment: Column, codes: str) -> Column:
    return F.date_format(moment, java_pattern(codes))


def format_value(value: Column, spec: str, dtype: T.DataType) -> Column:
    """format(value, spec) for dates (strftime codes), numbers (",.2f", ".1f", ",", "05d") and text ("")."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return format_date(value, spec)
    found = re.fullmatch(r"(0\d+)?(,)?(?:\.(\d+))?([dfs%])?", spec)
    if not found:
        raise OperatorError(f"cannot format with {spec!r}")
    width, thousands, places, how = found.groups()
    if how == "%":
        return F.concat(F.format_number(value * 100, int(places or 6)), F.lit("%"))
    if thousands:
        whole = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        return F.format_number(value, int(places) if places else 0 if whole else 6)
    if how == "f" or places:
        return F.format_string(f"%.{places or 6}f", value.cast("double"))
    if width:
        return F.format_string(f"%{width}d", value.cast("bigint"))
    return value.cast("string")


def truncated(x: Column) -> Column:
    """A number cut towards zero, as int() does."""
    return x.cast("bigint")


def rounded(x: Column, places: int = 0, binary: bool = True) -> Column:
    """To the nearest number of so many places, half to even. A binary number is taken as what it is, not as it is written:
    2.675 lies just below its last digit's half and becomes 2.67. `binary`: False for whole numbers and decimals."""
    if not binary or places < 0:
        return F.bround(x, places)
    x = x.cast("double")
    if places == 0:
        return F.rint(x) + 0.0
    # (a function of an array's element stays out of the code that is made for the usual numbers, and keeps that small)
    rare = F.transform(F.array(x), lambda v: _rounded_rarely(v, places))[0]
    if places > 15:
        return rare
    # Below 2^49 a double holds the scaled number's whole part and a half.
    scale, size = float(10 ** places), F.abs(x)
    near = F.floor(size * scale).cast("double")
    found = (near + _up(size, scale, near).cast("double")) / scale
    # (found is never below 0: tried in a condition, it is worked out without branches, each part of it once)
    return F.when((size * scale < float(1 << 49)) & (found >= 0), F.signum(x) * found).otherwise(rare) + 0.0


def _up(size: Column, scale: float, near: Column) -> Column:
    """Whether size * scale lies above near + 0.5, or is just that and near is odd. A product of doubles and what it is off
    by (from halves of 26 bits, whose products are exact) make the exact product, and the product is so near to the
    middle that their difference is exact: the sum of both has the right sign."""
    def halves(n):
        wide = n * float((1 << 27) + 1)
        high = wide - (wide - n)
        return high, n - high

    (high, low), (scale_high, scale_low) = halves(size), halves(scale)
    product = size * scale
    off = (high * scale - product) + low * scale if scale_low == 0 else (
        ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low)
    apart = (product - (near + 0.5)) + off
    return (apart > 0) | ((apart == 0) & (near % 2 == 1))


def _rounded_rarely(x: Column, places: int) -> Column:
    """Numbers of so many digits that their scaled value is beyond a double, by decimals."""
    if places <= 15:
        scale, size = float(10 ** places), F.abs(x)
        whole = F.floor(size).cast("double")
        tail = size - whole  # (exact, and so it is rounded by itself)
        near = F.floor(tail * scale).cast("double")
        digits = (near + _up(tail, scale, near).cast("double")).cast("decimal(16,0)")
        exact = whole.cast("decimal(16,0)") + digits / F.lit(10 ** places).cast("decimal(16,0)")
        return F.when(size < 1e15, F.signum(x) * exact.cast("double")).otherwise(F.bround(x, places))
    # Only where the number as written is halfway can the two differ. There |x| = m * 2^-e exactly, and twice the scaled
    # number, m * 2 * 10^places / 2^e, is held against the odd number it is written as.
    scale = F.lit(10 ** places).cast("decimal(38,0)")
    size = F.abs(x)
    written = F.when(size < 1e15, size).cast("decimal(34,18)")
    odd = (written * F.lit(2 * 10 ** places)).cast("decimal(38,12)")
    bits = order_bits(size)
    shift = F.lit(1075) - F.shiftright(bits, 52)
    whole = (F.pmod(bits, F.lit(1 << 52)) + F.lit(1 << 52)).cast("decimal(20,0)")
    part = F.least(shift, F.lit(62))
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int")).cast("decimal(20,0)")
    as_is = (whole * (scale * 2).cast("decimal(18,0)")).cast("decimal(38,0)")
    as_written = (odd.cast("decimal(20,0)") * (power(part) * power(shift - part)).cast("decimal(38,0)")).cast("decimal(38,0)")
    # (the bits last: few numbers come as far)
    halfway = (size < 1e15) & (odd == odd.cast("decimal(20,0)")) & (F.pmod(odd.cast("decimal(20,0)"), F.lit(2)) == 1) & (shift > 0) & (shift <= 124)
    below = (odd.cast("decimal(20,0)") - 1) / 2
    near = F.when(as_is > as_written, below + 1).when(as_is < as_written, below)
    exact = (near.cast("decimal(20,0)") / scale).cast("double") * F.signum(x)
    return F.when(halfway & (as_is != as_written), exact).otherwise(F.bround(x, places))


def floor_div(a: Column, b: Column) -> Column:
    """The quotient without its remainder, towards minus infinity: (a - modulo(a, b)) / b has no fraction to lose. Whole
    numbers of any size are divided as such."""
    whole = F.typeof(a).isin(*WHOLE) & F.typeof(b).isin(*WHOLE)
    long = lambda c: c.cast("bigint")
    rest = modulo(a, b)
    towards_zero = F.call_function("div", long(a), long(b))
    below = (long(a) % long(b) != 0) & ((long(a) < 0) != (long(b) < 0))
    return F.when(whole, F.when(below, towards_zero - 1).otherwise(towards_zero)).otherwise(F.round((a - rest) / b).cast("bigint"))


def modulo(a: Column, b: Column) -> Column:
    """The remainder that takes the divisor's sign."""
    rest = a % b
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def read_bool(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def read_number(text: Column) -> Column:
    """Text as a number (null where it is none)."""
    return F.when(F.trim(text).rlike(rf"\A(?:{NUMBER_FORM})\z"), F.trim(text).try_cast("double"))


def split_list(text: Column) -> Column:
    """Comma text as a list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda item: F.trim(item)), lambda item: item != "")


def _unit_value(text: Column, number: str, unit: str, units: dict) -> Column:
    form = rf"(?i)\A\s*({number})\s*({unit})\s*\z"
    amount = F.regexp_extract(text, form, 1).try_cast("double")
    name = F.regexp_extract(text, form, 2)
    factor = F.lit(None).cast("double")
    for known, size in units.items():
        factor = F.when(F.lower(name) == known.lower(), F.lit(float(size))).otherwise(factor)
    return F.when(text.rlike(form), amount * factor)


def size_bytes(text: Column) -> Column:
    """1 KB, 200 MB as bytes (1 KB = 1024); null where the text is no size."""
    return _unit_value(text, r"[0-9]+(?:\.[0-9]+)?", "[KMG]?B", SIZE_UNITS)


def size_text(n: Column) -> Column:
    """Bytes as 7 bytes, 2 KB (2,048 bytes)."""
    plain = F.concat(F.format_number(n, 0), F.when(n == 1, " byte").otherwise(" bytes"))
    made = plain
    for unit in ("KB", "MB", "GB"):
        short = F.regexp_replace(F.format_number(n / F.lit(SIZE_UNITS[unit]), 1), r"\.0$", "")
        made = F.when(n >= SIZE_UNITS[unit], F.concat(short, F.lit(f" {unit} ("), plain, F.lit(")"))).otherwise(made)
    return made


def duration_seconds(text: Column) -> Column:
    """500ms, 30s, 10m, 2h or a bare number of seconds; null where the text is no duration."""
    return _unit_value(text, r"[0-9]+(?:\.[0-9]+)?", "ms|s|m|h|", DURATION_UNITS)


def duration_text(span: Column) -> Column:
    """A day-time interval as hours:minutes:seconds (48:00:00)."""
    below = span < F.expr("INTERVAL '0' SECOND")
    size = F.when(below, -span).otherwise(span)
    hours = F.date_part(F.lit("DAY"), size) * 24 + F.date_part(F.lit("HOUR"), size)
    seconds = F.date_part(F.lit("SECOND"), size)
    shown = F.regexp_replace(F.format_string("%09.6f", seconds.cast("double")), r"\.?0+$", "")
    tail = F.when(seconds == F.floor(seconds), F.format_string("%02d", F.floor(seconds).cast("bigint"))).otherwise(shown)
    return F.concat(F.when(below, "-").otherwise(""), F.format_string("%02d", hours.cast("bigint")), F.lit(":"),
                    F.format_string("%02d", F.date_part(F.lit("MINUTE"), size).cast("bigint")), F.lit(":"), tail)


def number_text(x: Column) -> Column:
    """A number with , between thousands and at most 2 decimals."""
    shown = F.rtrim(F.rtrim(F.format_number(x, 2), F.lit("0")), F.lit("."))
    return F.when((x > -0.005) & (x < 0.005), "0").otherwise(shown)


def cell_text(value: Column, dtype: T.DataType) -> Column:
    """A value as a report's cell: thousands separators, 2 decimals, yes or no, ISO dates; a null is empty."""
    if isinstance(dtype, T.BooleanType):
        text = F.when(value, "yes").otherwise("no")
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        text = F.format_number(value, 0)
    elif isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        text = F.format_number(value, 2)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(value, "yyyy-MM-dd HH:mm")
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "").otherwise(text)


def row_hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)
