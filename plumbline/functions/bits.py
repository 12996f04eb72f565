"""The bits of a binary number, by functions that give them exactly."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def order_bits(x: Column) -> Column:
    """A finite double as the whole number that its bits make, put in the numbers' own order: exact, and different for
    different numbers (both zeros are 0)."""
    size = F.abs(x)
    two = lambda e: F.pow(F.lit(2.0), e)  # noqa: E731  (exact for whole e)
    near = F.floor(F.log2(size)).cast("int")  # (within one of the exponent)
    exact = F.when(size < two(near), near - 1).when(size >= two(near + 1), near + 1).otherwise(near)
    exponent = F.greatest(F.least(exact, F.lit(1023)), F.lit(-1022))
    part = size / two(exponent)  # from 1 up to 2, or less for the smallest numbers of all
    whole = F.when(part >= 1, (exponent + 1023).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    bits = whole * F.lit(1 << 52) + ((part - F.when(part >= 1, 1.0).otherwise(0.0)) * float(1 << 52)).cast("bigint")
    return F.when(x == 0, F.lit(0).cast("bigint")).when(x > 0, bits).when(x < 0, -bits)


def from_order_bits(bits: Column) -> Column:
    """The double that order_bits made the number of."""
    size = F.abs(bits)
    whole, part = F.shiftright(size, 52), F.pmod(size, F.lit(1 << 52))
    made = F.when(whole > 0, (part / float(1 << 52) + 1.0) * F.pow(F.lit(2.0), whole - 1023)).otherwise(
        part / float(1 << 52) * F.pow(F.lit(2.0), F.lit(-1022)))
    return F.when(bits < 0, -made).otherwise(made)
