"""The standard mathematics of numbers and lists."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import WIDE, div, failing, let, magnitude, mul


def _both(a: Column, b: Column, out: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), out)


def max2(a: Column, b: Column) -> Column:
    return _both(a, b, F.greatest(a, b))


def min2(a: Column, b: Column) -> Column:
    return _both(a, b, F.least(a, b))


def max_of(xs: Column) -> Column:
    return failing(F.array_max(xs), F.size(xs) > 0, "max of an empty list")


def min_of(xs: Column) -> Column:
    return failing(F.array_min(xs), F.size(xs) > 0, "min of an empty list")


def max_or(xs: Column, floor: Column) -> Column:
    """The greatest of xs and floor."""
    return F.greatest(F.array_max(xs), floor)


def min_or(xs: Column, ceiling: Column) -> Column:
    """The least of xs and ceiling."""
    return F.least(F.array_min(xs), ceiling)


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return min2(max2(x, lo), hi)


def sum_of(xs: Column) -> Column:
    total = F.aggregate(xs, F.lit(0).cast(WIDE), lambda a, x: F.try_add(a, x.cast(WIDE)).cast(WIDE))
    return failing(total, F.size(xs) > 0, "sum of an empty list")


def product_of(xs: Column) -> Column:
    total = F.aggregate(xs, F.lit(1).cast(WIDE), lambda a, x: F.try_multiply(a, x.cast(WIDE)).cast(WIDE))
    return failing(total, F.size(xs) > 0, "product of an empty list")


def abs_(x: Column) -> Column:
    return magnitude(x)


def sign(x: Column) -> Column:
    return F.when(x > 0, F.lit(1)).when(x < 0, F.lit(-1)).when(x == 0, F.lit(0))


def _euclid(a: Column, b: Column, kind: str) -> Column:
    start = F.struct(a.cast(kind).alias("a"), b.cast(kind).alias("b"))

    def step(s: Column, _: Column) -> Column:
        done = s["b"] == 0
        rest = s["a"] % F.when(~done, s["b"])
        return F.struct(F.when(done, s["a"]).otherwise(s["b"]).cast(kind).alias("a"), F.when(done, F.lit(0)).otherwise(rest).cast(kind).alias("b"))

    # Euclid's rule takes fewer than five steps for each digit of the smaller operand, and one to bring it to the right.
    steps = F.length(F.least(a, b).cast("string")) * 5 + 1
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["a"])


def gcd(a: Column, b: Column) -> Column:
    """Not negative; 0 for 0 and 0. Longs are worked on as longs."""
    small = [magnitude(x) < F.lit(Decimal(2**63)) for x in (a, b)]
    long = [F.abs(F.when(s, x).try_cast("bigint")) for s, x in zip(small, (a, b), strict=True)]
    return F.when(small[0] & small[1], _euclid(*long, "bigint").cast(WIDE)).when(a.isNotNull() & b.isNotNull(), _euclid(magnitude(a), magnitude(b), WIDE))


def lcm(a: Column, b: Column) -> Column:
    least = lambda g: F.when(g == 0, F.lit(0).cast(WIDE)).otherwise(mul(div(magnitude(a), g), magnitude(b)))
    return let(gcd(a, b), least)


def pow_(x: Column, exp: Column) -> Column:
    """Exact; 1 for an exponent of 0 or less, null beyond 38 digits."""
    steps = F.when(exp > 0, F.sequence(F.lit(1), F.least(exp, F.lit(127)).cast("int"), F.lit(1))).otherwise(F.array().cast("array<int>"))
    out = F.aggregate(steps, F.lit(1).cast(WIDE), lambda a, _: F.try_multiply(a, x.cast(WIDE)).cast(WIDE))
    flat = F.abs(x) <= 1
    return F.when((exp <= 127) | flat, F.when(flat & (exp > 127), F.when(x == 1, F.lit(1)).when(x == 0, F.lit(0)).otherwise(F.when(exp % 2 == 0, F.lit(1)).otherwise(F.lit(-1)))).otherwise(out))
