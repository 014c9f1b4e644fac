"""Functions of numbers, text and time.

Integers are exact: operands go to decimal(38,0), and a result that doesn't fit is
null. Functions that may fail with a message give a struct(ok, err).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
# Fixed value: the message of a place that a text or list doesn't have.
OUT_OF_RANGE = "index out of range"


def _wide(x: Column) -> Column:
    return x.cast(WIDE)


def failing(ok: Column, fine: Column, message: str) -> Column:
    """struct(ok, err): the value where it is fine, the message elsewhere."""
    return F.struct(F.when(fine, ok).alias("ok"), F.when(~F.coalesce(fine, F.lit(False)), F.lit(message)).alias("err"))


# -- integers ------------------------------------------------------------------


def pos(a: Column) -> Column:
    return a


def neg(a: Column) -> Column:
    """By subtraction: the unary minus of decimals keeps 34 digits only."""
    return F.try_subtract(F.lit(0).cast(WIDE), _wide(a)).try_cast(WIDE)


def magnitude(a: Column) -> Column:
    """Without the sign; abs of decimals keeps 34 digits only."""
    return F.when(a < 0, neg(a)).otherwise(_wide(a))


def add(a: Column, b: Column) -> Column:
    return F.try_add(_wide(a), _wide(b))


def sub(a: Column, b: Column) -> Column:
    return F.try_subtract(_wide(a), _wide(b))


def mul(a: Column, b: Column) -> Column:
    return F.try_multiply(_wide(a), _wide(b))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _pair(a: Column, b: Column) -> Column:
    return F.struct(_wide(a).alias("a"), _wide(b).alias("b"))


def _short(*columns: Column) -> tuple[list[Column], Column]:
    """The columns as longs, and whether all of them are longs."""
    longs = [c.try_cast("bigint") for c in columns]
    return longs, reduce(lambda x, y: x & y, [c.isNotNull() for c in longs])


def _quotient(a: Column, b: Column) -> Column:
    """a / b towards zero, of decimals; exact if it has no more than 32 digits, which decimal division keeps before its point."""
    return F.try_divide(F.try_subtract(a, F.when(b != 0, a % b)), F.when(b != 0, b)).try_cast(WIDE)


def div(a: Column, b: Column) -> Column:
    """Towards zero; null for a zero divisor."""
    (x, y), short = _short(a, b)
    short &= ~((x == -(2**63)) & (y == -1))
    half = F.lit(Decimal(10**19))

    def halves(s: Column) -> Column:
        rest = F.try_add(F.try_multiply(s["upper"] % s["b"], half).try_cast(WIDE), s["lower"]).try_cast(WIDE)
        return F.try_add(F.try_multiply(_quotient(s["upper"], s["b"]), half).try_cast(WIDE), _quotient(rest, s["b"])).try_cast(WIDE)

    def long(s: Column) -> Column:
        # A quotient of more than 32 digits has a divisor of a few: the dividend's upper and lower half are divided one after the other.
        parts = F.struct(_quotient(s["a"], half).alias("upper"), (s["a"] % half).alias("lower"), s["b"].alias("b"))
        return F.when(s["b"].between(-(10**6), 10**6), let(parts, halves)).otherwise(_quotient(s["a"], s["b"]))

    return F.when(short, F.call_function("div", x, F.when(y != 0, y)).cast(WIDE)).when(b != 0, let(_pair(a, b), long))


def rem(a: Column, b: Column) -> Column:
    """With the dividend's sign; null for a zero divisor."""
    return F.when(b != 0, _wide(a) % F.when(b != 0, _wide(b)))


def _limbs(x: Column) -> Column:
    """The two's complement of a wide integer in longs: 62 bits, 62 bits, and what is above them."""
    size = F.lit(Decimal(1 << 62))
    low = lambda v: F.when(v % size < 0, v % size + size).otherwise(v % size).try_cast("bigint")
    high = lambda v: (_quotient(v, size) - F.when(v % size < 0, 1).otherwise(0)).cast(WIDE)
    two = let(x, lambda v: F.struct(low(v).alias("low"), high(v).alias("rest")))
    return let(two, lambda s: F.struct(s["low"].alias("low"), low(s["rest"]).alias("middle"), high(s["rest"]).try_cast("bigint").alias("high")))


def _bitwise(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of longs on two's complements of any length; null if the result doesn't fit 38 digits."""
    (x, y), short = _short(a, b)
    size, whole = F.lit(Decimal(1 << 62)), F.lit(Decimal(1 << 124))

    def long(s: Column) -> Column:
        low, middle, high = (f(s["a"][n], s["b"][n]).cast(WIDE) for n in ("low", "middle", "high"))
        lower = (middle * size + low).cast(WIDE)
        # Below zero the highest part alone may be out of range where the sum isn't.
        up = F.when(high < 0, high + 1).otherwise(high).cast(WIDE)
        return F.try_add(F.try_multiply(up, whole).try_cast(WIDE), F.when(high < 0, lower - whole).otherwise(lower).cast(WIDE)).try_cast(WIDE)

    both = F.struct(_limbs(_wide(a)).alias("a"), _limbs(_wide(b)).alias("b"))
    return F.when(short, f(x, y).cast(WIDE)).when(a.isNotNull() & b.isNotNull(), let(both, long))


def band(a: Column, b: Column) -> Column:
    return _bitwise(a, b, Column.bitwiseAND)


def bor(a: Column, b: Column) -> Column:
    return _bitwise(a, b, Column.bitwiseOR)


def bxor(a: Column, b: Column) -> Column:
    return _bitwise(a, b, Column.bitwiseXOR)


def shl(a: Column, n: Column) -> Column:
    """a times 2 to the n, exactly; null beyond 38 digits or for n < 0."""
    powers = F.array(*[F.lit(Decimal(1 << i)).cast(WIDE) for i in range(127)])
    factor = F.when((n >= 0) & (n < 127), F.get(powers, n.cast("int")))
    return F.when(a == 0, F.when(n >= 0, F.lit(0).cast(WIDE))).otherwise(F.try_multiply(_wide(a), factor))


def shr(a: Column, n: Column) -> Column:
    """a divided by 2 to the n, rounded down; null for n < 0."""
    [x], short = _short(a)
    small = F.call_function("shiftright", x, F.least(F.greatest(n, F.lit(0)), F.lit(63)).cast("int"))
    powers = F.array(*[F.lit(Decimal(1 << i)).cast(WIDE) for i in range(127)])
    down = lambda s: F.try_subtract(div(s["a"], s["b"]), F.when(s["a"] % s["b"] < 0, 1).otherwise(0)).try_cast(WIDE)
    long = let(_pair(a, F.get(powers, F.greatest(n, F.lit(0)).cast("int"))), down)
    far = F.when(a < 0, -1).when(a >= 0, 0)
    return F.when(n >= 0, F.when(short, small.cast(WIDE)).when(n < 127, long).otherwise(far.cast(WIDE)))


# -- errors, records, unions ---------------------------------------------------


def error(message: Column) -> Column:
    """A failure as a value."""
    return F.struct(message.cast("string").alias("message"))


def message(error: Column) -> Column:
    return error["message"]


def record(**fields: Column) -> Column:
    """A record; its fields are read by name."""
    return F.struct(*[fields[n].alias(n) for n in sorted(fields)])


def with_field(record: Column, name: str, value: Column) -> Column:
    """A record with one field set."""
    return record.withField(name, value)


def tagged(tag: str, value: Column, members: dict[str, str]) -> Column:
    """A value of a union of members (tag to Spark type): the member that it is, and its value."""
    return F.struct(F.lit(tag).alias("tag"), *[(value if n == tag else F.lit(None)).cast(t).alias(n) for n, t in members.items()])


def match(union: Column, arms: dict[str, Callable[[Column], Column]], default: Column | None = None) -> Column:
    """The arm for the member that a value is; without one, the default or nothing."""
    out = None
    for tag, arm in arms.items():
        out = F.when(union["tag"] == tag, arm(union[tag])) if out is None else out.when(union["tag"] == tag, arm(union[tag]))
    return out if default is None else out.otherwise(default)


# -- bool ----------------------------------------------------------------------


def choose(condition: Column, a: Column, b: Column) -> Column:
    """a or b; without a condition, nothing."""
    return F.when(condition, a).when(~condition, b)


def switch(value: Column, cases: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    out = None
    for case, result in cases:
        out = F.when(value == case, result) if out is None else out.when(value == case, result)
    return out if default is None else out.otherwise(default)


# -- text ----------------------------------------------------------------------


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def length(s: Column) -> Column:
    return F.length(s)


def at(s: Column, i: Column) -> Column:
    return failing(F.substring(s, i.cast("int") + 1, F.lit(1)), (i >= 0) & (i < F.length(s)), OUT_OF_RANGE)


def slice_(s: Column, a: Column, b: Column) -> Column:
    fine = (a >= 0) & (b <= F.length(s)) & (a <= b)
    return failing(F.substring(s, F.when(fine, a).cast("int") + 1, F.when(fine, b - a).cast("int")), fine, OUT_OF_RANGE)


def chars(s: Column) -> Column:
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def bytes_(s: Column) -> Column:
    """The UTF-8 bytes, 0 to 255."""
    # Pairs of digits are cut in one pass: substring would look for each place from the start.
    pairs = F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


# -- time: instants and durations are milliseconds --------------------------------


def millis(t: Column) -> Column:
    """Epoch milliseconds; a timestamp without zone is taken in the session's, which is to be UTC."""
    return F.unix_millis(t.cast("timestamp"))


def now() -> Column:
    """This instant, the same all through a query. It isn't a value for checks, which are to give the same result each time."""
    return F.unix_millis(F.current_timestamp())


def instant(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def later(ms: Column, duration: Column) -> Column:
    return F.try_add(ms.cast("bigint"), duration.cast("bigint"))


def earlier(ms: Column, duration: Column) -> Column:
    return F.try_subtract(ms.cast("bigint"), duration.cast("bigint"))


def between(a: Column, b: Column) -> Column:
    """The duration from b to a."""
    return F.try_subtract(a.cast("bigint"), b.cast("bigint"))


def times(duration: Column, n: Column) -> Column:
    return F.try_multiply(duration.cast("bigint"), n.cast("bigint"))


# Units of a duration in milliseconds, in the order in which they are written.
UNITS = {"w": 604_800_000, "d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1_000, "ms": 1}


def parse_duration(text: str) -> int:
    """Milliseconds of a literal such as 3w4d5h6m7s8ms."""
    body = text[1:] if text.startswith("-") else text
    found = re.fullmatch("".join(rf"(?:(\d+){u})?" for u in UNITS), body)
    if not body or not found:
        raise ValueError(f"{text!r} isn't a duration")
    total = sum(int(n) * ms for n, ms in zip(found.groups(), UNITS.values(), strict=True) if n)
    if total >= 2**63:
        raise ValueError(f"{text!r} is too long")
    return -total if text.startswith("-") else total


def duration_text(ms: Column) -> Column:
    """The canonical form: units that are zero left out, 0ms for nothing, the sign in front."""
    left, parts = F.abs(ms.cast(WIDE)), []
    for unit, size in UNITS.items():
        n = ((left - left % size) / size).cast("bigint")
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))))
        left = left % size
    return F.when(ms == 0, "0ms").otherwise(F.concat(F.when(ms < 0, "-").otherwise(""), F.concat_ws("", *parts)))


def parse_datetime(text: str) -> int:
    """Epoch milliseconds of a literal such as D2009-03-31T23:59:59.000Z: three fractional digits or none, offsets up to 23:59."""
    found = re.fullmatch(r"D(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{3}))?(Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)", text)
    if not found:
        raise ValueError(f"{text!r} isn't a datetime")
    at, ms, zone = found.groups()
    time = datetime.fromisoformat(at + ("+00:00" if zone == "Z" else zone)).astimezone(UTC)
    return (time - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1) + int(ms or 0)
