"""Functions of lists (arrays), maps and ranges. Positions begin at 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from .scalars import OUT_OF_RANGE, failing

Fn = Callable[[Column], Column]
#: The most elements of a range that are walked.
BUDGET = 1 << 20
# Fixed value: the message of a key that a map doesn't have.
KEY_NOT_FOUND = "key not found"


def indices(xs: Column) -> Column:
    """0 to size - 1; of an empty list, nothing."""
    return F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1, F.lit(1))).otherwise(F.array().cast("array<int>"))


# -- lists ---------------------------------------------------------------------


def list_len(xs: Column) -> Column:
    return F.size(xs)


def list_fold(xs: Column, init: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    """f(accumulator, key, value) over a list; the key is the position."""
    pairs = F.arrays_zip(indices(xs).alias("k"), xs.alias("v"))
    return F.aggregate(pairs, init, lambda acc, p: f(acc, p["k"], p["v"]))


def list_any(xs: Column, p: Fn) -> Column:
    return F.exists(xs, p)


def list_all(xs: Column, p: Fn) -> Column:
    return F.forall(xs, p)


def list_map(xs: Column, f: Fn) -> Column:
    return F.transform(xs, f)


def list_filter(xs: Column, p: Fn) -> Column:
    return F.filter(xs, p)


def list_push(xs: Column, v: Column) -> Column:
    return F.array_append(xs, v)


def list_unshift(xs: Column, v: Column) -> Column:
    return F.array_prepend(xs, v)


def list_pop(xs: Column) -> Column:
    """The last element, null of an empty list."""
    return F.try_element_at(xs, F.lit(-1))


def list_shift(xs: Column) -> Column:
    """The first element, null of an empty list."""
    return F.get(xs, F.lit(0))


def list_get(xs: Column, i: Column) -> Column:
    return failing(F.get(xs, i.cast("int")), (i >= 0) & (i < F.size(xs)), OUT_OF_RANGE)


def list_set(xs: Column, i: Column, v: Column) -> Column:
    """With v at i; null if there is no such position."""
    return F.when((i >= 0) & (i < F.size(xs)), F.transform(xs, lambda x, j: F.when(j == i, v).otherwise(x)))


def list_values(xs: Column) -> Column:
    return xs


def list_equal(xs: Column, ys: Column) -> Column:
    """Equal in length, and element by element."""
    return (F.size(xs) == F.size(ys)) & F.forall(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda p: p["x"].eqNullSafe(p["y"]))


def list_add(xs: Column, other: Column, list_type: ArrayType, other_type: DataType) -> Column:
    """xs + other, by the types: another list is put behind it, an element is added; what could be both, or is neither, has no value."""
    as_list, as_element = other_type == list_type, other_type == list_type.elementType
    if as_list == as_element:
        return F.lit(None).cast(list_type)
    return F.concat(xs, other) if as_list else F.array_append(xs, other)


def list_concat(xs: Column, ys: Column) -> Column:
    return F.concat(xs, ys)


# -- maps ----------------------------------------------------------------------


def map_len(m: Column) -> Column:
    return F.cardinality(m)


def map_fold(m: Column, init: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    return F.aggregate(F.map_entries(m), init, lambda acc, e: f(acc, e["key"], e["value"]))


def map_any(m: Column, p: Fn) -> Column:
    return F.exists(F.map_values(m), p)


def map_all(m: Column, p: Fn) -> Column:
    return F.forall(F.map_values(m), p)


def map_map(m: Column, f: Fn) -> Column:
    """A list of the images of the values."""
    return F.transform(F.map_values(m), f)


def map_filter(m: Column, p: Fn) -> Column:
    """A list of the values that pass."""
    return F.filter(F.map_values(m), p)


def map_keys(m: Column) -> Column:
    return F.map_keys(m)


def map_values(m: Column) -> Column:
    return F.map_values(m)


def map_equal(m: Column, n: Column) -> Column:
    """The same keys with the same values, in any order."""
    return list_equal(F.array_sort(F.map_entries(m)), F.array_sort(F.map_entries(n)))


def map_get(m: Column, k: Column) -> Column:
    return failing(F.try_element_at(m, k), F.map_contains_key(m, k), KEY_NOT_FOUND)


def map_set(m: Column, k: Column, v: Column) -> Column:
    """With v for k; a key that is there keeps its place."""
    entries = F.map_entries(m)
    replaced = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == k, v).otherwise(e["value"]).alias("value")))
    added = F.array_append(entries, F.struct(k.alias("key"), v.alias("value")))
    return F.map_from_entries(F.when(F.map_contains_key(m, k), replaced).otherwise(added))


# -- ranges --------------------------------------------------------------------


def range_list(a: Column, b: Column, step: Column | None = None) -> Column:
    """a, a + step and so on, as long as that is on b's side; the step is 1 if none is given.

    A step of 0 and more than BUDGET elements give null; a step away from b, no elements.
    """
    step = F.lit(1) if step is None else step
    return _walk(a, b, step, F.when(step > 0, a <= b).otherwise(a >= b))


def range_literal(a: Column, b: Column, closed: bool = True) -> Column:
    """From a towards b, whichever is larger; half-open, without the larger end."""
    step = F.when(a > b, F.lit(-1)).otherwise(F.lit(1))
    if closed:
        return _walk(a, b, step, F.lit(True))
    return _walk(F.when(a > b, a - 1).otherwise(a), F.when(a > b, b).otherwise(b - 1), step, a != b)


def _walk(a: Column, b: Column, step: Column, any_: Column) -> Column:
    few = F.abs(b - a) < BUDGET * F.abs(step)
    return F.when(step != 0, F.when(~any_, F.array().cast("array<bigint>")).when(few, F.sequence(a.cast("bigint"), b.cast("bigint"), step.cast("bigint"))))


def range_equal(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Ranges are equal if start, end and step are."""
    return (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2])


def range_len(a: Column, b: Column, step: Column | None = None) -> Column:
    """The number of elements, without walking them; null for a step of 0."""
    step = F.lit(1) if step is None else step
    steps = F.call_function("div", (b - a).cast("bigint"), F.when(step != 0, step).cast("bigint"))
    return F.when(step != 0, F.when(F.when(step > 0, a <= b).otherwise(a >= b), steps + 1).otherwise(F.lit(0).cast("bigint")))


def range_fold(a: Column, b: Column, init: Column, f: Callable[[Column, Column, Column], Column], step: Column | None = None) -> Column:
    """f(accumulator, position, value) over a range."""
    return list_fold(range_list(a, b, step), init, f)


def range_any(a: Column, b: Column, p: Fn, step: Column | None = None) -> Column:
    return F.exists(range_list(a, b, step), p)


def range_all(a: Column, b: Column, p: Fn, step: Column | None = None) -> Column:
    return F.forall(range_list(a, b, step), p)


def range_map(a: Column, b: Column, f: Fn, step: Column | None = None) -> Column:
    return F.transform(range_list(a, b, step), f)


def range_filter(a: Column, b: Column, p: Fn, step: Column | None = None) -> Column:
    return F.filter(range_list(a, b, step), p)


def range_keys(a: Column, b: Column, step: Column | None = None) -> Column:
    return indices(range_list(a, b, step))
