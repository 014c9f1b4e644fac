"""Text cells to typed columns, in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..types import DIGITS, LogicalType

DIAGNOSTIC = "struct<code:string, row:bigint, col:int, field:string, value:string, type:string>"
PLACE = "struct<line:bigint, col:int>"


@dataclass(frozen=True)
class Names:
    """Columns of a typed table beside its fields: the row's place, its line, its cells' places, its gaps, its wide cells, what is wrong with it."""

    row: str
    line: str
    places: str
    gaps: str
    wide: str
    problems: str


def names(fields: dict[str, LogicalType]) -> Names:
    """Names that no field has; Spark's names are the same in upper and lower case."""
    taken = {f.lower() for f in fields}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    return Names(*map(free, ("_row", "_line", "_places", "_gaps", "_wide", "_problems")))


def coerced(text: Column, type: LogicalType) -> Column:
    """The typed value of a text, null if it has none."""
    if type.kind == "string":
        return text
    if type.kind == "bool":
        return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))
    if type.kind == "enum":
        out = F.lit(None).cast(type.spark)
        for name, value in reversed(type.members):
            out = F.when(text == name, F.lit(value).cast(type.spark)).otherwise(out)
        return out
    lo, hi = type.bounds
    digits = F.when(text.rlike(r"\A[+-]?0*[0-9]{1,%d}\z" % DIGITS), F.regexp_replace(text, r"\A([+-]?)0+(?=[0-9])", "$1"))
    wide = digits.try_cast("decimal(38,0)")
    return F.when(wide.between(F.lit(str(lo)).cast("decimal(38,0)"), F.lit(str(hi)).cast("decimal(38,0)")), wide).try_cast(type.spark)


def wide(text: Column, type: LogicalType) -> Column:
    """Whether a text is a value of an unbounded type that has more digits than a column can hold."""
    sign = r"\+?" if type.lo is not None else "[+-]?"
    return text.rlike(r"\A%s0*[1-9][0-9]{%d,}\z" % (sign, DIGITS)) if type.kind == "int" and type.hi is None else F.lit(False)


def problem(code: str, field: str, type: str, row: Column, col: Column, value: Column) -> Column:
    parts = F.struct(F.lit(code).alias("code"), row.cast("bigint").alias("row"), col.cast("int").alias("col"), F.lit(field).alias("field"), value.alias("value"), F.lit(type).alias("type"))
    return parts.cast(DIAGNOSTIC)


def listed(parts: list[Column], kind: str) -> Column:
    """The parts that aren't null."""
    return F.array_compact(F.array(*parts)) if parts else F.array().cast(f"array<{kind}>")


def typed_fields(fields: dict[str, LogicalType], header: list[str]) -> tuple[dict[str, int], list[SpecError]]:
    """Which cell each field is read from, and the fields that can't be."""
    found, wrong = {}, []
    for name, type in fields.items():
        if not type.readable:
            wrong.append(SpecError("unsupported_field_type", f"{name}: {type.name}"))
        elif name not in header:
            wrong.append(SpecError("missing_column", name))
        else:
            found[name] = header.index(name)
    return found, wrong


def coerce(raw: DataFrame, header: list[str], fields: dict[str, LogicalType]) -> tuple[DataFrame, list[SpecError]]:
    """The typed table of raw(line, cells, places): fields in their declared order, and the columns of names(fields).

    Columns are bound by name and others ignored. A cell that doesn't coerce, and
    one that a short row lacks, is a gap: null, named and told with its place; the
    rest of the row is typed all the same. A cell of an unbounded type with more
    digits than a column holds is null and named as wide, but no problem.
    """
    at, wrong = typed_fields(fields, header)
    has = names(fields)
    text = {n: F.get("cells", F.lit(i)) for n, i in at.items()}
    value = {n: coerced(text[n], fields[n]) for n in at}
    over = {n: F.coalesce(wide(text[n], fields[n]), F.lit(False)) for n in at if fields[n].kind == "int" and fields[n].hi is None}
    gap = {n: value[n].isNull() & ~over[n] if n in over else value[n].isNull() for n in at}
    place = {n: F.get("places", F.lit(i)) for n, i in at.items()}
    line = lambda n: F.coalesce(place[n]["line"], F.col("line"))
    told = [F.when(gap[n], problem("cell_type_mismatch", n, fields[n].name, line(n), place[n]["col"], text[n])) for n in at]
    places = F.struct(*[place[n].alias(n) for n in at]) if at else F.struct(F.lit(None).alias("_"))
    own = [F.col("line").alias(has.row), F.col("line").alias(has.line), places.alias(has.places)]
    own += [listed([F.when(gap[n], F.lit(n)) for n in at], "string").alias(has.gaps), listed([F.when(x, F.lit(n)) for n, x in over.items()], "string").alias(has.wide), listed(told, DIAGNOSTIC).alias(has.problems)]
    return raw.select(*[value[n].alias(n) for n in at], *own), wrong
