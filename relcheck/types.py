"""Logical types of fields, and how Spark stores them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .errors import SpecError, Undecidable

DIGITS = 38
_WIDEST = 10**DIGITS - 1
ORDERING = frozenset({"lt", "lteq", "gt", "gteq"})


@dataclass(frozen=True)
class LogicalType:
    """kind is int, bool, string, datetime, duration or enum; base is set on aliases and refinements."""

    name: str
    kind: str
    spark: str
    lo: int | None = None
    hi: int | None = None
    members: tuple[tuple[str, int | str], ...] = ()
    base: LogicalType | None = None
    predicate: Callable[[Column], Column] | None = field(default=None, compare=False)
    overrides: frozenset[str] = frozenset()
    nullable: bool = False

    def chain(self) -> list[LogicalType]:
        """This type and those it is made from, outermost first."""
        out, t = [], self
        while t is not None:
            out.append(t)
            t = t.base
        return out

    def custom(self, *ops: str) -> bool:
        """Whether any type in the chain brings its own version of one of the operators."""
        return any(t.overrides & set(ops) for t in self.chain())

    @property
    def orderable(self) -> bool:
        return self.kind != "bool"

    @property
    def summable(self) -> bool:
        """Sums are refused for integers that may not fit 64 bits, and for what isn't a plain number."""
        return self.kind == "int" and not self.nullable and not self.custom("add") and self.hi is not None and self.hi < 2**63

    @property
    def readable(self) -> bool:
        """Whether text can be coerced to it."""
        return self.kind in ("int", "bool", "string", "enum") and not self.nullable

    @property
    def bounds(self) -> tuple[int, int]:
        return (-_WIDEST if self.lo is None else self.lo, _WIDEST if self.hi is None else self.hi)

    def bind(self, value: object) -> object:
        """The stored form of a host value; enum members become their base values."""
        if self.kind == "enum":
            if isinstance(value, Member):
                if value.enum != self.chain()[-1].name:
                    raise TypeError(f"{value.enum} isn't {self.name}")
                return value.value
            raise TypeError(f"{self.name} compares with its members only")
        wanted = {"int": int, "duration": int, "bool": bool, "string": str}.get(self.kind)
        if wanted and (not isinstance(value, wanted) or (wanted is int and isinstance(value, bool))):
            raise TypeError(f"{value!r} isn't a value of {self.name}")
        return value

    def admit(self, value: object) -> object:
        """A host value converted to this type: out of range, or refused by a refinement in its chain, it has no value."""
        if value is None:
            if not self.nullable:
                raise Undecidable(f"null isn't a {self.name}")
            return None
        if self.kind == "int":
            lo, hi = self.lo, self.hi
            if (lo is not None and value < lo) or (hi is not None and value > hi):
                raise Undecidable(f"{value} is out of range for {self.name}")
        for t in self.chain():
            if t.predicate is not None and not _holds(t.predicate, value.value if isinstance(value, Member) else value):
                raise Undecidable(f"{value} isn't a {t.name}")
        return value

    def admitted(self, value: Column) -> Column:
        """A column converted to this type: null where admit() has no value."""
        out = converted(value, self) if self.kind == "int" else value
        for t in self.chain():
            if t.predicate is not None:
                out = F.when(F.coalesce(t.predicate(out), F.lit(False)), out)
        return out


def _holds(predicate: Callable, value: object) -> bool:
    """Whether a predicate written for columns is true of a host value."""
    try:
        held = predicate(value)
    except (TypeError, AttributeError, ValueError):  # it calls functions of columns
        held = predicate(F.lit(value))
    if isinstance(held, Column):
        held = SparkSession.active().range(1).select(held).first()[0]
    return held is True


@dataclass(frozen=True)
class Member:
    enum: str
    name: str
    value: int | str


def _integer(name: str, bits: int | None, signed: bool, spark: str) -> LogicalType:
    lo = (-(1 << bits - 1) if signed else 0) if bits else (None if signed else 0)
    return LogicalType(name, "int", spark, lo, (1 << bits - signed) - 1 if bits else None)


INTEGERS = {
    t.name: t
    for t in (
        _integer("sbyte", 8, True, "tinyint"),
        _integer("short", 16, True, "smallint"),
        _integer("int", 32, True, "int"),
        _integer("long", 64, True, "bigint"),
        _integer("byte", 8, False, "smallint"),
        _integer("ushort", 16, False, "int"),
        _integer("uint", 32, False, "bigint"),
        _integer("ulong", 64, False, "decimal(20,0)"),
        _integer("nint", None, True, "decimal(38,0)"),
        _integer("nuint", None, False, "decimal(38,0)"),
    )
}
SBYTE, SHORT, INT, LONG, BYTE, USHORT, UINT, ULONG, NINT, NUINT = INTEGERS.values()
BOOL = LogicalType("bool", "bool", "boolean")
STRING = LogicalType("string", "string", "string")
DATETIME = LogicalType("datetime", "datetime", "timestamp")
DURATION = LogicalType("duration", "duration", "bigint")


def enum(name: str, members: list[str] | dict[str, int | str | None], base: str = "int") -> LogicalType:
    """An enum over int or string: ints count on from the last value (at first 0), strings default to the name."""
    pairs, following = [], 0
    for member, value in (members if isinstance(members, dict) else dict.fromkeys(members)).items():
        if value is None:
            value = following if base == "int" else member
        if base == "int":
            following = value + 1
        pairs.append((member, value))
    if len({v for _, v in pairs}) != len(pairs):
        raise SpecError("enum_duplicate_value", name)
    return LogicalType(name, "enum", "int" if base == "int" and all(-(2**31) <= v < 2**31 for _, v in pairs) else "string" if base == "string" else "decimal(38,0)", members=tuple(pairs))


def member(t: LogicalType, name: str) -> Member:
    root = t.chain()[-1]
    return Member(root.name, name, dict(root.members)[name])


def alias(name: str, base: LogicalType, overrides: tuple[str, ...] = ()) -> LogicalType:
    """A type of its own name that stores what base stores."""
    return LogicalType(name, base.kind, base.spark, base.lo, base.hi, base.members, base, overrides=frozenset(overrides), nullable=base.nullable)


def refined(name: str, base: LogicalType, predicate: Callable[[Column], Column]) -> LogicalType:
    """base, with a predicate that every value has to meet."""
    return LogicalType(name, base.kind, base.spark, base.lo, base.hi, base.members, base, predicate, nullable=base.nullable)


def nullable(base: LogicalType) -> LogicalType:
    """base or null; of a nullable type, the same type."""
    if base.nullable:
        return base
    return LogicalType(f"{base.name} | null", base.kind, base.spark, base.lo, base.hi, base.members, base, overrides=base.overrides, nullable=True)


def same_type(a: LogicalType, b: LogicalType) -> bool:
    """Types are equal by name, with all they are made from."""
    return [(t.name, t.kind, t.members) for t in a.chain()] == [(t.name, t.kind, t.members) for t in b.chain()]


def converted(value: Column, to: LogicalType) -> Column:
    """A number as `to`: null if it is out of range."""
    wide = value.cast("decimal(38,0)")
    lo, hi = to.bounds
    fits = F.when(wide.between(F.lit(str(lo)).cast("decimal(38,0)"), F.lit(str(hi)).cast("decimal(38,0)")), wide)
    return fits.try_cast(to.spark)
