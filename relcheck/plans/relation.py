"""Single-table relations: typed columns, predicates, order, window, aggregates.

A Relation is an immutable description that becomes one DataFrame plan. What the
algebra declines has no value: the terminal operation raises Undecidable. A plan
that meets a cell without a value where one is needed fails as it runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Undecidable, Unsupported
from ..types import ORDERING, LogicalType, Member

_SYMBOLS = {"eql": "=", "neq": "<>", "lt": "<", "lteq": "<=", "gt": ">", "gteq": ">="}
#: Spark's limit and offset are ints; a cap from here on is no cap.
_MOST = 2**31 - 1


class Pred:
    """A boolean condition on rows; node is its tree, for the renderer of SQL text, binding the one call whose columns it reads."""

    def __init__(self, column: Column, node: tuple, binding: object):
        self.column, self.node, self.binding = column, node, binding

    def _both(self, other: object, name: str) -> Pred:
        if not isinstance(other, Pred):
            raise TypeError("predicates combine with predicates only")
        if self.binding is not other.binding:
            raise Undecidable("predicates of different queries")
        both = self.column & other.column if name == "AND" else self.column | other.column
        return Pred(both, (name, self.node, other.node), self.binding)

    def __and__(self, other: object) -> Pred:
        return self._both(other, "AND")

    def __or__(self, other: object) -> Pred:
        return self._both(other, "OR")

    def __invert__(self) -> Pred:
        return Pred(~self.column, ("NOT", self.node), self.binding)

    def __bool__(self) -> bool:
        raise TypeError("a predicate isn't a bool; use &, | and ~")


@dataclass(frozen=True)
class SortKey:
    column: TypedCol
    descending: bool

    def spark(self) -> Column:
        c = F.col(self.column.name)
        return c.desc() if self.descending else c.asc()


class TypedCol:
    """A column in query mode: comparisons give predicates, everything else is refused.

    binding is the call that it is a column for: one that an inner query reads from
    an outer one would depend on the outer row, and has no value.
    """

    def __init__(self, name: str, type: LogicalType, binding: object):
        self.name, self.type, self.binding = name, type, binding

    def _compare(self, op: str, other: object) -> Pred:
        if op in ORDERING and not self.type.orderable:
            raise TypeError(f"{self.type.name} has no order")
        if other is None:
            if op not in ("eql", "neq"):
                raise TypeError("null has no order")
            c = F.col(self.name)
            return Pred(c.isNull() if op == "eql" else c.isNotNull(), ("NULL" if op == "eql" else "NOT NULL", self.name), self.binding)
        if self.type.nullable:
            raise Unsupported(f"{self.name}: a nullable column compares with null only")
        if self.type.custom(op):
            raise Unsupported(f"{self.type.name} has its own {op}")
        if isinstance(other, TypedCol):
            if other.binding is not self.binding:
                raise Undecidable(f"{other.name} is a column of another query")
            if other.type.nullable:
                raise Unsupported(f"{other.name}: a nullable column compares with null only")
            if other.type.kind != self.type.kind:
                raise TypeError(f"{self.type.name} doesn't compare with {other.type.name}")
            if other.type.custom(op):
                raise Unsupported(f"{other.type.name} has its own {op}")
            right, node = F.col(other.name), ("column", other.name)
        elif isinstance(other, Pred | Column | Relation):
            raise Unsupported("only values and columns are compared")
        else:
            bound = self.type.bind(other)
            right, node = _literal(bound, self.type), ("value", bound)
        left = F.col(self.name)
        column = {"eql": left == right, "neq": left != right, "lt": left < right, "lteq": left <= right, "gt": left > right, "gteq": left >= right}[op]
        return Pred(column, (_SYMBOLS[op], self.name, node), self.binding)

    def __eq__(self, other: object) -> Pred:  # type: ignore[override]
        return self._compare("eql", other)

    def __ne__(self, other: object) -> Pred:  # type: ignore[override]
        return self._compare("neq", other)

    def __lt__(self, other: object) -> Pred:
        return self._compare("lt", other)

    def __le__(self, other: object) -> Pred:
        return self._compare("lteq", other)

    def __gt__(self, other: object) -> Pred:
        return self._compare("gt", other)

    def __ge__(self, other: object) -> Pred:
        return self._compare("gteq", other)

    __hash__ = object.__hash__

    def _refuse(self, *_: object) -> None:
        raise Unsupported("columns have comparisons and order only")

    __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __rmul__ = __truediv__ = __floordiv__ = __mod__ = __neg__ = _refuse

    def asc(self) -> SortKey:
        return self._key(False)

    def desc(self) -> SortKey:
        return self._key(True)

    def _key(self, descending: bool) -> SortKey:
        if not self.type.orderable:
            raise TypeError(f"{self.type.name} has no order")
        return SortKey(self, descending)


def _literal(value: object, type: LogicalType) -> Column:
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
        if abs(value) >= 10**38:
            raise Undecidable(f"{value} has more than 38 digits")
        return F.lit(Decimal(value))
    return F.lit(value)


class Columns:
    """The columns of a table by name, for one call."""

    def __init__(self, fields: dict[str, LogicalType]):
        self._fields, self._binding = fields, object()

    def __getattr__(self, name: str) -> TypedCol:
        return self[name]

    def __getitem__(self, name: str) -> TypedCol:
        fields = object.__getattribute__(self, "_fields")
        if name not in fields:
            raise AttributeError(f"no column {name}")
        return TypedCol(name, fields[name], object.__getattribute__(self, "_binding"))


Selector = Callable[[Columns], TypedCol] | str


class Missing(Exception):
    """An aggregate that a Memo is still to find."""


class Memo:
    """Aggregates of one table that are found together, in one pass for all that are known to be wanted.

    A check that asks for one that isn't found yet stops there, with Missing, and is
    asked again when it is.
    """

    def __init__(self) -> None:
        self.known: dict[tuple, object] = {}
        self.wanted: dict[tuple, tuple[Relation, str, TypedCol | None]] = {}

    def ask(self, relation: Relation, kind: str, column: TypedCol | None) -> object:
        key = (tuple(p.node for p in relation.conditions), kind, column and column.name)
        if key not in self.known:
            self.wanted[key] = (relation, kind, column)
            raise Missing
        return self.known[key]

    def find(self, df: DataFrame) -> None:
        asked, self.wanted = list(self.wanted.items()), {}
        row = df.agg(*[e.alias(f"{i}_{j}") for i, (_, (r, kind, c)) in enumerate(asked) for j, e in enumerate(_parts(kind, c, r.condition()))]).first()
        for i, (key, (_, kind, c)) in enumerate(asked):
            self.known[key] = tuple(row[f"{i}_{j}"] for j in range(len(_parts(kind, c, None))))


def _parts(kind: str, c: TypedCol | None, condition: Column | None) -> list[Column]:
    """The aggregates behind a value: of all rows, or of those under a condition."""
    under = lambda x: x if condition is None else F.when(condition, x)
    n = F.count(under(F.lit(1)))
    if kind == "count":
        return [n]
    cell = F.col(c.name)
    if kind == "sum":
        return [F.try_sum(under(cell.cast("decimal(28,0)"))), F.count(under(cell))]  # summed in 38 digits
    return [(F.min if kind == "min" else F.max)(under(cell)), n, F.count(under(cell))]


def _refused(type: Column | str, why: str) -> Column:
    return F.raise_error(F.lit(f"undecidable: {why}")).cast(type)


@dataclass(frozen=True)
class Relation:
    """df's rows under conditions, order and window. row_key orders rows that tie, and is unique."""

    df: DataFrame
    fields: dict[str, LogicalType]
    row_key: tuple[str, ...]
    conditions: tuple[Pred, ...] = ()
    keys: tuple[SortKey, ...] = ()
    cap: int | None = None
    skip: int = 0
    declined: str = ""
    memo: Memo | None = None

    # -- building -------------------------------------------------------------

    def _pick(self, selector: Selector) -> TypedCol:
        c = Columns(self.fields)
        picked = c[selector] if isinstance(selector, str) else selector(c)
        if not isinstance(picked, TypedCol) or picked.binding is not object.__getattribute__(c, "_binding"):
            raise Undecidable("not a column of this query")
        return picked

    def _windowed(self) -> bool:
        return self.cap is not None or self.skip > 0

    def where(self, condition: Callable[[Columns], Pred]) -> Relation:
        """Rows for which the condition is true; what it captures is captured now."""
        c = Columns(self.fields)
        try:
            pred = condition(c)
        except Undecidable as why:
            return replace(self, declined=str(why))
        if not isinstance(pred, Pred):
            return replace(self, declined="where takes a predicate")
        if pred.binding is not object.__getattribute__(c, "_binding"):
            return replace(self, declined="a predicate of another query")
        late = "where after limit or offset" if self._windowed() else ""
        return replace(self, conditions=(*self.conditions, pred), declined=self.declined or late)

    def order(self, selector: Callable[[Columns], SortKey]) -> Relation:
        """Order by a key; a later call is the primary key, earlier ones break its ties."""
        late = "order after limit or offset" if self._windowed() else ""
        return replace(self, keys=(selector(Columns(self.fields)), *self.keys), declined=self.declined or late)

    def limit(self, n: int) -> Relation:
        """At most n rows; of several limits the least holds, a negative one is 0."""
        n = max(0, n)
        return replace(self, cap=n if self.cap is None else min(n, self.cap))

    def offset(self, n: int) -> Relation:
        """Without the first n rows; offsets add up, a negative one is 0."""
        return replace(self, skip=self.skip + max(0, n))

    # -- plans ----------------------------------------------------------------

    def condition(self) -> Column | None:
        return reduce(lambda a, b: a & b, (p.column for p in self.conditions)) if self.conditions else None

    def filtered(self) -> DataFrame:
        if self.declined:
            raise Undecidable(self.declined)
        df = self.df
        for pred in self.conditions:
            df = df.filter(pred.column)
        return df

    def rows(self, ordered: bool = True) -> DataFrame:
        """The rows: conditions, then order, then offset, then limit, in whichever order they were called.

        A row with a gap has no value, and the plan fails on it. ordered: whether rows
        are in order where no limit or offset depends on it.
        """
        for key in self.keys:
            if key.column.type.custom(*ORDERING):
                raise Unsupported(f"{key.column.type.name} has an order of its own")
        df = self.filtered()
        if ordered or self._windowed():
            df = df.orderBy(*[k.spark() for k in self.keys], *self.row_key)
        if self.skip > _MOST:
            df = df.filter(F.lit(False))
        elif self.skip:
            df = df.offset(self.skip)
        if self.cap is not None and self.cap <= _MOST:
            df = df.limit(self.cap)
        solid = [F.col(n).isNotNull() for n, t in self.fields.items() if not t.nullable]
        if solid:
            df = df.filter(F.when(reduce(lambda a, b: a & b, solid), F.lit(True)).otherwise(_refused("boolean", "a row has a cell without a value")))
        return df.select(*self.fields)

    def _aggregated(self) -> DataFrame:
        if self._windowed():
            raise Undecidable("an aggregate of a limited relation")
        return self.filtered()

    def _column(self, kind: str, selector: Selector) -> TypedCol:
        c = self._pick(selector)
        if kind == "sum":
            if not c.type.summable:
                raise Unsupported(f"{c.type.name} has no sum")
            return c
        if not c.type.orderable:
            raise TypeError(f"{c.type.name} has no order")
        if c.type.nullable:
            raise Unsupported(f"{c.name}: a nullable column has no order")
        if c.type.custom(*ORDERING):
            raise Unsupported(f"{c.type.name} has an order of its own")
        return c

    def aggregate_df(self, **wanted: str | tuple[str, Selector]) -> DataFrame:
        """One row of aggregates, in one pass: name="count", or name=(kind, column) with kind sum, min or max.

        A sum is a decimal(38,0), 0 of no rows, nulls left out. An extreme is null of no
        rows; that of an enum is its member's name. Without a value, the plan fails.
        """
        out, parts = [], []
        for name, what in wanted.items():
            kind, c = (what, None) if isinstance(what, str) else (what[0], self._column(*what))
            aggregates = [e.alias(f"{name}_{j}") for j, e in enumerate(_parts(kind, c, None))]
            parts += aggregates
            value, *rest = (F.col(f"{name}_{j}") for j in range(len(aggregates)))
            if kind == "sum":
                value = F.when(value.isNotNull(), value.cast("decimal(38,0)")).when(rest[0] == 0, F.lit(0).cast("decimal(38,0)")).otherwise(_refused("decimal(38,0)", "the sum has more than 38 digits"))
            elif kind != "count":
                told = _named(value, c.type)
                kinds = "string" if c.type.kind == "enum" else c.type.spark
                gap = rest[1] < rest[0] if kind == "min" else (rest[1] == 0) & (rest[0] > 0)
                value = F.when(gap, _refused(kinds, "the first cell in order has no value")).otherwise(told)
            out.append(value.alias(name))
        return self._aggregated().agg(*parts).select(*out)

    def count_df(self, name: str = "n") -> DataFrame:
        return self.aggregate_df(**{name: "count"})

    def sum_df(self, selector: Selector, name: str = "total") -> DataFrame:
        return self.aggregate_df(**{name: ("sum", selector)})

    def min_df(self, selector: Selector, name: str = "least") -> DataFrame:
        return self.aggregate_df(**{name: ("min", selector)})

    def max_df(self, selector: Selector, name: str = "most") -> DataFrame:
        return self.aggregate_df(**{name: ("max", selector)})

    # -- values ---------------------------------------------------------------

    def _found(self, kind: str, c: TypedCol | None) -> tuple:
        df = self._aggregated()
        return self.memo.ask(self, kind, c) if self.memo else tuple(df.agg(*_parts(kind, c, None)).first())

    def count(self) -> int:
        return self._found("count", None)[0]

    def sum(self, selector: Selector) -> int:
        total, n = self._found("sum", self._column("sum", selector))
        if total is None and n:
            raise Undecidable("the sum has more than 38 digits")
        return int(total or 0)

    def _extreme(self, selector: Selector, kind: str) -> object:
        c = self._column(kind, selector)
        value, n, seen = self._found(kind, c)
        if n and (seen < n if kind == "min" else seen == 0):
            raise Undecidable("the first cell in order has no value")
        if value is not None and c.type.kind == "enum":
            root = c.type.chain()[-1]
            return next((Member(root.name, m, v) for m, v in root.members if v == value), value)
        return int(value) if isinstance(value, Decimal) else value

    def min(self, selector: Selector) -> object:
        """None of no rows; no value if a cell in the column has none."""
        return self._extreme(selector, "min")

    def max(self, selector: Selector) -> object:
        """None of no rows; no value if no cell in the column has one."""
        return self._extreme(selector, "max")

    def to_list(self) -> list:
        try:
            return self.rows().collect()
        except PySparkException as error:
            if "undecidable: " in str(error):
                raise Undecidable("a row has a cell without a value") from error
            raise

    def violations(self, condition: Callable[[Columns], Pred]) -> DataFrame:
        """Rows for which the condition isn't definitely true, in row order."""
        pred = self.where(condition)
        if pred.declined:
            raise Undecidable(pred.declined)
        return self.filtered().filter(~F.coalesce(pred.conditions[-1].column, F.lit(False))).orderBy(*self.row_key)


def _named(value: Column, type: LogicalType) -> Column:
    """An enum's base value as the name of its member."""
    if type.kind != "enum":
        return value
    out = None
    for name, base in type.members:
        out = F.when(value == F.lit(base), name) if out is None else out.when(value == F.lit(base), name)
    return out
