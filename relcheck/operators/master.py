"""Masters: declared tables with a row type, a primary key, sources, checks and scopes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SpecError, Undecidable, Unreadable
from ..plans.relation import Memo, Missing, Relation
from ..sources import Source, check_options, read
from ..types import LogicalType
from .coerce import DIAGNOSTIC, PLACE, coerce, listed, names, problem

#: The fields of a diagnostic.
DIAGNOSTICS = "code string, master string, source string, row bigint, col int, field string, value string, type string, key string, first bigint, detail string"


class Row:
    """A row's cells as columns, in checks of value mode: row.power >= row.cost; and its methods: row.margin(2)."""

    def __init__(self, fields: dict[str, LogicalType], methods: Mapping[str, Callable[..., Column]] = {}):  # noqa: B006
        self._fields, self._methods = fields, methods

    def __getattr__(self, name: str) -> Column | Callable[..., Column]:
        if name in self._methods:
            return lambda *args: self._methods[name](self, *args)
        if name not in self._fields:
            raise AttributeError(f"no field {name}")
        return F.col(f"`{name}`")


def asserted(condition: Column, value: Column) -> Column:
    """A method's value under an assertion within it: where that isn't definitely true, there is no value."""
    return F.when(condition, value)


@dataclass
class Master:
    """each: predicates over a Row; all: predicates over a Relation of all rows; scopes: named relations; methods: of a Row.

    fields are a dict, or a list of (name, type) as they are declared.
    """

    name: str
    fields: dict[str, LogicalType]
    primary: tuple[str, ...]
    sources: list[Source] = field(default_factory=list)
    each: list[Callable[[Row], Column]] = field(default_factory=list)
    all: list[Callable[[Relation], bool]] = field(default_factory=list)
    scopes: dict[str, Callable[..., Relation]] = field(default_factory=dict)
    methods: dict[str, Callable[..., Column]] = field(default_factory=dict)
    where: object = None

    def __post_init__(self) -> None:
        self.row_errors: list[SpecError] = []
        declared = self.fields
        if isinstance(declared, list | tuple) and all(isinstance(f, tuple) and len(f) == 2 for f in declared):
            seen = [f for f, _ in declared]
            self.row_errors = [SpecError("duplicate_row_field", f"{self.name}: {f}") for i, f in enumerate(seen) if f in seen[:i]][:1]
            declared = dict(declared)
        if not isinstance(declared, Mapping) or not all(isinstance(t, LogicalType) for t in declared.values()):
            self.row_errors = [SpecError("unsupported_row_type", self.name)]
            declared = {}
        self.fields = dict(declared)

    def check(self) -> list[SpecError]:
        """What is wrong with the declaration; with anything wrong, no data are read."""
        out, primary = [], tuple(self.primary)
        if not self.fields and not self.row_errors:
            out.append(SpecError("master_missing_row", self.name))
        if not primary:
            out.append(SpecError("master_missing_primary", self.name))
        out += [SpecError("master_duplicate_primary_key", f"{self.name}: {p}") for i, p in enumerate(primary) if p in primary[:i]]
        if not self.row_errors:
            out += [SpecError("master_primary_unknown_field", f"{self.name}: {p}") for p in primary if p not in self.fields]
        if self.where is not None:
            out.append(SpecError("master_where_unsupported", self.name))
        out += [SpecError("master_validate_not_assert", self.name) for c in [*self.each, *self.all] if not callable(c)]
        return out

    def relation(self, df: DataFrame, row_key: tuple[str, ...] | None = None) -> Relation:
        """All rows of a typed DataFrame. Rows that tie keep the order of row_key, the primary key if none is named."""
        return Relation(df.select(*dict.fromkeys([*self.fields, *(row_key or ())])), self.fields, tuple(row_key or self.primary))

    def scope(self, name: str, relation: Relation, *args: object) -> Relation:
        return self.scopes[name](relation, *args)

    def views(self, df: DataFrame) -> None:
        """The table and its scopes without parameters as temporary views, in no order but where a limit depends on it."""
        df.select(*self.fields).createOrReplaceTempView(self.name)
        for name, scope in self.scopes.items():
            if scope.__code__.co_argcount == 1:
                scope(self.relation(df)).rows(ordered=False).createOrReplaceTempView(f"{self.name}_{name}")


class Project:
    """Masters by name, of which some have a namespace before it (deck.Cards), and their tables."""

    def __init__(self, *masters: Master):
        self.masters = {m.name: m for m in masters}
        self._repeated = [m.name for i, m in enumerate(masters) if m.name in [x.name for x in masters[:i]]]
        self._tables: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> Master:
        """By the whole name, or by the last part of it if only one master has that."""
        found = [self.masters[name]] if name in self.masters else [m for n, m in self.masters.items() if n.rsplit(".", 1)[-1] == name]
        if len(found) != 1:
            raise KeyError(name)
        return found[0]

    def check(self) -> list[SpecError]:
        return [SpecError("duplicate_master", n) for n in self._repeated] + [e for m in self.masters.values() for e in m.check()]

    def load(self, spark: SparkSession, base: str) -> tuple[list[tuple[str, str, DataFrame]], DataFrame]:
        """(master, source, typed table) of each source that is read, and all diagnostics. With any declaration wrong, no data are read."""
        if wrong := self.check():
            return [], _spec_diagnostics(spark, "", "", wrong)
        tables, told = [], [_spec_diagnostics(spark, "", "", [])]
        for m in self.masters.values():
            for path, table, found in load(spark, m, base):
                told.append(found)
                if table is not None:
                    tables.append((m.name, path, table))
        return tables, reduce(DataFrame.union, told)

    def bind(self, name: str, df: DataFrame) -> None:
        self._tables[self[name].name] = df

    def relation(self, name: str) -> Relation:
        """A master's name in a query: the relation of all its rows."""
        m = self[name]
        if m.name not in self._tables:
            raise Undecidable(f"{m.name} has no table")
        return m.relation(self._tables[m.name])


def typed(df: DataFrame, fields: dict[str, LogicalType], row_key: tuple[str, ...], line: str | None = None) -> DataFrame:
    """A native table as coerce() gives it: nulls in fields that don't admit them are gaps. line: a column of line numbers."""
    has = names(fields)
    place = F.struct(*[F.col(f"`{k}`") for k in row_key]) if len(row_key) > 1 else F.col(f"`{row_key[0]}`")  # an order without a global sort
    gaps = listed([F.when(F.col(f"`{n}`").isNull(), F.lit(n)) for n, t in fields.items() if not t.nullable], "string")
    places = F.struct(*[F.lit(None).cast(PLACE).alias(n) for n in fields])
    own = [place.alias(has.row), (F.col(line) if line else F.lit(None)).cast("bigint").alias(has.line), places.alias(has.places)]
    own += [gaps.alias(has.gaps), listed([], "string").alias(has.wide), listed([], DIAGNOSTIC).alias(has.problems)]
    return df.select(*[F.col(f"`{n}`").cast(t.spark).alias(n) for n, t in fields.items()], *own)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def row_problems(table: DataFrame, master: Master, refine: bool = True, each: bool = True) -> DataFrame:
    """The rows of table that have a problem, with `_failed`: coercion's problems, refinements, then row checks.

    Of a cell's refinements the first that fails, from the outermost, is told. Row
    checks are left out for rows with a gap or a failed refinement, and altogether
    if a field has no column. A check that isn't definitely true fails. Rows are
    tested first, and only those that fail are told of.
    """
    has = names(master.fields)
    present = [n for n in master.fields if n in table.columns]
    place = {n: F.col(f"`{has.places}`.`{n}`") for n in present}
    line = {n: F.coalesce(place[n]["line"], F.col(has.line)) for n in present}
    refined, told = [], []
    for n in present:
        cell, test = F.col(f"`{n}`"), None
        for t in master.fields[n].chain():
            if t.predicate is not None:
                failed = cell.isNotNull() & ~F.coalesce(t.predicate(cell), F.lit(False))
                one = problem("cell_refinement", n, t.name, line[n], place[n]["col"], cell.cast("string"))
                test = F.when(failed, one) if test is None else test.when(failed, one)
                refined.append(failed)
        if test is not None and refine:
            told.append(test)
    checks = []
    if each and len(present) == len(master.fields):
        row = Row(master.fields, master.methods)
        checks = [~F.coalesce(c(row), F.lit(False)) for c in master.each]
    whole = [F.col(f"`{n}`").isNotNull() for n, t in master.fields.items() if n in present and not t.nullable]
    sound = reduce(lambda a, b: a & b, [*whole, ~_any(refined)])
    df = table.filter((F.size(has.problems) > 0) | (_any(refined) if refine else F.lit(False)) | (sound & _any(checks)))
    failed = [F.when(sound & c, problem("row_validation_failed", "", str(i), F.col(has.line), F.lit(None), F.lit(None).cast("string"))) for i, c in enumerate(checks)]
    return df.withColumn(_failed(master), F.concat(has.problems, listed(told, DIAGNOSTIC), listed(failed, DIAGNOSTIC)))


def _failed(master: Master) -> str:
    return names(master.fields).problems.replace("_problems", "_failed")


def duplicates(table: DataFrame, primary: tuple[str, ...], fields: dict[str, LogicalType]) -> DataFrame:
    """Rows whose primary key an earlier row has: the key, the row's place and line, the column `col` of its first key cell, and `first`, the earlier row's line.

    Keys with a gap are no keys. The first row of a key is found by aggregation and
    rows that share its place are counted, so a key of very many rows isn't gathered
    in a task; only keys and places are shuffled.
    """
    has = names(fields)
    key = [F.col(f"`{p}`") for p in primary]
    keyed = table.filter(reduce(lambda a, b: a & b, [k.isNotNull() for k in key]))
    at = F.col(f"`{has.places}`.`{primary[0]}`")
    keyed = keyed.select(*key, F.col(has.row).alias("_at"), F.coalesce(at["line"], F.col(has.line)).alias("_l"), at["col"].alias("_c"))
    # Rows in one place are there only if the row key repeats; all but the first one of them are later.
    placed = keyed.groupBy(*key, "_at").agg(F.count("*").alias("_n"), F.max("_l").alias("_l"), F.max("_c").alias("_c"))
    first = placed.groupBy(*key).agg(F.min(F.struct("_at", "_l")).alias("_f"), F.sum("_n").alias("_k")).filter("_k > 1")
    later = placed.join(first, list(primary)).withColumn("_n", F.when(F.col("_at") > F.col("_f._at"), F.col("_n")).otherwise(F.col("_n") - 1)).filter("_n > 0")
    out = [*key, F.col("_at").alias(has.row), F.col("_l").alias(has.line), F.col("_c").alias("col"), F.col("_f._l").alias("first")]
    return later.select(*out, F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")).alias("_i")).drop("_i")


def _full(df: DataFrame, master: str, source: str, **columns: Column) -> DataFrame:
    own = {"master": F.lit(master or None), "source": F.lit(source or None)}
    return df.select(*[columns.get(n, own.get(n, F.lit(None))).cast(kind).alias(n) for n, kind in (c.split() for c in DIAGNOSTICS.split(", "))])


def _spec_diagnostics(spark: SparkSession, master: str, source: str, wrong: list[SpecError]) -> DataFrame:
    rows = spark.createDataFrame([(e.code, e.row, e.detail) for e in wrong], "c string, r bigint, d string")
    return _full(rows, master, source, code=F.col("c"), row=F.col("r"), detail=F.col("d"))


def diagnostics(table: DataFrame, master: Master, source: str = "", wrong: list[SpecError] = ()) -> DataFrame:
    """Everything that is wrong with one source's table, in the schema of DIAGNOSTICS."""
    p, each = F.col("p"), F.col("p.code") == "row_validation_failed"
    checked = row_problems(table, master).select(F.explode(_failed(master)).alias("p"))
    out = _full(checked, master.name, source, code=p["code"], row=p["row"], col=p["col"], field=F.when(p["field"] != "", p["field"]), value=p["value"], type=F.when(~each, p["type"]), detail=F.when(each, F.concat(F.lit("check "), p["type"])))
    if all(k in table.columns for k in master.primary):
        has = names(master.fields)
        key = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(f"`{k}`").cast("string")) for k in master.primary])
        found = duplicates(table, master.primary, master.fields)
        out = out.union(_full(found, master.name, source, code=F.lit("duplicate_primary_key"), row=F.col(has.line), col=F.col("col"), key=key, first=F.col("first")))
    failed = [SpecError("table_validation_failed", f"check {i}") for i in failed_table_checks(table, master)]
    if wrong or failed:
        out = out.union(_spec_diagnostics(table.sparkSession, master.name, source, [*wrong, *failed]))
    return out


def failed_table_checks(table: DataFrame, master: Master) -> list[int]:
    """Which table checks aren't definitely true; one without a value fails, too.

    The aggregates that all checks ask for first are found in one pass over the
    table, then those that they ask for next, and so on. Columns with cells that are
    too wide to be held are no columns here.
    """
    if not master.all:
        return []
    has = names(master.fields)
    present = {n: t for n, t in master.fields.items() if n in table.columns}
    unbounded = [n for n, t in present.items() if t.kind == "int" and t.hi is None]
    if unbounded:
        wide = table.agg(*[F.max(F.array_contains(has.wide, n)).alias(str(i)) for i, n in enumerate(unbounded)]).first()
        present = {n: t for n, t in present.items() if n not in unbounded or not wide[str(unbounded.index(n))]}
    memo = Memo()
    relation = Relation(table.select(*[F.col(f"`{n}`") for n in present], has.row), present, (has.row,), memo=memo)
    open_, out = dict(enumerate(master.all)), []
    while open_:
        for i, check in list(open_.items()):
            try:
                passed = check(relation) is True
            except Missing:
                continue
            except (Undecidable, AttributeError, ZeroDivisionError):
                passed = False
            del open_[i]
            if not passed:
                out.append(i)
        if open_:
            memo.find(relation.df)
    return sorted(out)


def load(spark: SparkSession, master: Master, base: str) -> list[tuple[str, DataFrame | None, DataFrame]]:
    """(source, typed table or None, diagnostics) for each source; sources are never merged, and one that isn't read doesn't keep others from it."""
    if wrong := master.check():
        raise wrong[0]
    if master.row_errors:
        first = master.sources[0].path if master.sources else ""
        return [(first, None, _spec_diagnostics(spark, master.name, first, master.row_errors))]
    return list(_loaded(spark, master, base))


def _loaded(spark: SparkSession, master: Master, base: str) -> Iterator[tuple[str, DataFrame | None, DataFrame]]:
    for source in master.sources:
        try:
            if wrong := check_options(source):
                yield source.path, None, _spec_diagnostics(spark, master.name, source.path, wrong)
                continue
            raw = read(spark, source, base)
        except SpecError as error:
            yield source.path, None, _spec_diagnostics(spark, master.name, source.path, [error])
        except Unreadable as error:
            yield source.path, None, _full(error.found, master.name, source.path, code=F.col("code"), row=F.col("row"), detail=F.col("detail"))
        else:
            table, wrong = coerce(raw.rows, raw.header, master.fields)
            yield source.path, table, diagnostics(table, master, source.path, wrong)


def dump(name: str, path: str, table: DataFrame, fields: dict[str, LogicalType]) -> DataFrame:
    """(line string): a table as text in order, a heading and a line for each row; gaps say so."""
    has = names(fields)
    shown = [n for n in fields if n in table.columns]
    missing = lambda n: F.array_contains(has.gaps, n) | F.array_contains(has.wide, n)
    cells = [F.when(missing(n), F.lit("<unevaluated>")).otherwise(F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("null"))) for n in shown]
    rows = table.select(F.lit(1).alias("k"), F.col(has.row).alias("r"), F.concat_ws(" | ", *cells).alias("line"))
    head = table.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(None).cast(rows.schema["r"].dataType).alias("r"), F.lit(f"{name} <- {path}").alias("line"))
    return head.union(rows).orderBy("k", "r").select("line")


def report(found: DataFrame, path: str, format: str = "json") -> None:
    """Diagnostics as files of JSON lines, or of text."""
    if format == "json":
        found.write.mode("overwrite").json(path)
    else:
        text = F.concat_ws(":", "source", "row", "col"), F.concat_ws(" ", "code", "field", "value", "type", "key", "detail")
        found.select(F.concat_ws(" ", *text)).write.mode("overwrite").text(path)
