"""A query for each operator of the engine over the star-schema tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .errors import Undecidable
from .functions import collections as fc
from .functions import mathlib as fm
from .functions import scalars as fs
from .operators.coerce import coerced
from .operators.master import Master, asserted, duplicates, failed_table_checks, row_problems, typed
from .plans.diagram import explained
from .plans.relation import Relation
from .types import BOOL, BYTE, DATETIME, INT, INTEGERS, LONG, NINT, STRING, ULONG, alias, converted, enum, member, nullable, refined, same_type

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

Status = enum("Status", ["F", "O", "P"], base="string")
Priority = enum("Priority", {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW"}, base="string")
EventType = enum("EventType", ["view", "click", "signup", "purchase", "error"])
Quantity = refined("Quantity", INT, lambda q: q <= 45)

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
Lines = Master("lines", {"l_orderkey": LONG, "l_linenumber": INT, "l_partkey": LONG, "l_suppkey": LONG, "l_quantity": INT, "l_returnflag": STRING}, LINE_KEY)
Orders = Master(
    "orders_",
    {"o_orderkey": LONG, "o_custkey": LONG, "o_orderstatus": Status, "o_orderpriority": Priority},
    ("o_orderkey",),
    scopes={"with_status": lambda r, s: r.where(lambda c: c.o_orderstatus == s), "urgent_orders": lambda r: r.where(lambda c: c.o_orderpriority == member(Priority, "urgent"))},
)
Parts = Master("parts", {"p_partkey": LONG, "p_name": STRING, "p_size": INT, "p_brand": STRING}, ("p_partkey",))
Events = Master("events_", {"event_id": LONG, "user_id": LONG, "ts": DATETIME}, ("event_id",))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> Relation:
    df = _read(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("int"))
    return Lines.relation(df)


def orders(spark: SparkSession, sf_dir: str) -> Relation:
    return Orders.relation(_read(spark, sf_dir, "orders"))


def parts(spark: SparkSession, sf_dir: str) -> Relation:
    return Parts.relation(_read(spark, sf_dir, "part"))


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def _out(relation: Relation, *columns: str) -> DataFrame:
    return relation.filtered().select(*columns)


_LINE = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE "

# -- filters ---------------------------------------------------------------------

for _name, _op, _test in (
    ("eq", "=", lambda c: c.l_quantity == 10),
    ("neq", "<>", lambda c: c.l_quantity != 10),
    ("lt", "<", lambda c: c.l_quantity < 10),
    ("lteq", "<=", lambda c: c.l_quantity <= 10),
    ("gt", ">", lambda c: c.l_quantity > 10),
    ("gteq", ">=", lambda c: c.l_quantity >= 10),
):
    _query(f"where_{_name}", f"{_LINE} l_quantity {_op} 10")(lambda s, d, t=_test: _out(lines(s, d).where(t), *LINE_KEY))

for _name, _op, _test in (
    ("eq", "=", lambda c: c.l_linenumber == c.l_suppkey),
    ("neq", "<>", lambda c: c.l_linenumber != c.l_suppkey),
    ("lt", "<", lambda c: c.l_linenumber < c.l_suppkey),
    ("lteq", "<=", lambda c: c.l_linenumber <= c.l_suppkey),
    ("gt", ">", lambda c: c.l_linenumber > c.l_suppkey),
    ("gteq", ">=", lambda c: c.l_linenumber >= c.l_suppkey),
):
    _query(f"where_column_{_name}", f"{_LINE} l_linenumber {_op} l_suppkey")(lambda s, d, t=_test: _out(lines(s, d).where(t), *LINE_KEY))


@_query("where_and", f"{_LINE} l_quantity > 10 AND l_returnflag = 'R'")
def where_and(spark, sf_dir):
    return _out(lines(spark, sf_dir).where(lambda c: (c.l_quantity > 10) & (c.l_returnflag == "R")), *LINE_KEY)


@_query("where_or", f"{_LINE} l_quantity > 45 OR l_returnflag = 'R'")
def where_or(spark, sf_dir):
    return _out(lines(spark, sf_dir).where(lambda c: (c.l_quantity > 45) | (c.l_returnflag == "R")), *LINE_KEY)


@_query("where_not", f"{_LINE} NOT (l_quantity > 10 OR l_returnflag = 'R')")
def where_not(spark, sf_dir):
    return _out(lines(spark, sf_dir).where(lambda c: ~((c.l_quantity > 10) | (c.l_returnflag == "R"))), *LINE_KEY)


def _nullable_parts(spark: SparkSession, sf_dir: str) -> Relation:
    df = _read(spark, sf_dir, "part").withColumn("maybe", F.nullif(F.col("p_size"), F.lit(1)))
    return Relation(df, {"p_partkey": LONG, "maybe": nullable(INT)}, ("p_partkey",))


@_query("where_is_null", "SELECT p_partkey FROM part WHERE nullif(p_size, 1) IS NULL")
def where_is_null(spark, sf_dir):
    return _out(_nullable_parts(spark, sf_dir).where(lambda c: c.maybe == None), "p_partkey")  # noqa: E711


@_query("where_is_not_null", "SELECT p_partkey FROM part WHERE nullif(p_size, 1) IS NOT NULL")
def where_is_not_null(spark, sf_dir):
    return _out(_nullable_parts(spark, sf_dir).where(lambda c: c.maybe != None), "p_partkey")  # noqa: E711


@_query("where_enum", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def where_enum(spark, sf_dir):
    return _out(orders(spark, sf_dir).where(lambda c: c.o_orderstatus == member(Status, "F")), "o_orderkey")


@_query("where_bool", "SELECT p_partkey FROM part WHERE (p_size > 25) = true")
def where_bool(spark, sf_dir):
    df = _read(spark, sf_dir, "part").withColumn("large", F.col("p_size") > 25)
    return _out(Relation(df, {"p_partkey": LONG, "large": BOOL}, ("p_partkey",)).where(lambda c: c.large == True), "p_partkey")  # noqa: E712


@_query("where_radix_signed", f"{_LINE} l_quantity = 16 OR l_quantity <= -1 OR l_linenumber = 5")
def where_radix_signed(spark, sf_dir):
    return _out(lines(spark, sf_dir).where(lambda c: (c.l_quantity == 0x10) | (c.l_quantity <= -1) | (c.l_linenumber == 0b101)), *LINE_KEY)


@_query("where_captured", f"{_LINE} l_quantity > 40")
def where_captured(spark, sf_dir):
    least = 20
    found = lines(spark, sf_dir).where(lambda c: c.l_quantity > least * 2)
    least = 0  # what was captured is folded already
    return _out(found, *LINE_KEY)


@_query("where_chain", f"{_LINE} l_quantity > 10 AND l_quantity < 20 AND l_returnflag <> 'N'")
def where_chain(spark, sf_dir):
    found = lines(spark, sf_dir).where(lambda c: c.l_quantity > 10).where(lambda c: c.l_quantity < 20)
    return _out(found.where(lambda c: c.l_returnflag != "N"), *LINE_KEY)


# -- order, limit, offset -----------------------------------------------------------


@_query("order_limit", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20")
def order_limit(spark, sf_dir):
    return parts(spark, sf_dir).order(lambda c: c.p_size.desc()).limit(20).rows().select("p_partkey", "p_size")


@_query("order_offset_limit", "SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 10 OFFSET 5")
def order_offset_limit(spark, sf_dir):
    return parts(spark, sf_dir).order(lambda c: c.p_size.asc()).offset(5).limit(10).rows().select("p_partkey", "p_size")


@_query("order_twice", "SELECT p_partkey FROM part ORDER BY p_brand DESC, p_size, p_partkey LIMIT 25")
def order_twice(spark, sf_dir):
    return parts(spark, sf_dir).order(lambda c: c.p_size.asc()).order(lambda c: c.p_brand.desc()).limit(25).rows().select("p_partkey")


@_query("limit_min", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 3")
def limit_min(spark, sf_dir):
    return parts(spark, sf_dir).limit(7).limit(3).limit(9).rows().select("p_partkey")


@_query("offset_sum", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 4 OFFSET 8")
def offset_sum(spark, sf_dir):
    return parts(spark, sf_dir).offset(3).offset(5).limit(4).rows().select("p_partkey")


@_query("window_commutes", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 1 OFFSET 1")
def window_commutes(spark, sf_dir):
    return parts(spark, sf_dir).limit(1).offset(1).rows().select("p_partkey")


@_query("limit_negative", "SELECT p_partkey FROM part LIMIT 0")
def limit_negative(spark, sf_dir):
    return parts(spark, sf_dir).limit(-5).rows().select("p_partkey")


@_query("to_list_order", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'")
def to_list_order(spark, sf_dir):
    return orders(spark, sf_dir).where(lambda c: c.o_orderstatus != member(Status, "P")).order(lambda c: c.o_custkey.asc()).rows()


# -- aggregates -----------------------------------------------------------------------


@_query("count", "SELECT count(*) AS n FROM lineitem")
def count(spark, sf_dir):
    return lines(spark, sf_dir).count_df()


@_query("count_where", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 30")
def count_where(spark, sf_dir):
    return lines(spark, sf_dir).where(lambda c: c.l_quantity > 30).count_df()


@_query("count_ignores_order", "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 7")
def count_ignores_order(spark, sf_dir):
    return lines(spark, sf_dir).order(lambda c: c.l_partkey.desc()).where(lambda c: c.l_quantity < 7).count_df()


def _whole(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) for c in df.columns])


@_query("sum", "SELECT CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem")
def sum_(spark, sf_dir):
    return _whole(lines(spark, sf_dir).sum_df("l_quantity"))


@_query("sum_where", "SELECT CAST(sum(l_suppkey) AS BIGINT) AS total FROM lineitem WHERE l_returnflag = 'A'")
def sum_where(spark, sf_dir):
    return _whole(lines(spark, sf_dir).where(lambda c: c.l_returnflag == "A").sum_df("l_suppkey"))


@_query("sum_empty", "SELECT CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS total FROM lineitem WHERE l_quantity < 0")
def sum_empty(spark, sf_dir):
    return _whole(lines(spark, sf_dir).where(lambda c: c.l_quantity < 0).sum_df("l_quantity"))


@_query("sum_beyond_64_bits", "SELECT CAST(sum(CAST(o_orderkey AS HUGEINT) + 9223372036854000000) AS VARCHAR) AS total FROM orders")
def sum_beyond_64_bits(spark, sf_dir):
    # Two sums: a key and the number together needn't fit a LONG.
    df = _read(spark, sf_dir, "orders").withColumn("wide", F.when(F.col("o_orderkey").isNotNull(), F.lit(9223372036854000000)))
    sums = Relation(df, {"o_orderkey": LONG, "wide": LONG}, ("o_orderkey",)).aggregate_df(keys=("sum", "o_orderkey"), wide=("sum", "wide"))
    return sums.select((F.col("keys") + F.col("wide")).cast("string").alias("total"))


@_query("min", "SELECT min(p_size) AS least FROM part WHERE p_brand > 'Brand#2'")
def min_(spark, sf_dir):
    return parts(spark, sf_dir).where(lambda c: c.p_brand > "Brand#2").min_df("p_size")


@_query("max", "SELECT max(p_name) AS most FROM part")
def max_(spark, sf_dir):
    return parts(spark, sf_dir).max_df(lambda c: c.p_name)


@_query("min_empty", "SELECT min(p_size) AS least FROM part WHERE p_size < 0")
def min_empty(spark, sf_dir):
    return parts(spark, sf_dir).where(lambda c: c.p_size < 0).min_df("p_size")


@_query("enum_max", "SELECT max(o_orderstatus) AS most FROM orders")
def enum_max(spark, sf_dir):
    return orders(spark, sf_dir).max_df("o_orderstatus")


@_query("avg_div", "SELECT CAST(sum(l_quantity) AS BIGINT) // count(*) AS average FROM lineitem")
def avg_div(spark, sf_dir):
    both = lines(spark, sf_dir).aggregate_df(total=("sum", "l_quantity"), n="count")
    return both.select(fs.div(F.col("total"), F.col("n")).cast("bigint").alias("average"))


@_query("aggregates_of_gaps", """SELECT CASE WHEN count(x) = count(*) THEN CAST(min(x) AS VARCHAR) ELSE 'declined' END AS least, CAST(max(x) AS VARCHAR) AS most,
    CAST(coalesce(sum(x), 0) AS VARCHAR) AS total, CAST(count(*) AS VARCHAR) AS n, CASE WHEN count(x) = count(*) THEN 'rows' ELSE 'declined' END AS listed
    FROM (SELECT nullif(p_size, 7) AS x FROM part)""")
def aggregates_of_gaps(spark, sf_dir):
    df = _read(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(7)).alias("x"))
    r = Relation(df, {"p_partkey": LONG, "x": INT}, ("p_partkey",))
    listed = lambda: r.limit(df.count()).to_list() and "rows"
    found = [_outcome(f) for f in (lambda: r.min("x"), lambda: r.max("x"), lambda: r.sum("x"), r.count, listed)]
    return spark.createDataFrame([found], "least string, most string, total string, n string, listed string")


def _outcome(f: Callable[[], object]) -> str:
    """A value as text, or that there is none."""
    try:
        return str(f())
    except Undecidable:
        return "declined"
    except TypeError:
        return "refused"


@_query("extreme_of_enum", """SELECT CASE max(o_orderpriority) WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'unspecified' ELSE 'low' END AS most,
    CASE min(o_orderpriority) WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'unspecified' ELSE 'low' END AS least FROM orders""")
def extreme_of_enum(spark, sf_dir):
    return orders(spark, sf_dir).aggregate_df(most=("max", "o_orderpriority"), least=("min", "o_orderpriority"))


_DECLINED = {
    "arithmetic": lambda r: r.where(lambda c: c.p_size + 1 > 2).count(),
    "no_predicate": lambda r: r.where(lambda c: True).count(),
    "relation_operand": lambda r: r.where(lambda c: c.p_size > r).count(),
    "correlated": lambda r: r.where(lambda c: c.p_size > r.where(lambda d: d.p_partkey == c.p_partkey).count()).count(),
    "foreign_predicate": lambda r: r.where(lambda c: r.where(lambda d: c.p_size > 1).count() > 0).count(),
    "where_after_limit": lambda r: r.limit(2).where(lambda c: c.p_size > 1).to_list(),
    "order_after_offset": lambda r: r.offset(2).order(lambda c: c.p_size.asc()).to_list(),
    "count_of_limit": lambda r: r.limit(2).count(),
    "sum_of_offset": lambda r: r.offset(1).sum("p_size"),
    "min_of_limit": lambda r: r.limit(1).min("p_size"),
    "own_less": lambda r: replace(r, fields=r.fields | {"p_size": alias("Own", INT, ("lt",))}).where(lambda c: c.p_size < 3).count(),
    "own_less_by_alias": lambda r: replace(r, fields=r.fields | {"p_size": alias("Other", alias("Own", INT, ("lt",)))}).where(lambda c: c.p_size < 3).count(),
    "own_order": lambda r: replace(r, fields=r.fields | {"p_size": alias("Own", INT, ("lt",))}).order(lambda c: c.p_size.asc()).to_list(),
    "own_sum": lambda r: replace(r, fields=r.fields | {"p_size": alias("Own", INT, ("add",))}).sum("p_size"),
    "sum_of_unbounded": lambda r: replace(r, fields=r.fields | {"p_size": NINT}).sum("p_size"),
    "sum_of_ulong": lambda r: replace(r, fields=r.fields | {"p_size": ULONG}).sum("p_size"),
    "nullable_to_value": lambda r: replace(r, fields=r.fields | {"p_size": nullable(INT)}).where(lambda c: c.p_size == 1).count(),
    "min_of_nullable": lambda r: replace(r, fields=r.fields | {"p_size": nullable(INT)}).min("p_size"),
    "refined_operand": lambda r: r.where(lambda c: c.p_size > Quantity.admit(46)).count(),
    "count_into_byte": lambda r: BYTE.admit(r.count() + 256),
    "order_of_bool": lambda r: replace(r, fields=r.fields | {"p_size": BOOL}).where(lambda c: c.p_size < True).count(),
    "null_order": lambda r: r.where(lambda c: c.p_size < None).count(),
    "other_kind": lambda r: r.where(lambda c: c.p_size == "x").count(),
}


@_query("declined", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{'refused' if n in ('order_of_bool', 'null_order', 'other_kind') else 'declined'}')" for n in _DECLINED) + ") t(query, outcome)")
def declined(spark, sf_dir):
    """What the algebra doesn't express; each is asked of the whole table."""
    r = parts(spark, sf_dir)
    return spark.createDataFrame([(n, _outcome(lambda f=f: f(r))) for n, f in _DECLINED.items()], "query string, outcome string")


@_query("answered", """SELECT * FROM (VALUES ('aggregate_ignores_own_order', (SELECT count(*) FROM part)), ('uncorrelated', (SELECT count(*) FROM part WHERE p_size > (SELECT min(p_size) FROM part))),
    ('into_refined', (SELECT count(*) FROM part WHERE p_size > 45)), ('into_int', (SELECT count(*) FROM part))) t(query, n)""")
def answered(spark, sf_dir):
    """Twins of what is declined."""
    r = parts(spark, sf_dir)
    own = replace(r, fields=r.fields | {"p_size": alias("Own", INT, ("lt",))})
    found = [("aggregate_ignores_own_order", own.order(lambda c: c.p_size.asc()).count()), ("uncorrelated", r.where(lambda c: c.p_size > r.min("p_size")).count()), ("into_refined", r.where(lambda c: c.p_size > Quantity.admit(45)).count()), ("into_int", INT.admit(r.count()))]
    return spark.createDataFrame(found, "query string, n long")


# -- scopes, relation values -------------------------------------------------------------


@_query("scope_parameter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def scope_parameter(spark, sf_dir):
    return _out(Orders.scope("with_status", orders(spark, sf_dir), member(Status, "O")), "o_orderkey")


@_query("scope_view", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def scope_view(spark, sf_dir):
    Orders.views(_read(spark, sf_dir, "orders"))
    return spark.table("orders__urgent_orders")


@_query("relation_parameter", "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def relation_parameter(spark, sf_dir):
    def settled(r: Relation) -> Relation:
        return Orders.scope("with_status", r, member(Status, "F"))

    return settled(Orders.scope("urgent_orders", orders(spark, sf_dir))).count_df()


# -- validation --------------------------------------------------------------------------


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Master]:
    fields = Lines.fields | {"l_quantity": Quantity}
    master = Master("lines", fields, LINE_KEY, each=[lambda r: r.l_quantity >= r.l_linenumber, lambda r: fs.div(F.lit(100), r.l_quantity - 10) >= 0])
    df = _read(spark, sf_dir, "lineitem")
    return typed(df, fields, LINE_KEY), master


@_query("refine_violations", f"{_LINE} (l_quantity <= 45) IS NOT TRUE")
def refine_violations(spark, sf_dir):
    table, master = _checked(spark, sf_dir)
    return row_problems(table, master, each=False).select(*LINE_KEY)


@_query(
    "each_violations",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n FROM (SELECT *, CAST(l_quantity < l_linenumber AS INT)"
    " + CAST(l_quantity = 10 OR (l_quantity < 10 AND trunc(100 / (l_quantity - 10)) < 0) AS INT) AS n FROM lineitem WHERE l_quantity <= 45) WHERE n > 0",
)
def each_violations(spark, sf_dir):
    table, master = _checked(spark, sf_dir)
    return row_problems(table, master, refine=False).select(*LINE_KEY, F.size("_failed").alias("n"))


@_query("each_with_methods", f"{_LINE} l_quantity <= 45 AND NOT coalesce(CASE WHEN l_quantity > 3 THEN l_quantity * 2 > l_linenumber + 6 END, false)")
def each_with_methods(spark, sf_dir):
    """A method with an assertion within it: a row for which that fails has no value, and fails the check."""
    fields = Lines.fields | {"l_quantity": Quantity}
    doubled = lambda row, n: asserted(row.l_quantity > 3, row.l_quantity * n)
    master = Master("lines", fields, LINE_KEY, each=[lambda r: r.times(2) > r.l_linenumber + 6], methods={"times": doubled})
    return row_problems(typed(_read(spark, sf_dir, "lineitem"), fields, LINE_KEY), master).filter("_failed[0].code = 'row_validation_failed'").select(*LINE_KEY)


@_query(
    "failed_condition_drawn",
    """SELECT p_partkey, 'p_size >= 10 && p_size <= 40' || chr(10) || '^      ^     ^  ^      ^' || chr(10)
    || rpad('' || p_size, 7, ' ') || rpad(CASE WHEN p_size >= 10 THEN 'true' ELSE 'false' END, 6, ' ') || '|  ' || rpad('' || p_size, 7, ' ') || CASE WHEN p_size <= 40 THEN 'true' ELSE 'false' END
    || chr(10) || repeat(' ', 13) || 'false' AS diagram FROM part WHERE NOT (p_size >= 10 AND p_size <= 40)""",
)
def failed_condition_drawn(spark, sf_dir):
    return explained(parts(spark, sf_dir), lambda c: (c.p_size >= 10) & (c.p_size <= 40)).select("p_partkey", "diagram")


@_query("violations_null", "SELECT p_partkey FROM part WHERE (nullif(p_size, 3) > 2) IS NOT TRUE")
def violations_null(spark, sf_dir):
    df = _read(spark, sf_dir, "part").withColumn("size", F.nullif(F.col("p_size"), F.lit(3)))
    return Relation(df, {"p_partkey": LONG, "size": INT}, ("p_partkey",)).violations(lambda c: c.size > 2).select("p_partkey")


@_query(
    "all_checks",
    "SELECT unnest([0, 1, 2, 3, 4]) AS check_, unnest([(SELECT count(*) > 10 FROM part), (SELECT min(p_size) >= 1 FROM part), (SELECT max(p_size) < 20 FROM part), false, (SELECT sum(p_size) // count(*) > min(p_size) FROM part)]) AS passed",
)
def all_checks(spark, sf_dir):
    checks = [lambda r: r.count() > 10, lambda r: r.min("p_size") >= 1, lambda r: r.max("p_size") < 20, lambda r: r.limit(3).count() == 3, lambda r: r.sum("p_size") // r.count() > r.min("p_size")]
    master = Master("parts", Parts.fields, Parts.primary, all=checks)
    failed = failed_table_checks(typed(_read(spark, sf_dir, "part"), Parts.fields, Parts.primary), master)
    return spark.createDataFrame([(i, i not in failed) for i in range(len(checks))], "check_ int, passed boolean")


def _duplicates(primary: str) -> str:
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
    SELECT *, row_number() OVER (PARTITION BY {primary} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k > 1"""


@_query("pk_duplicates", _duplicates("l_orderkey"))
def pk_duplicates(spark, sf_dir):
    return duplicates(typed(_read(spark, sf_dir, "lineitem"), Lines.fields, LINE_KEY), ("l_orderkey",), Lines.fields).select("_row.*")


@_query("pk_composite", _duplicates("l_orderkey, l_linenumber"))
def pk_composite(spark, sf_dir):
    return duplicates(typed(_read(spark, sf_dir, "lineitem"), Lines.fields, LINE_KEY), ("l_orderkey", "l_linenumber"), Lines.fields).select("_row.*")


# -- coercion ----------------------------------------------------------------------------


def _coerce(name: str, text: str, type, spark_text: Callable[[], Column], sql: str) -> None:
    @_query(f"coerce_{name}", f"SELECT p_partkey, {sql} AS value FROM (SELECT p_partkey, {text} AS t FROM part)")
    def coerce_(spark, sf_dir):
        df = _read(spark, sf_dir, "part").select("p_partkey", spark_text().alias("t"))
        value = coerced(F.col("t"), type)
        return df.select("p_partkey", (value.cast("string") if type is NINT else value).alias("value"))


_NUMBER = "regexp_full_match(t, '[+-]?[0-9]+')"
_coerce("int_line_end", "CASE WHEN p_size % 2 = 0 THEN p_size || chr(10) ELSE '' || p_size END", INT, lambda: F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("\n"))).otherwise(F.col("p_size").cast("string")), f"CASE WHEN {_NUMBER} THEN TRY_CAST(t AS INT) END")
_coerce("byte", "CASE WHEN p_size % 5 = 0 THEN ' ' || (p_size * 7) WHEN p_size % 5 = 1 THEN '-' || p_size ELSE '' || (p_size * 7) END", BYTE, lambda: F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" "), (F.col("p_size") * 7).cast("string"))).when(F.col("p_size") % 5 == 1, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise((F.col("p_size") * 7).cast("string")), f"CASE WHEN {_NUMBER} AND TRY_CAST(t AS HUGEINT) BETWEEN 0 AND 255 THEN TRY_CAST(t AS SMALLINT) END")
_coerce("int", "CASE WHEN p_size % 3 = 0 THEN '+' || p_size WHEN p_size % 3 = 1 THEN '1_0' ELSE p_size || '0000000' END", INT, lambda: F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("+"), F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, F.lit("1_0")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("0000000"))), f"CASE WHEN {_NUMBER} THEN TRY_CAST(t AS INT) END")
_coerce("nint", "'99999999999' || p_partkey", NINT, lambda: F.concat(F.lit("99999999999"), F.col("p_partkey").cast("string")), f"CASE WHEN {_NUMBER} THEN CAST(TRY_CAST(t AS HUGEINT) AS VARCHAR) END")
_coerce("bool", "CASE p_size % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'yes' ELSE 'true ' END", BOOL, lambda: F.get(F.array(*map(F.lit, ("true", "false", "yes", "true "))), F.col("p_size") % 4), "CASE t WHEN 'true' THEN true WHEN 'false' THEN false END")
_coerce("enum", "CASE p_size % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'signup' ELSE 'nothing' END", EventType, lambda: F.get(F.array(*map(F.lit, ("view", "click", "signup", "nothing"))), F.col("p_size") % 4), "CASE t WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 END")

# -- scalars -------------------------------------------------------------------------------


def _scalar(name: str, table: str, key: str, value: Callable[[], Column], sql: str) -> None:
    """A column of one function over a whole table."""

    @_query(name, f"SELECT {key}, {sql} AS value FROM {table}")
    def scalar(spark, sf_dir):
        return _read(spark, sf_dir, table).select(key, value().alias("value"))


def _c(name: str) -> Column:
    return F.col(name)


def _long(x: Column) -> Column:
    return x.cast("bigint")


_I = "CAST(o_custkey - 700 AS BIGINT)"
for _name, _f, _sql in (
    ("int_add", fs.add, f"{_I} + o_orderkey"),
    ("int_sub", fs.sub, f"{_I} - o_orderkey"),
    ("int_mul", fs.mul, f"{_I} * o_orderkey"),
    ("int_div", fs.div, f"CASE WHEN o_orderkey % 50 <> 0 THEN {_I} // (o_orderkey % 50) END"),
    ("int_rem", fs.rem, f"CASE WHEN o_orderkey % 50 <> 0 THEN {_I} % (o_orderkey % 50) END"),
    ("bit_and", fs.band, f"{_I} & o_orderkey"),
    ("bit_or", fs.bor, f"{_I} | o_orderkey"),
    ("bit_xor", fs.bxor, f"xor({_I}, o_orderkey)"),
):
    _b = (lambda: _c("o_orderkey") % 50) if _name in ("int_div", "int_rem") else (lambda: _c("o_orderkey"))
    _scalar(_name, "orders", "o_orderkey", lambda f=_f, b=_b: _long(f(_c("o_custkey") - 700, b())), _sql)
_scalar("int_neg", "orders", "o_orderkey", lambda: _long(fs.neg(_c("o_custkey"))), "-o_custkey")
_scalar("shl", "orders", "o_orderkey", lambda: fs.shl(_c("o_custkey") - 700, _c("o_orderkey") % 70).cast("string"), f"CAST(CAST({_I} AS HUGEINT) * CAST(power(2::DOUBLE, o_orderkey % 70) AS HUGEINT) AS VARCHAR)")
_scalar("shr", "orders", "o_orderkey", lambda: _long(fs.shr(_c("o_custkey") - 700, _c("o_orderkey") % 70)), f"CASE WHEN o_orderkey % 70 > 62 THEN CASE WHEN {_I} < 0 THEN -1 ELSE 0 END ELSE CAST(floor({_I} / power(2, o_orderkey % 70)) AS BIGINT) END")

_WIDE_A, _WIDE_B = (f"(CAST(o_custkey - 700 AS HUGEINT) * 1000000000000000000000000000000 {x}" for x in ("- o_orderkey)", "+ o_custkey * 7919)"))
_POWER = "(CAST(1 AS HUGEINT) << CAST(o_orderkey % 120 AS INT))"


@_query(
    "wide_integers",
    f"""SELECT o_orderkey, CAST(CASE WHEN d <> 0 THEN a // d END AS VARCHAR) AS quotient, CAST(CASE WHEN d <> 0 THEN a % d END AS VARCHAR) AS rest, CAST(a & b AS VARCHAR) AS band, CAST(a | b AS VARCHAR) AS bor,
    CAST(xor(a, b) AS VARCHAR) AS bxor, CAST(CASE WHEN a < 0 THEN -((p - 1 - a) // p) ELSE a // p END AS VARCHAR) AS shr, CAST(-a AS VARCHAR) AS neg, CAST(CASE WHEN a < 0 THEN -a ELSE a END AS VARCHAR) AS abs
    FROM (SELECT o_orderkey, {_WIDE_A} AS a, {_WIDE_B} AS b, o_orderkey % 50 - 25 AS d, {_POWER} AS p FROM orders)""",
)
def wide_integers(spark, sf_dir):
    """Integers of up to 38 digits, with quotients that are as long."""
    big = F.lit(Decimal(10**30))
    a = (_c("o_custkey") - 700).cast("decimal(7,0)") * big
    a, b = fs.sub(a, _c("o_orderkey")), fs.add(a, _c("o_custkey") * 7919)
    d, n = _c("o_orderkey") % 50 - 25, _c("o_orderkey") % 120
    found = {"quotient": fs.div(a, d), "rest": fs.rem(a, d), "band": fs.band(a, b), "bor": fs.bor(a, b), "bxor": fs.bxor(a, b), "shr": fs.shr(a, n), "neg": fs.neg(a), "abs": fm.abs_(a)}
    return _read(spark, sf_dir, "orders").select("o_orderkey", *[c.cast("string").alias(k) for k, c in found.items()])


_scalar("bool_ops", "part", "p_partkey", lambda: ((_c("p_size") > 10) & ~(_c("p_size") > 30)) | (_c("p_size") == 1), "((p_size > 10) AND NOT (p_size > 30)) OR p_size = 1")
_scalar("choose", "part", "p_partkey", lambda: fs.choose(_c("p_size") > 25, F.lit("large"), F.lit("small")), "CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END")
_scalar("switch", "part", "p_partkey", lambda: fs.switch(_c("p_size"), [(F.lit(1), F.lit("one")), (F.lit(2), F.lit("two"))]), "CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END")
_scalar("str_concat", "part", "p_partkey", lambda: fs.concat(_c("p_name"), _c("p_brand")), "p_name || p_brand")
_scalar("str_less", "part", "p_partkey", lambda: _c("p_name") < _c("p_brand"), "p_name < p_brand")
_scalar("str_len", "documents", "doc_id", lambda: fs.length(_c("text")), "CAST(length(text) AS INT)")
_scalar("str_at", "documents", "doc_id", lambda: F.coalesce(fs.at(_c("text"), _c("n_chars") - 700)["ok"], fs.at(_c("text"), _c("n_chars") - 700)["err"]), "CASE WHEN n_chars >= 700 THEN substring(text, n_chars - 699, 1) ELSE 'index out of range' END")
_scalar("str_slice", "documents", "doc_id", lambda: F.coalesce(fs.slice_(_c("text"), F.lit(3), _c("n_chars") - 700)["ok"], F.lit("error")), "CASE WHEN n_chars >= 703 THEN substring(text, 4, n_chars - 703) ELSE 'error' END")
_scalar("str_chars", "part", "p_partkey", lambda: F.array_join(fs.chars(_c("p_name")), "|"), "array_to_string(string_split(p_name, ''), '|')")
_scalar("str_bytes", "documents", "doc_id", lambda: F.aggregate(fs.bytes_(_c("text")), F.lit(0).cast("bigint"), lambda a, b: a + b), "CAST(coalesce(list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))), 0) AS BIGINT)")
_scalar("dt_add", "events", "event_id", lambda: fs.later(fs.millis(_c("ts")), F.lit(fs.parse_duration("1w2d3h4m5s6ms"))), "epoch_us(ts) // 1000 + 788645006")
_scalar("dt_sub", "events", "event_id", lambda: fs.earlier(fs.millis(_c("ts")), F.lit(fs.parse_duration("36h"))), "epoch_us(ts) // 1000 - 129600000")
_scalar("dt_between", "events", "event_id", lambda: fs.between(fs.millis(_c("ts")), F.lit(fs.parse_datetime("D2020-01-01T00:00:00.000Z"))), "epoch_us(ts) // 1000 - 1577836800000")
_scalar("dt_before", "events", "event_id", lambda: fs.millis(_c("ts")) < F.lit(fs.parse_datetime("D2024-01-15T12:00:00Z")), "epoch_us(ts) // 1000 < epoch_ms(TIMESTAMP '2024-01-15 12:00:00')")
_scalar("dur_times", "events", "event_id", lambda: fs.times(F.lit(1500), _c("user_id")), "1500 * user_id")
_scalar("enum_less", "orders", "o_orderkey", lambda: _c("o_orderstatus") < F.lit(dict(Status.members)["O"]), "o_orderstatus < 'O'")

# -- collections -------------------------------------------------------------------------------

_XS = "list_transform(range(0, p_size % 7), lambda i: (i * p_size) % 11)"


def _xs() -> Column:
    n = _c("p_size") % 7
    return F.transform(fc.range_list(F.lit(0), n - 1), lambda i: (i * _c("p_size")) % 11)


def _list(name: str, value: Callable[[Column], Column], sql: str) -> None:
    """sql has the list as `xs`."""

    @_query(name, f"SELECT p_partkey, {sql} AS value FROM (SELECT p_partkey, p_size, {_XS} AS xs FROM part)")
    def list_(spark, sf_dir):
        return _read(spark, sf_dir, "part").select("p_partkey", "p_size", _xs().alias("xs")).select("p_partkey", value(_c("xs")).alias("value"))


def _told(xs: Column) -> Column:
    return F.concat_ws(",", xs.cast("array<string>"))


def _text(sql: str) -> str:
    return f"coalesce(array_to_string({sql}, ','), '')"


_list("list_len", fc.list_len, "CAST(len(xs) AS INT)")
_list("list_fold", lambda xs: _long(fc.list_fold(xs, F.lit(0).cast("bigint"), lambda a, k, v: a + (k + 1) * v)), "CAST(coalesce(list_sum(list_transform(xs, lambda v, k: k * v)), 0) AS BIGINT)")
_list("list_any", lambda xs: fc.list_any(xs, lambda x: x > 8), "len(list_filter(xs, lambda x: x > 8)) > 0")
_list("list_all", lambda xs: fc.list_all(xs, lambda x: x < 9), "len(list_filter(xs, lambda x: x < 9)) = len(xs)")
_list("list_map", lambda xs: _told(fc.list_map(xs, lambda x: x * 2)), _text("list_transform(xs, lambda x: x * 2)"))
_list("list_filter", lambda xs: _told(fc.list_filter(xs, lambda x: x % 2 == 0)), _text("list_filter(xs, lambda x: x % 2 = 0)"))
_list("list_keys", lambda xs: _told(fc.indices(xs)), _text("range(0, len(xs))"))
_list("list_push", lambda xs: _told(fc.list_push(xs, F.lit(99).cast("bigint"))), _text("list_append(xs, 99)"))
_list("list_unshift", lambda xs: _told(fc.list_unshift(xs, F.lit(99).cast("bigint"))), _text("list_prepend(99, xs)"))
_list("list_pop", fc.list_pop, "xs[len(xs)]")
_list("list_shift", fc.list_shift, "xs[1]")
_list("list_get", lambda xs: F.coalesce(fc.list_get(xs, F.lit(2))["ok"].cast("string"), fc.list_get(xs, F.lit(2))["err"]), "CASE WHEN len(xs) > 2 THEN CAST(xs[3] AS VARCHAR) ELSE 'index out of range' END")
_list("list_set", lambda xs: _told(fc.list_set(xs, F.lit(1), F.lit(77).cast("bigint"))), f"CASE WHEN len(xs) > 1 THEN {_text('list_transform(xs, lambda x, i: CASE WHEN i = 2 THEN 77 ELSE x END)')} ELSE '' END")
_list("list_concat", lambda xs: _told(fc.list_concat(xs, xs)), _text("list_concat(xs, xs)"))
_list("range_count", lambda xs: F.size(fc.range_list(F.lit(5), _c("p_size"))), "CAST(greatest(p_size - 4, 0) AS INT)")
_list("range_step", lambda xs: _told(fc.range_list(_c("p_size"), F.lit(0), F.lit(-7))), _text("range(p_size, -1, -7)"))
_list("range_half_open", lambda xs: _told(fc.range_literal(_c("p_size") % 4, F.lit(2), closed=False)), "CASE p_size % 4 WHEN 0 THEN '0,1' WHEN 1 THEN '1' WHEN 2 THEN '' ELSE '2' END")
_list("range_down", lambda xs: _told(fc.range_literal(_c("p_size") % 4, F.lit(1))), "CASE p_size % 4 WHEN 0 THEN '0,1' WHEN 1 THEN '1' WHEN 2 THEN '2,1' ELSE '3,2,1' END")
_list("range_equal", lambda xs: fc.range_equal((F.lit(0), _c("p_size"), F.lit(1)), (F.lit(0), F.lit(9), F.lit(1))), "p_size = 9")
_list("math_max_of", lambda xs: F.coalesce(fm.max_of(xs)["ok"].cast("string"), fm.max_of(xs)["err"]), "coalesce(CAST(list_max(xs) AS VARCHAR), 'max of an empty list')")
_list("math_min_of", lambda xs: F.coalesce(fm.min_of(xs)["ok"].cast("string"), fm.min_of(xs)["err"]), "coalesce(CAST(list_min(xs) AS VARCHAR), 'min of an empty list')")
_list("math_max_or", lambda xs: fm.max_or(xs, F.lit(5).cast("bigint")), "greatest(coalesce(list_max(xs), 5), 5)")
_list("math_min_or", lambda xs: fm.min_or(xs, F.lit(2).cast("bigint")), "least(coalesce(list_min(xs), 2), 2)")
_list("math_sum", lambda xs: F.coalesce(fm.sum_of(xs)["ok"].cast("string"), fm.sum_of(xs)["err"]), "coalesce(CAST(CAST(list_sum(xs) AS BIGINT) AS VARCHAR), 'sum of an empty list')")
_list("math_product", lambda xs: F.coalesce(fm.product_of(xs)["ok"].cast("string"), fm.product_of(xs)["err"]), "CASE WHEN len(xs) = 0 THEN 'product of an empty list' ELSE CAST(CAST(list_product(xs) AS BIGINT) AS VARCHAR) END")
_list("list_values", lambda xs: _told(fc.list_values(xs)), _text("xs"))
_list("list_equal", lambda xs: fc.list_equal(xs, F.transform(F.sequence(F.lit(0), F.size(xs)), lambda i: (i * _c("p_size")) % 11)) | fc.list_equal(xs, F.array(F.lit(0).cast("bigint"))), "xs = [0]")
_list("list_add_element", lambda xs: _told(fc.list_add(xs, F.lit(5).cast("bigint"), ArrayType(LongType()), LongType())), _text("list_append(xs, 5)"))
_list("list_add_list", lambda xs: _told(fc.list_add(xs, xs, ArrayType(LongType()), ArrayType(LongType()))), _text("list_concat(xs, xs)"))
_list("range_len", lambda xs: fc.range_len(_c("p_size"), F.lit(0), F.lit(-7)), "CAST(len(range(p_size, -1, -7)) AS BIGINT)")
_list("range_fold", lambda xs: _long(fc.range_fold(F.lit(2), _c("p_size"), F.lit(0).cast("bigint"), lambda a, k, v: a + (k + 1) * v, F.lit(3))), "CAST(coalesce(list_sum(list_transform(range(2, p_size + 1, 3), lambda v, k: k * v)), 0) AS BIGINT)")
_list("range_any", lambda xs: fc.range_any(F.lit(1), _c("p_size"), lambda v: v * v == _c("p_size")), "len(list_filter(range(1, p_size + 1), lambda v: v * v = p_size)) > 0")
_list("range_all", lambda xs: fc.range_all(F.lit(5), _c("p_size"), lambda v: v < 20), "p_size < 20")
_list("range_map", lambda xs: _told(fc.range_map(F.lit(1), _c("p_size") % 7, lambda v: v * 3)), _text("list_transform(range(1, p_size % 7 + 1), lambda v: v * 3)"))
_list("range_filter", lambda xs: _told(fc.range_filter(F.lit(1), _c("p_size"), lambda v: v % 5 == 0)), _text("list_filter(range(1, p_size + 1), lambda v: v % 5 = 0)"))
_list("range_keys", lambda xs: _told(fc.range_keys(F.lit(3), _c("p_size") % 9)), _text("range(0, greatest(p_size % 9 - 2, 0))"))

_M = "map(['size', 'seven'], [p_size, p_size % 7])"


def _map(name: str, value: Callable[[Column], Column], sql: str) -> None:
    """sql has the map as `m`."""

    @_query(name, f"SELECT p_partkey, {sql} AS value FROM (SELECT p_partkey, p_size, {_M} AS m FROM part)")
    def map_(spark, sf_dir):
        m = F.create_map(F.lit("size"), _c("p_size"), F.lit("seven"), _c("p_size") % 7)
        return _read(spark, sf_dir, "part").select("p_partkey", "p_size", m.alias("m")).select("p_partkey", value(_c("m")).alias("value"))


_map("map_len", fc.map_len, "CAST(cardinality(m) AS INT)")
_map("map_fold", lambda m: fc.map_fold(m, F.lit(0), lambda a, k, v: a + F.length(k) * v), "4 * p_size + 5 * (p_size % 7)")
_map("map_any", lambda m: fc.map_any(m, lambda v: v > 40), "p_size > 40 OR p_size % 7 > 40")
_map("map_all", lambda m: fc.map_all(m, lambda v: v < 40), "p_size < 40 AND p_size % 7 < 40")
_map("map_map", lambda m: _told(fc.map_map(m, lambda v: v + 1)), _text("list_transform(map_values(m), lambda v: v + 1)"))
_map("map_filter", lambda m: _told(fc.map_filter(m, lambda v: v > 3)), _text("list_filter(map_values(m), lambda v: v > 3)"))
_map("map_keys", lambda m: _told(fc.map_keys(m)), _text("map_keys(m)"))
_map("map_values", lambda m: _told(fc.map_values(m)), _text("map_values(m)"))
_map("map_get", lambda m: F.coalesce(fc.map_get(m, F.lit("none"))["ok"].cast("string"), fc.map_get(m, F.lit("none"))["err"]), "'key not found'")
_map("map_set", lambda m: _told(fc.map_values(fc.map_set(m, F.lit("size"), F.lit(-1)))), "'-1,' || (p_size % 7)")

_map("map_equal", lambda m: fc.map_equal(m, F.create_map(F.lit("seven"), F.lit(3), F.lit("size"), _c("p_size"))), "p_size % 7 = 3")

_P = ("part", "p_partkey")
_scalar("error_message", *_P, lambda: fs.message(fs.error(F.concat(F.lit("no "), _c("p_name")))), "'no ' || p_name")
_scalar("record_field", *_P, lambda: fs.with_field(fs.record(size=_c("p_size"), brand=_c("p_brand")), "size", _c("p_size") + 1)["size"], "p_size + 1")
_UNION = {"small": "int", "name": "string"}
_scalar("union_match", *_P, lambda: fs.match(F.when(_c("p_size") < 10, fs.tagged("small", _c("p_size"), _UNION)).otherwise(fs.tagged("name", _c("p_name"), _UNION)), {"small": lambda v: (v * 2).cast("string"), "name": lambda v: F.upper(v)}), "CASE WHEN p_size < 10 THEN CAST(p_size * 2 AS VARCHAR) ELSE upper(p_name) END")
_scalar("now", *_P, lambda: fs.now() > F.lit(fs.parse_datetime("D2024-01-01T00:00:00Z")), "true")
_scalar("convert_sbyte", *_P, lambda: converted(_c("p_size") * 5 - 128, INTEGERS["sbyte"]).cast("int"), "CASE WHEN p_size * 5 - 128 <= 127 THEN p_size * 5 - 128 END")
_scalar("convert_ulong", *_P, lambda: converted(_c("p_size") - 9, ULONG).cast("string"), "CASE WHEN p_size >= 9 THEN CAST(p_size - 9 AS VARCHAR) END")
_scalar("convert_refined", *_P, lambda: Quantity.admitted(_c("p_size") + 10), "CASE WHEN p_size <= 35 THEN p_size + 10 END")


@_query("type_bounds", "SELECT * FROM (VALUES ('sbyte', '-128', '127'), ('short', '-32768', '32767'), ('int', '-2147483648', '2147483647'), ('long', '-9223372036854775808', '9223372036854775807'), ('byte', '0', '255'), ('ushort', '0', '65535'), ('uint', '0', '4294967295'), ('ulong', '0', '18446744073709551615')) t(name, least, most)")
def type_bounds(spark, sf_dir):
    return spark.createDataFrame([(n, str(t.lo), str(t.hi)) for n, t in INTEGERS.items() if t.hi is not None], "name string, least string, most string")


@_query("type_equal", "SELECT * FROM (VALUES ('int = int', true), ('int = long', false), ('alias = base', false), ('alias = alias', true)) t(pair, equal)")
def type_equal(spark, sf_dir):
    own = alias("Own", INT)
    found = [("int = int", same_type(INT, INT)), ("int = long", same_type(INT, LONG)), ("alias = base", same_type(own, INT)), ("alias = alias", same_type(own, alias("Own", INT)))]
    return spark.createDataFrame(found, "pair string, equal boolean")


_scalar("math_max", *_P, lambda: fm.max2(_c("p_size"), F.lit(20)), "greatest(p_size, 20)")
_scalar("math_min", *_P, lambda: fm.min2(_c("p_size"), F.lit(20)), "least(p_size, 20)")
_scalar("math_clamp", *_P, lambda: fm.clamp(_c("p_size"), F.lit(10), F.lit(30)), "least(greatest(p_size, 10), 30)")
_scalar("math_abs", *_P, lambda: _long(fm.abs_(_c("p_size") - 25)), "CAST(abs(p_size - 25) AS BIGINT)")
_scalar("math_sign", *_P, lambda: fm.sign(_c("p_size") - 25), "CAST(sign(p_size - 25) AS INT)")
_scalar("math_gcd", *_P, lambda: _long(fm.gcd(_c("p_partkey"), _c("p_size"))), "CAST(gcd(p_partkey, p_size) AS BIGINT)")
_scalar("math_lcm", *_P, lambda: _long(fm.lcm(_c("p_partkey"), _c("p_size"))), "CAST(lcm(p_partkey, p_size) AS BIGINT)")
_scalar("math_pow", *_P, lambda: _long(fm.pow_(F.lit(-3), _c("p_size") % 30)), "CAST(CAST(3 AS HUGEINT) ** (p_size % 30) AS HUGEINT)::BIGINT * CASE WHEN p_size % 2 = 1 AND (p_size % 30) % 2 = 1 THEN -1 WHEN (p_size % 30) % 2 = 1 THEN -1 ELSE 1 END")

from . import load_queries  # noqa: E402, F401  registers its queries
