"""Queries for the path from files to checked tables. Files are written from the star-schema tables into the shared folder first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.coerce import names
from .operators.master import Master, Project, diagnostics, dump, load, report, row_problems, typed
from .plans import sqltext
from .plans.relation import Relation
from .queries import LINE_KEY, Events, Lines, Parts, Quantity, Status, _outcome, _query, _read, parts
from .sources import Source, lookup
from .storage import fresh_path, stored
from .streaming import check_stream
from .types import DATETIME, INT, LONG, NINT, STRING, member, refined

Size = refined("Size", INT, lambda x: x <= 50)


def _folder(spark: SparkSession, *files: tuple[str, DataFrame | str]) -> str:
    """A folder with files of these names: of a text, or of the texts `value` in the order of `k`, one to a line."""
    base = fresh_path(spark, "files")
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for name, text in files:
        df = spark.createDataFrame([(0, text)], "k int, value string") if isinstance(text, str) else text
        df.repartition(1, "k").sortWithinPartitions("k").select("value").write.option("lineSep", "\n").text(f"{base}/{name}.parts")
        folder = jvm.Path(f"{base}/{name}.parts")
        store = folder.getFileSystem(conf)
        part = next(f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-"))
        store.rename(part, jvm.Path(f"{base}/{name}"))
    return base


def _lines(df: DataFrame, key: str, header: str, value: Column) -> DataFrame:
    """A heading and a line for each row, in the order of key."""
    head = df.sparkSession.createDataFrame([(-1, header)], "k long, value string")
    return head.union(df.select(F.col(key).alias("k"), value.alias("value")))


def _text(name: str) -> Column:
    return F.col(name).cast("string")


@_query("csv_load", """SELECT p_partkey, p_name || ', "x"' || chr(10) || 'y' AS p_name, p_size, p_brand, CAST(2 * row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS line FROM part""")
def csv_load(spark, sf_dir):
    """Quoted cells with delimiters, quotes and line ends; a column that no field has; fields in another order than columns."""
    quoted = F.concat(F.lit('"'), F.col("p_name"), F.lit(', ""x""\ny"'))
    df = _lines(_read(spark, sf_dir, "part"), "p_partkey", "p_size,p_name,extra,p_partkey,p_brand", F.concat_ws(",", _text("p_size"), quoted, F.lit("e"), _text("p_partkey"), "p_brand"))
    master = Master("parts", Parts.fields, ("p_partkey",), [Source("csv", "parts.csv")])
    [(_, table, _)] = load(spark, master, _folder(spark, ("parts.csv", df)))
    return table.select(*Parts.fields, F.col("_line").alias("line"))


_SIZE = "CASE WHEN p_partkey % 7 = 0 THEN 'x' || p_size WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN '' || (p_size + 100) ELSE '' || p_size END"


@_query(
    "csv_problems",
    f"""
WITH src AS (SELECT p_name, row_number() OVER (ORDER BY p_partkey) + 1 AS line, {_SIZE} AS t, CASE WHEN p_partkey % 17 = 0 THEN p_partkey - 1 ELSE p_partkey END AS k, p_partkey % 19 = 0 AS short FROM part),
typed AS (SELECT *, CASE WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS INT) END AS size, min(line) OVER (PARTITION BY k) AS first_ FROM src)
SELECT code, CAST("row" AS BIGINT) AS "row", CAST(col AS INT) AS col, field, value, type, key, CAST(first_ AS BIGINT) AS "first" FROM (
SELECT 'cell_type_mismatch' AS code, line AS "row", 1 AS col, 'p_size' AS field, t AS value, 'Size' AS type, NULL AS key, NULL AS first_ FROM typed WHERE size IS NULL
UNION ALL SELECT 'cell_type_mismatch', line, NULL, 'p_name', NULL, 'string', NULL, NULL FROM typed WHERE short
UNION ALL SELECT 'cell_refinement', line, 1, 'p_size', CAST(size AS VARCHAR), 'Size', NULL, NULL FROM typed WHERE size > 50
UNION ALL SELECT 'row_validation_failed', line, NULL, NULL, NULL, NULL, NULL, NULL FROM typed WHERE size <= 50 AND NOT short AND size % 10 = 3
UNION ALL SELECT 'duplicate_primary_key', line, len(t) + 2, NULL, NULL, NULL, 'p_partkey=' || k, first_ FROM typed WHERE line > first_
UNION ALL SELECT 'table_validation_failed', NULL, NULL, NULL, NULL, NULL, NULL, NULL
UNION ALL SELECT 'missing_column', NULL, NULL, NULL, NULL, NULL, NULL, NULL WHERE false)""",
)
def csv_problems(spark, sf_dir):
    """Every kind of problem of cells, rows and tables, with its place."""
    t = F.expr("CASE WHEN p_partkey % 7 = 0 THEN concat('x', p_size) WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN string(p_size + 100) ELSE string(p_size) END")
    key = F.when(F.col("p_partkey") % 17 == 0, F.col("p_partkey") - 1).otherwise(F.col("p_partkey")).cast("string")
    value = F.when(F.col("p_partkey") % 19 == 0, F.concat_ws(",", t, key)).otherwise(F.concat_ws(",", t, key, F.lit("e"), "p_name"))
    df = _lines(_read(spark, sf_dir, "part"), "p_partkey", "p_size,p_partkey,extra,p_name", value)
    master = Master("parts", {"p_partkey": LONG, "p_name": STRING, "p_size": Size}, ("p_partkey",), [Source("csv", "parts.csv")], each=[lambda r: r.p_size % 10 != 3], all=[lambda r: r.count() > 0, lambda r: r.max("p_partkey") < 0])
    [(_, _, found)] = load(spark, master, _folder(spark, ("parts.csv", df)))
    return found.select("code", "row", "col", "field", "value", "type", "key", "first")


# What is said of sources that can't be read.
_SOURCES = {
    "empty": ("", (), [(None, "the source has no header row")]),
    "blank_lines": ("\n\n", (), [(None, "the source has no header row")]),
    "duplicate_header": ("id,power,power\n1,2,3", (), [(None, 'duplicate column "power"')]),
    "long_rows": ("id,name\n1,a,X\n2,b\n\n3,c,Y,Z", (), [(2, "row 2 has more fields than the header"), (5, "row 5 has more fields than the header")]),
    "bare_quote": ('id,name\n1,a"b\n2,c', (), [(2, "line 2: a quote isn't closed")]),
    "two_bare_quotes": ('id,name\n1,a\n2,c"d\n3,e"f\n4,g', (), [(3, "line 3: a quote in a bare cell")]),
    "after_quote": ('id,name\n1,"a"b\n2,c', (), [(2, "line 2: text after a closing quote")]),
    "long_before_malformed": ('id,name\n1,a,X\n2,"b"c\n3,d,Y', (), [(3, "line 3: text after a closing quote"), (2, "row 2 has more fields than the header")]),
    "long_delimiter": ("id,name", (("delimiter", "++"),), [(None, "delimiter must be a single character")]),
    "no_delimiter": ("id,name", (("delimiter", ""),), [(None, "delimiter must be a single character")]),
    "missing": (None, (), [(None, "no such file")]),
}


def _sql(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


@_query("csv_unreadable", 'SELECT source, code, CAST("row" AS BIGINT) AS "row", detail, tables FROM (VALUES ' + ", ".join(f"('{n}', 'source_unreadable', {_sql(r)}, {_sql(d)}, 0)" for n, (_, _, told) in _SOURCES.items() for r, d in told) + ', (\'good\', NULL, NULL, NULL, 2)) t(source, code, "row", detail, tables)')
def csv_unreadable(spark, sf_dir):
    """Sources that can't be read are told of one by one, and don't keep others of their master from it."""
    base = _folder(spark, *[(n, text) for n, (text, *_) in _SOURCES.items() if text is not None], ("good", "id;name\n1;a\n"))
    sources = [Source("csv", n, options) for n, (_, options, _) in _SOURCES.items()] + [Source("csv", "good", (("delimiter", ";"),))]
    found = load(spark, Master("m", {"id": INT, "name": STRING}, ("id",), [sources[-1], *sources]), base)
    rows = [(path, r["code"], r["row"], r["detail"], 0) for path, table, told in found if table is None for r in told.collect()]
    return spark.createDataFrame([*rows, ("good", None, None, None, sum(t is not None for _, t, _ in found))], "source string, code string, row long, detail string, tables int")


_DECLARED = {
    "unknown_format": (Source("xlsx", "a"), "unknown_format"),
    "unknown_option": (Source("csv", "a", (("header", "x"),)), "unknown_option"),
    "option_type": (Source("csv", "a", (("delimiter", 1),)), "option_type_mismatch"),
    "option_twice": (Source("csv", "a", (("delimiter", ";"), ("delimiter", ","))), "duplicate_option"),
    "absolute": (Source("csv", "/etc/a"), "locator_escapes_root"),
    "drive": (Source("csv", "c:a"), "locator_escapes_root"),
    "upwards": (Source("csv", "b/../../a"), "locator_escapes_root"),
    "upwards_backslash": (Source("csv", "..\\a"), "locator_escapes_root"),
}


@_query("source_checks", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{code}')" for n, (_, code) in _DECLARED.items()) + ", ('by_registry', 'csv')) t(source, code)")
def source_checks(spark, sf_dir):
    """Sources that are refused before anything is read."""
    rows = [(n, r["code"]) for n, (s, _) in _DECLARED.items() for _, _, told in load(spark, Master("m", {"id": INT}, ("id",), [s]), "/nowhere") for r in told.collect()]
    return spark.createDataFrame([*rows, ("by_registry", lookup("csv").__name__.removeprefix("read_"))], "source string, code string")


_MASTERS = {
    "no_row": (lambda: Master("m", {}, ("id",)), "master_missing_row,master_primary_unknown_field"),
    "no_primary": (lambda: Master("m", {"id": INT}, ()), "master_missing_primary"),
    "primary_twice": (lambda: Master("m", {"id": INT}, ("id", "id")), "master_duplicate_primary_key"),
    "primary_unknown": (lambda: Master("m", {"id": INT}, ("key",)), "master_primary_unknown_field"),
    "where": (lambda: Master("m", {"id": INT}, ("id",), where=lambda r: r.id > 0), "master_where_unsupported"),
    "no_assert": (lambda: Master("m", {"id": INT}, ("id",), each=[1], all=[True]), "master_validate_not_assert,master_validate_not_assert"),
    "row_type": (lambda: Master("m", "cards", ("id",), [Source("csv", "a")]), "unsupported_row_type"),
    "field_twice": (lambda: Master("m", [("id", INT), ("n", INT), ("id", LONG)], ("id",), [Source("csv", "a")]), "duplicate_row_field"),
    "field_type": (lambda: Master("m", {"id": INT, "at": DATETIME}, ("id",), [Source("csv", "a")]), "unsupported_field_type"),
    "column": (lambda: Master("m", {"id": INT, "b": INT}, ("id",), [Source("csv", "a")], each=[lambda r: r.b > 0], all=[lambda r: r.min("b") > 0, lambda r: r.count() == 1]), "missing_column,table_validation_failed"),
}


@_query("declaration_checks", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{codes}')" for n, (_, codes) in _MASTERS.items()) + ") t(master, codes)")
def declaration_checks(spark, sf_dir):
    """What is wrong with a master, told before its data are read, or when they are."""
    base, out = _folder(spark, ("a", "id,at\n1,x\n")), []
    for n, (made, _) in _MASTERS.items():
        master = made()
        codes = [e.code for e in master.check()] or [r["code"] for _, _, told in load(spark, master, base) for r in told.collect()]
        out.append((n, ",".join(sorted(codes))))
    return spark.createDataFrame(out, "master string, codes string")


@_query("multi_source", "SELECT 's' || (o_orderkey % 3) || '.csv' AS source, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def multi_source(spark, sf_dir):
    """Each source is a table of its own; here with keys that would be duplicates in one."""
    df = _read(spark, sf_dir, "orders").withColumn("id", F.floor(F.col("o_orderkey") / 3))
    part = lambda i: _lines(df.filter(F.col("o_orderkey") % 3 == i), "o_orderkey", "id|cust", F.concat_ws("|", _text("id"), _text("o_custkey")))
    master = Master("m", {"id": LONG, "cust": LONG}, ("id",), [Source("csv", f"s{i}.csv", (("delimiter", "|"),)) for i in range(3)])
    found = load(spark, master, _folder(spark, *[(f"s{i}.csv", part(i)) for i in range(3)]))
    out = None
    for path, table, told in found:
        assert told.isEmpty()
        one = table.agg(F.lit(path).alias("source"), F.count("*").alias("n"), F.sum("cust").alias("total"))
        out = one if out is None else out.union(one)
    return out


_WIDE = "CASE WHEN p_partkey % 3 = 0 THEN repeat('9', 45) WHEN p_partkey % 3 = 1 THEN '-' || p_partkey ELSE '99999999999999999999' END"


@_query("wide_cells", f"SELECT p_partkey, CASE WHEN len(t) < 40 THEN t END AS n, len(t) >= 40 AS wide, 'declined' AS least, (SELECT count(*) FROM part) AS n_rows FROM (SELECT p_partkey, {_WIDE} AS t FROM part)")
def wide_cells(spark, sf_dir):
    """Numbers with more digits than a column holds are no problem; but what asks for their column has no value."""
    t = F.expr("CASE WHEN p_partkey % 3 = 0 THEN repeat('9', 45) WHEN p_partkey % 3 = 1 THEN concat('-', p_partkey) ELSE '99999999999999999999' END")
    df = _lines(_read(spark, sf_dir, "part"), "p_partkey", "p_partkey,n", F.concat_ws(",", _text("p_partkey"), t))
    master = Master("m", {"p_partkey": LONG, "n": NINT}, ("p_partkey",), [Source("csv", "n.csv")], all=[lambda r: r.count() > 0, lambda r: r.min("n") < 0])
    [(_, table, told)] = load(spark, master, _folder(spark, ("n.csv", df)))
    codes = [tuple(r) for r in told.select("code", "detail").collect()]
    least = "declined" if codes == [("table_validation_failed", "check 1")] else str(codes)
    return table.select("p_partkey", F.col("n").cast("string").alias("n"), F.array_contains("_wide", "n").alias("wide"), F.lit(least).alias("least"), F.lit(table.count()).cast("long").alias("n_rows"))


@_query("row_key_name", "SELECT * FROM (SELECT p_partkey AS _row, p_size AS _line, p_name AS _gaps, CAST(row_number() OVER (ORDER BY p_partkey) + 1 AS BIGINT) AS line FROM part) WHERE _line > 40")
def row_key_name(spark, sf_dir):
    """Fields that are named like the engine's own columns."""
    fields = {"_row": LONG, "_line": INT, "_gaps": STRING}
    df = _lines(_read(spark, sf_dir, "part"), "p_partkey", "_row,_line,_gaps", F.concat_ws(",", _text("p_partkey"), _text("p_size"), "p_name"))
    master = Master("m", fields, ("_row",), [Source("csv", "m.csv")], each=[lambda r: getattr(r, "_line") <= 40], all=[lambda r: r.count() > 0])
    [(_, table, told)] = load(spark, master, _folder(spark, ("m.csv", df)))
    lines = told.filter("code = 'row_validation_failed'").select(F.col("row").alias("line"))
    return table.select(*fields, F.col(names(fields).line).alias("line")).join(lines, "line")


@_query("dump_text", "SELECT 'parts <- parts.csv' AS line UNION ALL SELECT p_partkey || ' | ' || CASE WHEN p_size > 30 THEN '<unevaluated>' ELSE CAST(p_size AS VARCHAR) END FROM part")
def dump_text(spark, sf_dir):
    df = _lines(_read(spark, sf_dir, "part"), "p_partkey", "p_partkey,p_size", F.concat_ws(",", _text("p_partkey"), F.when(F.col("p_size") > 30, "no").otherwise(_text("p_size"))))
    master = Master("parts", {"p_partkey": LONG, "p_size": INT}, ("p_partkey",), [Source("csv", "parts.csv")])
    [(path, table, _)] = load(spark, master, _folder(spark, ("parts.csv", df)))
    return dump("parts", path, table, master.fields)


@_query("report_json", "SELECT 'cell_refinement' AS code, 'l_quantity' AS field, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 3")
def report_json(spark, sf_dir):
    """Diagnostics written as JSON lines, and read back."""
    fields = Lines.fields | {"l_quantity": Quantity}
    found = diagnostics(typed(_read(spark, sf_dir, "lineitem"), fields, LINE_KEY), Master("lines", fields, LINE_KEY))
    path = fresh_path(spark, "report")
    report(found.filter("code = 'cell_refinement'"), path)
    return spark.read.schema("code string, field string, value string").json(path).groupBy("code", "field", "value").agg(F.count("*").alias("n"))


@_query("sql_texts", """SELECT * FROM (VALUES
    ('select', 'sqlite', 'SELECT "p_partkey", "p_name", "p_size", "p_brand" FROM "part" WHERE (("p_size" > ?) AND (NOT ("p_brand" = ?))) ORDER BY "p_size" DESC, "p_partkey" LIMIT -1 OFFSET ?', '3,x,2'),
    ('select', 'postgres', 'SELECT "p_partkey", "p_name", "p_size", "p_brand" FROM "part" WHERE (("p_size" > $1) AND (NOT ("p_brand" = $2))) ORDER BY "p_size" DESC, "p_partkey" LIMIT ALL OFFSET $3', '3,x,2'),
    ('select', 'mysql', 'SELECT `p_partkey`, `p_name`, `p_size`, `p_brand` FROM `part` WHERE ((`p_size` > ?) AND (NOT (`p_brand` = ?))) ORDER BY `p_size` DESC, `p_partkey` LIMIT 18446744073709551615 OFFSET ?', '3,x,2'),
    ('count', 'sqlite', 'SELECT count(*) FROM "part" WHERE (("p_size" > ?) AND (NOT ("p_brand" = ?)))', '3,x'),
    ('create', 'sqlite', 'CREATE TABLE "part" ("p_partkey" INTEGER, "p_name" TEXT, "p_size" INTEGER, "p_brand" TEXT)', ''),
    ('insert', 'postgres', 'INSERT INTO "part" ("p_partkey", "p_name", "p_size", "p_brand") VALUES ($1, $2, $3, $4)', '')) t(kind, dialect, text, bound)""")
def sql_texts(spark, sf_dir):
    r = parts(spark, sf_dir).where(lambda c: c.p_size > 3).where(lambda c: ~(c.p_brand == "x")).order(lambda c: c.p_size.desc())
    out = [("select", d, *sqltext.select(r.offset(2), "part", dialect=d)) for d in sqltext.DIALECTS] + [("count", "sqlite", *sqltext.select(r, "part", ["count(*)"]))]
    out += [("create", "sqlite", sqltext.create_table("part", Parts.fields), []), ("insert", "postgres", sqltext.insert_into("part", Parts.fields, "postgres"), [])]
    return spark.createDataFrame([(k, d, t, ",".join(map(str, v))) for k, d, t, v in out], "kind string, dialect string, text string, bound string")


@_query("project_gate", """SELECT * FROM (VALUES ('sound', 2, 0, NULL), ('unsound', 0, 1, 'master_missing_primary')) t(project, tables, problems, code)""")
def project_gate(spark, sf_dir):
    """With a wrong declaration anywhere, no data are read."""
    base = _folder(spark, ("a.csv", "id\n1\n2"), ("b.csv", "id\n3"))
    a, b = Master("a", {"id": INT}, ("id",), [Source("csv", "a.csv")]), Master("deck.b", {"id": INT}, ("id",), [Source("csv", "b.csv")])
    out = []
    for n, project in (("sound", Project(a, b)), ("unsound", Project(a, b, Master("c", {"id": INT}, ())))):
        tables, told = project.load(spark, base)
        found = told.collect()
        out.append((n, len(tables), len(found), found[0]["code"] if found else None))
    return spark.createDataFrame(out, "project string, tables int, problems int, code string")


@_query("master_by_name", "SELECT * FROM (VALUES ('parts', (SELECT CAST(count(*) AS VARCHAR) FROM part)), ('deck.orders', (SELECT CAST(count(*) AS VARCHAR) FROM orders)), ('orders', (SELECT CAST(count(*) AS VARCHAR) FROM orders)), ('unbound', 'declined')) t(name, n)")
def master_by_name(spark, sf_dir):
    """A master's name is the relation of all its rows, with or without its namespace."""
    cards = Master("deck.orders", {"o_orderkey": LONG, "o_orderstatus": Status}, ("o_orderkey",))
    project = Project(Parts, cards, Master("unbound", {"id": INT}, ("id",)))
    project.bind("parts", _read(spark, sf_dir, "part"))
    project.bind("orders", _read(spark, sf_dir, "orders"))
    return spark.createDataFrame([(n, _outcome(lambda n=n: project.relation(n).count())) for n in ("parts", "deck.orders", "orders", "unbound")], "name string, n string")


@_query("violations_agree", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_quantity >= 10) IS NOT TRUE")
def violations_agree(spark, sf_dir):
    """The rows that fail as a predicate of a relation and as a check of rows, which are the same."""
    table = typed(_read(spark, sf_dir, "lineitem"), Lines.fields, LINE_KEY)
    by_rows = row_problems(table, Master("lines", Lines.fields, LINE_KEY, each=[lambda r: r.l_quantity >= 10])).select(*LINE_KEY)
    by_query = Relation(table, Lines.fields, LINE_KEY).violations(lambda c: c.l_quantity >= 10).select(*LINE_KEY)
    return by_rows.intersectAll(by_query).union(by_rows.exceptAll(by_query)).union(by_query.exceptAll(by_rows))


@_query("stream_checks", "SELECT code, count(*) AS n FROM (SELECT 'cell_refinement' AS code FROM events WHERE user_id % 10 = 0 UNION ALL SELECT 'duplicate_primary_key' FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k > 1) GROUP BY code")
def stream_checks(spark, sf_dir):
    """Row checks on a stream of one batch."""
    path = fresh_path(spark, "stream")
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, sf_dir)).select("user_id", "event_id")
    user = refined("User", LONG, lambda x: x % 10 != 0)
    check_stream(stream, Master("s", {"user_id": user, "event_id": Events.fields["event_id"]}, ("user_id",)), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema("code string").json(f"{path}/out/batch=*").groupBy("code").agg(F.count("*").alias("n"))


def _stream_folder(spark: SparkSession, sf_dir: str) -> str:
    """events as a folder: a stream reads folders only."""
    df = stored(_read(spark, sf_dir, "events").repartition(2), "events")
    return df.inputFiles()[0].rsplit("/", 1)[0]


@_query("enum_members", "SELECT * FROM (VALUES ('F', 'F'), ('O', 'O'), ('P', 'P')) t(member, value)")
def enum_members(spark, sf_dir):
    return spark.createDataFrame([(n, str(member(Status, n).value)) for n, _ in Status.members], "member string, value string")
