"""Relations, sources, coercion and validation on small tables, each check with a failing twin."""

import csv
import io
import math
import random
from decimal import Decimal

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from relcheck.errors import SpecError, Undecidable, Unreadable
from relcheck.functions import collections as fc
from relcheck.functions import mathlib as fm
from relcheck.functions import scalars as fs
from relcheck.operators.coerce import coerced
from relcheck.operators.master import Master, Project, dump, duplicates, failed_table_checks, load, report, typed
from relcheck.plans import sqltext
from relcheck.plans.diagram import explained, layout
from relcheck.plans.relation import Relation
from relcheck.sources import Source, check_options, confined
from relcheck.sources.csv import fast_rows, read_csv, records
from relcheck.streaming import check_stream
from relcheck.types import BOOL, BYTE, DATETIME, INT, INTEGERS, LONG, NINT, STRING, ULONG, alias, enum, member, nullable, refined

Rarity = enum("Rarity", ["common", "rare", "legend"])
Level = refined("Level", INT, lambda x: x > 0)


def cards(spark, rows=((1, 5), (2, 30), (3, 20)), **types):
    fields = {"id": INT, "power": INT} | types
    return Relation(spark.createDataFrame(list(rows), ", ".join(f"{n} {t.spark}" for n, t in fields.items())), fields, ("id",))


def test_relation_values(spark):
    r = cards(spark)
    assert [x.id for x in r.order(lambda c: c.power.desc()).to_list()] == [2, 3, 1]
    assert [x.power for x in r.where(lambda c: c.power > 10).order(lambda c: c.power.asc()).limit(1).to_list()] == [20]
    assert (r.count(), r.sum("power"), r.min("power"), r.max("power")) == (3, 55, 5, 30)
    empty = r.where(lambda c: c.power > 99)
    assert (empty.count(), empty.sum("power"), empty.min("power")) == (0, 0, None)
    assert [x.id for x in r.limit(1).offset(1).to_list()] == [x.id for x in r.offset(1).limit(1).to_list()] == [2]
    assert len(r.limit(2**40).to_list()) == 3 and r.offset(2**40).to_list() == []


def test_declined(spark):
    r = cards(spark)
    for query in (
        lambda: r.limit(2).where(lambda c: c.power > 1).to_list(),
        lambda: r.limit(2).order(lambda c: c.power.asc()).to_list(),
        lambda: r.limit(2).count(),
        lambda: r.offset(1).sum("power"),
        lambda: r.where(lambda c: c.power + 1 > 2).count(),
        lambda: r.where(lambda c: True).count(),
        lambda: r.where(lambda c: c.power > r).count(),
        lambda: cards(spark, power=alias("Own", INT, ("lt",))).where(lambda c: c.power < 3).count(),
        lambda: cards(spark, power=alias("Own", INT, ("lt",))).order(lambda c: c.power.asc()).to_list(),
        lambda: cards(spark, power=alias("Own", INT, ("add",))).sum("power"),
        lambda: cards(spark, [(1, None), (2, 3)]).min("power"),
        lambda: cards(spark, [(1, None)]).max("power"),
        lambda: cards(spark, [(1, None), (2, 3)]).to_list(),
        lambda: BYTE.admit(300),
        lambda: Level.admit(-1),
        lambda: refined("Near", INT, lambda x: F.abs(x) < 3).admit(-4),
        lambda: r.where(lambda c: c.power > r.where(lambda d: d.id == c.id).count()).count(),
        lambda: r.where(lambda c: r.where(lambda d: c.id > 1).count() > 0).count(),
        lambda: cards(spark, power=nullable(INT)).min("power"),
    ):
        with pytest.raises(Undecidable):
            query()
    assert cards(spark, power=alias("Own", INT, ("lt",))).order(lambda c: c.power.asc()).count() == 3
    assert cards(spark, [(1, None), (2, 3)]).max("power") == 3
    assert (Level.admit(4), refined("Near", INT, lambda x: F.abs(x) < 3).admit(-2), nullable(INT).admit(None)) == (4, -2, None)
    assert r.where(lambda c: c.power > r.min("power")).count() == 2
    # Plans decline as they run.
    gaps = cards(spark, [(1, 5), (2, None), (3, 7)])
    assert gaps.max_df("power").first()[0] == 7 and gaps.limit(1).rows().count() == 1
    for plan in (lambda: gaps.min_df("power"), lambda: gaps.rows(), lambda: gaps.limit(2).rows(), lambda: cards(spark, [(1, None)]).max_df("power")):
        with pytest.raises(PySparkException, match="undecidable"):
            plan().collect()
    for query in (lambda c: c.power == "x", lambda c: c.ok < True, lambda c: c.power < None, lambda c: c.power and c.power):
        with pytest.raises(TypeError):
            cards(spark, [(1, 2, True)], ok=BOOL).where(query)
            bool(cards(spark)._pick("power") == 1)


@pytest.mark.parametrize("name", INTEGERS)
def test_summable(name):
    assert INTEGERS[name].summable == (name not in ("nint", "nuint", "ulong"))


def test_enum_and_nullable(spark):
    assert [m[1] for m in Rarity.members] == [0, 1, 2]
    r = cards(spark, [(1, 50, 0), (2, 150, 1), (3, 200, 2)], rarity=Rarity)
    assert r.where(lambda c: c.rarity == member(Rarity, "legend")).count() == 1
    assert r.max("rarity") == member(Rarity, "legend")
    with pytest.raises(TypeError):
        r.where(lambda c: c.rarity == 2)
    n = cards(spark, [(1, None), (2, 3)], power=nullable(INT))
    assert n.where(lambda c: c.power == None).count() == 1 and len(n.to_list()) == 2  # noqa: E711


def test_violations_are_not_definitely_true(spark):
    r = cards(spark, [(1, 30), (2, None), (3, 5)])
    assert [x.id for x in r.violations(lambda c: c.power > 10).collect()] == [2, 3]
    assert r.where(lambda c: c.power > 10).count() == 1


def test_random_predicates(spark):
    rows = [(i, random.Random(i).choice([None, 1, 2, 3]), random.Random(-i).randint(0, 3)) for i in range(40)]
    r = cards(spark, rows, cost=INT)
    c = duckdb.connect()
    c.sql("create table t(id int, power int, cost int)")
    c.executemany("insert into t values (?, ?, ?)", rows)
    rng = random.Random(3)

    def grow(depth):
        if depth == 0:
            a, b, n = *rng.sample(["power", "cost"], 2), rng.randint(0, 3)
            return rng.choice([lambda c: c[a] < n, lambda c: c[a] == c[b], lambda c: c[a] != n, lambda c: c[a] >= c[b]])
        p, q = grow(depth - 1), grow(depth - 1)
        return rng.choice([lambda c: p(c) & q(c), lambda c: p(c) | q(c), lambda c: ~p(c)])

    for _ in range(12):
        found = r.where(grow(3))
        sql, values = sqltext.select(found, "t")
        assert [x.id for x in found.filtered().orderBy("id").collect()] == [x[0] for x in c.execute(sql, values).fetchall()]


def test_sql_text(spark):
    r = cards(spark).where(lambda c: c.power > 3).where(lambda c: ~(c.id == 1)).order(lambda c: c.power.desc())
    assert sqltext.select(r.offset(2), "t", dialect="postgres") == ('SELECT "id", "power" FROM "t" WHERE (("power" > $1) AND (NOT ("id" = $2))) ORDER BY "power" DESC, "id" LIMIT ALL OFFSET $3', [3, 1, 2])
    assert sqltext.select(r, "t", ["count(*)"], "mysql")[0] == "SELECT count(*) FROM `t` WHERE ((`power` > ?) AND (NOT (`id` = ?)))"
    assert sqltext.create_table('a"b', {"id": INT, "name": STRING}) == 'CREATE TABLE "a""b" ("id" INTEGER, "name" TEXT)'
    assert sqltext.insert_into("t", {"id": INT, "name": STRING}) == 'INSERT INTO "t" ("id", "name") VALUES (?, ?)'


def test_csv_records():
    assert list(records("key,word\n1,Lantern\n\n2,\n3", ","))[1:] == [(2, ["1", "Lantern"], [(2, 1), (2, 3)]), (4, ["2", ""], [(4, 1), (4, 3)]), (5, ["3"], [(5, 1)])]
    assert list(records('a,b\r\n"x\r\ny","q""z"\r\né,1', ",")) == [(1, ["a", "b"], [(1, 1), (1, 3)]), (2, ["x\ny", 'q"z'], [(2, 1), (3, 4)]), (4, ["é", "1"], [(4, 1), (4, 4)])]
    for broken in ('"open', '"a"b', 'a"b', 'a"b\nc"d'):
        with pytest.raises(ValueError):
            list(records(broken, ","))
    wide = ",".join('"x"' for _ in range(50_000))
    assert len(list(records(wide, ","))[0][1]) == 50_000


@given(st.lists(st.lists(st.text('ab",\n\r é', max_size=6), min_size=1, max_size=4), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_csv_round_trip(rows):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
    want = [[c.replace("\r\n", "\n") for c in r] for r in rows]
    found = list(records(out.getvalue(), ","))
    assert [cells for _, cells, _ in found] == want
    lines = out.getvalue().split("\n")
    for _, _, places in found:
        assert all(lines[line - 1].encode()[col - 1 :].startswith(b'"') for line, col in places)


def test_csv_splits(spark, tmp_path):
    """A file in many splits, with records over the ends of several, is read as in one."""
    rng = random.Random(5)
    text = "id,word\n" + "".join(f'{i},{rng.choice(["plain", "", chr(34) + "q, " + chr(10) * rng.randint(0, 40) + "é" * rng.randint(0, 30) + chr(34)])}\n' + "\n" * rng.randint(0, 1) for i in range(90))
    (tmp_path / "s.csv").write_text(text)
    want = [(line, cells, places) for line, cells, places in records(text, ",")][1:]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = read_csv(spark, str(tmp_path / "s.csv"), {})
        (tmp_path / "open.csv").write_text(text + '"open')
        with pytest.raises(Unreadable):
            read_csv(spark, str(tmp_path / "open.csv"), {})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = [(r.line, r.cells, [tuple(p) for p in r.places]) for r in raw.rows.orderBy("line").collect()]
    assert raw.header == ["id", "word"] and got == want


def lamp(fields=None, **more):
    return Master("Lamp", fields or {"id": INT, "word": STRING, "watts": Level}, ("id",), [Source("csv", "s.csv")], **more)


def told(spark, tmp_path, master, text):
    (tmp_path / "s.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
    [(_, table, found)] = load(spark, master, str(tmp_path))
    return table, sorted(((r.code, r.row, r.col, r.field, r.key, r.first) for r in found.collect()), key=repr)


def text_of(name, path, table, fields):
    return [r.line for r in dump(name, path, table, fields).collect()]


def test_load(spark, tmp_path):
    table, found = told(spark, tmp_path, lamp(), "id,word,watts\n4,desk,60\n9,hall,25\n")
    assert found == [] and text_of("Lamp", "s.csv", table, lamp().fields) == ["Lamp <- s.csv", "4 | desk | 60", "9 | hall | 25"]
    table, found = told(spark, tmp_path, lamp(), "id,word,watts\nno,hall,25")
    assert found == [("cell_type_mismatch", 2, 1, "id", None, None)] and "<unevaluated> | hall" in text_of("Lamp", "s.csv", table, lamp().fields)[1]
    assert told(spark, tmp_path, lamp(), "id,word,watts\n4,attic,-3")[1] == [("cell_refinement", 2, 9, "watts", None, None)]
    assert told(spark, tmp_path, lamp(), 'word,id,watts\n"two\nlines",4,-3')[1] == [("cell_refinement", 3, 10, "watts", None, None)]
    assert told(spark, tmp_path, lamp(), "watts,extra,id,word\n3,x,1,a")[1] == []
    assert told(spark, tmp_path, lamp(), "id,word\n1,a")[1] == [("missing_column", None, None, None, None, None)]
    assert told(spark, tmp_path, lamp({"id": INT, "word": STRING}), "id,word\n4,desk\n9,hall\n4,attic")[1] == [("duplicate_primary_key", 4, 1, None, "id=4", 2)]
    assert told(spark, tmp_path, lamp({"id": INT, "word": STRING}), "id,word\n2\n")[1] == [("cell_type_mismatch", 2, None, "word", None, None)]
    assert told(spark, tmp_path, lamp({"id": INT, "at": DATETIME}), "id,at\n2,x\n")[1] == [("unsupported_field_type", None, None, None, None, None)]
    for text, row in (("id,id\n1,1", None), ("", None), ("id,word,watts\n1,a,2,EXTRA", 2), (b"id,word,watts\n1,\xff,2", 2)):
        assert told(spark, tmp_path, lamp(), text) == (None, [("source_unreadable", row, None, None, None, None)])
    (tmp_path / "a[1]*.csv").write_text("id\n7\n")
    (tmp_path / "folder").mkdir()
    found = load(spark, Master("Lamp", {"id": INT}, ("id",), [Source("csv", p) for p in ("a[1]*.csv", "folder", "none.csv")]), str(tmp_path))
    assert [t is not None for _, t, _ in found] == [True, False, False] and found[0][1].first()[0] == 7
    (tmp_path / "s.csv").write_text("id,word\n1,\n")
    assert [tuple(r) for r in fast_rows(spark, str(tmp_path / "s.csv"), ["id", "word"]).collect()] == [("1", "")]


def test_row_and_table_checks(spark, tmp_path):
    costs = {"id": INT, "price": INT, "watts": INT}
    each = lamp(costs, each=[lambda r: r.watts >= r.price, lambda r: r.id > 0])
    assert told(spark, tmp_path, each, "id,price,watts\n1,10,30\n2,50,20")[1] == [("row_validation_failed", 3, None, None, None, None)]
    assert told(spark, tmp_path, each, "id,price\n1,10")[1] == [("missing_column", None, None, None, None, None)]
    over = lamp({"id": INT, "price": INT}, each=[lambda r: fs.div(F.lit(100), r.price) >= 0])
    assert told(spark, tmp_path, over, "id,price\n1,5\n2,0")[1] == [("row_validation_failed", 3, None, None, None, None)]
    non_zero = refined("NonZero", INT, lambda x: x != 0)
    assert told(spark, tmp_path, lamp({"id": non_zero}, each=[lambda r: fs.div(F.lit(100), r.id) > 0]), "id\n5\n0")[1] == [("cell_refinement", 3, 1, "id", None, None)]
    for n, codes in ((3, []), (2, ["table_validation_failed"])):
        assert [x[0] for x in told(spark, tmp_path, lamp({"id": INT}, all=[lambda r, n=n: r.count() < n]), "id\n1\n2")[1]] == codes
    table = typed(cards(spark).df, {"id": INT, "power": INT}, ("id",))
    asked = []
    checks = [lambda r: r.limit(1).count() == 1, lambda r: asked.append(1) or (r.sum("power") == 55 and r.where(lambda c: c.power > 5).min("id") == 2), lambda r: r.count() == 3, lambda r: r.nothing, lambda r: 1 // (r.count() - 3) == 0]
    assert failed_table_checks(table, Master("C", {"id": INT, "power": INT}, ("id",), all=checks)) == [0, 3, 4] and len(asked) == 3
    report(load(spark, over, str(tmp_path))[0][2], str(tmp_path / "out"))
    report(load(spark, over, str(tmp_path))[0][2], str(tmp_path / "text"), "text")


def test_duplicates_of_tied_rows(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (1, 2, 7), (2, 1, 8), (None, 1, 9), (None, 1, 9)], "k int, r int, x int")
    fields = {"k": INT, "r": INT, "x": INT}
    assert sorted(r._row for r in duplicates(typed(df, fields, ("r",)), ("k",), fields).collect()) == [1, 2]


def test_declarations():
    assert [e.code for e in Master("M", {}, ()).check()] == ["master_missing_row", "master_missing_primary"]
    assert [e.code for e in Master("M", {"a": INT}, ("b", "b")).check()] == ["master_duplicate_primary_key", "master_primary_unknown_field", "master_primary_unknown_field"]
    project = Project(Master("a.M", {"a": INT}, ("a",)), Master("b.M", {"a": INT}, ("a",)), Master("b.N", {"a": INT}, ("a",)))
    assert project.check() == [] and project["N"].name == "b.N" and project["a.M"].name == "a.M"
    with pytest.raises(KeyError):
        project["M"]
    for path in ("/etc/x", "../x", "a/../../x", "c:x", "s3://x"):
        with pytest.raises(SpecError):
            confined("base", path)
    assert confined("base/", "a/b.csv") == "base/a/b.csv"
    assert [e.code for e in check_options(Source("csv", "x", (("delimiter", 1), ("delimiter", ";"), ("other", "x"))))] == ["option_type_mismatch", "duplicate_option", "unknown_option"]


def test_coercion(spark):
    def one(text, type):
        v = spark.createDataFrame([(text,)], "t string").select(coerced(F.col("t"), type)).first()[0]
        return v if v is None or isinstance(v, bool | str) else int(v)

    wide = "9" * 38
    for text, type, value in (("255", BYTE, 255), ("300", BYTE, None), ("-1", BYTE, None), ("99999999999", INT, None), ("99999999999", NINT, 99999999999), (wide, NINT, int(wide)), (wide + "9", NINT, None), ("18446744073709551615", ULONG, 2**64 - 1), (" 1", INT, None), ("12\n", INT, None), ("\n12", INT, None), ("1_0", INT, None), ("+7", INT, 7), ("000" + "0" * 40 + "12", INT, 12), ("maybe", BOOL, None), ("true", BOOL, True), ("rare", Rarity, 1), ("Rare", Rarity, None), ("", STRING, ""), (None, LONG, None)):
        assert one(text, type) == value, (text, type.name)


def test_functions(spark):
    def value(c):
        return spark.range(1).select(c.alias("v")).first().v

    i = lambda x: F.lit(x).cast("bigint")
    assert [int(value(fs.div(i(-7), i(2)))), int(value(fs.rem(i(-7), i(2)))), value(fs.div(i(1), i(0))), value(fs.rem(i(1), i(0)))] == [-3, -1, None, None]
    assert [int(value(fs.shl(i(1), i(100)))), value(fs.shl(i(1), i(127))), value(fs.shl(i(1), i(-1))), value(fs.shr(i(-5), i(1))), value(fs.shr(i(-5), i(99)))] == [2**100, None, None, -3, -1]
    assert value(fs.mul(F.lit(str(10**37)).cast("decimal(38,0)"), i(100))) is None
    assert [tuple(value(fs.at(F.lit("héy"), i(k)))) for k in (1, 3, -1)] == [("é", None), (None, "index out of range"), (None, "index out of range")]
    assert [tuple(value(fs.slice_(F.lit("héy"), i(a), i(b)))) for a, b in ((0, 2), (2, 1))] == [("hé", None), (None, "index out of range")]
    assert value(fs.chars(F.lit(""))) == [] and value(fs.bytes_(F.lit("é"))) == [195, 169] and value(fs.bytes_(F.lit(""))) == []
    assert fs.parse_duration("3w4d5h6m7s8ms") == 2178367008 and fs.parse_duration("5ms") == 5
    assert [value(fs.duration_text(i(x))) for x in (2178367008, 0, -61000)] == ["3w4d5h6m7s8ms", "0ms", "-1m1s"]
    assert fs.parse_datetime("D1970-01-01T01:00:00.001+01:00") == 1
    for bad in ("", "5", "1s1h", "-"):
        with pytest.raises(ValueError):
            fs.parse_duration(bad)
    with pytest.raises(ValueError):
        fs.parse_datetime("D1970-01-01T00:00:00.1Z")
    assert value(fc.range_list(i(5), i(4))) == [] and value(fc.range_list(i(0), i(4), i(0))) is None
    assert value(fc.range_literal(i(9), i(7))) == [9, 8, 7] and value(fc.range_literal(i(9), i(7), closed=False)) == [8, 7] and value(fc.range_literal(i(5), i(5), closed=False)) == []
    xs = F.array(i(3), i(1))
    assert value(fc.list_pop(xs)) == 1 and value(fc.list_pop(F.array().cast("array<int>"))) is None and value(fc.list_set(xs, i(5), i(0))) is None
    assert value(fc.map_set(F.create_map(F.lit("a"), i(1)), F.lit("b"), i(2))) == {"a": 1, "b": 2}
    assert value(fm.max2(i(1), F.lit(None).cast("bigint"))) is None
    assert [int(value(x)) for x in (fm.gcd(i(-12), i(18)), fm.gcd(i(0), i(0)), fm.lcm(i(4), i(6)), fm.lcm(i(0), i(6)), fm.pow_(i(2), i(10)), fm.pow_(i(2), i(0)))] == [6, 0, 12, 0, 1024, 1]


def test_stream(spark, tmp_path):
    checks = Master("S", {"id": INT, "power": Level}, ("id",))
    stream = lambda: check_stream(spark.readStream.schema("id int, power int").parquet(str(tmp_path / "in")), checks, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    codes = lambda n: sorted(r.code for r in spark.read.json(str(tmp_path / "out" / f"batch={n}")).collect())
    spark.createDataFrame([(1, 5), (1, -5)], "id int, power int").write.parquet(str(tmp_path / "in"))
    stream()
    assert codes(0) == ["cell_refinement", "duplicate_primary_key"]
    spark.createDataFrame([(1, 5), (2, 5)], "id int, power int").write.mode("append").parquet(str(tmp_path / "in"))
    stream()
    assert codes(1) == ["duplicate_primary_key"]


def test_wide_integers(spark):
    r = random.Random(3)
    most = 10**38 - 1

    def number():
        return r.choice([1, -1]) * r.choice([r.randrange(10), 10 ** r.randrange(39) - 1, r.randrange(2**62, 2**64), r.randrange(10 ** r.randrange(1, 39)), most, 2 ** r.randrange(126)])

    rows = [(Decimal(number()), Decimal(number()), r.choice([0, 1, 62, 63, 64, 126, 127, 200, -1])) for _ in range(400)]
    df = spark.createDataFrame(rows, "a decimal(38,0), b decimal(38,0), n int")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    fit = lambda v: v if v is not None and abs(v) <= most else None
    quotient = lambda x, y: abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1) if y else None
    rules = {
        "div": (fs.div(a, b), lambda x, y, k: fit(quotient(x, y))),
        "rem": (fs.rem(a, b), lambda x, y, k: x - quotient(x, y) * y if y else None),
        "and": (fs.band(a, b), lambda x, y, k: fit(x & y)),
        "or": (fs.bor(a, b), lambda x, y, k: fit(x | y)),
        "xor": (fs.bxor(a, b), lambda x, y, k: fit(x ^ y)),
        "shr": (fs.shr(a, n), lambda x, y, k: x >> k if k >= 0 else None),
        "neg": (fs.neg(a), lambda x, y, k: -x),
        "abs": (fm.abs_(a), lambda x, y, k: abs(x)),
        "gcd": (fm.gcd(a, b), lambda x, y, k: math.gcd(x, y)),
        "lcm": (fm.lcm(a, b), lambda x, y, k: fit(math.lcm(x, y))),
    }
    for row in df.select("*", *[c.alias(name) for name, (c, _) in rules.items()]).collect():
        for name, (_, rule) in rules.items():
            got = None if row[name] is None else int(row[name])
            assert got == rule(int(row.a), int(row.b), row.n), (name, row)


def test_diagrams(spark):
    fields = {"id": INT, "n": INT, "low": INT, "s": STRING, "maybe": nullable(INT)}
    df = spark.createDataFrame([(1, 70000, 5, "é", None), (2, None, 5, "é", 3)], "id int, n int, low int, s string, maybe int")
    told = lambda f: [x.diagram for x in explained(Relation(df, fields, ("id",)), f).collect()]
    drawn = lambda *lines: "\n".join(lines)
    # Two values share a row if they don't touch; a gap and what depends on it aren't drawn.
    assert told(lambda c: c.n < c.low) == [drawn("n < low", "^ ^ ^", "| | 5", "| false", "70000"), drawn("n < low", "    ^", "    5")]
    assert told(lambda c: (c.low == 4) | (c.s == "x"))[0] == drawn('low == 4 || s == "x"', "^   ^    ^  ^ ^", "5   |    |  | false", '    |    |  "é"', "    |    false", "    false")
    assert told(lambda c: ~((c.low >= 1) & (c.low <= 9)))[0] == drawn("!(low >= 1 && low <= 9)", "^ ^   ^    ^  ^   ^", "| 5   true |  5   true", "false      true")
    assert told(lambda c: (c.maybe != None) & (c.low > 1)) == [drawn("maybe != null && low > 1", "^     ^       ^  ^   ^", "null  false   |  5   true", "              false")]  # noqa: E711
    assert told(lambda c: ((c.low > 9) | (c.low < 1)) & (c.low == 5))[0].splitlines()[0] == "(low > 9 || low < 1) && low == 5"
    assert layout("x", [0], [None]) == "x"
    with pytest.raises(Undecidable):
        told(lambda c: c.s + 1)
