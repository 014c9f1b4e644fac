"""CSV with the place of every cell: its line and the byte column where its text starts.

A file is read as lines, by Spark's splittable text source. Whether a split begins
within a quoted cell, and at which line, is told by the numbers of quotes and lines
in the splits before it, which are counted first; so every split is taken apart by
itself. Only a record that goes over the end of a split is put together again from
its parts. The records are stored once, and all that follows reads them from there.

Files that some tasks can't split (compressed ones) are one split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import ship
from ..errors import SpecError, Unreadable
from ..storage import stored
from . import Raw, register

PLACES = "array<struct<line: bigint, col: int>>"
_SCHEMA = f"line long, cells array<string>, places {PLACES}, error string, part string, text binary"
_PLACE = pa.struct([("line", pa.int64()), ("col", pa.int32())])
_ARROW = pa.schema([("line", pa.int64()), ("cells", pa.list_(pa.string())), ("places", pa.list_(_PLACE)), ("error", pa.string()), ("part", pa.string()), ("text", pa.binary())])
#: Records told at once.
_HELD = 10_000

Place = tuple[int, int]


def _width(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def parse(text: str, line: int, delimiter: str) -> tuple[list[str], list[Place]]:
    """The cells of a record without its line end, and their places. Lines and columns begin at 1."""
    if '"' not in text:
        cells = text.removesuffix("\r").split(delimiter)
        col, places, step = 1, [], _width(delimiter)
        for cell in cells:
            places.append((line, col))
            col += _width(cell) + step
        return cells, places
    cells, places, at, n = [], [], 0, len(text)
    begin, col = 0, 1  # a place in this line, and its column
    end_of_line = text.find("\n") if "\n" in text else n
    while True:
        col, begin = col + _width(text[begin:at]), at
        places.append((line, col))
        if not text.startswith('"', at):
            stop = text.find(delimiter, at, end_of_line)
            cell = text[at : stop if stop >= 0 else end_of_line]
            if '"' in cell:
                raise ValueError(f"line {line}: a quote in a bare cell")
            if stop < 0:
                cells.append(cell.removesuffix("\r"))
                return cells, places
            cells.append(cell)
            at = stop + 1
            continue
        at, parts = at + 1, []
        while True:
            end = text.find('"', at)
            if end < 0:
                raise ValueError(f"line {line}: a quote isn't closed")
            parts.append(text[at:end])
            at = end + 1
            if not text.startswith('"', at):
                break
            parts.append('"')
            at += 1
        cells.append("".join(parts).replace("\r\n", "\n"))
        if at > end_of_line:
            line += text.count("\n", begin, at)
            begin, col = text.rfind("\n", 0, at) + 1, 1
            after = text.find("\n", at)
            end_of_line = after if after >= 0 else n
        if text.startswith(delimiter, at):
            at += 1
        elif text[at:end_of_line] in ("", "\r"):
            return cells, places
        else:
            raise ValueError(f"line {line}: text after a closing quote")


def records(text: str, delimiter: str) -> Iterator[tuple[int, list[str], list[Place]]]:
    """(line, cells, places) of each record of a whole text; blank lines are none."""
    held, inside = [], False
    for at, line in enumerate(text.split("\n"), 1):
        held.append(line)
        inside ^= line.count('"') % 2 == 1
        if not inside:
            if held not in ([""], ["\r"]):
                first = at - len(held) + 1
                yield first, *parse("\n".join(held), first, delimiter)
            held = []
    if held:
        raise ValueError("a quote isn't closed")


class _Splits:
    """Takes apart the lines of splits one after another; what goes over a split's end is told as parts."""

    def __init__(self, delimiter: str, begins: dict[int, tuple[int, bool]]):
        self.delimiter, self.begins = delimiter, begins
        self.block, self.line, self.inside, self.whole = -1, 1, False, True
        self.lines: list[bytes] = []
        self.out: list[list] = [[] for _ in _ARROW]

    def tell(self, *row: object) -> None:
        for column, value in zip(self.out, row, strict=True):
            column.append(value)

    def record(self, data: bytes, line: int) -> None:
        if data in (b"", b"\r"):
            return
        try:
            cells, places = parse(data.decode(), line, self.delimiter)
        except ValueError as error:  # of which UnicodeDecodeError is one
            told = str(error) if type(error) is ValueError else f"line {line}: not in UTF-8"
            self.tell(line, None, None, told, None, None)
        else:
            self.tell(line, cells, [{"line": a, "col": b} for a, b in places], None, None, None)

    def leave(self) -> None:
        """The end of a split."""
        if self.lines:
            part = "begin" if self.whole else "more"
            data, first = b"\n".join(self.lines), self.line - len(self.lines)
            self.tell(first, None, None, None, part, data)
            self.lines = []

    def add(self, block: int, data: bytes) -> None:
        if block != self.block:
            self.leave()
            self.block = block
            self.line, self.inside = self.begins.get(block, (1, False))
            self.whole = not self.inside
        self.lines.append(data)
        self.line += 1
        if data.count(b'"') % 2:
            self.inside = not self.inside
        if not self.inside:
            text, first = b"\n".join(self.lines), self.line - len(self.lines)
            if self.whole:
                self.record(text, first)
            else:
                self.tell(first, None, None, None, "more", text)
            self.lines, self.whole = [], True

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.out, _ARROW, strict=True)], schema=_ARROW)
        self.out = [[] for _ in _ARROW]
        return out


def _taken_apart(delimiter: str, begins: dict[int, tuple[int, bool]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = _Splits(delimiter, begins)
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                splits.add(block, data)
                if len(splits.out[0]) >= _HELD:
                    yield splits.batch()
        splits.leave()
        yield splits.batch()

    return run


def _put_together(delimiter: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = _Splits(delimiter, {})
        for batch in batches:
            for line, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                splits.record(data, line)
        yield splits.batch()

    return run


def _begins(lines: DataFrame) -> dict[int, tuple[int, bool]]:
    """The first line of each split, and whether it begins within a quoted cell; a row for each split comes to the driver."""
    quotes = F.octet_length("value") - F.octet_length(F.expr("""replace(string(value), '"', '')"""))
    seen = lines.groupBy("block").agg(F.count("*").alias("n"), F.sum(quotes.cast("long")).alias("quotes")).orderBy("block").collect()
    out, line, inside = {}, 1, False
    for row in seen:
        out[row["block"]] = (line, inside)
        line, inside = line + row["n"], inside ^ bool(row["quotes"] % 2)
    if inside:
        raise SpecError("source_unreadable", "a quote isn't closed")
    return out


def _is_file(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.exists(path) and store.getFileStatus(path).isFile()


def _failure(error: Exception) -> str:
    return str(getattr(error, "desc", None) or error).strip().split("\n")[0]


def read_csv(spark: SparkSession, path: str, options: dict[str, object]) -> Raw:
    """Header and raw rows. An empty cell is the empty string; a short row has fewer cells.

    A source that can't be read, is malformed or not in UTF-8, has no header or one
    that repeats a name, or has rows longer than the header raises Unreadable with
    all that is wrong with it up to the place where it is malformed.
    """
    delimiter = options.get("delimiter", ",")
    if len(delimiter) != 1:
        raise SpecError("source_unreadable", "delimiter must be a single character")
    if delimiter in '"\r\n':
        raise SpecError("source_unreadable", "the delimiter may not be a quote or a line end")
    ship(spark)
    try:
        if not _is_file(spark, path):
            raise SpecError("source_unreadable", "no such file")
        lines = spark.read.option("lineSep", "\n").text(re.sub(r"([\[\]{}*?\\])", r"\\\1", path))
        lines = lines.select(F.input_file_block_start().alias("block"), F.col("value").cast("binary").alias("value"))
        begins = _begins(lines) if lines.rdd.getNumPartitions() > 1 else {}
        found = stored(lines.mapInArrow(_taken_apart(delimiter, begins), _SCHEMA), "csv")
        if begins:
            over = found.filter("part is not null")
            start = F.last(F.when(F.col("part") == "begin", F.col("line")), ignorenulls=True).over(Window.orderBy("line"))
            whole = over.withColumn("start", start).groupBy("start").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("all"))
            joined = F.aggregate("all.text", F.lit(b""), lambda a, x: F.concat(a, F.when(F.length(a) > 0, F.lit(b"\n")).otherwise(F.lit(b"")), x))
            parts = whole.select(F.col("start").alias("line"), joined.alias("text")).mapInArrow(_put_together(delimiter), _SCHEMA)
            found = found.filter("part is null").union(parts)
        elif (open_ := found.filter("part is not null").agg(F.min("line").alias("l")).first()["l"]) is not None:
            raise SpecError("source_unreadable", f"line {open_}: a quote isn't closed", open_)
        first = found.agg(F.min_by("cells", F.when(F.col("error").isNull(), F.col("line"))).alias("header"), F.min(F.when(F.col("error").isNotNull(), F.struct("line", "error"))).alias("error")).first()
    except SpecError as error:
        raise Unreadable(_told(spark, [error])) from error
    except (PySparkException, OSError) as error:
        raise Unreadable(_told(spark, [SpecError("source_unreadable", _failure(error))])) from error
    header, error, wrong = first["header"], first["error"], []
    if error is not None:
        wrong.append(SpecError("source_unreadable", error["error"], error["line"]))
    if header is None:
        raise Unreadable(_told(spark, wrong or [SpecError("source_unreadable", "the source has no header row")]))
    twice = next((h for i, h in enumerate(header) if h in header[:i]), None)
    if twice is not None:
        wrong.append(SpecError("source_unreadable", f'duplicate column "{twice}"'))
    long = found.filter(F.size("cells") > len(header))
    if error is not None:
        long = long.filter(F.col("line") < error["line"])
    if wrong or not long.isEmpty():
        rows = long.select(F.lit("source_unreadable").alias("code"), F.col("line").alias("row"), F.format_string("row %d has more fields than the header", "line").alias("detail"))
        raise Unreadable(reduce(DataFrame.union, [_told(spark, wrong), rows]))
    head = found.agg(F.min("line").alias("l")).first()["l"]
    return Raw(header, found.filter(F.col("line") != head).select("line", "cells", "places"))


def _told(spark: SparkSession, wrong: list[SpecError]) -> DataFrame:
    return spark.createDataFrame([(e.code, e.row, e.detail) for e in wrong], "code string, row long, detail string")


def fast_rows(spark: SparkSession, path: str, header: list[str], delimiter: str = ",") -> DataFrame:
    """The columns of a bulk file as text, without places; short rows can't be told from empty cells."""
    schema = ", ".join(f"`{h}` string" for h in header)
    df = spark.read.schema(schema).option("header", True).option("sep", delimiter).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in header])


register("csv", read_csv, {"delimiter": str})
