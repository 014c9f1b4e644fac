"""Line dedup by distinct-site spread.

For every line hash a HyperLogLog sketch of its sites is built by aggregation, so
a line of many rows costs a sketch and not its rows. Lines whose estimate is near
the threshold get an exact distinct count; the others are decided by the sketch.
A line that is spread over enough sites is boilerplate and goes from every
document but the one with the smallest doc_id, so that no content is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, forget, pick, pieces, stored

#: Sketches with 2 ** LG_K registers; estimates within so many standard errors of the threshold count as near.
LG_K, ERRORS = 10, 6
#: Up to so many boilerplate lines are sent to all tasks; more are joined by document.
SENT = 1 << 18
_STRIP = b" \t\r"


def _hashes(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The lines of a text, their hashes without white space at the ends, and which are not blank."""
    lines = text.split(b"\n")
    bare = [x.strip(_STRIP) for x in lines]
    hashes = np.array([xxhash.xxh64_intdigest(x, 42) for x in bare], dtype=np.uint64).view(np.int64)
    return lines, hashes, np.array([bool(x) for x in bare], dtype=bool)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in pieces(batches, "text"):
        seen = [np.unique(h[full]) for _, h, full in map(_hashes, texts)]
        owner = pa.array(np.repeat(np.arange(len(seen)), [len(x) for x in seen]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seen), pa.int64()), *(column(rows, c).take(owner) for c in ("site", "doc_id", "unnamed"))], names=["h", "site", "doc_id", "unnamed"])


def _unnamed() -> Column:
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def spread_lines(docs: DataFrame, min_sites: int) -> tuple[DataFrame, DataFrame]:
    """(h, first) of the lines on min_sites sites or more, and the lines(h, site, doc_id, unnamed) behind them.

    first is the smallest doc_id with the line; unnamed is a hash of the text of a
    document without one. A null site is no site.
    """
    seen = docs.select("doc_id", "text", F.xxhash64("source").alias("site"), F.col("source").isNull().alias("nowhere"))
    seen = seen.select("doc_id", "text", F.when(~F.col("nowhere"), F.col("site")).alias("site"), _unnamed().alias("unnamed"))
    seen = stored(seen.mapInArrow(_lines, "h long, site long, doc_id long, unnamed long"), "lines")
    sketches = seen.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sites"), F.min("doc_id").alias("first"))
    error = min_sites * ERRORS * 1.04 / 2 ** (LG_K / 2)
    about = stored(sketches.select("h", "first", F.hll_sketch_estimate("sites").alias("n")).filter(F.col("n") >= min_sites - error), "spread")
    near = about.filter(F.col("n") < min_sites + error)
    sure = about.filter(F.col("n") >= min_sites + error).select("h", "first")
    exact = seen.filter("site is not null").join(near.select("h"), "h", "left_semi").select("h", "site").distinct().groupBy("h").count()
    exact = near.join(exact.filter(F.col("count") >= min_sites), "h").select("h", "first")
    boilerplate = stored(sure.union(exact), "boilerplate")
    forget(about)
    return boilerplate, seen


def _clean(hashes: np.ndarray | None, first: np.ndarray | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text"):
            ids = column(rows, "doc_id").to_pylist()
            dropped = column(rows, "_drop").to_pylist() if hashes is None else None
            out, n_lines, n_removed = [], [], []
            nulls = column(rows, "text").is_null().to_pylist()
            for i, (text, doc) in enumerate(zip(texts, ids, strict=True)):
                lines, h, full = _hashes(text)
                if hashes is None:
                    go = np.isin(h, np.array(dropped[i] or [], dtype=np.int64))
                elif len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    go = (hashes[at] == h) & (first[at] != doc if doc is not None else True)
                else:
                    go = np.zeros(len(h), dtype=bool)
                go &= full
                n_lines.append(0 if nulls[i] else len(lines))
                n_removed.append(int(go.sum()))
                out.append(None if nulls[i] else b"\n".join(x for x, g in zip(lines, go.tolist(), strict=True) if not g) if n_removed[-1] else text)
            arrays = [pa.array(out, pa.binary()).cast(pa.string()) if n == "text" else column(rows, n) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, "n_lines", "n_removed"])

    return run


def remove_spread_lines(docs: DataFrame, *, min_sites: int = 10, sent: int = SENT, columns: tuple[str, ...] = ("doc_id", "text", "lang", "source")) -> DataFrame:
    """The named columns of docs, text without boilerplate, and n_lines, n_removed.

    docs has doc_id long, text string and source (the site). Lines are what stands
    between line feeds, compared without blanks, tabs and carriage returns at their
    ends; blank ones always stay. A null text stays null and has no lines; an empty
    one has one blank line. Of rows that repeat the first doc_id all keep the line;
    rows without a doc_id don't. An empty table gives no rows; texts may be of any
    length; other columns, whatever their names, aren't looked at.

    Up to `sent` boilerplate lines are sent to all tasks; more are joined to their
    documents, with the same result.
    """
    docs = pick(docs, *dict.fromkeys([*columns, "doc_id", "text", "source"]))
    boilerplate, seen = spread_lines(docs, min_sites)
    names = list(columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", n_lines long, n_removed long"
    if boilerplate.count() <= sent:
        table = boilerplate.toArrow().sort_by("h")
        for used in (seen, boilerplate):  # nothing below reads them
            forget(used)
        least = np.iinfo(np.int64).min
        return docs.mapInArrow(_clean(table.column("h").to_numpy(), table.column("first").fill_null(least).to_numpy(), names), schema)
    drop = seen.join(boilerplate, "h").filter("first is null or doc_id is null or first <> doc_id").groupBy("doc_id", "unnamed").agg(F.collect_set("h").alias("_drop"))
    drop = drop.select(F.col("doc_id").alias("_doc_id"), F.col("unnamed").alias("_unnamed"), "_drop")
    docs = docs.withColumn("_hash", _unnamed())
    docs = docs.join(drop, F.coalesce("doc_id", "_hash").eqNullSafe(F.coalesce("_doc_id", "_unnamed")) & docs["_hash"].eqNullSafe(drop["_unnamed"]), "left")
    return docs.drop("_hash", "_doc_id", "_unnamed").mapInArrow(_clean(None, None, names), schema)
