"""Token counts: a separator scan of flat, unindexed token files.

A stream is one flat file: token ids of a fixed width, documents one after
another, each closed by a separator id. It is cut into blocks anywhere. Each block
is scanned by itself with one vectorised comparison; an exclusive prefix scan over
the blocks' summaries (tokens, separators, end of the last document) then tells
each block which document it begins in and where that began. The prefix scan runs
in two levels, so no task holds more than a group of summaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import ship
from .shared import column, pick, pieces, stored
from .tokens import Encoder, tokenizer_path

#: Summaries in a group of the prefix scan.
GROUP = 4096


def _scan(separator: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, ends = [], []
            for data in column(batch, "payload"):
                ids = np.frombuffer(data.as_buffer(), dtype=dtype) if data.is_valid else np.empty(0, dtype)
                size.append(len(ids))
                ends.append(np.flatnonzero(ids == separator).astype(np.int32))
            lists = pa.ListArray.from_arrays(np.cumsum([0] + [len(e) for e in ends]).astype(np.int32), pa.array(np.concatenate(ends) if ends else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([column(batch, "stream"), column(batch, "block"), pa.array(size, pa.int64()), lists], names=["stream", "block", "n", "ends"])

    return run


def _before(summary: DataFrame, name: str, value: str, how) -> DataFrame:
    """Adds name: the exclusive prefix of value over a stream's blocks, by groups of blocks."""
    inner = Window.partitionBy("stream", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("stream").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    totals = summary.groupBy("stream", "group").agg(how(value).alias("_all"))
    totals = totals.select("stream", "group", how("_all").over(outer).alias("_groups"))
    joined = summary.withColumn("_own", how(value).over(inner)).join(totals, ["stream", "group"])
    sums = F.coalesce("_own", F.lit(0)) + F.coalesce("_groups", F.lit(0))
    return joined.withColumn(name, sums if how is F.sum else F.coalesce(F.greatest("_own", "_groups"), F.lit(0))).drop("_own", "_groups")


def token_counts(blocks: DataFrame, separator: int, dtype: str = "<u2") -> DataFrame:
    """(stream, ordinal, start, n_tokens, closed) for each document in blocks(stream, block, payload).

    blocks: a stream's bytes are its payloads in the order of block; payloads hold
    whole ids, and may be empty or null. Two separators in a row enclose a document
    of no tokens. Tokens after a stream's last separator are a last document with
    closed false. n_tokens leaves the separator out.
    """
    summary = pick(blocks, "stream", "block", "payload").mapInArrow(_scan(separator, dtype), "stream long, block long, n long, ends array<int>")
    summary = stored(summary.withColumn("group", F.floor(F.col("block") / GROUP)), "blocks").withColumn("k", F.size("ends").cast("long"))
    light = summary.select("stream", "group", "block", "n", "k", F.try_element_at("ends", F.lit(-1)).alias("last"))
    light = _before(_before(light, "start", "n", F.sum), "documents", "k", F.sum)
    light = light.withColumn("end", F.col("start") + F.col("last") + 1)
    light = stored(_before(light, "open", "end", F.max).select("stream", "block", "n", "start", "documents", "open", "end"), "prefix")

    own = summary.select("stream", "block", "ends").filter("size(ends) > 0").join(light.select("stream", "block", "start", "documents", "open"), ["stream", "block"])
    ends = F.transform("ends", lambda e: e + F.col("start"))
    begins = F.concat(F.array("open"), F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda e: e + F.col("start") + 1))
    own = own.select("stream", "documents", F.posexplode(F.arrays_zip(begins.alias("begin"), ends.alias("end"))).alias("i", "span"))
    closed = own.select("stream", (F.col("documents") + F.col("i")).alias("ordinal"), F.col("span.begin").alias("start"), (F.col("span.end") - F.col("span.begin")).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = light.groupBy("stream").agg(F.max(F.col("start") + F.col("n")).alias("all"), F.coalesce(F.max("end"), F.lit(0)).alias("start"), F.max(F.col("documents")).alias("d"), F.max_by(F.col("end").isNotNull().cast("int"), "block").alias("x"))
    counts = summary.groupBy("stream").agg(F.sum("k").alias("ordinal"))
    tails = tails.filter("all > start").join(counts, "stream").select("stream", "ordinal", "start", (F.col("all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(tails)


def _open(path: str):
    """A file to seek in, by a path as Spark tells it."""
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def read_flat(spark: SparkSession, path: str, block_bytes: int = 1 << 17, width: int = 2, range_bytes: int = 1 << 26) -> DataFrame:
    """Blocks of raw token files: a stream for each file, in the order of their names' hashes.

    Files, of any length, are read by ranges of about range_bytes, and a task holds
    no more than a block of one. width is that of an id in bytes, and ids lie whole
    in blocks; bytes at a range's end that are no whole id are an error. Only from a
    store that Spark reads but pyarrow.fs doesn't, each file is read as a whole by
    one task, and files have 2 GB at most.
    """
    if block_bytes <= 0 or block_bytes % width:
        raise ValueError(f"blocks of {block_bytes} bytes don't hold whole ids of {width}")
    per = max(1, range_bytes // block_bytes)

    def told(stream: int, block: int, data: bytes) -> pa.RecordBatch:
        if len(data) % width:
            raise ValueError(f"block {block} of {len(data)} bytes doesn't hold whole ids of {width}")
        return pa.RecordBatch.from_pylist([{"stream": stream, "block": block, "payload": data}])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as file:
                    file.seek(row["first"] * block_bytes)
                    for block in range(row["first"], min(row["first"] + per, -(-row["length"] // block_bytes))):
                        size = min(block_bytes, row["length"] - block * block_bytes)
                        data = file.read(size)
                        if len(data) != size:
                            raise ValueError(f"{row['path']} ends before byte {row['length']}")
                        yield told(row["stream"], block, data)

    def cut_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, data in zip(column(batch, "stream").to_pylist(), column(batch, "content"), strict=True):
                data = data.as_buffer()
                for i in range(0, data.size, block_bytes):
                    yield told(stream, i // block_bytes, data.slice(i, min(block_bytes, data.size - i)).to_pybytes())

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("stream"), "path", "length", "content").filter("length > 0")
    some = files.select("path").first()
    try:
        if some:
            _open(some["path"]).close()
    except (pa.ArrowException, OSError, ValueError):
        return files.select("stream", "content").mapInArrow(cut_whole, "stream long, block long, payload binary")
    # Only names and lengths are read by Spark, not the content.
    ranges = files.select("stream", "path", "length").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes), F.lit(per).cast("long"))))
    ranges = ranges.repartition(max(8, spark.sparkContext.defaultParallelism), "stream", "first")
    return ranges.mapInArrow(cut, "stream long, block long, payload binary")


def _flat(path: str, separable: bool, separator: int, dtype: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, encoder = TaskContext.get().partitionId(), Encoder(path, separable, dtype)
        schema = pa.schema([("kind", pa.int8()), ("stream", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("doc_id", pa.int64())])
        close, step = np.array([separator], dtype=dtype).tobytes(), block * np.dtype(dtype).itemsize
        held, at, ordinal = bytearray(), 0, 0

        def told(payloads: list[bytes], at: int) -> pa.RecordBatch:
            n = len(payloads)
            return pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int8()), pa.array([stream] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(payloads, pa.binary()), pa.nulls(n, pa.int64())], schema=schema)

        for rows, texts in pieces(batches, "text"):
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int8()), pa.array([stream] * n, pa.int64()), pa.array(range(ordinal, ordinal + n), pa.int64()), pa.nulls(n, pa.binary()), column(rows, "doc_id")], schema=schema)
            ordinal += n
            for ids in encoder.ids(texts):
                held += ids
                held += close
            if full := len(held) // step:
                yield told([bytes(held[i * step : (i + 1) * step]) for i in range(full)], at)
                at += full
                del held[: full * step]
        if held:
            yield told([bytes(held)], at)

    return run


def write_flat(docs: DataFrame, path: str, separable: bool, separator: int, dtype: str = "<u2", block: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """Tokenise docs(doc_id long, text string) into flat streams in the shared folder.

    Returns the blocks(stream, block, payload) and the order of documents
    (stream, ordinal, doc_id), which the token stream itself doesn't hold. A null
    text is empty: its document has no tokens.
    """
    flat = pick(docs, "doc_id", "text").mapInArrow(_flat(path, separable, separator, dtype, block), "kind byte, stream long, block long, payload binary, doc_id long")
    flat = stored(flat, "flat", "zstd")
    return flat.filter("kind = 0").select("stream", "block", "payload"), flat.filter("kind = 1").select("stream", F.col("block").alias("ordinal"), "doc_id")


def document_token_counts(docs: DataFrame, path: str | None = None, separable: bool = True, separator: int = 49407) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs(doc_id long, text string), counted in the flat streams written from them.

    A null or empty text has no tokens; a row without doc_id is counted, too, and
    repeated rows are counted one by one. An empty table gives no rows. Texts may be of
    any length; other columns, whatever their names, aren't looked at.
    """
    blocks, order = write_flat(docs, path or tokenizer_path(), separable, separator)
    return order.join(token_counts(blocks, separator), ["stream", "ordinal"]).select("doc_id", "n_tokens")
