"""Best-fit packing: best-fit decreasing over exact piece sizes, for all documents at once.

Sizes are whole numbers up to the capacity, so best-fit decreasing needs to know
only how many pieces of each size there are. The plan is made from those counts:
sizes in descending order, each batch of equal pieces put into the tightest open
bins, found in a segment tree over remaining capacities; bins that hold the same
are one entry with a count. The plan is bounded by the capacity and not by the
number of documents. Each piece then finds its bin and offset from its rank among
the pieces of its size, which is counted in two levels: within a task's chunk, and
over the counts of the chunks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import column, pick, pieces, stored
from .tokens import Encoder, tokenizer_path


class Open:
    """Which remaining capacities have open bins: a segment tree of their bin counts."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._sum = [0] * (2 * self._leaves)

    def add(self, room: int, bins: int) -> None:
        at = room + self._leaves
        while at:
            self._sum[at] += bins
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least size with an open bin."""
        at, found = size + self._leaves, None
        if self._sum[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self._sum[at + 1]:
                found = at + 1
                break
            at >>= 1
        if found is None:
            return None
        while found < self._leaves:
            found = 2 * found if self._sum[2 * found] else 2 * found + 1
        return found - self._leaves


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (size, first rank, pieces per bin, first bin, first offset), in the order of size and rank.

    Pieces of a size with ranks from the first rank on fill the bins one after
    another, so many in each, from the first offset on.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    tree = Open(capacity)
    held: dict[int, list[tuple[int, int]]] = {}  # by remaining capacity: runs (first bin, number of bins)
    n_bins = 0

    def open_bins(room: int, first: int, bins: int) -> None:
        if bins and room:
            held.setdefault(room, []).append((first, bins))
            tree.add(room, bins)

    def fill(size: int, rank: int, left: int, room: int, first: int, bins: int) -> int:
        """Put up to `left` pieces into bins with so much room; returns how many went in."""
        each = room // size
        full = min(bins, left // each)
        if full:
            rows.append((size, rank, each, first, capacity - room))
            open_bins(room - each * size, first, full)
        rest = min(left - full * each, each - 1) if full < bins else 0
        if rest:
            rows.append((size, rank + full * each, rest, first + full, capacity - room))
            open_bins(room - rest * size, first + full, 1)
        open_bins(room, first + full + (rest > 0), bins - full - (rest > 0))
        return full * each + rest

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                bins = -(-left // (capacity // size))
                done = fill(size, rank, left, capacity, n_bins, bins)
                n_bins += bins
            else:
                first, bins = held[room].pop()
                tree.add(room, -bins)
                done = fill(size, rank, left, room, first, bins)
            left, rank = left - done, rank + done
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def _cut(path: str, separable: bool, last: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, encoder = TaskContext.get().partitionId(), Encoder(path, separable, special=True)
        end, seen = np.array([last], dtype="<u4").tobytes(), np.zeros(capacity + 1, dtype=np.int64)
        for rows, texts in pieces(batches, "text"):
            ids = [x + end for x in encoder.ids(texts)]
            n = np.array([len(x) // 4 for x in ids])
            cuts = -(-n // capacity)
            owner = np.repeat(np.arange(len(n)), cuts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(n[owner] - start, capacity)
            crc = [zlib.crc32(memoryview(ids[o])[4 * s : 4 * (s + k)]) for o, s, k in zip(owner.tolist(), start.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            by = length[order]
            first = np.searchsorted(by, by, side="left")
            rank = np.empty(len(by), dtype=np.int64)
            rank[order] = np.arange(len(by)) - first + seen[by]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [column(rows, "doc_id").take(pa.array(owner)), *(pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), (np.full(len(by), chunk), pa.int64()), (rank, pa.int64())))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "rank"],
            )

    return run


def _place(rows: np.ndarray, total: int):
    code = rows[:, 0] * total + rows[:, 1]
    order = np.argsort(code)
    code, rows = code[order], rows[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = column(batch, "length").to_numpy(), column(batch, "rank").to_numpy()
            _, first, each, bins, offset = rows[np.searchsorted(code, size * total + rank, side="right") - 1].T
            nth = rank - first
            added = [pa.array(bins + nth // each, pa.int64()), pa.array(offset + nth % each * size, pa.int64())]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), *added], names=[*kept, "sequence_id", "offset"])

    return run


def token_pieces(docs: DataFrame, path: str, separable: bool, last: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, chunk, rank): the pieces of docs(doc_id long, text string)."""
    cut = pick(docs, "doc_id", "text").mapInArrow(_cut(path, separable, last, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, rank long")
    return stored(cut, "pieces")


def pack(docs: DataFrame, *, path: str | None = None, separable: bool = True, last: int = 1, capacity: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of docs.

    A document is its text's ids and then `last`; a null or empty text is that id
    alone. Documents above the capacity are cut into pieces of just the capacity
    and a last, shorter one. Repeated rows are packed as often as they occur. An
    empty table gives no rows.
    """
    items = token_pieces(docs, path or tokenizer_path(), separable, last, capacity)
    counts = items.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    sizes = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(sizes, capacity)
    ranked = items.join(counts.select("length", "chunk", "before"), ["length", "chunk"]).withColumn("rank", F.col("rank") + F.col("before"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_place(rows, max(sizes.values(), default=0) + 1), schema)
