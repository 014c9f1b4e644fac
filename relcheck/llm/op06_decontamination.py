"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle sets. In each partition an
item's sketch is the shingles that are least under a number of hash functions
fixed for the partition; each of them lies in a document with just the probability
that the document contains the item. An item with as few shingles as functions is
its own sketch. A document is a candidate for an item if it has at least so many of
the sketch's shingles that one at the threshold would have fewer with a probability
of at most `MISS`, and if its own set is not too small to contain the item.
Candidates are confirmed by the exact containment of the whole sets.

Documents are scanned once, whole, against an index of a checked size; a larger
set of items is searched in blocks, one scan for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, forget, pick, pieces, stored
from .words import mix, seeds, shingle_sets

#: Upper bounds of the partitions by set size, with their numbers of hash functions; larger items use LAST.
PARTITIONS, LAST = {8: 8, 16: 16, 32: 20, 128: 24}, 32
MISS = 1e-6
#: Shingles of items in one block.
BLOCK = 1 << 21


def functions_for(n: int) -> int:
    return next((k for top, k in PARTITIONS.items() if n <= top), LAST)


def least_matches(k: int, threshold: float) -> int:
    """The greatest c with P(fewer than c of k sketch shingles | containment at the threshold) <= MISS."""
    total = 0.0
    for c in range(k + 1):
        total += math.comb(k, c) * threshold**c * (1 - threshold) ** (k - c)
        if total > MISS:
            return max(1, c)
    return max(1, k)


class Index:
    """The sketches and whole sets of a block of items."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], threshold: int):
        self.ids, self.sets = [i for i, _ in items], [s for _, s in items]
        self.threshold = threshold
        shingle, item, self.least = [], [], []
        for at, s in enumerate(self.sets):
            k = functions_for(len(s))
            if len(s) <= k:
                sketch, least = s, -(-threshold * len(s) // 100)
            else:
                sketch, least = s[mix(s[:, None] ^ seeds(k, 21)).argmin(0)], least_matches(k, threshold / 100)
            shingle.append(sketch)
            item.append(np.full(len(sketch), at))
            self.least.append(least)
        shingle = np.concatenate(shingle) if items else np.empty(0, dtype=np.uint64)
        item = np.concatenate(item) if items else np.empty(0, dtype=np.int64)
        order = np.argsort(shingle, kind="stable")
        self.shingle, self.item = shingle[order], item[order]

    def found(self, sets: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(set, item, shared) for all that contain an item."""
        if not len(self.shingle) or not sets:
            return []
        value = np.concatenate(sets)
        begin = np.searchsorted(self.shingle, value, side="left")
        hit = np.flatnonzero(self.shingle[np.minimum(begin, len(self.shingle) - 1)] == value)
        if not len(hit):
            return []
        count = np.searchsorted(self.shingle, value[hit], side="right") - begin[hit]
        owner = np.searchsorted(np.cumsum([len(s) for s in sets]), hit, side="right")
        at = np.repeat(begin[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())
        pairs, matches = np.unique(np.stack((np.repeat(owner, count), self.item[at])), axis=1, return_counts=True)
        out = []
        for d, i, n in zip(*pairs.tolist(), matches.tolist(), strict=True):
            size = len(self.sets[i])
            if n >= self.least[i] and 100 * len(sets[d]) >= self.threshold * size:
                shared = int(np.isin(self.sets[i], sets[d], assume_unique=True).sum())
                if 100 * shared >= self.threshold * size:
                    out.append((d, i, shared))
        return out


def _item_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text"):
            sets = shingle_sets(texts, size)
            yield pa.RecordBatch.from_arrays([column(rows, "item_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["item_id", "n", "set"])

    return run


def indexes(items: DataFrame, shingle: int, threshold: int, block: int = BLOCK) -> Iterator[Index]:
    """An index for each block of items(item_id long, text string); none for wordless items."""
    sets = stored(pick(items, "item_id", "text").mapInArrow(_item_sets(shingle), "item_id long, n long, set binary").filter("n > 0"), "items")
    blocks = max(1, -(-(sets.agg(F.sum("n")).first()[0] or 0) // block))
    for b in range(blocks):
        part = sets.filter(F.pmod(F.xxhash64("set"), F.lit(blocks)) == b) if blocks > 1 else sets
        rows = sorted(((r["item_id"], bytes(r["set"])) for r in part.select("item_id", "set").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield Index([(i, np.frombuffer(s, dtype=np.uint64)) for i, s in rows], threshold)
    forget(sets)


def _pairs(index: Index, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text"):
            found = index.found(shingle_sets(texts, size))
            yield pa.RecordBatch.from_arrays(
                [column(rows, "doc_id").take(pa.array([d for d, _, _ in found], pa.int64())), pa.array([index.ids[i] for _, i, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64()), pa.array([len(index.sets[i]) for _, i, _ in found], pa.int64())],
                names=["doc_id", "item_id", "n_shared", "n_item"],
            )

    return run


def _without(index: Index, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text"):
            keep = np.ones(rows.num_rows, dtype=bool)
            keep[[d for d, _, _ in index.found(shingle_sets(texts, size))]] = False
            yield rows.filter(pa.array(keep))

    return run


def contained_items(docs: DataFrame, items: DataFrame, *, shingle: int = 5, threshold: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) where a document holds threshold % of an item's distinct shingles.

    docs(doc_id long, text string), items(item_id long, text string). A text with
    fewer words than a shingle is one shingle of all of them; one without words has
    none, holds nothing and is held by nothing. Repeated rows give repeated results;
    an empty table on either side gives none. Texts may be of any length, and other
    columns, whatever their names, aren't looked at.
    """
    out = None
    for index in indexes(items, shingle, threshold, block):
        part = pick(docs, "doc_id", "text").mapInArrow(_pairs(index, shingle), "doc_id long, item_id long, n_shared long, n_item long")
        out = part if out is None else out.union(part)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, *, shingle: int = 5, threshold: int = 80, block: int = BLOCK) -> DataFrame:
    """The rows of docs, with all columns, that hold no item by the same rule; null and empty texts hold none, and repeated rows go or stay together."""
    for index in indexes(items, shingle, threshold, block):
        docs = docs.mapInArrow(_without(index, shingle), docs.schema)
    return docs
