"""Near-duplicates: a multi-index Hamming join over b-bit MinHash signatures.

A document's signature has `chunks` x `slots` MinHash values of 16 bits. Two
signatures that differ in at most 2 * chunks - 1 values agree, by pigeonhole, on
all but one value of some chunk; so each document is indexed once per chunk and
allowed error (the chunk without that value), and every such pair shares a key.
The number of chunks is the least that lets a pair at the threshold itself miss
all keys with a probability of at most `miss`.

Candidates are confirmed on the full shingle sets:

* documents with equal sets are one class from the start, and its smallest
  doc_id stands for it;
* keys of up to four classes give pairs; those whose signatures differ in no more
  values than a pair at the threshold would, but for a probability of `miss`, are
  compared one by one;
* larger keys join classes into families. A family is compared in blocks of a
  bounded size, each block exactly and as a whole, and a block hands on only a
  spanning forest of its links. Families above `family` classes are compared key
  by key in the same way.

No pair of a group is ever a row before it is confirmed or under that bound. A key
of very many classes is made a leader and its members where the classes are, before
any shuffle, so that what goes to one task is a few rows from each other task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, reduced
from .shared import column, forget, pick, pieces, stored
from .words import U, distinct, mix, seeds, shingle_sets

#: Keys of up to so many classes give pairs.
SMALL = 4
#: Bits of the filter for the documents whose sets are wanted: so many for each, in these bounds.
BITS, BITMAP = 16, (1 << 20, 1 << 27)
#: Classes whose keys are put together before they are shuffled.
CHUNK = 1 << 14


def chunks_needed(threshold: float, slots: int, miss: float) -> int:
    near = threshold**slots + slots * (1 - threshold) * threshold ** (slots - 1)
    return max(1, math.ceil(math.log(miss) / math.log(1 - near))) if near < 1 else 1


def most_errors(threshold: float, width: int, miss: float) -> int:
    """The least d with P(more than d of the values differ | similarity at the threshold) <= miss."""
    total = 0.0
    for d in range(width + 1):
        total += math.comb(width, d) * (1 - threshold) ** d * threshold ** (width - d)
        if 1 - total <= miss:
            return d
    return width


def signature(shingle_set: np.ndarray, size: int) -> np.ndarray:
    by = seeds(size, 5)
    low = np.full(size, np.iinfo(np.uint64).max, dtype=U)
    for i in range(0, len(shingle_set), 512):
        np.minimum(low, (shingle_set[i : i + 512, None] * by + by[::-1]).min(0), out=low)
    return (mix(low) >> U(48)).astype(np.uint16)


def keys(signatures: np.ndarray, slots: int) -> np.ndarray:
    """For each row its keys: of each chunk and allowed error, the hash of the other values."""
    n, width = signatures.shape
    by = seeds(width, 9)
    terms = mix((signatures.astype(U) + U(1)) * by)
    whole = terms.reshape(n, width // slots, slots).sum(2, dtype=U)
    without = np.repeat(whole, slots, axis=1) - terms
    return mix(without + by[::-1])


def _profile(size: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text"):
            sets = shingle_sets(texts, size)
            yield pa.RecordBatch.from_arrays(
                [
                    column(rows, "doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s, width).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "print", "sig"],
            )

    return run


def _rows(key: np.ndarray, rep: np.ndarray, lead: np.ndarray | None, many: np.ndarray) -> pa.RecordBatch:
    """Key rows; those with a leader are done with, and are dealt out by their own class."""
    deal = key if lead is None else rep
    leads = pa.nulls(len(key), pa.int64()) if lead is None else pa.array(lead)
    return pa.RecordBatch.from_arrays([pa.array(deal), pa.array(key), pa.array(rep), leads, pa.array(many)], names=["deal", "key", "rep", "lead", "many"])


def _keyed(width: int, slots: int):
    """The keys of classes: of a key that more than SMALL classes of a chunk have, the first one leads the others and goes on alone."""

    def told(sig: list[bytes], rep: list[int]) -> Iterator[pa.RecordBatch]:
        if not rep:
            return
        reps = np.array(rep, dtype=np.int64)
        parts = [keys(np.frombuffer(b"".join(sig[i : i + 1024]), dtype=np.uint16).reshape(-1, width), slots).ravel() for i in range(0, len(sig), 1024)]
        key, owner = np.concatenate(parts).view(np.int64), np.repeat(reps, width)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(first, len(key)))
        many, leads = np.repeat(count > SMALL, count), np.zeros(len(key), dtype=bool)
        leads[first] = True
        yield _rows(key[~many | leads], owner[~many | leads], None, many[~many | leads])
        if (led := many & ~leads).any():
            yield _rows(key[led], owner[led], np.repeat(owner[first], count)[led], many[led])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig: list[bytes] = []
        rep: list[int] = []
        for batch in batches:
            sig += column(batch, "sig").to_pylist()
            rep += column(batch, "rep").to_pylist()
            while len(rep) >= CHUNK:
                yield from told(sig[:CHUNK], rep[:CHUNK])
                sig, rep = sig[CHUNK:], rep[CHUNK:]
        yield from told(sig, rep)

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of keys: pairs of short runs, leader and member of long ones.

    Holds a batch and up to SMALL rows before it, however long a run is.
    """
    key = rep = np.empty(0, dtype=np.int64)
    many = np.empty(0, dtype=bool)
    long_key, leader = None, 0

    def told(kind: int, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int8)), pa.array(a), pa.array(b), pa.array(k)], names=["kind", "a", "b", "key"])

    def whole(k: np.ndarray, r: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(k):
            return
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        count = np.diff(np.append(first, len(k)))
        n = np.repeat(np.where(np.logical_or.reduceat(m, first), SMALL + 1, count), count)
        lead = np.repeat(r[first], count)
        short, long = n <= SMALL, n > SMALL
        long[first] = False
        if long.any():
            yield told(1, lead[long], r[long], k[long])
        for d in range(1, SMALL):
            if len(k) > d and (at := np.flatnonzero((k[:-d] == k[d:]) & short[d:])).size:
                yield told(0, r[at], r[at + d], k[at])

    for batch in batches:
        led = column(batch, "lead").is_valid()
        if pa.compute.any(led).as_py():
            done = batch.filter(led)
            yield told(1, *(column(done, c).to_numpy() for c in ("lead", "rep", "key")))
            batch = batch.filter(pa.compute.invert(led))
        k = np.concatenate((key, column(batch, "key").to_numpy()))
        r = np.concatenate((rep, column(batch, "rep").to_numpy()))
        m = np.concatenate((many, column(batch, "many").to_numpy(zero_copy_only=False)))
        if long_key is not None:
            n = int(np.searchsorted(k, long_key, side="right"))
            if n:
                yield told(1, np.full(n, leader), r[:n], k[:n])
            k, r, m = k[n:], r[n:], m[n:]
            if not len(k):
                key, rep, many = k, r, m
                continue
            long_key = None
        if not len(k):
            key, rep, many = k, r, m
            continue
        cut = int(np.searchsorted(k, k[-1], side="left"))
        yield from whole(k[:cut], r[:cut], m[:cut])
        key, rep, many = k[cut:], r[cut:], m[cut:]
        if len(key) > SMALL or many.any():
            yield from whole(key, rep, many | True)
            long_key, leader = int(key[0]), int(rep[0])
            key, rep, many = key[:0], rep[:0], many[:0]
    yield from whole(key, rep, many)


def _near(width: int, errors: int):
    """Pairs whose signatures differ in at most so many values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                rows = batch.slice(i, 4096)
                x, y = (np.frombuffer(b"".join(column(rows, c).to_pylist()), dtype=np.uint16).reshape(-1, width) for c in ("sig_a", "sig_b"))
                yield rows.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= errors))

    return run


def _wanted(bits: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = column(batch, "bit").to_numpy()
                keep = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
                if keep.any():
                    yield batch.filter(pa.array(keep.astype(bool)))

        for rows, texts in pieces(some(), "text"):
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array([s.tobytes() for s in shingle_sets(texts, size)], pa.binary())], names=["rep", "set"])

    return run


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, set) of the documents in wanted(rep), and of few others.

    The filter is a bitmap of a bounded size over hashes of doc_id, so no text is
    shuffled and nothing that grows without a bound goes through the driver; the
    joins that follow are exact.
    """
    bitmap = min(max(BITMAP[0], 1 << (BITS * wanted.count()).bit_length()), BITMAP[1])
    at = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(bitmap)).alias("bit"))
    got = at.groupBy(F.expr("bit div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("bits")).collect()
    bits = np.zeros(bitmap // 8, dtype=np.uint8)
    for row in got:
        bits[row["bucket"] * 4096 : (row["bucket"] + 1) * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bitmap)).alias("bit"))
    return rows.mapInArrow(_wanted(bits, size), "rep long, set binary")


def linked(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """For each of the sets the first of those it is connected to among them.

    Intersection sizes are exact: of the elements in two sets or more, the frequent
    ones are counted by matrix products, the others by listing their pairs of sets.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), size)
    value = np.concatenate(sets) if n else np.empty(0, dtype=U)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    shared = np.zeros(n * n, dtype=np.int32)
    if len(value):
        first = np.concatenate(([True], value[1:] != value[:-1]))
        label = np.cumsum(first) - 1
        count = np.bincount(label)[label]
        rare = (count >= 2) & (count < 24)
        la, ow = label[rare], owner[rare]
        for d in range(1, 24):
            if len(la) <= d:
                break
            at = np.flatnonzero(la[:-d] == la[d:])
            if not len(at):
                break
            shared += np.bincount(ow[at] * n + ow[at + d], minlength=n * n)
        la, ow = label[count >= 24], owner[count >= 24]
        la = np.unique(la, return_inverse=True)[1] if len(la) else la
        ends = np.searchsorted(la, np.arange(0, la[-1] + 1025, 1024)) if len(la) else []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            m = np.zeros((n, 1024), dtype=np.float32)
            m[ow[a:b], la[a:b] % 1024] = 1
            shared += np.triu(m @ m.T, 1).ravel().astype(np.int32)  # 1024 at most at a time: exact
    shared = shared.reshape(n, n)
    link = np.empty((n, n), dtype=bool)
    some = [slice(i, i + 256) for i in range(0, n, 256)]  # rows at a time: the matrices of longs would be large
    for at in some:
        both = shared[at].astype(np.int64) + shared[:, at].T
        link[at] = 100 * both >= threshold * (size[at, None] + size[None, :] - both)
    link[size == 0] = link[:, size == 0] = False
    np.fill_diagonal(link, True)
    label = np.arange(n)
    while True:
        low = np.concatenate([np.where(link[at], label[None, :], n).min(1) for at in some]) if n else label
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _block(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        reps = table.column("rep").to_numpy()
        sets = [np.frombuffer(x, dtype=U) for x in table.column("set").to_pylist()]
        to = linked(sets, threshold)
        out = to != np.arange(len(to))
        return pa.table({"a": pa.array(reps[out], pa.int64()), "b": pa.array(reps[to[out]], pa.int64())})

    return run


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "x"), column(batch, "y"), strict=True):
                x, y = (np.frombuffer(s.as_py(), dtype=U) for s in (x, y))
                both = len(x) + len(y) - len(distinct(np.concatenate((x, y))))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, *, shingle: int = 5, threshold: int = 80, slots: int = 7, miss: float = 1e-4, block: int = 1024, weight: int = 1 << 20, family: int = 8192) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs(doc_id long, text string).

    Links join documents whose sets of `shingle`-word shingles satisfy
    100 * intersection >= threshold * union; component_id is the smallest doc_id
    reachable. A text with fewer words is one shingle of all of them. Null or
    wordless texts have an empty set and no links. Rows that repeat a doc_id are
    one node. A row without a doc_id has no links, a null component_id, and is kept.
    An empty table gives no rows; texts may be of any length; other columns, whatever
    their names, aren't looked at.
    """
    docs = pick(docs, "doc_id", "text")
    width = slots * chunks_needed(threshold / 100, slots, miss)
    profile = stored(docs.mapInArrow(_profile(shingle, width), "doc_id long, n long, print binary, sig binary"), "profile")
    classes = stored(profile.filter("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    keyed = classes.select("rep", "sig").mapInArrow(_keyed(width, slots), "deal long, key long, rep long, lead long, many boolean")
    found = stored(keyed.repartition("deal").sortWithinPartitions("key", "rep").mapInArrow(_runs, "kind byte, a long, b long, key long"), "candidates")
    # A doc_id that repeats with several texts stands for several classes.
    sizes = classes.groupBy("rep").agg(F.max("n").alias("n"), F.min("n").alias("least"), F.first("sig").alias("sig"))

    families = components(reduced(found.filter("kind = 1")))
    large = stored(families.groupBy("component").count().filter(F.col("count") > family).select("component"), "large")
    members = families.join(large, "component", "left_anti").select(F.lit(0).alias("of"), F.col("component").alias("unit"), F.col("node").alias("rep"))
    over = found.filter("kind = 1").join(families.join(large, "component").select(F.col("node").alias("a")), "a", "left_semi")
    by_key = over.select("key", F.explode(F.array("a", "b")).alias("rep")).distinct()
    members = stored(members.union(by_key.select(F.lit(1), "key", "rep")).join(sizes.select("rep", "n"), "rep"), "members")

    pairs = found.filter("kind = 0").select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("least").alias(f"least_{side}"), F.col("sig").alias(f"sig_{side}")), side)
        pairs = pairs.join(families.join(large, "component", "left_anti").select(F.col("node").alias(side), F.col("component").alias(f"f_{side}")), side, "left")
    pairs = pairs.filter("f_a is null or f_b is null or f_a <> f_b")
    several, errors = "least_a < n_a or least_b < n_b", most_errors(threshold / 100, width, miss)
    single = pairs.filter(f"not ({several}) and 100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
    pairs = stored(single.mapInArrow(_near(width, errors), "a long, b long").union(pairs.filter(several).select("a", "b")), "pairs")

    sets = stored(_sets(docs, members.select("rep").union(pairs.select("a")).union(pairs.select("b")), shingle), "sets")
    blocks = members.groupBy("of", "unit").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / weight)).cast("int").alias("k"))
    placed = members.join(blocks, ["of", "unit"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    placed = placed.select("of", "unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep")
    forest = placed.join(sets, "rep").groupBy("of", "unit", "i", "j").applyInArrow(_block(threshold), "a long, b long")
    got = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")
    sure = got.mapInArrow(_confirm(threshold), "a long, b long")
    joined = components(forest.union(sure))

    # Nothing below reads what is forgotten.
    low = stored(classes.select("print", "rep").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("print", F.coalesce("component", "rep").alias("low")), "class_components")
    for used in (found, sets, pairs, members, families, large, classes, joined):
        forget(used)
    out = profile.select("doc_id", F.col("n").alias("n_shingles"), "print").join(low, "print", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
