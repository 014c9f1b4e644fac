"""Connected components over a table of links, by alternating large and small stars.

Each task of a round makes its links a forest of stars before it writes them. Every
step reads stored tables and has one join at most: what the driver holds
of the plans it has run stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import column, forget, pick, stored

#: A node with more rows than a part of MANY of all, and than LEAST_MANY, isn't joined in one task.
MANY, LEAST_MANY = 4096, 512
#: Links that are made a forest at a time.
CHUNK = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) with the least node v connected to u, for every other node u of the links."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        a, b = a[x != y], b[x != y]
        x, y = x[x != y], y[x != y]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) that connect what the given ones do: of each CHUNK or more of them a forest."""

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = forest(*(np.concatenate([column(x, c).to_numpy() for x in held]) for c in ("u", "v")))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield told(held)
            held, n = [], 0
    if n:
        yield told(held)


def _stars(links: DataFrame) -> DataFrame:
    return links.mapInArrow(_forests, "u long, v long")


def reduced(links: DataFrame) -> DataFrame:
    """Fewer links(a, b) that connect what the given ones do; meant for stored links, whose tasks need no other Python worker."""
    rows = pick(links, "a", "b").filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return _stars(rows).select(F.col("u").alias("a"), F.col("v").alias("b"))


def _led(e: DataFrame, low: DataFrame, most: int | None) -> DataFrame:
    """e(u, v) with m, the least neighbour of v, from low(u, m, n), which has a row for each node and its number of rows.

    Nodes of more than `most` rows, if there are any, are looked up where the links
    are; those links are then dealt out by both ends.
    """
    if most is None:
        return e.join(low.select(F.col("u").alias("v"), "m"), "v")
    heavy = low.filter(F.col("n") > most).select(F.col("u").alias("v"), F.col("m").alias("m_heavy"))
    rows = e.join(F.broadcast(heavy), "v", "left").withColumn("at", F.when(F.col("m_heavy").isNull(), F.col("v")).otherwise(F.xxhash64("u", "v")))
    light = low.filter(F.col("n") <= most).select(F.col("u").alias("at"), "m")
    return rows.join(light, "at", "left").select("u", "v", F.coalesce("m_heavy", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b); component is its smallest node.

    Each round costs an aggregation, a join and a window on keys, and the number of
    rounds grows with the logarithm of the longest chain. No group is gathered in a
    task. The result reads one stored table, which forget() deletes.
    """
    # What made the links may have a Python worker for each task: there is to be no second one.
    e = stored(pick(links, "a", "b").filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).select("u", F.least("u", "low").alias("m"), "high", "n"), "nodes")
        # Links are stars if no node with a smaller neighbour has another one.
        unsettled, rows, n = low.agg(F.count_if(F.expr("m < u and high > m")), F.sum("n"), F.max("n")).first()
        if not unsettled:
            forget(e)
            return low.select(F.col("u").alias("node"), F.col("m").alias("component"))
        # As each has more than rows / (2 * MANY) of the rows, there are fewer than 2 * MANY heavy nodes.
        most = max(LEAST_MANY, rows // 2 // MANY)
        large = stored(_stars(_led(e, low, most if n > most else None).select("u", F.col("m").alias("v"))), "links")
        for used in (e, low):
            forget(used)
        # Each forest has a node as its u once at most, so a group has no more rows than there are forests.
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        e = stored(_stars(small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v")), "links")
        forget(large)
