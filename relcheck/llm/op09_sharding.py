"""Sharding by bytes: minimax contiguous partition of ordered atomic groups.

Rows with equal texts are one atomic group; groups are ordered by a hash of the
text. The smallest feasible shard capacity is found by binary search with a greedy
check, and the cuts are made there. The groups never reach the driver: the order
is seen through ranges of hashes with their total sizes, and only ranges in which
a cut may lie are split further, until those are single groups. The answer is the
exact minimax of the groups, whatever their number.

One group that is larger than the mean sets the capacity by itself, and would leave
the other shards uneven. It takes a shard of its own, in its place in the order,
and what lies before and behind it is partitioned by the same search, over all
these sides together; shards stay runs of the order, and no shard grows larger.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, pick, stored

#: Bits of the hash that the first look tells apart, and each further one.
FIRST, STEP, BITS = 12, 8, 64


def _greedy(ends: list[int], shards: int, capacity: int) -> list[int] | None:
    """How many segments lie before each cut, or None if so many shards don't do."""
    cuts, at, n = [], 0, len(ends)
    for _ in range(shards):
        at = bisect_right(ends, (ends[at - 1] if at else 0) + capacity)
        cuts.append(at)
    return cuts if at == n else None


def _ends(sizes: list[int]) -> list[int]:
    return list(accumulate(sizes))


def _needed(ends: list[int], capacity: int) -> int:
    """How many runs of this capacity, no less than any size, hold all."""
    runs = at = 0
    while at < len(ends):
        at = bisect_right(ends, (ends[at - 1] if at else 0) + capacity)
        runs += 1
    return runs


def smallest_capacity(sides: list[list[int]], shards: int) -> tuple[int, list[list[int]]] | None:
    """The least capacity that lets `shards` runs, none over two sides, hold all sizes, and each side's greedy cuts; None if sides are more than shards."""
    sides = [s for s in sides]
    ends, total = [_ends(s) for s in sides], sum(map(sum, sides))
    if sum(map(bool, sides)) > shards:
        return None
    low, high = max([-(-total // shards) if shards else 0, *(x for s in sides for x in s)]), max(total, 0)
    while low < high:
        mid = (low + high) // 2
        if sum(_needed(e, mid) for e in ends) > shards:
            low = mid + 1
        else:
            high = mid
    return low, [(_greedy(e, _needed(e, low), low) or [])[:-1] for e in ends]


def _doubtful(sizes: list[int], low: int, high: int, shards: int) -> set[int]:
    """Segments in which a cut may lie for a capacity from low to high."""
    ends, total = _ends(sizes), sum(sizes)
    out: set[int] = set()
    a = b = 0  # the least and the greatest place of the last cut, in bytes
    for _ in range(shards - 1):
        i, j = bisect_right(ends, a + low), bisect_right(ends, b + high)
        out.update(range(i, min(j, len(sizes) - 1) + 1))
        a = ends[i - 1] if i else 0
        b = ends[j] if j < len(ends) else total
    return out


class _Order:
    """Segments of the order of hashes: (first hash, bits told apart, bytes, groups, largest group)."""

    def __init__(self, groups: DataFrame):
        self._groups = groups
        self.segments = self._look(FIRST, None)

    def _look(self, bits: int, prefixes: list[int] | None) -> list[tuple[int, int, int, int, int]]:
        df = self._groups.withColumn("prefix", F.shiftright("h", BITS - bits))
        if prefixes is not None:
            parents = df.sparkSession.createDataFrame([(p,) for p in prefixes], "parent long")
            df = df.join(F.broadcast(parents), F.shiftright("h", BITS - bits + STEP) == F.col("parent"), "left_semi")
        seen = df.groupBy("prefix").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"), F.max("bytes").alias("largest")).collect()
        return sorted((r["prefix"] << BITS - bits, bits, r["bytes"], r["groups"], r["largest"]) for r in seen)

    def split(self, which: set[int]) -> bool:
        """Split the segments of more than one group among these; false if there are none."""
        again = [i for i in which if self.segments[i][3] > 1]
        kept = [s for i, s in enumerate(self.segments) if i not in set(again)]
        for bits in {self.segments[i][1] for i in again}:
            kept += self._look(bits + STEP, [self.segments[i][0] >> BITS - bits for i in again if self.segments[i][1] == bits])
        self.segments = sorted(kept)
        return bool(again)


def _searched(sides: list[_Order], shards: int) -> tuple[int, list[list[int]]] | None:
    """The exact answer of smallest_capacity for the groups behind the segments, which are split as far as it takes."""
    while True:
        sizes = [[s[2] for s in o.segments] for o in sides]
        found = smallest_capacity(sizes, shards)
        if found is None:
            return None
        low = max([-(-sum(map(sum, sizes)) // shards) if shards else 0, *(s[4] for o in sides for s in o.segments)])
        if not any([o.split(_doubtful(s, low, found[0], shards)) for o, s in zip(sides, sizes, strict=True)]):
            return found


def cuts(groups: DataFrame, shards: int, alone: tuple[int, ...] = ()) -> tuple[list[int], int] | None:
    """First hash of each run but the first one, and the capacity, for groups(h long, bytes long).

    The groups of alone, in order, are runs by themselves and not under the capacity;
    each side of them is then cut for the least capacity of its own number of runs.
    None if there aren't enough shards for that.
    """
    h, bounds = F.col("h"), [None, *alone, None]
    spans = list(zip(bounds[:-1], bounds[1:], strict=True))
    sides = [_Order(groups.filter((h > a if a is not None else F.lit(True)) & (h < b if b is not None else F.lit(True)))) for a, b in spans]
    found = _searched(sides, shards - len(alone))
    if found is None:
        return None
    high, at = found
    if alone:
        at = [_searched([o], len(places) + 1)[1][0] if o.segments else [] for o, places in zip(sides, at, strict=True)]
    firsts, began = [], False
    for (before, _), order, places in zip(spans, sides, at, strict=True):
        if before is not None:
            firsts += [before] if began else []
            began = True
        if order.segments:
            # What follows a group that is alone begins behind it.
            firsts += [before + 1] if before is not None else []
            firsts += [order.segments[i][0] for i in places]
            began = True
    return firsts, high


def _places(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First hash of each run but the first one; the largest run's bytes.

    Groups above the mean of what is left are taken alone as long as no run grows by it.
    """
    firsts, most = cuts(groups, shards)
    alone: list[int] = []
    while True:  # at most `shards` rounds
        rest = groups.filter(~F.col("h").isin(alone)) if alone else groups
        total, left = rest.agg(F.sum("bytes")).first()[0] or 0, shards - len(alone)
        big = rest.filter(F.col("bytes") * left > total).orderBy(F.desc("bytes"), "h").limit(1).collect() if left > 1 else []
        if not big:
            return firsts, most
        alone.append(big[0]["h"])
        found = cuts(groups, shards, tuple(sorted(alone)))
        if found is None or found[1] > most:
            return firsts, most
        firsts = found[0]


def minimax_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs(doc_id, text).

    size is the text's bytes in UTF-8 plus 1; a null text counts none and its rows
    are a group of their own. Rows with equal texts share a shard; their order there
    is that of text hash and doc_id, and repeated rows have slots of their own.
    Fewer groups than shards leave shards empty; an empty table gives no rows. Other
    columns aren't looked at. grown_shard is null under this law.
    """
    rows = pick(docs, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.xxhash64("text", F.col("text").isNull()).alias("h"),
    )
    # A row's place in its range partition is its rank there; kept, so that ranks are told once.
    rows = stored(rows.repartitionByRange("h", "doc_id", "size").sortWithinPartitions("h", "doc_id").withColumn("at", F.monotonically_increasing_id()), "shard_rows")
    groups = stored(rows.groupBy("h").agg(F.sum("size").alias("bytes")), "shard_groups")
    firsts, _ = _places(groups, shards)
    forget(groups)

    shard = F.lit(0)
    for f in firsts:
        shard = shard + F.when(F.col("h") >= F.lit(f), 1).otherwise(0)
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("part", F.shiftright("at", 33))
    # A shard is one run of the order, and so is what each partition has of it.
    parts = placed.groupBy("shard", "part").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    w = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    out = placed.join(parts.select("shard", "part", "least", "before"), ["shard", "part"])
    slot = F.col("before") + F.col("at") - F.col("least")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
