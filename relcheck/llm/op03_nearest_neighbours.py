"""Approximate nearest neighbours: an inverted multi-index for inner products.

Each half of a vector has a codebook of its own, so K centroids a half make K * K
cells. A query visits cells in the order of summed distance, which a heap over the
two sorted lists of centroids yields one by one, until they hold `visit` entries;
those are reranked by the exact inner product.

`visit` is calibrated on the data: for a bounded sample of queries the true
neighbours are found by brute force over all vectors, and `visit` is the number of
entries that would have been seen before all but the allowed share of them, but at
least as many as a whole result takes.

Equal vectors are one entry, which keeps only as many of its smallest ids as a
result can hold, and equal queries are searched once; so a vector with very many
copies costs no more than another.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import column, pick, stored

#: Vectors that the codebooks are trained on, at most, and their rounds.
TRAINED_ON, ROUNDS = 20_000, 12
#: Queries that `visit` is calibrated on, and the share of their neighbours to be found.
SAMPLED, SHARE = 128, 0.95
#: Entries to a cell, on average; centroids of a half: the work grows with more entries to a cell, no result changes.
IN_CELL, CENTROIDS = 16, (2, 1024)
#: Entries and queries that one task compares.
ENTRIES, QUERIES = 1 << 16, 1 << 14


def _matrix(values: pa.Array, dim: int) -> np.ndarray:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float64)
    for _ in range(rounds):
        near = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


class Codebooks:
    def __init__(self, sample: np.ndarray, k: int):
        self.half = -(-sample.shape[1] // 2)
        self.halves = [kmeans(part, k) for part in self._split(sample)]

    def _split(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :]] if x.shape[1] > 1 else [x, x * 0]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half, squared distances to the centroids less the vector's own square."""
        return [(c**2).sum(1) - 2 * part @ c.T for part, c in zip(self._split(x.astype(np.float64)), self.halves, strict=True)]

    def codes(self, x: np.ndarray) -> np.ndarray:
        a, b = (d.argmin(1) for d in self.distances(x))
        return a * len(self.halves[1]) + b


def traverse(first: np.ndarray, second: np.ndarray, count: np.ndarray, visit: int) -> list[int]:
    """Cells with entries in the order of summed distance, until they hold `visit` entries."""
    k = len(second)
    by_a, by_b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    a, b = first[by_a].tolist(), second[by_b].tolist()
    heap, reached, out, seen = [(a[0] + b[0], 0, 0)], [0] * len(a), [], 0
    while heap and seen < visit:
        _, i, j = heapq.heappop(heap)
        cell = by_a[i] * k + by_b[j]
        if n := count[cell]:
            out.append(cell)
            seen += n
        # (i, j) is left once to its right, and row i + 1 is entered once row i has moved on from it.
        if j + 1 < k:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def _exact(queries: np.ndarray, ids: np.ndarray, books: Codebooks, top: int):
    """The best of a task's vectors for each sampled query, with their cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(column(batch, "embedding"), queries.shape[1]).astype(np.float64)
            own = column(batch, "entry").to_numpy()
            score = queries @ x.T
            score[ids[:, None] == own] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, :top]
            q = np.repeat(np.arange(len(queries)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(score[q, best.ravel()]), pa.array(books.codes(x)[best.ravel()], pa.int32())], names=["q", "score", "cell"])

    return run


def _coded(books: Codebooks, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = books.codes(_matrix(column(batch, "embedding"), dim)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=[*batch.schema.names, "cell"])

    return run


def _probes(books: Codebooks, count: np.ndarray, visit: int, regions: int, blocks: list[int], query_blocks: int, dim: int):
    """For each query and region that it visits: its cells there, once for each block of the region."""
    counts = count.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(books.halves[1])
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = column(batch, "embedding")
            first, second = books.distances(_matrix(lists, dim))
            at, region, block, part, cells = [], [], [], [], []
            for i, query in enumerate(column(batch, "entry").to_pylist()):
                own: dict[int, list[int]] = {}
                for c in traverse(first[i], second[i], counts, visit):
                    own.setdefault(c // k % regions, []).append(c)
                for r, c in own.items():
                    for b in range(blocks[r]):
                        at.append(i)
                        region.append(r)
                        block.append(b)
                        part.append(query % query_blocks)
                        cells.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(region, pa.int32()), pa.array(block, pa.int32()), pa.array(part, pa.int32()), column(batch, "entry").take(pa.array(at, pa.int64())), lists.take(pa.array(at, pa.int64())), pa.array(cells, pa.list_(pa.int32()))], names=["region", "block", "part", "query", "vector", "cells"])

    return run


def _rerank(dim: int, top: int, n_cells: int):
    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        q, e, least, score = [], [], [], []
        if queries.num_rows and entries.num_rows:
            x = _matrix(entries.column("embedding"), dim).astype(np.float64)
            cell, entry, low = (entries.column(c).to_numpy() for c in ("cell", "entry", "least"))
            ids = queries.column("query").to_numpy()
            for i in range(0, len(ids), 256):
                some = queries.slice(i, 256)
                y = _matrix(some.column("vector"), dim).astype(np.float64)
                seen = np.zeros((len(y), n_cells), dtype=bool)
                lists = some.column("cells").to_pylist()
                seen[np.repeat(np.arange(len(y)), [len(c) for c in lists]), np.concatenate(lists)] = True
                about = np.where(seen[:, cell], y @ x.T, -np.inf)
                take = min(top + 1, len(x))
                # Scores are told as sums in one order; so equal vectors tie, and near the cut all of them stay.
                cut = np.partition(about, -take, axis=1)[:, -take]
                row, at = np.nonzero((about >= (cut - 1e-9 * (1 + abs(cut)))[:, None]) & np.isfinite(about))
                q.append(ids[i : i + 256][row])
                e.append(entry[at])
                least.append(low[at])
                score.append((y[row] * x[at]).sum(1))
        join = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
        return pa.table({"query": join(q, pa.int64()), "entry": join(e, pa.int64()), "least": join(least, pa.int64()), "score": join(score, pa.float64())})

    return run


def _usable(vectors: DataFrame) -> DataFrame:
    v = pick(vectors, "vec_id", "embedding").filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(fine & F.exists("embedding", lambda x: x != 0))
    # Zeros are one value for grouping: -0.0 equals 0.0.
    return v.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")))


def nearest(vectors: DataFrame, queries: str = "vec_id % 20 = 0", *, top: int = 20, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that `queries` selects, the nearest other rows.

    vectors(vec_id long, embedding array<float>); nearness is the inner product in
    double precision, ties go to the smaller vec_id, ranks begin at 1. Null, zero or
    non-finite vectors and those without vec_id take no part. Vectors of different
    lengths have no inner product: each length is a search of its own. Rows that
    repeat a vec_id with the same vector are one row; with another vector they are
    rows of their own, which are candidates for each other. An empty table, and one
    without such queries, gives no rows; other columns aren't looked at.
    """
    usable = _usable(vectors)
    sizes = [r["d"] for r in usable.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    found = [_nearest(usable.filter(F.size("embedding") == d) if len(sizes) > 1 else usable, queries, top, share) for d in sizes]
    return reduce(DataFrame.union, found) if found else _empty(vectors)


def _empty(vectors: DataFrame) -> DataFrame:
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest(usable: DataFrame, queries: str, top: int, share: float) -> DataFrame:
    spark = usable.sparkSession
    empty = _empty(usable)
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    few = usable.dropDuplicates(["embedding", "vec_id"]).withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= top + 1)
    grouped = few.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    grouped = stored(grouped.withColumn("entry", F.monotonically_increasing_id()), "vectors")  # as written, it stays the same
    n = grouped.count()
    if not n:
        return empty
    sample = grouped.orderBy(F.xxhash64("embedding"), "least").limit(TRAINED_ON).select("embedding").toArrow().column("embedding")
    dim = len(sample[0])
    sample = _matrix(sample, dim).astype(np.float64)
    k = int(np.clip(np.ceil(np.sqrt(n / IN_CELL)), *CENTROIDS))
    books = Codebooks(sample, k)
    entries = stored(grouped.select("entry", "least", "ids", "embedding").mapInArrow(_coded(books, dim), "entry long, least long, ids array<long>, embedding array<float>, cell int"), "entries")
    count = np.zeros(k * k, dtype=np.int64)
    for row in entries.groupBy("cell").count().collect():  # CENTROIDS squared at most
        count[row["cell"]] = row["count"]

    wanted = stored(usable.filter(queries).select(F.col("vec_id").alias("query_id"), "embedding").join(grouped.select("embedding", "entry"), "embedding").select("query_id", "entry"), "queries")
    asked = entries.join(wanted.select("entry").distinct(), "entry", "left_semi")
    trial = asked.orderBy(F.xxhash64("embedding"), "least").limit(SAMPLED).select("entry", "embedding").toArrow()
    if not trial.num_rows:
        return empty
    own, y = trial.column("entry").to_numpy(), _matrix(trial.column("embedding"), dim).astype(np.float64)
    true = entries.select("entry", "embedding").mapInArrow(_exact(y, own, books, top), "q int, score double, cell int")
    best = Window.partitionBy("q").orderBy(F.desc("score"))
    true = true.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= top).select("q", "cell").toPandas()
    first, second = books.distances(y)
    needed = []
    for q, cells in true.groupby("q")["cell"]:
        order = np.argsort((first[q][:, None] + second[q][None, :]).ravel(), kind="stable")
        upto = np.empty(len(order), dtype=np.int64)
        upto[order] = np.cumsum(count[order])
        needed += upto[cells.to_numpy()].tolist()
    # The query's own entry counts, too; so many hold a whole result at least.
    visit = n if n <= top + 1 or not needed else max(int(np.ceil(np.quantile(needed, share))), top + 1)

    regions = int(min(k, max(16, n // 32768)))
    of = np.bincount(np.arange(k * k) // k % regions, weights=count, minlength=regions)
    blocks = np.maximum(1, np.ceil(of / ENTRIES)).astype(int).tolist()
    query_blocks = -(-asked.count() // QUERIES)
    schema = "region int, block int, part int, query long, vector array<float>, cells array<int>"
    probes = asked.select("entry", "embedding").repartition(max(8, spark.sparkContext.defaultParallelism)).mapInArrow(_probes(books, count, visit, regions, blocks, query_blocks, dim), schema)
    placed = entries.select("entry", "least", "embedding", "cell").withColumn("region", (F.floor(F.col("cell") / k) % regions).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("entry"), F.element_at(F.lit(blocks), F.col("region") + 1)).cast("int"))
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    on = ["region", "block", "part"]
    found = probes.groupBy(on).cogroup(placed.groupBy(on)).applyInArrow(_rerank(dim, top, k * k), "query long, entry long, least long, score double")

    nearest_first = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    found = found.withColumn("n", F.row_number().over(nearest_first)).filter(F.col("n") <= top + 1)
    own = F.col("query") == F.col("entry")
    found = found.join(entries.select("entry", "ids"), "entry").select(F.col("query").alias("entry"), "score", own.alias("own"), F.explode("ids").alias("vec_id"))
    in_order = Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(in_order)).filter(F.col("n") <= top + 1).groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score", "own"))).alias("all"))
    # Without the query's own row, the first `top` are left.
    out = wanted.distinct().join(found, "entry")
    out = out.select("query_id", F.slice(F.filter("all", lambda x: ~x["own"] | (x["vec_id"] != F.col("query_id"))), 1, top).alias("all"))
    return out.select("query_id", F.posexplode("all").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")

