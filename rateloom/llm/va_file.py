"""Exact top-k search by inner product over vector-approximation files.

Vectors lie in shards. A shard's row holds one byte for each component, the cell that the component falls in, beside the
exact vectors; Parquet stores the two apart, so a scan of the cells reads no vector. Bounds of a score follow from the
cells alone: a positive component of the query takes the cell's upper end for the upper bound, a negative one the lower end.

First the cells are scanned for the k highest lower bounds of each query, over all shards: the least of them is a score that
the k-th result is sure to reach. Then each shard reads exact vectors in the order of their upper bounds, until the next
bound is below that limit and below the k-th score found so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import importable, save

#: Cells of a component; vectors of the sample that places their ends (bounds hold wherever the ends are).
CELLS, FIT_ROWS = 64, 5_000
#: Components of a shard, rows at most; queries searched together, and queries whose bounds are held at once.
SHARD_SIZE, SHARD_ROWS, BLOCK_QUERIES, STEP = 1 << 20, 8192, 4096, 256
#: Exact vectors read at first; then twice as many each time.
READ = 32

SHARDS = "shard string, d int, ids array<long>, cells binary, low binary, high binary, kind string, vectors binary"
QUERY = "shard string, place int, query_id long, vector array<double>"
LOWER = "query int, lower double"
FOUND = "query int, query_id long, vec_id long, score long"
WIDEST = (1 << 63) - 1


def whole_numbers(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[list, np.ndarray]]:
    """Identifiers and floor(scale * component) of the vectors that take part, lengths apart."""
    lists = batch.column("vector")
    ids, values = batch.column("vec_id"), lists.flatten()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * x)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = np.asarray(lists.is_valid().to_numpy(zero_copy_only=False), bool) & (bad[ends] == bad[ends - sizes])
    for d in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == d))
        yield ids.take(pa.array(rows)).to_pylist(), x[(ends[rows] - d)[:, None] + np.arange(d)]


def fit_ends(sample: list[np.ndarray]) -> np.ndarray:
    """Inner ends of the cells, a row for each component, by quantiles of the sample; the last row, over all components, serves further ones."""
    share = np.arange(1, CELLS) / CELLS
    widest = max(map(len, sample), default=0)
    by = [np.array([v[j] for v in sample if len(v) > j]) for j in range(widest)]
    every = np.concatenate(sample) if widest else np.zeros(1)
    return np.ceil(np.stack([np.quantile(x, share) for x in [*by, every]]))


def cells_of(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j in range(x.shape[1]):
        out[:, j] = np.searchsorted(ends[min(j, len(ends) - 1)], x[:, j], side="right")
    return out


def cell_bounds(cells: np.ndarray, low: np.ndarray, high: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole number of each component's cell; the shard's own range closes the outer cells."""
    d = cells.shape[1]
    inner = ends[np.minimum(np.arange(d), len(ends) - 1)]
    lows = np.maximum(np.concatenate([low[:, None], inner], axis=1), low[:, None])
    highs = np.minimum(np.concatenate([inner - 1, high[:, None]], axis=1), high[:, None])
    each = np.arange(d)
    return lows[each, cells], highs[each, cells]


def bounds(queries: np.ndarray, lows: np.ndarray, highs: np.ndarray, upper: bool) -> np.ndarray:
    """Bounds of all scores; sums that doubles cannot hold exactly get some room."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        out = up @ highs.T + down @ lows.T if upper else up @ lows.T + down @ highs.T
        size = np.abs(queries).sum(axis=1, keepdims=True) * max(np.abs(lows).max(initial=0), np.abs(highs).max(initial=0))
        out += np.where(size < 2.0**52, 0, size * 1e-9) * (1 if upper else -1)
    return np.clip(np.nan_to_num(out, copy=False, nan=np.inf if upper else -np.inf), -float(WIDEST), float(WIDEST))


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; what 64 bits cannot hold is told as the nearest number that they can."""
    if float(np.abs(vectors).max(initial=0)) * float(np.abs(query).sum()) < 2.0**53:
        return (vectors.astype(np.float64) @ query).astype(np.int64)
    q = [int(v) for v in query.tolist()]
    sums = [sum(int(a) * b for a, b in zip(row, q)) for row in vectors.tolist()]
    return np.array([max(-WIDEST, min(WIDEST, s)) for s in sums], np.int64)


def write_shards(vectors: DataFrame, scale: int, ends: np.ndarray) -> DataFrame:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        number = 0

        def shard(ids: list, x: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            low, high = (x.min(axis=0), x.max(axis=0)) if len(x) else (x, x)
            kind = "<i2" if np.abs(x).max(initial=0) < 32768 else "<f8"
            binary = lambda a: pa.array([a.tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{TaskContext.get().partitionId()}-{number}"]), pa.array([x.shape[1]], pa.int32()), pa.array([ids], pa.list_(pa.int64())), binary(cells_of(x, ends)), binary(low), binary(high), pa.array([kind]), binary(x.astype(kind))],
                names=["shard", "d", "ids", "cells", "low", "high", "kind", "vectors"])

        for batch in batches:
            for ids, x in whole_numbers(batch, scale):
                d, most = x.shape[1], max(1, min(SHARD_ROWS, SHARD_SIZE // max(1, x.shape[1])))
                names, parts = held.setdefault(d, [[], []])
                names += ids
                parts.append(x)
                if len(names) >= most:
                    whole = np.concatenate(parts)
                    full = len(whole) // most * most
                    for a in range(0, full, most):
                        yield shard(names[a : a + most], whole[a : a + most])
                    held[d] = [names[full:], [whole[full:]]]
        for names, parts in held.values():
            if names:
                yield shard(names, np.concatenate(parts))

    return save(vectors.mapInArrow(write, SHARDS), "va-file")


def read_cells(row: dict) -> np.ndarray:
    return np.frombuffer(row["cells"], np.uint8).reshape(row["n"], row["d"])


class Queries:
    """A block of queries, by length of the vector."""

    def __init__(self, rows: list):
        self.names = [r.query_id for r in rows]
        self.at = {(r.shard, r.place): k for k, r in enumerate(rows)}
        by: dict[int, list[int]] = {}
        for k, r in enumerate(rows):
            by.setdefault(len(r.vector), []).append(k)
        self.of = {d: (np.array(ks), np.array([rows[k].vector for k in ks], np.float64).reshape(len(ks), d)) for d, ks in by.items()}

    def own(self, shard: str, n: int) -> dict[int, int]:
        """Places of the shard that are queries themselves."""
        return {k: p for p in range(n) if (k := self.at.get((shard, p))) is not None}

    def steps(self, row: dict, ends: np.ndarray, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of some queries, their vectors, and their bounds over the shard, minus infinity for the query itself."""
        if row["d"] not in self.of:
            return
        lows, highs = cell_bounds(read_cells(row), np.frombuffer(row["low"]), np.frombuffer(row["high"]), ends)
        own, (numbers, vectors) = self.own(row["shard"], row["n"]), self.of[row["d"]]
        for a in range(0, len(numbers), STEP):
            some, x = numbers[a : a + STEP], vectors[a : a + STEP]
            out = bounds(x, lows, highs, upper)
            for k, number in enumerate(some.tolist()):
                if number in own:
                    out[k, own[number]] = -np.inf
            yield some, x, out


class Nearest:
    """The best ``k`` rows so far: higher scores first, then smaller identifiers, null (``WIDEST`` in the order) last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def worst(self) -> tuple[float, int]:
        return self.rows[-1][:2] if len(self.rows) == self.k else (-np.inf, WIDEST)

    def offer(self, scores: np.ndarray, order: np.ndarray, ids: list) -> None:
        best = np.lexsort((order, -scores))[: self.k].tolist()
        rows = self.rows + [(int(scores[j]), int(order[j]), ids[j]) for j in best]
        self.rows = sorted(rows, key=lambda r: (-r[0], r[1], r[2] is None))[: self.k]


def search_shard(row: dict, queries: Queries, ends: np.ndarray, floor: np.ndarray, held: list[Nearest], met: dict | None = None) -> None:
    """Read exact vectors in the order of their upper bounds, until none can be among the first any more. ``met`` counts vectors: those there are, and those read."""
    vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(row["n"], row["d"])
    ids = np.array([WIDEST if i is None else i for i in row["ids"]], np.int64)
    for some, x, upper in queries.steps(row, ends, upper=True):
        for k, number in enumerate(some.tolist()):
            near, bound = held[number], upper[k]
            score, name = near.worst()
            kept = np.flatnonzero((bound >= floor[number]) & ((bound > score) | (bound == score) & (ids < name)) & (bound > -np.inf))
            order = kept[np.argsort(-bound[kept], kind="stable")]
            at, step = 0, READ
            while at < len(order):
                some_rows = order[at : at + step]
                score, name = near.worst()
                some_rows = some_rows[(bound[some_rows] > score) | (bound[some_rows] == score) & (ids[some_rows] < name)]
                if not len(some_rows) and bound[order[at]] < score:
                    break
                if len(some_rows):
                    near.offer(exact_scores(vectors[some_rows], x[k]), ids[some_rows], [row["ids"][p] for p in some_rows.tolist()])
                at, step = at + step, 2 * step
                if met is not None:
                    met["read"] = met.get("read", 0) + len(some_rows)
            if met is not None:
                met["all"] = met.get("all", 0) + row["n"]


def nearest_rows(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose identifier is divisible by ``every`` the ``k`` other rows of highest score: ``query_id, rank, vec_id, score``.

    Scores are inner products of floor(``scale`` * component). Vectors that are null, or hold a null or a component that is
    not finite, take no part; vectors are compared with those of their own length. Equal scores go to the smaller
    identifier, a null one last; rows that repeat an identifier are rows of their own, as candidates and as queries. Scores
    beyond 64 bits count as the nearest number of 64 bits. Other columns are not read; an empty table gives no rows.

    Queries are searched in blocks of about ``BLOCK_QUERIES``, each against all shards; a block and its limits are all that
    comes to the driver. Ends of cells are quantiles of at most ``FIT_ROWS`` vectors; every row is filed and searched.
    """
    spark = vectors.sparkSession
    importable(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sample = rows.filter(usable).orderBy(F.xxhash64("vec_id", "vector")).limit(FIT_ROWS).select("vector").collect()
    ends = fit_ends([np.floor(scale * np.array(r.vector, np.float64)) for r in sample])
    shards = write_shards(rows, scale, ends)
    cells = shards.select("shard", "d", F.size("ids").alias("n"), "cells", "low", "high")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places = [p for p, i in enumerate(row["ids"]) if i is not None and i % every == 0]
                x = np.frombuffer(row["vectors"], row["kind"]).reshape(len(row["ids"]), row["d"])
                if places:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["shard"]] * len(places)), pa.array(places, pa.int32()), pa.array([row["ids"][p] for p in places], pa.int64()), pa.array([x[p].astype(np.float64) for p in places], pa.list_(pa.float64()))], names=["shard", "place", "query_id", "vector"])

    queries = save(shards.select("shard", "d", "ids", "kind", "vectors").mapInArrow(pick, QUERY), "va-queries")
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    found = []
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("shard", "place"), F.lit(blocks)) == b) if blocks > 1 else queries
        found.append(_search_block(shards, cells, Queries(own.collect()), ends, k))
        if blocks > 1:
            found[-1] = save(found[-1], "va-found")
    return reduce(DataFrame.unionByName, found)


def _search_block(shards: DataFrame, cells: DataFrame, queries: Queries, ends: np.ndarray, k: int) -> DataFrame:
    spark = shards.sparkSession
    shared = spark.sparkContext.broadcast((queries, ends))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ends = shared.value
        best = np.full((len(queries.names), k), -np.inf)
        for batch in batches:
            for row in batch.to_pylist():
                for some, _, lower in queries.steps(row, ends, upper=False):
                    both = np.concatenate([best[some], lower], axis=1)
                    best[some] = -np.partition(-both, k - 1, axis=1)[:, :k]
        query, place = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(best[query, place])], names=["query", "lower"])

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))
    limits = cells.mapInArrow(lowest, LOWER).withColumn("place", place).filter(F.col("place") == k).select("query", "lower").collect()
    floor = np.full(len(queries.names), -np.inf)
    for query, lower in limits:  # one row for each query of the block
        floor[query] = lower
    limit = spark.sparkContext.broadcast(floor)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ends = shared.value
        held = [Nearest(k) for _ in queries.names]
        for batch in batches:
            for row in batch.to_pylist():
                search_shard(row | {"n": len(row["ids"])}, queries, ends, limit.value, held)
        out = [(number, queries.names[number], vec_id, score) for number, near in enumerate(held) for score, _, vec_id in near.rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["query", "query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    best = shards.mapInArrow(search, FOUND).withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
