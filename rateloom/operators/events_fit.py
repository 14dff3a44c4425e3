"""Chance of an event from two linear rates with bounds, fitted over all rows by Spark.

The rate of a row is ``a max(0, t0 + t1 x1 + t2 x2) + b max(0, t3 + t4 x3 + t5 x4)``, the chance 1 - exp(-rate). Weighted log
loss is minimised under bounds on every coefficient. Each step is one pass over the unrounded rows, for all groups and starts at
once: loss, gradient and expected curvature, 29 sums for each, added in Arrow batches by each task and then by Spark. The step
itself, on six numbers, is made on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import importable, save

#: Bounds of intercepts and slopes, where the search begins, and the least chance that is told (fixed values).
BOUNDS = np.array([(-0.5, 0.5), (0.0, 3.0), (0.0, 3.0)] * 2)
BEGIN = np.array([0.0, 0.4, 0.4] * 2)
#: The positive parts make several minima: each group is fitted from all of these, and the best is told (fixed values).
STARTS = (BEGIN, np.array([0.2, 0.05, 0.05] * 2), np.array([-0.4, 3.0, 0.0, -0.5, 0.8, 0.0]), np.array([-0.5, 0.8, 0.0, -0.4, 3.0, 0.0]))
LEAST_CHANCE = 1e-4
#: Rows of a block: 256 KB.
BLOCK_ROWS = 4096


def parts_of(theta: Sequence[Column]) -> tuple[Column, Column]:
    one = F.greatest(F.lit(0.0), theta[0] + theta[1] * F.col("x1") + theta[2] * F.col("x2"))
    return one, F.greatest(F.lit(0.0), theta[3] + theta[4] * F.col("x3") + theta[5] * F.col("x4"))


def chance(theta: Sequence[Column]) -> Column:
    one, two = parts_of(theta)
    return F.least(F.lit(1 - LEAST_CHANCE), F.greatest(F.lit(LEAST_CHANCE), 1 - F.exp(-(F.col("a") * one + F.col("b") * two))))


def partial_sums(columns: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Weight, loss, gradient (6) and the upper half of the curvature (21), summed over rows whose y, w, a, b, x1 .. x4 are given one below the other."""
    y, w, a, b, *x = columns
    one, two = theta[0] + theta[1] * x[0] + theta[2] * x[1], theta[3] + theta[4] * x[2] + theta[5] * x[3]
    p = -np.expm1(-(a * np.maximum(one, 0.0) + b * np.maximum(two, 0.0)))
    inside = (p > LEAST_CHANCE) & (p < 1 - LEAST_CHANCE)
    p = np.clip(p, LEAST_CHANCE, 1 - LEAST_CHANCE)
    curve = np.where(inside, (1 - p) / p, 0.0)
    a, b = np.where(one > 0, a, 0.0), np.where(two > 0, b, 0.0)
    d = np.stack([a, a * x[0], a * x[1], b, b * x[2], b * x[3]])
    slope = d @ (w * np.where(inside, 1 - y - y * (1 - p) / p, 0.0))
    return np.concatenate([[w.sum(), -(w * (y * np.log(p) + (1 - y) * np.log1p(-p))).sum()], slope, ((d * (w * curve)) @ d.T)[np.triu_indices(6)]])


def blocks_of(rows: DataFrame, group: str) -> DataFrame:
    """(group, block): the rows' y, w, a, b, x1 .. x4 as doubles, one below the other, of at most ``BLOCK_ROWS`` rows of a group in
    each block. Every step of a fit reads all rows, and blocks reach a worker at the price of a copy."""
    importable(rows.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, list] = {}

        def out(g: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({group: pa.array([g], pa.string()), "block": pa.array([np.concatenate(open_.pop(g), axis=1).tobytes()], pa.binary())})

        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            place = groups.indices.to_numpy(zero_copy_only=False)
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            for code, g in enumerate(groups.dictionary.to_pylist()):
                own = values[:, place == code]
                for k in range(0, own.shape[1], BLOCK_ROWS):
                    more = own[:, k : k + BLOCK_ROWS]
                    if sum(x.shape[1] for x in open_.get(g, [])) + more.shape[1] > BLOCK_ROWS:
                        yield out(g)
                    open_.setdefault(g, []).append(more)
        yield from [out(g) for g in list(open_)]

    read = rows.filter(F.col(group).isNotNull()).select(group, *[F.col(c).cast("double").alias(c) for c in ("y", "w", "a", "b", "x1", "x2", "x3", "x4")])
    return save(read.mapInArrow(put, f"{group} string, block binary"), "event-blocks")


def sums_at(blocks: DataFrame, group: str, thetas: dict) -> dict:
    """(group, start) to (loss, gradient, curvature) per unit of weight, at the coefficients of each. Blocks are read once for all
    starts; a task hands on one row of sums for each group and start that it has met."""
    wanted: dict[str, list] = {}
    for (g, k), t in thetas.items():
        wanted.setdefault(g, []).append((k, t))
    names = [f"s{i}" for i in range(29)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for g, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(block.as_buffer()).reshape(8, -1)
                for k, t in wanted[g]:
                    sums[g, k] = sums.get((g, k), 0.0) + partial_sums(own, t)
        if sums:
            keys, found = list(sums), np.array(list(sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), *map(pa.array, found.T.copy())], names=[group, "_start", *names])

    read = blocks.filter(F.col(group).isin(list(wanted))).select(group, "block")
    found = read.mapInArrow(add, f"{group} string, _start int, " + ", ".join(f"{n} double" for n in names)).groupBy(group, "_start").agg(*[F.sum(n).alias(n) for n in names])
    out = {}
    for g, k, *sums in found.collect():
        w, loss, slope, upper = sums[0], sums[1], np.array(sums[2:8]), np.zeros((6, 6))
        upper[np.triu_indices(6)] = sums[8:]
        out[g, k] = (loss / w, slope / w, (upper + np.triu(upper, 1).T) / w)
    return out


def units(curve: np.ndarray) -> np.ndarray:
    """Of each coefficient the root of its curvature, 1 where it has none."""
    own = np.sqrt(np.maximum(np.diag(curve), 0.0))
    return np.where(own > 0, own, 1.0)


def step_of(theta: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Newton's step over the coefficients that no bound holds, each in units of its own curvature: shares get small and events of a
    team many as tables grow, and what steadies the inverse must not outweigh a coefficient for its unit."""
    low, high = BOUNDS.T
    free = ~(((theta <= low) & (slope > 0)) | ((theta >= high) & (slope < 0)))
    step = np.zeros(6)
    if free.any():
        unit = units(curve)[free]
        own = curve[np.ix_(free, free)] / np.outer(unit, unit)
        step[free] = -np.linalg.solve(own + 1e-8 * np.eye(free.sum()), slope[free] / unit) / unit
    return step


def slope_step(theta: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Down the gradient, each coefficient by its own curvature: where Newton's step does not help, as at the edge of a positive part."""
    return -slope / units(curve) ** 2


def fit_events(rows: DataFrame, group: str, rounds: int = 80, tolerance: float = 1e-10) -> dict[str, tuple[np.ndarray, float]]:
    """group to (coefficients, loss), the best over ``STARTS``. ``rows``: (group: string, y, w, a, b, x1 .. x4), saved, without nulls;
    ``group`` has few values. A step that does not lower the loss is cut to a quarter; where no part of Newton's step helps, the gradient is tried."""
    blocks = blocks_of(rows, group)
    names = [r[0] for r in blocks.select(group).distinct().collect()]
    keys = [(g, k) for g in names for k in range(len(STARTS))]
    theta = {key: STARTS[key[1]].copy() for key in keys}
    held = sums_at(blocks, group, theta) if keys else {}
    step = {key: step_of(theta[key], *held[key][1:]) for key in keys}
    scale, plain, small, open_ = dict.fromkeys(keys, 1.0), dict.fromkeys(keys, False), dict.fromkeys(keys, 0), set(keys)
    for _ in range(rounds):
        if not open_:
            break
        tried = {key: np.clip(theta[key] + scale[key] * step[key], *BOUNDS.T) for key in open_}
        found = sums_at(blocks, group, tried)
        for key in list(open_):
            gain = held[key][0] - found[key][0]
            if gain > 0:
                theta[key], held[key], scale[key] = tried[key], found[key], 1.0
                small[key] = small[key] + 1 if gain < tolerance else 0
                plain[key] = plain[key] and gain < tolerance
                if small[key] > 2:
                    open_.discard(key)
            else:
                scale[key] /= 4
                if scale[key] * np.abs(step[key] * units(held[key][2])).max() >= 1e-7:
                    continue
                if plain[key]:
                    open_.discard(key)
                plain[key], scale[key] = True, 1.0
            step[key] = (slope_step if plain[key] else step_of)(theta[key], *held[key][1:])
    best = {g: min((k for k in keys if k[0] == g), key=lambda k: held[k][0]) for g in names}
    return {g: (theta[k], held[k][0]) for g, k in best.items()}
