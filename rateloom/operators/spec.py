"""Projections by specification: a chain of named steps for each position, compiled to columns, with its trace from the same compiler.

A step is an expression over the inputs and the steps before it. A statistic names the steps that its trace shows, the last of
which is its mean, and the family of its law. What is computed and what is told therefore cannot differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    section: str
    name: str
    expr: str
    label: str = ""
    #: an expression whose value is told beside the step's
    detail: str = ""


@dataclass(frozen=True)
class Stat:
    name: str
    family: str  # count, amount or event
    steps: tuple[str, ...]


@dataclass(frozen=True)
class Position:
    name: str
    steps: tuple[Step, ...]
    stats: tuple[Stat, ...]

    def __post_init__(self):
        seen = [s.name for s in self.steps]
        if len(set(seen)) < len(seen) or any(n not in seen for stat in self.stats for n in stat.steps):
            raise ValueError(f"{self.name}: steps have names of their own, and statistics show steps")


def chain(inputs: DataFrame, position: Position) -> DataFrame:
    """The inputs with a column for each step, in order; an input that a step names anew is replaced from there on."""
    rows = inputs
    for step in position.steps:
        rows = rows.withColumn(step.name, F.expr(step.expr).cast("double"))
    return rows


def compile_position(inputs: DataFrame, position: Position, keys: Sequence[str]) -> DataFrame:
    """(keys, stat, family, mean, trace): one row for each statistic; ``trace`` is an array of (section, label, value, detail)."""
    steps = {s.name: s for s in position.steps}
    rows = chain(inputs, position)

    def told(name: str) -> Column:
        step = steps[name]
        detail = F.expr(step.detail).cast("string") if step.detail else F.lit("")
        return F.struct(F.lit(step.section).alias("section"), F.lit(step.label or name.replace("_", " ")).alias("label"), F.col(name).alias("value"), F.coalesce(detail, F.lit("")).alias("detail"))

    stats = [F.struct(F.lit(s.name).alias("stat"), F.lit(s.family).alias("family"), F.col(s.steps[-1]).alias("mean"), F.array(*[told(n) for n in s.steps]).alias("trace")) for s in position.stats]
    return rows.select(*keys, F.explode(F.array(*stats)).alias("s")).select(*keys, "s.*")


def compile_all(inputs: DataFrame, positions: Sequence[Position], column: str, keys: Sequence[str]) -> DataFrame:
    """All positions; ``inputs`` is read once for each, filtered to it, so pass a saved table."""
    out = None
    for position in positions:
        rows = compile_position(inputs.filter(F.col(column) == position.name), position, keys)
        out = rows if out is None else out.unionByName(rows)
    return out


def trace(projections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, stat, step, section, label, value, detail): a row for each step."""
    return projections.select(*keys, "stat", F.posexplode("trace").alias("step", "t")).select(*keys, "stat", F.col("step").cast("long").alias("step"), "t.*")


def chain_sql(inputs: str, position: Position, column: str, given: Sequence[str]) -> str:
    """The chain as nested SELECTs; ``given`` are the inputs' columns."""
    rows, seen = f"(SELECT * FROM {inputs} WHERE {column} = '{position.name}')", set(given)
    for step in position.steps:
        made = f"* REPLACE (({step.expr})::DOUBLE AS {step.name})" if step.name in seen else f"*, ({step.expr})::DOUBLE AS {step.name}"
        rows, seen = f"(SELECT {made} FROM {rows})", seen | {step.name}
    return rows


def compile_sql(inputs: str, positions: Sequence[Position], column: str, keys: Sequence[str], given: Sequence[str]) -> str:
    """(keys, stat, family, step, section, label, value, detail, last) of every statistic's steps."""
    parts = []
    for position in positions:
        steps, rows = {s.name: s for s in position.steps}, chain_sql(inputs, position, column, given)
        for stat in position.stats:
            for k, name in enumerate(stat.steps):
                step = steps[name]
                detail = f"coalesce(({step.detail})::VARCHAR, '')" if step.detail else "''"
                parts.append(f"SELECT {', '.join(keys)}, '{stat.name}' AS stat, '{stat.family}' AS family, {k}::BIGINT AS step, '{step.section}' AS section, '{step.label or name.replace('_', ' ')}' AS label, {name} AS value, {detail} AS detail, {str(k == len(stat.steps) - 1).lower()} AS last FROM {rows}")
    return " UNION ALL ".join(parts)
