"""Nested JSON to rows: maps of objects, and events with makers, markets and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_map(df: DataFrame, column: str, fields: dict[str, str], key: str = "id") -> DataFrame:
    """A JSON object of objects to one row per key. Values are read as text and cast by ``fields``; what cannot be cast, or
    is missing, is null."""
    inner = "map<string,string>"
    rows = df.select(F.explode(F.from_json(column, f"map<string,{inner}>")).alias(key, "_o"))
    return rows.select(key, *[F.col("_o")[name].try_cast(kind).alias(name) for name, kind in fields.items()])


QUOTES = "array<struct<id:string,home:string,away:string,start:string,makers:array<struct<key:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>>>"


def explode_quotes(df: DataFrame, column: str) -> DataFrame:
    """(id, home, away, start, maker, market, name, price, point): one row per outcome."""
    rows = df.select(F.explode(F.from_json(column, QUOTES)).alias("e")).select("e.*")
    rows = rows.select("id", "home", "away", "start", F.explode("makers").alias("m")).select("id", "home", "away", "start", F.col("m.key").alias("maker"), F.explode("m.markets").alias("k"))
    return rows.select("id", "home", "away", "start", "maker", F.col("k.key").alias("market"), F.explode("k.outcomes").alias("o")).select("id", "home", "away", "start", "maker", "market", "o.*")


def consensus(quotes: DataFrame) -> DataFrame:
    """Median point over makers for each event, market and outcome, with the number of makers."""
    return quotes.groupBy("id", "market", "name").agg(F.percentile("point", F.lit(0.5)).alias("point"), F.countDistinct("maker").alias("n_makers"))


def json_column(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))
