"""A catalogue of Parquet sources, read by name with aligned schemas and exposed as views."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import rename_guarded


@dataclass(frozen=True)
class Source:
    """``pattern`` is a path or glob below the root; ``required`` columns must be there after renaming; rows of the column
    ``season`` before ``min_season`` are left out."""

    view: str
    pattern: str
    required: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)
    description: str = ""
    min_season: int | None = None
    season: str = "season"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches a path or glob, in whatever file system it names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return bool(found)


def footer_count(spark: SparkSession, path: str) -> int:
    """Rows of Parquet files; no column is read, so the footers answer."""
    return spark.read.parquet(path).select().count()


def read_aligned(spark: SparkSession, path: str) -> DataFrame:
    """All files of a glob, united by column name; a column that is missing from a file is null there. Where files disagree
    on a column's type, they are read one by one and the column becomes text."""
    try:
        df = spark.read.option("mergeSchema", True).parquet(path)
        df.schema  # noqa: B018  merged here
        return df
    except Exception as e:
        if "CANNOT_MERGE" not in str(e) and "Failed merging" not in str(e) and "merge" not in str(e).lower():
            raise
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = [str(s.getPath()) for s in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)]
    each = [spark.read.parquet(f) for f in sorted(files)]
    kinds: dict[str, set[str]] = {}
    for df in each:
        for c, t in df.dtypes:
            kinds.setdefault(c, set()).add(t)
    mixed = [c for c, t in kinds.items() if len(t) > 1]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumns({c: F.col(c).cast("string") for c in mixed if c in df.columns}) for df in each])


class Catalogue:
    """Views over the sources that have files; partial data stays usable."""

    def __init__(self, spark: SparkSession, root: str, sources: list[Source]):
        self.spark, self.root, self.sources = spark, root.rstrip("/"), {s.view: s for s in sources}

    def refresh(self) -> dict[str, bool]:
        """Create or replace each source's view, drop those without files; returns which are there."""
        there = {}
        for name, source in self.sources.items():
            path = f"{self.root}/{source.pattern}"
            there[name] = exists(self.spark, path)
            if there[name]:
                self.load(name).createOrReplaceTempView(name)
            else:
                self.spark.catalog.dropTempView(name)
        return there

    def load(self, name: str) -> DataFrame:
        source = self.sources[name]
        df = rename_guarded(read_aligned(self.spark, f"{self.root}/{source.pattern}"), source.rename)
        if missing := [c for c in source.required if c not in df.columns]:
            raise ValueError(f"{name}: required columns are missing: {', '.join(missing)}")
        return df if source.min_season is None else df.filter(F.col(source.season) >= source.min_season)

    def counts(self) -> dict[str, int]:
        """Rows of each view, -1 where there are no files."""
        return {n: self.spark.table(n).count() if self.spark.catalog.tableExists(n) else -1 for n in self.sources}


def first_available(spark: SparkSession, view: str, *paths: str) -> DataFrame:
    """The view if it is there, else the first path that can be read."""
    if spark.catalog.tableExists(view):
        return spark.table(view)
    for path in paths:
        try:
            if exists(spark, path):
                return spark.read.parquet(path)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"neither view {view} nor any of {paths}")


def current_period(schedule: DataFrame, season: str = "season", week: str = "week", score: str = "score") -> DataFrame:
    """The earliest (season, week) with an open score; where none is open, the last one played."""
    opened = F.min(F.when(F.col(score).isNull(), F.struct(season, week)))
    return schedule.agg(F.coalesce(opened, F.max(F.struct(season, week))).alias("p")).select(F.col(f"p.{season}"), F.col(f"p.{week}"))


def resolve_period(spark: SparkSession, schedule: DataFrame | None, persisted: DataFrame | None, today: str | None = None) -> DataFrame:
    """One row (season, week, origin): from the schedule, else from what was persisted last (season, week, at), else from the calendar,
    in which a season starts in March and its weeks in September. Empty and absent sources are passed over."""
    day = F.to_date(F.lit(today)) if today else F.current_date()
    season = F.year(day) - (F.month(day) < 3).cast("int")
    week = F.greatest(F.lit(1), F.least(F.lit(18), F.floor(F.datediff(day, F.make_date(season, F.lit(9), F.lit(1))) / 7) + 1))
    rows = spark.range(1).select(season.cast("long").alias("season"), week.cast("long").alias("week"), F.lit("calendar").alias("origin"), F.lit(3).alias("place"))
    if persisted is not None:
        last = persisted.agg(F.max_by(F.struct("season", "week"), "at").alias("p")).filter("p IS NOT NULL")
        rows = rows.unionByName(last.select("p.season", "p.week", F.lit("persisted").alias("origin"), F.lit(2).alias("place")))
    if schedule is not None:
        found = current_period(schedule).filter("season IS NOT NULL")
        rows = rows.unionByName(found.select("season", "week", F.lit("schedule").alias("origin"), F.lit(1).alias("place")))
    return rows.orderBy("place").limit(1).select("season", "week", "origin")
