"""Exact deduplication by content sort, in DataFrame operations only.

Sampled splitters range-partition the rows by the first characters of the text; each range is sorted externally by the
whole text and the identifier, which places equal texts side by side, and every row is compared in full with its
neighbour: a run starts where the two differ. Runs alone make the groups; the SHA-256 is only told, never compared.

First characters that many rows share (copies of one text, or a common heading) would fill one range. Such rows carry a
salt as well, so they spread over many ranges. Their runs are closed salt by salt, and the first row of each run goes to
a second sort by whole text, in which equal neighbours join the runs of one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import save

#: Characters that the splitters compare.
HEAD = 64
#: Rows of one range that may share a head; a head with more is salted. At most ``HOT_HEADS`` heads can have more.
HEAD_ROWS, HOT_HEADS = 500, 10_000


def hot_heads(rows: DataFrame, most: int) -> DataFrame:
    """``head, salts`` of the heads with more than ``most`` rows; their number is bounded by rows / most."""
    counts = rows.groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return save(counts.select("head", F.ceil(F.col("n") / most).cast("int").alias("salts")), "hot-heads")


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, keep: str = "min", head_rows: int = HEAD_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null texts count as empty; texts of any length are compared whole. ``keep`` is "min" or "max": which identifier of
    a group stays. Null identifiers lose to any other; of rows that repeat both text and identifier one stays. Other
    columns of ``docs``, whatever their names, are not read. An empty table gives an empty result.
    """
    best, order = (F.max, F.desc_nulls_last) if keep == "max" else (F.min, F.asc_nulls_last)
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (normalise(body) if normalise else body).alias("body")).withColumn("head", F.substring("body", 1, HEAD))
    hot = hot_heads(rows, max(head_rows, -(-docs.count() // HOT_HEADS)))
    # at most HOT_HEADS rows of HEAD characters
    rows = rows.join(F.broadcast(hot), "head", "left")
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts")), F.lit(0)).cast("int"))
    rows = rows.withColumn("text_sha256", F.sha2("body", 256)).repartitionByRange("head", "salt")
    sorted_texts = Window.partitionBy("head", "salt").orderBy("body", order("doc_id"))
    fresh = F.coalesce(F.col("body") != F.lag("body").over(sorted_texts), F.lit(True))
    rows = rows.withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(sorted_texts))
    first_text = F.when(F.col("fresh") & F.col("salts").isNotNull(), F.col("body"))
    rows = rows.select("doc_id", "text_sha256", "head", "salt", "run", "fresh", F.col("salts").isNotNull().alias("salted"), first_text.alias("body"))
    run = Window.partitionBy("head", "salt", "run")
    rows = rows.withColumns({"keep_id": best("doc_id").over(run), "group_size": F.count(F.lit(1)).over(run)})
    rows = save(rows, "content-sort")
    same_text = Window.partitionBy("body")
    place = F.row_number().over(same_text.orderBy(order("keep_id"), "salt"))
    merged = rows.filter("salted AND fresh").select(
        "head", "salt", "run", best("keep_id").over(same_text).alias("keep_id"), F.sum("group_size").over(same_text).alias("group_size"), (place == 1).alias("winner"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    alone = rows.filter("NOT salted").withColumn("kept", F.col("fresh")).select(*columns)
    spread = rows.filter("salted").drop("keep_id", "group_size", "body").join(merged, ["head", "salt", "run"])
    return alone.unionByName(spread.withColumn("kept", F.col("fresh") & F.col("winner")).select(*columns))
