"""The corpus pipeline: raw documents to packed training sequences.

Toxic documents go, of equal texts one stays, of near copies one stays, documents that repeat a benchmark item go, and the
rest is tokenized and packed. Each stage is one of the operators of ``rateloom.llm`` over all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateloom.llm.content_sort import content_sort
from rateloom.llm.decontam_cgk import without_leaks
from rateloom.llm.ffd_packing import pack
from rateloom.llm.queries import TOXIC, WORD_TOKENIZER
from rateloom.llm.simhash_gray import drop_near_duplicates
from rateloom.llm.toxicity_fst import fit_toxicity, held_out, without_toxic
from rateloom.shared import save, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_rows(docs: DataFrame) -> DataFrame:
    """A saved table of the rows with a key of their own, ``_row``: identifiers may be null or repeated, and decide for no other row."""
    return save(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the limit go; the model is fitted on the labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    return without_toxic(docs.select(*COLUMNS), fit_toxicity(docs, labels), TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, one row without doc_id only where none has any."""
    rows = with_rows(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("place")
    kept = save(content_sort(rows.select(place, "text"), id_col="place", keep="min").filter("kept").select("doc_id._row"), "kept")
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a similarity of 0.8 or more over five-word shingles the smallest doc_id stays."""
    return drop_near_duplicates(with_rows(docs), row_col="_row").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that repeats a benchmark item go."""
    return without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens."""
    return pack(docs, WORD_TOKENIZER, end_id=2, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_rest),
]

#: The toxicity, near-copy and decontamination stages have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
