"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of pieces.

Documents are tokenized and cut into pieces of at most the sequence length. Pieces are dealt to groups at random and
each group is packed alone, so a group's size, not the corpus, bounds a task. The tree holds the largest free capacity
below each node; descending to the left where it suffices finds the first bin that fits in logarithmic time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import importable, save
from .word_cache import cache, sliced

PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Tournament tree over bins; every bin starts with ``capacity`` free."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, math.ceil(math.log2(max(1, bins))))
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, and how much was free there before; that room is then taken."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        had = free[node]
        free[node] = had - size
        leaf, node = node, node // 2
        while node:
            free[node] = max(free[2 * node], free[2 * node + 1])
            node //= 2
        return leaf - self.leaves, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset for each size; ties in size keep their order."""
    order = np.argsort(-sizes, kind="stable")
    tree = CapacityTree(len(sizes), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        bins[i], had = tree.place(size)
        offsets[i] = capacity - had
    return bins, offsets


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, spaces: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``PIECES``: each document's ids and the end id, cut every ``capacity`` ids."""
    importable(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = cache(tokenizer_path, spaces), np.array([end_id], np.uint32)
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches, "text"):
            rows = []
            names = batch.column("doc_id").to_pylist()
            for name, ids in zip(names, encoder.encode(batch.column("text"))):
                ids = np.concatenate([ids, end]).astype("<u4")
                for k in range(0, len(ids), capacity):
                    piece = ids[k : k + capacity]
                    rows.append((row, name, k, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                    row += 1
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, group_pieces: int = 4096, spaces: bool = False, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null texts count as empty and give one piece with the end id; null and repeated identifiers are packed like others.
    Long texts give as many full pieces as they need. Other columns are not read; an empty table gives no rows.
    """
    pieces = save(cut_pieces(docs, tokenizer_path, end_id, capacity, spaces, id_col, text_col), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        rows["sequence_id"], rows["offset"] = (rows["bucket"].to_numpy() << 32) | bins, offsets
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)))
    return dealt.groupBy("bucket").applyInPandas(pack_group, PACKED)
