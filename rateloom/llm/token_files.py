"""Token ids as Arrow stream files of fixed-size-list batches.

Documents are range-partitioned and sorted by identifier. Each partition becomes one Arrow IPC stream whose batches
hold equal-length sequences (``ids``) with masks (``mask``: false where the last sequence is padded), and a second
stream with the place of each document. Every batch but the last has the same byte length, so sequence ``i`` is found
by arithmetic and read from a memory map without copying. Files are written under another name and moved into place,
so a task that runs again replaces its file by the same bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import importable, new_path, save
from .word_cache import cache, sliced

MANIFEST = "part long, path string, n_docs long, n_tokens long"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(seq_len: int, wide: bool) -> pa.Schema:
    ids = pa.list_(pa.field("item", pa.uint32() if wide else pa.uint16(), nullable=False), seq_len)
    return pa.schema([pa.field("ids", ids, nullable=False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), seq_len), nullable=False)], metadata={"seq_len": str(seq_len)})


class SequenceWriter:
    """Cuts a run of ids into sequences of ``seq_len`` and writes them ``rows`` to a batch."""

    def __init__(self, sink, seq_len: int, rows: int, wide: bool):
        self.schema, self.seq_len, self.rows = sequence_schema(seq_len, wide), seq_len, rows
        self.writer, self.kept, self.n, self.total = pa.ipc.new_stream(sink, self.schema), [], 0, 0

    def _batch(self, ids: np.ndarray) -> None:
        n = -(-len(ids) // self.seq_len) * self.seq_len
        mask = np.zeros(n, bool)
        mask[: len(ids)] = True
        kind = self.schema.field("ids").type
        full = np.zeros(n, np.uint32 if kind.value_type == pa.uint32() else np.uint16)
        full[: len(ids)] = ids
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), type=t.type) for x, t in ((full, self.schema.field("ids")), (mask, self.schema.field("mask")))], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.kept.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= (size := self.rows * self.seq_len):
            run = np.concatenate(self.kept)
            for k in range(0, len(run) - size + 1, size):
                self._batch(run[k : k + size])
            run = run[len(run) // size * size :]
            self.kept, self.n = [run], len(run)

    def close(self) -> None:
        if self.n:
            self._batch(np.concatenate(self.kept))
        self.writer.close()


class SequenceFile:
    """Random access to the sequences of one file: ``ids(i)`` and ``mask(i)`` are views into the memory map."""

    def __init__(self, path: str):
        self.source = pa.memory_map(path)
        self.schema = pa.ipc.read_schema(self.source)
        self.first = self.source.tell()
        batch = self._read(self.first)
        self.rows, self.step = (batch.num_rows, self.source.tell() - self.first) if batch else (0, 0)
        size = self.source.size() - self.first
        full = max(0, (size - 8) // self.step) if batch else 0
        tail = self._read(self.first + full * self.step) if batch else None
        self.n = full * self.rows + (tail.num_rows if tail else 0)

    def _read(self, at: int) -> pa.RecordBatch | None:
        self.source.seek(at)
        try:
            return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        except EOFError:
            return None

    def __len__(self) -> int:
        return self.n

    def _row(self, name: str, i: int):
        batch = self._read(self.first + i // self.rows * self.step)
        k, size = i % self.rows, self.schema.field(name).type.list_size
        return batch.column(name).flatten().slice(k * size, size)

    def ids(self, i: int) -> np.ndarray:
        return self._row("ids", i).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        return self._row("mask", i)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, spaces: bool = True, seq_len: int = 1024, rows_per_batch: int = 128, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files below ``path`` (default: the shared scratch folder); one row per file: ``part, path, n_docs, n_tokens``.

    ``wide`` stores 32-bit ids, else 16-bit ones, which hold vocabularies of up to 65,536 ids. Null texts count as empty
    and get the end id alone; null identifiers come first; rows that repeat an identifier are all written, in any order
    among themselves. Other columns are not read. An empty table makes no files.
    """
    spark = docs.sparkSession
    importable(spark)
    path = path or new_path(spark, "tokens")
    pafs.FileSystem.from_uri(path)[0].create_dir(pafs.FileSystem.from_uri(path)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, place = cache(tokenizer_path, spaces), None, 0
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        names = [f"{root}/tokens-{task.partitionId():06d}{x}.arrows" for x in ("", ".docs")]
        own = [f"{n}.{task.taskAttemptId()}" for n in names]
        n_docs, end = 0, np.array([end_id], np.uint32)
        for batch in sliced(batches, "text"):
            if out is None:
                sinks = [fs.open_output_stream(x) for x in own]
                out, listing = SequenceWriter(sinks[0], seq_len, rows_per_batch, wide), pa.ipc.new_stream(sinks[1], DOCS)
            sizes = []
            for ids in encoder.encode(batch.column("text")):
                if not wide and len(ids) and int(ids.max()) > 0xFFFF:
                    raise ValueError("these ids need wide=True")
                out.add(ids)
                out.add(end)
                sizes.append(len(ids) + 1)
            sizes = np.array(sizes, np.int64)
            listing.write_batch(pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(place + np.cumsum(sizes) - sizes), pa.array(sizes)], schema=DOCS))
            place += int(sizes.sum())
            n_docs += len(sizes)
        if out is not None:
            out.close()
            listing.close()
            for sink, tmp, name in zip(sinks, own, names):
                sink.close()
                fs.move(tmp, name)
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [f"{path}/{names[0].rpartition('/')[2]}"], "n_docs": [n_docs], "n_tokens": [place]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    return save(rows.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files alone: ``doc_id, start, n_tokens, ids_crc32``; ``start`` counts the ids of all documents before it.

    The manifest has one row per file; only that small table is ordered as a whole.
    """
    importable(manifest.sparkSession)
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    n = max(1, min(manifest.count(), 100_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, at = pafs.FileSystem.from_uri(name)
                local = isinstance(fs, pafs.LocalFileSystem)
                source = pa.memory_map(at) if local else fs.open_input_file(at)
                listing = fs.open_input_file(at.removesuffix(".arrows") + ".docs.arrows")
                runs = _ids(source)
                have = np.zeros(0, np.uint16)
                for docs in pa.ipc.open_stream(listing):
                    sums = []
                    for n_tokens in docs.column("n_tokens").to_pylist():
                        crc, left = 0, n_tokens
                        while left:
                            if not len(have):
                                have = next(runs)
                            crc = zlib.crc32(have[:left].astype("<u4").tobytes(), crc)
                            have, left = have[left:], left - min(left, len(have))
                        sums.append(crc)
                    start = pa.array(docs.column("start").to_numpy() + base)
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                source.close()

    return files.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ids(source) -> Iterator[np.ndarray]:
    """The unmasked ids of a file, batch by batch; whole batches are not copied."""
    for batch in pa.ipc.open_stream(source):
        ids, mask = batch.column("ids").flatten().to_numpy(), batch.column("mask").flatten()
        n = mask.true_count
        if n:
            yield ids[:n]
