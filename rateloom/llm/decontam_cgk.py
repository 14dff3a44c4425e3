"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are runs of words. A CGK walk reads a run with a random step table: at each step it emits the word under
the pointer and, by a coin that depends on the step and the word, moves on or stays. Runs at a small edit distance come
out at a small Hamming distance with good probability. Each repetition samples a few steps as a key; a window and an item
that agree on any key become a candidate. The number of repetitions follows from the target recall and, for each length of
items, from how well runs with just the most edits agree, measured when the index is built. Candidates are verified by the
exact edit distance, so every reported pair is real.

The benchmark is the query set: its items go to every task in blocks of a checked size, and each document is read where it
lies, so nothing is exchanged. A benchmark of several blocks is searched block by block: each block's result is saved, and its
index taken back, before the next is built, so no more than one block is held anywhere; the documents are read once for each. A window that cannot reach the similarity is passed over before it is embedded: k edits
leave one of any k + 1 pieces of an item whole, so its window has a short run of the item's words, and few words that occur
in no item. These bounds lose nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import importable, save
from .word_cache import sliced

#: Trimmed from words.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’„…–—"
#: Items of one block, and bytes of items that one block may hold.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 64 << 20
FOUND = "doc_id long, item_id long, start_word long, n_words long, edits long, similarity double"


def words_of(text: str) -> list[str]:
    return [w for w in words_in(pa.array([text]))[0].to_pylist() if w]


def words_in(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words, in lower case and without outer punctuation (maybe empty then), and where each text starts, with the end."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    parts = cut.flatten().dictionary_encode()
    words = pc.utf8_trim(pc.utf8_lower(parts.dictionary), characters=PUNCTUATION)
    return pa.DictionaryArray.from_arrays(parts.indices, words), np.asarray(cut.offsets) - cut.offsets[0].as_py()


class CgkIndex:
    """Keys of all items: ``walks`` walks, and as many keys of ``sampled`` steps in each as an item's length needs."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float = 0.95, sampled: int = 3, walks: int = 6, seed: int = 5):
        self.similarity, self.sampled = similarity, sampled
        self.items = [(i, words_of(t or "")) for i, t in items]
        self.items = [(i, w) for i, w in self.items if w]
        self.codes: dict[str, int] = {}
        for _, words in self.items:
            for w in words:
                self.codes.setdefault(w, len(self.codes) + 1)
        self.runs = [np.array([self.codes[w] for w in words], np.int32) for _, words in self.items]
        self.lengths = sorted({len(r) for r in self.runs})
        rng = np.random.default_rng(seed)
        self.coins = rng.integers(0, 1 << 62, walks)
        self.walks = walks
        self.tables = {}
        self.grams = self._pieces()
        for n in self.lengths:
            own = [k for k, r in enumerate(self.runs) if len(r) == n]
            # steps past the end of most walks say nothing: sample the first 3n/2
            reach = max(sampled, 3 * n // 2)
            keys = self.keys_needed(n, reach, recall, np.random.default_rng([seed, n]))
            steps = [[np.sort(rng.choice(reach, sampled, replace=False)) for _ in range(keys)] for _ in range(walks)]
            codes = np.concatenate([self.runs[k] for k in own])
            starts = np.arange(len(own)) * n
            padded, tables = np.append(codes, -1), []
            for w in range(walks):
                for s, key in zip(steps[w], self._keys(padded, starts, starts + n, w, steps[w])):
                    order = np.argsort(key, kind="stable")
                    tables.append((key[order], np.array(own)[order]))
            self.tables[n] = (steps, tables)

    def keys_needed(self, n: int, reach: int, recall: float, rng: np.random.Generator, pairs: int = 200) -> int:
        """Keys for each walk with which runs of ``n`` words and windows with the most edits, made up at random, meet at the target recall."""
        width, most = 2 * n + 2, self._most(n)
        runs = rng.integers(1, 1 << 30, (pairs, width)).astype(np.int32)
        edited = np.zeros((pairs, width), np.int32)
        for k in range(pairs):
            run = runs[k].tolist()
            for place in sorted(rng.choice(n, min(most, n), replace=False).tolist(), reverse=True):
                run[place : place + 1] = ([-2 - place], [], [run[place], -2 - place])[rng.integers(3)]
            edited[k] = (run + [0] * width)[:width]
        agree = np.zeros((self.walks, pairs))
        for w in range(self.walks):
            sides = []
            for x in (runs, edited):
                starts = np.arange(pairs) * width
                sides.append(self._emitted(np.append(x.reshape(-1), -1), starts, starts + n, w, reach))
            agree[w] = (sides[0] == sides[1]).mean(axis=0)
        miss = np.prod(1 - agree**self.sampled, axis=0)
        return next((m for m in range(1, 64) if 1 - (miss**m).mean() >= recall), 64)

    def _most(self, n: int) -> int:
        """Edits that an item of ``n`` words may have."""
        return int((1 - self.similarity) * n + 1e-9)

    def _pieces(self) -> dict[int, tuple[np.ndarray, dict[int, np.ndarray]]]:
        """For each size of pieces: sorted hashes of the items' runs of so many words, and which of them each item length has."""
        own: dict[int, dict[int, np.ndarray]] = {}
        for n in self.lengths:
            size = max(1, n // (self._most(n) + 1))
            own.setdefault(size, {})[n] = np.unique(np.concatenate([runs_hashed(r, np.arange(n - size + 1), size) for r in self.runs if len(r) == n]))
        out = {}
        for size, by_length in own.items():
            hashes = np.unique(np.concatenate(list(by_length.values())))
            out[size] = (hashes, {n: np.isin(hashes, x) for n, x in by_length.items()})
        return out

    def _starts(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item length, starts of the windows that have a whole piece of such an item and enough words of any item)."""
        counts = np.concatenate([[0], np.cumsum(codes > 0, dtype=np.int32)])
        for size, (hashes, by_length) in self.grams.items():
            at = np.flatnonzero(counts[size:] - counts[:-size] == size)
            found = runs_hashed(codes, at, size)
            place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            hit = hashes[place] == found
            at, place = at[hit], place[hit]
            for n, has in by_length.items():
                last, most = at[has[place]], self._most(n)
                # a document that is shorter than the item by what edits allow gets one window, up to its end
                least = math.ceil(n * self.similarity)
                first = np.maximum(last - (n - size) - most, 0)
                first[1:] = np.maximum(first[1:], last[:-1] + 1)
                many = np.maximum(last - first + 1, 0)
                starts = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
                starts = starts[starts <= len(codes) - least]
                yield n, starts[counts[np.minimum(starts + n, len(codes))] - counts[starts] >= least]

    def _emitted(self, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, walk: int, steps: int) -> np.ndarray:
        """Words that the walk emits at each of the first ``steps`` steps (rows) of the windows from ``starts`` to ``ends``. ``padded``: one more code at the end."""
        at, out = starts.copy(), np.empty((steps, len(starts)), np.int64)
        coin = np.uint64(self.coins[walk])
        spread = np.arange(1, steps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for step in range(steps):
            word = np.where(at >= ends, -1, padded[np.minimum(at, len(padded) - 1)]).astype(np.int64)
            out[step] = word
            x = (word.astype(np.uint64) + spread[step]) ^ coin
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            at = at + ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
        return out

    def _keys(self, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, walk: int, steps: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Keys of the windows: hashes of the words emitted at the sampled steps."""
        emitted = self._emitted(padded, starts, ends, walk, int(max(x[-1] for x in steps)) + 1)
        for own in steps:
            key = np.zeros(len(starts), np.uint64)
            for s in own.tolist():
                key = (key ^ emitted[s].astype(np.uint64)) * np.uint64(0x100000001B3) + np.uint64(s)
            yield key

    def candidates(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (document, item, start) of windows that share a key with an item. ``bounds``: where documents start, and the end."""
        found, padded = [], np.append(codes, -1)
        for n, starts in self._starts(codes) if len(codes) else ():
            if not len(starts):
                continue
            steps, tables = self.tables[n]
            least = math.ceil(n * self.similarity)
            doc = np.searchsorted(bounds, starts, side="right") - 1
            inside = starts + least <= bounds[doc + 1]
            starts, doc = starts[inside], doc[inside]
            if not len(starts):
                continue
            for w in range(self.walks):
                for j, key in enumerate(self._keys(padded, starts, np.minimum(starts + n, bounds[doc + 1]), w, steps[w])):
                    table, own = tables[w * len(steps[w]) + j]
                    low, high = np.searchsorted(table, key, "left"), np.searchsorted(table, key, "right")
                    hit = np.flatnonzero(high > low)
                    if len(hit):
                        sizes = (high - low)[hit]
                        which = np.repeat(low[hit] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                        found.append(np.stack([np.repeat(doc[hit], sizes), own[which], np.repeat(starts[hit], sizes)], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def verify(self, codes: np.ndarray, bounds: np.ndarray, found: np.ndarray) -> Iterator[tuple[int, int, int, int, int, float]]:
        """The best window of each document and item that reaches the similarity."""
        best: dict[tuple[int, int], tuple] = {}
        for doc, item, start in found.tolist():
            run = self.runs[item]
            most = self._most(len(run))
            if (doc, item) in best and best[doc, item][0] == 0:
                continue
            text = codes[start : min(start + len(run) + most, int(bounds[doc + 1]))]
            if len(set(text.tolist()) & set(run.tolist())) < (len(set(run.tolist())) - most):
                continue
            edits, used = prefix_edits(run.tolist(), text.tolist(), most)
            if edits <= most and ((doc, item) not in best or edits < best[doc, item][0]):
                best[doc, item] = (edits, start - int(bounds[doc]), used)
        for (doc, item), (edits, start, used) in best.items():
            yield doc, self.items[item][0], start, used, edits, 1 - edits / len(self.runs[item])


def runs_hashed(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` codes from each place."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = (out + codes[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return out


def prefix_edits(run: list[int], text: list[int], most: int) -> tuple[int, int]:
    """Least edit distance of ``run`` to a prefix of ``text``, and that prefix's length; above ``most`` it may be any larger number."""
    before = list(range(len(text) + 1))
    for i, a in enumerate(run, 1):
        row = [i]
        low, high = max(1, i - most), min(len(text), i + most)
        row += [most + 1] * (low - 1)
        for j in range(low, high + 1):
            row.append(min(before[j - 1] + (a != text[j - 1]), before[j] + 1, row[j - 1] + 1))
        row += [most + 1] * (len(text) - high)
        before = row
        if min(row) > most:
            return most + 1, 0
    edits = min(before)
    return edits, before.index(edits)


def encode_words(texts: pa.Array, codes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words (0: not in any item), and where each text starts, with the end. Words without letters or digits are left out."""
    parts, ends = words_in(texts)
    at = pc.index_in(parts.dictionary, pa.array(list(codes)))
    known = pc.if_else(pc.equal(parts.dictionary, ""), -1, pc.add(pc.fill_null(at, -1), 1)).to_numpy(zero_copy_only=False)
    run = known.astype(np.int32)[parts.indices.to_numpy()] if len(parts) else np.zeros(0, np.int32)
    kept = run >= 0
    before = np.concatenate([[0], np.cumsum(kept)])
    return run[kept], before[ends]


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a row and an item that a passage of the row's text repeats: ``doc_id, item_id, start_word, n_words, edits, similarity``.

    ``similarity``: 1 - edits / words of the item, over words without case and outer punctuation; the best passage of each
    pair is told. Null and empty texts and items match nothing; long texts are read whole; repeated rows are reported each;
    null identifiers stay null; other columns are not read; empty tables give no rows.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    search_with = lambda shared: rows.mapInArrow(lambda batches: search(batches, shared.value), FOUND)
    out, blocks = [], block_count(benchmark, item_text_col)
    for shared in indexes(benchmark, blocks, similarity, recall, item_id_col, item_text_col):
        out.append(search_with(shared) if blocks == 1 else save(search_with(shared), "leaks"))
        if blocks > 1:
            shared.unpersist()
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], FOUND)


def block_count(benchmark: DataFrame, item_text_col: str = "text") -> int:
    count, size = benchmark.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(item_text_col).cast("string"))), F.lit(0))).first()
    return max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))


def indexes(benchmark: DataFrame, blocks: int, similarity: float = 0.8, recall: float = 0.95, item_id_col: str = "item_id", item_text_col: str = "text") -> Iterator[Broadcast]:
    """Indexes over all items, block by block, as broadcasts; a block is collected when it is asked for."""
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect() if blocks > 1 else items.collect()
        if own:
            yield benchmark.sparkSession.sparkContext.broadcast(CgkIndex([tuple(r) for r in own], similarity, recall))


def search(batches: Iterator[pa.RecordBatch], index: CgkIndex) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", 6_000_000):
        codes, bounds = encode_words(batch.column("text"), index.codes)
        names = batch.column("doc_id")
        found = list(index.verify(codes, bounds, index.candidates(codes, bounds)))
        if found:
            doc, item, start, used, edits, similarity = zip(*found)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(doc)), *[pa.array(x, pa.int64()) for x in (item, start, used, edits)], pa.array(similarity, pa.float64())], names=["doc_id", "item_id", "start_word", "n_words", "edits", "similarity"])


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text repeats no item; each row is decided where it is read, whatever its identifier."""
    importable(docs.sparkSession)
    blocks = block_count(benchmark, options.get("item_text_col", "text"))
    for shared in indexes(benchmark, blocks, **options):
        docs = docs.mapInArrow(lambda batches, shared=shared: clean(batches, shared.value, text_col), docs.schema)
        if blocks > 1:
            docs = save(docs, "clean-rows")
            shared.unpersist()
    return docs


def clean(batches: Iterator[pa.RecordBatch], index: CgkIndex, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, text_col, 6_000_000):
        codes, bounds = encode_words(batch.column(text_col), index.codes)
        kept = np.ones(batch.num_rows, bool)
        kept[[found[0] for found in index.verify(codes, bounds, index.candidates(codes, bounds))]] = False
        yield batch.filter(pa.array(kept))
