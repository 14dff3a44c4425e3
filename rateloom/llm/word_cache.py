"""Batched tokenization: the distinct words of many texts are encoded once each, whole texts are then put together.

Both supported tokenizers cut a text before they merge symbols, and never merge over these cuts, so the ids of a text
are those of its parts in order. ``tests/llm`` compares this with plain encoding over whole tables.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Any white space, to Arrow's regular expressions.
_SPACE = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
#: A space is not a sure cut where white space stands before it and after it (or the text ends there); \x1f marks starts.
_UNSURE = rf"{_SPACE}\x20(?:{_SPACE}|\z)|\x1f"
_LOADED: dict[tuple, "WordCache"] = {}


class WordCache:
    """``spaces``: the tokenizer keeps white space (cut before single spaces), else it drops it (cut at white space)."""

    def __init__(self, path: str, spaces: bool, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.spaces, self.limit = Tokenizer.from_file(path), spaces, limit
        vocabulary, suffix = self.tokenizer.get_vocab(with_added_tokens=True), getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():  # one character stands for one byte
            self.bytes_of[k] = len(token.removesuffix(suffix))
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.lists = np.zeros(1 << 14, np.int32), None
        self.met = np.zeros(1 << 14, np.int32)  # batches that held each word

    def _forget(self, more: int) -> None:
        """Make room for ``more`` words: those that one batch alone held go, unless that is not enough, when all do."""
        n = len(self.index)
        keep = np.flatnonzero(self.met[:n] > 1)
        if len(keep) > self.limit // 2 or len(keep) + more > self.limit:
            return self._reset()
        words, kept = list(self.index), pa.ListArray.from_arrays(pa.array(self.at[: n + 1]), pa.array(self.flat[: self.used])).take(pa.array(keep))
        self.index = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.at[: len(keep) + 1] = np.asarray(kept.offsets)
        self.used = int(self.at[len(keep)])
        self.flat[: self.used] = kept.values.to_numpy()
        self.met[:] = 0
        self.met[: len(keep)] = 1
        self.lists = None

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], size: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has. Words are encoded together and the ids dealt out by
        the bytes they stand for; where these don't meet the words' ends, the words are encoded one by one."""
        chunks = [words[k : k + size] for k in range(0, len(words), size)]
        joint = "" if self.spaces else " "
        texts = [joint.join(c) for c in chunks]
        ids, sizes = [], []
        for chunk, text, found in zip(chunks, texts, self._plain(texts)):
            found = np.array(found, np.uint32)
            plain = text.isascii()  # such words keep their lengths when they are normalised
            forms = chunk if self.spaces or plain else self.tokenizer.normalizer.normalize_str(text).split(" ")
            ends = np.cumsum(list(map(len, forms if plain else map(str.encode, forms))))
            have = np.cumsum(self.bytes_of[found])
            at = np.searchsorted(have, ends)
            if len(forms) != len(chunk) or not len(have) or have[-1] != ends[-1] or (have[at] != ends).any():
                each = self._plain(chunk)
                found, n = np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each])
            else:
                n = np.diff(at + 1, prepend=0)
            ids.append(found)
            sizes.append(n)
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _learn(self, new: list[str]) -> None:
        """The ids of new parts go to the end of ``flat``."""
        if self.spaces:  # first parts of texts, and parts with white space, can't stand among others
            alone = [x for x in new if not x or x[0] == "\x1f" or not x.isprintable()]
            if alone:
                held = set(alone)
                new = [x for x in new if x not in held]
            new = sorted(new, key=str.isascii)
            found, sizes = self._joined([" " + x for x in new])
            each = self._plain([x[1:] if x[:1] == "\x1f" else " " + x for x in alone])
            found = np.concatenate([found, np.array([i for x in each for i in x], np.uint32)])
            sizes = np.concatenate([sizes, np.array([len(x) for x in each], np.int64)])
            new = new + alone
        else:
            new = sorted(new, key=str.isascii)
            found, sizes = self._joined(new)
        first, total = len(self.index), len(found)
        self.lists = None
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(new) >= len(self.at):
            self.at, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.met))
        self.flat[self.used : self.used + total] = found
        self.at[first + 1 : first + len(new) + 1] = self.used + np.cumsum(sizes, dtype=np.int32)
        self.used += total
        self.index.update(zip(new, range(first, first + len(new))))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array, as unsigned 32-bit integers; nulls count as empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return []
        if self.spaces:
            unsure = pc.match_substring_regex(texts, _UNSURE).to_numpy(zero_copy_only=False)
            cut = pc.split_pattern(pc.binary_join_element_wise("\x1f", pc.if_else(pa.array(unsure), "", texts), ""), " ")
        else:
            unsure = np.zeros(len(texts), bool)
            cut = pc.ascii_split_whitespace(texts)
        parts = cut.flatten().dictionary_encode()
        words = parts.dictionary.to_pylist()
        if len(self.index) + len(words) > self.limit:
            self._forget(len(words))
        if new := [w for w in words if w not in self.index]:
            self._learn(new)
        if self.lists is None:  # the ids of every known part stand in order
            self.lists = pa.ListArray.from_arrays(pa.array(self.at[: len(self.index) + 1]), pa.array(self.flat[: self.used]))
        own = np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))
        self.met[own] += 1
        which = own[parts.indices.to_numpy()]
        ends_at = np.asarray(cut.offsets)
        found = self.lists.take(pa.array(which))
        ids, ends = found.values.to_numpy(), np.asarray(found.offsets)
        bound = ends[ends_at - ends_at[0]]
        out = [ids[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
        for k in np.flatnonzero(unsure).tolist():
            out[k] = np.array(self._plain([texts[k].as_py()])[0], np.uint32)
        return out


def cache(path: str, spaces: bool) -> WordCache:
    """One for each worker process, kept over its tasks."""
    key = (path, spaces)
    if key not in _LOADED:
        _LOADED[key] = WordCache(path, spaces)
    return _LOADED[key]


def small_batches(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most about ``most`` bytes of text each (one row at least), to bound memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Small slices of all batches of a task. Workers live on between tasks, so at the end what they no longer use goes back to the system."""
    for batch in batches:
        yield from small_batches(batch, text, most)
    give_back()


def give_back() -> None:
    """Return memory that is no longer used to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)
