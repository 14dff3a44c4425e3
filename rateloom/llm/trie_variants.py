"""Spelling variants: a trie self-join with active-node sets finds all words of a vocabulary that are one edit apart.

A node's active nodes are the trie's other nodes whose strings are one edit away. They follow from those of the node above:
the node above itself, its other children, the children of the node, and what the active nodes above reach by the same
letter. Where a word ends, its active nodes at which words end are its near words.

The trie is cut into parts by prefix. Of two words that are one edit apart, the shorter of ``m`` letters, either the first
or the last ``m // 2`` letters agree; so a forward and a backward trie, cut at that depth, hold every pair, and no part
needs nodes of another. A word is filed at most four times, whatever the vocabulary. A part with too many words is cut again
in the same way over what its words do not share, down to rests of one or two letters, of which there are few.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import importable, save
from .word_cache import sliced

#: Letters of a word, and occurrences, at least.
LETTERS, OFTEN = 5, 3
#: One in so many runs of a document loses a letter.
TYPO = 97
#: Words of one part of the trie; different words that a task counts before it hands them on.
PART_WORDS, HELD_WORDS = 20_000, 300_000

COUNTED = "word string, n long"
NEAR = "word string, n_near long, near_n long, near string"


def run_counts(doc_id: int | None, text: str, letters: int = LETTERS) -> Iterator[tuple[str, int]]:
    """Words of a text with their occurrences: runs of letters with A-Z lower-cased, some of them less one letter."""
    low = text.encode("utf-8", "replace").lower().decode("utf-8")  # of bytes, A-Z alone
    start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(re.findall(f"[a-zÀ-ÿ]{{{letters},}}", low)).items():
        h = 1 if start is None else zlib.crc32(run.encode(), start)
        if h % TYPO == 0:
            run = run[: (k := h % len(run))] + run[k + 1 :]
        if len(run) >= letters:
            yield run, n


def vocabulary(docs: DataFrame, letters: int = LETTERS, often: int = OFTEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: counted by task first, so that a frequent word is one row of each task."""
    importable(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in sliced(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in run_counts(doc_id, text.as_py() or "", letters):
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, COUNTED).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def cut(rows: DataFrame) -> DataFrame:
    """Rows (part, path, least, rest, ...) filed again below their part: by the first and by the last half of what the shorter rests hold."""
    half = F.floor(F.col("least") / 2).cast("int")
    size = F.char_length("rest")
    side = lambda letter, head, rest: F.struct(
        F.concat_ws("|", F.concat("part", F.lit(letter)), head).alias("part"), F.concat("path", F.lit(letter)).alias("path"), (F.col("least") - half).alias("least"), rest.alias("rest"))
    sides = F.array(side("f", F.col("rest").substr(F.lit(1), half), F.col("rest").substr(half + 1, size)), side("b", F.col("rest").substr(size - half + 1, half), F.col("rest").substr(F.lit(1), size - half)))
    others = [c for c in rows.columns if c not in ("part", "path", "least", "rest")]
    return rows.select(*others, F.explode(sides).alias("_")).select(*others, "_.*")


def parts_of(words: DataFrame, letters: int, part_words: int) -> DataFrame:
    """Words filed under the parts of the two tries: ``part, path, least, rest, word, n``. ``least``: letters of the shorter rests of the part."""
    size = F.char_length("word")
    least = F.explode(F.when(size > letters, F.array(size - 1, size)).otherwise(F.array(size))).alias("least")
    rows = words.select("word", "n", least).withColumns({"part": F.col("least").cast("string"), "path": F.lit(""), "rest": F.col("word")})
    rows = save(cut(rows), "trie-parts")
    while True:
        large = save(rows.filter("least > 1").groupBy("part").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > part_words).select("part"), "large-parts")
        if large.isEmpty():
            return rows
        rows = save(rows.join(large, "part", "left_anti").unionByName(cut(rows.join(large, "part", "left_semi"))), "trie-parts")


def trie_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places of all ordered pairs of these different strings that are one edit apart."""
    children: list[dict[str, int]] = [{}]
    ends: dict[int, int] = {}
    for k, word in enumerate(words):
        node = 0
        for letter in word:
            below = children[node].get(letter)
            if below is None:
                below = children[node][letter] = len(children)
                children.append({})
            node = below
        ends[node] = k
    stack: list[tuple[int, set[int]]] = [(0, set(children[0].values()))]
    while stack:
        node, active = stack.pop()
        if node in ends:
            yield from ((ends[node], ends[u]) for u in active if u in ends)
        own = children[node]
        for letter, below in own.items():
            reached = {node, *own.values(), *children[below].values()}
            reached.update(v for u in active if (v := children[u].get(letter)) is not None)
            reached.discard(below)
            stack.append((below, reached))


def path_of(a: str, b: str, depth: int) -> str:
    """Where a pair of one edit belongs: forward as long as the first halves agree, else backward."""
    path, least = "", min(len(a), len(b))
    for _ in range(depth):
        half = least // 2
        same = a[:half] == b[:half]
        a, b = (a[half:], b[half:]) if same else (a[: len(a) - half], b[: len(b) - half])
        path, least = path + ("f" if same else "b"), least - half
    return path


def near_in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: near words of each word within its part, counted, and the most frequent of them."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "least", "rest", "word", "n"))))
    out: list[tuple] = []
    for _, group in groupby(rows, lambda row: row[0]):
        _, paths, leasts, rests, words, counts = zip(*group)
        if len(words) < 2:
            continue
        path, least = paths[0], leasts[0]
        best: dict[int, list] = {}
        # the backward trie reads words from their ends
        for i, j in trie_pairs([r[::-1] for r in rests] if path[-1] == "b" else list(rests)):
            if min(len(rests[i]), len(rests[j])) == least and path_of(words[i], words[j], len(path)) == path:
                held, offer = best.setdefault(i, [0, None]), (-counts[j], words[j])
                held[0] += 1
                held[1] = offer if held[1] is None else min(held[1], offer)
        out += [(words[i], n, -offer[0], offer[1]) for i, (n, offer) in best.items()]
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["word", "n_near", "near_n", "near"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame, letters: int = LETTERS, part_words: int = PART_WORDS) -> DataFrame:
    """``word, n_near, near_n, near`` of every word (word, n: words differ) with a near word: how many there are, and the most frequent, of several the first in code-point order."""
    importable(words.sparkSession)
    parts = parts_of(words, letters, part_words).repartition("part").sortWithinPartitions("part")
    best: Column = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = parts.mapInArrow(near_in_parts, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def spelling_groups(docs: DataFrame, ratio: int = 2, letters: int = LETTERS, often: int = OFTEN, part_words: int = PART_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word of the corpus: ``word, form, root, n, n_near, form_n``.

    A word's ``form`` is its most frequent near word, if that occurs ``ratio`` times as often or more; ``root`` is the end
    of the chain of forms, on which counts grow by that ratio, so that some halvings of the paths reach it. Null and empty
    texts have no words; texts and words of any length are read whole; repeated rows count each; a null identifier takes no
    letter from its runs; other columns are not read; an empty table gives no rows.
    """
    words = save(vocabulary(docs, letters, often, id_col, text_col), "vocabulary")
    enough = F.col("near_n") >= ratio * F.col("n")
    rows = words.join(near_words(words, letters, part_words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n"))
    rows = save(rows, "forms")
    up = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        jumped = save(up.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        up = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            break
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
