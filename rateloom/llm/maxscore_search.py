"""Ranked lexical search: MaxScore over shards of documents.

Each task turns the documents that it reads into shards: postings of the items' terms, in the order of identifiers. A shard
is searched item by item. The item's terms are sorted by the most that each can add in this shard; those whose sums stay
below the score that the tenth document has so far are non-essential: a document that holds only these cannot be among the
first. Blocks of documents gather the essential lists, and non-essential postings are probed, largest bound first, for
those documents alone that can still qualify. The first documents of a task go along from shard to shard, so later shards
begin with a high limit; Spark ranks the few documents that tasks hand on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import importable, save
from .word_cache import sliced

#: Items, and bytes of their texts, that are searched together.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 16_000_000
#: Documents and postings of a shard; documents whose essential postings are gathered together.
SHARD_DOCS, SHARD_POSTINGS, SPAN = 16_384, 2_000_000, 4096
#: Terms whose place in the vocabulary a task remembers.
SEEN_TERMS = 500_000

#: Of UTF-8 with A-Z lower-cased: letters, digits, and all that is not ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
SHARDS = "n_docs long, n_terms long, ids array<long>, lengths binary, terms array<int>, df array<int>, places binary, counts binary"
FOUND = "item int, item_id long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode("utf-8", "replace").lower())


class ShardWriter:
    """Gathers documents into shards of postings, documents by identifier, null identifiers last."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary, self.seen = vocabulary, {}
        self._reset()

    def _reset(self) -> None:
        self.n_docs = self.n_terms = self.postings = 0
        self.ids, self.lengths, self.held = [], [], []

    def add(self, doc_id: int | None, text: str | None) -> None:
        terms = terms_of(text)
        if not terms:
            return
        self.n_docs += 1
        self.n_terms += len(terms)
        counts = Counter(terms)
        get, vocabulary, own = self.seen.get, self.vocabulary, []
        for term, n in counts.items():
            k = get(term)
            if k is None:
                k = self.seen[term] = vocabulary.get(term, -1)
            if k >= 0:
                own.append((k, n))
        if len(self.seen) > SEEN_TERMS:
            self.seen.clear()
        if own:
            self.ids.append(doc_id)
            self.lengths.append(len(terms))
            self.held.append(own)
            self.postings += len(own)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def batch(self) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        sizes = [len(self.held[k]) for k in order]
        flat = np.array([x for k in order for x in self.held[k]], np.int32).reshape(-1, 2)
        places = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
        by_term = np.argsort(flat[:, 0], kind="stable")
        terms, df = np.unique(flat[:, 0], return_counts=True)
        lists = lambda x, kind: pa.array([x], pa.list_(kind))
        row = pa.RecordBatch.from_arrays(
            [pa.array([self.n_docs]), pa.array([self.n_terms]), lists([self.ids[k] for k in order], pa.int64()), pa.array([np.array([self.lengths[k] for k in order], np.int64).tobytes()], pa.binary()),
             lists(terms, pa.int32()), lists(df.astype(np.int32), pa.int32()), pa.array([places[by_term].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(flat[by_term, 1]).tobytes()], pa.binary())],
            names=["n_docs", "n_terms", "ids", "lengths", "terms", "df", "places", "counts"])
        self._reset()
        return row


class Shard:
    """A shard with what each posting adds, before weights."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = row["ids"]
        lengths = np.frombuffer(row["lengths"], np.int64)
        norm = 25 + (75 * lengths * n_docs) // n_terms
        self.places = np.frombuffer(row["places"], np.int32)
        counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.adds = (1_000_000_000 * counts) // (1000 * counts + 8 * norm[self.places])
        starts = np.concatenate([[0], np.cumsum(row["df"])]).astype(np.int64)
        self.most = np.maximum.reduceat(self.adds, starts[:-1]) if len(self.adds) else np.zeros(0, np.int64)
        self.at = {int(t): (int(a), int(b), k) for k, (t, a, b) in enumerate(zip(row["terms"], starts[:-1], starts[1:]))}


class First:
    """The best ``k`` documents so far: higher scores first, then smaller identifiers, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def limit(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def offer(self, scores: np.ndarray, ids: list) -> None:
        if len(scores) > self.k:  # equal scores stand in the order of identifiers
            kept = np.argsort(-scores, kind="stable")[: self.k]
            scores, ids = scores[kept], [ids[j] for j in kept.tolist()]
        rows = self.rows + [(int(s), d) for s, d in zip(scores, ids)]
        self.rows = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]


def search_shard(shard: Shard, terms: list[tuple[int, int]], first: First, met: Counter | None = None) -> None:
    """Offer to ``first`` the documents of the shard that can qualify; ``terms``: (term, weight in the item, repeats counted).

    ``met`` counts postings: those there are, and those gathered or probed for.
    """
    held = sorted((weight * int(shard.most[k]), weight, a, b) for t, weight in terms if weight and (at := shard.at.get(t)) for a, b, k in [at])
    if not held:
        return
    bounds = np.cumsum([h[0] for h in held])
    lists = [(weight, shard.places[a:b], shard.adds[a:b]) for _, weight, a, b in held]
    edges = np.arange(0, len(shard.ids) + SPAN, SPAN)
    spans = [np.searchsorted(places, edges) for _, places, _ in lists]
    if met is not None:
        met["all"] += sum(len(places) for _, places, _ in lists)
    for s, low in enumerate(edges[:-1].tolist()):
        limit = first.limit
        essential = int(np.searchsorted(bounds, limit))  # lists before this one sum to less than the limit
        if essential == len(lists):
            return
        total = np.zeros(SPAN, np.int64)
        for (weight, places, adds), cuts in zip(lists[essential:], spans[essential:]):
            a, b = cuts[s], cuts[s + 1]
            total[places[a:b] - low] += weight * adds[a:b]
            if met is not None:
                met["read"] += b - a
        docs = np.flatnonzero(total)
        for j in range(essential - 1, -1, -1):
            docs = docs[total[docs] + bounds[j] >= limit]
            if not len(docs):
                break
            (weight, places, adds), (a, b) = lists[j], spans[j][s : s + 2]
            if a == b:
                continue
            own = places[a:b] - low
            place = np.minimum(np.searchsorted(own, docs), b - a - 1)
            hit = own[place] == docs
            total[docs[hit]] += weight * adds[a:b][place[hit]]
            if met is not None:
                met["read"] += len(docs)
        docs = docs[total[docs] >= limit]
        if len(docs):
            first.offer(total[docs], [shard.ids[low + d] for d in docs.tolist()])


def weights(n_docs: int, df: dict[int, int]) -> dict[int, int]:
    return {t: int(np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * d + 1)))) for t, d in df.items()}


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` best documents for each row of ``items``: ``item_id, rank, doc_id, score``.

    Every document counts in the statistics and may be ranked. Null and wordless texts have no terms: such documents are
    not counted, such items get no rows. Repeated rows are documents, or items, of their own; equal scores go by ascending
    doc_id, a null one last. Long texts are read whole; other columns are not read; empty tables give no rows.

    Items are held in blocks of bounded size. A block reads the documents once; its vocabulary and that vocabulary's
    counts are all that comes to the driver.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    asked = save(asked.withColumn("row", F.monotonically_increasing_id()), "items")
    count, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    found = [_rank_block(rows, asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("item_id", "text").collect(), k) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _rank_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    counted = [Counter(terms_of(text)) for _, text in items]
    vocabulary = {t: n for n, t in enumerate(dict.fromkeys(t for c in counted for t in c))}
    shared = spark.sparkContext.broadcast(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(shared.value)
        for batch in sliced(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                writer.add(doc_id, text.as_py())
                if writer.full():
                    yield writer.batch()
        if writer.n_docs:
            yield writer.batch()

    shards = save(docs.mapInArrow(write, SHARDS), "shards")
    n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    df = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("_")).groupBy("_.terms").agg(F.sum("_.df").alias("df")).collect()
    weight = weights(n_docs or 0, {r.terms: r.df for r in df})  # a row for each term of the block at most
    asked = [(item, item_id, [(t, n * weight[t]) for term, n in c.items() if (t := vocabulary[term]) in weight]) for item, ((item_id, _), c) in enumerate(zip(items, counted))]
    plan = spark.sparkContext.broadcast([a for a in asked if a[2]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [First(k) for _ in plan.value]
        for batch in batches:
            for row in batch.select(["ids", "lengths", "terms", "df", "places", "counts"]).to_pylist():
                shard = Shard(row, n_docs, n_terms)
                for held, (_, _, terms) in zip(first, plan.value):
                    search_shard(shard, terms, held)
        out = [(item, item_id, doc_id, score) for held, (item, item_id, _) in zip(first, plan.value) for score, doc_id in held.rows]
        for a in range(0, len(out), 50_000):
            part = list(zip(*out[a : a + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["item", "item_id", "doc_id", "score"])

    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = shards.select("ids", "lengths", "terms", "df", "places", "counts").mapInArrow(search, FOUND)
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
