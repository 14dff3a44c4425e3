"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, in which neighbours differ in few bits. Runs of them form nodes, and runs of nodes
form upper nodes. The bits that all members of a node share are factored out: what a node's upper node shares is not among
its own. The tree is compared with itself from the top: two nodes add the differences in the bits that they share, and
their upper nodes did not, to those met above, and whole groups are left out as soon as the sum exceeds the limit, or
once their members are all known to be connected. Only links that join two parts are passed on, so groups of copies
never become all their pairs.

The uppermost nodes are files, whose members share all bits of one mask; they spread the index over the cluster. Exact search
(``simhash_groups``) has a mask for each of ``limit + 1`` blocks of the bits, one of which every link leaves unchanged, so each
fingerprint stands in as many files and links never cross files. The looser search of the pipeline (``near_duplicate_links``)
files a wide signature under short bands. A file that is still large is cut into segments of the Gray order: a segment's
fingerprints go only to the segments whose shared bits they may match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import attach, attach_totals, importable, save
from .components import components
from .word_cache import give_back, sliced

SEED = 42
#: Fingerprints of one segment, and segments at most (beyond that they grow).
SEGMENT_ROWS, MAX_SEGMENTS = 32_768, 2048
#: Members of a node.
FAN = 8
#: Pairs of nodes that are looked at together.
STEP = 2048
#: Pairs of fingerprints joined before connections are brought up to date.
JOIN_STEP = 4096
#: Rows under one index, where they hold their shingles, and shingles that are compared at a time.
SET_ROWS, SET_STEP = 16_384, 1 << 21
LINKS = "file long, a long, b long"
#: Whether pairs of places may be links.
May = Callable[[np.ndarray, np.ndarray], np.ndarray]


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words (A-Z lower-cased, split at ASCII white space), repeats included."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, n, h = b" ".join(parts), len(parts), xxhash.xxh64_intdigest
    if n <= words:
        return np.array([h(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, n) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    ends = (ends - 1).tolist()
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash made from each hash; the first is the hash itself."""
    if not k:
        return hashes
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes: 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, f0``: the fingerprint as a signed long."""
    importable(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            prints = [fingerprint(shingle_hashes(text or "", words)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "f0"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(make, "doc_id long, f0 long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the binary reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def gray_order(x: Column) -> Column:
    """The same of a column of longs, as a long that sorts in that order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


class GrayIndex:
    """A tree over 64-bit codes sorted by Gray rank. With ``files``, codes of different files never match: the tree is
    sorted by file first, and the bits of the file's number are shared patterns as well."""

    def __init__(self, codes: np.ndarray, files: np.ndarray | None = None, height: int = 1):
        self.order = np.argsort(gray_rank(codes), kind="stable") if files is None else np.lexsort((gray_rank(codes), files))
        self.size = len(codes)
        any_of = all_of = [codes[self.order]] if files is None else [codes[self.order], files[self.order]]
        self.shared, self.patterns = [[np.full(self.size, ~np.uint64(0)) for _ in all_of]], [all_of]
        while len(all_of[0]) > 1 or len(self.patterns) <= height:
            cut = np.arange(0, len(all_of[0]), FAN)
            any_of, all_of = [np.bitwise_or.reduceat(w, cut) for w in any_of], [np.bitwise_and.reduceat(w, cut) for w in all_of]
            self.shared.append([~(x ^ y) for x, y in zip(any_of, all_of)])
            self.patterns.append(all_of)
        self.height = len(self.patterns) - 1
        # factored: what the upper node shares is not the node's own
        self.own = [[low & ~np.repeat(high, FAN)[: len(low)] for low, high in zip(a, b)] for a, b in zip(self.shared, self.shared[1:])] + [self.shared[-1]]
        self.leaves = [np.pad(w, (0, -self.size % FAN)).reshape(-1, FAN) for w in self.patterns[0]]

    def links(self, limit: int, labels: np.ndarray | None = None, apart: Sequence[tuple[int, int]] = (), may: May | None = None) -> Iterator[tuple[int, int]]:
        """Links within ``limit`` bits that connect all members that such links connect. Members of one label count as
        connected; the pairs ``apart`` are no links, nor are those that ``may`` (places, places) denies."""
        return self._links(self, limit, None if labels is None else labels[self.order], apart, may)

    def links_to(self, other: "GrayIndex", limit: int, labels: tuple[np.ndarray, np.ndarray] | None = None, apart: Sequence[tuple[int, int]] = (), may: May | None = None) -> Iterator[tuple[int, int]]:
        """The same between the members of two trees of one height: (place here, place there)."""
        return self._links(other, limit, None if labels is None else np.concatenate([labels[0][self.order], labels[1][other.order]]), apart, may)

    def _numbers(self, other: "GrayIndex", a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A number for each pair of a place here and one in ``other``, in either order where both are one tree."""
        if other is self:
            a, b = np.minimum(a, b), np.maximum(a, b)
        return a * other.size + b

    def _links(self, other: "GrayIndex", limit: int, labels: np.ndarray | None, apart: Sequence[tuple[int, int]], may: May | None) -> Iterator[tuple[int, int]]:
        self.may = may
        first = 0 if other is self else self.size
        self.apart = self._numbers(other, *np.array(apart, np.int64).T) if len(apart) else np.zeros(0, np.int64)
        n = self.size + (0 if other is self else other.size)
        self.parent, self.version, self.known = np.arange(n), 0, {}
        if labels is not None:
            _, least, which = np.unique(labels, return_index=True, return_inverse=True)
            self.parent = least[which]
        for tier in tiers(limit) if self.size and other.size else ():
            for a, b in self._search(other, first, tier):
                yield int(self.order[a]), int(other.order[b])

    def _whole(self, tree: "GrayIndex", first: int, level: int) -> np.ndarray:
        """The root of each node's members if it is one, else -1."""
        version, whole = self.known.get((first, level), (-1, None))
        if version != self.version:
            cut, mine = np.arange(0, tree.size, FAN**level), self.parent[first : first + tree.size]
            low, high = np.minimum.reduceat(mine, cut), np.maximum.reduceat(mine, cut)
            whole = np.where(low == high, low, -1)
            self.known[first, level] = (self.version, whole)
        return whole

    def _apart(self, other: "GrayIndex", level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differences in the bits that both nodes share, and that not both of their upper nodes do."""
        out = np.zeros(len(a), np.int16)
        for k, (x, y) in enumerate(zip(self.patterns[level], other.patterns[level])):
            bits = self.shared[level][k][a] & other.shared[level][k][b] & (self.own[level][k][a] | other.own[level][k][b])
            differ = (x[a] ^ y[b]) & bits
            out += np.bitwise_count(differ).astype(np.int16) if k == 0 else np.int16(128) * (differ != 0)
        return out

    def _search(self, other: "GrayIndex", first: int, limit: int) -> Iterator[tuple[int, int]]:
        """Pairs of nodes from the top down, with the differences met so far."""
        a = b = np.zeros(1, np.int64)
        stack = [(self.height, a, b, self._apart(other, self.height, a, b))]
        one, two = np.divmod(np.arange(FAN * FAN), FAN)
        while stack:
            level, a, b, apart = stack.pop()
            if len(a) > STEP:
                stack += [(level, a[k : k + STEP], b[k : k + STEP], apart[k : k + STEP]) for k in reversed(range(0, len(a), STEP))]
                continue
            x, y = self._whole(self, 0, level)[a], self._whole(other, first, level)[b]
            near = (apart <= limit) & ((x != y) | (x < 0))
            a, b, apart = a[near], b[near], apart[near]
            if level == 1:
                yield from self._join(other, first, a, b, limit)
                continue
            a, b, apart = (a[:, None] * FAN + one).reshape(-1), (b[:, None] * FAN + two).reshape(-1), np.repeat(apart, FAN * FAN)
            real = (a < len(self.own[level - 1][0])) & (b < len(other.own[level - 1][0]))
            if other is self:
                real &= a <= b
            a, b = a[real], b[real]
            apart = apart[real] + self._apart(other, level - 1, a, b)
            near = apart <= limit
            a, b, apart = a[near], b[near], apart[near]
            if len(a):
                stack.append((level - 1, a, b, apart))

    def _join(self, other: "GrayIndex", first: int, a: np.ndarray, b: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
        """The members of these lowest nodes that connect two parts, closest first."""
        differ = self.leaves[0][a][:, :, None] ^ other.leaves[0][b][:, None, :]
        apart = np.bitwise_count(differ)
        near = apart <= limit
        if len(self.leaves) > 1:
            near &= self.leaves[1][a][:, :, None] == other.leaves[1][b][:, None, :]
        pair, i, j = np.nonzero(near)
        apart = apart[pair, i, j]
        i, j = a[pair] * FAN + i, b[pair] * FAN + j
        real = (i < self.size) & (j < other.size)
        if other is self:
            real &= i < j
        if len(self.apart):
            at = np.flatnonzero(real)
            real[at] = ~np.isin(self._numbers(other, self.order[i[at]], other.order[j[at]]), self.apart)
        sort = np.flatnonzero(real)[np.argsort(apart[real], kind="stable")]
        i, j = i[sort], j[sort]
        for k in range(0, len(i), JOIN_STEP):
            p, q = i[k : k + JOIN_STEP], j[k : k + JOIN_STEP]
            x, y = self.parent[p], self.parent[first + q]
            new = np.flatnonzero(x != y)
            if self.may and len(new):
                new = new[self.may(self.order[p[new]], other.order[q[new]])]
            if not len(new):
                continue
            parent = self.parent
            for n in new.tolist():
                u, v = int(x[n]), int(y[n])
                while parent[u] != u:
                    u = int(parent[u])
                while parent[v] != v:
                    v = int(parent[v])
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    yield int(p[n]), int(q[n])
            self.parent, self.version = roots(parent), self.version + 1


def tiers(limit: int) -> tuple[int, ...]:
    """A wide search takes close links first: they connect most of a group."""
    return (limit // 3, limit) if limit > 6 else (limit,)


def links_in_files(filed: DataFrame, limit: int, segment_rows: int = SEGMENT_ROWS, apart: DataFrame | None = None, forests: int = 1, most: int = 0, similarity: float = 0.0) -> DataFrame:
    """``filed``: (file: long, id: long, f0: long, maybe label: long) to links (file, a, b) within ``limit`` bits, file by file.
    Rows of one label are known to be connected, and need no link between them. Pairs in ``apart`` (file, a, b) are no links.
    With more than one of ``forests`` that many sets of links are passed on, none of which has a link of another, as long
    as there are any: each connects what links that are in no set before connect.
    A column ``words: array<long>`` holds wide signatures, filed by band: links then also lie within ``most`` bits of these, and
    are told in the first file alone that both rows have. A column ``shingles: array<int>`` holds sets of different numbers: links
    then also have the Jaccard ``similarity`` over these, so that no other pair leaves a task.

    Small files lie whole in a task, many under one index. A file of more than ``segment_rows`` rows is cut into segments of
    its Gray order; each segment is an index of its own, and gets the rows of those other segments whose shared bits allow a
    match. Only the shared bits of at most ``MAX_SEGMENTS`` segments, and of each file's own, come to the driver.
    """
    spark = filed.sparkSession
    importable(spark)
    carried = ["id", "f0"] + [c for c in ("label", "words", "shingles") if c in filed.columns]
    large = filed.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > segment_rows)
    large = save(large, "large-files")
    total = large.agg(F.sum("n")).first()[0]
    few = filed.join(large, "file", "left_anti") if total else filed
    # a pair that is no link travels as a row with both identifiers
    lists = {"words": "array<long>", "shingles": "array<int>"}
    blank = [F.lit(None).cast(lists[c]).alias(c) if c in lists else F.lit(0).cast("long").alias(c) for c in carried[1:]]
    few = few.select("file", *carried, F.lit(None).cast("long").alias("other"))
    if apart is not None:
        few = few.unionByName((apart.join(large, "file", "left_anti") if total else apart).select("file", F.col("a").alias("id"), *blank, F.col("b").alias("other")))
    found = few.repartition("file").sortWithinPartitions("file").mapInArrow(lambda batches: within_files(batches, limit, forests, most, similarity), LINKS)
    if not total:
        return found
    parts = min(MAX_SEGMENTS, -(-total // segment_rows))
    rows = filed.join(large, "file", "left_semi").withColumn("rank", gray_order(F.col("f0"))).repartitionByRange(parts, "file", "rank")
    rows = save(rows.select("file", F.spark_partition_id().alias("part"), *carried), "segments")
    shared = rows.groupBy("file", "part").agg(F.bit_and("f0").alias("all_of"), F.bit_or("f0").alias("any_of")).toPandas().sort_values(["file", "part"])
    pairs = segment_pairs(*(shared[c].to_numpy() for c in ("file", "part", "all_of", "any_of")), limit)
    pairs_of = F.broadcast(spark.createDataFrame(pairs))  # at most as many rows as there are pairs of segments in a file
    met = rows.join(pairs_of, ["file", "part"]).filter(F.bit_count((F.col("f0").bitwiseXOR(F.col("all_of"))).bitwiseAND(F.col("mask"))) <= limit)
    met = met.select("pair", "side", "file", *carried, F.lit(None).cast("long").alias("other"))
    if apart is not None:
        part_of = lambda x: rows.select("file", F.col("id").alias(x), F.col("part").alias(f"{x}_part"))
        placed = apart.join(large, "file", "left_semi").join(part_of("a"), ["file", "a"]).join(part_of("b"), ["file", "b"])
        placed = placed.select("file", F.col("a").alias("id"), F.col("b").alias("other"), F.least("a_part", "b_part").alias("part"), F.greatest("a_part", "b_part").alias("last"))
        lower = pairs_of.filter("side <= 0").select("file", "part", "pair", "side")
        upper = pairs_of.filter("side = 1").select("file", F.col("part").alias("last"), "pair")
        inside = placed.filter("part = last").join(lower.filter("side < 0"), ["file", "part"])
        across = placed.filter("part < last").join(lower.filter("side = 0"), ["file", "part"]).join(upper, ["file", "last", "pair"])
        chosen = ["pair", F.lit(2).alias("side"), "file", "id", *blank, "other"]
        met = met.unionByName(inside.select(*chosen)).unionByName(across.select(*chosen))
    parts = max(1, min(pairs.num_rows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = met.repartitionById(parts, F.pmod(F.col("pair"), F.lit(parts)).cast("int")).sortWithinPartitions("pair", "side")
    return found.unionByName(met.mapInArrow(lambda batches: between_segments(batches, limit, forests, most, similarity), LINKS))


def segment_pairs(files: np.ndarray, parts: np.ndarray, all_of: np.ndarray, any_of: np.ndarray, limit: int) -> pa.Table:
    """Segments of one file that may hold links: ``file, part, pair, side`` (-1: with itself, 0, 1), and the other side's ``mask`` and ``all_of``."""
    mask, out, number = ~(all_of ^ any_of), [], 0
    for file in np.unique(files):
        own = np.flatnonzero(files == file)
        for i in own.tolist():
            near = own[own >= i]
            near = near[np.bitwise_count(((all_of[i] ^ all_of[near]) & mask[i] & mask[near]).view(np.uint64)) <= limit]
            ids = number + np.arange(len(near))
            number += len(near)
            other = near != i
            out.append((np.full(len(near), parts[i]), ids, np.where(near == i, -1, 0), mask[near], all_of[near], np.full(len(near), file)))
            out.append((parts[near][other], ids[other], np.ones(other.sum(), int), np.full(other.sum(), mask[i]), np.full(other.sum(), all_of[i]), np.full(other.sum(), file)))
    part, pair, side, mask, all_of, file = (np.concatenate(x) for x in zip(*out))
    return pa.table({"file": pa.array(file, pa.int64()), "part": pa.array(part, pa.int32()), "pair": pa.array(pair, pa.int64()), "side": pa.array(side, pa.int32()), "mask": pa.array(mask, pa.int64()), "all_of": pa.array(all_of, pa.int64())})


def numbers(rows: pa.RecordBatch, *names: str) -> list[np.ndarray | None]:
    return [rows.column(n).to_numpy() if n in rows.schema.names else None for n in names]


def links_out(files: np.ndarray, ids: np.ndarray, others: np.ndarray, found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        a, b = np.array(found).T
        yield pa.RecordBatch.from_arrays([pa.array(files[a]), pa.array(ids[a]), pa.array(others[b])], names=["file", "a", "b"])


def wide_words(rows: pa.RecordBatch) -> np.ndarray | None:
    """Signatures as a row of words each; rows without one are zero."""
    if "words" not in rows.schema.names:
        return None
    lists = rows.column("words")
    out = np.zeros((len(lists), WIDE), np.uint64)
    known = lists.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    out[known] = pc.list_flatten(lists).to_numpy().view(np.uint64).reshape(-1, WIDE)
    return out


def told_here(here: np.ndarray, there: np.ndarray, files: np.ndarray, most: int) -> May:
    """Pairs within ``most`` bits that agree on no band before that of their file."""
    masks = band_masks()

    def may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for k in range(0, len(a), JOIN_STEP):
            differ = here[a[k : k + JOIN_STEP]] ^ there[b[k : k + JOIN_STEP]]
            near, band = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= most, files[a[k : k + JOIN_STEP]] // (1 << BAND_BITS)
            for before in range(int(band.max(initial=0))):
                at = np.flatnonzero(near & (band > before))
                near[at] = (differ[at] & masks[before]).any(axis=1)
            out[k : k + JOIN_STEP] = near
        return out

    return may


class ShingleSets:
    """The sets of some rows, as numbers counted from 0."""

    def __init__(self, lists: pa.ListArray, similarity: float):
        self.ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
        self.values, self.similarity, self.mark = pc.list_flatten(lists).to_numpy(), similarity, None

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows ``a`` and ``b`` have the similarity, pair by pair."""
        if self.mark is None:  # many groups have no pair to compare
            known, self.values = np.unique(self.values, return_inverse=True)
            self.values, self.mark = self.values.astype(np.int32), np.zeros(len(known), bool)
        sizes = np.diff(self.ends)
        out = np.minimum(sizes[a], sizes[b]) >= self.similarity * np.maximum(sizes[a], sizes[b]) - 1e-9
        at = np.flatnonzero(out)
        if len(np.unique(a[at])) > len(np.unique(b[at])):
            a, b = b, a
        at = at[np.argsort(a[at], kind="stable")]
        one, n = a[at], sizes[b[at]]
        before = np.append(0, np.cumsum(n))
        cuts = np.flatnonzero((np.diff(one, prepend=-1) != 0) | (np.diff(before[:-1] // SET_STEP, prepend=0) != 0))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
            own = self.values[self.ends[one[i]] : self.ends[one[i] + 1]]
            self.mark[own] = True
            where = np.arange(before[j] - before[i]) + np.repeat(self.ends[b[at[i:j]]] - before[i:j] + before[i], n[i:j])
            shared = np.add.reduceat(self.mark[self.values[where]], before[i:j] - before[i], dtype=np.int64)
            self.mark[own] = False
            out[at[i:j]] = shared >= self.similarity * (len(own) + n[i:j] - shared) - 1e-9
        return out


def shingle_column(rows: pa.RecordBatch, similarity: float) -> ShingleSets | None:
    return ShingleSets(rows.column("shingles"), similarity) if "shingles" in rows.schema.names else None


def may_link(words: np.ndarray | None, sets: ShingleSets | None, files: np.ndarray, most: int, one: slice, two: slice) -> May | None:
    """What whole signatures and sets, as far as the rows hold them, say of pairs (place in ``one``, place in ``two``)."""
    if words is None:
        return None
    told = told_here(words[one], words[two], files[one], most)
    if sets is None:
        return told

    def may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = told(a, b)
        at = np.flatnonzero(out)
        if len(at):
            out[at] = sets.alike(one.start + a[at], two.start + b[at])
        return out

    return may


def disjoint(links: Callable[[list], Iterator[tuple[int, int]]], apart: list[tuple[int, int]], forests: int) -> list[tuple[int, int]]:
    """The links of so many forests, none of which has a link of another."""
    out: list[tuple[int, int]] = []
    for _ in range(forests):
        more = list(links(apart + out))
        if not more:
            break
        out += more
    return out


def within_files(batches: Iterator[pa.RecordBatch], limit: int, forests: int = 1, most: int = 0, similarity: float = 0.0) -> Iterator[pa.RecordBatch]:
    """Rows sorted by file: one index over many whole files at a time."""
    for rows in groups_of(batches, "file"):
        told = rows.filter(pc.is_valid(rows.column("other")))
        rows = rows.filter(pc.is_null(rows.column("other")))
        files, ids, codes, labels = numbers(rows, "file", "id", "f0", "label")
        if not len(files):
            continue
        several = None if files[0] == files[-1] else files.view(np.uint64)
        if several is not None and labels is not None:  # connected in one file, two rows may still need a link in another
            labels = np.unique(labels, return_inverse=True)[1] + len(labels) * np.unique(files, return_inverse=True)[1]
        apart = []
        if told.num_rows:
            own = set(told.column("file").to_pylist())
            place = {(f, i): p for p, (f, i) in enumerate(zip(files.tolist(), ids.tolist())) if f in own}
            apart = [(place[f, a], place[f, b]) for f, a, b in zip(*(told.column(c).to_pylist() for c in ("file", "id", "other"))) if (f, a) in place and (f, b) in place]
        index, every = GrayIndex(codes.view(np.uint64), several), slice(0, len(files))
        may = may_link(wide_words(rows), shingle_column(rows, similarity), files, most, every, every)
        yield from links_out(files, ids, ids, disjoint(lambda known: index.links(limit, labels, known, may), apart, forests))
    give_back()


def between_segments(batches: Iterator[pa.RecordBatch], limit: int, forests: int = 1, most: int = 0, similarity: float = 0.0) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pair and side: an index over each side. Side 2: pairs that are no links."""
    for rows in groups_of(batches, "pair"):
        pair, side, files, ids, codes, labels = numbers(rows, "pair", "side", "file", "id", "f0", "label")
        other, words, sets = pc.fill_null(rows.column("other"), 0).to_numpy(), wide_words(rows), shingle_column(rows, similarity)
        codes, starts = codes.view(np.uint64), np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pair)]):
            cut, end = a + int(np.searchsorted(side[a:b], 1)), a + int(np.searchsorted(side[a:b], 2))
            if side[a] < 0:
                place = {i: p for p, i in enumerate(ids[a:end].tolist())} if end < b else {}
                apart = [(place[x], place[y]) for x, y in zip(ids[end:b].tolist(), other[end:b].tolist()) if x in place and y in place]
                one = GrayIndex(codes[a:end])
                own = None if labels is None else labels[a:end]
                may = may_link(words, sets, files, most, slice(a, end), slice(a, end))
                yield from links_out(files[a:end], ids[a:end], ids[a:end], disjoint(lambda known: one.links(limit, own, known, may), apart, forests))
            elif a < cut < end:
                one, two = GrayIndex(codes[a:cut]), GrayIndex(codes[cut:end])
                height = max(one.height, two.height)
                one, two = (x if x.height == height else GrayIndex(c, height=height) for x, c in ((one, codes[a:cut]), (two, codes[cut:end])))
                here, there = ({i: p for p, i in enumerate(x.tolist())} if end < b else {} for x in (ids[a:cut], ids[cut:end]))
                told = [(x, y) if x in here else (y, x) for x, y in zip(ids[end:b].tolist(), other[end:b].tolist())]
                apart = [(here[x], there[y]) for x, y in told if x in here and y in there]
                both = None if labels is None else (labels[a:cut], labels[cut:end])
                may = may_link(words, sets, files, most, slice(a, cut), slice(cut, end))
                yield from links_out(files[a:cut], ids[a:cut], ids[cut:end], disjoint(lambda known: one.links_to(two, limit, both, known, may), apart, forests))
    give_back()


def groups_of(batches: Iterator[pa.RecordBatch], key: str, least: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key``, in runs of whole groups with ``least`` rows or more (but for the last)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if "shingles" in batch.schema.names:
            least = SET_ROWS
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        x = whole.column(key).to_numpy()
        cut = int(np.searchsorted(x, x[-1]))
        if cut:
            yield whole.slice(0, cut)
        held = [whole.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def block_files(kinds: DataFrame, limit: int, file_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(file, id, f0) of ``kinds`` (f0): rows within ``limit`` bits meet in a file.

    The bits are cut into ``limit + 1`` blocks. Two codes that differ in at most ``limit`` bits agree on a block, so each code is
    filed under every block with its bits there. Files of more than ``file_rows`` rows are filed again in the same way by the
    bits that their members need not share, as long as there are bits enough; so a file shares more bits the more rows there are.
    """
    width, blocks = 64, limit + 1
    rows = kinds.select(F.lit(0).cast("long").alias("file"), F.col("f0").alias("id"), "f0", F.col("f0").alias("rest"))
    done = None
    used = 0
    while True:
        size = width // blocks
        used += size + blocks.bit_length()
        if size < 4 or used > 62:  # too few bits are left to tell rows apart
            break
        options = []
        for k in range(blocks):
            low, high = k * size, (k + 1) * size
            bits = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << size) - 1))
            above = F.shiftleft(F.shiftrightunsigned("rest", high), low) if high < 64 else F.lit(0).cast("long")
            rest = above.bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << low) - 1)))
            file = F.shiftleft(F.shiftleft(F.col("file"), blocks.bit_length()).bitwiseOR(F.lit(k)), size).bitwiseOR(bits)
            options.append(F.struct(file.cast("long").alias("file"), rest.cast("long").alias("rest")))
        rows = rows.select("id", "f0", F.explode(F.array(*options)).alias("o")).select("o.file", "id", "f0", "o.rest")
        width -= size
        large = save(rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > file_rows).select("file"), "large-blocks")
        if large.isEmpty():
            break
        rows = save(rows, "blocks")
        small = rows.join(large, "file", "left_anti")
        # files of different rounds have numbers of different lengths: a leading bit tells them apart
        done = small if done is None else done.unionByName(small)
        rows = rows.join(large, "file", "left_semi").withColumn("file", F.col("file").bitwiseOR(F.lit(1 << used)))
        used += 1
    out = rows if done is None else done.unionByName(rows)
    return out.select("file", "id", "f0")


def simhash_groups(docs: DataFrame, words: int = 3, limit: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``; fingerprints link at ``limit`` or fewer differing bits.

    ``component_id`` is the smallest identifier reachable over links, the row's own included. All fingerprints link, those of
    rows without identifier too; only a component without any identifier has a null one. Null and wordless texts have
    fingerprint zero and link like others; repeated rows are all returned. Other columns are not read; an empty table gives no rows.
    """
    prints = with_fingerprints(docs, words, id_col, text_col).withColumn("salt", F.monotonically_increasing_id())
    prints = save(prints, "fingerprints")
    kinds = save(prints.groupBy("f0").agg(F.min("doc_id").alias("least")), "kinds")
    found = components(links_in_files(block_files(kinds, limit), limit))
    named = save(kinds.join(found.withColumnRenamed("node", "f0"), "f0", "left").withColumn("component", F.coalesce("component", "f0")), "named-kinds")
    named = attach_totals(named, ["component"], F.col("f0"), {"_least": F.min("least")}, {"component_id": F.min("_least")})
    rows = attach(prints, named.select("f0", "component_id"), "f0", F.col("salt"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Signature of the similarity search: words of 64 bits, bands, bits of a band.
WIDE, BANDS, BAND_BITS = 8, 44, 16
#: The bands of a first round; most groups are connected by then. How much the links passed on grow with each further round.
FIRST_BANDS, FORESTS = 8, 4


def set_of(text: str | None, words: int) -> np.ndarray:
    """The different shingles of a text, sorted."""
    return np.unique(shingle_hashes(text or "", words))


def band_bits() -> np.ndarray:
    """The bits of the signature that each band holds, band after band."""
    rng = np.random.default_rng(SEED)
    rounds = -(-BANDS * BAND_BITS // (64 * WIDE))
    return np.concatenate([rng.permutation(64 * WIDE) for _ in range(rounds)])[: BANDS * BAND_BITS]


def band_masks() -> np.ndarray:
    """The same as a mask of words for each band."""
    out = np.zeros((BANDS, WIDE), np.uint64)
    for band, bits in enumerate(band_bits().reshape(BANDS, BAND_BITS)):
        for k in bits.tolist():
            out[band, k // 64] |= np.uint64(1 << (63 - k % 64))
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, d0, d1, f0 .. f7, bands``: a digest of the set of shingles, its wide SimHash, and ``BANDS`` selections of its bits; rows without any word are left out."""
    importable(docs.sparkSession)
    bits = band_bits()
    names = ["d0", "d1", *[f"f{k}" for k in range(WIDE)]]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            prints, kept = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                hashes = set_of(text, words)  # the similarity is one of sets
                if len(hashes):
                    digest = xxhash.xxh3_128_intdigest(hashes.tobytes(), SEED)
                    prints.append([digest >> 64, digest & ((1 << 64) - 1), *[fingerprint(mixed(hashes, j)) for j in range(WIDE)]])
                    kept.append(k)
            columns = np.array(prints, np.uint64).reshape(-1, WIDE + 2)
            each = np.unpackbits(np.ascontiguousarray(columns[:, 2:]).astype(">u8").view(np.uint8).reshape(-1, 8 * WIDE), axis=1)[:, bits]
            bands = np.packbits(each, axis=1).reshape(-1, 2).astype(np.int32) @ np.array([256, 1], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
            signed = columns.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(kept, pa.int64())), *[pa.array(np.ascontiguousarray(signed[:, j])) for j in range(WIDE + 2)], lists], names=["doc_id", *names, "bands"])

    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", bands array<int>")


def shingle_sets(named: DataFrame, docs: DataFrame, words: int, short: bool = False) -> DataFrame:
    """``doc_id, shingles`` of the texts that ``named`` (doc_id) names: sorted hashes of their different shingles, saved. ``short``: 32 bits of each."""
    kind = pa.int32() if short else pa.int64()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2_000_000):
            sets = [set_of(text, words) for text in batch.column("text").to_pylist()]
            sets = [np.unique(x.astype(np.uint32)).view(np.int32) if short else x.view(np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(kind))], names=["doc_id", "shingles"])

    return save(docs.select("doc_id", "text").join(named, "doc_id", "left_semi").mapInArrow(make, f"doc_id long, shingles array<{'int' if short else 'long'}>"), "short-sets" if short else "candidate-sets")


def jaccard_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose ``sets`` (doc_id, shingles) have the Jaccard similarity or more; Spark's array functions count the shared ones."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"{x}_set"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(shared >= similarity * (F.size("a_set") + F.size("b_set") - shared) - 1e-9).select("a", "b")


def near_duplicate_links(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Links (a, b) between rows of ``docs`` (doc_id, text) of at least that Jaccard similarity over word shingles.

    Rows with equal sets of shingles are linked at once, and one of them stands for all. Candidates agree on a band of a
    512-bit SimHash and lie within the bits of one of its words that the similarity allows (three standard deviations), as
    the Gray index finds them; the whole signature and then the sets decide.

    An index passes on candidates that would connect what is not connected yet, so a large group brings a few for each
    member. A candidate that fails connects nothing: files with such candidates are searched again, with only verified links
    counted as connections and whole signatures compared. Files that still have failed candidates are searched once more with the
    sets of their rows, as 32-bit numbers, and the index itself compares them: candidates that fail, of which a large group may
    have the square of its size, leave no task. (Two shingles of a pair share a number by chance less than once in a million pairs
    of short texts. A candidate that then fails is left out, and ``FORESTS`` times as many links are told.) Rounds end when no file has a
    candidate between rows that verified links do not connect. A pair just at the limit shares a band with probability
    0.96, closer pairs almost surely.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = save(signatures(docs, words), "signatures")
    names = [f"f{k}" for k in range(WIDE)]
    kinds = marks.groupBy("d0", "d1").agg(F.min("doc_id").alias("id"), *[F.first(n).alias(n) for n in (*names, "bands")])
    kinds = save(kinds.filter("id is not null"), "signature-kinds")
    # bands compare different words of the signature, so that their errors differ
    word = F.element_at(F.array(*names), F.pmod(F.col("band"), F.lit(WIDE)) + 1)
    differ = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    limit, most = (int(n * differ + 3 * (n * differ * (1 - differ)) ** 0.5) for n in (64, 64 * WIDE))
    side = lambda x: kinds.select(F.col("id").alias(x), *[F.col(n).alias(f"{x}_{n}") for n in names])
    apart_bits = sum((F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}"))) for n in names), F.lit(0))
    links, sets, failed, again = None, None, None, None
    labelled = kinds.withColumn("label", F.col("id"))
    for number in count():
        filed = labelled.select("id", "label", *names, F.posexplode("bands").alias("band", "bits"))
        # searched again, files have whole signatures, by which a pair is looked at once, and then the sets, by which it is decided there
        wide = [F.array(*names).alias("words")] if number > 1 else []
        filed = filed.select("band", (F.col("band") * 65536 + F.col("bits")).cast("long").alias("file"), "id", word.alias("f0"), "label", *wide)
        fresh = filed.filter(F.col("band") < FIRST_BANDS if number == 0 else F.col("band") >= FIRST_BANDS)
        if number:
            old = filed.filter(F.col("band") < FIRST_BANDS) if number == 1 else filed
            fresh = fresh.unionByName(old.join(again, "file", "left_semi")) if number == 1 else old.join(again, "file", "left_semi")
        if number > 2:
            short = shingle_sets(fresh.select(F.col("id").alias("doc_id")).distinct(), docs, words, short=True)
            fresh = fresh.join(short.withColumnRenamed("doc_id", "id"), "id")
        found = links_in_files(fresh.drop("band"), limit, SET_ROWS if number > 2 else SEGMENT_ROWS, failed, FORESTS ** max(0, number - 3), most, similarity)
        found = save(found.select("file", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "candidates")
        close = save(found.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").filter(apart_bits <= most).select("a", "b"), "close-candidates")
        named = close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        if sets is not None:
            named = save(named.join(sets, "doc_id", "left_anti"), "named")
        if sets is None or not named.isEmpty():
            more = shingle_sets(named, docs, words)
            sets = more if sets is None else sets.unionByName(more)
        good = save(jaccard_links(close, sets, similarity), "near-links")
        any_good = not good.isEmpty()
        links = good if links is None else save(links.unionByName(good), "near-links") if any_good else links
        bad = save(found.join(good, ["a", "b"], "left_anti").select("file", "a", "b"), "failed-candidates")
        failed = bad if failed is None else save(failed.unionByName(bad), "failed-candidates")
        # from now on links are looked for between what is not connected yet
        if any_good:
            known = components(links).select(F.col("node").alias("id"), F.col("component").alias("label"))
            labelled = save(kinds.join(known, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled-kinds")
        # a failed candidate whose ends are connected all the same has hidden no link of its file
        label = lambda x: labelled.select(F.col("id").alias(x), F.col("label").alias(f"{x}_label"))
        again = save(bad.join(label("a"), "a").join(label("b"), "b").filter("a_label != b_label").select("file").distinct(), "files-again")
        if number and again.isEmpty():
            break
    same = attach_totals(marks.select("doc_id", "d0", "d1"), ["d0", "d1"], F.col("doc_id"), {"_id": F.min("doc_id")}, {"id": F.min("_id")})
    return links.unionByName(same.filter("doc_id != id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, row_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns kept, less all but the smallest doc_id of each group of linked rows.

    Null and wordless texts and rows without identifier link to nothing and stay; rows that repeat an identifier share its
    fate; an empty table stays empty. With ``row_col``, a column of different longs in a saved table, each row is linked and decided by itself,
    rows without identifier too: of a group the smallest (doc_id, row) stays, a null doc_id last.
    """
    if row_col:
        rows = docs.select(F.col(row_col).alias("_row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row_col).alias("row")).alias("_place"))
        linked = components(near_duplicate_links(docs.select(F.col(row_col).alias("doc_id"), "text"), words, similarity)).withColumnRenamed("node", "_row")
        linked = save(linked.join(rows, "_row"), "linked-rows")
        linked = attach_totals(linked, ["component"], F.col("_row"), {"_least": F.min("_place")}, {"_first": F.min("_least")})
        gone = linked.filter("_place != _first").select(F.col("_row").alias("_node"))
        return docs.join(gone, docs[row_col] == gone["_node"], "left_anti")
    found = components(near_duplicate_links(docs, words, similarity)).filter("node != component").select(F.col("node").alias("_node"))
    return docs.join(found, docs["doc_id"] == found["_node"], "left_anti")
