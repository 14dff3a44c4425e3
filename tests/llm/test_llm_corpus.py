"""Operators that compare or arrange the whole corpus: copies, hosts, fingerprints, token files, packing, pipeline."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from rateloom.llm import components as graph
from rateloom.llm import content_sort, decontam_cgk, ffd_packing, queries, token_files, url_reputation
from rateloom.llm import simhash_gray as simhash
from rateloom.llm.word_cache import WordCache
from rateloom.shared import save

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = [(1, "a b"), (2, None), (3, ""), (4, "word " * 60_000), (4, "word " * 60_000), (None, "x y z"), (None, "x y z"), (5, "a b")]


@pytest.fixture(scope="module")
def odd_docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, 3) for i, t in DOCS], "doc_id long, text string, lang string, source string, body int, part int, n_chars int")


def test_exact_copies_edges(spark, odd_docs):
    rows = content_sort.content_sort(odd_docs, keep="max").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert by[1] == [(5, 2, False)] and by[5] == [(5, 2, True)] and by[2] == [(3, 2, False)] and by[3] == [(3, 2, True)]
    assert sorted(by[4]) == [(4, 2, False), (4, 2, True)] and sorted(by[None], key=str) == [(None, 2, False), (None, 2, True)]
    assert content_sort.content_sort(odd_docs.limit(0)).count() == 0
    low = {r.doc_id: r.keep_id for r in content_sort.content_sort(odd_docs).collect()}
    assert low[5] == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_oracle(name, spark, sf_dir):
    con = duckdb.connect()
    for t in "documents pages labels benchmark embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs) > 0
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (ours, theirs))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_exact_copies_under_hot_heads(spark):
    """Copies of one text, many texts under one long heading, null and repeated identifiers: salted or not, the rows are the same."""
    df = spark.range(1200).selectExpr("CASE WHEN id % 11 = 0 THEN NULL WHEN id % 5 = 0 THEN 5 ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' WHEN id % 3 = 1 THEN concat(repeat('heading ', 12), id % 7) WHEN id % 2 = 0 THEN NULL ELSE concat('t', id) END AS text")
    texts = [(r.doc_id, r.text or "") for r in df.collect()]
    for keep in (min, max):
        salted, plain = (sorted(map(tuple, content_sort.content_sort(df, keep=keep.__name__, head_rows=n).collect()), key=str) for n in (40, 5000))
        assert [r[:3] + r[4:] for r in salted] == [r[:3] + r[4:] for r in plain] and sum(r[3] for r in salted) == sum(r[3] for r in plain) == len({t for _, t in texts})
        groups = {}
        for d, t in texts:
            groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(d)
        for d, keep_id, size, kept, digest in salted:
            ids = [x for x in groups[digest] if x is not None]
            assert size == len(groups[digest]) and keep_id == (keep(ids) if ids else None) and (not kept or d == keep_id)


def test_exact_copies_hot_group(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    rows = content_sort.content_sort(df, keep="max")
    assert rows.filter("kept").count() == 2001 and rows.filter("group_size = 1000 AND keep_id = 2997").count() == 1000


def test_hosts_and_rules(spark):
    urls = ["http://Example.NET/en/x?q", "https://sub.example.net/fr/", "http://example.com/de/1", "http://notexample.com/de/1", "http://a.org/fr/#x", "http://a.org", "http://net/", "http://x.net", None, "nohost", "ftp://H:80?x", "a://b://c/d", "http://\u00c9A.net/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r.page_id: r for r in url_reputation.judge_urls(df, spark.createDataFrame([(1, 1)], "page_id long, bad int"), queries.URL_RULES).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(k, r) for k, r in queries.URL_RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        best = max(fits, key=lambda x: len(x[1]), default=None)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, best and best[1]), u
        assert not best or out[i].verdict == best[0]
    assert url_reputation.judge_urls(df.limit(0), spark.createDataFrame([], "page_id long, bad int"), queries.URL_RULES).count() == 0


def test_reputation_shrinks(spark):
    rng = random.Random(1)
    pages, bad = [], []
    for h in range(40):
        rate = 0.9 if h < 4 else 0.05
        for _ in range(60):
            bad.append((len(pages), int(rng.random() < rate)))
            pages.append((len(pages), f"http://h{h}.d{h % 8}.com/x"))
    pages += [(10_000, "http://new.d1.com/"), (10_001, "http://unknown.fr/")]
    out = {r.page_id: r for r in url_reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int"), []).collect()}
    assert all(out[i].verdict == ("block" if int(re.search(r"h(\d+)", u)[1]) < 4 else "allow") for i, u in pages[:-2])
    assert out[10_000].verdict == out[10_001].verdict == "allow" and 0.02 < out[10_000].bad_rate < 0.5


def test_many_rules_are_joined(spark):
    """The same verdicts whether rules are listed or joined."""
    rng = random.Random(4)
    names = [".".join(rng.choices(["a", "b", "example", "org"], k=k)) for k in (1, 2, 2, 3, 3)]
    rules = sorted({(rng.choice(["block", "allow"]), f"{n}/{''.join(rng.choices(['x/', 'y', 'z/'], k=rng.randint(0, 3)))}") for n in names for _ in range(12)}, key=lambda r: (r[1], r[0]))
    rules = list({r[1]: r for r in rules}.values())
    rows = [(i, ".".join(rng.choices(["a", "b", "example", "org"], k=rng.randint(1, 4))), "/" + "".join(rng.choices(["x/", "y", "z/"], k=rng.randint(0, 4)))) for i in range(400)] + [(400, "", "")]
    df = spark.createDataFrame(rows, "page_id long, host string, path string")
    listed, joined = ({r.page_id: (r.rule, r.rule_verdict) for r in url_reputation.with_rules(df, rules, n).collect()} for n in (500, 1))
    assert listed == joined and sum(v[0] is not None for v in listed.values()) > 50


def test_bad_hosts_are_blocked_in_the_tables(spark):
    """The tables' hosts are alike (their texts are dealt at random), so none is blocked; hosts that get low-quality pages are,
    and a host with one bad page is not, as it would be without the prior."""
    pages, docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("pages", "documents", "labels"))
    outcomes = {r.page_id: r.bad for r in url_reputation.page_outcomes(pages, docs, labels).collect()}
    assert len(outcomes) > 900 and 0.05 < sum(outcomes.values()) / len(outcomes) < 0.3
    bad = sorted(i for i, b in outcomes.items() if b)
    moved = {i: "https://spam.example.com/x" for i in bad[:60]} | {bad[61]: "https://once.example.com/x"}
    url = F.create_map(*[F.lit(x) for kv in moved.items() for x in kv])[F.col("page_id")]
    judged = url_reputation.judge_urls(pages.withColumn("url", F.coalesce(url, "url")), url_reputation.page_outcomes(pages, docs, labels), [])
    blocked = {r.host: r.n for r in judged.groupBy("host").agg(F.count("page_id").alias("n"), F.max("verdict").alias("v")).filter("v = 'block'").collect()}
    assert blocked == {"spam.example.com": 60}
    assert url_reputation.judge_urls(pages, url_reputation.page_outcomes(pages, docs, labels), []).filter("verdict = 'block'").count() == 0


def test_page_outcomes_edges(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "h://a/" + "x" * 100_000, "<article><h1>T</h1><p>One &amp; <b>t</b>wo</p></article>", "q"), (1, "h://a/", "<article><p>One &amp; two</p></article>", "q"), (2, None, None, None), (3, "h://b/", "", ""), (None, "h://c/", "<p>bad  one</p>", "")]
    pages = spark.createDataFrame(rows, schema)
    docs = spark.createDataFrame([(1, "One & two"), (2, "bad\none"), (3, None), (4, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (3, 0), (4, 0), (None, 0)], "doc_id long, quality int")
    assert sorted((r.page_id, r.bad) for r in url_reputation.page_outcomes(pages, docs, labels).collect() if r.page_id) == [(1, 0), (1, 0)]
    assert [(r.page_id, r.bad) for r in url_reputation.page_outcomes(pages, docs, labels).collect() if r.page_id is None] == [(None, 1)]
    assert url_reputation.judge_urls(pages, url_reputation.page_outcomes(pages, docs, labels), queries.URL_RULES).count() == 5
    assert url_reputation.page_outcomes(pages.limit(0), docs, labels).count() == 0


def brute_groups(prints, limit):
    ids, bits = np.array(list(prints)), np.array(list(prints.values()), np.uint64)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(bits[k + 1 :] ^ bits[k]) <= limit) + k + 1:
            a, b = find(k), find(int(j))
            if ids[a] > ids[b]:
                a, b = b, a
            parent[b] = a
    return {int(ids[k]): int(ids[find(k)]) for k in range(len(ids))}


def test_simhash_matches_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: simhash.fingerprint(simhash.shingle_hashes(t or "", 3)) for i, t in texts.items()}
    rows = queries.op7_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_groups(prints, 3)
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] for r in rows)


def test_shingle_hashes_are_xxh64(spark):
    text = "A\u00c9b  c\td E\nf \u00a0 g"
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    want = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(" ".join(words[k : k + 3]),) for k in range(len(words) - 2)], "s string").selectExpr("xxhash64(s)").collect()]
    assert simhash.shingle_hashes(text, 3).tolist() == want
    assert len(simhash.shingle_hashes("", 3)) == 0 and len(simhash.shingle_hashes("one two", 3)) == 1
    hashes = np.array([0b1011, 0b0011, 0b0110], np.uint64)
    assert simhash.fingerprint(hashes) == 0b0011 and simhash.fingerprint(hashes[:2]) == 0b0011


def linked(size, links):
    parent = list(range(size))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(size)}


def families(rng, size, flips=4):
    centres = rng.integers(0, 1 << 63, max(2, size // 20)).astype(np.uint64)
    changes = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, flips), replace=False)) for _ in range(size)], np.uint64)
    return centres[rng.integers(0, len(centres), size)] ^ changes


@pytest.mark.parametrize("size", [1, 9, 40, 700])
def test_gray_index_links_everything(size):
    bits = families(np.random.default_rng(size), size)
    links = list(simhash.GrayIndex(bits).links(3))
    assert all(np.bitwise_count(bits[a] ^ bits[b]) <= 3 for a, b in links)
    assert linked(size, links) == brute_groups({i: int(x) for i, x in enumerate(bits)}, 3)


def test_gray_index_between_segments_and_files():
    rng = np.random.default_rng(3)
    bits = families(rng, 300)
    half = {i: int(x) for i, x in enumerate(bits)}
    across = [(a, b + 150) for a, b in simhash.GrayIndex(bits[:150]).links_to(simhash.GrayIndex(bits[150:]), 3)]
    inside = list(simhash.GrayIndex(bits[:150]).links(3)) + [(a + 150, b + 150) for a, b in simhash.GrayIndex(bits[150:]).links(3)]
    assert linked(300, across + inside) == brute_groups(half, 3)
    files = rng.integers(0, 5, 300).astype(np.uint64)
    got = linked(300, simhash.GrayIndex(bits, files).links(3))
    for f in range(5):
        own = np.flatnonzero(files == f).tolist()
        want = brute_groups({i: half[i] for i in own}, 3)
        assert {i: got[i] for i in own} == want


def test_gray_index_leaves_groups_out():
    """Few pairs are looked at: with the sums switched off every fingerprint meets every other."""
    bits = np.unique(np.random.default_rng(9).integers(0, 1 << 63, 16_000).astype(np.uint64))
    met = 0

    class Counted(simhash.GrayIndex):
        def _join(self, other, first, a, b, limit):
            nonlocal met
            met += len(a) * simhash.FAN**2
            return super()._join(other, first, a, b, limit)

    list(Counted(bits).links(3))
    assert met < 0.25 * len(bits) ** 2 / 2
    index = simhash.GrayIndex(bits)
    for level in range(len(index.own) - 1):  # factored: no bit stands in a node and in one above it
        assert not (index.own[level][0] & np.repeat(index.own[level + 1][0], simhash.FAN)[: len(index.own[level][0])]).any()


def test_large_files_are_cut_in_segments(spark):
    """A hot file: far more fingerprints than a segment takes, beside small files."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 40, 300)
    bits = {i: int(centres[i % 300]) ^ (1 << int(rng.integers(0, 40))) ^ (1 << int(rng.integers(0, 40))) for i in range(2600)}
    small = {10_000 + i: int(x) >> 1 for i, x in enumerate(families(rng, 60))}
    df = spark.createDataFrame([(7, i, b) for i, b in bits.items()] + [(i % 3, i, b) for i, b in small.items()], "file long, id long, f0 long")
    links = graph.components(simhash.links_in_files(df, 3, segment_rows=200)).collect()
    got = {i: i for i in (*bits, *small)} | {r.node: r.component for r in links}
    want = brute_groups(bits, 3)
    for f in range(3):
        want |= brute_groups({i: b for i, b in small.items() if i % 3 == f}, 3)
    assert got == want


@pytest.mark.parametrize("file_rows", [4, 30, 100_000])
def test_blocks_bring_every_link_together(spark, file_rows):
    """Families around few centres, with negative codes; files cut again and again by what their members need not share."""
    bits = np.unique(families(np.random.default_rng(11), 600))
    bits = np.unique(np.concatenate([bits, np.array([0, 7, (1 << 64) - 1, (1 << 64) - 8], np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in bits.view(np.int64)], "f0 long")
    filed = simhash.block_files(df, 3, file_rows)
    assert filed.count() <= len(bits) * 4 ** (1 if file_rows > 1000 else 4)
    place = {int(x): i for i, x in enumerate(bits.view(np.int64))}
    links = [(place[r.a], place[r.b]) for r in simhash.links_in_files(filed, 3).collect()]
    assert all(np.bitwise_count(bits[a] ^ bits[b]) <= 3 for a, b in links)
    assert linked(len(bits), links) == brute_groups({i: int(x) for i, x in enumerate(bits)}, 3)
    files = {}
    for r in filed.collect():
        files.setdefault(r.file, set()).add(r.f0 & (1 << 64) - 1)
    for members in files.values():  # a file's members share a block at least
        same = ~(int(np.bitwise_or.reduce(np.array(list(members), np.uint64))) ^ int(np.bitwise_and.reduce(np.array(list(members), np.uint64)))) & (1 << 64) - 1
        assert any((same >> k) & 0xFFFF == 0xFFFF for k in (0, 16, 32, 48))


def test_index_grows_with_its_input(spark):
    """Random fingerprints in many small files: no file grows beyond what one more cut leaves, and a row is copied 16 times at most."""
    df = spark.range(120_000).select(F.xxhash64("id").alias("f0"))
    filed = simhash.block_files(df, 3, file_rows=8)
    assert filed.count() <= 4 * 4 * 120_000 and filed.groupBy("file").count().agg(F.max("count")).first()[0] <= 64


def test_simhash_edges(spark, odd_docs):
    rows = {}
    for r in simhash.simhash_groups(odd_docs).collect():
        rows.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert rows[2] == rows[3] == {("0" * 16, 2)} and len(rows[1]) == 1 and {c for _, c in rows[1] | rows[5]} == {1} and {c for _, c in rows[4]} == {4}
    assert {c for _, c in rows[None]} == {None}
    assert simhash.simhash_groups(odd_docs.limit(0)).count() == 0


def test_rows_without_identifier_link_others(spark, monkeypatch):
    prints = {1: 0, None: 0b111, 3: 0b111111, 9: 0xFFFFFF << 30}
    monkeypatch.setattr(simhash, "with_fingerprints", lambda docs, *_: docs.select("doc_id", F.col("text").cast("long").alias("f0")))
    docs = spark.createDataFrame([(i, str(x)) for i, x in prints.items()], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()} == {1: 1, None: 1, 3: 1, 9: 9}


def test_equal_signatures_are_compared_by_their_sets(spark, monkeypatch):
    """Signatures say nothing here: each row shares enough with the next alone, not with the first."""
    monkeypatch.setattr(simhash, "fingerprint", lambda hashes: 5)
    words = [f"w{k}" for k in range(140)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 100])) for k in range(4)]
    kept = [r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert kept == [0]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 700)] + [(900, 900), (3, 2), (2, 3), (None, 4)]
    rng = random.Random(2)
    rng.shuffle(edges)
    out = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 100 for k in range(100, 161)} | {k: 500 for k in range(500, 700)} | {2: 2, 3: 2}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, odd_docs):
    rng = random.Random(8)
    rows, base = [], {}
    for g in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        base[g] = len(rows)
        rows.append((len(rows), " ".join(words)))
        for k in range(3):
            copy = list(words)
            for _ in range(k + 1):
                copy[rng.randrange(200)] = "changed"
            rows.append((len(rows), " ".join(copy)))
    far = [f"v{k}" for k in range(200)]
    rows += [(len(rows), " ".join(far)), (len(rows) + 1, " ".join(far[:100] + [f"u{k}" for k in range(100)]))]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(base.values()) | {160, 161}
    assert simhash.drop_near_duplicates(odd_docs).columns == odd_docs.columns
    assert simhash.drop_near_duplicates(odd_docs).filter("doc_id IS NULL").count() == 2
    assert simhash.drop_near_duplicates(odd_docs.limit(0)).count() == 0


def test_near_duplicates_of_families(spark):
    """Families of 200 texts whose pairs are 0.7 to 0.9 alike: hardly a link is lost, and no row is dropped without one."""
    rng = random.Random(21)
    rows = []
    for family in range(3):
        words = [f"f{family}w{rng.randrange(9000)}" for _ in range(300)]
        for _ in range(200):
            copy = list(words)
            for _ in range(rng.randint(2, 7)):
                copy[rng.randrange(300)] = f"c{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    sets = [set(simhash.set_of(t, 5).tolist()) for _, t in rows]
    edges = [(a, b) for f in range(3) for a in range(200 * f, 200 * f + 200) for b in range(a + 1, 200 * f + 200) if (n := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    want, members = linked(len(rows), edges), {}
    assert 0.1 * 3 * 19_900 < len(edges) < 0.9 * 3 * 19_900
    links = [tuple(r) for r in simhash.near_duplicate_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    got = linked(len(rows), links)
    assert set(links) <= {*edges}
    for k in range(len(rows)):
        members.setdefault(want[k], []).append(k)
    held = sum(max(sum(got[i] == got[k] for i in group) for k in group) - 1 for group in members.values())
    assert held >= 0.98 * sum(len(group) - 1 for group in members.values())


@pytest.mark.parametrize("segment_rows", [60, 100_000])
def test_links_that_failed_are_replaced(spark, segment_rows):
    """Fingerprints that are all alike: with the pairs told apart left out, further forests bring every other pair in the end."""
    filed = spark.createDataFrame([(f, 100 * f + i, (i % 3) << 5, 100 * f + i) for f in range(2) for i in range(90)], "file long, id long, f0 long, label long")
    apart, seen = None, set()
    for forests in (1, 2, 64):
        found = [tuple(r) for r in simhash.links_in_files(filed, 3, segment_rows, apart, forests).collect()]
        pairs = {(f, min(a, b), max(a, b)) for f, a, b in found}
        assert len(pairs) == len(found) and not pairs & seen and all(a // 100 == b // 100 == f for f, a, b in pairs)
        assert len(pairs) >= 2 * 89 * min(forests, 30)
        seen |= pairs
        apart = spark.createDataFrame(sorted(seen), "file long, a long, b long")
    assert len(seen) == 2 * 90 * 89 // 2


def test_pairs_are_told_in_their_first_band():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 64, (40, simhash.WIDE), dtype=np.uint64)
    words[20:] = words[:20]
    for k in range(20):  # near copies: a few bits of each word differ
        for w in range(simhash.WIDE):
            for b in rng.choice(64, 5, replace=False):
                words[20 + k, w] ^= np.uint64(1 << int(b))
    each = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(40, -1), axis=1)[:, simhash.band_bits()].reshape(40, simhash.BANDS, simhash.BAND_BITS)
    for a, b in [(k, 20 + k) for k in range(20)]:
        shared = np.flatnonzero((each[a] == each[b]).all(axis=1)).tolist()
        for band in range(simhash.BANDS):
            may = simhash.told_here(words, words, np.full(40, band * 65536 + 3), 60)
            if band in shared:
                assert may(np.array([a]), np.array([b]))[0] == (band == shared[0])
        assert not simhash.told_here(words, words, np.zeros(40, np.int64), 20)(np.array([a]), np.array([b]))[0]


@pytest.mark.parametrize("segment_rows", [20, 100_000])
def test_sets_decide_in_the_index(spark, segment_rows):
    """Fingerprints and signatures that are all alike: only pairs whose sets are alike leave a task, and connect all that such pairs connect."""
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(family * 1000, family * 1000 + 24), 20)) for family in range(2) for _ in range(60)]
    edges = [(a, b) for a in range(120) for b in range(a + 1, 120) if (n := len({*sets[a]} & {*sets[b]})) >= 0.8 * (40 - n)]
    filed = spark.createDataFrame([(7, k, (k % 3) << 5, k, [1] * simhash.WIDE, x) for k, x in enumerate(sets)], "file long, id long, f0 long, label long, words array<long>, shingles array<int>")
    found = [(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links_in_files(filed, 3, segment_rows, most=10, similarity=0.8).collect()]
    assert 100 < len(edges) < 120 * 119 // 4 and {*found} <= {*edges}
    assert linked(120, found) == linked(120, edges)


def test_failed_candidates_of_a_large_group_stay_in_their_tasks(spark, monkeypatch):
    """250 texts are just under 0.8 alike to 150 near copies: the fourth round tells links alone and is the last."""
    rng, rows, made = random.Random(4), [], {}
    words = [f"w{k}" for k in range(300)]
    for k in range(400):
        copy = list(words)
        for at in rng.sample(range(300), 1 if k % 8 < 3 else 8):
            copy[at] = f"c{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))

    def counted(df, label):
        out = save(df, label)
        made.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "save", counted)
    links = [tuple(r) for r in simhash.near_duplicate_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    sets = [set(simhash.set_of(t, 5).tolist()) for _, t in rows]
    edges = [(a, b) for a in range(400) for b in range(a + 1, 400) if (n := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    assert {*links} <= {*edges} and linked(400, links) == linked(400, edges)
    assert made["failed-candidates"][0] > 100  # of the first round: one for a row and file at most
    rounds = len(made["candidates"])
    assert rounds <= 4 and (rounds < 4 or made["failed-candidates"][5] == 0)


def test_near_duplicates_with_repeated_lines(spark):
    """The same shingle set, a line once or fifty times."""
    head, line = " ".join(f"h{k}" for k in range(104)), " ".join(f"r{k}" for k in range(10))
    rows = [(1, f"{head} {line} {line}"), (2, f"{head} {line}" + f" {line}" * 49), (3, line), (4, " ".join([line] * 30))]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1, 3, 4}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "Bc", "\u00e9", "\u00df", "1", "'s", ".", ",", "\u3000", "\u00a0", "\x1c", "\x1f", "\u0301", "\u0130", "<|endoftext|>", "\u4e2d"]), max_size=25))
def test_cached_encoding_is_plain_encoding(parts):
    text = "".join(parts)
    for path, spaces in ((BYTE, True), (WORD, False)):
        key = (path, spaces)
        test_cached_encoding_is_plain_encoding.__dict__.setdefault("held", {})
        held = test_cached_encoding_is_plain_encoding.__dict__["held"]
        if key not in held:
            held[key] = (WordCache(path, spaces, limit=200), Tokenizer.from_file(path))
        cached, plain = held[key]
        got = cached.encode(pa.array([text, "x " + text, None]))
        assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in (text, "x " + text, "")]


def test_token_files_round_trip(spark, sf_dir):
    plain = Tokenizer.from_file(BYTE)
    want, start = {}, 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_files(spark, sf_dir).collect()} == want


def test_token_files_random_access(spark, odd_docs):
    manifest = token_files.write_token_files(odd_docs, BYTE, 0, seq_len=64, rows_per_batch=8).orderBy("part").collect()
    plain = Tokenizer.from_file(BYTE)
    stream = []
    for _, t in sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0)):
        stream += [*plain.encode(t or "", add_special_tokens=False).ids, 0]
    got = []
    for m in manifest:
        f = token_files.SequenceFile(m.path.removeprefix("file://"))
        for i in reversed(range(len(f))):
            assert len(f.ids(i)) == 64
        for i in range(len(f)):
            got += f.ids(i)[: f.mask(i).true_count].tolist()
    assert got == stream
    rows = token_files.read_token_files(token_files.write_token_files(odd_docs, BYTE, 0)).collect()
    assert len(rows) == len(DOCS) and sum(r.n_tokens for r in rows) == len(stream)
    assert token_files.read_token_files(token_files.write_token_files(odd_docs.limit(0), BYTE, 0)).count() == 0


def check_packing(rows, docs, capacity):
    plain = Tokenizer.from_file(WORD)
    want = sorted(((d, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in docs), key=str)
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r.length for r in rows) == sum(len(i) for _, i in want)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id is not None) == sorted((d, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(i)) for d, i in want for k in range(0, len(i), capacity) for p in [i[k : k + capacity]] if d is not None)
    return 1 - sum(r.length for r in rows) / capacity / len(used)


def test_packing(spark, sf_dir, odd_docs):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check_packing(queries.op10_packing(spark, sf_dir).collect(), docs, 4096) < 0.05
    check_packing(ffd_packing.pack(odd_docs, WORD, 2, 512, group_pieces=16).collect(), DOCS, 512)
    assert ffd_packing.pack(odd_docs.limit(0), WORD, 2).count() == 0


def test_first_fit_matches_plain_scan():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 100, rng.integers(1, 200))
        bins, offsets = ffd_packing.first_fit_decreasing(sizes, 100)
        free = []
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if k == len(free):
                free.append(100)
            assert (bins[i], offsets[i]) == (k, 100 - free[k])
            free[k] -= sizes[i]


def brute_leaking(texts, items, similarity=0.8):
    """Documents with a window that repeats an item, by the plain edit distance at every word; windows with too few of an item's words are passed over."""
    out = set()
    for d, text in texts.items():
        words = decontam_cgk.words_of(text or "")
        for item in items:
            run = decontam_cgk.words_of(item)
            most = int((1 - similarity) * len(run) + 1e-9)
            known = np.concatenate([[0], np.cumsum([w in set(run) for w in words], dtype=int)])
            for s in range(len(words)):
                e = min(len(words), s + len(run) + most)
                if run and known[e] - known[s] >= len(run) - most and decontam_cgk.prefix_edits(run, words[s:e], most)[0] <= most:
                    out.add(d)
                    break
    return out


def test_pipeline_stages_of_odd_rows(spark, sf_dir):
    """Nulls in every column, empty texts, repeated rows, extra columns with clashing names, and no rows at all."""
    rows = [(None, None, None, None, None), (None, "", None, "s", 0), (1, "plain words", "en", None, 2), (1, "plain words", "en", None, 2), (2, "w " * 30_000, "en", "s", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema + ", _row int, body int, toxic string")
    kept = {"toxicity": 5, "exact_dedup": 3, "near_dedup": 5, "decontamination": 5}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        if name == "near_dedup":  # rows with equal sets of shingles are near copies; empty ones link to nothing
            kept[name] = 4
        assert out.count() == kept[name], name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sum(r.length for r in packed if r.start == 0 and r.doc_id is None) == 2 and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_stages(spark, sf_dir):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        gone = {d: t for d, t in before.items() if d not in after}
        assert docs.columns == columns and set(after) <= set(before) and all(after[d] == before[d] for d in after)
        if name == "toxicity":
            toxic = {d for d in before if labels.get(d) == 1}
            assert sum(labels.get(d) == 0 for d in gone) <= 0.05 * len(gone) + 1 and len(toxic & set(gone)) >= 0.6 * len(toxic)  # learned from eight toxic texts
        if name == "exact_dedup":
            assert len(set(after.values())) == len(after) and all(min(d for d, x in before.items() if x == t) != g and t in after.values() for g, t in gone.items())
        if name == "near_dedup":
            sets = {d: frozenset(simhash.shingle_hashes(t or "", 5).tolist()) for d, t in before.items()}
            near = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9 and len(a | b) > 0
            ids = sorted(sets)
            linked = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if near(sets[a], sets[b])}
            assert {b for _, b in linked} == set(gone)
        if name == "decontamination":
            truth = brute_leaking(before, [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
            assert set(gone) <= truth and len(gone) >= 0.95 * len(truth) and truth
        before = after
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), list(before.items()), 4096)


def test_pipeline_decides_each_row(spark, sf_dir):
    """Rows without identifier, and rows that repeat one, decide for no other row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    add = lambda rows: docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").select([f.name for f in docs.schema]).to(docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    fresh = [" ".join(f"{x}{k}" for k in range(60)) for x in "uvw"]
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_leaks):
        gone = sorted(set(texts) - {r.doc_id for r in stage(spark, docs, sf_dir).collect()})
        rows = [(None, texts[gone[0]]), (None, fresh[0]), (-7, texts[gone[0]]), (-7, fresh[1])]
        after = stage(spark, add(rows), sf_dir).filter("doc_id IS NULL OR doc_id < 0").collect()
        assert sorted((r.doc_id, r.text) for r in after if r.doc_id) == [(-7, fresh[1])] and [r.text for r in after if r.doc_id is None] == [fresh[0]]
    rows = [(None, fresh[0]), (None, fresh[0]), (None, fresh[1]), (-7, fresh[1]), (-7, fresh[1]), (-7, fresh[2]), (None, None), (-8, "")]
    after = corpus_pipeline.drop_copies(spark, add(rows), sf_dir).filter("doc_id IS NULL OR doc_id < 0").collect()
    assert sorted(((r.doc_id, r.text) for r in after), key=str) == sorted([(None, fresh[0]), (-7, fresh[1]), (-7, fresh[2]), (-8, "")], key=str)
    rows = [(None, fresh[0]), (None, fresh[0] + " z"), (None, fresh[1]), (-7, fresh[1] + " z"), (-7, fresh[2]), (-7, fresh[2] + " z"), (None, None)]
    after = corpus_pipeline.drop_near_copies(spark, add(rows), sf_dir).filter("doc_id IS NULL OR doc_id < 0").collect()
    assert len(after) == 4 and sum(r.doc_id is None for r in after) == 2 and (-7, fresh[1] + " z") in {(r.doc_id, r.text) for r in after}
    assert {(r.text or "null").removesuffix(" z") for r in after} == {*fresh, "null"}


@pytest.mark.parametrize("path,spaces", [(queries.BYTE_TOKENIZER, True), (queries.WORD_TOKENIZER, False)])
def test_words_of_several_batches_stay_in_the_cache(path, spaces):
    """A full cache lets go of words that one batch alone held: common ones are not encoded again, and all ids stay right."""
    cache = WordCache(path, spaces, limit=60)
    learned, learn = [], cache._learn
    cache._learn = lambda new: (learned.extend(new), learn(new))[1]
    common = ["the", "quick", "häuser", "jumps", "over"]
    for k in range(12):
        texts = [" ".join([*common, *(f"w{k}x{i}y{j}" for j in range(4)), *common]) for i in range(5)]
        for text, ids in zip(texts, cache.encode(pa.array(texts))):
            assert ids.tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(cache.index) <= 60
    assert learned.count("quick") == 1 and learned.count("over") == 1
    wide = [" ".join(f"z{j}" for j in range(100))]  # more words than the cache should hold
    assert cache.encode(pa.array(wide))[0].tolist() == cache.tokenizer.encode(wide[0], add_special_tokens=False).ids
