"""Operators that search: spelling variants, ranked lexical search, nearest vectors; each against plain comparisons."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rateloom.llm import maxscore_search as maxscore
from rateloom.llm import trie_variants as trie
from rateloom.llm import va_file

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WIDE = "doc_id long, text string, word string, n long, rank int, score long, shard string, vector int"


def wide(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "s", 4) for i, t in rows], WIDE)


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_spelling(docs: list[tuple[int | None, str | None]]) -> dict[str, tuple]:
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) if near[w] else None for w in words}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w: str) -> str:
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def told(rows) -> dict[str, tuple]:
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=0, max_size=7), unique=True, max_size=40))
def test_active_nodes_are_one_edit_away(words):
    assert sorted(trie.trie_pairs(words)) == sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b))


@pytest.mark.parametrize("part_words", [1, 3, 20_000])
def test_parts_lose_no_pair(spark, part_words):
    """Dense vocabularies over few letters; parts cut again and again, down to rests of one letter."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abç") for _ in range(rng.randint(5, 8))): rng.randint(3, 9) for _ in range(500)}
    words |= {"x" * 40 + "a" * k: 5 + k for k in range(4)} | {"y" + "x" * 39: 3}
    found = {r.word: (r.n_near, r.near_n, r.near) for r in trie.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), part_words=part_words).collect()}
    want = {}
    for w in words:
        near = [v for v in words if one_edit(v, w)]
        if near:
            best = min(near, key=lambda v: (-words[v], v))
            want[w] = (len(near), words[best], best)
    assert found == want and len(want) > 300


def test_spelling_of_documents(spark):
    """Upper case, letters that case folding would join, null identifiers, repeated rows, runs that lose a letter, chains of forms."""
    rng = random.Random(9)
    stems = ["garden", "ÉTOILE", "étoile", "Éclair", "window", "bread", "breads"]
    docs: list[tuple[int | None, str | None]] = [(k, " ".join(rng.choice(stems) for _ in range(60))) for k in range(400)]
    docs += [(None, "Garden garden2garden gardem gardem gardem"), (7, None), (8, ""), (9, "a1b_c"), (10, "chaina " * 3 + "chainab " * 6 + "chainabc " * 12 + "chainabcd " * 24 + "chainabcde " * 48)]
    docs += [(11, "word " * 5)] * 2 + [(12, "z" * 70_000 + " " + ("q" * 3000 + " ") * 2 + ("q" * 3001 + " ") * 7), (13, ("q" * 3000 + " "))]
    got = told(trie.spelling_groups(wide(spark, docs)).collect())
    assert got == plain_spelling(docs)
    assert got["chaina"][1] == "chainabcde" and got["q" * 3000][0] == "q" * 3001 and got["gardem"][0] == "garden"
    assert trie.spelling_groups(wide(spark, [])).count() == 0
    assert trie.spelling_groups(wide(spark, [(1, None), (None, "")])).count() == 0


def test_spelling_of_a_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = told(trie.spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), part_words=40).collect())
    assert got == plain_spelling([tuple(r) for r in rows])


def plain_ranking(docs, items, k=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    terms = [(d, Counter(split(t))) for d, t in docs]
    terms = [(d, c, sum(c.values())) for d, c in terms if c]
    n, run, df = len(terms), sum(s for _, _, s in terms), Counter(t for _, c, _ in terms for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for d, c, size in terms:
            m = 25 + 75 * size * n // run
            score = sum(int(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item_id, place + 1, d, -s) for place, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items):
    asked = spark.createDataFrame([(i, t, 5, 6) for i, t in items], "item_id long, text string, rank int, term int")
    return sorted((tuple(r) for r in maxscore.rank_documents(wide(spark, docs), asked).collect()), key=str)


def test_ranking_matches_plain_scores(spark, monkeypatch):
    """Ties, repeated rows and items, terms in every document, accents, digits, odd records; shards and blocks of many sizes."""
    rng = random.Random(3)
    names = [f"t{k}" for k in range(60)] + ["the", "THE", "Éa", "éa", "naïve-x", "a_b"]
    docs = [(k, " ".join(rng.choices(names, k=rng.randint(1, 40)))) for k in range(300)]
    docs += [(500, "only here")] * 3 + [(501, "only here"), (None, "only here"), (502, None), (503, "  ,. "), (504, ""), (505, "the " * 40_000)]
    items = [(k, " ".join(rng.choices(names, k=12))) for k in range(20)] + [(90, "only here only"), (90, "only here only"), (91, None), (92, "--"), (None, "t1 t2"), (93, "absent words")]
    want = plain_ranking(docs, items)
    assert ranked(spark, docs, items) == want and len([r for r in want if r[0] == 90]) == 10
    for name, value in (("SHARD_DOCS", 7), ("SPAN", 16), ("BLOCK_ITEMS", 5)):
        monkeypatch.setattr(maxscore, name, value)
        assert ranked(spark, docs, items) == want, name
    assert ranked(spark, [], items) == ranked(spark, docs, []) == ranked(spark, [(1, None)], items) == []


def test_non_essential_postings_are_passed_over(spark, sf_dir):
    """Over the table's documents fewer postings are read than there are, and the first ten stay the same."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    counted = [Counter(maxscore.terms_of(t)) for _, t in items]
    vocabulary = {t: n for n, t in enumerate(dict.fromkeys(t for c in counted for t in c))}
    writer = maxscore.ShardWriter(vocabulary)
    for d, t in docs:
        writer.add(d, t)
    n_docs, n_terms, row = writer.n_docs, writer.n_terms, writer.batch().to_pylist()[0]
    shard, weight, met = maxscore.Shard(row, n_docs, n_terms), maxscore.weights(n_docs, dict(zip(row["terms"], row["df"]))), Counter()
    monkey, maxscore.SPAN = maxscore.SPAN, 16
    try:
        out = []
        for (item_id, _), c in zip(items, counted):
            first = maxscore.First(10)
            maxscore.search_shard(shard, [(t, n * weight[t]) for term, n in c.items() if (t := vocabulary[term]) in weight], first, met)
            out += [(item_id, place + 1, d, s) for place, (s, d) in enumerate(first.rows)]
    finally:
        maxscore.SPAN = monkey
    assert sorted(out, key=str) == plain_ranking(docs, items)
    assert 0 < met["read"] < 0.8 * met["all"], met


def plain_nearest(rows, k=5, every=50):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for place, (q, a) in enumerate(whole):
        if q is None or q % every:
            continue
        told = lambda b: max(-va_file.WIDEST, min(va_file.WIDEST, sum(x * y for x, y in zip(a, b))))  # noqa: E731, B023
        scores = [(-told(b), i is None, i or 0, i) for n, (i, b) in enumerate(whole) if n != place and len(a) == len(b)]
        out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def nearest(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows], "vec_id long, embedding array<double>, score int, vec_rank int, shard string")
    return sorted((tuple(r) for r in va_file.nearest_rows(df, **options).collect()), key=str)


def test_nearest_matches_plain_scores(spark, monkeypatch):
    """Ties, copies, repeated and null identifiers, nulls, values that are not finite, empty and huge vectors, several lengths."""
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(12)]) for k in range(600)]
    rows += [(1000 + k, [0.25] * 12) for k in range(300)] + [(50, rows[50][1]), (1000, [0.25] * 12), (None, [0.5] * 12), (None, None), (2000, None)]
    rows += [(2050, [0.1, None] * 6), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (2200, [1e300] * 12), (2201, [-1e30] * 12), (2250, [40.0] * 12), (2300, []), (2301, []), (2350, [1.0, 2.0]), (2351, [3.0, -1.0]), (2400, [7.0] * 13)]
    want = plain_nearest(rows)
    assert nearest(spark, rows) == want
    for name, value in (("SHARD_ROWS", 16), ("READ", 1), ("BLOCK_QUERIES", 5), ("FIT_ROWS", 3)):
        monkeypatch.setattr(va_file, name, value)
        assert nearest(spark, rows) == want, name
    assert nearest(spark, []) == nearest(spark, [(1, [1.0]), (50, None)]) == []
    assert nearest(spark, [(0, [1.0, 2.0])]) == [] and nearest(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 131072)]


def test_cells_bound_scores_and_spare_vectors(spark, sf_dir):
    """Bounds hold for every pair of the table, and only a part of the vectors is read."""
    rows = [np.floor(256 * np.array(r.embedding, np.float64)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding").collect()]
    x = np.stack(rows)
    ends = va_file.fit_ends(rows[:100])
    cells = va_file.cells_of(x, ends)
    lows, highs = va_file.cell_bounds(cells, x.min(axis=0), x.max(axis=0), ends)
    assert ((lows <= x) & (x <= highs)).all()
    exact = x[::50] @ x.T
    assert (va_file.bounds(x[::50], lows, highs, False) <= exact).all() and (exact <= va_file.bounds(x[::50], lows, highs, True)).all()
    Row = __import__("collections").namedtuple("Row", "shard place query_id vector")
    queries = va_file.Queries([Row("0", p, p, x[p].tolist()) for p in range(0, len(x), 50)])
    row = {"shard": "0", "d": x.shape[1], "n": len(x), "ids": list(range(len(x))), "cells": cells.tobytes(), "low": x.min(axis=0).tobytes(), "high": x.max(axis=0).tobytes(), "kind": "<f8", "vectors": x.tobytes()}
    met, held = {}, [va_file.Nearest(5) for _ in queries.names]
    va_file.search_shard(row, queries, ends, np.full(len(held), -np.inf), held, met)
    assert met["read"] < 0.5 * met["all"], met
    for q, near in zip(queries.names, held):
        want = sorted((-int(s), p) for p, s in enumerate(exact[q // 50]) if p != q)[:5]
        assert [(-r[0], r[1]) for r in near.rows] == want
