"""Toxicity by a weighted finite-state pattern grammar.

Words fall into classes: insult, threat, target, negation, reported speech, other. Small transducers read and write these
classes: one marks insults and threats in the reach of a negation, one those behind a word of reported speech, one those
that stand with a target, and one weighs what comes out. ``compose`` joins them into one machine over the reachable
tuples of their states. A clause's weight is the weight of its path; a text is scored by the clauses that match, not by
isolated words.

Insult terms are a small seed list and the terms (words, and stems of words) that a bounded sample of labelled texts shows to
stand in toxic texts only. Those that mostly follow a word of intent are threats. Words that stand before such terms in
texts labelled harmless, and hardly in toxic ones, are learned as reported speech. The weights of the outputs, and a logistic model
that turns the clauses of a whole text into its score, are fitted on labelled rows alone; nothing but the text is scored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import importable, save
from .word_cache import sliced

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)  # in the order of SYMBOLS
#: Seed terms (fixed values); insults and threats are widened by what labels teach.
INSULTS = "idiot moron loser scum trash stupid pathetic worthless disgusting clown fool jerk imbecile coward liar vermin".split()
THREATS = "kill destroy hurt beat stab shoot hunt crush".split()
TARGETS = "you your yours yourself u they them their he she his her tu toi ton vous votre du dich dein ihr euch usted te ustedes".split()
NEGATIONS = "not no never nobody none neither nor isn't aren't wasn't don't doesn't didn't won't pas jamais nicht kein keine nie nunca".split()
REPORTS = "said says say claimed claims wrote writes called calls quoted quote according reportedly alleged dit disait sagte sagt dijo dice".split()
STEMS = (4, 5, 6, 7)
#: Bounds of the sample of labelled texts that the models are fitted on: texts of each label.
SAMPLE = 3000
NOT_LETTER = re.compile(r"[\W\d_]+")
FEATURES = ("clauses", "most", "sum", "density")
#: Words at either end of a text by which its copies are known, and the part of a term's texts that must differ there.
ENDS, VARIED = 8, 0.5


def term_of(word: str) -> str:
    return NOT_LETTER.sub("", word).lower()


class Transducer:
    """Deterministic: ``arcs[state][symbol]`` is (next state, symbol written, weight). State 0 starts a clause."""

    def __init__(self, arcs: list[dict[str, tuple[int, str, float]]]):
        self.arcs = arcs

    def run(self, symbols: list[str]) -> tuple[list[str], float]:
        state, out, total = 0, [], 0.0
        for x in symbols:
            state, y, weight = self.arcs[state][x]
            out.append(y)
            total += weight
        return out, total


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``second`` makes of the output of ``first``, over the pairs of states that can be reached."""
    number, queue, arcs = {(0, 0): 0}, [(0, 0)], []
    for a, b in queue:
        row = {}
        for x, (a2, y, w) in first.arcs[a].items():
            b2, z, v = second.arcs[b][y]
            if (a2, b2) not in number:
                number[a2, b2] = len(queue)
                queue.append((a2, b2))
            row[x] = number[a2, b2], z, w + v
        arcs.append(row)
    return Transducer(arcs)


#: Words after a negation that it reaches, and words between a target and a term that belong together.
NEAR, REACH = 3, 6
#: Symbols: o other, i insult, t threat, g target, n negation, r report; a term that is marked gets its marks behind it.
SYMBOLS = "oitgnr"
MARKS = ("", "n", "r", "g")
#: What the weighing transducer reads, as (kind, mark). A mark hides those after it: negated before reported before aimed.
OUTPUTS = tuple(k + m for k in "it" for m in MARKS)
#: Weights before they are fitted: plain, negated, reported and aimed, of insults and of threats.
PRIOR = np.array([1.0, 0.3, 0.5, 1.3, 1.2, 0.35, 0.6, 1.6])


def negation() -> Transducer:
    """State: how many words the last negation still reaches."""
    rows = []
    for left in range(NEAR + 1):
        step = max(0, left - 1)
        rows.append({x: (NEAR if x == "n" else step, x + "n" if left and x in "it" else x, 0.0) for x in SYMBOLS})
    return Transducer(rows)


def report() -> Transducer:
    """State: whether a word of reported speech came before."""
    reads = [*SYMBOLS, "in", "tn"]
    return Transducer([{x: (int(told or x == "r"), x + "r" if told and x in ("i", "t") else x, 0.0) for x in reads} for told in (0, 1)])


def target() -> Transducer:
    """State: words for which a target before still counts."""
    reads = [*SYMBOLS, "in", "tn", "ir", "tr"]
    return Transducer([{x: (REACH if x == "g" else max(0, left - 1), x + "g" if left and x in ("i", "t") else x, 0.0) for x in reads} for left in range(REACH + 1)])


def weigher(weights: np.ndarray) -> Transducer:
    """One state; other symbols weigh nothing."""
    own = dict(zip(OUTPUTS, weights.tolist()))
    return Transducer([{x: (0, x, own.get(x, 0.0)) for x in [*SYMBOLS, *OUTPUTS]}])


class ClauseMachine:
    """The composition negation, report, target, weights. ``step[state][class]``: (next state, weight, number of the output or -1)."""

    def __init__(self, weights: np.ndarray = PRIOR):
        self.grammar = compose(compose(compose(negation(), report()), target()), weigher(weights))
        place = {x: k for k, x in enumerate(OUTPUTS)}
        self.step = [[(row[x][0], row[x][2], place.get(row[x][1], -1)) for x in SYMBOLS] for row in self.grammar.arcs]

    def score(self, kinds: list[int]) -> float:
        """Weight of one clause."""
        return self.read(kinds, [0] * len(OUTPUTS))

    def read(self, kinds: list[int], seen: list[int]) -> float:
        """The same; what the clause's terms come out as is counted in ``seen``."""
        state, total = 0, 0.0
        for k in kinds:
            state, weight, output = self.step[state][k]
            total += weight
            if output >= 0:
                seen[output] += 1
        return total


class Lexicon:
    """Classes of words; learned terms are words ("w:idiot") and stems ("s:lowei"), of which some are threats."""

    def __init__(self, terms: list[str] = (), threats: list[str] = (), reports: list[str] = ()):
        self.words = dict.fromkeys(INSULTS, INSULT) | dict.fromkeys(THREATS, THREAT) | dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT)
        self.words |= {t[2:]: INSULT for t in terms if t[:2] == "w:" and t[2:] not in self.words}
        self.words |= {t[2:]: THREAT for t in threats if t[:2] == "w:"}
        self.words |= {w: REPORT for w in reports if w not in self.words}
        self.stems = {t[2:]: THREAT if t in set(threats) else INSULT for t in terms if t[:2] == "s:"}
        self.known: dict[str, int] = {}

    def kind(self, raw: str) -> int:
        word = NOT_LETTER.sub("", raw).lower() if not raw.isalpha() else raw.lower()
        if word in self.words:
            return self.words[word]
        for n in STEMS:
            if len(word) >= n and word[:n] in self.stems:
                return self.stems[word[:n]]
        return self.words.get(raw.lower().strip(".,;:!?\"'"), OTHER)


def clause_features(texts: pa.Array, lexicon: Lexicon, machine: ClauseMachine, seen: np.ndarray | None = None) -> np.ndarray:
    """A row of ``FEATURES`` for each text: matched clauses, highest, sum (both of clauses), sum over the root of the length.
    ``seen``: a row for each text, to count what its terms come out as."""
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    parts = cut.flatten().dictionary_encode()
    words = parts.dictionary.to_pylist()
    kinds = np.fromiter(map(lexicon.kind, words), np.int8, len(words))
    ends = pc.match_substring_regex(parts.dictionary, r"[.!?;:,]\W*$").to_numpy(zero_copy_only=False)
    at = parts.indices.to_numpy() if len(parts) else np.zeros(0, np.int32)
    run, stop = kinds[at], ends[at]
    bounds = np.asarray(cut.offsets) - cut.offsets[0].as_py()
    out = np.zeros((len(texts), len(FEATURES)))
    hits = np.flatnonzero((run == INSULT) | (run == THREAT))
    for doc in np.unique(np.searchsorted(bounds, hits, side="right") - 1).tolist():
        first, last = int(bounds[doc]), int(bounds[doc + 1])
        own = hits[(hits >= first) & (hits < last)] - first
        stops = np.append(np.flatnonzero(stop[first:last]), last - first)
        totals, count = [], [0] * len(OUTPUTS)
        for k in np.unique(np.searchsorted(stops, own)).tolist():
            a, b = (0 if k == 0 else int(stops[k - 1]) + 1), int(stops[k]) + 1
            totals.append(machine.read(run[first + a : first + b].tolist(), count))
        total = max(0.0, sum(totals))
        if seen is not None:
            seen[doc] = count
        out[doc] = (math.log1p(len(totals)), max(totals), math.log1p(total), total / math.sqrt(last - first))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most about ``most`` different labelled texts of each label, chosen by a hash of the identifier.

    ``labels`` has one row per identifier. The chosen identifiers, whose number is bounded by ``most`` and not by the
    tables, are broadcast to the documents, so only their texts are moved.
    """
    counts = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, 1.2 * most / n))).otherwise(share)
    chosen = save(labels.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < share * 1_000_000), "labels-chosen")
    rows = docs.join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL").select("text", "toxic")
    # labels of equal texts that disagree: toxic
    return save(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")


def learned_terms(sample: DataFrame, least: int = 4, odds: float = 3.0, most: int = 3000) -> list[str]:
    """Words and stems that stand in toxic texts far more often than in others; stems only where no other text has them."""
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []
    sample = save(sample.withColumn("doc", F.monotonically_increasing_id()), "toxic-texts")
    parts = F.split("text", r"\s+")
    ends = [F.xxhash64(F.array_join(F.slice(x, 1, ENDS), " ")) for x in (parts, F.reverse(parts))]
    edges = sample.filter("toxic = 1").select("doc", ends[0].alias("head"), ends[1].alias("tail"))
    words = sample.select("doc", "toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("raw"))
    words = words.select("doc", "toxic", F.regexp_replace("raw", r"[^\p{L}]+", "").alias("word")).filter(F.length("word") > 2)
    terms = F.array(F.concat(F.lit("w:"), "word"), *[F.when(F.length("word") > n, F.concat(F.lit("s:"), F.substring("word", 1, n))) for n in STEMS])
    terms = save(words.select("doc", "toxic", F.explode(terms).alias("term")).filter("term is not null").distinct(), "sample-terms")
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    support = max(least, round(0.01 * n1))
    ratio = F.log((F.col("bad") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n0 + 1))
    chosen = save(counts.filter((F.col("bad") >= support) & (ratio >= odds)).orderBy(F.desc("bad"), "term").limit(most), "toxic-terms")
    where = terms.filter("toxic = 1").join(chosen, "term").join(edges, "doc").groupBy("term", "bad", "n").agg(F.collect_set("doc").alias("docs"), F.count_distinct("head").alias("heads"), F.count_distinct("tail").alias("tails")).collect()
    # copies of a text share its first or last words
    where = [r for r in where if min(r.heads, r.tails) >= VARIED * r.bad]
    chosen = without_copied(sorted(where, key=lambda r: (-r.bad, r.term)))
    bad = {r.term[2:]: r.bad for r in chosen if r.term[0] == "s" and r.n == r.bad}

    def narrowed(stem: str) -> str:
        """The longest stem that has nearly all of these texts."""
        longer = [x for x in bad if len(x) > len(stem) and x.startswith(stem) and bad[x] >= 0.9 * bad[stem]]
        return max(longer, key=lambda x: (len(x), bad[x], x), default=stem)

    roots = {x for x in bad if not any(x[:k] in bad for k in STEMS if k < len(x))}
    stems = {narrowed(x) for x in roots}
    return sorted([f"s:{x}" for x in stems] + [r.term for r in chosen if r.term[0] == "w" and not any(r.term[2 : 2 + k] in stems for k in STEMS)])


def without_copied(rows: list, most: int = 12, alike: float = 0.4) -> list:
    """The terms less those that come from copies of one text: many unrelated terms stand in the same texts as such a term."""
    if not rows:
        return rows
    number = {d: k for k, d in enumerate(sorted({d for r in rows for d in r.docs}))}
    has = np.zeros((len(rows), len(number)), np.float32)
    for i, r in enumerate(rows):
        has[i, [number[d] for d in r.docs]] = 1
    size, start = has.sum(axis=1), np.array([r.term[2:5] for r in rows])
    kept = []
    for i, r in enumerate(rows):
        both = has @ has[i]
        company = start[both >= alike * (size + size[i] - both)]
        if len(set(company.tolist())) <= most:
            kept.append(r)
    return kept


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method; returns weights and intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


#: Words of intent (fixed values); what toxic texts put behind them is a threat.
INTENT = "will i'll we'll gonna going shall should must werde werden vais voy vamos".split()


def learned_context(sample: DataFrame, terms: list[str], least: int = 5, odds: float = 2.0, most: int = 200) -> tuple[list[str], list[str]]:
    """(threats among ``terms``, words of reported speech), from the words up to three places before each term in the sample.

    A term is a threat if a word of intent stands there in half of its places in toxic texts or more; a word is one of reported
    speech if it stands there in ``least`` harmless texts or more, and far more often than in toxic ones. At most ``most`` of either.
    """
    lexicon = Lexicon(terms)

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = set()
            for doc, (text, toxic) in enumerate(zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist())):
                words = text.lower().split()
                for k, raw in enumerate(words):
                    if lexicon.kind(raw) in (INSULT, THREAT):
                        near = [w for w in words[max(0, k - 3) : k] if lexicon.kind(w) == OTHER]
                        found.add((doc, toxic, NOT_LETTER.sub("", raw), "", int(any(w in INTENT for w in words[max(0, k - 3) : k]))))
                        found.update((doc, toxic, "", w, 0) for w in near if len(term_of(w)) > 2)
            yield pa.RecordBatch.from_pylist([dict(zip(("doc", "toxic", "term", "word", "intent"), x)) for x in sorted(found)], schema=CONTEXT)

    rows = save(sample.mapInArrow(before, "doc long, toxic int, term string, word string, intent int"), "term-context")
    counts = rows.filter("term != '' AND toxic = 1").groupBy("term").agg(F.avg("intent").alias("part"), F.count(F.lit(1)).alias("n"))
    intended = [r.term for r in counts.filter((F.col("part") >= 0.5) & (F.col("n") >= least)).orderBy(F.desc("n"), "term").limit(most).collect()]
    threats = [t for t in terms if any(w == t[2:] if t[0] == "w" else w.startswith(t[2:]) for w in intended)]
    totals = {r.toxic: r.n for r in rows.filter("term != ''").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    told = rows.filter("word != ''").groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("good"), F.sum("toxic").alias("bad"))
    ratio = F.log((F.col("good") + 0.5) / (totals.get(0, 0) + 1)) - F.log((F.col("bad") + 0.5) / (totals.get(1, 0) + 1))
    reports = told.filter((F.col("good") >= least) & (ratio >= odds)).orderBy(F.desc("good"), "word").limit(most).collect()
    return threats, [r.word for r in reports]


CONTEXT = pa.schema([("doc", pa.int64()), ("toxic", pa.int32()), ("term", pa.string()), ("word", pa.string()), ("intent", pa.int32())])


def fit_weights(seen: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of the outputs, none negative: a logistic model of the texts' counts. The prior's weights are first brought to the
    scale of the labels together, then each may leave it as far as its own occurrences tell; unseen outputs keep the prior's."""
    x = np.column_stack([np.log1p(seen), np.ones(len(seen))])
    scale, bias = fit_logistic(x[:, :-1] @ PRIOR[:, None], y, 1e-2)
    scale = max(float(scale[0]), 0.5)
    prior = np.append(scale * PRIOR, bias)
    precision = np.append(np.full(len(PRIOR), 4 / scale**2), 1e-3)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(precision), x.T @ (y - p) - precision * (w - prior))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return np.maximum(w[:-1], 0) / scale


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Lexicon, ClauseMachine, np.ndarray, float]:
    """Terms, machine and logistic weights from labelled rows (doc_id, toxic 0/1); the fitted sample, which comes to the driver
    as numbers only, is bounded by ``sample`` texts of each label. Rows of ``labels`` that disagree count as toxic, and so do
    equal texts whose labels disagree; without both labels a prior is returned."""
    importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = labelled_sample(docs, labels, sample)
    terms = learned_terms(texts)
    lexicon, machine = Lexicon(terms, *learned_context(texts, terms)), ClauseMachine()

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros((batch.num_rows, len(OUTPUTS)))
            clause_features(batch.column("text"), lexicon, machine, seen)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(c) for c in seen.T]], names=["toxic", *OUTPUTS])

    rows = texts.mapInArrow(outputs, "toxic int, " + ", ".join(f"{f} double" for f in OUTPUTS)).toPandas()
    if not len(rows) or rows["toxic"].nunique() < 2:
        return lexicon, machine, np.array([0.5, 1.0, 1.0, 0.5]), -3.0
    machine = ClauseMachine(fit_weights(rows[list(OUTPUTS)].to_numpy(), rows["toxic"].to_numpy(float)))
    x = texts.mapInArrow(lambda batches: features_of(batches, lexicon, machine), "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    y = x["toxic"].to_numpy(float)
    w, b = fit_logistic(x[list(FEATURES)].to_numpy(), y)
    part, share = y.mean(), labels.agg(F.avg("toxic")).first()[0]
    # the sample has its own share of toxic texts
    return lexicon, machine, w, b + math.log(share / (1 - share)) - math.log(part / (1 - part))


def features_of(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, machine: ClauseMachine) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = clause_features(batch.column("text"), lexicon, machine)
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(x[:, k]) for k in range(len(FEATURES))]], names=["toxic", *FEATURES])


def score_toxicity(docs: DataFrame, model: tuple[Lexicon, ClauseMachine, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score, clauses``. Null and empty texts have no matched clause; long texts are
    scored whole; repeated rows are all scored; other columns are not read; an empty table gives no rows."""
    importable(docs.sparkSession)
    lexicon, machine, weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            x = clause_features(batch.column("text"), shared.value, machine)
            p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(np.round(np.expm1(x[:, 0])).astype(np.int64))], names=["doc_id", "score", "clauses"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double, clauses long")


def without_toxic(docs: DataFrame, model: tuple[Lexicon, ClauseMachine, np.ndarray, float], limit: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose score is below ``limit``; each row is decided where it is read, whatever its identifier."""
    importable(docs.sparkSession)
    lexicon, machine, weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            x = clause_features(batch.column(text_col), shared.value, machine)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ weights + bias, -40, 40))) < limit))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2
