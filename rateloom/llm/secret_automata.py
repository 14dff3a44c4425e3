"""Secret scan: base patterns, widened by grammar inference.

Labelled credentials are the values that stand behind a key word (``assign``) and access ids; bare hexadecimal runs carry no
label. For each labelled kind a prefix tree of character classes is built from whole credentials, and its statistically
compatible states are merged: two states are alike if, at every distance behind them, classes and ends are as frequent in
both (Hoeffding bounds), so lengths and prefixes of a format survive and the rest folds into few states. That gives a
probabilistic automaton. Every run of credential characters in every text, inside base spans or outside, and every part of a
run between ``/ . _ -`` is then scored: the log likelihood of its format under the best automaton, less that under a model of
the corpus's other words, for each character. A run without small letters is also scored in small letters, at the price of how
seldom credentials are written so. Where a part scores above its run, as a key in a path does, the parts stand for the run.
What is above the limit is reported as ``format`` beside the base spans: among bare hexadecimal runs that tells keys from
card numbers, and it finds keys that no pattern of the base covers.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import importable, save
from .word_cache import sliced

#: (kind, pattern, group whose length counts, least length); letters in either case only in the first (fixed values).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: As the third, but runs that are too short are not stopped at.
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.-]+={0,2}")
#: What a run may be put together from: a path, a dotted or dashed name.
PART = re.compile(r"[A-Za-z0-9+=]+")
KINDS = [b[0] for b in BASE]
#: The kinds whose matches are labelled credentials.
LABELLED = ("assign", "access")
LEARNED = "format"
#: Bounds of what the automata are fitted on: different credentials of each kind, from all texts, and as many words, from so many texts.
SAMPLE_TEXTS, SAMPLE_CREDENTIALS = 20_000, 1500
#: Longest example, in characters: the fit's tables are as wide. Longer credentials are no examples, but are scored whole.
SAMPLE_LENGTH = 1000
#: A run's score, log likelihood ratio for each character, from which it has a credential's format; other words may raise it.
LEAST_SCORE = 0.35
#: Scores that a task remembers, of runs of at most so many characters.
HELD_SCORES, HELD_LENGTH = 200_000, 200
#: One in so many different words is an example of ordinary words.
WORD_SHARE = 16
END = 8
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_-.", "=")
_CLASS = {x: k for k, own in enumerate(CLASSES) for x in own}
SIZES = tuple(map(len, CLASSES))


def classes(text: str) -> list[int]:
    return [_CLASS.get(c, END + 1) for c in text]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base matches, leftmost and non-overlapping for each kind: (kind, start, end) by kind."""
    out = []
    for kind, pattern, group, least in BASE[:2]:
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


class Automaton:
    """Deterministic probabilistic automaton over character classes, inferred from examples by state merging.

    A state's members are the ends of examples that are still to come there, as (example, offset); the prefix tree is never
    written out.
    """

    def __init__(self, examples: list[str], alpha: float = 0.05):
        longest = max(map(len, examples), default=0)
        self.codes = np.full((len(examples), longest + 2), -1, np.int8)
        self.texts = examples
        for k, text in enumerate(examples):
            self.codes[k, : len(text) + 1] = [*classes(text), END]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.members = [np.stack([np.arange(len(examples)), np.zeros(len(examples), int)], axis=1)]
        self.profiles = [self._profile(self.members[0])]
        self.next: list[dict[int, int]] = [{}]
        self._merge_all()
        self._weigh()

    def _profile(self, members: np.ndarray) -> np.ndarray:
        """Rows: distances behind a state; columns: how often each class, or the end, stands there."""
        width = self.codes.shape[1]
        out = np.zeros((width, END + 1))
        for d in range(width):
            inside = members[members[:, 1] + d < width]
            found = self.codes[inside[:, 0], inside[:, 1] + d]
            found = found[found >= 0]
            if not len(found):
                break
            out[d] = np.bincount(found, minlength=END + 1)
        return out

    def _differ(self, a: np.ndarray, b: np.ndarray) -> float | None:
        """The largest difference of two profiles, or None where one is beyond chance."""
        n, m = a.sum(axis=1), b.sum(axis=1)
        both = (n > 0) & (m > 0)
        n, m = n[both], m[both]
        apart = np.abs(a[both] / n[:, None] - b[both] / m[:, None]).max(axis=1)
        return None if (apart > self.bound * (1 / np.sqrt(n) + 1 / np.sqrt(m))).any() else float(apart.max(initial=0))

    def _steps(self, members: np.ndarray, c: int) -> np.ndarray:
        return members[self.codes[members[:, 0], members[:, 1]] == c] + [0, 1]

    def _fold(self, state: int, members: np.ndarray) -> None:
        """More members for a state, and for those that follow it."""
        stack = [(state, members)]
        while stack:
            s, more = stack.pop()
            if len(more):
                self.members[s] = np.concatenate([self.members[s], more])
                self.profiles[s] = self.profiles[s] + self._profile(more)
                stack += [(after, self._steps(more, c)) for c, after in self.next[s].items()]

    def _merge_all(self) -> None:
        queue = deque([0])
        while queue:
            state = queue.popleft()
            for c in range(END):
                blue = self._steps(self.members[state], c)
                if c in self.next[state] or not len(blue):
                    continue
                profile = self._profile(blue)
                near = [(d, s) for s in range(len(self.members)) if (d := self._differ(self.profiles[s], profile)) is not None]
                if near:
                    _, other = min(near)
                    self.next[state][c] = other
                    self._fold(other, blue)
                    queue.append(other)
                else:
                    self.next[state][c] = len(self.members)
                    self.members.append(blue)
                    self.profiles.append(profile)
                    self.next.append({})
                    queue.append(len(self.members) - 1)

    def _weigh(self) -> None:
        """``steps``: for each state, character to (next state, log likelihood); ``ends``: log likelihood of ending there."""
        self.steps: list[dict[str, tuple[int, float]]] = []
        self.ends: list[float] = []
        for s, members in enumerate(self.members):
            chars = Counter(self.texts[e][o] for e, o in members.tolist() if o < len(self.texts[e]))
            count, total = self.profiles[s][0], self.profiles[s][0].sum() + 4.5
            self.steps.append({x: (self.next[s].get(k, 0), math.log((count[k] + 0.5) / total) + math.log((chars[x] + 1) / (count[k] + SIZES[k]))) for k, own in enumerate(CLASSES) for x in own})
            self.ends.append(math.log((count[END] + 0.5) / total))
        self.states = len(self.members)
        del self.codes, self.texts, self.members, self.profiles, self.next

    def log_likelihood(self, text: str) -> float:
        """Of the whole text; an unknown step restarts at the root at its price."""
        state, total = 0, 0.0
        for x in text:
            state, p = self.steps[state][x]
            total += p
        return total + self.ends[state]


class Background:
    """First-order chain over character classes of the corpus's other words, numbers among them."""

    def __init__(self, words: list[str]):
        count = [[1.0] * 9 for _ in range(9)]
        for w in words:
            before = END
            for c in classes(w):
                if c > 7:
                    continue
                count[before][c] += 1
                before = c
            count[before][END] += 1
        self.log = [[math.log(x / sum(row)) - math.log(SIZES[c] if c < END else 1) for c, x in enumerate(row)] for row in count]

    def log_likelihood(self, run: list[int]) -> float:
        before, total = END, 0.0
        for c in run:
            if c > 7:
                return 0.0
            total += self.log[before][c]
            before = c
        return total + self.log[before][END]


class Model:
    """``credentials`` by kind, and other words. A third of the words sets the limit: one in a hundred of them at most reaches it."""

    def __init__(self, credentials: dict[str, list[str]], words: list[str], limit: float = LEAST_SCORE):
        self.automata = {k: Automaton(v) for k, v in sorted(credentials.items()) if v}
        self.shortest = min((len(x) for v in credentials.values() for x in v), default=0)
        cases = [x.isupper() for x in credentials.get("assign", []) if x.isupper() or x.islower()]
        #: Log odds that a credential in one case is written in capitals.
        self.capitals = math.log((sum(cases) + 1) / (len(cases) + 2))
        tried = words[::3] if len(words) >= 30 else []
        self.background = Background([w for k, w in enumerate(words) if k % 3 or not tried])
        self.held: dict[str, float] = {}
        tried = [w for w in tried if RUN.fullmatch(w)]
        self.limit = max(limit, float(np.quantile([self.score(w) for w in tried], 0.99))) if tried and self.automata else limit
        self.held.clear()

    def score(self, text: str) -> float:
        """Log likelihood ratio for each character: from the limit on, the run has a credential's format."""
        if not self.automata:
            return -1e9
        if text in self.held:
            return self.held[text]
        ratio = self._ratio(text)
        if text.isupper():
            ratio = max(ratio, self._ratio(text.lower()) + self.capitals)
        ratio /= len(text) + 1
        if len(text) <= HELD_LENGTH:
            if len(self.held) >= HELD_SCORES:
                self.held.clear()
            self.held[text] = ratio
        return ratio

    def _ratio(self, text: str) -> float:
        return max(a.log_likelihood(text) for a in self.automata.values()) - self.background.log_likelihood(classes(text))

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All runs, less full stops at their end, from the shortest credential's length on that have a credential's format;
        instead of a run its parts, where one of them has the format and a higher score than the run."""
        out = []
        if not self.automata:
            return out
        for m in RUN.finditer(text):
            if m.end() - m.start() >= self.shortest:
                run = m[0].rstrip(".")
                if len(run) < self.shortest:
                    continue
                whole = self.score(run)
                parts = [(p.start(), p.end(), self.score(p[0])) for p in PART.finditer(run) if self.shortest <= len(p[0]) < len(run)]
                parts = [(a, b) for a, b, score in parts if score >= self.limit and score > whole]
                if parts:
                    out += [(LEARNED, m.start() + a, m.start() + b) for a, b in parts]
                elif whole >= self.limit:
                    out.append((LEARNED, m.start(), m.start() + len(run)))
        return out


def fit_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", texts: int = SAMPLE_TEXTS, credentials: int = SAMPLE_CREDENTIALS) -> Model:
    """Automata from the labelled credentials of all texts; words come from about ``texts`` rows, chosen by a hash of their
    identifier. At most ``credentials`` different ones of each kind, and as many words, chosen by their hash and none longer than
    ``SAMPLE_LENGTH``, come to the driver."""
    importable(docs.sparkSession)
    share = max(1, docs.count() // texts)
    chosen = F.pmod(F.xxhash64(F.lit(3), F.col(id_col).cast("string")), F.lit(share)) == 0
    rows = docs.select(F.col(text_col).cast("string").alias("text"), chosen.alias("chosen")).filter("text IS NOT NULL")

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found, words = set(), set()
            for text, own in zip(batch.column("text").to_pylist(), batch.column("chosen").to_pylist()):
                for m in BASE[0][1].finditer(text):
                    if BASE[0][3] <= len(m[2]) <= SAMPLE_LENGTH:
                        found.add(("assign", m[2]))
                found.update(("access", m[0]) for m in BASE[1][1].finditer(text) if BASE[1][3] <= len(m[0]) <= SAMPLE_LENGTH)
                if own:
                    words.update(w for w in text.split() if 5 < len(w) <= SAMPLE_LENGTH and w.isascii() and zlib.crc32(w.encode()) % WORD_SHARE == 0)
            known = {v.rstrip(".") for _, v in found}
            words = {w.strip(".,;:!?\"'()") for w in words}
            found |= {("word", w) for w in words if w not in known}
            if found:
                kinds, values = zip(*sorted(found))
                yield pa.RecordBatch.from_pydict({"kind": kinds, "value": values})

    found = save(rows.mapInArrow(examples, "kind string, value string").distinct(), "secret-examples")
    held = {}
    for kind in (*LABELLED, "word"):
        some = found.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(credentials)
        held[kind] = [r.value for r in some.collect()]
    words = held.pop("word")
    return Model({k: [x.rstrip(".") for x in v] for k, v in held.items()}, words)


def scan_secrets(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Offsets are code points, ends exclusive. Null texts count as empty: no spans, the digest of the empty string. Long
    texts are scanned whole; repeated rows are all scanned; other columns are not read; an empty table gives no rows.
    """
    importable(docs.sparkSession)
    shared, order = docs.sparkSession.sparkContext.broadcast(model), {k: i for i, k in enumerate([*KINDS, LEARNED])}

    def joined(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = shared.value.spans(text or "")
                n = Counter(k for k, _, _ in base)
                rows.append((*[n[k] for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], *[pa.array(c, pa.string()) for c in columns[3:]]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
