"""Secret scans: base patterns, and probabilistic automata inferred from the credentials they find.

The strings found by the base patterns are credentials labelled by their kind. From a bounded sample of
each kind a prefix tree is built over character classes, and states whose outgoing frequencies are statistically
compatible are merged into a probabilistic automaton. Every other long token of every text is then a
candidate, scored by how much likelier the automata find its format than an automaton of ordinary tokens does.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.tables import slices, working

# The base patterns, and the shortest length that counts.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "grammar")
_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)

# Tokens an automaton may score, and the kind under which ordinary ones are learned.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ORDINARY = "ordinary"
# Learned from at most so many different strings of each kind, and so many characters of each.
SAMPLE_STRINGS = 400
SAMPLE_LENGTH = 64
# Fewer strings than this teach no automaton.
LEAST_STRINGS = 5
# Confidence of the compatibility test.
ALPHA = 0.05
# An added span is at least this much likelier per character than as an ordinary token, in nats, and
# at most so much less likely than all but this share of its kind's own credentials.
ADVANTAGE = 0.4
TAIL, ROOM = 0.02, 0.2

# Character classes and the number of characters in each.
_CLASSES = {"d": 10, "h": 6, "l": 20, "H": 6, "U": 20}
_CLASS_OF = str.maketrans(
    {c: "d" for c in "0123456789"}
    | {c: "h" for c in "abcdef"}
    | {c: "l" for c in "ghijklmnopqrstuvwxyz"}
    | {c: "H" for c in "ABCDEF"}
    | {c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}
)
_END = ""


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and credential of each base match, leftmost and not overlapping per kind."""
    found = []
    if _NAMES.search(text):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= SHORTEST["assign"]:
                found.append((m.start(), m.end(), "assign", m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= SHORTEST["access"]:
                found.append((m.start(), m.end(), "access", m[0]))
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str]]:
    """Long tokens that touch no base span."""
    at = 0
    spans = sorted((s[0], s[1]) for s in base)
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if not any(s < m.end() and e > m.start() for s, e in spans[at : at + 3]):
            yield m.start(), m.end(), m[0]


class PrefixTree:
    """States with counts of strings passing, ending, and leaving by each class."""

    def __init__(self, strings: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.passing: list[dict[str, int]] = [{}]
        self.ending: list[int] = [0]
        for string in strings:
            state = 0
            for symbol in string:
                self.passing[state][symbol] = self.passing[state].get(symbol, 0) + 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.passing.append({})
                    self.ending.append(0)
                state = self.next[state][symbol]
            self.ending[state] += 1

    def total(self, state: int) -> int:
        return self.ending[state] + sum(self.passing[state].values())

    def _alike(self, first: int, second: int) -> bool:
        """Hoeffding test on the frequency of ending and of each class."""
        n, m = self.total(first), self.total(second)
        if not n or not m:
            return True
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        if abs(self.ending[first] / n - self.ending[second] / m) > bound:
            return False
        mine, theirs = self.passing[first], self.passing[second]
        return all(
            abs(mine.get(s, 0) / n - theirs.get(s, 0) / m) <= bound for s in mine.keys() | theirs.keys()
        )

    def _compatible(self, first: int, second: int) -> bool:
        """The test holds for both states and for all that follow alike."""
        waiting = [(first, second)]
        while waiting:
            a, b = waiting.pop()
            if not self._alike(a, b):
                return False
            waiting += [(self.next[a][s], t) for s, t in self.next[b].items() if s in self.next[a]]
        return True

    def _fold(self, into: int, state: int) -> None:
        """Add the counts of a subtree to the states it merges with."""
        waiting = [(into, state)]
        while waiting:
            a, b = waiting.pop()
            self.ending[a] += self.ending[b]
            for symbol, count in self.passing[b].items():
                self.passing[a][symbol] = self.passing[a].get(symbol, 0) + count
            for symbol, target in self.next[b].items():
                if symbol in self.next[a]:
                    waiting.append((self.next[a][symbol], target))
                else:
                    self.next[a][symbol] = target

    def merge(self) -> None:
        """Merge every state into the first settled state it is compatible with, else settle it."""
        settled = [0]
        while True:
            known = set(settled)
            fringe = [
                (state, symbol, target)
                for state in settled
                for symbol, target in sorted(self.next[state].items())
                if target not in known
            ]
            if not fringe:
                return
            state, symbol, target = max(fringe, key=lambda f: (self.total(f[2]), -f[0], f[1]))
            for other in settled:
                if self._compatible(other, target):
                    self.next[state][symbol] = other
                    self._fold(other, target)
                    break
            else:
                settled.append(target)


@dataclass(frozen=True)
class Automaton:
    """Log-probability of each class and of ending, by state."""

    steps: tuple[dict[str, tuple[int, float]], ...]
    ends: tuple[float, ...]
    unseen: float

    @classmethod
    def infer(cls, strings: list[str]) -> Automaton:
        shapes = sorted(s[:SAMPLE_LENGTH].translate(_CLASS_OF) for s in strings)
        tree = PrefixTree(shapes)
        tree.merge()
        number, order = {0: 0}, [0]
        for state in order:
            for target in tree.next[state].values():
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
        steps, ends = [], []
        for state in order:
            n = tree.total(state) + 1.0
            ends.append(math.log((tree.ending[state] + 0.5) / n))
            steps.append(
                {
                    s: (number[t], math.log(tree.passing[state][s] / n / _CLASSES.get(s, 1)))
                    for s, t in tree.next[state].items()
                }
            )
        # What a state has never seen keeps the state and costs as if seen a small part of a time.
        return cls(tuple(steps), tuple(ends), math.log(0.01 / (len(shapes) + 1.0) / 10))

    def likelihood(self, string: str) -> float:
        """Mean log-likelihood of a character."""
        state, total = 0, 0.0
        for symbol in string.translate(_CLASS_OF):
            step = self.steps[state].get(symbol)
            if step is None:
                total += self.unseen
            else:
                state, gain = step
                total += gain
        # How a string ends counts only where the sample was not cut.
        if len(string) <= SAMPLE_LENGTH:
            total += self.ends[state]
        return total / max(1, len(string))


@dataclass(frozen=True)
class Grammar:
    """Automata of the credential kinds with the least likelihood each accepts, and of ordinary tokens."""

    kinds: dict[str, tuple[Automaton, float]]
    ordinary: Automaton | None

    def accepts(self, token: str) -> bool:
        if not self.kinds or self.ordinary is None or token.isalpha():
            return False
        usual = self.ordinary.likelihood(token)
        for automaton, least in self.kinds.values():
            own = automaton.likelihood(token)
            if own >= least and own - usual >= ADVANTAGE:
                return True
        return False


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """Automata of the credentials which the base patterns find in ``docs``.

    At most ``SAMPLE_STRINGS`` different strings of each kind take part, in the order of a hash: a
    bounded sample, found over all texts. Kinds with fewer than ``LEAST_STRINGS`` have no automaton.
    """

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("secrets")
        for batch in slices(batches):
            kinds, found = [], []
            for text in batch.column(0).to_pylist():
                base = base_spans(text or "")
                for _, _, kind, credential in base:
                    kinds.append(kind)
                    found.append(credential[: SAMPLE_LENGTH + 1])
                for _, _, token in candidates(text or "", base):
                    kinds.append(ORDINARY)
                    found.append(token[: SAMPLE_LENGTH + 1])
            arrays = [pa.array(kinds, pa.string()), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", "string"])

    order = Window.partitionBy("kind").orderBy("_order", "string")
    sample = (
        docs.select(text_col)
        .mapInArrow(strings, "kind string, string string")
        .distinct()
        .withColumn("_order", F.xxhash64("string"))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= SAMPLE_STRINGS)
    )
    by_kind: dict[str, list[str]] = {}
    for row in sample.select("kind", "string").collect():
        by_kind.setdefault(row["kind"], []).append(row["string"])
    return infer_grammar(by_kind)


def infer_grammar(by_kind: dict[str, list[str]]) -> Grammar:
    """Automata of labelled strings; those labelled ``ordinary`` are what credentials are told from."""
    kinds = {}
    for kind in sorted(by_kind):
        strings = by_kind[kind]
        if kind != ORDINARY and len(strings) >= LEAST_STRINGS:
            automaton = Automaton.infer(strings)
            own = sorted(map(automaton.likelihood, strings))
            kinds[kind] = (automaton, own[int(TAIL * len(own))] - ROOM)
    ordinary = by_kind.get(ORDINARY, [])
    if len(ordinary) >= LEAST_STRINGS:
        # Each half is held against an automaton of the other, which has not learned its strings by heart.
        ordinary = sorted(ordinary, key=lambda t: hashlib.sha256(t.encode()).digest())
        halves = [ordinary[::2], ordinary[1::2]]
        usual = [Automaton.infer(half) for half in reversed(halves)]
        ordinary = [t for half, u in zip(halves, usual) for t in half if not _credential_like(t, kinds, u)]
    # With too few ordinary tokens all characters are equally likely.
    enough = len(ordinary) >= LEAST_STRINGS
    return Grammar(kinds, Automaton.infer(ordinary) if enough else _uniform())


def _credential_like(token: str, kinds: dict[str, tuple[Automaton, float]], usual: Automaton) -> bool:
    """A kind accepts the token and neither the other tokens nor its own characters explain it better.

    Bare credentials are among the tokens others are told from; were they kept, they would explain themselves.
    """
    if token.isalpha():
        return False
    whole = {"h": "l", "H": "U"}
    drawn = {whole.get(c, c) for c in token.translate(_CLASS_OF)}
    evenly = -math.log(sum({"d": 10, "l": 26, "U": 26}.get(c, 1) for c in drawn))
    explained = max(usual.likelihood(token) + ADVANTAGE - ROOM, evenly)
    for automaton, least in kinds.values():
        own = automaton.likelihood(token)
        if own >= least and explained - own < ADVANTAGE:
            return True
    return False


def _uniform() -> Automaton:
    each = {s: (0, math.log(n / 68 / n)) for s, n in _CLASSES.items()}
    return Automaton(({**each, **{s: (0, math.log(1 / 68)) for s in "+/_.=-"}},), (0.0,), math.log(1 / 68))


def all_spans(text: str | None, grammar: Grammar) -> list[tuple[int, int, str]]:
    """Base spans and those added by the automata, by start, then kind as listed."""
    text = text or ""
    base = base_spans(text)
    found = [s[:3] for s in base]
    found += [(s, e, "grammar") for s, e, t in candidates(text, base) if grammar.accepts(t)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(
    docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Spans of secrets in every whole text.

    Id, ``n_assign``, ``n_access``, ``n_hex`` (base spans of each kind), ``n_grammar`` (added),
    ``base_sha256`` of the joined base spans, and ``spans``: ``kind:start:end`` by start, then kind,
    joined by commas; code points, end exclusive. A null text counts as empty and has no spans. Every row
    gives one row; other columns are left out, whatever their names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(grammar)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_assign", "n_access", "n_hex", "n_grammar", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("secrets")
        for batch in slices(batches):
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, joined = [], []
            for text in batch.column(1).to_pylist():
                spans = all_spans(text, shipped.value)
                for kind in KINDS:
                    counts[kind].append(sum(s[2] == kind for s in spans))
                base = _joined([s for s in spans if s[2] != "grammar"])
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                joined.append(_joined(spans))
            arrays = [batch.column(0)] + [pa.array(counts[k], pa.int64()) for k in KINDS]
            arrays += [pa.array(digests, pa.string()), pa.array(joined, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = (
        f"`{id_col}` {id_type}, n_assign long, n_access long, n_hex long, n_grammar long, "
        "base_sha256 string, spans string"
    )
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact(docs: DataFrame, grammar: Grammar, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans by one mark. Null stays null."""
    shipped = docs.sparkSession.sparkContext.broadcast(grammar)
    names, at = docs.columns, docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        parts, done = [], 0
        for start, end, _ in all_spans(text, shipped.value):
            if start >= done:
                parts += [text[done:start], mark]
            done = max(done, end)
        return "".join([*parts, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("secrets")
        for batch in slices(batches):
            texts = [clean(t) for t in batch.column(at).to_pylist()]
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, docs.schema)
