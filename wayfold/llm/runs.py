"""Periodic runs of words by branching tandem repeats in an enhanced suffix array.

The words of several documents share one suffix array; a document's words are symbols of its own, so nothing
is found across documents. For each interval of the LCP array the suffixes of the smaller child are tested:
``i`` of depth ``d`` begins a square that cannot move right when ``ISA[i + d]`` or ``ISA[i - d]`` lies in the other child.
Such squares are rotated left as far as they go and merged into runs. There are no tree nodes:
intervals are two numbers per LCP entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.tables import slices

# A run has at least so many periods, and so many words.
LEAST_PERIODS = 4
LEAST_WORDS = 6
# Fixed value: what separates words.
SPACE = "[\\x20\\x09-\\x0D]+"
# Documents share a suffix array up to so many words, and suffixes are tested so many at a time.
BATCH_WORDS = 1 << 18
TESTED = 1 << 20

SPAN = "struct<start:bigint,length:bigint,period:bigint>"
SPANS = f"n_words long, runs array<{SPAN}>, collapsed string"
_SPAN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


@dataclass
class SuffixArray:
    """Suffix array of a sequence of symbols, its inverse, and common prefixes of neighbours."""

    order: np.ndarray
    inverse: np.ndarray
    # Of each suffix with the one before it in the order; 0 for the first.
    lcp: np.ndarray


def suffix_array(symbols: np.ndarray, follows: np.ndarray) -> SuffixArray:
    """By doubling; suffixes that are told apart already are not sorted again.

    ``follows`` is the end of the document of each position. Equal symbols must be of one document.
    """
    n = len(symbols)
    place = np.arange(n, dtype=np.int64)
    order = np.argsort(symbols, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = symbols[order[1:]] != symbols[order[:-1]]
    # A rank is the place of the first suffix of its group in the order.
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0))
    levels, width = [rank.astype(np.int32)], 1
    while True:
        single = fresh & np.append(fresh[1:], True)
        left = np.flatnonzero(~single)
        if not len(left):
            break
        members = order[left]
        ahead = members + width
        inside = ahead < follows[members]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        first = rank[members]
        # Groups stay where they are, so sorting by both keys keeps the places in use.
        by = np.argsort(first * (n + 1) + second)
        members, first, second = members[by], first[by], second[by]
        order[left] = members
        new = np.ones(len(left), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = rank.copy()
        rank[members] = np.maximum.accumulate(np.where(new, left, 0))
        fresh[left] = new
        levels.append(rank.astype(np.int32))
        width *= 2
    return SuffixArray(order, rank, _common_prefixes(order, follows, levels))


def _common_prefixes(order: np.ndarray, follows: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix of neighbours: equal ranks at a level mean so many equal words."""
    lcp = np.zeros(len(order), dtype=np.int64)
    at, other = order[:-1].copy(), order[1:].copy()
    at_end, other_end = follows[at], follows[other]
    open_ = np.flatnonzero(levels[0][at] == levels[0][other])
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        a, b = at[open_], other[open_]
        inside = (a < at_end[open_]) & (b < other_end[open_])
        same = np.zeros(len(open_), dtype=bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        moved = open_[same]
        at[moved] += 1 << level
        other[moved] += 1 << level
        lcp[moved + 1] += 1 << level
    return lcp


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the interval that each LCP entry splits in two."""
    values = lcp.tolist()
    n = len(values)
    first, last = [0] * n, [n - 1] * n
    open_: list[int] = []
    for j, value in enumerate(values):
        while open_ and values[open_[-1]] > value:
            last[open_.pop()] = j - 1
        # An equal entry before splits off a child of the same interval.
        first[j] = open_[-1] if open_ else 0
        open_.append(j)
    return np.array(first, dtype=np.int64), np.array(last, dtype=np.int64)


def branching_squares(
    symbols: np.ndarray, begins: np.ndarray, follows: np.ndarray, array: SuffixArray
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of the squares that cannot move right and may belong to a long enough run.

    Of each split the side with fewer suffixes is tested, so all tests together are the number of words times
    its logarithm at most.
    """
    first, last = intervals(array.lcp)
    split = np.flatnonzero(array.lcp > 0)
    depth, low, high = array.lcp[split], first[split], last[split]
    left_smaller = split - low <= high - split + 1
    start = np.where(left_smaller, low, split)
    count = np.where(left_smaller, split - low, high - split + 1)
    other_low = np.where(left_smaller, split, low)
    other_high = np.where(left_smaller, high, split - 1)
    starts, halves = [], []
    edges = np.append(0, np.cumsum(count))
    at = 0
    while at < len(split):
        upto = max(at + 1, int(np.searchsorted(edges, edges[at] + TESTED, side="right")) - 1)
        part = np.repeat(np.arange(at, upto), count[at:upto])
        offset = np.arange(len(part)) - (edges[part] - edges[at])
        suffix = array.order[start[part] + offset]
        d = depth[part]
        for step in (d, -d):
            partner = suffix + step
            inside = np.flatnonzero((partner >= begins[suffix]) & (partner < follows[suffix]))
            place = array.inverse[partner[inside]]
            within = (place >= other_low[part[inside]]) & (place <= other_high[part[inside]])
            found = inside[within]
            square, half = np.minimum(suffix[found], partner[found]), d[found]
            # Two words of the two periods before must match too, or no run of four periods ends here.
            far = square - (LEAST_PERIODS - 2) * half
            room = far >= begins[square]
            square, half, far = square[room], half[room], far[room]
            near = square + half
            same = (symbols[far] == symbols[near]) & (symbols[square - 1] == symbols[near - 1])
            starts.append(square[same])
            halves.append(half[same])
        at = upto
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *halves])


def _rotated(symbols: np.ndarray, begin: int, square: int, half: int) -> int:
    """First word of the square moved left as far as its words match one period on."""
    block = 64
    while square > begin:
        low = max(begin, square - block)
        differing = np.flatnonzero(symbols[low:square] != symbols[low + half : square + half])
        if len(differing):
            return low + int(differing[-1]) + 1
        square, block = low, block * 2
    return square


def find_runs(words: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Runs of each document as rows of start, length and period, by start, then period.

    ``words`` are numbers of the words of all documents, one after another; ``lengths`` those of the documents.
    """
    result = [np.zeros((0, 3), dtype=np.int64) for _ in lengths]
    if not len(words):
        return result
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    begins, follows = (ends - lengths)[doc], ends[doc]
    symbols = pd.factorize(doc * (int(words.max()) + 1) + words)[0].astype(np.int64)
    # Symbols of one document stay together: they are numbered as they appear.
    array = suffix_array(symbols, follows)
    squares, halves = branching_squares(symbols, begins, follows, array)
    end = squares + 2 * halves
    by = np.lexsort((halves, end))
    squares, halves, end = squares[by], halves[by], end[by]
    groups = np.flatnonzero(np.append(True, end[1:] != end[:-1])) if len(end) else end
    found: dict[int, list[tuple[int, int, int]]] = {}
    for low, high in zip(groups, [*groups[1:], len(end)]):
        stop, begin = int(end[low]), int(begins[squares[low]])
        periods = halves[low:high]
        while len(periods):
            # The shortest square of those with one end; longer ones in its run are multiples of its period.
            period = int(periods[0])
            start = _rotated(symbols, begin, stop - 2 * period, period)
            merged = (periods % period == 0) & (stop - 2 * periods >= start)
            periods = periods[~merged]
            length = stop - start
            if length >= max(LEAST_WORDS, LEAST_PERIODS * period):
                found.setdefault(int(doc[start]), []).append((start - begin, length, period))
    for number, rows in found.items():
        unique = {}
        for start, length, period in sorted(rows, key=lambda r: r[2]):
            unique.setdefault((start, length), period)
        rows = sorted((s, n, p) for (s, n), p in unique.items())
        rows.sort(key=lambda r: (r[0], r[2]))
        result[number] = np.array(rows, dtype=np.int64)
    return result


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """Words that no run repeats, joined by one space."""
    if len(runs):
        kept = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(words)


def _marked(texts: list[list[bytes]]) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Number of words, runs and collapsed text of each document of one batch."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    numbers: dict[bytes, int] = {}
    words = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], dtype=np.int64)
    for text, runs in zip(texts, find_runs(words, lengths)):
        yield len(text), runs, _collapsed(text, runs)


def mark_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Periodic runs of the words of every whole text.

    Words are maximal stretches without ASCII white space, compared as they are. Result: id, ``n_words``,
    ``runs`` (array of start, length and smallest period in words, by start, then period; every run of at least four
    periods and six words, as long as it goes) and ``collapsed``, the words outside the later periods of all
    runs, joined by one space.

    A null text counts as empty: no words, no runs, empty text. Every input row gives one row, also when ids are
    null or repeated; other columns are left out, whatever their names.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            # Splits at exactly the six ASCII white space characters.
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            counts, runs, collapsed = [], [], []
            at = 0
            while at < len(texts):
                upto, total = at, 0
                while upto < len(texts) and (upto == at or total + len(texts[upto]) <= BATCH_WORDS):
                    total += len(texts[upto])
                    upto += 1
                for n, found, text in _marked(texts[at:upto]):
                    counts.append(n)
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found.tolist()])
                    collapsed.append(text.decode())
                at = upto
            arrays = [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(runs, pa.list_(_SPAN)),
                pa.array(collapsed, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {SPANS}")


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Make every tenth document periodic from some word on, as told by the CRC-32 of its id.

    A document without id stays as it is. Columns: id and text.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text_col), SPACE), lambda w: w != "")

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.call_function("div", n - a, 3 + F.pmod(g, F.lit(8)))
        return F.transform(w, lambda word, i: F.when(i < a, word).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int"))))

    # A list of one, so that the words are split once.
    joined = F.array_join(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(w))[0], " ")
    text = F.when(F.pmod(h, F.lit(10)) == 0, joined).otherwise(F.col(text_col))
    return docs.select(id_col, text.alias(text_col))


def digests(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # Ties: smallest start, then period; the array is in that order and the first maximum is taken.
    longest = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p")))
    )
    row = marked.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), longest.alias("_longest"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
    length, period = -F.col("_longest.n"), F.col("_longest.p")
    return row.select(
        id_col,
        "n_runs",
        F.col("_longest.s").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.call_function("div", 1000 * length, period).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
