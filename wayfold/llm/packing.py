"""Packing of token pieces into sequences by non-negative least squares over a length histogram.

Lengths are counted in steps of ``STEP`` tokens. All combinations of at most ``DEPTH`` lengths which
fill the window exactly are enumerated, their repeat counts are solved against the histogram, rounded
to what is there, and the lengths left over are packed greedily. All of this works on one small
histogram, whatever the size of the corpus; the pieces themselves never leave Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.bpe import Vocabulary
from wayfold.llm.tables import slices, stored

WINDOW = 2048
END_ID = 1
STEP = 8
DEPTH = 3
ITERATIONS = 1500
# Pieces are numbered within so many lanes at most, so that no length is numbered in one task.
LANES = 4096

PIECES = "{id} {type}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(
    docs: DataFrame,
    vocabulary: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """Tokenize every whole text, add the end id and cut it every ``window`` ids.

    Each piece has its first position, its length, the CRC-32 of its ids as little-endian unsigned
    32-bit integers and the number of ids of its document. A null or empty text is the end id alone.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shipped.value.get()
        for batch in slices(batches):
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([bpe.encode(text or ""), end])
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(piece))
                    sums.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(ids))
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
            columns += [pa.array(c, pa.int64()) for c in (starts, lengths, sums, totals)]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECES.format(id=f"`{id_col}`", type=id_type)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def combinations(bins: int, depth: int = DEPTH) -> np.ndarray:
    """All ascending combinations of at most ``depth`` lengths that add up to ``bins``; 0 fills up."""
    found = []

    def extend(chosen: list[int], least: int, rest: int, places: int) -> None:
        found.append([0] * (places - 1) + [*chosen, rest])
        if places > 1:
            for size in range(least, rest // 2 + 1):
                extend([*chosen, size], size, rest - size, places - 1)

    extend([], 1, bins, depth)
    return np.array(found, dtype=np.int64)


def solve_counts(combos: np.ndarray, counts: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Non-negative repeat counts whose use of lengths is closest to ``counts`` in least squares.

    ``counts[l]`` is the number of pieces of length ``l``; place 0 is ignored. Accelerated projected
    gradient steps, restarted when they turn uphill.
    """
    size = len(counts)
    used = combos > 0
    target = counts.astype(float)
    target[0] = 0.0

    def use(x: np.ndarray) -> np.ndarray:
        total = np.bincount(combos.ravel(), np.repeat(x, combos.shape[1]), size)
        total[0] = 0.0
        return total

    def slope(residual: np.ndarray) -> np.ndarray:
        return (residual[combos] * used).sum(axis=1)

    probe = np.ones(len(combos))
    for _ in range(30):
        probe = slope(use(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 1.0 / (1.05 * norm)
    x = np.zeros(len(combos))
    ahead, momentum = x, 1.0
    for _ in range(iterations):
        gradient = slope(use(ahead) - target)
        moved = np.maximum(ahead - step * gradient, 0.0)
        if np.dot(gradient, moved - x) > 0:
            momentum, ahead = 1.0, moved
        else:
            following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            ahead = moved + (momentum - 1) / following * (moved - x)
            momentum = following
        x = moved
    return x


@dataclass(frozen=True)
class Pattern:
    """``repeats`` sequences made of these lengths, longest first."""

    lengths: tuple[int, ...]
    repeats: int


def plan(counts: np.ndarray, depth: int = DEPTH) -> list[Pattern]:
    """Patterns that use up a histogram of lengths, ``counts[l]`` pieces of length ``l``.

    The window is the largest length of the histogram. Every piece is used exactly once.
    """
    bins = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    patterns = []
    combos = combinations(bins, depth)
    repeats = solve_counts(combos, left)
    for at in np.argsort(-repeats, kind="stable"):
        wanted = int(repeats[at] + 0.5)
        if wanted == 0:
            break
        lengths, each = np.unique(combos[at][combos[at] > 0], return_counts=True)
        possible = min(wanted, int((left[lengths] // each).min()))
        if possible:
            left[lengths] -= each * possible
            patterns.append(Pattern(tuple(sorted(combos[at][combos[at] > 0].tolist())[::-1]), possible))
    patterns.extend(_greedy(left))
    return patterns


def _greedy(left: np.ndarray) -> list[Pattern]:
    """Longest first, then always the longest that still fits. Each pattern empties one length."""
    patterns = []
    left = left.copy()
    while left.any():
        lengths, rest = [], len(left) - 1
        spare = left.copy()
        while rest > 0 and (fitting := np.flatnonzero(spare[: rest + 1])).size:
            size = int(fitting[-1])
            lengths.append(size)
            spare[size] -= 1
            rest -= size
        kinds, each = np.unique(lengths, return_counts=True)
        repeats = int((left[kinds] // each).min())
        left[kinds] -= each * repeats
        patterns.append(Pattern(tuple(lengths), repeats))
    return patterns


def _places(patterns: list[Pattern], bins: int) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, slot), by rank.

    Pieces of a length are ranked from 0; the ranks from one row's first to the next row's take that
    slot of consecutive sequences.
    """
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken = np.zeros(bins + 1, dtype=np.int64)
    sequence = 0
    for pattern in patterns:
        for slot, size in enumerate(pattern.lengths):
            rows.setdefault(size, []).append((int(taken[size]), sequence, slot))
            taken[size] += pattern.repeats
        sequence += pattern.repeats
    return {size: np.array(r, dtype=np.int64) for size, r in rows.items()}


def pack(
    docs: DataFrame,
    vocabulary: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    step: int = STEP,
) -> DataFrame:
    """Place every token of every document in a sequence of at most ``window`` tokens.

    One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset`` in the sequence (gapless from 0) and ``slot``, its number there. Documents are cut
    every ``window`` ids only. A null text counts as empty and gives the end id alone; rows with
    null or repeated ids are documents like others; an empty table gives an empty result. Other columns are
    left out, whatever their names.
    """
    if window % step:
        raise ValueError("the window must be a multiple of the step")
    spark = docs.sparkSession
    cut = pieces(docs, vocabulary, id_col, text_col, window, end_id).withColumns(
        {
            "_lane": F.pmod(F.spark_partition_id(), F.lit(LANES)),
            "_bin": F.ceil(F.col("length") / step).cast("int"),
        }
    )
    # Stored, so that lanes stay what they are when a task runs again.
    cut = stored(cut, "pieces")
    per_lane = cut.groupBy("_lane", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_bin").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    per_lane = stored(
        per_lane.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "lanes"
    )
    bins = window // step
    counts = np.zeros(bins + 1, dtype=np.int64)
    for row in per_lane.groupBy("_bin").agg(F.sum("_n").alias("n")).collect():
        counts[row["_bin"]] = row["n"]
    # At most `bins` lengths and a few patterns for each: bounded whatever the corpus.
    places = spark.sparkContext.broadcast(_places(plan(counts), bins))

    @F.pandas_udf("sequence_id long, slot int")
    def placed(sizes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence = np.zeros(len(sizes), dtype=np.int64)
        slot = np.zeros(len(sizes), dtype=np.int32)
        size_of, rank_of = sizes.to_numpy(), ranks.to_numpy()
        for size in np.unique(size_of):
            mine = size_of == size
            rows = places.value[size]
            at = np.searchsorted(rows[:, 0], rank_of[mine], side="right") - 1
            sequence[mine] = rows[at, 1] + rank_of[mine] - rows[at, 0]
            slot[mine] = rows[at, 2]
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    in_lane = Window.partitionBy("_lane", "_bin").orderBy(id_col, "start", "ids_crc32")
    along = Window.partitionBy("sequence_id").orderBy("slot")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        cut.withColumn("_in_lane", F.row_number().over(in_lane) - 1)
        .join(per_lane.drop("_n"), ["_lane", "_bin"])
        .withColumn("_place", placed("_bin", F.col("_in_lane") + F.col("_before")))
    )
    return ranked.select(
        id_col, "start", "length", "ids_crc32", "doc_tokens", "_place.sequence_id", "_place.slot"
    ).select(
        id_col,
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"),
        "slot",
    )
