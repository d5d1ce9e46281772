"""Nearest vectors: of a few given ones by one scan, of a table of them by blocks and bounds."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.joins import Lookup, lookup_join
from wayfold.operators.retrieval import top_per_key
from wayfold.plans.scratch import staged

# Centres of cells at most, width of the rings around a centre, and vectors of a block. These change the work only.
MOST_CENTRES = 256
RING = 0.05
BLOCK = 2048
# Asked vectors that are compared in one go, and vectors they meet in one task, about. These change the work only.
BATCH = 2048
HELD = 8192
# Room for rounding in bounds; similarities themselves are compared as they are.
SLACK = 1e-7
# No two unit vectors are farther apart.
FARTHEST = 2.0


def similar_by_embedding(
    vectors: DataFrame, ids: list[int], k: int = 5, id_col: str = "vec_id"
) -> DataFrame:
    """For each of a few ids the ``k`` rows with the most similar ``embedding`` (cosine).

    The vectors of ``ids`` reach every task as one scalar, so the table is scanned without a join, the
    plan does not grow with them, and every task keeps its own best ``k`` per id before the shuffle.
    Equal scores go by id; of an id's copies the smallest vector is asked.
    """
    vector = F.col("embedding").cast("array<double>")
    # One row per asked id, also when an id has many copies.
    asked = (
        vectors.where(F.col(id_col).isin(ids))
        .groupBy(id_col)
        .agg(F.min("embedding").alias("embedding"))
        .agg(F.collect_list(F.struct(id_col, vector.alias("q"))).alias("asked"))
    )
    pairs = vectors.select(
        F.col(id_col).alias("similar_id"),
        vector.alias("v"),
        F.sqrt(_dot(vector, vector)).alias("norm"),
        F.explode(asked.scalar()).alias("a"),
    )
    length = F.sqrt(_dot(F.col("a.q"), F.col("a.q")))
    cosine = _dot(F.col("v"), F.col("a.q")) / F.nullif(F.col("norm") * length, F.lit(0.0))
    found = pairs.select(f"a.{id_col}", "similar_id", cosine.alias("similarity")).where(
        (F.col(id_col) != F.col("similar_id")) & F.col("similarity").isNotNull()
    )
    return top_per_key(
        found, [id_col], [F.col("similarity").desc(), F.col("similar_id").asc()], k
    )


def similar_by_embedding_batch(
    vectors: DataFrame, asked: DataFrame, k: int = 5, id_col: str = "vec_id"
) -> DataFrame:
    """As :func:`similar_by_embedding` for a table of ids: exact, without comparing all with all.

    Vectors lie in cells around a bounded number of centres, in rings by their distance to the centre, in blocks
    of bounded size. A first round compares each asked vector with the blocks of its own ring, which
    bounds how far its neighbours can be. By the triangle inequality a block whose ring is farther from
    the vector holds none of them, and a second round compares what is left. A block meets a batch of asked vectors
    at once, by a matrix product in its task. Vectors that are null, of
    another length, zero or not finite have no similarity. Of an id's copies the smallest vector is asked.
    """
    tables = _Blocks(vectors, k, id_col)
    wanted = asked.select(F.col(id_col).alias("asked_id")).distinct()
    mine = lookup_join(
        tables.smallest.withColumnRenamed("id", "asked_id"),
        Lookup.stage(wanted, ["asked_id"], "similar-asked"),
        ["asked_id"],
        "left_semi",
    )
    mine = staged(mine.select("asked_id", "h", "g"), "similar-own")
    queries = tables.queries(mine.select("h", "g").distinct())
    near = staged(_first_round(tables, queries, k), "similar-near")
    scored = staged(_scores(tables, near, queries, k), "similar-first")
    rest = _scores(tables, _second_round(tables, queries, near, scored, k), queries, k)
    best = _best_ids(scored.union(rest), k + 1)
    # All ids of one vector share its neighbours; each leaves itself out.
    named = mine.join(queries.select("query", "h", "g"), ["h", "g"]).select("asked_id", "query")
    found = best.join(named, "query").where(F.col("asked_id") != F.col("similar_id"))
    order = [F.col("similarity").desc(), F.col("similar_id").asc()]
    return top_per_key(
        found.select(F.col("asked_id").alias(id_col), "similar_id", "similarity"), [id_col], order, k
    )


class _Blocks:
    """Different vectors in blocks, and the rings of the blocks.

    Of equal vectors only the ``k + 1`` smallest ids can be among anyone's neighbours, so many copies of one
    vector are one row.
    """

    def __init__(self, vectors: DataFrame, k: int, id_col: str):
        spark = vectors.sparkSession
        vector = F.col("embedding").cast("array<double>")
        finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        some = F.exists(vector, lambda x: x != 0)
        usable = vectors.where(F.col(id_col).isNotNull() & vector.isNotNull() & finite & some).select(
            F.col(id_col).alias("id"), vector.alias("v")
        )
        # Scaled by the largest component, so that squares neither overflow nor vanish.
        largest = F.array_max(F.transform("v", F.abs))
        usable = usable.withColumn("v", F.transform("v", lambda x: x / largest)).withColumns(
            {"h": F.xxhash64("v"), "g": F.xxhash64(F.lit("second"), "v")}
        )
        usable = staged(usable, "similar-usable")
        self.smallest = usable.groupBy("id").agg(F.min(F.struct("v", "h", "g")).alias("s")).select("id", "s.h", "s.g")
        few = top_per_key(usable.select("id", "h", "g").distinct(), ["h", "g"], [F.col("id").asc()], k + 1)
        ids = few.groupBy("h", "g").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        different = usable.groupBy("h", "g").agg(F.any_value("v").alias("v"))
        whole = staged(different.join(ids, ["h", "g"]), "similar-vectors")
        sizes = whole.agg(
            F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")
        ).first()
        self.size = sizes["most"] if sizes["least"] == sizes["most"] else None
        self.centres = self._centres(whole, sizes["n"])
        near = F.array_min(
            F.transform(
                F.col("centres"),
                lambda c: F.struct(_distance(self.dot(F.col("u"), c["v"])).alias("d"), c["cell"].alias("cell")),
            )
        )
        placed = (
            whole.withColumn("length", F.sqrt(self.dot(F.col("v"), F.col("v"))))
            .withColumn("u", F.transform("v", lambda x: x / F.col("length")))
            .withColumn("centres", self.centres.scalar())
            .withColumn("near", near)
            .select("h", "g", "v", "u", "length", "ids", "near.cell", "near.d")
            .withColumn("ring", F.floor(F.col("d") / RING).cast("int"))
        )
        placed = staged(placed, "similar-placed")
        parts = placed.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
        part = F.pmod("h", F.col("parts")).cast("int")
        self.data = staged(
            lookup_join(placed, Lookup.stage(parts, ["cell", "ring"], "similar-parts"), ["cell", "ring"])
            .withColumn("part", part)
            .drop("parts"),
            "similar-blocks",
        )
        rings = self.data.groupBy("cell", "ring", "part").agg(
            F.min("d").alias("low"), F.max("d").alias("high"), F.sum(F.size("ids")).alias("held")
        )
        self.rings = Lookup.stage(rings, ["cell"], "similar-rings")
        self.total = sizes["n"]

    def _centres(self, whole: DataFrame, total: int) -> DataFrame:
        """One row: an array of ``cell`` and unit vector; vectors drawn by hash, about the root of their number."""
        wanted = min(MOST_CENTRES, math.isqrt(max(total - 1, 0)) + 1)
        below = min(1.0, 4 * wanted / max(1, total))
        drawn = whole.where(F.pmod("g", F.lit(1 << 30)) <= int(below * (1 << 30)))
        few = drawn.orderBy("g", "h").limit(wanted).select(_unit(F.col("v"), self.dot).alias("v"))
        rows = staged(few, "similar-centres").agg(F.sort_array(F.collect_list("v")).alias("a"))
        numbered = F.transform("a", lambda v, i: F.struct(i.alias("cell"), v.alias("v")))
        return rows.select(numbered.alias("centres"))

    def dot(self, left: Column, right: Column) -> Column:
        """Scalar product, null for vectors of different lengths."""
        return _dot(left, right) if self.size else F.when(F.size(left) == F.size(right), _dot(left, right))

    def queries(self, keys: DataFrame) -> DataFrame:
        """The asked vectors with a number, their batch, their cell and their distances to all centres.

        A batch holds the vectors of cells that follow each other, or some of one cell.
        """
        distances = F.transform("centres", lambda c: _distance(self.dot(F.col("u"), c["v"])))
        rows = (
            self.data.join(keys, ["h", "g"])
            # The distances to the centres are dealt to all tasks.
            .repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")
            .withColumn("centres", self.centres.scalar())
            .select("h", "g", "v", "length", "cell", "d", distances.alias("to"))
        )
        rows = staged(rows, "similar-asked-rows")
        batches = rows.repartitionByRange(max(1, -(-rows.count() // BATCH)), "cell", "h")
        named = batches.select(
            F.monotonically_increasing_id().alias("query"), F.spark_partition_id().alias("batch"), *rows.columns
        )
        return staged(named, "similar-queries")


def _unit(vector: Column, dot) -> Column:
    length = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: x / length)


def _distance(cosine: Column) -> Column:
    return F.sqrt(F.greatest(2 - 2 * cosine, F.lit(0.0)))


def _gap(low: str, high: str, at: Column) -> Column:
    """How far a ring is at least from a vector at a distance from its centre."""
    return F.greatest(F.col(low) - at, at - F.col(high), F.lit(0.0))


def _first_round(tables: _Blocks, queries: DataFrame, k: int) -> DataFrame:
    """For each asked vector the nearest blocks of the own cell that hold enough ids."""
    near = lookup_join(queries.select("query", "batch", "cell", "d"), tables.rings, ["cell"], "inner")
    window = Window.partitionBy("query").orderBy("gap", "ring", "part")
    held = F.sum("held").over(window.rowsBetween(Window.unboundedPreceding, -1))
    return (
        near.withColumn("gap", _gap("low", "high", F.col("d")))
        .withColumn("before", F.coalesce(held, F.lit(0)))
        .where(F.col("before") <= k)
        .select("query", "batch", "cell", "ring", "part")
    )


def _second_round(tables: _Blocks, queries: DataFrame, near: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """For each asked vector the blocks that may hold a better neighbour than the first round found."""
    best = _best_ids(scored, k + 1)
    bound = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least"))
    reach = F.when(F.col("n") > k, _distance(F.col("least")) + SLACK).otherwise(FARTHEST + SLACK)
    asked = queries.join(bound.select("query", reach.alias("reach")), "query", "left").select(
        "query", "batch", F.coalesce("reach", F.lit(FARTHEST + SLACK)).alias("reach"), F.posexplode("to").alias("cell", "at")
    )
    rings = tables.rings.df
    spans = Lookup.stage(
        rings.groupBy("cell").agg(F.min("low").alias("first"), F.max("high").alias("last")), ["cell"], "similar-spans"
    )
    cells = lookup_join(asked, spans, ["cell"], "inner").where(
        _gap("first", "last", F.col("at")) <= F.col("reach")
    )
    open_ = lookup_join(cells.drop("first", "last"), tables.rings, ["cell"], "inner").where(
        _gap("low", "high", F.col("at")) <= F.col("reach")
    )
    return open_.select("query", "batch", "cell", "ring", "part").join(
        near, ["query", "cell", "ring", "part"], "left_anti"
    )


def _scores(tables: _Blocks, pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Of each asked vector and some of its blocks the ``k + 1`` most similar vectors: similarity and ids.

    A block goes once to each batch that asks for it, with the numbers of those that do; the blocks of a batch are
    dealt to tasks, which hold about ``HELD`` vectors.
    """
    block = ["cell", "ring", "part"]
    spread = max(1, -(-tables.total // HELD))
    wanted = pairs.groupBy("batch", *block).agg(F.collect_list("query").alias("wanted"))
    vectors = F.collect_list(F.struct("v", "length", "ids")).alias("vectors")
    held = wanted.join(tables.data.groupBy(*block).agg(vectors), block).select(
        "batch", F.pmod(F.xxhash64(*block), F.lit(spread)).alias("task"), "wanted", "vectors"
    )
    tasks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("to_task")
    asked = queries.select(F.col("batch").alias("to_batch"), tasks, "query", "v", "length")
    ids = tables.data.schema["ids"].dataType.simpleString()
    return (
        held.groupBy("batch", "task")
        .cogroup(asked.groupBy("to_batch", "to_task"))
        .applyInArrow(_nearest(k + 1), f"query long, similarity double, ids {ids}")
    )


def _nearest(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The most similar vectors of each asked one among its blocks, by similarity, then by their least id.

    Matrix products only leave out what is surely not among them. What is left is summed in the order of
    its components, as elsewhere, so that similarities do not depend on the blocks.
    """
    room = SLACK

    def whole(column: pa.ChunkedArray) -> pa.Array:
        return pa.concat_arrays(column.chunks)

    def ends(lists: pa.Array) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])

    def by_size(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Positions and matrix of the vectors of each size."""
        at, values = ends(lists), lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(at)
        rows = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        return {n: (r, values[at[r][:, None] + np.arange(n)]) for n, r in rows.items()}

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        types = [pa.int64(), pa.float64(), held.schema.field("vectors").type.value_type.field("ids").type]
        schema = pa.schema(list(zip(["query", "similarity", "ids"], types)))
        if not held.num_rows or not asked.num_rows:
            return schema.empty_table()
        blocks, lists = whole(held["vectors"]), whole(held["wanted"])
        block_ends, list_ends, wanted = ends(blocks), ends(lists), lists.flatten().to_numpy(zero_copy_only=False)
        vectors = blocks.flatten()
        ids, long_w = vectors.field("ids"), vectors.field("length").to_numpy(zero_copy_only=False)
        least = pc.rank(pc.list_element(ids, 0), tiebreaker="first").to_numpy(zero_copy_only=False)
        numbers, long_q = (whole(asked[c]).to_numpy(zero_copy_only=False) for c in ("query", "length"))
        order = np.argsort(numbers)
        floor = np.full(len(numbers), -np.inf)
        queries = by_size(whole(asked["v"]))
        kept, waiting, rows = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), [], 0

        def trimmed() -> tuple[np.ndarray, ...]:
            """The best so far; they bound what is still to come."""
            q, w, score = (np.concatenate(c) for c in zip(kept, *waiting))
            by = np.lexsort((least[w], -score, q))
            q, w, score = q[by], w[by], score[by]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == most - 1
            floor[q[last]] = score[last]
            return q[place < most], w[place < most], score[place < most]

        for size, (at_w, matrix_w) in by_size(vectors.field("v")).items():
            if size not in queries:
                continue
            at_q, matrix_q = queries[size]
            row_of = np.full(len(numbers), -1)
            row_of[at_q] = np.arange(len(at_q))
            for b in range(len(blocks)):
                low, high = np.searchsorted(at_w, block_ends[b : b + 2])
                mine = order[np.searchsorted(numbers, wanted[list_ends[b] : list_ends[b + 1]], sorter=order)]
                mine = mine[row_of[mine] >= 0]
                if low == high or not len(mine):
                    continue
                x, y = matrix_q[row_of[mine]], matrix_w[low:high]
                about = x @ y.T / long_w[at_w[low:high]] / long_q[mine][:, None]
                if high - low > most:
                    bound = np.partition(about, high - low - most, axis=1)[:, high - low - most]
                    floor[mine] = np.maximum(floor[mine], bound - room)
                i, j = np.nonzero(about >= floor[mine][:, None] - room)
                q, w = mine[i], at_w[low + j]
                total = np.zeros(len(i))
                for c in range(size):
                    total += x[i, c] * y[j, c]
                waiting.append((q, w, total / (long_q[q] * long_w[w])))
                rows += len(q)
                if rows > 1 << 18:
                    kept, waiting, rows = trimmed(), [], 0
        kept = trimmed()
        columns = [pa.array(numbers[kept[0]]), pa.array(kept[2]), ids.take(pa.array(kept[1]))]
        return pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, types)], schema=schema)

    return run


def _best_ids(scores: DataFrame, k: int) -> DataFrame:
    each = scores.select("query", "similarity", F.explode("ids").alias("similar_id"))
    order = [F.col("similarity").desc(), F.col("similar_id").asc()]
    return top_per_key(each, ["query"], order, k).drop("rank")


def _dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
