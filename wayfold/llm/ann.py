"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample and every vector is put in the leaf its centres lead to. A query
goes down the tree best bin first: children enter a priority queue by their inner product with the query, the best
waiting node is opened next, and leaves come out in the order they are worth visiting. How many
are visited is calibrated: it is widened until the neighbours that a full scan finds for a bounded set
of queries are reached. Scores of the vectors found are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.covertree import usable
from wayfold.llm.tables import discard, release, stored

K = 20
# Vectors the tree is fitted on, and leaves, at most: the tree that travels to the tasks is bounded.
SAMPLE = 32_768
MOST_LEAVES = 4096
LEAF = 512
BRANCHES = 8
ROUNDS = 8
SEED = 5
# Queries the visits are calibrated with, and the recall they have to reach.
CALIBRATION = 256
RECALL = 0.95
# Neighbouring leaves are bundled: so many bundles at least, of so many rows at least and bytes at most. A query travels once to
# each bundle it visits leaves of, and so many queries meet a bundle in one task.
BUNDLES = 16
BLOCK = 1024
BUNDLE_BYTES = 16 << 20
QUERY_BLOCK = 32_768
# Queries that are scored at once, and rows of visits handed on at once.
SCORED = 128
VISITS = 2048
# Share of the visits made first, whose results bound what the others return.
FIRST_SHARE = 8
_ROUNDING = 1e-9


@dataclass
class Tree:
    """Centres by node, children of inner nodes and leaf numbers of the others."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    leaves: int

    def assign(self, values: np.ndarray) -> np.ndarray:
        """Leaf of each row: always the nearest child."""
        node = np.zeros(len(values), dtype=int)
        result = np.zeros(len(values), dtype=np.int32)
        waiting = np.arange(len(values))
        while len(waiting):
            for at in np.unique(node[waiting]).tolist():
                mine = waiting[node[waiting] == at]
                if self.children[at]:
                    kids = np.array(self.children[at])
                    node[mine] = kids[_nearest(values[mine], self.centres[kids])]
                else:
                    result[mine] = self.leaf[at]
                    node[mine] = -1
            waiting = waiting[node[waiting] >= 0]
        return result

    def best_bins(self, query: np.ndarray, visits: int) -> list[int]:
        """The first leaves of a best-bin-first traversal, best first."""
        worth = self.centres @ query
        queue, found = [(-worth[0], 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                found.append(self.leaf[node])
            for child in self.children[node]:
                heapq.heappush(queue, (-worth[child], child))
        return found


def _nearest(values: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * values @ centres.T).argmin(axis=1)


def grow(sample: np.ndarray, leaves: int) -> Tree:
    """Split the largest group by k-means until there are so many leaves or all groups are points."""
    random = np.random.default_rng(SEED)
    centres, children, members = [sample.mean(axis=0)], [[]], {0: np.arange(len(sample))}
    open_groups = [(-len(sample), 0)]
    while open_groups and len(members) < leaves:
        _, node = heapq.heappop(open_groups)
        mine = members[node]
        parts = _k_means(sample[mine], min(BRANCHES, leaves - len(members) + 1), random)
        if len(parts) < 2:
            continue
        del members[node]
        for part in parts:
            child = len(centres)
            centres.append(sample[mine[part]].mean(axis=0))
            children.append([])
            children[node].append(child)
            members[child] = mine[part]
            heapq.heappush(open_groups, (-len(part), child))
    leaf = [-1] * len(centres)
    for number, node in enumerate(sorted(members)):
        leaf[node] = number
    return Tree(np.array(centres), children, leaf, len(members))


def _k_means(values: np.ndarray, k: int, random: np.random.Generator) -> list[np.ndarray]:
    """Positions of each non-empty cluster."""
    starts = np.unique(values, axis=0)
    if len(starts) < 2 or k < 2:
        return [np.arange(len(values))]
    centres = starts[random.choice(len(starts), min(k, len(starts)), replace=False)]
    for _ in range(ROUNDS):
        own = _nearest(values, centres)
        centres = np.array([values[own == i].mean(axis=0) for i in np.unique(own)])
    own = _nearest(values, centres)
    return [np.flatnonzero(own == i) for i in np.unique(own)]


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    blobs = column.to_pylist() if isinstance(column, pa.Array) else column.to_list()
    return np.frombuffer(b"".join(blobs), dtype="<f8").reshape(len(blobs), -1)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _exact_top(
    vector: np.ndarray, rough: np.ndarray, values: np.ndarray, ids: np.ndarray, own: object, k: int,
    least: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of a query's best rows, without its own and those below ``least``.

    ``rough`` scores may be off by rounding, differently for equal vectors; rows near the
    bound are scored again in one fixed order of additions.
    """
    rough = np.where(ids == own, -np.inf, rough)
    if len(rough) > k:
        bound = np.partition(rough, len(rough) - k)[len(rough) - k]
        least = max(least, bound)
    scale = max(1.0, float(np.abs(rough[np.isfinite(rough)]).max(initial=1.0)))
    near = np.flatnonzero((rough >= least - _ROUNDING * scale) & (rough > -np.inf))
    scores = np.einsum("ij,ij->i", values[near], np.broadcast_to(vector, (len(near), len(vector))))
    best = _top(scores, ids[near], k)
    return ids[near][best], scores[best]


def prepare(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``data`` (components as little-endian doubles) of the vectors that take part. Stored."""
    rows = vectors.where(usable(vector_col) & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    )
    # The length most vectors have; the smaller one of equally frequent ones.
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    rows = rows.where(F.size("vector") == F.lit(common["dim"] if common else 0))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array(v, dtype="<f8").tobytes() for v in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "data"])

    return stored(rows.mapInArrow(pack, "id long, data binary"), "vectors")


def fit(rows: DataFrame) -> Tree | None:
    """Tree fitted on at most ``SAMPLE`` vectors, chosen by a hash of their ids; None without vectors."""
    total = rows.count()
    if not total:
        return None
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("data").collect()
    sample = np.frombuffer(b"".join(bytes(r["data"]) for r in chosen), dtype="<f8")
    return grow(sample.reshape(len(chosen), -1), min(MOST_LEAVES, -(-total // LEAF)))


def calibrate(rows: DataFrame, tree: Tree, k: int, recall: float = RECALL) -> int:
    """Leaves to visit so that a full scan's neighbours are reached.

    The true neighbours of ``CALIBRATION`` vectors, chosen by a hash, are found among all rows. The visits are
    widened leaf by leaf until their mean share reached is ``recall``.
    """
    chosen = rows.orderBy(F.xxhash64("id", F.lit("calibration")), "id").limit(CALIBRATION).collect()
    own = np.array([r["id"] for r in chosen])
    queries = np.frombuffer(b"".join(bytes(r["data"]) for r in chosen), dtype="<f8")
    queries = queries.reshape(len(chosen), -1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            leaves = tree.assign(values)
            scores = values @ queries.T
            out = [[], [], [], []]
            for q in range(len(queries)):
                best = _top(np.where(ids == own[q], -np.inf, scores[:, q]), ids, k)
                best = best[ids[best] != own[q]]
                for column, found in zip(out, (np.full(len(best), q), ids[best], scores[best, q],
                                               leaves[best])):
                    column.append(found)
            names = ["q", "id", "score", "leaf"]
            arrays = [pa.array(np.concatenate(c)) for c in out]
            yield pa.RecordBatch.from_arrays(arrays, names=names).cast(
                pa.schema([("q", pa.int64()), ("id", pa.int64()), ("score", pa.float64()),
                           ("leaf", pa.int64())])
            )

    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    true = (
        rows.mapInArrow(scan, "q long, id long, score double, leaf long")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("q", "leaf")
        .collect()
    )
    # For each true neighbour, how many leaves have to be visited to reach it.
    needed: dict[int, list[int]] = {}
    orders: dict[int, dict[int, int]] = {}
    for row in true:
        q = row["q"]
        if q not in orders:
            bins = tree.best_bins(queries[q], tree.leaves)
            orders[q] = {leaf: i + 1 for i, leaf in enumerate(bins)}
        needed.setdefault(q, []).append(orders[q][row["leaf"]])
    for visits in range(1, tree.leaves):
        reached = [np.mean([n <= visits for n in found]) for found in needed.values()]
        if not reached or np.mean(reached) >= recall:
            return visits
    return tree.leaves


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = RECALL,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of each query's ``k`` nearest found.

    ``queries`` has ids (in ``id_col``) of rows of ``vectors``; each is compared with every other row.
    Nearness is the inner product in double precision, ties go to the smaller id. Vectors that are null, empty or
    zero, hold null or non-finite components or have another length than most take no part, nor do
    null ids; a repeated id counts once, with its smallest vector. A query with fewer candidates
    in the visited leaves than ``k`` visits all. Other columns are left out.
    """
    spark = vectors.sparkSession
    rows = prepare(vectors, id_col, vector_col)
    tree = fit(rows)
    schema = "query_id long, rank int, vec_id long, score double"
    if tree is None:
        return spark.createDataFrame([], schema)
    visits = calibrate(rows, tree, k, recall)
    shipped = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = pa.array(shipped.value.assign(_matrix(batch.column(1))), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, leaves], names=["id", "data", "leaf"])

    placed = stored(rows.mapInArrow(place, "id long, data binary, leaf int"), "placed")
    discard(spark, rows)
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"))
    # At most one row for each leaf of the bounded tree.
    sizes = {r["leaf"]: r["size"] for r in sizes.collect()}
    start, parts = bundles(sizes, tree.centres.shape[1])

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [start[leaf] + part for leaf, part in zip(*(batch.column(i).to_pylist() for i in (2, 3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.int32())], names=names)

    names = ["id", "data", "leaf", "bundle"]
    several = {leaf: n for leaf, n in parts.items() if n > 1}
    part = F.lit(0)
    if several:
        split = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
        part = F.pmod(F.xxhash64("id"), F.coalesce(split[F.col("leaf")], F.lit(1))).cast("int")
    held_rows = placed.withColumn("part", part).mapInArrow(bundled, "id long, data binary, leaf int, bundle int")

    wanted = queries.select(F.col(f"`{id_col}`").cast("long").alias("id")).distinct()
    asked = placed.drop("leaf").join(wanted, "id", "left_semi")
    early = max(1, visits // FIRST_SHARE)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("id", pa.int64()), ("bundle", pa.int32()), ("early", pa.bool_()), ("leaves", pa.list_(pa.int32()))]
        )
        for batch in batches:
            found: list[dict] = []
            for i, query in enumerate(_matrix(batch.column(1))):
                own = batch.column(0)[i].as_py()
                bins = shipped.value.best_bins(query, shipped.value.leaves)
                # Leaves without vectors cost no visit; too few candidates widen the visits.
                candidates = seen = 0
                at: dict[tuple[int, bool], list[int]] = {}
                for leaf in bins:
                    size = sizes.get(leaf, 0)
                    if size and (seen < visits or candidates <= k):
                        for bundle in range(start[leaf], start[leaf] + parts[leaf]):
                            at.setdefault((bundle, seen < early), []).append(leaf)
                        seen += 1
                        candidates += size
                found += [{"id": own, "bundle": b, "early": e, "leaves": l} for (b, e), l in at.items()]
                if len(found) >= VISITS:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found = []
            yield pa.RecordBatch.from_pylist(found, schema)

    # Vectors come to the visits when they travel, so that they do not lie on disk once for each.
    visiting = stored(
        asked.mapInArrow(visit, "id long, bundle int, early boolean, leaves array<int>"), "visits"
    )
    first = stored(
        _meet(visiting.where("early").join(asked, "id"), held_rows, None, k), "first-visits"
    )
    release(spark)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    leading = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    bounds = leading.select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    later = visiting.where(~F.col("early")).join(asked, "id").join(bounds, "id", "left")
    both = first.union(_meet(later, held_rows, "least", k))
    return (
        both.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def bundles(sizes: dict[int, int], width: int) -> tuple[dict[int, int], dict[int, int]]:
    """The first bundle of each leaf and how many it has: neighbouring leaves share one, a very large one has several."""
    most = max(1, min(BUNDLE_BYTES // (8 * width), max(BLOCK, -(-sum(sizes.values()) // BUNDLES))))
    start, parts, number, room = {}, {}, -1, 0
    for leaf, size in sorted(sizes.items()):
        parts[leaf] = -(-size // most)
        if size > room:
            number, room = number + 1, most
        start[leaf] = number
        number, room = number + parts[leaf] - 1, 0 if parts[leaf] > 1 else room - size
    return start, parts


def _meet(visits: DataFrame, placed: DataFrame, least: str | None, k: int) -> DataFrame:
    """The best of the visited leaves of each bundle for each query, none worse than its ``least``."""
    bound = F.col(least) if least else F.lit(None).cast("double")
    # Queries of a bundle that many visit are dealt to several tasks, which each get the bundle's rows.
    crowds = visits.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("crowds"))
    asked = visits.join(crowds, "bundle").select(
        "bundle",
        F.pmod(F.xxhash64("id", F.lit("crowd")), F.col("crowds")).cast("int").alias("crowd"),
        "id",
        "data",
        "leaves",
        bound.alias("least"),
    )
    held = placed.join(crowds, "bundle").select(
        "bundle", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"), "id", "data", "leaf"
    )

    def meet(asking: pd.DataFrame, holding: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(asking) or not len(holding):
            return pd.DataFrame({n: [] for n in names}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"}
            )
        # Rows of a leaf stand together.
        holding = holding.sort_values(["leaf", "id"])
        values, ids, leaf = _matrix(holding["data"]), holding["id"].to_numpy(), holding["leaf"].to_numpy()
        different, begin = np.unique(leaf, return_index=True)
        ranges = dict(zip(different.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(leaf)])))
        found = []
        for at in range(0, len(asking), SCORED):
            some = asking.iloc[at : at + SCORED]
            vectors = _matrix(some["data"])
            visitors: dict[int, list[int]] = {}
            for i, leaves in enumerate(some["leaves"]):
                for x in leaves:
                    visitors.setdefault(int(x), []).append(i)
            rough = np.full((len(some), len(ids)), -np.inf)
            for x, who in visitors.items():
                # A part of a very large leaf may have no row.
                low, high = ranges.get(x, (0, 0))
                rough[who, low:high] = vectors[who] @ values[low:high].T
            for i, (own, low) in enumerate(zip(some["id"], some["least"].fillna(-np.inf))):
                near, scores = _exact_top(vectors[i], rough[i], values, ids, own, k, low)
                found.append((np.full(len(near), own), near, scores))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*found))})

    keys = ["bundle", "crowd"]
    return (
        asked.groupBy(*keys)
        .cogroup(held.groupBy(*keys))
        .applyInPandas(meet, "query_id long, vec_id long, score double")
    )
