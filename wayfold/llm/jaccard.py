"""N-gram Jaccard self-join with signature trees.

Documents are sets of word shingles; two link when their Jaccard similarity reaches the threshold, and the
result is the connected component of each. A pair that links shares a shingle among the
first quarter of each set in a common order, rare shingles first; every such shingle is the root of a forest of
signature trees over the documents that have it there. A tree node holds the OR of its documents' token
bitmaps and their range of sizes, and a dual traversal drops node pairs whose greatest possible overlap
is too small. What is left is checked on the whole sets.

Documents that already are in one component need not meet again. Copies are one member, documents
like the pivot of their min-hash group are united first, and the trees only compare members of different
components, so a group of thousands of near copies costs a row each, not a pair for every two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.components import connected_components
from wayfold.llm.tables import discard, keeps, partitions, release, slices, stored, working
from wayfold.operators.joins import Lookup, lookup_join

SHINGLE = 5
# Linked when PER_UNION * intersection >= LINK * union.
LINK, PER_UNION = 3, 4

# The order of shingles puts those frequent in about this many documents last. It changes the work only.
ORDER_SAMPLE = 4096
ORDER_LEAST = 3
ORDER_SHINGLES = 1 << 16
# Min-hash groups whose pivot is tried first: bands of two.
BANDS = 6
# Roots of more members have pivots in turns first, so often at most and until a turn finds so few links. Trees of
# smaller roots make at most half as many pairs for a member.
LARGE_ROOT = 64
PIVOT_TURNS = 6
FEW_LINKS = 64
# Pivots of a large root in a turn.
PIVOTS = 4
# Members of one tree task; a root with more is dealt out over pairs of blocks.
BLOCK = 1024
LEAF = 16
FAN = 8
LEAST_BITS = 256

KNOWN_WORDS = 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(31)
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, 2 * BANDS, dtype=np.uint64) * np.uint64(
    2
) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, filled on demand and bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = value
        return value


_hashes = WordHashes()


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Ascending hashes of the distinct shingles of a whole text.

    Words are runs without ASCII white space, A-Z in lower case. Fewer words than ``width`` are one
    shingle; a text without words has none.
    """
    words = (text or "").encode().lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=n)
    if n < width:
        total = np.array([n], dtype=np.uint64)
        for i in range(n):
            total = total * _STEP + hashed[i : i + 1]
    else:
        last = n - width + 1
        total = hashed[:last].copy()
        for i in range(1, width):
            total *= _STEP
            total += hashed[i : i + last]
    total ^= total >> _SHIFT
    total *= _MIX
    total ^= total >> _SHIFT
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the threshold, in whole numbers."""
    if not len(a) or not len(b):
        return False
    if PER_UNION * min(len(a), len(b)) < LINK * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return PER_UNION * shared >= LINK * (len(a) + len(b) - shared)


def prefix(tokens: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: rare ones by hash, then common ones by rank.

    As many as a set can miss and still reach the threshold, and one more.
    """
    n = len(tokens)
    size = n - -(-LINK * n // PER_UNION) + 1 if n else 0
    if not len(common):
        return tokens[:size]
    at = np.searchsorted(common, tokens)
    at[at == len(common)] = 0
    hit = common[at] == tokens
    rare = tokens[~hit]
    if len(rare) >= size:
        return rare[:size]
    known = at[hit]
    known = known[np.argsort(rank[known], kind="stable")][: size - len(rare)]
    return np.concatenate([rare, common[known]])


def bands(tokens: np.ndarray) -> np.ndarray:
    """Keys of the min-hash groups of a set."""
    if not len(tokens):
        return np.empty(0, dtype=np.uint64)
    least = np.array([(tokens * f).min() for f in _FACTORS], dtype=np.uint64)
    keys = (least[0::2] * _STEP + least[1::2]) * _MIX + np.arange(BANDS, dtype=np.uint64)
    return keys ^ (keys >> _SHIFT)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _common_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles most frequent in a sample of documents, and their rank by frequency."""
    total = docs.count()
    one_in = max(1, -(-total // ORDER_SAMPLE))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("jaccard")
        for batch in slices(batches):
            found = [shingles(t) for t in batch.column(0).to_pylist()]
            if found:
                values = pa.array(_signed(np.concatenate(found)), pa.int64())
                yield pa.RecordBatch.from_arrays([values], names=["token"])

    chosen = docs.where(F.pmod(F.xxhash64(text_col), F.lit(one_in)) == 0).select(text_col)
    counted = (
        chosen.mapInArrow(explode, "token long")
        .groupBy("token")
        .count()
        .where(F.col("count") >= ORDER_LEAST)
        .orderBy(F.desc("count"), "token")
        .limit(ORDER_SHINGLES)
        .select("token")
    )
    by_count = np.array([r["token"] for r in counted.collect()], dtype=np.int64).view(np.uint64)
    rank = np.arange(len(by_count))[::-1]
    order = np.argsort(by_count)
    return by_count[order], rank[order]


def signatures(docs: DataFrame, id_col: str, text_col: str, seed: int = 0) -> DataFrame:
    """Id, ``n`` shingles, ``node`` and ``check`` (two hashes of the set), ``prefix``, ``bands``, ``bits``.

    Stored. ``node`` is null for documents without words.
    """
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, text_col))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("jaccard")
        for batch in slices(batches):
            sizes, nodes, checks, prefixes, keys, maps = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingles(text)
                sizes.append(len(tokens))
                nodes.append(node_of(tokens, seed))
                checks.append(node_of(tokens, seed + 1))
                prefixes.append(_signed(prefix(tokens, *common.value)))
                keys.append(_signed(bands(tokens)))
                maps.append(bitmap(tokens).tobytes())
            arrays = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(nodes, pa.int64()),
                pa.array(checks, pa.int64()),
                pa.array(prefixes, pa.list_(pa.int64())),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(maps, pa.binary()),
            ]
            names = [id_col, "n", "node", "check", "prefix", "bands", "bits"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = (
        f"`{id_col}` {id_type}, n long, node long, check long, prefix array<long>, "
        "bands array<long>, bits binary"
    )
    return stored(docs.select(id_col, text_col).mapInArrow(run, schema), "signatures")


def node_of(tokens: np.ndarray, seed: int) -> int | None:
    """A hash of a whole set, as signed 64 bits."""
    if not len(tokens):
        return None
    value = xxhash.xxh3_64_intdigest(tokens.tobytes(), seed)
    return value - (1 << 64) if value >> 63 else value


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_shingles`` and ``component_id``, the smallest id reachable by links, of every document.

    A document without words links with nothing. A row with a null id has no component and makes
    no link; rows that repeat an id are documents of their own, and each row gives one. Other
    columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    for seed in range(0, 64, 2):
        signed = signatures(docs, id_col, text_col, seed)
        members = signed.where(F.col("node").isNotNull() & F.col(f"`{id_col}`").isNotNull())
        nodes = stored(
            members.groupBy("node").agg(
                F.min(id_col).alias("rep"),
                F.min("check").alias("low"),
                F.max("check").alias("high"),
            ),
            "nodes",
        )
        # Two different sets with one 64-bit hash would count as copies; then hash anew.
        if nodes.where("low <> high").isEmpty():
            break
        discard(spark, signed)
    else:
        raise RuntimeError("no hash tells all sets apart")
    nodes = Lookup.stage(nodes.select("node", "rep"), ["node"], "llm-reps")

    links = _pivot_links(docs, members, nodes, id_col, text_col, seed)
    united = Lookup.stage(connected_components(links), ["node"], "llm-united")
    release(spark)
    chosen, large = _roots(members, nodes, united, id_col)
    release(spark)
    for turn in range(PIVOT_TURNS if large is not None else 0):
        pairs = _root_pivots(members, nodes, united, large, id_col, turn)
        links = verify(docs, pairs, nodes, id_col, text_col, seed)
        found = links.count()
        if found:
            whole = connected_components(united.df.toDF("a", "b").union(links))
            united = Lookup.stage(whole, ["node"], "llm-united")
        release(spark)
        if found <= FEW_LINKS:
            break
    pairs = _tree_pairs(members, nodes, united, chosen, id_col)
    release(spark)
    more = verify(docs, pairs, nodes, id_col, text_col, seed)
    whole = united.df.toDF("a", "b").union(more)
    final = connected_components(whole)

    labelled = nodes.df.join(final, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    smallest = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = stored(labelled.join(smallest, "component").select("node", "component_id"), "labels")
    own = F.coalesce(F.col("component_id"), F.col(f"`{id_col}`"))
    return signed.select(id_col, "n", "node").join(labels, "node", "left").select(
        id_col,
        F.col("n").alias("n_shingles"),
        F.when(F.col(f"`{id_col}`").isNotNull(), own).alias("component_id"),
    )


def _representatives(members: DataFrame, nodes: Lookup, id_col: str) -> DataFrame:
    """One row of signatures for each different set."""
    found = lookup_join(members, nodes, ["node"], "inner")
    return found.where(F.col(f"`{id_col}`") == F.col("rep")).drop("rep", "check", id_col)


def _pivot_links(
    docs: DataFrame, members: DataFrame, nodes: Lookup, id_col: str, text_col: str, seed: int
) -> DataFrame:
    """Verified links between sets and a pivot of their min-hash group, in two rounds.

    In the second, only groups that are still in several components have a pivot.
    """
    keyed = stored(
        _representatives(members, nodes, id_col).select("node", F.explode("bands").alias("key")),
        "bands",
    )
    pivots = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"))
    pairs = keyed.join(pivots.where("a < z").drop("z"), "key").where("node <> a")
    pairs = stored(pairs.select("a", F.col("node").alias("b")).distinct(), "pivots")
    links = verify(docs, pairs, nodes, id_col, text_col, seed)
    united = Lookup.stage(connected_components(links), ["node"], "llm-first")
    labelled = lookup_join(keyed, united, ["node"]).withColumn(
        "component", F.coalesce("component", "node")
    )
    last = F.max(F.struct("node", "component")).alias("last")
    pivots = labelled.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), last
    )
    pairs = (
        labelled.join(pivots.where("low < high"), "key")
        .where("component <> last.component")
        .select(F.col("last.node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    more = verify(docs, stored(pairs, "pivots"), nodes, id_col, text_col, seed)
    return united.df.toDF("a", "b").union(more)


def _texts(
    docs: DataFrame, wanted: DataFrame, nodes: Lookup, id_col: str, text_col: str, seed: int
) -> DataFrame:
    """``node`` and ``text`` of the wanted sets, from the document of smallest id that has each."""
    named = wanted.select("node").distinct().join(nodes.df, "node").select("rep", "node")
    lookup = Lookup.stage(named, ["rep"], "llm-wanted")
    found = lookup_join(docs.select(id_col, text_col), lookup, [id_col], "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("jaccard")
        # An id may be repeated with another text, which has another set.
        for batch in slices(batches):
            keep = [
                node_of(shingles(text), seed) == node
                for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return (
        found.select("node", F.col(f"`{text_col}`").alias("text"))
        .mapInArrow(run, "node long, text string")
        .dropDuplicates(["node"])
    )


@lru_cache(maxsize=64)
def _kept_shingles(text: str) -> np.ndarray:
    return shingles(text)


def _forget() -> None:
    _hashes.clear()
    _kept_shingles.cache_clear()


keeps("jaccard", _forget)


def verify(
    docs: DataFrame, pairs: DataFrame, nodes: Lookup, id_col: str, text_col: str, seed: int
) -> DataFrame:
    """The pairs (``a``, ``b``) of stored candidate pairs whose whole sets reach the threshold, stored."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    texts = _texts(docs, wanted, nodes, id_col, text_col, seed)
    both = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("jaccard")
        for batch in slices(batches):
            first, second = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [linked(_kept_shingles(x), shingles(y)) for x, y in zip(first, second)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    checked = both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")
    return stored(checked, "verified")


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bits of a set, of a power-of-two width of more than four bits a shingle."""
    bits = max(LEAST_BITS, 1 << (8 * max(1, len(tokens))).bit_length() - 1)
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of fewer words: halves are combined by OR. Works along the last axis."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


def _ones(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


class TreeNode:
    """Documents ``start`` to ``end`` of the sorted list, and what bounds the overlap with them."""

    __slots__ = ("start", "end", "children", "bits", "extra", "least", "most", "component", "rest")

    def __init__(self, start, end, children, bits, extra, least, most, component, rest):
        self.start, self.end, self.children, self.bits = start, end, children, bits
        # Shingles beyond the first of a bit, at most.
        self.extra, self.least, self.most, self.component = extra, least, most, component
        # Shingles of a document from the root on, at most.
        self.rest = rest


def build_tree(
    sizes: np.ndarray, maps: list[np.ndarray], comps: np.ndarray, rests: np.ndarray
) -> TreeNode:
    """Signature tree over documents sorted by size."""
    level = []
    for start in range(0, len(sizes), LEAF):
        end = min(start + LEAF, len(sizes))
        width = min(len(m) for m in maps[start:end])
        folded = np.stack([fold(m, width) for m in maps[start:end]])
        own = comps[start:end]
        level.append(
            TreeNode(
                start,
                end,
                (),
                np.bitwise_or.reduce(folded, axis=0),
                int((sizes[start:end] - _ones(folded)).max()),
                int(sizes[start]),
                int(sizes[end - 1]),
                own[0] if (own == own[0]).all() else None,
                int(rests[start:end].max()),
            )
        )
    while len(level) > 1:
        level = [_parent(level[i : i + FAN]) for i in range(0, len(level), FAN)]
    return level[0]


def _parent(nodes: list[TreeNode]) -> TreeNode:
    width = min(len(n.bits) for n in nodes)
    # Folding may put more shingles on a bit: at most as many as bits were lost.
    lost = [int(_ones(n.bits) - _ones(fold(n.bits, width))) for n in nodes]
    same = nodes[0].component is not None and all(n.component == nodes[0].component for n in nodes)
    return TreeNode(
        nodes[0].start,
        nodes[-1].end,
        tuple(nodes),
        np.bitwise_or.reduce(np.stack([fold(n.bits, width) for n in nodes]), axis=0),
        max(n.extra + x for n, x in zip(nodes, lost)),
        nodes[0].least,
        nodes[-1].most,
        nodes[0].component if same else None,
        max(n.rest for n in nodes),
    )


def may_link(a: TreeNode, b: TreeNode) -> bool:
    """False when no document of one can reach the threshold with one of the other."""
    if a.component is not None and a.component == b.component:
        return False
    if PER_UNION * a.most < LINK * b.least or PER_UNION * b.most < LINK * a.least:
        return False
    width = min(len(a.bits), len(b.bits))
    x, y = fold(a.bits, width), fold(b.bits, width)
    shared = int(_ones(x & y))
    lost_a, lost_b = int(_ones(a.bits) - _ones(x)), int(_ones(b.bits) - _ones(y))
    # Shingles in common lie on shared bits: one each, and at most the extra ones besides.
    most = min(shared + a.extra + lost_a, shared + b.extra + lost_b, a.most, b.most, a.rest, b.rest)
    return (PER_UNION + LINK) * most >= LINK * (a.least + b.least)


def dual_traversal(
    sizes: np.ndarray,
    maps: list[np.ndarray],
    comps: np.ndarray,
    sides: np.ndarray,
    rests: np.ndarray | None = None,
) -> Iterator[tuple[int, int]]:
    """Pairs of positions whose bounds allow a link, of different components.

    Members of side 0 meet those of side 1 only; members of side 3 meet each other. Documents are
    sorted by size; of a document's shingles in the common order, ``rests`` tells how many there are from the
    root on, all when not given. Two documents need to meet at the first shingle they share only, so they share no more.
    """
    rests = sizes if rests is None else rests
    root = build_tree(sizes, maps, comps, rests)
    waiting = [(root, root)]
    while waiting:
        a, b = waiting.pop()
        if not may_link(a, b):
            continue
        if a.children or b.children:
            # Split the one with more documents; a node with itself into its pairs of children.
            if a is b:
                kids = a.children
                waiting += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
            elif not b.children or (a.children and a.end - a.start >= b.end - b.start):
                waiting += [(kid, b) for kid in a.children]
            else:
                waiting += [(a, kid) for kid in b.children]
            continue
        width = min(len(a.bits), len(b.bits))
        left = np.stack([fold(m, width) for m in maps[a.start : a.end]])
        right = left if a is b else np.stack([fold(m, width) for m in maps[b.start : b.end]])
        n, m = sizes[a.start : a.end], sizes[b.start : b.end]
        shared = _ones(left[:, None, :] & right[None, :, :])
        most = np.minimum((shared.T + n - _ones(left)).T, shared + m - _ones(right))
        most = np.minimum(most, np.minimum(rests[a.start : a.end, None], rests[None, b.start : b.end]))
        fits = (PER_UNION + LINK) * most >= LINK * (n[:, None] + m[None, :])
        fits &= comps[a.start : a.end, None] != comps[None, b.start : b.end]
        s, t = sides[a.start : a.end, None], sides[None, b.start : b.end]
        fits &= (s != t) | (s == 3)
        if a is b:
            fits = np.triu(fits, 1)
        for i, j in np.argwhere(fits).tolist():
            yield a.start + i, b.start + j


def _roots(members: DataFrame, nodes: Lookup, united: Lookup, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``token``, ``node``, ``n`` and ``rest`` of the roots that trees are made of, stored; the first three of large ones.

    Two linked documents share no more shingles than either has from the first on that they share, their root. So
    a row goes that cannot have its first shared shingle there, with the smallest set of its root.
    """
    spark = members.sparkSession
    known = lookup_join(_representatives(members, nodes, id_col), united, ["node"]).select(
        "node", F.coalesce("component", "node").alias("component"), "n", "prefix"
    )
    rows = known.select("node", "component", "n", F.posexplode("prefix").alias("place", "token"))
    rows = rows.select("token", "node", "component", "n", (F.col("n") - F.col("place")).alias("rest"), "place")
    # Roots with several components; a minimum and a maximum for each, taken before the shuffle.
    several = (
        rows.groupBy("token")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"))
        .where("low < high")
        .select("token", "least")
    )
    several = Lookup.stage(several, ["token"], "llm-roots")
    crossing = lookup_join(rows, several, ["token"], "inner")
    enough = (PER_UNION + LINK) * F.col("rest") >= LINK * (F.col("n") + F.col("least"))
    crossing = stored(crossing.where(enough).drop("least").dropDuplicates(["token", "node"]), "crossing")
    # Shingles of one passage are roots over the same documents: the first of them will do. The common order
    # is the same in all documents, so it comes first in each.
    alike = crossing.groupBy("token").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.min("place").alias("place"),
        F.count(F.lit(1)).alias("c"),
        F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit("two"), F.col("node"))).alias("two"),
    )
    roots = alike.where("low < high").groupBy("c", "one", "two").agg(F.min(F.struct("place", "token")).alias("first"))
    roots = roots.select(F.col("first.token").alias("token"), "c")
    chosen = stored(crossing.join(roots, "token").select("token", "node", "n", "rest", "c"), "roots")
    discard(spark, crossing)
    large = chosen.where(F.col("c") > LARGE_ROOT).select("token", "node", "n")
    return chosen.drop("c"), None if large.isEmpty() else stored(large, "large-roots")


def _in_components(rows: DataFrame, united: Lookup) -> DataFrame:
    found = lookup_join(rows, united, ["node"])
    return found.withColumn("component", F.coalesce("component", "node"))


def _root_pivots(
    members: DataFrame, nodes: Lookup, united: Lookup, large: DataFrame, id_col: str, turn: int
) -> DataFrame:
    """Pairs of a document and the pivots of each of its large roots, others in each turn, that may link. Stored.

    A row of a root makes ``PIVOTS`` pairs, so a group of very many variants is united by as many pairs as it has rows
    and not by a pair for every two.
    """
    labelled = _in_components(large, united)
    order = F.xxhash64(F.lit(turn), "node")
    pivots = labelled.groupBy("token", F.pmod(order, F.lit(PIVOTS)).alias("k")).agg(
        F.max(F.struct(order.alias("order"), "node", "n", "component")).alias("p")
    )
    met = labelled.join(pivots, "token").where("component <> p.component")
    smaller, larger = F.least("n", "p.n"), F.greatest("n", "p.n")
    met = met.where(PER_UNION * smaller >= LINK * larger)
    met = met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
    drawn = _representatives(members, nodes, id_col).select("node", "n", "bits").dropDuplicates(["node"])
    drawn = stored(drawn.join(large.select("node").distinct(), "node", "left_semi"), "large-bits")
    both = met.join(drawn.toDF("a", "n", "x"), "a").join(drawn.toDF("b", "m", "y"), "b")
    pairs = stored(both.select("a", "b", "n", "m", "x", "y").mapInArrow(_fitting, "a long, b long"), "pivots")
    discard(members.sparkSession, drawn)
    return pairs


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose bitmaps allow a link."""
    for batch in slices(batches):
        keep = []
        for n, m, *maps in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            x, y = (np.frombuffer(b, dtype=np.uint64) for b in maps)
            width = min(len(x), len(y))
            x, y = fold(x, width), fold(y, width)
            most = int(_ones(x & y)) + min(n - int(_ones(x)), m - int(_ones(y)))
            keep.append((PER_UNION + LINK) * most >= LINK * (n + m))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _tree_pairs(
    members: DataFrame, nodes: Lookup, united: Lookup, chosen: DataFrame, id_col: str
) -> DataFrame:
    """Candidate pairs of different components, from the trees of all roots. Stored."""
    spark = members.sparkSession
    chosen = _in_components(chosen.select("token", "node", "rest"), united)
    several = chosen.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    chosen = stored(chosen.join(several.where("low < high").select("token"), "token", "left_semi"), "open-roots")
    release(spark)
    drawn = _representatives(members, nodes, id_col).select("node", "n", "bits")
    drawn = drawn.join(chosen.select("node").distinct(), "node", "left_semi")
    placed = _blocks(chosen).join(drawn.dropDuplicates(["node"]), "node")
    spread = placed.repartition(partitions(spark), "token", "task").sortWithinPartitions(
        "token", "task", "n", "node"
    )
    columns = ["token", "task", "node", "component", "side", "n", "rest", "bits"]
    pairs = spread.select(*columns).mapInArrow(_traverse, "a long, b long")
    return stored(pairs.distinct(), "candidates")


def _blocks(crossing: DataFrame) -> DataFrame:
    """Deal the documents of each root to tasks of bounded size.

    Most roots have few documents and one task. In a larger one, documents of the component that
    has the most rows meet the others only: they are dealt to blocks and the others, themselves in blocks,
    go to each of them. The others also meet each other, by pairs of blocks.
    """
    per_component = crossing.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    roots = per_component.groupBy("token").agg(
        F.sum("c").alias("total"), F.max(F.struct("c", "component")).alias("top")
    )
    large = roots.where(F.col("total") > BLOCK).select(
        "token",
        F.col("top.component").alias("main"),
        F.ceil(F.col("top.c") / (BLOCK // 2)).alias("blocks"),
        F.ceil((F.col("total") - F.col("top.c")) / (BLOCK // 2)).alias("others"),
    )
    dealt = crossing.join(large, "token", "left")
    own = F.xxhash64("node")
    main = F.col("component") == F.col("main")
    block = F.pmod(own, F.col("blocks"))
    other = F.pmod(own, F.greatest("others", F.lit(1)))

    def task(kind: str, i, j, side):
        name = F.concat_ws(":", F.lit(kind), i.cast("string"), j.cast("string"))
        return F.struct(name.alias("task"), side.alias("side"))

    to_others = F.transform(
        F.sequence(F.lit(0), F.col("others") - 1), lambda j: task("m", block, j, F.lit(0))
    )
    to_blocks = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: task("m", i, other, F.lit(1))
    )
    among = F.transform(
        F.sequence(F.lit(0), F.col("others") - 1),
        lambda k: task(
            "o",
            F.least(other, k),
            F.greatest(other, k),
            F.when(other == k, F.lit(3)).when(other < k, F.lit(0)).otherwise(F.lit(1)),
        ),
    )
    whole = F.array(task("w", F.lit(0), F.lit(0), F.lit(3)))
    tasks = F.when(F.col("main").isNull(), whole).when(main, to_others).otherwise(
        F.concat(to_blocks, among)
    )
    return dealt.select("token", "node", "component", "rest", F.explode(tasks).alias("t")).select(
        "token", "node", "component", "rest", "t.task", "t.side"
    )


def _traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dual traversal of each (token, task), whose rows follow each other."""
    key, rows = None, []

    def flush() -> pa.RecordBatch:
        found = []
        if len(rows) > 1:
            nodes, comps, sides, sizes, rests, maps = zip(*rows)
            traversal = dual_traversal(
                np.array(sizes),
                [np.frombuffer(m, dtype=np.uint64) for m in maps],
                np.array(comps),
                np.array(sides),
                np.array(rests),
            )
            found = [sorted((nodes[i], nodes[j])) for i, j in traversal]
        first, second = ([p[0] for p in found], [p[1] for p in found])
        arrays = [pa.array(first, pa.int64()), pa.array(second, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for token, task, *row in zip(*columns):
            if (token, task) != key:
                yield flush()
                key, rows = (token, task), []
            rows.append(row)
    yield flush()
