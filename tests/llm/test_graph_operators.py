"""Joins, components, lines, vectors and revisits against brute force on small tables."""

import itertools
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm import ann, covertree, jaccard, lines, warc
from wayfold.llm.components import connected_components
from wayfold.llm.tables import stored
from wayfold.operators.joins import Lookup


def groups_of(nodes, links):
    """Smallest reachable node, by repeated relabelling."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("kind", ["chain", "random", "none"])
def test_components(spark, kind):
    random.seed(5)
    links = {
        "chain": [(i + 1, i) for i in range(40)],
        "random": [(random.randint(0, 60), random.randint(0, 60)) for _ in range(45)],
        "none": [],
    }[kind]
    frame = spark.createDataFrame([*links, *links, (None, 3)], "a long, b long")
    real = [(a, b) for a, b in links if a != b]
    expected = groups_of({n for p in real for n in p}, real)
    assert {r["node"]: r["component"] for r in connected_components(frame).collect()} == expected


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copies(seed=2):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = random.choices(vocabulary, k=55)
    texts = []
    for _ in range(12):
        base = random.choices(vocabulary, k=random.choice([3, 6, 30, 120, 300]))
        for _ in range(random.choice([1, 2, 6, 14])):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 40))):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts.append(" ".join(copy))
    for _ in range(8):
        texts.append(" ".join(passage + random.choices(vocabulary, k=random.randint(1, 60))))
    return texts


@pytest.mark.parametrize("block", [jaccard.BLOCK, 4])
def test_jaccard_equals_brute_force(make_docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_copies()
    rows = list(enumerate(texts, start=10))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "A B"), (904, "a b"), (905, "a b"),
             (906, "ſ K"), (907, "S k")]
    rows.append(rows[0])
    docs = make_docs([*rows, (None, texts[0])])
    sets = {i: shingle_set(t) for i, t in rows}
    links = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    expected = groups_of(sets, links)
    assert len(set(expected.values())) < len(expected)
    found = jaccard.components(docs).collect()
    assert len(found) == len(rows) + 1
    for row in found:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["n_shingles"] == len(sets[10])
        else:
            assert row["n_shingles"] == len(sets[row["doc_id"]])
            assert row["component_id"] == expected[row["doc_id"]], row


def test_jaccard_empty_table(make_docs):
    assert jaccard.components(make_docs([])).count() == 0


def test_signature_tree_bounds_lose_no_pair():
    """Every pair that links passes the dual traversal, in whichever component it is."""
    random_ = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = random_.integers(0, 1 << 63, random_.integers(1, 400), dtype=np.uint64)
        for _ in range(3):
            keep = random_.random(len(base)) > random_.choice([0.0, 0.05, 0.2])
            extra = random_.integers(0, 1 << 63, random_.integers(0, 20), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[keep], extra])))
    sets = sorted((s for s in sets if len(s)), key=len)
    expected = {
        (i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard.linked(sets[i], sets[j])
    }
    assert expected
    sizes = np.array([len(s) for s in sets])
    maps = [jaccard.bitmap(s) for s in sets]
    alone, together = np.arange(len(sets)), np.full(len(sets), 3)
    found = set(jaccard.dual_traversal(sizes, maps, alone, together))
    assert expected <= found and len(found) < 4 * len(expected) + 50
    one = np.zeros(len(sets), dtype=int)
    assert not set(jaccard.dual_traversal(sizes, maps, one, together))


def test_variants_that_link_by_chance_make_no_pair_for_every_two(make_docs, monkeypatch):
    random.seed(5)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in random.sample(range(140), 2):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    made, pivots = [], jaccard._root_pivots

    def counted(*args):
        found = pivots(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "_root_pivots", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.components(make_docs(rows)).collect()}
    sets = [jaccard.shingles(t) for _, t in rows]
    parent = list(range(120))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(120), 2):
        if jaccard.linked(sets[i], sets[j]):
            x, y = sorted((top(i), top(j)))
            parent[y] = x
    assert got == {i: top(i) for i in range(120)}
    assert made


def test_documents_meet_at_the_first_shingle_they_share():
    sets = [np.arange(100, dtype=np.uint64), np.arange(3, 103, dtype=np.uint64)]
    sizes, comps = np.array([100, 100]), np.array([0, 1])
    maps, together = [jaccard.bitmap(s) for s in sets], np.array([3, 3])
    assert list(jaccard.dual_traversal(sizes, maps, comps, together, np.array([97, 100]))) == [(0, 1)]
    # Later roots cannot be the first shingle of two documents that link.
    assert not list(jaccard.dual_traversal(sizes, maps, comps, together, np.array([80, 83])))


def test_lines(make_docs):
    random.seed(7)
    long_line = random.choices([f"word{i}" for i in range(300)], k=60)
    long_line[30] = "of"
    long_line = " ".join(long_line)
    edited = long_line.split()
    edited[30] = "in"
    edited = " ".join(edited)
    other = " ".join(random.choices([f"other{i}" for i in range(300)], k=60))
    docs = make_docs(
        [
            (3, f"{long_line}\nOne line.\n###"),
            (1, f"{other}\nONE   line!"),
            (2, f"{edited}\n{other}\n\n###"),
            (4, None),
            (5, ""),
            (None, f"{other}\nOne line."),
        ]
    )
    found = {(r["doc_id"], r["line_no"]): r for r in lines.mark(docs).collect()}
    assert len(found) == 3 + 2 + 4 + 1 + 2
    gone = {k for k, r in found.items() if not r["kept"]}
    assert gone == {(3, 1), (2, 1), (3, 0)}
    assert (found[3, 1]["kept_id"], found[3, 1]["kept_line"]) == (1, 1)
    assert (found[3, 0]["kept_id"], found[3, 0]["kept_line"]) == (2, 0)
    cleaned = {r["doc_id"]: r["text"] for r in lines.drop_repeats(docs).collect()}
    assert cleaned[3] == "###" and cleaned[2] == f"{edited}\n\n###"
    assert cleaned[4] is None and cleaned[5] == "" and cleaned[None] == f"{other}\nOne line."
    assert lines.drop_repeats(docs).columns == docs.columns


def test_many_variants_of_a_line_are_one_group(make_docs):
    random.seed(8)
    base = [f"word{random.randint(0, 999)}" for _ in range(80)]
    rows = [(i, " ".join([*base[:40], f"variant{i}", *base[41:]])) for i in range(60)]
    kept = [r["doc_id"] for r in lines.mark(make_docs(rows)).where("kept").collect()]
    assert 0 in kept and len(kept) <= 3


def test_variants_with_rare_words_of_their_own_meet_pivots(make_docs, monkeypatch):
    base = [f"word{i:02d}" for i in range(30)]
    rows = [(i, " ".join([f"quiteunusual{i}x{j}" for j in range(3)] + base[3:])) for i in range(40)]
    met = []
    whole = lines._close

    def counted(pairs):
        found = whole(pairs)
        met.append(found.count())
        return found

    monkeypatch.setattr(lines, "_close", counted)
    got = lines.mark(make_docs(rows)).where("kept").collect()
    assert [r["doc_id"] for r in got] == [0] and sum(met) < 40 * 39 / 4


def test_lines_that_share_rare_words_only_are_not_compared(make_docs, monkeypatch):
    shared = "anextraordinarilylongword"
    rows = [(i, " ".join([*[f"w{i}x{j}" for j in range(10)], shared, *[f"v{i}x{j}" for j in range(10)]])) for i in range(30)]
    met, whole = [], lines._close

    def counted(pairs):
        met.append(pairs.count())
        return whole(pairs)

    # The word stands for one that is not among the commonest of a large table.
    monkeypatch.setattr(lines, "COMMON", 0, raising=False)
    monkeypatch.setattr(lines, "COMMON_WORDS", (0, 0), raising=False)
    monkeypatch.setattr(lines, "_close", counted)
    got = lines.mark(make_docs([*rows, (30, rows[0][1] + " more")])).where("kept").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(30)) and 0 < sum(met) < 30


def test_keys_of_lines_are_dealt_once(spark, make_docs):
    found = lines.different_lines(make_docs([(1, "one two three four"), (2, "one two three five")]), "doc_id", "text")
    own = ["line", "words", *lines.PARITIES]
    labels = Lookup.stage(spark.createDataFrame([(0, 0)], "line long, component long"), ["line"], "test-labels")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for known in (None, labels):
            dealt = lines._dealt(lines.line_keys(found, F.col("rare")).drop("size"), known)
            met = lines._pivot_pairs(dealt, F.max(F.struct(*own, "component")), own)
            plan = met._jdf.queryExecution().executedPlan().toString().split("\n")
            assert len([x for x in plan if "REPARTITION_BY_COL" in x and "Reused" not in x]) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_lines_use_no_python_and_take_empty_tables(make_docs):
    found = lines.mark(make_docs([]))
    assert found.count() == 0
    text = found._jdf.queryExecution().toString()
    assert "Python" not in text and "Pandas" not in text and "Cartesian" not in text


def test_simhash_is_the_majority_of_each_bit(spark):
    random.seed(3)
    rows = [([random.randrange(-(2**60), 2**60) for _ in range(n)],) for n in (1, 2, 3, 12, 255, 400)]
    frame = spark.createDataFrame(rows, "tokens array<long>")
    votes = frame.select("tokens", lines.simhash(F.col("tokens")).alias("sim"),
                         F.transform("tokens", lambda t: F.xxhash64(F.lit("vote"), t)).alias("x"))
    for row in votes.collect():
        voters = row["x"][: lines.VOTES]
        bits = sum((2 * sum(x >> k & 1 for x in voters) > len(voters)) << k for k in range(64))
        assert row["sim"] % (1 << 64) == bits


def test_blocks_meet_whatever_two_bits_differ(spark):
    random.seed(4)
    sims = []
    for _ in range(40):
        sim = random.getrandbits(64)
        near = sim ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64))
        sims.append([x - (1 << 64) if x >= 1 << 63 else x for x in (sim, near)])
    frame = spark.createDataFrame(sims, "sim long, near long")
    own = frame.select(lines.block_tokens().alias("a"), F.col("near").alias("sim"))
    both = own.select("a", lines.block_tokens().alias("b")).collect()
    assert all(set(r["a"]) & set(r["b"]) for r in both)


def test_words_that_share_a_letter_do_not_link(make_docs, monkeypatch):
    # With so few letters most words share one, and letters alone would link nearly everything.
    monkeypatch.setattr(lines, "LETTERS", 3)
    random.seed(5)
    texts = [" ".join(f"w{random.randrange(10**6)}" for _ in range(10)) for _ in range(30)]
    texts += [texts[0].rsplit(" ", 1)[0] + " other", texts[1] + " other"]
    found = {r["doc_id"]: r["kept_id"] for r in lines.mark(make_docs(list(enumerate(texts)))).collect()}
    assert found == {**{i: i for i in range(30)}, 30: 0, 31: 1}


def test_rows_that_repeat_an_id_lose_their_own_lines_only(make_docs):
    rows = [
        (0, "dup line here now"),
        (1, "dup line here now\nfoo alpha"),
        (1, "unique line zz top\nbar beta"),
        (2, "bar beta"),
        (2, "bar beta"),
    ]
    docs = make_docs(rows).withColumns({"_row": F.lit(1), "_gone": F.lit(2), "_removed": F.lit(3), "kept": F.lit(4)})
    found = lines.drop_repeats(docs)
    assert found.columns == docs.columns
    got = sorted((r["doc_id"], r["text"]) for r in found.collect())
    assert got == [
        (0, "dup line here now"), (1, "foo alpha"), (1, "unique line zz top\nbar beta"), (2, ""), (2, "")
    ]


def test_documents_of_very_many_lines_and_very_long_lines(make_docs):
    many = "\n".join(["same old line of words"] * 160_000)
    mixed = "\n".join(f"line {i // 2} of a document" for i in range(40_000))
    long_ = " ".join(f"w{i % 3001}" for i in range(5_000))
    changed = long_.split()
    changed[100:400] = ["else"] * 300
    docs = make_docs([(1, many), (2, mixed), (3, long_), (4, " ".join(changed)), (5, "x" * 300_000)])
    found = {r["doc_id"]: r["text"] for r in lines.drop_repeats(docs).collect()}
    assert found[1] == "same old line of words" and found[3] == long_ and found[4] == ""
    assert found[2].split("\n")[0] == "line 0 of a document" and found[5] == "x" * 300_000


VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("node", T.StringType()),
    ]
)


def vector_rows(seed=1, n=160, dim=12):
    random_ = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 4 == 0 or i < 8:
            centre = random_.normal(size=dim)
        value = centre + random_.normal(size=dim) * random_.choice([0, 0.02, 0.1, 0.5])
        rows.append((i, [float(x) for x in value.astype(np.float32)], int(i % 3 == 0 and i > 80), "x"))
    rows += [
        (900, None, 0, "x"),
        (901, [], 0, "x"),
        (902, [0.0] * dim, 0, "x"),
        (903, [float("nan")] * dim, 0, "x"),
        (904, [None] * dim, 0, "x"),
        (905, [float("inf")] * dim, 0, "x"),
        (906, rows[5][1], None, "x"),
        (907, rows[5][1][:4], 0, "x"),
        (908, [x * 1e18 for x in rows[5][1]], 0, "x"),
    ]
    return rows


def good(vector):
    return bool(vector) and all(x is not None and np.isfinite(x) for x in vector) and any(vector)


@pytest.mark.parametrize("root", [covertree.ROOT, 16])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, root):
    monkeypatch.setattr(covertree, "ROOT", root)
    rows = [*vector_rows(), (None, vector_rows()[5][1], 0, "x")]
    links = []
    for a, b in itertools.combinations([r for r in rows if r[0] is not None], 2):
        if a[2] is not None and a[2] == b[2] and good(a[1]) and good(b[1]) and len(a[1]) == len(b[1]):
            x, y = np.array(a[1]), np.array(b[1])
            if (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= 0.98:
                links.append((a[0], b[0]))
    assert len(links) > 20
    ids = [r[0] for r in rows if r[0] is not None]
    expected = groups_of(ids, links)
    found = covertree.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(found) == len(rows)
    for row in found:
        i = row["vec_id"]
        if i is None:
            assert row["component_id"] is None and row["kept"] is None and row["n_links"] == 0
        else:
            assert row["n_links"] == sum(i in p for p in links), i
            assert row["component_id"] == expected[i] and row["kept"] == (expected[i] == i)


def test_near_duplicates_whose_squares_overflow_or_vanish(spark):
    vectors = [[1e200] * 3, [1e200, 1e200, 1.0001e200], [1e-200] * 3, [5e-324] * 3, [1.0] * 3, [1e300, -1e300, 0.0]]
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.near_duplicates(frame).collect()}
    assert found == {**{i: (4, 0) for i in range(5)}, 5: (0, 5)}


def test_near_duplicates_empty(spark):
    assert covertree.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_cover_tree_is_nested_and_covers():
    random_ = np.random.default_rng(4)
    units = covertree._units(np.concatenate([random_.normal(size=(60, 5)), np.ones((3, 5))]))
    tree = covertree.build(units)
    for above, level in zip(tree.levels, tree.levels[1:]):
        assert list(level.centre[: len(above.centre)]) == list(above.centre)
    last = tree.levels[-1]
    apart = np.linalg.norm(units - units[last.centre[tree.leaf_of]], axis=1)
    assert (apart <= last.radius[tree.leaf_of] + 1e-12).all() and apart.max() < 1e-5


def neighbours(rows, query, k):
    own = dict((r[0], r[1]) for r in rows)
    scores = [
        (-float(np.dot(np.array(own[query]), np.array(v))), i) for i, v in own.items() if i != query
    ]
    return [i for _, i in sorted(scores)[:k]]


def test_a_query_travels_once_to_each_bundle_of_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 4)
    whole, visits = ann.stored, []

    def watched(frame, label):
        found = whole(frame, label)
        if label == "visits":
            visits.append((found.columns, found.count()))
        return found

    monkeypatch.setattr(ann, "stored", watched)
    vectors = spark.createDataFrame([r for r in vector_rows(3) if r[0] < 160], VECTORS)
    found = ann.search(vectors, vectors.select("vec_id"), k=3, recall=1.0)
    assert found.count() == 160 * 3
    ((columns, count),) = visits
    assert "data" not in columns and count <= 2 * 160


def test_roots_meet_in_turns(spark, monkeypatch):
    monkeypatch.setattr(covertree, "ROOT", 4)
    whole, turns = covertree.stored, []

    def watched(frame, label):
        turns.append(label == "vector-links")
        return whole(frame, label)

    monkeypatch.setattr(covertree, "stored", watched)
    random_ = np.random.default_rng(6)
    rows = [(i, [1.0, *map(float, random_.normal(size=5) * 0.01)], 0, "x") for i in range(60)]
    found = covertree.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert {(r["n_links"], r["component_id"]) for r in found} == {(59, 0)} and sum(turns) > 2


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 16)
    monkeypatch.setattr(ann, "BLOCK", 8)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 5)
    rows = vector_rows(3)
    rows = [(i, [float(x / np.linalg.norm(v)) for x in v] if good(v) else v, *r) for i, v, *r in rows if i != 908]
    frame = spark.createDataFrame([*rows, rows[1], (None, rows[1][1], 0, "x")], VECTORS)
    held = {r["vec_id"]: r["embedding"] for r in frame.collect() if r["vec_id"] is not None}
    usable = [(i, v) for i, v in held.items() if good(v) and len(v) == 12]
    asked = frame.where("vec_id % 4 = 0").select("vec_id")
    found = {}
    for row in ann.search(frame, asked, k=5).collect():
        found.setdefault(row["query_id"], {})[row["rank"]] = (row["vec_id"], row["score"])
    assert set(found) == {i for i, _ in usable if i % 4 == 0}
    shares = []
    for query, ranks in found.items():
        assert sorted(ranks) == [1, 2, 3, 4, 5]
        ids = [ranks[r][0] for r in sorted(ranks)]
        assert query not in ids and len(set(ids)) == 5
        for i, score in ranks.values():
            exact = float(np.dot(np.array(held[query]), np.array(held[i])))
            assert abs(score - exact) < 1e-12
        shares.append(len(set(ids) & set(neighbours(usable, query, 5))) / 5)
    assert np.mean(shares) >= 0.9


def test_nearest_neighbours_of_few_and_equal_vectors(spark):
    rows = [(i, [1.0, 0.0], 0, "x") for i in range(6)]
    frame = spark.createDataFrame(rows, VECTORS)
    found = ann.search(frame, frame.where("vec_id = 3").select("vec_id"), k=20).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [0, 1, 2, 4, 5]
    empty = spark.createDataFrame([], VECTORS)
    assert ann.search(empty, empty.select("vec_id")).count() == 0


CAPTURES = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("captured_at", T.LongType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("part", T.StringType()),
    ]
)


def resolve(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], CAPTURES)
    return {r["record_id"]: r for r in warc.resolve_revisits(frame).collect()}


def test_revisits(spark):
    page = {"ETag": '"a"', "Content-Type": "text/html", "Content-Length": "9", "Date": "1"}
    rows = [
        (1, "http://www.Example.com/x/?utm_source=f&b=2&a=1#top", 10, 200, page),
        (2, "https://example.com:443/x?a=1&b=2", 20, 304, {"etag": 'W/"a"', "Date": "2", "Content-Length": "0"}),
        (3, "example.com/x?a=1&b=2", 30, 304, {"ETag": '"b"'}),
        (4, "http://example.com/x?b=2&a=1", 10, 304, {"ETag": '"a"'}),
        (5, "http://example.com/y", 10, 304, {}),
        (6, "http://example.com/y", 5, 200, {"Last-Modified": "m"}),
        (7, "http://example.com/y", 11, 304, {"Last-Modified": "m", "Set-Cookie": "no"}),
        (8, None, 11, 304, None),
        (9, "http://example.com/y", None, 304, {"Last-Modified": "m"}),
        (10, "http://example.com/y", 12, 304, None),
        (11, "http://example.com/y", 7, 404, {}),
    ]
    found = resolve(spark, rows)
    assert set(found) == {2, 3, 4, 5, 7, 8, 9, 10}
    got = {i: (r["base_id"], r["verdict"]) for i, r in found.items()}
    assert got == {
        2: (1, "resolved"),
        3: (1, "changed"),
        4: (None, "no_response"),
        5: (6, "no_validator"),
        7: (6, "resolved"),
        8: (None, "no_response"),
        9: (None, "no_response"),
        10: (6, "no_validator"),
    }
    assert found[2]["headers"] == {
        "etag": 'W/"a"', "content-type": "text/html", "content-length": "9", "date": "2"
    }
    assert found[7]["headers"] == {"last-modified": "m"} and found[3]["headers"] is None
    assert resolve(spark, []) == {}


def test_revisits_with_null_and_repeated_ids_keep_their_own_headers(spark):
    url = "http://h.example/p"
    rows = [
        (1, url, 1, 200, {"ETag": '"a"', "X": "one"}),
        (1, url, 5, 200, {"ETag": '"b"', "X": "two"}),
        (None, url, 2, 304, {"ETag": '"a"', "Date": "n1"}),
        (None, url, 6, 304, {"ETag": '"b"', "Date": "n2"}),
        (7, url, 3, 304, {"ETag": '"a"', "Date": "r1"}),
        (7, url, 7, 304, {"ETag": '"b"', "Date": "r2"}),
        (7, url, 7, 304, {"ETag": '"b"', "Date": "r2"}),
        (None, url, 8, 200, {"ETag": '"c"'}),
        (9, url, 9, 304, {"ETag": '"b"', "Date": "last"}),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], CAPTURES)
    found = sorted(
        (r["headers"]["date"], r["headers"]["x"], r["record_id"]) for r in warc.resolve_revisits(frame).collect()
    )
    assert found == [
        ("last", "two", 9), ("n1", "one", None), ("n2", "two", None), ("r1", "one", 7), ("r2", "two", 7), ("r2", "two", 7)
    ]


def test_one_url_over_many_ranges(spark):
    rows = []
    for i in range(400):
        rows.append((i, "http://h.example/p", i // 2, 200 if i % 37 == 0 else 304, {"ETag": '"e"'}))
    found = resolve(spark, rows)
    for i, _, at, status, _ in rows:
        if status == 304:
            earlier = [(t, j) for j, _, t, s, _ in rows if s == 200 and t < at]
            assert found[i]["base_id"] == (max(earlier)[1] if earlier else None)


def test_line_components_take_links_of_later_rounds(spark):
    def links(*pairs):
        return stored(spark.createDataFrame(list(pairs), "a long, b long"), "test-links")

    labels = lines._united(None, links((2, 1), (3, 4), (8, 9)))
    labels = lines._united(labels, links((4, 2), (5, 6)))
    labels = lines._united(labels, links((6, 9), (7, 9)))
    labels = lines._united(labels, links((4, 4)))
    found = {r["line"]: r["component"] for r in labels.df.collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5}


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_find_every_pair_of_the_edit_similarity(make_docs):
    """Recall by length against brute force: every pair of lines is a group or is not, as the edits say."""
    random.seed(12)
    common = [f"w{i}" for i in range(30)]
    rows, pairs = [], []
    for n in (4, 5, 9, 10, 14, 19, 25, 39, 60, 79, 130, 300):
        for k in range(14):
            base = [random.choice([*common, f"rare{random.randrange(4000)}"]) for _ in range(n)]
            line = list(base)
            edits = n // 5 if k % 2 else max(1, n // 10)
            for i in random.sample(range(n), edits + (k == 13)):
                line[i] = f"new{random.randrange(10**6)}"
            if k % 5 == 0:
                del line[random.randrange(len(line))]
            pairs.append((n, base, line))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(line))]
    found = {r["doc_id"]: r for r in lines.mark(make_docs(rows)).collect()}
    linked = {}
    for k, (n, base, line) in enumerate(pairs):
        longer = max(len(base), len(line))
        if word_distance(base, line) <= int(longer * 0.2 + 1e-9):
            linked.setdefault(n, []).append(found[2 * k]["kept_id"] == found[2 * k + 1]["kept_id"])
    assert len(linked) >= 10 and all(map(all, linked.values())), linked
    texts = {i: t.split() for i, t in rows}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        longer = max(len(texts[a]), len(texts[b]))
        allowed = int(longer * 0.2 + 1e-9)
        if abs(len(texts[a]) - len(texts[b])) <= allowed and len(texts[a]) < 80:
            if word_distance(texts[a], texts[b]) <= allowed:
                low, high = sorted((top(a), top(b)))
                root[high] = low
    short = [i for i in texts if len(texts[i]) < 80]
    assert {i: found[i]["kept_id"] for i in short} == {i: top(i) for i in short}


def test_pipeline_keeps_documents_that_share_an_id(spark):
    random.seed(21)
    texts = [" ".join(f"t{k}w{random.randrange(10**6)}" for _ in range(60)) for k in range(5)]
    near = texts[0] + " more"
    rows = [(1, texts[0]), (2, near), (2, texts[1]), (3, texts[2]), (3, texts[2]), (None, texts[0])]
    rows += [(4, texts[3]), (4, texts[4])]
    docs = spark.createDataFrame(
        [(i, t, "en", "x", len(t)) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    found = corpus_pipeline.jaccard_join(spark, docs, "")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in found.collect())
    stay = [(0, texts[0]), (1, texts[0]), (2, texts[1]), (3, texts[2]), (4, texts[3]), (4, texts[4])]
    assert kept == sorted(stay)
