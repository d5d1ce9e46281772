import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import requests as Q
from wayfold.operators import names, similarity
from wayfold.operators import retrieval as R
from wayfold.operators.similarity import similar_by_embedding, similar_by_embedding_batch

SCHEMA = (
    "product_id long, name string, segment string, category string, type string, "
    "franchise string, min_age int, times_sold long, store_a long, store_b long, store_c long, "
    "popularity_global double, text_blob string"
)


def make_products(rng, count):
    rows = []
    for i in range(1, count + 1):
        name = "".join(rng.choices("abc", k=rng.randint(1, 6)))
        segment = rng.choice(["Games", "Games", "Console", "Accessories", None])
        franchise = rng.choice(["f1", "f1", "f1", "f2", "f3", None])
        stores = [rng.choice([0, 0, 1, 2, 3]) for _ in range(3)]
        age = rng.choice([0, 3, 7, 12, 300])
        rows.append(
            (i, name, segment, "c", "t", franchise, age, 1, *stores, rng.randrange(6) / 5, "b")
        )
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_products(random.Random(11), 150)


@pytest.fixture(scope="module")
def products(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def search(rows, segment, store, max_age, excluded, k):
    column = {"store_a": 8, "store_b": 9, "store_c": 10}.get(store)
    kept = [
        r
        for r in rows
        if (segment is None or r[2] == segment)
        and (max_age is None or r[6] <= max_age)
        and (not excluded or (r[5] is not None and r[5] != excluded))
        and (column is None or r[column] > 0)
    ]
    kept.sort(key=lambda r: (-(r[column] if column else 0), -r[11], r[0]))
    return [r[0] for r in kept[:k]]


@pytest.mark.parametrize(
    "store,max_age,excluded,segment",
    [
        (None, None, None, "Games"),
        ("Store A", 7, "f1", "Games"),
        ("b", 0, "", None),
        ("unknown", 12, "f2", "Console"),
    ],
)
def test_single_search(products, rows, store, max_age, excluded, segment):
    got = R.search_products(products, store, max_age, excluded, segment, 7)
    assert got.columns == list(R.SEARCH_COLUMNS)
    key = R.store_column(store)
    assert [r["product_id"] for r in got.collect()] == search(rows, segment, key, max_age, excluded, 7)


def make_requests(spark, rng, count):
    rows = []
    for i in range(count):
        intent = rng.choice(["search_product", "recommendation", "greeting", "unrelated"])
        constraints = (
            rng.choice([None, -5, 0, 3, 5, 7, 11, 12, 299, 300, 2**31 - 1]),
            rng.choice([None, "Store A", "B", "store_c", "elsewhere"]),
            rng.choice([None, "Games", "Console", "Accessories", "Other"]),
            rng.choice([None, "", "f1", "f1", "f2"]),
        )
        rows.append((i, intent, constraints, [rng.choice(["AB", "c", "zzz", "Ca"])]))
    schema = (
        "request_id long, intent_type string, constraints struct<max_age: int, store: string, "
        "category: string, exclude_franchise: string>, mentioned_products array<string>"
    )
    return rows, spark.createDataFrame(rows, schema)


def expected_search(rows, request, k=5):
    age, store, category, excluded = request[2]
    segment = category if category in Q.SEGMENTS else "Games"
    return search(rows, segment, R.store_column(store), age, excluded, k)


@pytest.mark.parametrize("large", [False, True])
def test_batch_search_equals_single_searches(spark, products, rows, large, monkeypatch):
    if large:
        monkeypatch.setattr("wayfold.operators.joins.BROADCAST_BYTES", -1)
    asked, requests = make_requests(spark, random.Random(4), 120)
    got = {}
    for r in Q.batch_search(requests, products).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["product_id"])
    expected = {
        r[0]: expected_search(rows, r) for r in asked if r[1] in Q.SEARCH_INTENTS
    }
    assert got == {k: v for k, v in expected.items() if v}
    messages = {r["request_id"] for r in Q.request_messages(requests).collect()}
    assert messages == {r[0] for r in asked if r[1] not in Q.SEARCH_INTENTS}


def fuzzy(rows, term, k):
    found = [r for r in rows if term.lower() in r[1].lower()]
    return [r[0] for r in sorted(found, key=lambda r: (-r[11], r[0]))[:k]]


def test_names_that_contain_terms(spark, products, rows):
    terms = ["a", "AB", "abc", "zz", "", "cab", "aaaaaaaaa"]
    asked = spark.createDataFrame([(t,) for t in [*terms, None, "a"]], "term string")
    got = {}
    for r in R.fuzzy_matches(asked, products, 4).orderBy("term", "rank").collect():
        got.setdefault(r["term"], []).append(r["product_id"])
    assert got == {t: fuzzy(rows, t, 4) for t in terms if fuzzy(rows, t, 4)}
    single = R.product_fuzzy(products, "AB", 4).collect()
    assert [r["product_id"] for r in single] == fuzzy(rows, "ab", 4)
    wild = {r["product_id"] for r in R.product_fuzzy(products, "a_c", 1000).collect()}
    assert {r[0] for r in rows if "abc" in r[1] or "aac" in r[1] or "acc" in r[1]} == wild
    assert R.product_fuzzy(products, "a_c", 10, literal=True).count() == 0


def test_wildcards_work_for_many_terms_as_for_one(spark, products):
    names = spark.createDataFrame(
        [(1, "Mario Kart", 0.5), (2, "Super Mario", 0.9), (3, "50% off", 0.1), (4, "a_b\\\\c", 0.2), (5, "xy", 0.3)],
        "product_id long, name string, popularity_global double",
    )
    for c in R.NEIGHBOR_COLUMNS:
        if c not in names.columns:
            names = names.withColumn(c, F.lit(None).cast("string"))
    terms = ["M%o", "_ario", "mario", "%", "___", "0\\% O", "\\_B", "a%c", "zz%", "r_o k", "ma%o%t", ""]
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {}
    for r in R.fuzzy_matches(asked, names, 4).orderBy("term", "rank").collect():
        got.setdefault(r["term"], []).append(r["product_id"])
    for term in terms:
        single = [r["product_id"] for r in R.product_fuzzy(names, term, 4).collect()]
        assert got.get(term, []) == single, term
    assert got["M%o"] == [2, 1] and got["___"] == [2, 1, 4, 3]
    lone = spark.createDataFrame([("b\\",), ("\\",), ("b\\c",)], "term string")
    assert R.fuzzy_matches(lone, names, 4).count() == 2
    plain = R.fuzzy_matches(asked, names, 4, literal=True).collect()
    assert {r["term"] for r in plain} == {"mario", "%", ""}


def make_edges(spark, rng, count):
    pairs = {}
    for _ in range(count):
        a, b = sorted(rng.sample(range(1, 170), 2))
        pairs[a, b] = rng.randint(1, 4)
    # One product takes part in a third of the edges.
    for b in range(2, 151):
        pairs[1, b] = rng.randint(1, 4)
    rows = [(a, b, n) for (a, b), n in pairs.items()]
    return rows, spark.createDataFrame(rows, "product_id_1 long, product_id_2 long, cooccurrence_count long")


def test_neighbors_of_every_product(spark, products):
    rows, edges = make_edges(spark, random.Random(9), 300)
    got = {}
    for r in R.neighbors_topk(edges, products, 3).orderBy("product_id_1", "rank").collect():
        got.setdefault(r["product_id_1"], []).append((r["product_id"], r["cooccurrence_count"]))
    expected = {}
    for a, b, n in sorted(rows, key=lambda e: (e[0], -e[2], e[1])):
        if b <= 150:
            expected.setdefault(a, []).append((b, n))
    assert got == {k: v[:3] for k, v in expected.items()}
    one = R.cooccurrence_neighbors(edges, products, 1, 3).collect()
    assert [(r["product_id"], r["cooccurrence_count"]) for r in one] == expected[1][:3]
    last = R.cooccurrence_neighbors(edges, products, 150, 3)
    assert last.count() == 0 or 150 in expected
    assert R.cooccurrence_neighbors(edges, products, 150, 3, symmetric=True).count() > 0


def test_recommendations(spark, products, rows):
    edge_rows, edges = make_edges(spark, random.Random(2), 300)
    asked, requests = make_requests(spark, random.Random(8), 60)
    got = {}
    for r in Q.recommend(requests, products, edges).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append((r["product_id"], r["source"]))
    by_id = {r[0]: r for r in rows}
    expected = {}
    for request in asked:
        if request[1] not in Q.SEARCH_INTENTS:
            continue
        listed = []
        for named in fuzzy(rows, request[3][0], 1):
            near = [e for e in edge_rows if e[0] == named and e[1] in by_id]
            near.sort(key=lambda e: (-e[2], e[1]))
            fitting = [e[1] for e in near[:5] if expected_search([by_id[e[1]]], request)]
            listed += [(p, "bought together") for p in fitting]
        seen = {p for p, _ in listed}
        listed += [(p, "search") for p in expected_search(rows, request) if p not in seen]
        if listed:
            expected[request[0]] = listed[:5]
    assert got == expected


def test_details(spark, products, rows):
    assert R.product_details(products, 3, "x").first()["product_id"] == 3
    name = rows[4][1]
    first = min(r[0] for r in rows if r[1].lower() == name.lower())
    assert R.product_details(products, 0, name.upper()).first()["product_id"] == first
    assert R.product_details(products).count() == 0
    asked = spark.createDataFrame(
        [(1, 3, "x"), (2, 0, name.upper()), (3, None, name), (4, None, None), (5, 999, name)],
        "request_id long, product_id long, product_name string",
    )
    got = {r["request_id"]: r["product_id"] for r in R.product_details_batch(asked, products).collect()}
    assert got == {1: 3, 2: first, 3: first}


def test_embedding_text(spark, products):
    few = products.where("product_id <= 3").withColumn("min_age", F.col("product_id").cast("int") * 5)
    few = few.withColumns({"name": F.concat(F.lit("P"), "product_id"), "segment": F.lit("Games"), "franchise": F.lit("F")})
    edges = spark.createDataFrame([(1, 2, 1), (1, 3, 4)], "product_id_1 long, product_id_2 long, cooccurrence_count long")
    got = {r[0]: r[1] for r in R.embedding_text(few, edges).collect()}
    assert got == {
        1: "P1 (Games, F). Frequently bought with: P3, P2. Popular with young children and families",
        2: "P2 (Games, F). Popular with pre-teens",
        3: "P3 (Games, F)",
    }


def test_nearest_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = similar_by_embedding(vectors, [0, 2], 2).orderBy("vec_id", "rank").collect()
    assert [(r["vec_id"], r["similar_id"]) for r in got] == [(0, 4), (0, 1), (2, 1), (2, 0)]
    assert similar_by_embedding(vectors, [77]).count() == 0


VECTOR = "vec_id long, embedding array<double>"


def nearest(rows, asked, k):
    """Plain comparison of all with all; of an id's copies the smallest vector is asked."""
    usable = [(i, np.array(v)) for i, v in rows if i is not None and good_vector(v)]
    own = {}
    for i, v in usable:
        if i not in own or v.tolist() < own[i].tolist():
            own[i] = v
    units = [(i, v / np.abs(v).max()) for i, v in usable]
    units = [(i, v / np.linalg.norm(v)) for i, v in units]
    found = {}
    for a in {i for i in asked if i in own}:
        q = own[a] / np.abs(own[a]).max()
        q = q / np.linalg.norm(q)
        best = sorted({(-round(float(u @ q), 9), i) for i, u in units if i != a and len(u) == len(q)})
        found[a] = [i for _, i in best[:k]]
    return found


def good_vector(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def batch(spark, rows, asked, k):
    vectors = spark.createDataFrame(rows, VECTOR)
    wanted = spark.createDataFrame([(i,) for i in asked], "vec_id long")
    found = {}
    for r in similar_by_embedding_batch(vectors, wanted, k).orderBy("vec_id", "rank").collect():
        found.setdefault(r["vec_id"], []).append(r["similar_id"])
    return found


def clustered(n, dim, clusters, noise, seed=5):
    random_ = np.random.default_rng(seed)
    centres = random_.normal(size=(clusters, dim))
    return [(i, (centres[i % clusters] + noise * random_.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [2048, 4])
def test_nearest_vectors_of_a_table(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rows = clustered(150, 6, 9, 0.2)
    copies = [(1000 + i, rows[3][1]) for i in range(25)] + [(2000 + i, [2 * x for x in rows[3][1]]) for i in range(3)]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 6), (3003, [float("nan")] * 6), (3004, [None] * 6)]
    odd += [(3005, [float("inf")] * 6), (None, rows[0][1]), (3006, [1e200] * 6), (3007, [1e-200] * 6)]
    rows = rows + copies + odd
    asked = [0, 3, 7, 8, 1010, 2001, 3000, 3002, 3006, 77, 77, 9999, None]
    assert batch(spark, rows, asked, 4) == nearest(rows, asked, 4)


def test_nearest_vectors_by_shuffle_joins(spark, shuffled):
    rows = clustered(60, 4, 5, 0.3)
    assert batch(spark, rows, range(0, 60, 7), 3) == nearest(rows, range(0, 60, 7), 3)


def test_nearest_vectors_of_several_lengths_and_of_few(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.2]), (3, [1.0]), (4, [1.0, 0.1, 0.0]), (5, [3.0]), (6, [0.0, 1.0, 1.0])]
    assert batch(spark, rows, range(1, 7), 5) == nearest(rows, range(1, 7), 5)
    assert batch(spark, rows[:1], [1], 5) == {} and batch(spark, [], [1], 5) == {}


def test_few_pairs_of_clustered_vectors_are_scored(spark, monkeypatch):
    rows = clustered(4000, 8, 40, 0.02)
    asked = range(0, 4000, 10)
    scored = []
    whole = similarity._scores

    def counted(tables, pairs, *kept):
        met = pairs.join(tables.data.groupBy("cell", "ring", "part").count(), ["cell", "ring", "part"])
        scored.append(met.agg(F.sum("count")).first()[0] or 0)
        return whole(tables, pairs, *kept)

    monkeypatch.setattr(similarity, "_scores", counted)
    assert batch(spark, rows, asked, 5) == nearest(rows, asked, 5)
    assert sum(scored) < 0.1 * len(asked) * len(rows)
    print("share of pairs scored", sum(scored) / (len(asked) * len(rows)))


def test_asked_vectors_meet_blocks_in_batches(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BATCH", 16)
    monkeypatch.setattr(similarity, "HELD", 100)
    rows = clustered(400, 6, 400, 0.0) + [(1000 + i, [1.0 * (j == i % 6) for j in range(6)]) for i in range(60)]
    asked = range(0, 400, 4)
    rounds = []
    whole = similarity._scores

    def counted(tables, pairs, *kept):
        found = whole(tables, pairs, *kept)
        rounds.append((found.count(), pairs.count()))
        return found

    monkeypatch.setattr(similarity, "_scores", counted)
    assert batch(spark, rows, asked, 4) == nearest(rows, asked, 4)
    # Pairs of vectors are not rows: each task gives the best few of each vector.
    assert all(found <= len(asked) * 5 * 5 for found, _ in rounds) and rounds[1][1] > 1000


@pytest.mark.parametrize("large", [False, True])
def test_terms_of_any_length_in_the_index(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr("wayfold.operators.joins.BROADCAST_BYTES", -1)
    monkeypatch.setattr(names, "BLOCK_BITS", 3)
    rng = random.Random(7)
    rows = [(i * 5, "".join(rng.choices("abÄ %_\\", k=rng.randint(0, 12))), rng.random()) for i in range(150)]
    rows += [(9000, None, 1.0), (9001, "aaaaaaaaaaaa", 0.0), (9002, "x" * 3000 + "end", 0.5)]
    products = spark.createDataFrame(rows, "product_id long, name string, popularity_global double")
    terms = {"".join(rng.choices("abä %", k=rng.randint(0, 6))) for _ in range(150)} | {"", "aaaa", "xxxx", "xend", "x" * 2000}
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {}
    for r in R.fuzzy_matches(asked, products, 3, literal=True).orderBy("term", "rank").collect():
        got.setdefault(r["term"], []).append(r["product_id"])
    expected = {}
    for term in terms:
        found = sorted((-p, i) for i, n, p in rows if n is not None and term.lower() in n.lower())
        if found:
            expected[term] = [i for _, i in found[:3]]
    assert got == expected and len(expected) > 40


def test_rare_pieces_lead_to_few_candidates(spark, monkeypatch):
    rows = [(i, f"red widget #{i}", 0.5) for i in range(2000)]
    products = spark.createDataFrame(rows, "product_id long, name string, popularity_global double")
    index = names.NameIndex.build(products)
    looked_up = []
    whole = names.lookup_join

    def counted(left, lookup, *args, **kwargs):
        if lookup is index.names:
            looked_up.append(left.count())
        return whole(left, lookup, *args, **kwargs)

    monkeypatch.setattr(names, "lookup_join", counted)
    asked = spark.createDataFrame([(f"Widget #{i}",) for i in range(100, 2000, 10)], "term string")
    assert R.fuzzy_matches(asked, index, 1).count() == 190
    # All names share most of a term's pieces; those it has of its own leave few names to compare.
    assert looked_up[0] < 190 * 25


def test_long_terms_read_few_hits(spark, monkeypatch):
    rows = [(i, f"red widget #{i}", 0.5) for i in range(2000)]
    products = spark.createDataFrame(rows, "product_id long, name string, popularity_global double")
    index = names.NameIndex.build(products)
    read = []
    whole = names.lookup_join

    def counted(left, lookup, *args, **kwargs):
        joined = whole(left, lookup, *args, **kwargs)
        if lookup is index.hits:
            read.append(joined.agg(F.sum(F.size("hits")).alias("n")).first()["n"])
        return joined

    monkeypatch.setattr(names, "lookup_join", counted)
    asked = spark.createDataFrame([(f"RED WIDGET #{i}",) for i in range(100, 2000)], "term string")
    found = {r["term"]: r["product_id"] for r in R.fuzzy_matches(asked, index, 1).collect()}
    assert found == {f"RED WIDGET #{i}": i for i in range(100, 2000)}
    # Pieces of three have some hundred hits each, so hits would grow as terms times names.
    assert read[0] < 1900 * 25


def test_terms_around_the_length_of_a_long_piece(spark):
    rng = random.Random(13)
    rows = [(i, "".join(rng.choices("abÄ%", k=rng.randint(5, 30))), rng.random()) for i in range(200)]
    products = spark.createDataFrame(rows, "product_id long, name string, popularity_global double")
    terms = set()
    for _, name, _ in rows:
        start = rng.randrange(len(name))
        terms.add(name[start : start + rng.randint(6, 18)].upper())
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {}
    for r in R.fuzzy_matches(asked, products, 3, literal=True).orderBy("term", "rank").collect():
        got.setdefault(r["term"], []).append(r["product_id"])
    expected = {t: [i for _, i in sorted((-p, i) for i, n, p in rows if t.lower() in n.lower())[:3]] for t in terms}
    assert got == expected


def test_edges_meet_the_ids_alone(spark, products, monkeypatch):
    # Between the size of the ids and that of the products with their columns.
    monkeypatch.setattr("wayfold.operators.joins.BROADCAST_BYTES", 2000)
    spread = []
    whole = R.lookup_join.__globals__["spread_join"]

    def counted(left, right, on, how="inner", hot=None):
        spread.append(how)
        return whole(left, right, on, how, hot)

    monkeypatch.setattr("wayfold.operators.joins.spread_join", counted)
    monkeypatch.setattr(R, "TASK_EDGES", 5)
    edges = [(a, b, a * b % 7 + 1) for a in range(1, 20) for b in range(a + 1, 20)] + [(1, 999, 50)]
    df = spark.createDataFrame(edges, "product_id_1 long, product_id_2 long, cooccurrence_count long")
    got = R.neighbors_topk(df, products, 3, symmetric=True).where("product_id_1 < 20").collect()
    assert "left_semi" not in spread
    both = [(a, b, n) for a, b, n in edges if b < 20] + [(b, a, n) for a, b, n in edges]
    expected = {a: [b for _, b in sorted((-n, b) for x, b, n in both if x == a)[:3]] for a in range(1, 20)}
    found = {}
    for r in sorted(got, key=lambda r: (r["product_id_1"], r["rank"])):
        found.setdefault(r["product_id_1"], []).append(r["product_id"])
    assert found == expected


def test_names_that_cannot_be_indexed_are_errors(spark):
    for row in [(1, "x" * (1 << names.POSITION_BITS), 0.1), (1 << names.ID_BITS, "x", 0.1), (-1, "x", 0.1)]:
        products = spark.createDataFrame([row], "product_id long, name string, popularity_global double")
        with pytest.raises(Exception, match="too long"):
            names.NameIndex.build(products)
