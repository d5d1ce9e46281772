import itertools
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayfold.functions.product import age_bucket, store_key
from wayfold.operators import catalog as C
from wayfold.operators import cooccurrence as G
from wayfold.operators.ids import assign_ids
from wayfold.plans.etl import publish_catalog, stage_catalog
from wayfold.sources.catalog_files import read_catalog_json, read_matrix, read_matrix_cells
from wayfold.sources.tables import load_raw, read_catalog, write_catalog, write_raw

DOCUMENT = {
    "Console": [{"name": "Deck", "Store A": 20, "Store B": 15, "Store C": 15, "times_sold": 50}],
    "Games": [
        {
            "name": "Zoo Tale",
            "release_date": "2020-03-20",
            "Store A": 50,
            "Store B": 30,
            "Store C": None,
            "type": "Adventure",
            "category": "Game",
            "franchise": " Zoo World",
            "min_age": 3,
        },
        {"name": "Arc", "release_date": "soon", "times_sold": 10, "min_age": 12, "franchise": ""},
    ],
}


@pytest.fixture(scope="module")
def products(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "items.json"
    path.write_text(json.dumps(DOCUMENT))
    return C.build_products(read_catalog_json(spark, str(path)))


def test_products_from_a_document(products):
    rows = {r["name"]: r for r in products.collect()}
    assert {n: r["product_id"] for n, r in rows.items()} == {"Arc": 1, "Deck": 2, "Zoo Tale": 3}
    zoo, deck, arc = rows["Zoo Tale"], rows["Deck"], rows["Arc"]
    assert (zoo["times_sold"], zoo["store_c"], zoo["popularity_global"]) == (80, 0, 1.0)
    assert (deck["min_age"], deck["age_bucket"], deck["family_friendly"]) == (0, "0-3", 1)
    assert (deck["popularity_global"], deck["franchise"], deck["franchise_clean"]) == (0.625, None, "")
    assert zoo["franchise_clean"] == "zoo_world"
    assert (arc["release_date"], zoo["release_date"].year, arc["family_friendly"]) == (None, 2020, 0)
    assert deck["text_blob"] == (
        "Deck is a console product. Recommended minimum age: 0. "
        "This product has moderate popularity."
    )
    assert zoo["text_blob"] == (
        "Zoo Tale is a games product. Category: Game. Type: Adventure. Franchise:  Zoo World. "
        "Recommended minimum age: 3. This product is very popular."
    )
    assert (zoo["popularity_store_a"], arc["popularity_store_c"]) == (1.0, 0.0)


def test_no_sales_mean_no_popularity(spark):
    raw = spark.createDataFrame([("a",), (None,)], "name string")
    rows = C.build_products(raw).orderBy("product_id").collect()
    assert [(r["product_id"], r["name"], r["popularity_global"]) for r in rows] == [
        (1, "a", 0.0),
        (2, None, 0.0),
    ]
    assert "None" not in rows[1]["text_blob"]


def test_age_buckets_and_store_spellings(spark):
    ages = spark.createDataFrame([(a,) for a in (0, 3, 4, 7, 8, 12, 13, 16, 17)], "a int")
    got = [r[0] for r in ages.select(age_bucket("a")).collect()]
    assert got == ["0-3", "0-3", "4-7", "4-7", "8-12", "8-12", "13-16", "13-16", "17+"]
    spelled = [" Store A ", "b", "STORE_C", "Store D", None]
    stores = spark.createDataFrame([(s,) for s in spelled], "s string")
    got = [r[0] for r in stores.select(store_key("s")).collect()]
    assert got == ["store_a", "store_b", "store_c", None, None]


def test_ids_are_dense_with_one_very_common_name(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("name"),
        "id",
    ).repartition(7)
    numbered = assign_ids(df, [F.col("name").asc()], "n")
    rows = numbered.orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 5001))
    assert [r["name"] for r in rows] == sorted(r["name"] for r in rows)
    assert len({r["id"] for r in rows}) == 5000


def test_matrix_to_edges(spark, tmp_path):
    path = tmp_path / "matrix.csv"
    path.write_text("product,a,b,c\na,5,2,0\nb,2,1,\nc,0,3,x\n")
    cells = G.matrix_to_long(read_matrix(spark, str(path)))
    assert cells.count() == 7
    solo = {r["product_name"]: r["solo_sales"] for r in G.solo_sales(cells).collect()}
    assert solo == {"a": 5, "b": 1}
    both = {(r[0], r[1]): r[2] for r in G.undirected_edges(cells).collect()}
    assert both == {("a", "b"): 4, ("b", "c"): 3}
    upper = {(r[0], r[1]): r[2] for r in G.undirected_edges(cells, "upper").collect()}
    assert upper == {("a", "b"): 2, ("b", "c"): 3}


def test_matrix_by_rows_equals_matrix_by_columns(spark, tmp_path):
    path = tmp_path / "matrix.csv"
    path.write_text(',"a, b",c,"d ""x"""\n"a, b",5,2,0\n\nc,2,1,\n"d ""x""",0,3,x\nshort,7\n')
    got = sorted(tuple(r) for r in read_matrix_cells(spark, str(path)).collect())
    ab, d = "a, b", 'd "x"'
    assert got == sorted(
        [(ab, ab, 5), (ab, "c", 2), (ab, d, 0), ("c", ab, 2), ("c", "c", 1), (d, ab, 0), (d, "c", 3), ("short", ab, 7)]
    )
    wide = tmp_path / "wide.csv"
    names = [f"p{i}" for i in range(5000)]
    wide.write_text("\n".join([",".join(["product", *names]), *(f"p{i}," + "1," * 4999 + "2" for i in range(3))]))
    cells = read_matrix_cells(spark, str(wide))
    assert (cells.count(), cells.where("product_1 = 'p1' AND count = 2").first()["product_2"]) == (15000, "p4999")


def test_upper_triangle_of_unsorted_labels(spark, tmp_path):
    path = tmp_path / "matrix.csv"
    path.write_text("product,Zelda,Ari,Mo\nZelda,1,5,\nAri,,2,4\nMo,,,3\n")
    cells = G.matrix_to_long(read_matrix(spark, str(path)))
    expected = {("Ari", "Zelda"): 5, ("Ari", "Mo"): 4}
    for matrix in ("upper", "both"):
        assert {(r[0], r[1]): r[2] for r in G.undirected_edges(cells, matrix).collect()} == expected


def test_all_keys_of_a_document_are_columns(spark, tmp_path):
    path = tmp_path / "items.json"
    document = {
        "Games": [
            {"name": "x", "Esrb Rating": "E", "times_sold": "12", "tags": ["a", "b"]},
            {"name": "y", "players": 4, "min_age": "3+", "online": True},
            None,
        ]
    }
    path.write_text(json.dumps(document))
    rows = {r["name"]: r.asDict() for r in read_catalog_json(spark, str(path)).collect()}
    assert set(rows) == {"x", "y"}
    assert (rows["x"]["times_sold"], rows["x"]["esrb_rating"], rows["x"]["tags"]) == (12.0, "E", '["a","b"]')
    assert (rows["y"]["players"], rows["y"]["online"], rows["y"]["min_age"]) == ("4", "true", None)
    assert rows["y"]["esrb_rating"] is None and rows["x"]["store_a"] is None


@pytest.mark.parametrize(
    "text",
    ['{"Games":[{"name":"x"},{"na', "[1]", '{"Games":[{"name":"x"}]', '{"Games":"x"}', '{"Games":[3]}'],
)
def test_unreadable_documents_are_errors(spark, tmp_path, text):
    path = tmp_path / "items.json"
    path.write_text(text)
    with pytest.raises(Exception, match="unreadable"):
        read_catalog_json(spark, str(path)).collect()


@pytest.mark.parametrize("block", [1000, 4, 1])
def test_pairs_of_baskets(spark, block):
    rng = random.Random(block)
    lines = [(b, rng.randrange(12)) for b in range(30) for _ in range(rng.randrange(1, 9))]
    # One basket holds a third of all lines.
    lines += [(99, i) for i in range(12)] * 5 + [(None, 1), (1, None)]
    df = spark.createDataFrame(lines, "b int, i int")
    baskets = {}
    for b, i in lines:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    expected = Counter(
        pair for items in baskets.values() for pair in itertools.combinations(sorted(items), 2)
    )
    got = G.cooccurrence_from_baskets(df, "b", "i", block=block).collect()
    assert {(r[0], r[1]): r[2] for r in got} == dict(expected) and len(got) == len(expected)
    alone = Counter(min(items) for items in baskets.values() if len(items) == 1)
    assert {r[0]: r[1] for r in G.solo_from_baskets(df, "b", "i").collect()} == dict(alone)


@pytest.mark.parametrize("block", [1000, 3])
def test_pairs_are_made_by_tasks_of_few_lines(spark, monkeypatch, block):
    # All baskets share few groups, so each is counted by itself; tasks go by lines.
    monkeypatch.setattr(G, "BASKET_GROUPS", 2)
    monkeypatch.setattr(G, "TASK_LINES", 10)
    lines = [(b, (b * 7 + i * i) % 11) for b in range(40) for i in range(b % 6 + 1)]
    df = spark.createDataFrame(lines, "b int, i int")
    counts, tasks = G.partial_cooccurrence(df, "b", "i", block)
    assert tasks > 1
    baskets = {}
    for b, i in lines:
        baskets.setdefault(b, set()).add(i)
    expected = Counter(p for items in baskets.values() for p in itertools.combinations(sorted(items), 2))
    got = G.cooccurrence_from_baskets(df, "b", "i", block).collect()
    assert {(r[0], r[1]): r[2] for r in got} == dict(expected) and len(got) == len(expected)


def test_names_become_ids_and_features(spark):
    products = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "product_id long, name string")
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 5), ("a", "x", 7)], "product_1 string, product_2 string, count long")
    ided = G.edges_with_ids(edges, products)
    assert sorted(tuple(r) for r in ided.collect()) == [(1, 3, 2), (3, 4, 5)]
    solo = spark.createDataFrame([("b", 9), ("x", 1)], "product_name string, solo_sales long")
    assert [tuple(r) for r in G.solo_sales_with_ids(solo, products).collect()] == [(3, 9)]

    def features(**options):
        df = G.add_graph_features(products, ided, **options).orderBy("product_id")
        return [(r["num_neighbors"], r["total_cooccurrence"]) for r in df.collect()]

    assert features() == [(1, 2), (0, 0), (1, 5), (0, 0)]
    assert features(symmetric=True) == [(1, 2), (0, 0), (2, 7), (1, 5)]


def test_share_of_the_catalog(products):
    got = {r["segment"]: (r["products"], r["share"]) for r in C.catalog_share(products, "segment").collect()}
    assert got == {"Console": (1, 1 / 3), "Games": (2, 2 / 3)}


def test_published_versions_replace_each_other(spark, tmp_path):
    one = spark.range(3).withColumnRenamed("id", "product_id")
    root = str(tmp_path / "catalog")
    names = ("products", "product_solo_sales", "product_cooccurrence")
    write_catalog({n: one for n in names}, root)
    assert read_catalog(spark, root)["products"].count() == 3
    write_catalog({n: one.where("product_id > 0") for n in names}, root)
    assert {n: t.count() for n, t in read_catalog(spark, root).items()} == dict.fromkeys(names, 2)
    with pytest.raises(ValueError):
        write_catalog({"products": one}, root)
    raw = str(tmp_path / "raw")
    tables = {n: one for n in ("products_raw", "product_solo_sales_raw", "product_cooccurrence_raw")}
    write_raw(tables, raw)
    write_raw(tables, raw)
    assert load_raw(spark, raw)["products_raw"].count() == 3


def test_load_from_files_to_published_tables(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps(DOCUMENT))
    (tmp_path / "matrix.csv").write_text("p,Arc,Deck,Zoo Tale\nArc,4,1,0\nDeck,1,9,3\nZoo Tale,0,3,2\n")
    raw, root = str(tmp_path / "raw"), str(tmp_path / "final")
    stage_catalog(spark, str(tmp_path / "items.json"), str(tmp_path / "matrix.csv"), raw)
    publish_catalog(spark, raw, root)
    tables = read_catalog(spark, root)
    features = {
        r["name"]: (r["product_id"], r["num_neighbors"], r["total_cooccurrence"])
        for r in tables["products"].collect()
    }
    assert features == {"Arc": (1, 1, 2), "Deck": (2, 1, 6), "Zoo Tale": (3, 0, 0)}
    solo = {r["product_id"]: r["solo_sales"] for r in tables["product_solo_sales"].collect()}
    assert solo == {1: 4, 2: 9, 3: 2}
    edges = sorted(tuple(r) for r in tables["product_cooccurrence"].collect())
    assert edges == [(1, 2, 2), (2, 3, 6)]
