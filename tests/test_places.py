import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions.places import path_string, primary_state
from wayfold.operators import hierarchy as H
from wayfold.operators import matching as M
from wayfold.operators.typos import near_names, nearest_names
from wayfold.sources.json_tree import (
    load_gazetteer,
    read_gazetteer,
    read_hierarchy_json,
    write_gazetteer,
)


def node(level, **children):
    return {"admin_level": level, "children": children}


MINI = {
    "admin_level": 2,
    "children": {
        "Viseu": node(6, **{"São Pedro do Sul": node(7, Valadares=node(8), Pinho=node(8))}),
        "Porto": node(6, **{"Vila Nova de Gaia": node(7, Valadares=node(8))}),
        "Madeira": node(4, Funchal=node(7, **{"Santo António": node(8)}), Machico=node(7)),
        "Nowhere": {"children": {"Lost": node(8)}},
    },
}


def gazetteer(spark, folder, tree, root="portugal", **options):
    path = folder / "tree.json"
    text = tree if isinstance(tree, str) else json.dumps(tree, ensure_ascii=False, indent=1)
    path.write_text(text, encoding="utf-8")
    return load_gazetteer(spark, str(path), root, **options)


@pytest.fixture(scope="module")
def mini(spark, tmp_path_factory):
    return gazetteer(spark, tmp_path_factory.mktemp("mini"), MINI)


GOLDEN = [
    ("valadares", "viseu", "valadares", "porto", 2, 0),
    ("valadares", "viseu", "valadares", None, 8, 1),
    ("valadares", None, "valadares", "", 8, 1),
    ("lugar que nao existe", None, "valadares", "viseu", 2, 0),
    ("valadares", "viseu", "sao pedro do sul", "viseu", 7, 0),
    ("valadares", "viseu", "sao pedro do sul", None, 7, 0),
    ("valadares", None, "sao pedro do sul", "viseu", 7, 1),
    ("valadares", "sao pedro do sul", "pinho", "sao pedro do sul", 7, 0),
    ("valadares", "viseu", "valadares", "sao pedro do sul", 8, 0),
    ("VALADARES", "VISEU", "VALADARES", "PORTO", 2, 0),
    ("funchal", "madeira", "machico", "madeira", 4, 0),
    ("valadares", "lisboa", "valadares", "viseu", 8, 1),
    ("  ", "viseu", "valadares", "viseu", 2, 0),
    (" Santo Antonio", "MADEIRA ", "santo antónio", "funchal", 8, 0),
]


def golden_pairs(spark):
    rows = [(i, *r[:4]) for i, r in enumerate(GOLDEN)]
    return spark.createDataFrame(
        rows, "id_1 int, city_1 string, state_1 string, city_2 string, state_2 string"
    )


def scores(df):
    return {r["id_1"]: (r["expected_level"], r["is_ambiguous"]) for r in df.collect()}


def test_golden_pairs(spark, mini):
    got = scores(M.match_levels(golden_pairs(spark), mini))
    assert got == {i: r[4:] for i, r in enumerate(GOLDEN)}


def test_a_stored_gazetteer_gives_the_same(spark, mini, tmp_path):
    write_gazetteer(mini, str(tmp_path / "gaz"))
    again = read_gazetteer(spark, str(tmp_path / "gaz"))
    got = scores(M.match_levels(golden_pairs(spark), again))
    assert got == {i: r[4:] for i, r in enumerate(GOLDEN)}


def test_golden_pairs_without_broadcast(spark, mini, shuffled):
    got = scores(M.match_levels(golden_pairs(spark), mini))
    assert got == {i: r[4:] for i, r in enumerate(GOLDEN)}


def test_tree_is_read_in_document_order(spark, mini):
    rows = mini.nodes.orderBy("path").collect()
    assert [r["id"] for r in rows] == list(range(12))
    assert [r["name"] for r in rows][:5] == [
        "portugal",
        "viseu",
        "sao pedro do sul",
        "valadares",
        "pinho",
    ]
    assert "lost" not in {r["name"] for r in rows}
    assert rows[2]["original_name"] == "São Pedro do Sul"
    texts = {r["id"]: r["p"] for r in mini.nodes.select("id", path_string("ancestors").alias("p")).collect()}
    assert texts[3] == "valadares > sao pedro do sul > viseu > portugal"


def test_repeated_names_levels_and_states(spark, tmp_path):
    text = """{"admin_level": 0, "children": {
        "b": {"admin_level": 7, "children": {"x": {"admin_level": 8}}},
        "a": {"admin_level": 3},
        "b": {"admin_level": 7, "children": {"y": {"admin_level": 8}, "": {"admin_level": 9, "name": "z"}}}}}"""
    gaz = gazetteer(spark, tmp_path, text, root="r")
    rows = gaz.nodes.orderBy("path").select(
        "name", "admin_level", primary_state("ancestors").alias("state")
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("r", 0, None),
        ("b", 7, "b"),
        ("y", 8, "b"),
        ("z", 9, "b"),
        ("a", 3, None),
    ]


def test_statistics_children_names_and_containment(spark, mini):
    totals = H.hierarchy_totals(mini.nodes).first()
    # 23 proper ancestors in all; both Valadares lie below the root.
    assert tuple(totals) == (12, 11, 22)
    levels = {r[0]: r[1] for r in H.level_histogram(mini.nodes).collect()}
    assert levels == {2: 1, 4: 1, 6: 2, 7: 4, 8: 4}
    assert {r["id"]: r["children"] for r in H.children_counts(mini.nodes).collect()}[2] == 2
    assert [r["id"] for r in H.locations_named(mini.nodes, "Valadares").collect()] == [3, 7]
    inside = H.containment_pairs(mini.nodes, "valadares", "São Pedro do Sul").collect()
    assert [(r["inner_id"], r["outer_id"]) for r in inside] == [(3, 2)]


def test_wrong_state_can_be_strict(spark, mini):
    pairs = spark.createDataFrame(
        [(0, "valadares", "lisboa", "valadares", "viseu")],
        "id_1 int, city_1 string, state_1 string, city_2 string, state_2 string",
    )
    assert scores(M.match_levels(pairs, mini, strict_state=True)) == {0: (2, 0)}


def test_absent_state_columns_and_other_columns(spark, mini):
    pairs = spark.createDataFrame(
        [(0, "pinho", "pinho", "kept", 77, 5)] * 2,
        "id_1 int, city_1 string, city_2 string, n_1 string, expected_level int, _city int",
    )
    for mode in ("first", "best"):
        result = M.match_levels(pairs, mini, mode)
        assert result.columns == [
            "id_1", "city_1", "city_2", "n_1", "_city", "expected_level", "is_ambiguous"
        ]
        assert [tuple(r) for r in result.collect()] == [
            (0, "pinho", "pinho", "kept", 5, 8, 0)
        ] * 2


def test_any_column_can_hold_the_names(spark, mini):
    df = spark.createDataFrame([("Valadares", "PORTO", 3)], "`Place Name` string, `1st` string, x int")
    row = M.resolve(df, mini, "Place Name", "1st").first()
    assert (row["n"], row["first"]["id"], row["x"]) == (1, 7, 3)


def test_typos_are_corrected_wherever_they_are(spark, mini):
    rows = [
        (0, "xaladares", "viseu"),
        (1, "valadare", "porto"),
        (2, "vvaladares", None),
        (3, "funhcal", None),
        (4, "pinho", None),
        (5, None, None),
    ]
    df = spark.createDataFrame(rows, "i int, city string, state string")
    one = {r["i"]: (r["corrected_city"], r["n"]) for r in M.resolve_fuzzy(df, mini).collect()}
    assert one == {
        0: ("valadares", 1),
        1: ("valadares", 1),
        2: ("valadares", 2),
        3: (None, 0),
        4: (None, 1),
        5: (None, 0),
    }
    two = {r["i"]: r["corrected_city"] for r in M.resolve_fuzzy(df, mini, max_distance=2).collect()}
    assert two[3] == "funchal"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("limit", [0, 1, 2, 4])
def test_all_near_names_within_their_scope(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice("xy"), "".join(rng.choices("abé", k=rng.randint(0, 14)))) for _ in range(160)]
    asked, known = rows[::2] + [("x", None), (None, "ab")], rows[1::2] + [("y", None), (None, "ab")]
    got = near_names(
        spark.createDataFrame(asked, "land string, name string"),
        spark.createDataFrame(known, "land string, name string"),
        limit,
        ["land"],
    ).collect()
    expected = {
        (k, a, b, distance(a, b))
        for k, a in asked
        for q, b in known
        if k == q and None not in (k, a, b) and distance(a, b) <= limit
    }
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


@pytest.mark.parametrize("large", [False, True])
def test_city_and_state_are_corrected_together(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr("wayfold.operators.joins.BROADCAST_BYTES", -1)
    rows = [
        (0, None, 0, "Land", 2, "A"), (1, 0, 0, "Norte", 4, "A"), (2, 0, 1, "Sorte", 4, "A"),
        (3, 1, 0, "Porto", 8, "A"), (4, 2, 0, "Porta", 8, "A"), (5, 2, 1, "Braga", 8, "A"),
        (6, None, 1, "Other", 2, "B"), (7, 6, 0, "Norte", 4, "B"), (8, 7, 0, "Porty", 8, "B"),
    ]
    nodes = spark.createDataFrame(
        rows, "id long, parent_id long, position int, name string, admin_level int, country string"
    )
    gaz = H.build_gazetteer(H.build_hierarchy(nodes))
    asked = [
        (0, "Porto", "Norte", "a"),  # known
        (1, "Portx", "Xorte", "A"),  # two pairs at one distance: the first by city
        (2, "Porto", "Sorta", "A"),  # the pair is nearer than the known city alone
        (3, "Brago", "elsewhere", "A"),  # no pair: the city alone
        (4, "Portx", "Norte", "B"),  # within its own country
        (5, "Portx", None, "A"),  # no state: nothing to correct it with
        (6, None, "Norte", "A"),
        (7, "Porto", "Norte", "C"),
        (8, "zzzzz", "Norte", "A"),
    ]
    df = spark.createDataFrame(
        [(*r, "kept") for r in asked], "i int, city string, state string, land string, _wf_city_code string"
    )
    found = M.resolve_fuzzy(df, gaz, max_distance=1, country="land", correct_state=True)
    assert found.columns[:5] == df.columns
    got = {r["i"]: (r["corrected_city"], r["corrected_state"], r["n"], r["first"] and r["first"]["id"]) for r in found.collect()}
    assert got == {
        0: (None, None, 1, 3),
        1: ("porta", "sorte", 1, 4),
        2: ("porta", "sorte", 1, 4),
        3: ("braga", None, 1, 5),
        4: ("porty", None, 1, 8),
        5: ("porta", None, 1, 4),
        6: (None, None, 0, None),
        7: (None, None, 0, None),
        8: (None, None, 0, None),
    }


def test_parts_find_every_near_name(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(120)})
    unknown, known = words[::2], words[1::2]

    for limit in (1, 2, 3):
        expected = {}
        for u in unknown:
            best = min((distance(u, k), k) for k in known)
            if best[0] <= limit:
                expected[u] = best[1]
        got = nearest_names(
            spark.createDataFrame([(u,) for u in unknown], "name string"),
            spark.createDataFrame([(k,) for k in known], "name string"),
            limit,
        )
        assert {r["name"]: r["nearest"] for r in got.collect()} == expected


# Random trees against a direct evaluation of the rules


def random_tree(rng, size):
    """(id, parent, position, name, level) in preorder; few names, levels in no order."""
    children = {0: []}
    for i in range(1, size):
        parent = rng.randrange(i)
        children[parent].append(i)
        children[i] = []
    rows, number = [], itertools.count()

    def walk(key, parent, position):
        own = next(number)
        rows.append((own, parent, position, rng.choice("abcdef"), rng.randrange(10)))
        for place, child in enumerate(children[key]):
            walk(child, own, place)

    walk(0, None, 0)
    return rows


class Direct:
    def __init__(self, rows):
        self.level = {r[0]: r[4] for r in rows}
        self.name = {r[0]: r[3] for r in rows}
        parent = {r[0]: r[1] for r in rows}
        self.chain = {}
        for key in parent:
            chain, up = [], key
            while up is not None:
                chain.append(up)
                up = parent[up]
            self.chain[key] = chain

    def resolve(self, city, state):
        named = [k for k in sorted(self.name) if self.name[k] == city]
        if state:
            below = [k for k in named if state in [self.name[a] for a in self.chain[k][1:]]]
            return below or named
        return named

    def shared(self, a, b):
        if a == b or a in self.chain[b]:
            return self.level[a]
        if b in self.chain[a]:
            return self.level[b]
        common = set(self.chain[a]) & set(self.chain[b])
        return max([2, *[self.level[c] for c in common]])

    def score(self, one, two, best):
        left, right = self.resolve(*one), self.resolve(*two)
        flag = int(len(left) > 1 or len(right) > 1)
        if not left or not right:
            return 2, flag
        if best:
            return max(self.shared(a, b) for a in left for b in right), flag
        return self.shared(left[0], right[0]), flag


@pytest.mark.parametrize("seed", [1])
def test_random_trees_follow_the_rules(spark, seed):
    rng = random.Random(seed)
    rows = random_tree(rng, 60)
    direct = Direct(rows)
    nodes = spark.createDataFrame(
        rows, "id long, parent_id long, position int, name string, admin_level int"
    )
    gaz = H.build_gazetteer(H.build_hierarchy(nodes))
    keys = [(c, s) for c in "abcdefg" for s in (*"abcdefg", None)]
    asked = [(i, *one, *two) for i, (one, two) in enumerate(itertools.product(keys, keys))]
    pairs = spark.createDataFrame(
        asked, "id_1 int, city_1 string, state_1 string, city_2 string, state_2 string"
    )
    first = scores(M.match_levels(pairs, gaz))
    best = scores(M.match_levels(pairs, gaz, mode="best"))
    for i, c1, s1, c2, s2 in asked:
        assert first[i] == direct.score((c1, s1), (c2, s2), False), (c1, s1, c2, s2)
        assert best[i] == direct.score((c1, s1), (c2, s2), True), (c1, s1, c2, s2)
    swapped = pairs.select(
        "id_1",
        F.col("city_2").alias("city_1"),
        F.col("state_2").alias("state_1"),
        F.col("city_1").alias("city_2"),
        F.col("state_1").alias("state_2"),
    )
    assert scores(M.match_levels(swapped, gaz, mode="best")) == best


def test_best_without_broadcast(spark, shuffled):
    rows = random_tree(random.Random(3), 30)
    direct = Direct(rows)
    nodes = spark.createDataFrame(
        rows, "id long, parent_id long, position int, name string, admin_level int"
    )
    gaz = H.build_gazetteer(H.build_hierarchy(nodes))
    asked = [(i, a, None, b, s) for i, (a, b, s) in enumerate(itertools.product("abc", "abc", "ab"))]
    pairs = spark.createDataFrame(
        asked, "id_1 int, city_1 string, state_1 string, city_2 string, state_2 string"
    )
    got = scores(M.match_levels(pairs, gaz, mode="best"))
    assert got == {i: direct.score((a, s), (b, t), True) for i, a, s, b, t in asked}


def test_countries_are_looked_up_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(node(2, North=node(6, Town=node(8)))))
    (tmp_path / "b.json").write_text(json.dumps(node(2, South=node(6, Town=node(8), Village=node(8)))))
    nodes = read_hierarchy_json(
        spark, str(tmp_path), {"a.json": "Aland", "b.json": "Bland"}, with_country=True
    )
    gaz = H.build_gazetteer(H.build_hierarchy(nodes))
    rows = [
        (0, "town", "aland", "town", "bland"),
        (1, "town", "bland", "village", "BLAND"),
        (2, "village", "aland", "village", "bland"),
    ]
    pairs = spark.createDataFrame(
        rows, "id_1 int, city_1 string, country_1 string, city_2 string, country_2 string"
    )
    for mode in ("first", "best"):
        result = M.match_levels(pairs, gaz, mode, country=("country_1", "country_2"))
        assert scores(result) == {0: (2, 0), 1: (6, 0), 2: (2, 0)}
    with pytest.raises(ValueError):
        M.match_levels(pairs, gaz)


@pytest.mark.parametrize(
    "text",
    [
        '{"admin_level": 2, "children": {"a": {"admin_level": 4',
        '{"admin_level": "four"}',
        '{"admin_level": 2, "children": {"a": 7}}',
        '{"admin_level": 2, "children": [1]}',
        "no tree",
    ],
)
def test_unreadable_trees_are_errors(spark, tmp_path, text):
    path = tmp_path / "tree.json"
    path.write_text(text)
    with pytest.raises(Exception, match="unreadable"):
        read_hierarchy_json(spark, str(path), "root").collect()


def test_a_level_may_be_text(spark, tmp_path):
    path = tmp_path / "tree.json"
    path.write_text('{"admin_level": "2", "children": {"a": {"admin_level": 4.0, "children": null}}}')
    rows = read_hierarchy_json(spark, str(path), "root").orderBy("id").collect()
    assert [(r["name"], r["admin_level"]) for r in rows] == [("root", 2), ("a", 4)]


NODES = "id long, parent_id long, position int, name string, admin_level int"


def test_chains_of_any_depth(spark):
    depth = 70
    rows = [(i, i - 1 if i else None, 0, f"n{i}", i) for i in range(depth)]
    tree = H.build_hierarchy(spark.createDataFrame(rows, NODES))
    chains = {r["id"]: [a["id"] for a in r["ancestors"]] for r in tree.collect()}
    assert chains == {i: list(range(i, -1, -1)) for i in range(depth)}
    empty = H.build_hierarchy(spark.createDataFrame([], NODES))
    assert empty.count() == 0 and empty.columns == tree.columns


@pytest.mark.parametrize(
    "rows, message",
    [
        ([(1, None, 0, "a", 2), (2, 9, 0, "b", 4)], "absent"),
        ([(1, None, 0, "a", 2), (2, 4, 0, "b", 4), (3, 2, 0, "c", 6), (4, 3, 0, "d", 8)], "its own ancestor"),
        ([(1, 1, 0, "a", 2)], "its own ancestor"),
    ],
)
def test_broken_node_tables_are_errors(spark, rows, message):
    with pytest.raises(Exception, match=message):
        H.build_hierarchy(spark.createDataFrame(rows, NODES)).collect()
