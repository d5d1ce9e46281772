import unicodedata

import pytest

from wayfold.functions.text import is_empty, normalize_columns, normalize_name, snake


def fold(text):
    if not text:
        return ""
    plain = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in plain if unicodedata.category(c) != "Mn").strip()


TEXTS = [
    None,
    "",
    "   ",
    "São Pedro do Sul",
    "  VALADARES  ",
    " Açores ",
    "\x1cx y\x1f",
    "İstanbul",
    "ΟΔΥΣΣΕΥΣ",
    "élève",
    "각힣 가",
    "ொᬆ",
    "Ångström ﬁ ß",
    "Дом Ёлка",
    "\U00010400 \U0001d15e",
    "́",
]


def test_folding_follows_the_unicode_rules(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r["i"]: r["f"] for r in df.select("i", normalize_name("t").alias("f")).collect()}
    assert got == {i: fold(t) for i, t in enumerate(TEXTS)}


def test_folding_twice_changes_nothing(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    once = df.select(normalize_name("t").alias("f"))
    assert once.where(normalize_name("f") != once["f"]).count() == 0


def test_blankness(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t　",), ("a",), ("́",)], "t string")
    got = [r["e"] for r in df.select(is_empty("t").alias("e")).collect()]
    assert got == [True, True, True, False, False]
    numbers = spark.createDataFrame([(None,), (float("nan"),), (0.0,)], "t double")
    got = [r["e"] for r in numbers.select(is_empty("t", floating=True).alias("e")).collect()]
    assert got == [True, True, False]


def test_snake_case_and_column_names(spark):
    df = spark.createDataFrame([(" Super Hero ",), (None,)], "`Store A ` string")
    assert normalize_columns(df).columns == ["store_a"]
    assert [r[0] for r in df.select(snake("`Store A `")).collect()] == ["super_hero", ""]
    with pytest.raises(ValueError):
        normalize_columns(spark.createDataFrame([(1, 2)], "`a b` int, A_B int"))
