"""Product feature expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.text import snake, strip

# Store columns and the spellings which name them.
STORES = {
    "store_a": ("store a", "a", "store_a"),
    "store_b": ("store b", "b", "store_b"),
    "store_c": ("store c", "c", "store_c"),
}
# Upper bound and label of each age bucket.
AGE_BUCKETS = ((3, "0-3"), (7, "4-7"), (12, "8-12"), (16, "13-16"))
OLDEST_BUCKET = "17+"
FAMILY_AGE = 7
# Popularity phrases.
VERY_POPULAR, MODERATELY_POPULAR = 0.8, 0.4


def store_key(col: Column | str) -> Column:
    """Column name of a store given as 'Store A', 'A' or 'store_a'; NULL when unknown."""
    spelled = F.lower(strip(col))
    result = F.lit(None).cast("string")
    for key, names in STORES.items():
        result = F.when(spelled.isin(*names), F.lit(key)).otherwise(result)
    return result


def age_bucket(col: Column | str) -> Column:
    """Label of the age range a minimum age falls into."""
    age = F.col(col) if isinstance(col, str) else col
    (bound, label), *rest = AGE_BUCKETS
    chain = F.when(age <= bound, label)
    for bound, label in rest:
        chain = chain.when(age <= bound, label)
    return chain.otherwise(OLDEST_BUCKET)


def family_friendly(col: Column | str) -> Column:
    age = F.col(col) if isinstance(col, str) else col
    return (age <= FAMILY_AGE).cast("int")


def franchise_clean(col: Column | str) -> Column:
    return snake(col)


def text_blob(
    name: Column,
    segment: Column,
    category: Column,
    kind: Column,
    franchise: Column,
    min_age: Column,
    popularity: Column,
) -> Column:
    """Short description of a product; parts whose value is NULL or empty are left out."""

    def present(value: Column, *parts: Column) -> Column:
        return F.when(value != "", F.concat(*parts))

    return F.concat_ws(
        " ",
        present(
            name,
            name,
            F.lit(" is a "),
            F.lower(F.coalesce(segment, F.lit(""))),
            F.lit(" product."),
        ),
        present(category, F.lit("Category: "), category, F.lit(".")),
        present(kind, F.lit("Type: "), kind, F.lit(".")),
        present(franchise, F.lit("Franchise: "), franchise, F.lit(".")),
        F.concat(
            F.lit("Recommended minimum age: "), min_age.cast("string"), F.lit(".")
        ),
        F.when(popularity >= VERY_POPULAR, "This product is very popular.")
        .when(
            popularity >= MODERATELY_POPULAR, "This product has moderate popularity."
        )
        .otherwise("This product has lower popularity."),
    )
