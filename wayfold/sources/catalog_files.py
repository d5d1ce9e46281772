"""Read product documents and co-purchase matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.text import normalize_columns
from wayfold.operators.catalog import ensure_columns
from wayfold.operators.joins import Lookup, lookup_join
from wayfold.plans.scratch import staged

# Item keys of the product documents.
ITEM_SCHEMA = (
    "name STRING, release_date STRING, times_sold DOUBLE, `Store A` DOUBLE, `Store B` DOUBLE, "
    "`Store C` DOUBLE, type STRING, category STRING, franchise STRING, min_age DOUBLE"
)


def read_catalog_json(
    spark: SparkSession,
    path: str,
    item_schema: str = ITEM_SCHEMA,
    wholetext: bool = True,
) -> DataFrame:
    """Items of ``{segment: [item, ...]}`` documents, one row each, with their segment.

    A file is one document, or with ``wholetext=False`` one document per line, which lets large
    files be split. Columns are the union of the items' keys: those of ``item_schema`` with its types
    (a number may be written as text), all others as text, nested values as JSON text. Column names
    are normalised, keys an item lacks read as NULL, unreadable dates become NULL and the store columns
    are always there. A document that is not such an object is an error when the items are read; blank
    lines are skipped.
    """
    text = F.col("value")
    segments = F.from_json(text, "MAP<STRING, ARRAY<STRING>>")
    # A document cut short still parses to what stands before the cut.
    broken = (
        segments.isNull()
        | F.json_object_keys(text).isNull()
        | F.exists(F.map_values(segments), lambda items: items.isNull())
    )
    documents = (
        spark.read.text(path, wholetext=wholetext)
        .where(F.trim(F.translate("value", "\r\n\t", "   ")) != "")
        .select(_checked(segments, broken, "document").alias("segments"))
    )
    item = F.col("item")
    fields = F.from_json(item, "MAP<STRING, STRING>")
    items = staged(
        documents.select(F.explode("segments").alias("segment", "items"))
        .select("segment", F.explode("items").alias("item"))
        .where(item.isNotNull())
        .select("segment", _checked(fields, fields.isNull(), "item").alias("fields")),
        "catalog-items",
    )
    known = dict(f.rsplit(" ", 1) for f in item_schema.split(", "))
    known = {name.strip("`"): kind for name, kind in known.items()}
    # As many rows as there are different keys; they become the columns.
    present = items.select(F.explode(F.map_keys("fields")).alias("key")).distinct().orderBy("key")
    extra = [row["key"] for row in present.collect() if row["key"] not in (*known, "segment")]
    typed = [
        F.try_element_at("fields", F.lit(name)).try_cast(kind).alias(name)
        for name, kind in known.items()
    ]
    others = [F.try_element_at("fields", F.lit(name)).alias(name) for name in extra]
    df = normalize_columns(items.select("segment", *typed, *others))
    if "release_date" in df.columns:
        df = df.withColumn("release_date", F.try_to_timestamp("release_date"))
    stores = {f"store_{s}": "double" for s in "abc"}
    return ensure_columns(df, stores)


def _checked(value: Column, broken: Column, what: str) -> Column:
    """``value``, or an error that shows the start of the text where it is ``broken``."""
    start = F.substring("value" if what == "document" else "item", 1, 80)
    message = F.concat(F.lit(f"unreadable {what}: "), start)
    return F.when(broken, F.raise_error(message)).otherwise(value)


# A cell after its comma: quoted, with quotes inside doubled, or bare.
_CELL = r',("(?:[^"]|"")*"|[^,"]*)'


def read_matrix_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a matrix in one CSV file as ``product_1, product_2, count``, row by row.

    The first line holds the column labels, the first cell of every other line its row label. Cells
    which are empty or no number are left out. Columns are numbered and met with their labels by
    position, so neither plan nor schema grows with the number of products.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    head = lines.limit(1)
    found = F.regexp_extract_all(F.concat(F.lit(","), "value"), F.lit(_CELL), 1)
    labels = Lookup.stage(
        head.select(F.posexplode(found).alias("position", "cell")).select(
            "position", _unquoted("cell").alias("product_2")
        ),
        ["position"],
        "matrix-labels",
    )
    cells = (
        lines.where(F.col("value") != head.scalar())
        .select(found.alias("cells"))
        .select(_unquoted(F.get("cells", F.lit(0))).alias("product_1"), F.posexplode("cells"))
        .where(F.col("pos") > 0)
        .select(
            "product_1",
            F.col("pos").alias("position"),
            _unquoted("col").try_cast("double").alias("count"),
        )
        .where(F.col("count").isNotNull())
    )
    return lookup_join(cells, labels, ["position"], "inner").select(
        "product_1", "product_2", "count"
    )


def _unquoted(cell: Column | str) -> Column:
    """The text of a cell; NULL when it is empty."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.when(cell.startswith('"'), inner).when(cell != "", cell)


def read_matrix(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """A wide matrix: the first column holds the row labels, the header the column labels.

    CSV cells are read as numbers, empty cells as NULL.
    """
    if format != "csv":
        return spark.read.format(format).load(path)
    raw = spark.read.option("header", True).csv(path)
    label, *cells = raw.columns
    return raw.select(
        F.col(f"`{label}`"),
        *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in cells],
    )
