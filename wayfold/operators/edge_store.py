"""Co-purchase edges, degrees and solo sales kept up to date by signed changes of baskets.

The tables are stored in buckets of their first product. A change turns into signed counts; only buckets that a
changed product lies in are read, and only these are written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.cooccurrence import partial_cooccurrence, solo_from_baskets
from wayfold.plans.scratch import staged

BUCKETS = 64
# Rows of a task that sums or writes, so that none of them has to be put on disk.
TASK_ROWS = 1_000_000
EDGES, SOLO, DEGREES = "edges", "solo", "degrees"


def _bucket(item: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(buckets)).cast("int")


def _dealt(df: DataFrame, item: str, buckets: int, rows: int) -> DataFrame:
    """Rows with their ``bucket`` and ``slice`` of it, dealt by these to tasks of bounded size."""
    slices = -(-rows // (buckets * TASK_ROWS))
    cut = F.pmod(F.xxhash64(F.lit("slice"), item), F.lit(max(1, slices))).cast("int")
    keyed = df.withColumns({"bucket": _bucket(item, buckets), "slice": cut})
    return keyed.repartition(min(buckets, -(-rows // TASK_ROWS) or 1) * max(1, slices), "bucket", "slice")


def _write(df: DataFrame, root: str, name: str, item: str, buckets: int) -> None:
    """Replace the buckets that the rows of a stored table lie in."""
    _write_dealt(_dealt(df, item, buckets, df.count()), root, name)


def _write_dealt(df: DataFrame, root: str, name: str) -> None:
    (
        df.drop("slice")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(f"{root}/{name}")
    )


def create(lines: DataFrame, basket: str, item: str, root: str, buckets: int = BUCKETS) -> None:
    """Store edges, solo sales and degrees of all baskets."""
    counts, tasks = partial_cooccurrence(lines, basket, item)
    # Summed where they are written, so that edges are dealt once.
    _write_dealt(_summed(_dealt(counts, "item_1", buckets, tasks * TASK_ROWS), ["item_1", "item_2"], "count"), root, EDGES)
    edges = lines.sparkSession.read.schema(counts.schema).parquet(f"{root}/{EDGES}")
    _write(staged(solo_from_baskets(lines, basket, item), "new-solo"), root, SOLO, "item", buckets)
    _write(staged(_degrees(edges), "new-degrees"), root, DEGREES, "item", buckets)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the stored tables; rows that changes brought down to nothing are not in it."""
    df = spark.read.parquet(f"{root}/{name}").drop("bucket")
    return df.where(F.col(_counted(name)) > 0)


def _counted(name: str) -> str:
    return {EDGES: "count", SOLO: "solo_sales", DEGREES: "total_cooccurrence"}[name]


def _degrees(edges: DataFrame) -> DataFrame:
    """Neighbours and total count of each first product of an edge."""
    return edges.groupBy(F.col("item_1").alias("item")).agg(
        F.count(F.lit(1)).alias("num_neighbors"), F.sum("count").alias("total_cooccurrence")
    )


def apply_changes(
    spark: SparkSession,
    root: str,
    added: DataFrame,
    withdrawn: DataFrame,
    basket: str,
    item: str,
    buckets: int = BUCKETS,
) -> None:
    """Add the lines of new baskets and take out those of withdrawn ones, both whole baskets.

    A basket that changed is withdrawn as it was and added as it is. The result is that of building the
    tables again from the baskets there are now; taking out what was never added is an error. Edges are the last
    table to be written, so a change that broke off can be told by their not being as they should.
    """
    (more, tasks), (less, tasks_less) = (partial_cooccurrence(lines, basket, item) for lines in (added, withdrawn))
    edges = _signed(more, less, ["item_1", "item_2"], "count", tasks + tasks_less)
    edges = staged(edges, "edge-changes")
    solo = _signed(
        solo_from_baskets(added, basket, item), solo_from_baskets(withdrawn, basket, item), ["item"], "solo_sales"
    )
    solo = staged(solo, "solo-changes")
    # An edge that appears or goes changes the number of neighbours, so degrees are told from the edges' own change.
    before = _touched(spark, root, EDGES, edges, "item_1", buckets)
    rows = before.count() + edges.count()
    merged = staged(
        _merged(before, edges, ["item_1", "item_2"], "count", max(1, -(-rows // TASK_ROWS))), "merged-edges"
    )
    shift = merged.groupBy(F.col("item_1").alias("item")).agg(
        F.sum((F.col("count") > 0).cast("long") - (F.col("count") > F.col("change")).cast("long")).alias("neighbors"),
        F.sum("change").alias("change"),
    )
    shift = staged(shift.where("neighbors <> 0 or change <> 0"), "degree-changes")
    degrees = _merged(
        _touched(spark, root, DEGREES, shift, "item", buckets).drop("num_neighbors"),
        shift.drop("neighbors"),
        ["item"],
        "total_cooccurrence",
    )
    neighbors = _merged(
        _touched(spark, root, DEGREES, shift, "item", buckets).drop("total_cooccurrence"),
        shift.select("item", F.col("neighbors").alias("change")),
        ["item"],
        "num_neighbors",
    )
    degrees = degrees.drop("change").join(neighbors.drop("change"), "item")
    sold = _merged(_touched(spark, root, SOLO, solo, "item", buckets), solo, ["item"], "solo_sales")
    results = [
        (staged(degrees.select("item", "num_neighbors", "total_cooccurrence"), "new-degrees"), DEGREES, "item"),
        (staged(sold.drop("change"), "new-solo"), SOLO, "item"),
        (merged.drop("change"), EDGES, "item_1"),
    ]
    for df, name, key in results:
        _write(df, root, name, key, buckets)


def _summed(dealt: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Sums of what was dealt by bucket and slice of a key, without dealing it again."""
    return dealt.groupBy("bucket", "slice", *keys).agg(F.sum(count).alias(count))


def _signed(
    added: DataFrame, withdrawn: DataFrame, keys: list[str], count: str, tasks: int | None = None
) -> DataFrame:
    """``change`` of the count of each key that changes; added and withdrawn counts may be partial."""
    both = added.select(*keys, F.col(count).alias("change")).unionByName(
        withdrawn.select(*keys, (-F.col(count)).alias("change"))
    )
    if tasks:
        both = both.repartition(tasks, *keys)
    return both.groupBy(*keys).agg(F.sum("change").alias("change")).where("change <> 0")


def _touched(
    spark: SparkSession, root: str, name: str, changes: DataFrame, key: str, buckets: int
) -> DataFrame:
    """The stored rows of all buckets that a change lies in; other folders are not opened."""
    # As many rows as there are buckets at most.
    wanted = [r["b"] for r in changes.select(_bucket(key, buckets).alias("b")).distinct().collect()]
    return spark.read.parquet(f"{root}/{name}").where(F.col("bucket").isin(wanted)).drop("bucket")


def _merged(
    before: DataFrame, changes: DataFrame, keys: list[str], count: str, tasks: int | None = None
) -> DataFrame:
    """Counts after the change, with the change; keys that come down to nothing stay as 0."""
    both = before.withColumn("change", F.lit(0).cast("long")).unionByName(
        changes.withColumn(count, F.lit(0).cast("long"))
    )
    if tasks:
        both = both.repartition(tasks, *keys)
    summed = both.groupBy(*keys).agg(F.sum(count).alias("before"), F.sum("change").alias("change"))
    now = F.col("before") + F.col("change")
    short = F.raise_error(F.lit("a basket was withdrawn that is not in the tables")).cast("long")
    return summed.select(*keys, F.when(now < 0, short).otherwise(now).alias(count), "change")
