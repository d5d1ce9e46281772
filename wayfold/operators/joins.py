"""Equi-joins which hold when one key carries a large share of the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.plans.scratch import row_bytes, staged, staged_and_measured

# A side is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 64 << 20
# Keys tracked as possibly hot, and the share of the rows that makes one hot.
HOT_KEYS = 64
HOT_SHARE = 0.005


def measured_bytes(df: DataFrame) -> int:
    """Size of a stored table.

    Counting rows of a stored table reads footers only. When the count alone shows that the table
    is too large to broadcast, that lower bound is returned and the rows are not read.
    """
    least = 8 * df.count()
    if least > BROADCAST_BYTES:
        return least
    total = F.coalesce(F.sum(row_bytes(df)), F.lit(0))
    return df.agg(total.alias("bytes")).first()["bytes"]


@dataclass(frozen=True)
class Lookup:
    """A staged table with its key columns and measured size."""

    df: DataFrame
    keys: tuple[str, ...]
    bytes: int

    @classmethod
    def stage(cls, df: DataFrame, keys: list[str], label: str) -> Lookup:
        """Store a frame; its size is taken while writing."""
        table, _, size = staged_and_measured(df, label)
        return cls(table, tuple(keys), size)

    @classmethod
    def over(cls, table: DataFrame, keys: list[str]) -> Lookup:
        """Wrap a table which is already stored."""
        return cls(table, tuple(keys), measured_bytes(table))


def lookup_join(
    left: DataFrame,
    lookup: Lookup,
    on: list[str],
    how: str = "left",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` to a lookup on ``left[on] = lookup.keys``; adds the lookup's other columns.

    A small lookup is broadcast, so ``left`` is never shuffled. A larger one is joined by
    shuffle, with the hot keys of ``left`` spread over all partitions.
    """
    renamed = lookup.df.withColumnsRenamed(dict(zip(lookup.keys, on, strict=True)))
    if lookup.bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(renamed), on, how)
    if left.isStreaming:
        return left.join(renamed, on, how)
    return spread_join(left, renamed, on, how, hot)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join (inner, left or left_semi) that splits the hot keys of ``left``.

    Rows of a hot key get a salt from their content; the matching rows of ``right`` are repeated
    once per salt. Only hot keys pay for the repetition, and there are at most ``HOT_KEYS`` of
    them. Which keys count as hot changes the work layout, never the result. The salt depends on
    content only, so a task that runs again sends its rows where they went before; many copies of
    one row therefore share a salt and are left to adaptive skew handling. ``hot`` may be passed when
    it was found on a cheaper frame with the same keys.
    """
    salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(left, [on])[0] if hot is None else hot)
    own_salt = F.pmod(row_hash(left), F.lit(salts)).cast("int")
    every_salt = F.sequence(F.lit(0), F.lit(salts - 1))
    salted = (
        left.withColumn("_wf_key", key_hash(on))
        .join(hot, "_wf_key", "left")
        .withColumn("_wf_salt", F.when(F.col("_wf_hot"), own_salt).otherwise(0))
        .drop("_wf_key", "_wf_hot")
    )
    repeated = (
        right.withColumn("_wf_key", key_hash(on))
        .join(hot, "_wf_key", "left")
        .withColumn(
            "_wf_salt",
            F.explode(
                F.when(F.col("_wf_hot"), every_salt).otherwise(F.array(F.lit(0)))
            ),
        )
        .drop("_wf_key", "_wf_hot")
    )
    return salted.join(repeated, [*on, "_wf_salt"], how).drop("_wf_salt")


def hot_keys(df: DataFrame, groups: list[list[str]]) -> list[DataFrame]:
    """For each group of key columns, hashes of the keys holding a large share of ``df``.

    All groups are found in one pass with bounded sketches, nothing is shuffled by key, and each
    result has at most ``HOT_KEYS`` rows. They are stored, so joins using them do not repeat it.
    """
    names = [f"k{i}" for i in range(len(groups))]

    def sketch(name: str) -> Column:
        top = F.expr(f"approx_top_k({name}, {HOT_KEYS})")
        return F.transform(
            top,
            lambda t: F.struct(
                F.lit(name).alias("name"), t["item"].alias("_wf_key"), t["count"].alias("c")
            ),
        ).alias(name)

    found = staged(
        df.select([key_hash(on).alias(n) for n, on in zip(names, groups)])
        .agg(F.count(F.lit(1)).alias("n"), *[sketch(n) for n in names])
        .select("n", F.explode(F.concat(*names)).alias("t"))
        .where(F.col("t.c") >= F.col("n") * HOT_SHARE)
        .select("t.name", "t._wf_key", F.lit(True).alias("_wf_hot")),
        "hot-keys",
    )
    return [found.where(F.col("name") == n).select("_wf_key", "_wf_hot") for n in names]


def key_hash(on: list[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in on])


def row_hash(df: DataFrame) -> Column:
    """Hash of a row's content, stable when a lost task is run again."""
    columns = [
        F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)
    ]
    return F.xxhash64(*columns)
