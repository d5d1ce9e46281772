"""Positional index of product names: the names that contain a text, found without reading the names.

Names are cut into pieces of three and of eight characters once, when the catalog is built. Each piece has its hits,
product and position in one number, in lists of bounded size. A text of three characters or more is looked up by the
two rarest of the longest pieces it has; hits of both at the right distance from each other are candidates, and only
these are held against the text. Shorter texts are pieces themselves. The hits of a piece of three grow with the catalog, so many
long texts looked up by such pieces would read as many hits as texts times names; those of eight stay few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.joins import Lookup, lookup_join
from wayfold.plans.scratch import staged

PIECE = 3
# Texts of so many characters are looked up by pieces as long.
LONG_PIECE = 8
# A hit is the product id, moved left by so many bits, plus the position.
POSITION_BITS = 20
ID_BITS = 63 - POSITION_BITS
# Products whose hits of one piece share a list: those whose ids differ in the last so many bits only.
BLOCK_BITS = 14
# Names of the index tables beside the catalog's.
INDEX_TABLES = ("product_names", "product_name_hits", "product_name_pieces")


@dataclass(frozen=True)
class NameIndex:
    """Names with their popularity, lists of hits by piece and block, and the number of hits of each piece."""

    names: Lookup
    hits: Lookup
    pieces: Lookup

    @classmethod
    def build(cls, products: DataFrame) -> NameIndex:
        """Index a stored product table; products without a name are in no list."""
        names = Lookup.stage(name_table(products), ["product_id"], "names")
        # Names of one block in one task, where all their lists are made; tasks follow the number of names.
        tasks = max(_shuffle_partitions(products), names.df.count() >> BLOCK_BITS)
        dealt = names.df.withColumn("block", _block()).repartition(tasks, "block")
        hits = Lookup.stage(hit_lists(dealt), ["piece"], "name-hits")
        counts = hits.df.groupBy("piece").agg(F.sum(F.size("hits")).alias("n"))
        return cls(names, hits, Lookup.stage(counts, ["piece"], "name-pieces"))

    def tables(self) -> dict[str, DataFrame]:
        return dict(zip(INDEX_TABLES, (self.names.df, self.hits.df, self.pieces.df)))

    @classmethod
    def over(cls, tables: dict[str, DataFrame]) -> NameIndex:
        """An index whose tables are stored already."""
        names, hits, pieces = (tables[name] for name in INDEX_TABLES)
        return cls(
            Lookup.over(names, ["product_id"]),
            Lookup.over(hits, ["piece"]),
            Lookup.over(pieces, ["piece"]),
        )


def name_table(products: DataFrame) -> DataFrame:
    """``product_id, popularity_global`` and the lower-cased name."""
    folded = F.lower("name")
    too_large = (F.char_length(folded) >= 1 << POSITION_BITS) | ~F.col("product_id").between(0, (1 << ID_BITS) - 1)
    checked = F.when(too_large, F.raise_error(F.lit("an id or a name is too long to be indexed"))).otherwise(folded)
    return products.where(F.col("name").isNotNull()).select(
        "product_id", "popularity_global", checked.alias("folded")
    )


def hit_lists(names: DataFrame) -> DataFrame:
    """``piece, block`` and ``hits``, ascending.

    Pieces of three and of eight characters have a hit for each position, shorter ones (the empty one too) one for each
    name, at position 0.
    """
    name = F.col("folded")

    def cut(size: int) -> Column:
        last = F.char_length(name) - size
        places = F.sequence(F.lit(0), last)
        found = F.transform(places, lambda i: F.substr(name, i + 1, F.lit(size)))
        if size < PIECE:
            found = F.array_distinct(found)
            pairs = F.transform(found, lambda p: F.struct(p.alias("piece"), F.lit(0).alias("at")))
        else:
            pairs = F.transform(found, lambda p, i: F.struct(p.alias("piece"), i.alias("at")))
        return F.when(last >= 0, pairs).otherwise(F.array().cast("array<struct<piece:string,at:int>>"))

    whole = F.concat(
        F.array(F.struct(F.lit("").alias("piece"), F.lit(0).alias("at"))),
        *[cut(size) for size in [*range(1, PIECE + 1), LONG_PIECE]],
    )
    # Names that were dealt by their block are not dealt again.
    blocks = names if "block" in names.columns else names.withColumn("block", _block())
    rows = blocks.select("product_id", "block", F.explode(whole).alias("p"))
    hit = F.shiftleft("product_id", POSITION_BITS) + F.col("p.at")
    return (
        rows.select(F.col("p.piece").alias("piece"), "block", hit.alias("hit"))
        .groupBy("piece", "block")
        .agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    )


def _block() -> Column:
    return F.shiftright("product_id", BLOCK_BITS)


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _pieces_of(text: Column) -> Column:
    """Offset and piece of every part of a text that is looked up."""

    def each(size: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.char_length(text) - size),
            lambda i: F.struct(i.alias("offset"), F.substr(text, i + 1, F.lit(size)).alias("piece")),
        )

    alone = F.array(F.struct(F.lit(0).alias("offset"), text.alias("piece")))
    length = F.char_length(text)
    return F.when(length >= LONG_PIECE, each(LONG_PIECE)).when(length >= PIECE, each(PIECE)).otherwise(alone)


def containing(texts: DataFrame, index: NameIndex) -> DataFrame:
    """``text, product_id, popularity_global`` and ``folded`` of the names that contain each distinct ``text``.

    A text with a piece that no name has is dropped at once. Of the others, the two rarest pieces are looked
    up and their hits moved back by the pieces' offsets: equal numbers are places where the text can begin.
    """
    asked = texts.select("text", F.explode(_pieces_of(F.col("text"))).alias("p"))
    asked = asked.select("text", "p.offset", "p.piece")
    counted = lookup_join(asked, index.pieces, ["piece"])
    rarest = F.slice(F.sort_array(F.collect_set(F.struct("n", "piece", "offset"))), 1, 2)
    chosen = (
        counted.groupBy("text")
        .agg(F.count("n").alias("known"), F.count(F.lit(1)).alias("all"), rarest.alias("rarest"))
        .where("known = all")
        .select("text", F.size("rarest").alias("wanted"), F.explode("rarest").alias("r"))
        .select("text", "wanted", "r.piece", "r.offset")
    )
    mask = (1 << POSITION_BITS) - 1
    inside = F.filter("hits", lambda h: h.bitwiseAND(F.lit(mask)) >= F.col("offset"))
    starts = F.transform(inside, lambda h: h - F.col("offset"))
    found = (
        lookup_join(chosen, index.hits, ["piece"], "inner")
        .select("text", "block", "wanted", starts.alias("starts"))
        .groupBy("text", "block", "wanted")
        .agg(F.collect_list("starts").alias("lists"))
        .where("size(lists) = wanted")
    )
    both = F.when(
        F.size("lists") > 1, F.array_intersect(F.col("lists")[0], F.col("lists")[1])
    ).otherwise(F.col("lists")[0])
    ids = F.array_distinct(F.transform(both, lambda h: F.shiftright(h, POSITION_BITS)))
    candidates = found.select("text", F.explode(ids).alias("product_id"))
    named = lookup_join(candidates, index.names, ["product_id"], "inner")
    return named.where(F.contains("folded", "text"))


def matches(
    terms: DataFrame, index: NameIndex, literal: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Stored distinct ``term, text`` of the terms, and ``text, product_id, popularity_global`` of what they match.

    ``%`` and ``_`` work as wildcards unless ``literal``, and a backslash before one of them, or before another
    backslash, takes it as it stands. A term with wildcards is looked up by its longest literal part
    and the names found are held against the whole; without any literal part all names are.
    """
    asked = staged(
        terms.where(F.col("term").isNotNull()).select("term", F.lower("term").alias("text")).distinct(),
        "terms",
    )
    text = F.col("text")
    wild = F.lit(False) if literal else text.rlike(r"[%_\\]")
    parts = F.split(text, r"\\.|[%_\\]")
    longest = F.element_at(F.array_sort(F.transform(parts, _with_length)), -1)["part"]
    # A backslash that escapes nothing stands for itself.
    lone = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\(?=[^%_\\]|$)", r"$1\\\\")
    texts = asked.select("text").distinct().select(
        F.when(wild, longest).otherwise(text).alias("piece"),
        F.struct(
            "text", F.when(wild, F.concat(F.lit("%"), lone, F.lit("%"))).alias("pattern")
        ).alias("of"),
    )
    found = containing(texts.select(F.col("piece").alias("text")).distinct(), index)
    by_part = Lookup.stage(
        texts.groupBy("piece").agg(F.collect_list("of").alias("of")), ["piece"], "term-parts"
    )
    whole = (
        lookup_join(found.withColumnRenamed("text", "piece"), by_part, ["piece"], "inner")
        .withColumn("of", F.explode("of"))
        .where(F.col("of.pattern").isNull() | F.like("folded", F.col("of.pattern")))
    )
    return asked, whole.select("of.text", "product_id", "popularity_global")


def _with_length(part: Column) -> Column:
    return F.struct(F.char_length(part).alias("size"), part.alias("part"))

