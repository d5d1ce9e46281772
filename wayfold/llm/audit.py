"""Interaction of document filters as a removal game, solved by its potential.

A coalition is a set of filters and is worth the documents that fail at least one of them. Documents are
counted by the set of filters they fail, at most 32 counts a part, so all that follows is independent of the
size of the corpus. The potential of a coalition is worth plus the potentials of the coalition without
each of its filters, divided by its size; a filter's Shapley value is the grand potential minus
the potential without that filter, and what one step of an order removes is the difference of two coalitions.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.tables import stored
from wayfold.operators.joins import Lookup, lookup_join

# The filters and their thresholds.
LETTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_UPPER_PERCENT = 5
MARKUP = "[#$%&*|]"
# Fixed value: what separates words.
SPACE = "[\\x20\\x09-\\x0D]+"

COALITIONS = 1 << len(LETTERS)
GRAND = COALITIONS - 1
# Potentials are multiples of one over the least common multiple of 1 to 5, so they are exact in these units.
UNITS = 60
ORDERS = ["".join(p) for p in permutations(LETTERS)]


def bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails, from the text alone."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    # Bound once: the word list is counted twice.
    counts = F.transform(
        F.array(words),
        lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")),
    )[0]
    few = counts["n"] < LEAST_WORDS
    repeated = 100 * counts["distinct"] < LEAST_DISTINCT_PERCENT * counts["n"]
    shouting = 100 * upper > MOST_UPPER_PERCENT * F.length(text)
    failed = {"A": few, "B": repeated, "C": shouting, "D": text.rlike(MARKUP)}
    mask = F.lit(0)
    for letter, condition in failed.items():
        mask = mask + F.when(condition, bit(letter)).otherwise(0)
    return mask


def failures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """``doc_id``, ``part`` and ``mask``: the bits of the filters each document fails.

    Filter E asks for a document with the same text and a smaller id, anywhere in the table. A null text
    counts as empty and a null part as the empty one. A document without id is no copy and no
    original; rows that repeat id and text are not copies of each other. Every input row gives one
    row; other columns are left out, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        own_failures(text).alias("own"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = stored(rows, "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    copied = first.where("first_id < last_id").drop("last_id")
    copied = Lookup.stage(copied, ["digest"], "audit-copied")
    found = lookup_join(rows, copied, ["digest"])
    later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    mask = F.col("own") + F.when(later, bit("E")).otherwise(0)
    return found.select("doc_id", "part", mask.alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones of each part by the filters they fail.

    A document is good or toxic when any label row of its id says so; labels without an id count for
    no document.
    """
    marked = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
        )
        .where("good or toxic")
    )
    marked = Lookup.stage(marked, ["doc_id"], "audit-labels")
    return (
        lookup_join(failed, marked, ["doc_id"])
        .groupBy("part", "mask")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("good").alias("good"),
            F.count_if("toxic").alias("toxic"),
        )
    )


def coalition_values(counts: DataFrame) -> DataFrame:
    """One row per part: its ``total`` and ``worth``, an array over all coalitions in order of their bits."""
    met = (F.col("mask").bitwiseAND(F.col("coalition"))) != 0
    summed = (
        counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(GRAND))))
        .groupBy("part", "coalition")
        .agg(
            F.sum("n").alias("total"),
            *[F.sum(F.when(met, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")],
        )
    )
    entries = F.array_sort(F.collect_list(F.struct("coalition", "n", "good", "toxic")))
    return summed.groupBy("part").agg(F.max("total").alias("total"), entries.alias("worth"))


def potentials(worth: Column) -> Column:
    """Potential of every coalition in units of 1 / ``UNITS``, by coalition.

    Each coalition follows all its subsets in the order of bits, so one pass is the whole recursion.
    """

    def next_one(known: Column, coalition: Column) -> Column:
        total = F.get(worth, coalition)["n"] * UNITS
        for letter in LETTERS:
            without = F.get(known, coalition - bit(letter))
            total = total + F.when(coalition.bitwiseAND(bit(letter)) != 0, without).otherwise(0)
        # Exact: all potentials are whole numbers of these units.
        return F.concat(known, F.array(F.call_function("div", total, F.bit_count(coalition))))

    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(GRAND)), start, next_one)


def steps(values: DataFrame) -> DataFrame:
    """One row per part, order and step, from the worth of the coalitions alone."""
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.aggregate(
        F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""),
        F.lit(0),
        lambda sum_, c: sum_ + _bit_of(c),
    )
    orders = F.explode(F.array(*[F.lit(o) for o in ORDERS]))
    placed = (
        values.select("part", "total", "worth", potentials(F.col("worth")).alias("potential"))
        .withColumn("filter_order", orders)
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
        .withColumns({"own": _bit_of(letter), "before": before})
    )

    def worth(coalition: Column, name: str) -> Column:
        return F.get("worth", coalition)[name]

    own, earlier = F.col("own"), F.col("before")
    after = own + earlier
    removed = worth(after, "n") - worth(earlier, "n")
    share = F.get("potential", F.lit(GRAND)) - F.get("potential", GRAND - own)
    scale = len(ORDERS) // UNITS
    return placed.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - worth(after, "n")).alias("kept"),
        removed.alias("removed"),
        (worth(own, "n") - removed).alias("redundant"),
        (worth(F.lit(GRAND), "n") - worth(GRAND - own, "n")).alias("unique_fails"),
        (worth(after, "good") - worth(earlier, "good")).alias("good_lost"),
        (worth(after, "toxic") - worth(earlier, "toxic")).alias("toxic_lost"),
        (share * scale).alias("shapley"),
    )


def _bit_of(letter: Column) -> Column:
    """Bit of a letter; 0 for the empty string."""
    found = F.lit(0)
    for one in LETTERS:
        found = F.when(letter == one, bit(one)).otherwise(found)
    return found


def audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """What every order of the five filters keeps and removes, by part.

    One row per part, ``filter_order`` (all 120) and ``step`` with counts of documents: ``kept`` after the
    step, ``removed`` by it, ``redundant`` (failing its filter but removed earlier), ``unique_fails`` (failing its
    filter only), ``good_lost`` and ``toxic_lost`` (removed here and labelled so), and ``shapley``: what its filter
    removes, summed over all orders. Documents are treated as in :func:`failures` and labels as in :func:`mask_counts`;
    an empty table has no parts and gives no rows.
    """
    return steps(coalition_values(mask_counts(failures(docs, id_col, text_col, part_col), labels)))
