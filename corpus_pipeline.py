"""A corpus pipeline of five stages over ``documents``.

Documents whose language cannot be told go, lines that repeat go, of near copies one stays, secrets are
masked, and what is left is packed into training sequences. Each stage reads what the one before wrote.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import bpe, jaccard, langid, lines, packing, secrets
from wayfold.llm.tables import ship, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a clear language; a null language becomes the predicted one."""
    ship(spark)
    found = langid.identify(docs.select(*COLUMNS), langid.learn(docs))
    kept = found.where(~F.col("rejected"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that stand elsewhere already; a document left without any text goes."""
    ship(spark)
    cleaned = lines.drop_repeats(docs.select(*COLUMNS))
    cleaned = cleaned.withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.where((F.trim("text") != "") | F.col("doc_id").isNull())


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of near copies; all rows with a null id stay.

    Rows that repeat an id are documents of their own; of equal ids the smaller hash of the text, then of the row, stays.
    """
    ship(spark)
    row = F.struct("doc_id", F.xxhash64("text").alias("t"), F.xxhash64(*COLUMNS).alias("r"))
    named = docs.where(F.col("doc_id").isNotNull()).select(*COLUMNS, row.alias("row_id"))
    groups = jaccard.components(named, "row_id")
    kept = groups.where("row_id = component_id").select("row_id").distinct()
    named = named.join(kept, "row_id").dropDuplicates(["row_id"]).select(*COLUMNS)
    return named.union(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every span of a secret."""
    ship(spark)
    masked = secrets.redact(docs.select(*COLUMNS), secrets.learn(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every token in a sequence."""
    ship(spark)
    return packing.pack(docs, bpe.Vocabulary(TOKENIZER, public_tokenizers.PATTERN))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("secret_scan", secret_scan),
    ("packing", pack_tokens),
]

# Language by compression and merging by tokenizer have no SQL equivalent.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
