"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.plans.scratch import scratch_path, staged

# Texts handed from Arrow to Python objects at once, so that memory does not follow the batch size.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str) -> Column:
    """True for the rows labels are never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back; lost executors then cost no lineage."""
    return staged(df, f"llm-{label}")


def discard(spark: SparkSession, frame: DataFrame) -> None:
    """Remove the files of a stored table which no later result reads."""
    for name in frame.inputFiles()[:1]:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps; Spark drops them when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def share_file(spark: SparkSession, data: bytes, label: str) -> str:
    """Write a small file to the shared scratch folder and have every executor fetch it once.

    Returns the name under which tasks find it by ``SparkFiles.get``; executors that start later get it too.
    """
    name = f"{label}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, label)}/{name}")
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    stream = system.create(path)
    try:
        stream.write(data)
    finally:
        stream.close()
    context.addFile(system.makeQualified(path).toString())
    return name


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into short ones."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


_owner: str | None = None
_forget: dict[str, Callable[[], None]] = {}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Name what empties the tables that an operator keeps between tasks of a Python worker."""
    _forget[owner] = forget


def working(owner: str) -> None:
    """Called at the begin of a task. A worker outlives its task and comes to other operators, so what those before it
    have kept goes first: a worker holds the tables of one operator. No result depends on them."""
    global _owner
    if owner == _owner:
        return
    _owner = owner
    for other, forget in _forget.items():
        if other != owner:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, as ``--py-files`` would.

    Not needed where it is on their path anyway: installed, named in PYTHONPATH, or the working
    folder.
    """
    context = spark.sparkContext
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep) + [os.getcwd()]
    if any(p and Path(p).resolve() == ROOT for p in paths):
        return
    if context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="wayfold-code-")
        context.addPyFile(shutil.make_archive(f"{folder}/wayfold", "zip", ROOT, "wayfold"))
        _shipped.add(context.applicationId)
