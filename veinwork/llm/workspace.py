"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a local one where that is unset and all runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veinwork-")
    path = f"{base.rstrip('/')}/veinwork-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df``, written as Parquet and read back: a cut in the lineage that outlives executors.

    Shuffle files of the write go when it ends, not when the driver collects its garbage.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def from_files(df: DataFrame, path: str) -> DataFrame:
    """``df`` if it reads files, so that each run of a task sees the same rows in the same order; else a written copy."""
    try:
        df.select("_metadata.row_index")
        return df
    except AnalysisException:
        return written(df, path)


#: Decisions on rows up to this number (16 bytes each, twice that in memory) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def kept_rows(docs: DataFrame, keys: dict[str, Column], decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` keeps.

    ``keys`` gives the columns of ``decided`` that name a row as expressions
    over ``docs``; ``decided`` has them with ``copies``, the number of such
    rows, and ``kept``.  Of equal keys that are kept one row stays.
    """
    own = {k: f"__{k}_{uuid.uuid4().hex[:8]}" for k in keys}
    named = docs.withColumns({own[k]: v for k, v in keys.items()})

    def meet(left: DataFrame, some: DataFrame, how: str) -> DataFrame:
        number = some.limit(BROADCAST_ROWS + 1).count()
        if not number:
            return left if how == "left_anti" else left.limit(0)
        right = some.select(*[F.col(k).alias(f"{own[k]}_r") for k in keys])
        on = None
        for k in keys:
            same = F.col(own[k]).eqNullSafe(F.col(f"{own[k]}_r"))
            on = same if on is None else on & same
        return left.join(F.broadcast(right) if number <= BROADCAST_ROWS else right.hint("merge"), on, how)

    once = meet(named, decided.filter("NOT kept OR copies > 1"), "left_anti")
    repeated = decided.filter("kept AND copies > 1")
    if not repeated.isEmpty():
        once = once.unionByName(meet(named, repeated, "left_semi").dropDuplicates(list(own.values())))
    return once.drop(*own.values())


def dropped(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def released() -> None:
    """Free memory of this process goes back to the system: a worker that waits for its next task does not hold that of its last."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


#: MB of rows that executors and their workers hand to each other at a time, at most.
BATCH_MB = 4
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Rows go to workers in batches of ``BATCH_MB`` at most, or fewer where the session says so.

    This is the session's from then on, for what a query returns runs after it.
    By default a batch is 10,000 rows or 64 MB: executors then build it in
    buffers outside of their heap, up to twice its size, and workers hold it.
    """
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(BATCH_BYTES).lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_MB << 20:
        spark.conf.set(BATCH_BYTES, f"{BATCH_MB}m")


def rested(spark: SparkSession) -> None:
    """Executors collect their garbage, so that heap which an earlier stage filled goes back to the system before the next one's workers start.

    A heap grows to its limit before it is collected in full, and keeps what it
    has: without this, a stage finds the executor's memory taken by what no one
    uses.  One small task a slot; an executor that none reaches keeps its garbage.
    """
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def sparing(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows`` for ``mapInArrow``, which gives free memory back when the task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        released()

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """About ``size`` rows, at most twice as many: those whose hashed id is below the share that is wanted."""
    share = size / max(1, rows.count())
    if share >= 1:
        return rows
    scale = 1 << 30
    return rows.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(scale)) < int(share * scale)).limit(2 * size)
