"""Helpers shared by the training-data operators: durable intermediates, size-checked
broadcasts, and whole-table readers."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of two longs that are shipped to every executor at most (32 MB); larger sides are shuffled.
BROADCAST_ROWS = 2_000_000

#: Bytes of the rows that go to a Python worker together: a batch ends with the row that reaches them.
BATCH_BYTES = 2_000_000

#: The ASCII white space that the word and line rules name: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset on one machine (tests) a new local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        ctx = spark.sparkContext
        have = ctx._jsc.sc().getCheckpointDir()
        if not have.isDefined() and (not ctx.master.startswith("local") or ctx.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = have.get() if have.isDefined() else tempfile.mkdtemp(prefix="gaugeline-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, so a lost executor costs a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # the schema is given, so an empty table reads as one; partition columns come last
    fields = [f for f in df.schema if f.name not in partition_by] + [df.schema[p] for p in partition_by]
    return spark.read.schema(StructType(fields)).parquet(path)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where the counted rows stay within the limit; otherwise the plain side (shuffled join)."""
    return F.broadcast(df) if rows <= limit else df


def quoted(name: str) -> str:
    """A column's name as one identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in names])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, its session cutting batches for Python workers by bytes, not only by 10,000 rows of any length;
    a bound that the session has already stays."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id's decimal text divisible by five (null ids: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def hand_back() -> None:
    """Gives memory that the allocators hold but nothing uses back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def handing_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that hands memory back before its first batch and after its last one: a worker
    waiting for its next task then holds only what that task will find again."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        hand_back()
        yield from run(batches)
        hand_back()

    return task
