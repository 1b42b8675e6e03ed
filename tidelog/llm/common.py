"""Shared helpers of the training-data operators: staging, workers' caches, ranking, edge cases."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of two or three longs that are broadcast at most (some 50 MB).
BROADCAST_ROWS = 2_000_000
#: Rows and bytes of an Arrow batch of whole texts: a worker's memory, and the JVM's beside its heap, follow these.
BATCH_ROWS, BATCH_BYTES = 500, "4m"

_local: list[str] = []
_staged: dict[str, list[str]] = {}
_owner: contextvars.ContextVar[str] = contextvars.ContextVar("owner", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a single-JVM session may do without it: it gets a temporary folder, deleted at its end.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tidelog-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return "file://" + _local[0]


@contextlib.contextmanager
def owner(name: str) -> Iterator[None]:
    """What is staged inside belongs to ``name``, and ``release`` of that name deletes nothing else."""
    token = _owner.set(name)
    try:
        yield
    finally:
        _owner.reset(token)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidelog/{uuid.uuid4().hex}-{name}"
    _staged.setdefault(_owner.get(), []).append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables from which nothing will be read any more."""
    for df in tables:
        if df is not None and hasattr(df, "staged_at"):
            delete(df.sparkSession, df.staged_at)


def release(spark: SparkSession, name: str) -> None:
    """Delete what was staged under the owner ``name``. Call it only when the results are written."""
    for path in _staged.pop(name, []):
        delete(spark, path)


def small_batches(spark: SparkSession, most: int = BATCH_ROWS, size: str = BATCH_BYTES) -> None:
    """Whole texts go to Python in small Arrow batches, so that a worker's memory does not follow their lengths."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= most:
        spark.conf.set(rows, most)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Give memory that is free in this process back to the system: Arrow's, and the C library's where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


_held: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """The worker's object ``name``, kept for the tasks after this one. A worker keeps one: another name drops it first."""
    if name not in _held:
        _held.clear()
        give_back()
        _held[name] = make()
    return _held[name]


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def rank_within(df: DataFrame, keys: list[str], order: list[str], salt: Column, name: str = "rank") -> DataFrame:
    """Gapless ranks from 0 within ``keys`` without bringing a whole key into one task.

    Rows are split by ``salt`` (a deterministic int column of few values a key), ranked in each
    part, and each part starts where the parts before it end. The order is by part, then
    ``order``; the counts are one small row a key and part.
    """
    part = "_part"
    df = df.withColumn(part, salt)
    counts = df.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(part).alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*keys, part).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(inner).cast("long") - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(part) == F.col("_p")]
    out = ranked.join(starts, on, "left")
    return out.withColumn(name, F.col("_rn") + F.col("_start")).drop(part, "_rn", "_start", "_p", *[f"_k{i}" for i in range(len(keys))])


def run_name() -> str:
    """A name that no other run has."""
    return uuid.uuid4().hex


def bounded_sample(df: DataFrame, by: Column, n: int, total: int) -> DataFrame:
    """At most ``n`` rows of ``df``, those of least hash ``by``, without sorting or sending all of them.

    ``total`` bounds the rows of ``df``. Over 4n, one pass counts the rows themselves by the bits of
    their hash, and a threshold that leaves at least n of them (about 2n at most) comes first, so
    tasks pass on a few rows each whatever the input and whatever share of it ``df`` is.
    """
    rows = df.withColumn("_h", by)
    if total > 4 * n:
        short = F.pmod("_h", F.lit(1 << 40))
        counts = {r["b"]: r["n"] for r in rows.groupBy(F.length(F.bin(short)).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 40 rows
        seen = 0
        for bits in sorted(counts):
            seen += counts[bits]
            if seen >= n:
                rows = rows.where(short < (1 << bits))
                break
        return rows.orderBy(short, "_h").limit(n).drop("_h")
    return rows.orderBy("_h").limit(n).drop("_h")


def small_side(df: DataFrame) -> DataFrame:
    """A staged table of a few longs a row, as a broadcast if it has at most ``BROADCAST_ROWS`` rows; else Spark decides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
