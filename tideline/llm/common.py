"""Reading, folds and bounded samples that the operators share."""

from __future__ import annotations

import atexit
import gc
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.llm.arrowtext import give_back

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids are of no fold (null)."""
    return F.crc32(F.col(column).cast("string")) % F.lit(parts)


def held_out(column: str, parts: int, remainder: int) -> Column:
    """True for rows that training must not see; null ids count as not held out."""
    return F.coalesce(fold(column, parts) == F.lit(remainder), F.lit(False))


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those whose keys hash lowest: the same ones in any partitioning.

    Rows are counted first and cut by a hash value that leaves few more than
    ``most`` of them, so what meets in the last sort doesn't grow with the table.
    """
    rows = df.where(F.col(key).isNotNull())
    n = rows.count()
    h = F.xxhash64(key)
    share = (most + 8 * most**0.5 + 16) / max(n, 1)  # fewer than ``most`` are left by chance once in some 10**15 times
    if share < 1:
        rows = rows.where(h <= F.lit(int(-(1 << 63) + share * (1 << 64))))
    return rows.orderBy(h, key).limit(most)


def shared_root(spark: SparkSession) -> str:
    """The folder for tables between steps: that of ``spark.checkpoint.dir``, which all executors see.

    Where it is unset, a session on one machine (a test) gets a temporary folder; any other is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="tideline-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return _own_root[0]


_own_root: list[str] = []


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Arrow batches are small, for tables whose rows may be very long; the session's own settings come back."""
    ours = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
    before = {k: spark.conf.get(k) for k in ours}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def saved(df: DataFrame, watch: Observation | None = None, **metrics: Column) -> DataFrame:
    """``df`` written to shared storage and read again, so its lineage ends there.

    ``watch`` gets ``metrics`` of the rows while they are written. :func:`release` removes the table;
    what nobody released goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tideline-{uuid.uuid4().hex}"
    _tables[path] = spark
    with small_batches(spark):
        (df.observe(watch, *[m.alias(name) for name, m in metrics.items()]) if watch else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


_tables: dict[str, SparkSession] = {}


def release(*tables: DataFrame) -> None:
    """Remove saved tables that nothing will read any more."""
    for t in tables:
        path = getattr(t, "_saved_at", None)
        if path in _tables:
            _remove(_tables.pop(path), path)


def cleared(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps: it does so as the driver's garbage is collected, which may be long after."""
    gc.collect()  # Python's handles on plans keep them alive
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in _tables.items():
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: its folder is its owner's to clear
            return


def in_one_task(rows: DataFrame, fit: Callable[[pa.Table], T]) -> T:
    """``fit`` of all rows of a bounded table, worked out in one task: the driver holds neither the rows nor what fitting needs."""
    schema = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.cast(schema) if b.schema != schema else b for b in batches]
        yield pa.record_batch({"model": pa.array([pickle.dumps(fit(pa.Table.from_batches(got, schema)))], pa.binary())})
        give_back()

    with small_batches(rows.sparkSession):
        model = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(model[0]) if model else fit(schema.empty_table())  # a plan known to be empty runs no task


#: Rows of two or three numbers that may be broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a stored table of a few numbers a row, marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Rows of such a table that are worth a file of their own.
FILE_ROWS = 20_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of a few numbers for each of ``rows`` rows, in few partitions if they are few: each file costs a start of ``chmod`` on a local disk."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(min(4 * cores, max(cores, -(-rows // FILE_ROWS)))) if rows <= BROADCAST_ROWS else df
