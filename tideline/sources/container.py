"""Containers: a partitioned Parquet dataset of messages, clustered by topic and time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.names import is_active, natural_number, natural_prefix
from tideline.functions.time import SECOND


class Container:
    """A bound set of messages. ``tick`` is how many microseconds one second of a request stands for.

    ``within`` gives the rows of a closed interval where the stored time is of
    another type than ``t_us``, so that windows reach the files all the same.
    """

    def __init__(self, rows: DataFrame, tick: int = SECOND, within: Callable[[int, int], DataFrame] | None = None):
        self.rows, self.tick, self.within = rows, tick, within
        self._bounds: tuple[int | None, int | None] | None = None

    def bounds(self, refresh: bool = False) -> tuple[int | None, int | None]:
        """First and last time. Resolved before a scan, so that windows are literals and both ends reach the files."""
        if self._bounds is None or refresh:
            r = self.rows.agg(F.min("t_us"), F.max("t_us")).first()
            self._bounds = (r[0], r[1])
        return self._bounds

    def between(self, lo: int | None, hi: int | None) -> DataFrame:
        """Messages in a closed time interval. An unknown bound (an empty container) selects nothing."""
        if lo is None or hi is None:
            return self.rows.where(F.lit(False))
        rows = self.rows if self.within is None else self.within(int(lo), int(hi))
        return rows.where(F.col("t_us").between(F.lit(int(lo)), F.lit(int(hi))))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a container, in whatever store the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def open_container(spark: SparkSession, path: str, tick: int = SECOND) -> Container | None:
    """The container at ``path``, or None if there is none (then a request gets an empty reply)."""
    try:
        return Container(spark.read.parquet(path), tick)
    except AnalysisException:
        return None


def with_parts(rows: DataFrame, origin: int, duration_us: int) -> DataFrame:
    """Messages with the number of the fixed-duration split that each is in, by its own time."""
    return rows.withColumn("part", F.floor((F.col("t_us") - F.lit(origin)) / F.lit(duration_us)).cast("int"))


def convert(rows: DataFrame, path: str, duration_us: int | None = None) -> None:
    """Write messages as a container.

    Rows are dealt by ranges of (topic, time): a topic that holds most of the
    messages spreads over many files, each with a narrow time range, which is what
    lets a window skip files. Spark's commit protocol leaves nothing half-written.
    """
    keys = ["topic"]
    if duration_us:
        origin = rows.agg(F.min("t_us")).first()[0] or 0
        rows, keys = with_parts(rows, origin, duration_us), ["topic", "part"]
    rows.repartitionByRange(*keys, "t_us").sortWithinPartitions(*keys, "t_us").write.mode("errorifexists").partitionBy(*keys).parquet(path)


def split_files(files: DataFrame, column: str = "name") -> DataFrame:
    """A directory listing in natural order without splits that are being written: (name, n)."""
    name = F.col(column)
    return files.where(~is_active(name)).select(name.alias("name"), natural_prefix(name).alias("prefix"), natural_number(name).alias("n")).orderBy("prefix", "n").drop("prefix")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Foreign split files in a directory, each row with its split's number taken from the file's name."""
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)  # a split being written ends otherwise
    return rows.select("*", natural_number(F.col("_metadata.file_name")).alias("part"))
