"""Small text and JSON sources and sinks: aliases, request files, freshness samples, signal series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.link import parse_dbm

AOI_SCHEMA = "delta double, time_sequence array<array<double>>"


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(abbr, topic) of a JSON object."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("abbr", "topic"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of request files; lines keep their order within a file by ``n``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).where(F.trim("line") != "")


def read_aoi(spark: SparkSession, path: str) -> DataFrame:
    """(series, delta, i, t, tp) of ``*.aoi`` files, or of what :func:`write_aoi` left; a file that can't be parsed gives one row of nulls."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("at"))
    written = F.url_decode(F.regexp_extract("at", "/series=([^/]+)/[^/]*$", 1))
    named = whole.withColumn("series", F.when(F.col("file").endswith(".aoi"), F.col("file")).when(written != "", written)).where("series is not null")
    one = named.select("series", F.from_json("value", AOI_SCHEMA, {"mode": "PERMISSIVE"}).alias("v"))
    flat = one.select("series", F.col("v.delta").alias("delta"), F.posexplode_outer("v.time_sequence").alias("i", "p"))
    return flat.select("series", "delta", "i", F.get("p", F.lit(0)).alias("t"), F.get("p", F.lit(1)).alias("tp"))


def write_aoi(samples: DataFrame, path: str, delta: float = 0.0) -> None:
    """One JSON object per series of (series, i, t, tp) in a folder of its name; nothing is written for an empty one."""
    own = F.coalesce(F.max("delta"), F.lit(float(delta))) if "delta" in samples.columns else F.lit(float(delta))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("i", "t", "tp"))), lambda s: F.array(s["t"], s["tp"]))
    samples.where("t is not null").groupBy("series").agg(own.alias("delta"), pairs.alias("time_sequence")).write.partitionBy("series").json(path)


def signal_replay(spark: SparkSession, path: str) -> DataFrame:
    """(tick, dbm) of a JSON object of levels, in the order of the file."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.map_values(F.from_json("value", "map<string,double>"))
    return raw.select(F.posexplode(entries).alias("tick", "dbm"))


def signal_text(lines: DataFrame, column: str = "line") -> DataFrame:
    """Levels in the text of a wireless tool; lines without one are skipped."""
    return lines.select("*", parse_dbm(F.col(column)).alias("dbm")).where("dbm is not null")


def write_signal(series: DataFrame, path: str) -> None:
    """(tick, dbm) levels as one JSON object a line."""
    series.select("tick", "dbm").write.json(path)
