"""Live operation: replay, bounded subscriptions, first-message latency, recording, ring state, the signal sampler."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tideline.functions.link import parse_dbm


def replay(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Files of a recording as live traffic, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def bounded_stream(stream: DataFrame, topics: list[str] | None, lo: int, hi: int) -> DataFrame:
    """What a subscription of limited duration receives."""
    rows = stream if topics is None else stream.where(F.col("topic").isin(topics))
    return rows.where(F.col("t_us").between(F.lit(lo), F.lit(hi)))


def subscribe(stream: DataFrame, name: str, topics: list[str] | None, lo: int, hi: int, checkpoint: str | None = None) -> StreamingQuery:
    """A running subscription into the table ``name``; its owner waits for it and stops it."""
    writer = bounded_stream(stream, topics, lo, hi).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def parallel(stream: DataFrame, topics: list[str], lo: int, hi: int, prefix: str) -> list[StreamingQuery]:
    """One subscription for each topic, all running at once on one session."""
    return [subscribe(stream, f"{prefix}_{k}", [t], lo, hi) for k, t in enumerate(topics)]


def first_times(stream: DataFrame) -> DataFrame:
    """First message time of each topic: state of one number per topic."""
    return stream.groupBy("topic").agg(F.min("t_us").alias("t_us"))


def stamps(stream: DataFrame, schema: str, path: str = "header.stamp") -> DataFrame:
    """Publish stamps of decoded messages, nothing else of them."""
    return stream.select("topic", F.from_json("data", schema).alias("m")).select("topic", F.col(f"m.{path}").alias("stamp"))


def record(stream: DataFrame, path: str, checkpoint: str, topics: list[str] | None, lo: int, hi: int) -> StreamingQuery:
    """Write a live stream into a container; readers see whole batches only, by the sink's own log."""
    rows = bounded_stream(stream, topics, lo, hi)
    return rows.writeStream.format("parquet").partitionBy("topic").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sampler(spark: SparkSession, text: str, per_second: int = 2) -> DataFrame:
    """(t_us, dbm): a level about every half second; ``text`` stands for what the wireless tool prints."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.select(F.unix_micros("timestamp").alias("t_us"), parse_dbm(F.lit(text)).alias("dbm"))


RING_STATE = StructType([StructField("t_us", LongType()), StructField("seq", LongType())])


class Ring(StatefulProcessor):
    """The last ``size`` messages of a key, whatever order batches come in; emits the whole ring after each batch."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", RING_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = [(int(t), int(s)) for t, s in self.kept.get()]
        for frame in rows:
            got += list(zip(frame["t_us"].astype(int), frame["seq"].astype(int), strict=True))
            got = sorted(got, reverse=True)[: self.size]
        self.kept.put(got)
        yield pd.DataFrame({"topic": key[0], "rn": range(1, len(got) + 1), "t_us": [t for t, _ in got], "seq": [s for _, s in got]})

    def close(self) -> None:
        pass


def ring_stream(stream: DataFrame, size: int = 10) -> DataFrame:
    """(topic, rn, t_us, seq) rings, updated batch by batch; state is ``size`` pairs a topic."""
    return stream.select("topic", "t_us", "seq").groupBy("topic").transformWithStateInPandas(
        statefulProcessor=Ring(size), outputStructType="topic string, rn long, t_us long, seq long", outputMode="Update", timeMode="None"
    )
