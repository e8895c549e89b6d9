"""The message envelope: one row (robot_id, topic, conn_id, t_us, seq, data) over any table with times and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.time import micros, stored_between

#: Topics that are numbered by a literal list; with more, the numbering is joined.
LITERAL_TOPICS = 2_000


def topics(df: DataFrame, column: str) -> DataFrame:
    """(topic, conn_id) in order of name: one row per topic, the only ordering over everything."""
    names = df.select(F.col(column).alias("topic")).where("topic is not null").distinct()
    return names.select("topic", (F.row_number().over(Window.orderBy("topic")) - 1).cast("int").alias("conn_id"))


def numbered(column: Column, names: list[str]) -> Column:
    """Position of a topic among ``names``, null if it isn't one."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>"), column)
    return F.when(place > 0, place - 1).cast("int")


class Messages:
    """The envelope view of a table. ``data`` stays opaque; decoding is :func:`decoded`.

    :meth:`rows` are all messages; :meth:`within` those of a closed interval, whose
    ends reach the files as literals of the stored time column.
    """

    def __init__(self, df: DataFrame, ts: str, topic: str, seq: str, data: Column, robot: Column | None = None, extra: list[str] | None = None):
        self.df, self.ts, self.topic = df, ts, topic
        self.columns = [(robot if robot is not None else F.lit(1)).cast("int").alias("robot_id"), F.col(topic).alias("topic"), micros(df, ts).alias("t_us"), F.col(seq).alias("seq"), data.alias("data"), *(extra or [])]
        self.order = ["robot_id", "topic", "conn_id", "t_us", "seq", "data", *(extra or [])]
        known = topics(df, topic)
        first = known.limit(LITERAL_TOPICS + 1).collect()
        self.names = [r.topic for r in sorted(first, key=lambda r: r.conn_id)] if len(first) <= LITERAL_TOPICS else None
        self.known = known

    def _envelope(self, df: DataFrame) -> DataFrame:
        if self.names is not None:
            return df.select(*self.columns, numbered(F.col(self.topic), self.names).alias("conn_id")).select(*self.order)
        return df.select(*self.columns).join(self.known, "topic", "left").select(*self.order)

    def rows(self) -> DataFrame:
        return self._envelope(self.df)

    def within(self, lo: int, hi: int) -> DataFrame:
        return self._envelope(self.df.where(stored_between(self.df, self.ts, lo, hi)))


def decoded(rows: DataFrame, schema: str) -> DataFrame:
    """Decoded scan mode: the payload as a struct. Raw mode is simply not calling this, and then nothing is parsed."""
    return rows.withColumn("message", F.from_json("data", schema))


def event_table(spark: SparkSession, sf_dir: str) -> Messages:
    """The ``events`` table as a message stream of 20 robots."""
    return Messages(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "event_type", "event_id", F.col("props"), F.col("user_id") % 20 + 1, ["value"])


def order_table(spark: SparkSession, sf_dir: str) -> Messages:
    """The ``orders`` table as a container with many equal times."""
    return Messages(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", "o_orderpriority", "o_orderkey", F.col("o_orderstatus"))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_table(spark, sf_dir).rows()


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_table(spark, sf_dir).rows()


def connections(spark: SparkSession, rows: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """(conn_id, topic, header map) of every connection."""
    pairs = rows.select("conn_id", "topic").distinct()  # maps can't be compared, so they are made after this
    kind = F.lit("std/String")
    for name, value in (kinds or {}).items():
        kind = F.when(F.col("topic") == name, F.lit(value)).otherwise(kind)
    return pairs.withColumn("header", F.create_map(F.lit("topic"), F.col("topic"), F.lit("type"), kind))
