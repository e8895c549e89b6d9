"""Responses: catalogue, sizes, and the packed reply to a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalog(rows: DataFrame) -> DataFrame:
    return rows.groupBy("topic", "conn_id").agg(F.count("*").alias("n"), F.min("t_us").alias("t0"), F.max("t_us").alias("t1"))


def first_sizes(rows: DataFrame) -> DataFrame:
    """Bytes of each topic's first message: a partial aggregation, no sort."""
    return rows.groupBy("topic").agg(F.min_by(F.octet_length("data"), F.struct("t_us", "seq")).alias("first_size"))


def pack(rows: DataFrame) -> DataFrame:
    """Per connection: messages, bytes, first time, and the payloads (text or bytes) in order as one.

    The payload of a reply is one value by contract, so this is for answers to
    requests; larger results stay rows.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("t_us", "seq", "data"))), lambda m: m["data"])
    empty = F.lit("").cast(dict(rows.dtypes)["data"])
    joined = F.concat_ws("", ordered) if dict(rows.dtypes)["data"] == "string" else F.aggregate(ordered, empty, lambda a, x: F.concat(a, F.coalesce(x, empty)))
    return rows.groupBy("conn_id").agg(
        F.count("*").alias("n"),
        F.sum(F.octet_length("data")).alias("bytes"),
        F.min(F.struct("t_us", "seq")).alias("first"),
        joined.alias("payload"),
    )


def con_info(rows: DataFrame, elapsed: float | None = None) -> DataFrame:
    """One string: connection ids in the order they are first seen, then elapsed time (if given) and message count."""
    seen = rows.groupBy("conn_id").agg(F.min(F.struct("t_us", "seq")).alias("ft"), F.count("*").alias("n"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ft", "conn_id"))), lambda x: x["conn_id"].cast("string")), " ")
    tail = [F.lit(f"{elapsed:.4f}/")] if elapsed is not None else []
    return seen.agg(F.concat(ids, F.lit(" /"), *tail, F.coalesce(F.sum("n"), F.lit(0)).cast("string")).alias("con_info"))


def window_metrics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("topic").agg(F.count("*").alias("n"), F.sum(F.octet_length("data")).alias("bytes"))
