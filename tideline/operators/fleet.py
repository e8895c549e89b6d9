"""Fleets: robots in groups, subscriptions of groups, one query over all robots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nodes of the fleet and of a group.
FLEET, GROUP = 20, 5


def group_of(robot_id: Column, size: int = GROUP) -> Column:
    return F.floor((robot_id - 1) / size).cast("int")


def hetero(rows: DataFrame, subscriptions: DataFrame, size: int = GROUP) -> DataFrame:
    """Messages that a robot's group subscribes to; (group_id, topic) is a table of the fleet's configuration."""
    keyed = rows.withColumn("group_id", group_of(F.col("robot_id"), size))
    return keyed.join(F.broadcast(subscriptions) if subscriptions.limit(100_001).count() <= 100_000 else subscriptions, ["group_id", "topic"], "left_semi")


def fleet_query(stores: dict[int, DataFrame], query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same query on each robot's own store, results side by side."""
    out = None
    for robot, rows in stores.items():
        one = query(rows).withColumn("robot_id", F.lit(robot))
        out = one if out is None else out.unionByName(one)
    return out


def fleet_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("robot_id", "topic").agg(F.count("*").alias("n"))
