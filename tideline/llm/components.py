"""Connected components of a distributed edge list.

Labels start as the smallest neighbour. A round takes the smallest label among a
node's neighbours and then follows labels (the label of the label), so chains
shorten by half or better a round. A round is one write to shared storage, which
also counts the labels it changed: lineage ends there, and lost executors cost one
round's tasks at most. Nothing but that count reaches the driver. All groupings are
by minimum, combined before the shuffle; joins on a node with many edges are of the
kind that adaptive execution splits. Edges counted to be at most ``EDGES_AT_ONCE``
are settled in one task instead, whose memory that number bounds.

:func:`merged` brings labels up to date with new links by way of the components
they join, so what later rounds work on is as small as what they found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tideline.llm.arrowtext import give_back
from tideline.llm.common import BROADCAST_ROWS, gathered, release, saved, small

#: Edges that one task may hold; more are settled by rounds over the cluster.
EDGES_AT_ONCE = 1 << 20


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges, and the smallest node that each one reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(nodes))
    a, b = at[: len(u)], at[len(u) :]
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up


def _at_once(edges: DataFrame) -> DataFrame:
    """:func:`connected` of few edges (u, v), worked out in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        u, v = (np.concatenate([np.zeros(0, np.int64), *[b.column(k).to_numpy() for b in held]]) for k in (0, 1))
        nodes, label = least_nodes(u, v)
        for k in range(0, len(nodes), 100_000):
            yield pa.record_batch({"node": pa.array(nodes[k : k + 100_000]), "label": pa.array(label[k : k + 100_000])})
        give_back()

    return edges.repartition(1).mapInArrow(run, "node long, label long")


def connected(edges: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """(node, label) of all nodes with an edge, of which there are ``most`` at most; label is the smallest node of the component."""
    watch = Observation()
    pairs = saved(gathered(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), most), watch, rows=F.count(F.lit(1)))
    if watch.get["rows"] <= EDGES_AT_ONCE:
        labels = saved(_at_once(pairs))
        release(pairs)
        return labels
    both = saved(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    release(pairs)
    labels = saved(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("l")), "v").groupBy(F.col("u").alias("node")).agg(F.min("l").alias("m"))
        lowered = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("top"))
        watch = Observation()
        after = saved(lowered.join(up, "low").select("node", "old", F.least("low", "top").alias("label")), watch, changed=F.sum(F.expr("if(old <> label, 1, 0)")))
        before, labels = labels, after.select("node", "label")
        labels._saved_at = after._saved_at
        release(before)
        if not watch.get["changed"]:
            release(both)
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) of all nodes after links (a, b) between some of them."""
    roots = connected(labelled(links, labels), "la", "lb", links.count()).select(F.col("node").alias("label"), F.col("label").alias("root"))
    return saved(labels.join(small(roots), "label", "left").select("node", F.coalesce("root", "label").alias("label")))


def labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, la, lb) of the stored ``pairs`` (a, b) that have different labels; few pairs go to where the labels are."""
    few = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda df: df
    return labels.toDF("b", "lb").join(few(labels.toDF("a", "la").join(few(pairs.select("a", "b")), "a")), "b").where("la <> lb").select("a", "b", "la", "lb")
