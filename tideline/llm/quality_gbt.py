"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training is numpy in one task, on the statistics (a few numbers a document) of
at most ``most`` labelled documents. The trees are complete binary trees kept in
flat arrays, so that scoring walks all rows of a batch down one level at a time
with array indexing and no branching in Python per row.

Defined cases: null and empty texts have all statistics zero and are scored like
any other row; a very long text is scored whole, in memory of a small multiple of
its size. Without any training label the score is 0.5 throughout; empty tables
give empty results. Only id and text are read, so other columns may have any name;
repeated rows are scored one by one, and learned from once; ties of a split go to
the first feature; null ids pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.arrowtext import map_chunks
from tideline.llm.common import held_out, in_one_task, table
from tideline.llm.doc_stats import COUNTS, RATIOS, SCHEMA, batch_statistics, statistics
from tideline.llm.labelled import labelled_texts, training_labels

FEATURES = [*COUNTS, *RATIOS]
#: Labelled documents that a model is fitted on, at most.
TRAIN_ROWS = 20_000
ROUNDS, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 64, 0.2, 1.0, 10


@dataclass
class Trees:
    """``feature[t, i]`` and ``cut[t, i]`` for inner node i (children 2i+1, 2i+2), ``leaf[t, j]`` for the lowest level."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            out += self.leaf[t, node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Logistic boosting; each split is the best of all features' histogram edges."""
    n, m = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    if not n:
        return empty
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Trees(empty.feature, empty.cut, empty.leaf, bias)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    margin = np.full(n, bias)
    features, cuts, values = [], [], []
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            at = node - base
            best_gain, best = np.full(width, 1e-6), np.full((width, 2), -1)
            for j in range(m):
                if not len(edges[j]):
                    continue
                key = at * bins + binned[:, j]
                gs, hs, cs = (np.bincount(key, v, minlength=width * bins).reshape(width, bins).cumsum(1) for v in (g, h, np.ones(n)))
                left_g, left_h, left_c = gs[:, :-1], hs[:, :-1], cs[:, :-1]
                tg, th, tc = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = left_g**2 / (left_h + L2) + (tg - left_g) ** 2 / (th - left_h + L2) - tg**2 / (th + L2)
                gain[(left_c < LEAST) | (tc - left_c < LEAST)] = -1
                gain[:, len(edges[j]) :] = -1
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best_gain
                best_gain[better] = top[better]
                best[better] = np.stack([np.full(width, j), k], 1)[better]
            for i in range(width):
                if best[i, 0] >= 0:
                    feature[base + i], cut[base + i] = best[i, 0], edges[best[i, 0]][best[i, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf_of = node - inner
        leaf = -rate * np.bincount(leaf_of, g, minlength=leaves) / (np.bincount(leaf_of, h, minlength=leaves) + L2)
        margin += leaf[leaf_of]
        features.append(feature), cuts.append(cut), values.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(values), bias)


def matrix(got: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([np.asarray(got[c], dtype=np.float64) for c in FEATURES], axis=1)


def sample_statistics(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Statistics and labels of a bounded sample."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_statistics(batch).append_column("label", batch.column(2))

    return map_chunks(labelled_texts(docs, sample), run, SCHEMA + ", label int")


def sample_arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The statistics' matrix and the labels, in order of id."""
    rows = rows.sort_by([("doc_id", "ascending")])
    return matrix({c: rows[c].to_numpy() for c in FEATURES}), rows["label"].to_numpy().astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS, parts: int = 3, remainder: int = 1) -> Trees:
    return in_one_task(sample_statistics(docs, training_labels(labels, label, most, parts, remainder)), lambda rows: fit(*sample_arrays(rows)))


def score(docs: DataFrame, model: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = shared.value.probability(matrix(statistics(batch.column(1))))
        return pa.record_batch({"doc_id": batch.column(0), "score": pa.array(p), "predicted": pa.array(p >= 0.5).cast(pa.int32())})

    return map_chunks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, score double, predicted int")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
