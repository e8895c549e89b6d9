"""Language ID: averaged hashed subword embeddings with a linear softmax.

A document's vector is the mean of the embeddings of its byte n-grams (3 and 4
bytes, A-Z lower-cased, everything but letters one separator), hashed into
``BUCKETS`` rows. Embeddings and the linear layer are trained together by
stochastic gradient descent in numpy on at most ``TRAIN_ROWS`` labelled
documents. Scoring is linear in the n-grams, so the two layers are multiplied out
once into a table of [bucket, language] and a document costs one gather per byte.

Calibration: a temperature fitted on a fifth of the sample that training didn't
see. A document is rejected if it has no letter, or if its calibrated
probability is under the lower of 1.5 / languages and the ``REJECT_QUANTILE`` quantile of
those calibration documents.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and
rejected. Without any training row every text is ``und``; empty tables give empty
results. A very long text is read whole, in memory of a small multiple of its size.
Rows with null lang are never learned from; null ids pass through; repeated rows are
scored one by one and learned from once; equal scores go to the first language by
name; other columns are not read and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.arrowtext import LOWER, Chunk, lut, map_chunks
from tideline.llm.common import bounded, held_out, in_one_task, table

TRAIN_ROWS = 2_000
BUCKETS, DIM, EPOCHS, RATE = 1 << 15, 12, 4, 0.5
REJECT_QUANTILE = 0.001
ASCII_LETTER = lut(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
HIGH = lut(lambda b: b >= 0x80)
#: Letters (any byte over 0x7F counts as part of one) lower-cased, all else a space.
FOLD = np.where(ASCII_LETTER | HIGH, LOWER, 0x20).astype(np.uint32)


def grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the 3-gram and of the 4-gram at each byte; 0 marks those of separators or across documents."""
    b = FOLD[chunk.data]
    n = len(b)
    three, four = np.zeros(n, np.int32), np.zeros(n, np.int32)
    if n < 4:
        return three, four
    t = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    h3 = (t * np.uint32(0x9E3779B1)) >> np.uint32(17)
    h4 = ((t[:-1] ^ (b[3:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)) >> np.uint32(17)
    blank = b == 0x20  # the newline after each document is one, so no n-gram joins two documents but over it
    three[:-2] = np.where(blank[:-2] & blank[1:-1] | blank[1:-1], 0, h3 | 1)
    four[:-3] = np.where(blank[1:-2] | blank[2:-1], 0, h4 & ~np.uint32(1) | 2)
    return three, four


def has_letter(texts: pa.Array, chunk: Chunk) -> np.ndarray:
    found = chunk.count(ASCII_LETTER[chunk.data]) > 0
    for i in np.flatnonzero(~found & (chunk.count(HIGH[chunk.data]) > 0)):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return found


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # [bucket, language], embeddings times linear layer
    bias: np.ndarray
    temperature: float = 1.0
    reject_under: float = 0.0

    def logits(self, chunk: Chunk) -> np.ndarray:
        sums = np.zeros((chunk.n, len(self.langs)))
        total = np.zeros(chunk.n)
        for ids in grams(chunk):
            total += chunk.count(ids > 0)
            for k in range(len(self.langs)):
                sums[:, k] += np.add.reduceat(self.table[k][ids], chunk.start[:-1]) if chunk.n else 0
        return sums / np.maximum(total, 1)[:, None] + self.bias

    def probabilities(self, chunk: Chunk) -> np.ndarray:
        z = self.logits(chunk) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def fit(features: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str]) -> Model:
    """SGD on (bucket ids, their shares of the document) pairs; the last fifth of the rows calibrates."""
    rng = np.random.default_rng(17)
    k = len(langs)
    emb, lin, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, k)), np.zeros(k)
    cut = len(y) - len(y) // 5
    step, steps = 0, max(1, EPOCHS * cut)
    for _ in range(EPOCHS):
        for i in rng.permutation(cut):
            ids, share = features[i]
            rate = RATE * (1 - step / steps)
            step += 1
            v = share @ emb[ids]
            z = v @ lin + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = lin @ p
            lin -= rate * np.outer(v, p)
            bias -= 0.1 * rate * p
            # a document's n-grams have small shares each; the step is scaled up so that rows move as their share of the vector asks
            emb[ids] -= np.outer(np.minimum(rate * share * len(ids) ** 0.5, 1.0), back)
    full = emb @ lin
    full[0] = 0
    model = Model(langs, np.ascontiguousarray(full.T.astype(np.float32)), bias)
    held = range(cut, len(y)) if cut < len(y) else range(len(y))
    z = np.array([share @ full[ids] + bias for ids, share in (features[i] for i in held)]).reshape(len(held), k)
    own = y[list(held)]

    def loss(t: float) -> tuple[float, np.ndarray]:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
        return -np.log(np.maximum(p[np.arange(len(own)), own], 1e-12)).mean(), p

    if len(own):
        model.temperature = min(np.geomspace(0.05, 5, 40), key=lambda t: loss(t)[0])
        model.reject_under = float(min(1.5 / k, np.quantile(loss(model.temperature)[1].max(axis=1), REJECT_QUANTILE)))
    return model


def sample_features(rows: DataFrame) -> DataFrame:
    """(doc_id, lang, ids, counts): buckets of (doc_id, lang, text) rows and how often each stands there."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        chunk = Chunk(batch.column(2))
        both = [(grams_) for grams_ in grams(chunk)]
        ids, counts = [], []
        for a, b in zip(chunk.start[:-1], chunk.start[1:], strict=True):
            own, c = np.unique(np.concatenate([g[a:b] for g in both]), return_counts=True)
            ids.append(own[own > 0]), counts.append(c[own > 0])
        return pa.record_batch({"doc_id": batch.column(0), "lang": batch.column(1), "ids": pa.array(ids, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int32()))})

    return map_chunks(rows, run, "doc_id long, lang string, ids array<int>, counts array<int>")


def fit_sample(rows: pa.Table) -> Model | None:
    """The model of a bounded sample, in an order that doesn't depend on how the rows came."""
    rows = rows.sort_by([("doc_id", "ascending")])
    langs, features = rows["lang"].to_pylist(), []
    if not langs:
        return None
    for ids, counts in zip(rows["ids"], rows["counts"], strict=True):
        c = counts.values.to_numpy().astype(np.float64)
        features.append((ids.values.to_numpy(), c / max(c.sum(), 1)))
    order = np.random.default_rng(5).permutation(len(langs))
    names = sorted(set(langs))
    return fit([features[i] for i in order], np.array([names.index(langs[i]) for i in order]), names)


def train(docs: DataFrame, most: int = TRAIN_ROWS, parts: int = 5, remainder: int = 0) -> Model | None:
    """Fitted on the text and lang of a bounded sample of ids outside the held-out fold.

    Of several labelled texts under one id the one with the smallest language and
    text counts; a minimum is combined before the shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", parts, remainder))
    chosen = F.broadcast(bounded(rows.select("doc_id").distinct(), "doc_id", most))
    one = rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("one")).select("doc_id", "one.lang", "one.text")
    return in_one_task(sample_features(one), fit_sample)


def label_batch(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether the document is rejected."""
    chunk = Chunk(texts)
    if model is None:
        return ["und"] * chunk.n, np.zeros(chunk.n), np.ones(chunk.n, bool)
    p = model.probabilities(chunk)
    best, letters = p.argmax(axis=1), has_letter(texts, chunk)
    score = np.where(letters, p.max(axis=1), 0.0)
    return [model.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], score, ~letters | (score < model.reject_under)


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, score, rejected = label_batch(shared.value, batch.column(1))
        return pa.record_batch({"doc_id": batch.column(0), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(score), "rejected": pa.array(rejected)})

    return map_chunks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(~label_batch(shared.value, batch.column(at))[2]))

    return map_chunks(docs, run, docs.schema, column=text)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "rejected")
