"""Toxicity: non-negative positive-unlabelled learning.

Positives are documents labelled toxic (a bounded sample of those labelled rows);
unlabelled are all texts of the training fold, whatever their label. With the
logistic loss the risk of a linear classifier is estimated as

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

The class prior is the share of toxic labels in the training fold, less a standard
error. Above zero of its second term the risk is convex: it is descended by Newton
steps, and a step that would bring that term below zero is taken back by halves, so
that a flexible model can't drive the estimate negative.

Features are presence flags of hashed words and word beginnings (4, 5 and 6
bytes; lower-cased; words of letters, digits and non-ASCII bytes). One pass over all
unlabelled texts counts the flags that positives have; the few hundred that are
significantly more frequent among positives are learned. A second pass turns every
unlabelled text into its pattern of those flags and counts equal patterns before the
shuffle; each Newton step sums its gradient and curvature over the stored patterns,
in the tasks that read them, and the driver gets a table of a size set by the number
of flags. Presence in whole texts is additive, so the weights become one short table
and a document is scored by a gather per word; only words with a weight are looked
at again, to count each flag once.

Defined cases: null and empty texts have no flag and get the score of the bias
alone; a very long text is scored whole, in memory of a small multiple of its size.
Without a toxic training label that has a text the score is near 0; one such label
is enough to learn from, though flags then need to be found often. Empty tables give
empty results. Null ids are scored and count as unlabelled; repeated rows are scored,
and count as unlabelled, one by one, and as positives once; flags that are equally
significant are taken in order of their numbers; only id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.arrowtext import ALNUM_WORD, Chunk, give_back, map_chunks, mix, pieces
from tideline.llm.common import bounded, held_out, in_one_task, release, saved, small_batches, table
from tideline.llm.labelled import labelled_texts, training_labels

#: Labelled positive documents that a model is fitted on, at most.
POSITIVES = 2_500
#: Flags are numbers of so many bits: few enough to pack beside a document's number, too many to collide.
BITS = 40
#: Flags that are counted among the unlabelled (those that most positives have), and that are learned, at most.
CANDIDATES, FLAGS = 1 << 16, 512
#: Different texts that a flag must stand in to be evidence.
SUPPORT = 3
#: A flag is learned if it is so many standard errors more frequent among positives: of CANDIDATES, a few are by chance.
LEAST_Z = 4.0
#: Newton steps at most, how often one is halved at most, the weight of the squares of the weights in the risk, and the share of it whose gain ends descent.
STEPS, HALVES, RIDGE, SETTLED = 12, 3, 2e-6, 3e-3
BEGINNINGS = (4, 5, 6)


def flags(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Flag ids [feature kind, word] (-1: none) and each word's document."""
    words = chunk.words(ALNUM_WORD)
    shift = np.uint64(64 - BITS)
    out = np.full((1 + len(BEGINNINGS), len(words.starts)), -1, np.int64)
    out[0] = words.hash >> shift
    length = words.ends - words.starts
    for k, size in enumerate(BEGINNINGS, 1):
        longer = np.flatnonzero(length > size)
        begin = words.starts[longer]
        out[k, longer] = (chunk.span_hash(begin, begin + size) ^ np.uint64(0xABCDEF12345 * k)) >> shift
    return out, words.doc


@dataclass
class Model:
    flag: np.ndarray  # sorted; those with a weight
    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        doc, at, n = own_flags(texts, self.flag)
        mean = np.bincount(doc, self.weight[at], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1)
        return 1.0 / (1.0 + np.exp(-np.clip(mean + self.bias, -30, 30)))


def unlike(rows: list[np.ndarray], hashes: int = 24, alike: int = 17) -> list[np.ndarray]:
    """The sampled flag sets without near copies of earlier ones, whose words would pass for evidence many times over."""
    seen: list[set[int]] = [set() for _ in range(hashes)]
    salt = np.arange(1, hashes + 1, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
    kept = []
    for row in rows:
        if not len(row):
            continue
        low = mix(row.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + salt).min(axis=1).tolist()
        if sum(h in s for h, s in zip(low, seen, strict=True)) < alike:
            kept.append(row)
            for h, s in zip(low, seen, strict=True):
                s.add(h)
    return kept


def doc_flags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct flags of the documents, and where each document's begin (and the last's end)."""
    chunk = Chunk(texts, lower=True)
    ids, doc = flags(chunk)
    pair = np.unique(np.concatenate([doc[row >= 0] << BITS | row[row >= 0] for row in ids]))
    return pair & ((1 << BITS) - 1), np.searchsorted(pair, np.arange(chunk.n + 1) << BITS)


def own_flags(texts: pa.Array, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, place in the sorted ``names``) of every flag that a document has, once; and the number of documents."""
    chunk = Chunk(texts, lower=True)
    if not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), chunk.n
    ids, doc = flags(chunk)
    maybe = np.zeros(1 << 20, bool)
    maybe[names & 0xFFFFF] = True
    found = []
    for row in ids:
        hit = np.flatnonzero(maybe[row & 0xFFFFF])
        at = np.minimum(np.searchsorted(names, row[hit]), len(names) - 1)
        real = names[at] == row[hit]
        found.append(doc[hit[real]] * len(names) + at[real])
    pair = np.unique(np.concatenate(found))
    return pair // len(names), pair % len(names), chunk.n


def positive_flags(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The flags most positives have and in how many, and for each positive its places among them.

    A flag must stand in SUPPORT positives that are no near copies of each other, or in all if they are fewer.
    """
    rows = rows.sort_by([("doc_id", "ascending")])
    own = []
    for batch in rows.combine_chunks().to_batches():
        for part in pieces(batch):
            ids, cut = doc_flags(part.column(1))
            own += [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    apart = unlike(own)
    names, counts = np.unique(np.concatenate([*apart, np.zeros(0, np.int64)]), return_counts=True)
    names = names[counts >= min(SUPPORT, len(apart))]
    found = np.concatenate([*own, np.zeros(0, np.int64)])
    at = np.searchsorted(names, found[np.isin(found, names)])
    counts = np.bincount(at, minlength=len(names))
    often = np.sort(np.lexsort((names, -counts))[:CANDIDATES])
    names, counts = names[often], counts[often]
    return names, counts, [np.searchsorted(names, x[np.isin(x, names)]).astype(np.uint16) for x in own]


def summed(texts: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the sums of their values over what ``run`` yields in all tasks."""
    with small_batches(texts.sparkSession):
        got = texts.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    return got["k"].to_numpy(), got["v"].to_numpy()


def unlabelled_counts(texts: DataFrame, names: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all texts each flag stands, and the number of texts; added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names) + 1)
        for batch in batches:
            for part in pieces(batch):
                _, at, n = own_flags(part.column(0), names)
                total += np.append(np.bincount(at, minlength=len(names)), n)
        used = np.flatnonzero(total)
        yield pa.record_batch({"k": pa.array(used), "v": pa.array(total[used])})
        give_back()

    out = np.zeros(len(names) + 1)
    k, v = summed(texts, run)
    out[k] = v
    return out[:-1], int(out[-1])


def patterns(texts: DataFrame, names: np.ndarray) -> DataFrame:
    """(pattern, c): the sets of flags that texts have, as 16-bit places in ``names``, and how many texts have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, int] = {}
            for part in pieces(batch):
                doc, at, n = own_flags(part.column(0), names)
                cut = np.searchsorted(doc, np.arange(n + 1)).tolist()
                data = at.astype("<u2").tobytes()
                for a, b in zip(cut, cut[1:], strict=False):
                    own = data[2 * a : 2 * b]
                    held[own] = held.get(own, 0) + 1
            yield pa.record_batch({"pattern": pa.array(list(held), pa.binary()), "c": pa.array(list(held.values()), pa.int64())})
        give_back()

    return texts.mapInArrow(run, "pattern binary, c long").groupBy("pattern").agg(F.sum("c").alias("c"))


def presence(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of flag places as a matrix of each flag's share of its row, with a last column of ones for the bias."""
    x = np.zeros((len(rows), width + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1 / max(len(r), 1)
    x[:, -1] = 1
    return x


def negative_risk(x: np.ndarray, c: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of loss(-) over rows that stand for ``c`` texts each, its gradient and its curvature."""
    z = x @ w
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    return float(c @ np.logaddexp(0, z)), (c * p) @ x, x.T @ (x * (c * p * (1 - p))[:, None])


def unlabelled_risk(kept: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """:func:`negative_risk` over all stored patterns."""
    width = len(w) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, g, h = 0.0, np.zeros(width + 1), np.zeros((width + 1, width + 1))
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                x = presence([np.frombuffer(b.as_buffer(), "<u2") for b in part.column(0)], width).astype(np.float64)
                for total, own in zip((g, h), (got := negative_risk(x, part.column(1).to_numpy().astype(float), w))[1:], strict=True):
                    total += own
                loss += got[0]
        flat = np.concatenate([[loss], g, h.ravel()])
        used = np.flatnonzero(flat)
        yield pa.record_batch({"k": pa.array(used), "v": pa.array(flat[used])})

    flat = np.zeros(1 + (width + 1) * (width + 2))
    k, v = summed(kept, run)
    flat[k] = v
    return float(flat[0]), flat[1 : width + 2], flat[width + 2 :].reshape(width + 1, width + 1)


def chosen(counts: np.ndarray, n_p: int, unlabelled: np.ndarray, n_u: int, prior: float) -> np.ndarray:
    """Places of the flags to learn, by the root of the likelihood ratio of their counts among positives."""
    rate_u = (unlabelled + 0.5) / (n_u + 1)
    expected = n_p * rate_u
    z = np.where(counts > expected, np.sqrt(np.maximum(2 * (counts * np.log(np.maximum(counts, 1) / expected) - (counts - expected)), 0)), 0)
    # of an unlabelled document with such a flag, at least half the chance must be that it is toxic
    good = np.flatnonzero((z > LEAST_Z) & (prior * counts / max(n_p, 1) > 0.5 * rate_u))
    return np.sort(good[np.argsort(-z[good], kind="stable")[:FLAGS]])


def descend(xp: np.ndarray, prior: float, of_unlabelled: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], n_u: int, slack: float) -> np.ndarray:
    """Weights (the last: bias) of least non-negative risk; ``of_unlabelled`` sums loss(-) over the unlabelled.

    Flags are evidence for toxicity only, so their weights stay at zero or above: Newton steps are taken
    in the weights that are free to move. ``slack`` is how far the prior may be off, as a share of it.
    """
    xp = xp.astype(np.float64)
    width, mean_p = xp.shape[1], xp.mean(axis=0)
    w = np.zeros(width)
    w[-1] = np.log(prior / (1 - prior))
    penalty = np.full(width, RIDGE)
    penalty[-1] = 0.0
    least = np.append(np.zeros(width - 1), -np.inf)

    def at(w: np.ndarray) -> tuple[float, bool, np.ndarray, np.ndarray]:
        loss, g, h = of_unlabelled(w)
        z = xp @ w
        of_p = prior * np.logaddexp(0, z).mean()
        negative = loss / n_u - of_p
        risk = prior * np.logaddexp(0, -z).mean() + max(0.0, negative) + float(penalty @ (w * w)) / 2
        # loss(+) - loss(-) of a positive is minus its margin
        return risk, negative >= -slack * of_p, g / n_u - prior * mean_p + penalty * w, h / n_u + np.diag(penalty + 1e-9)

    here = at(w)
    for _ in range(STEPS):
        free = np.flatnonzero((w > least) | (here[2] < 0))
        move = np.zeros(width)
        move[free] = -np.linalg.solve(here[3][np.ix_(free, free)], here[2][free])
        move *= min(1.0, 8.0 / max(np.abs(move).max(), 1e-9))
        for _ in range(HALVES):
            new = np.maximum(w + move, least)
            there = at(new)
            if there[1] and there[0] <= here[0]:
                break
            move = move / 2
        else:
            break
        gain, w, here = here[0] - there[0], new, there
        if gain < SETTLED * abs(here[0]):
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", positives: int = POSITIVES, parts: int = 5, remainder: int = 0) -> Model:
    """Fitted on a bounded sample of labelled positives and all texts outside the held-out fold."""
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    known = training_labels(labels, label, 2**31 - 1, parts, remainder)
    count = known.agg(F.sum((F.col("label") > 0).cast("long")).alias("p"), F.count("*").alias("n")).first()
    if not count.p:
        return nothing
    sampled = bounded(known.where("label > 0"), "doc_id", positives)
    names, counts, rows = in_one_task(labelled_texts(docs, sampled), positive_flags)
    if not rows:
        return nothing
    texts = docs.where(~held_out("doc_id", parts, remainder)).select("text")
    unlabelled, n_u = unlabelled_counts(texts, names)
    prior = float(np.clip(count.p / count.n, 1e-4, 0.9))
    own = chosen(counts, len(rows), unlabelled, n_u, prior)
    kept = saved(patterns(texts, names[own]))
    places = np.full(len(names), -1)
    places[own] = np.arange(len(own))
    xp = presence([(at := places[r])[at >= 0] for r in rows], len(own))
    w = descend(xp, prior, lambda w: unlabelled_risk(kept, w), n_u, 3 * (count.p + 1) ** -0.5)
    release(kept)
    return Model(names[own], w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = shared.value.scores(batch.column(1))
        return pa.record_batch({"doc_id": batch.column(0), "score": pa.array(p), "predicted": pa.array(p >= 0.5).cast(pa.int32())})

    return map_chunks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.scores(batch.column(at)) < 0.5))

    return map_chunks(docs, run, docs.schema, column=text)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
