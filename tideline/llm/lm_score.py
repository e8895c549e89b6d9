"""LM scoring of whole documents, beside an add-one unigram baseline.

Texts are encoded once and stored as 16-bit subword ids (of the lower-cased
text, whose bytes the ids give back). From the stored ids

1. two passes over all training documents count tokens and their neighbours, which
   give token classes;
2. one pass over all training documents counts words, and tokens after classes
   (:mod:`tideline.llm.attention`); both counts are combined before the shuffle;
3. the attention model is fitted on all windows of all training documents: weights
   to go on from come of windows drawn at one rate, every training document is in
   one group, each group goes on in a task of its own through each of its windows
   once, and the groups' weights are averaged, an embedding by how often each group
   met its token;
4. one pass scores every document in overlapping windows, and sums the baseline
   over the words above a count that at most ``FREQUENT`` reach, a table
   of bounded size; the few other words are joined with the full word counts.

Words are compared by 64-bit hashes.

Defined cases: a null or empty text has no word and one token, the end. Baseline and
model both predict the end, the model as an id of its own after the text's ids. A very
long text is encoded and scored whole. Without training documents all counts are 0 and
the model's weights are those it begins with; empty tables give empty results. Repeated
rows are scored, and learned from, one by one; null ids are not held out and pass
through; ties of counts fall on the same side; only id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import attention
from tideline.llm.arrowtext import SPACE_WORD, Chunk, give_back, map_chunks, mix, pieces
from tideline.llm.bpe import encoder
from tideline.llm.common import held_out, in_one_task, saved, table

VOCABULARY = "byte_bpe_50k"
#: The id after a text's last one, which no vocabulary has.
END = 50_257
#: Windows that one task fits on, about; a document is in one group, however long.
GROUP = 192_000
#: Least share of the windows that the weights all groups go on from are fitted on; as many as one group has, if they are more.
DRAWN = 0.0
#: Words whose counts every task holds, at most.
FREQUENT = 1 << 18
_ASCII_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def encoded(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, held_out, ids) of every row; rid is unique once this is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = encoder(VOCABULARY, "H").ids, END.to_bytes(2, "little")
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces(batch):
                got = ids([t.encode().translate(_ASCII_LOWER).decode() if t else "" for t in part.column(1).to_pylist()])
                got = [x + end for x in got]
                yield pa.record_batch({"rid": pa.array(np.arange(rid, rid + len(got))), "doc_id": part.column(0), "held_out": part.column(2), "ids": pa.array(got, pa.binary())})
                rid += len(got)
        give_back()

    return docs.mapInArrow(run, "rid long, doc_id long, held_out boolean, ids binary")


class Bytes:
    """Turns stored ids back into the bytes of texts."""

    def __init__(self) -> None:
        base = encoder(VOCABULARY, "H")
        by_id = {i: b for b, i in base.ranks.items()} | {i: s.encode() for s, i in base.special.items()}
        self.size = END + 1  # the end stands for no bytes
        parts = [by_id.get(i, b"") for i in range(self.size)]
        self.length = np.array([len(x) for x in parts])
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def texts(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        n = self.length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ids) else 0
        data = self.data[np.arange(total) + np.repeat(self.start[ids] - (ends - n), n)]
        offsets = np.concatenate([[0], ends])[first].astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


_bytes: list[Bytes] = []


def id_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, and where each document's start."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    ids = np.frombuffer(data, "<u2", (offs[-1] - offs[0]) // 2, offs[0]).astype(np.int64) if data is not None else np.zeros(0, np.int64)
    return ids, (offs - offs[0]) // 2


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, Chunk]:
    """All ids of a batch, where each document's start, and its texts."""
    if not _bytes:
        _bytes.append(Bytes())
    ids, first = id_arrays(column)
    return ids, first, Chunk(_bytes[0].texts(ids, first))


def corpus_counts(rows: DataFrame, cls: np.ndarray) -> DataFrame:
    """(kind, key, c) over training documents: word hashes (0), pair keys (1) and documents (2)."""
    shared = rows.sparkSession.sparkContext.broadcast(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        pairs = np.zeros((attention.HEAD + attention.TAIL + 1) * len(shared.value), np.int32)
        n_docs = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[begin], np.add.reduceat(counts, begin)

        def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(keys), 100_000):
                k, c = keys[a : a + 100_000], counts[a : a + 100_000]
                yield pa.record_batch({"kind": pa.array(np.full(len(k), kind, np.int32)), "key": pa.array(k.astype(np.int64)), "c": pa.array(c.astype(np.int64))})

        for batch in batches:
            for part in pieces(batch, "ids", 1 << 20):
                ids, first, chunk = unpack(part.column(0))
                n_docs += part.num_rows
                pairs += np.bincount(attention.pair_keys(ids, first, shared.value), minlength=len(pairs)).astype(np.int32) if len(ids) else 0
                held.append(np.unique(chunk.words(SPACE_WORD).hash.view(np.int64), return_counts=True))
                if len(held) == 16 or sum(len(k) for k, _ in held) > 2_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 1_000_000:  # bounded: what is counted so far goes on, the rest starts anew
                        yield from out(0, *held.pop())
        if held:
            yield from out(0, *merged())
        used = np.flatnonzero(pairs)
        yield from out(1, used, pairs[used])
        yield from out(2, np.zeros(1), np.array([n_docs]))

    return rows.where("not held_out").select("ids").mapInArrow(run, "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c"))


def summed(rows: DataFrame, size: int, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys (below ``size``) that ``keys_of`` gives over all training documents, and how often; added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.int64)
        for batch in batches:
            for part in pieces(batch, "ids", 1 << 20):
                keys, counts = np.unique(keys_of(*id_arrays(part.column(0))), return_counts=True)
                table[keys] += counts
        used = np.flatnonzero(table)
        for a in range(0, len(used), 100_000):
            yield pa.record_batch({"key": pa.array(used[a : a + 100_000]), "c": pa.array(table[used[a : a + 100_000]])})

    got = rows.where("not held_out").select("ids").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).toArrow()
    order = np.argsort(got["key"].to_numpy())
    return got["key"].to_numpy()[order], got["c"].to_numpy()[order]


def corpus_classes(rows: DataFrame, size: int, seed: int = 11) -> np.ndarray:
    """Classes of all tokens, from the neighbours they have in all training documents."""
    counts = np.zeros(size, np.int64)
    keys, c = summed(rows, size, lambda ids, first: ids)
    counts[keys] = c
    place = attention.head_places(counts)
    shared = rows.sparkSession.sparkContext.broadcast(place)
    keys, c = summed(rows, size * 2 * attention.HEAD, lambda ids, first: attention.neighbour_keys(ids, first, shared.value))
    return attention.classes(place, keys, c, np.random.default_rng(seed))


def drawn_windows(rows: DataFrame, size: int, share: float, groups: int) -> DataFrame:
    """(g, w): a share of the windows of every training document, each in a group; which ones follows from document and place."""
    width = 3 * attention.HALF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "ids", 1 << 20):
                ids, first = id_arrays(part.column(1))
                context, target, doc = attention.blocks(ids, first, size)
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                h = mix(part.column(0).to_numpy()[doc].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
                take = np.flatnonzero((h >> np.uint64(11)) < np.uint64(share * (1 << 53)))
                if len(take):
                    flat = np.ascontiguousarray(np.concatenate([context[take], target[take]], axis=1).astype("<i4"))
                    w = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), len(take), [None, pa.py_buffer(flat)])
                    yield pa.record_batch({"g": pa.array((h[take] % np.uint64(groups)).astype(np.int32)), "w": w.cast(pa.binary())})
        give_back()

    return rows.where("not held_out").select("rid", "ids").mapInArrow(run, "g int, w binary")


def _of_group(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and targets of the windows in a table, in an order that doesn't depend on how they came."""
    flat = np.frombuffer(b"".join(sorted(t["w"].to_pylist())), "<i4").reshape(-1, 3 * attention.HALF)
    return flat[:, : 2 * attention.HALF], flat[:, 2 * attention.HALF :]


def fitted_weights(rows: DataFrame, cls: np.ndarray, class_sum: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights fitted on every window of every training document; the driver gets one set of weights, whatever the number of groups."""
    size, dim = len(cls), attention.DIM
    total = rows.where("not held_out").agg(F.coalesce(F.sum(F.ceil(F.length("ids") / (2 * attention.HALF))), F.lit(0))).first()[0]
    share = min(1.0, max(DRAWN, GROUP / max(total, 1)))
    groups = max(1, -(-total // GROUP))
    start = attention.begin(cls, class_sum, np.random.default_rng(seed))
    windows = drawn_windows(rows, size, share, 1)
    base = in_one_task(windows, lambda t: attention.fitted(start, *_of_group(t), cls, seed))
    if groups == 1:  # it has met all windows
        return base
    names = [f"v{k}" for k in range(dim)]

    def go_on(t: pa.Table) -> pa.Table:
        ids, first = id_arrays(pa.array(sorted(t["ids"].to_pylist()), pa.large_binary()))  # in an order that doesn't depend on how they came
        context, target, _ = attention.blocks(ids, first, size)
        flat = attention.as_rows(attention.fitted(base, context, target, cls, seed + t["g"][0].as_py(), again=True))
        weight = np.full(len(flat), len(context), np.float64)
        weight[: size + 1] = np.bincount(np.where(context < 0, size, context).ravel(), minlength=size + 1)
        k = np.flatnonzero(weight)
        return pa.table({"k": pa.array(k), "n": pa.array(weight[k])} | {c: pa.array(flat[k, i].astype(np.float64) * weight[k]) for i, c in enumerate(names)})

    every = rows.where("not held_out").select(F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int").alias("g"), "ids")
    parts = every.groupBy("g").applyInArrow(go_on, "k long, n double, " + ", ".join(f"{c} double" for c in names))
    got = parts.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()
    mean = attention.as_rows(base).astype(np.float64)
    mean[got["k"].to_numpy()] = np.stack([got[c].to_numpy() for c in names], axis=1) / got["n"].to_numpy()[:, None]
    return attention.from_rows(mean, base)


def frequent(words: DataFrame, most: int) -> pa.Table:
    """The words whose count reaches a threshold that at most ``most`` words do; found from a histogram of some hundred rows."""
    level = F.floor(F.log2("c") * 8)
    left, least = most, 1 << 30
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        left -= r["count"]
        if left < 0:
            break
        least = r.level
    return words.where(level >= least).toArrow()


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 7, remainder: int = 2) -> DataFrame:
    """Baseline and model score of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", held_out("doc_id", parts, remainder))
    rows = saved(encoded(docs.select("doc_id", "text", "held_out")))

    size = END + 1
    cls = corpus_classes(rows, size)
    counts = saved(corpus_counts(rows, cls))
    pairs = counts.where("kind = 1").select("key", "c").toArrow()  # at most classes times vocabulary
    keys, pair_counts = pairs["key"].to_numpy(), pairs["c"].to_numpy()
    within, class_sum = attention.shares(cls, keys, pair_counts)
    model = attention.assembled(fitted_weights(rows, cls, class_sum), cls, within)
    words = counts.where("kind = 0").select(F.col("key").alias("h"), "c")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = int(counts.where("kind = 2").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    train_tokens, distinct = int(total.n) + ends, int(total.v) + (ends > 0)
    log_all = float(np.log10(train_tokens + distinct + 1))
    top = frequent(words, FREQUENT)
    order = np.argsort(top["h"].to_numpy())
    shared = spark.sparkContext.broadcast((model, top["h"].to_numpy()[order], top["c"].to_numpy()[order]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, hashes, counted = shared.value
        ids, first, chunk = unpack(batch.column(3))
        n = chunk.n
        context, target, doc = attention.blocks(ids, first, size)
        lp = model.log_probs(context, target).sum(axis=1, dtype=np.float64)
        lm = np.bincount(doc, lp, minlength=n) / np.log(10)
        w = chunk.words(SPACE_WORD)
        h, of = w.hash.view(np.int64), w.doc
        at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
        common = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
        base = np.bincount(of[common], np.log10(counted[at[common]] + 1.0), minlength=n) + np.log10(ends + 1.0)
        known = np.bincount(of[common], minlength=n) + (ends > 0)
        rare = np.bincount(of[~common], minlength=n)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)]), pa.int32()), pa.array(h[~common]))
        return pa.record_batch({"rid": batch.column(0), "doc_id": batch.column(1), "held_out": batch.column(2), "n_tokens": pa.array(w.per_doc + 1), "known": pa.array(known.astype(np.int64)), "base": pa.array(base), "score": pa.array(np.minimum(lm, 0.0)), "rare": lists})

    partly = saved(map_chunks(rows, run, "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>", column="ids"))
    rare = partly.select("rid", F.explode("rare").alias("h")).groupBy("rid", "h").agg(F.count("*").alias("times"))
    more = rare.join(words, "h").groupBy("rid").agg(F.sum("times").alias("known_more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("base_more"))
    # a word that training never saw adds log10(1) - log_all, which is counted with n_tokens
    return partly.join(more, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        "score",
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
