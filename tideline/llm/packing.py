"""Best-fit packing of tokenised documents, planned over a histogram of lengths.

1. One pass encodes documents, cuts them into pieces of at most ``capacity``
   ids and numbers the pieces of each length within their task; the result is
   written to shared storage, so that these numbers are fixed whatever happens to
   executors later.
2. The histogram of lengths (at most ``capacity`` rows whatever the corpus) goes
   to the driver, which runs best-fit decreasing over counts: sequences of equal
   room are one range, and equal pieces are placed in ranges at a time.
3. A piece's rank within its length is its number in its task plus the pieces of
   that length in earlier tasks (a running sum over a small table). The rank
   looks up its planned slot: sequence and offset. No piece is shuffled by
   length alone, so a length that a third of all pieces have is no hot key.

A document's pieces but the first are full; the first holds the rest.

Defined cases: a null or empty text is the end id alone, one piece of length 1.
Repeated rows are packed once each. Null ids are returned as null. Only id and
text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.arrowtext import pieces
from tideline.llm.bpe import encoder
from tideline.llm.common import saved, table

CAPACITY, END_ID, VOCABULARY = 1024, 2, "byte_bpe_50k"


@dataclass
class Plan:
    """Slot ranges, in order of (length, rank): ``per_bin`` pieces side by side in each of consecutive sequences."""

    length: np.ndarray
    rank: np.ndarray
    first_bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    n_bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks within them."""
        at = np.searchsorted(self.length << 48 | self.rank, length << 48 | rank, side="right") - 1
        k = rank - self.rank[at]
        return self.first_bin[at] + k // self.per_bin[at], self.offset[at] + k % self.per_bin[at] * length


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts: each piece goes where the least room is left that holds it."""
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, how many)
    slots, n_bins = [], 0

    def put(length: int, rank: int, first: int, bins: int, per_bin: int, room: int) -> None:
        slots.append((length, rank, first, per_bin, capacity - room))
        if room > per_bin * length:
            ranges[room - per_bin * length].append((first, bins))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for room in range(length, capacity + 1):
            while left and ranges[room]:
                first, bins = ranges[room].pop()
                per_bin = min(room // length, left)  # the room that stays is less yet, so the next of this length goes there too
                used = min(bins, left // per_bin)
                put(length, rank, first, used, per_bin, room)
                if used < bins:
                    ranges[room].append((first + used, bins - used))
                rank, left = rank + used * per_bin, left - used * per_bin
            if not left:
                break
        while left:
            per_bin = min(capacity // length, left)
            bins = left // per_bin
            put(length, rank, n_bins, bins, per_bin, capacity)
            n_bins, rank, left = n_bins + bins, rank + bins * per_bin, left - bins * per_bin
    slots.sort()
    columns = np.array(slots, dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, n_bins)


def encoded_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document, numbered by (task, nth) within their length. Save it before :func:`pack`."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in pieces(batch):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, got in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    got += end
                    n = len(got) // 4
                    at = 0
                    to = n % capacity or capacity
                    k = 0
                    while at < n:
                        own = got[4 * at : 4 * to]
                        row.append(i), piece.append(k), start.append(at), length.append(to - at), crc.append(zlib.crc32(own))
                        if keep_ids:
                            ids.append(own)
                        at, to, k = to, to + capacity, k + 1
                n = np.array(length, dtype=np.int64)
                order = np.argsort(n, kind="stable")
                ordered = n[order]
                nth = np.empty(len(n), np.int64)
                nth[order] = np.arange(len(n)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(n, minlength=capacity + 1)
                out = {"doc_id": part.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(n), "ids_crc32": pa.array(crc, pa.int64()), "task": pa.array(np.full(len(n), task, np.int64)), "nth": pa.array(nth)}
                yield pa.record_batch(out | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {}))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long" + ", ids binary" * keep_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(numbered: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``numbered`` with sequence_id and offset instead of (task, nth); its rows must be stored, not recomputed."""
    by_task = saved(numbered.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = numbered.sparkSession.sparkContext.broadcast(best_fit(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = numbered.join(first, ["task", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    kept = [c for c in numbered.columns if c not in ("task", "nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            bins, offset = plan.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bins), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    rows = ranked.select(*kept, "rank")
    schema = rows.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return rows.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from a packing that kept ids; a sequence is at most ``capacity`` ids, so no group is large."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x.ids)).alias("ids"))


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """Encode, store, plan and place."""
    return pack(saved(encoded_pieces(docs, capacity, end_id, vocabulary, keep_ids)), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
