"""Vectorised text primitives over the buffers of Arrow string columns.

Texts are handled as UTF-8 bytes, many documents at a time and never one
character at a time in Python. A :class:`Chunk` holds whole documents (never a
part of one) of about ``CHUNK_BYTES`` together, so memory is bounded by that
size or by a small multiple of the longest single document: its bytes, their
flags, and some numbers for each of its words. Whatever needs 64 bits for each
byte is worked out in blocks of ``CHUNK_BYTES``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are worked on at once in one Python worker.
CHUNK_BYTES = 1 << 20
_U64 = np.uint64


def lut(test: Callable[[int], bool]) -> np.ndarray:
    """A 256-entry table of ``test`` over byte values."""
    return np.array([test(b) for b in range(256)], dtype=bool)


#: Words ``[^\x20\x09-\x0D]+``.
SPACE_WORD = lut(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (of lower-cased text).
ALNUM_WORD = lut(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Lower-cases A-Z and nothing else.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wraps around on purpose)."""
    x = x ^ (x >> _U64(30))
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U64) * _U64(0xD1B54A32D192ED03))


#: Bytes of which the terms of span hashes are held at once; longer chunks are worked on in blocks.
BLOCK_BYTES = CHUNK_BYTES + (CHUNK_BYTES >> 2)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for one block and the place after it."""
    out = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(BLOCK_BYTES + 1, base, dtype=_U64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _prefix(data: np.ndarray) -> np.ndarray:
    """Sums of the terms of a block's bytes before each place."""
    sums = np.zeros(len(data) + 1, dtype=_U64)
    terms = _byte_values()[data]
    terms *= _powers()[0][: len(data)]
    np.cumsum(terms, out=sums[1:])
    return sums


class Chunk:
    """Some whole documents, one newline byte after each."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.fill_null("") if texts.null_count else texts
        texts = texts.cast(pa.large_string())
        n = len(texts)
        _, offsets, data = texts.buffers()
        offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and n else np.zeros(0, np.uint8)
        offs = offs - offs[0]
        self.n = n
        self.n_bytes = np.diff(offs)
        #: Start of each document in ``data``, then the end of all.
        self.start = offs + np.arange(n + 1)
        self.data = np.insert(raw, offs[1:], 0x0A)
        if lower:
            self.data = LOWER[self.data]
        self._sums: np.ndarray | None = None

    def count(self, flags: np.ndarray) -> np.ndarray:
        """For each document, its bytes that are flagged."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.start[1:]] - total[self.start[:-1]]

    def words(self, is_word: np.ndarray) -> Words:
        return Words(self, is_word)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes give equal hashes anywhere."""
        _, down = _powers()
        if len(self.data) <= BLOCK_BYTES:
            if self._sums is None:
                self._sums = _prefix(self.data)
            value = (self._sums[ends] - self._sums[starts]) * down[starts]
        else:
            value = (self._sums_at(ends) - self._sums_at(starts)) * down[starts % BLOCK_BYTES]
            value *= self._block_scale(_BASE_INVERSE)[starts // BLOCK_BYTES]
        return mix(value + (ends - starts).astype(_U64) * _U64(0x2545F4914F6CDD1D))

    def _block_scale(self, base: int) -> np.ndarray:
        """Powers of the base that the blocks of a long chunk begin with."""
        step, out = pow(base, BLOCK_BYTES, 1 << 64), [1]
        for _ in range(len(self.data) // BLOCK_BYTES):
            out.append(out[-1] * step & (1 << 64) - 1)
        return np.array(out, dtype=_U64)

    def _sums_at(self, places: np.ndarray) -> np.ndarray:
        """Sums of all terms before each of the places of a long chunk, block by block with the sum so far carried on."""
        rising = len(places) < 2 or bool((places[1:] >= places[:-1]).all())
        order = None if rising else np.argsort(places, kind="stable")
        at = places if order is None else places[order]
        got = np.empty(len(at), _U64)
        scale, carry = self._block_scale(_BASE), np.zeros(1, _U64)
        for k in range(len(scale)):
            begin = k * BLOCK_BYTES
            local = _prefix(self.data[begin : begin + BLOCK_BYTES])
            lo, hi = np.searchsorted(at, [begin, begin + BLOCK_BYTES])
            got[lo:hi] = carry + scale[k] * local[at[lo:hi] - begin]
            carry = carry + scale[k] * local[-1:]
        if order is None:
            return got
        out = np.empty_like(got)
        out[order] = got
        return out

    def spans(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal flagged runs."""
        edge = np.empty(len(flags) + 1, dtype=bool)
        if len(flags):
            edge[0], edge[-1] = flags[0], flags[-1]
            np.not_equal(flags[1:], flags[:-1], out=edge[1:-1])
        else:
            edge[0] = False
        at = np.flatnonzero(edge)
        return at[::2], at[1::2]


class Words:
    """The words of a chunk: byte spans, and for each document its share of them."""

    def __init__(self, chunk: Chunk, is_word: np.ndarray):
        self.chunk = chunk
        self.flags = is_word[chunk.data]
        self.starts, self.ends = chunk.spans(self.flags)
        #: first[i] .. first[i + 1] are the words of document i.
        self.first = np.searchsorted(self.starts, chunk.start)
        self.per_doc = np.diff(self.first)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.chunk.span_hash(self.starts, self.ends)
        return self._hash

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.chunk.n), self.per_doc)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words inside one document, and the index of each one's first word."""
        n = len(self.starts)
        if n < size:
            return np.zeros(0, _U64), np.zeros(0, np.int64)
        doc = self.doc
        inside = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
        del doc
        return combine(self.hash[inside + k] for k in range(size)), inside


def combine(parts: Iterable[np.ndarray]) -> np.ndarray:
    """One hash of an ordered list of hashes, taken one by one."""
    total: np.ndarray | int = 0
    for k, part in enumerate(parts):
        total += part * _U64((0xA0761D6478BD642F + 0xE7037ED1A0B428DA * k) & (2**64 - 1) | 1)
    return mix(total)


def hash_of_words(text: str, is_word: np.ndarray) -> np.ndarray:
    """Word hashes of one short text, as documents get them."""
    return Chunk(pa.array([text]), lower=True).words(is_word).hash


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose texts have about ``most`` bytes together."""
    n = batch.num_rows
    if not n:
        return
    text = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Hand memory that a task has freed back to the system: workers live on, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_chunks(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None], schema: str, column: str = "text") -> DataFrame:
    """``make`` applied to bounded slices of each partition; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column):
                out = make(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out
        give_back()

    return df.mapInArrow(run, schema)
