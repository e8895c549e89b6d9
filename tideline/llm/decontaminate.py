"""Benchmark decontamination: documents that hold a passage close to a benchmark item.

A document is contaminated by an item if some part of its text is within
``APART`` of the item's length in edit distance (insertions, deletions and
substitutions of characters; A-Z lower-cased, any white space a space).

Search by CGK embedding: a random walk over a string emits the character under a
pointer and moves the pointer by a random bit that depends on step and
character. Strings at small edit distance emit sequences at small Hamming
distance, because after an edit the two walks fall into step again. Sampling a
few emitted characters is then a locality-sensitive hash for edit distance, and
repetitions with new walks reach the target recall: items are grouped by length,
and each group gets walks until it finds ``RECALL`` of its own passages edited to
the whole distance that ``APART`` allows (:func:`rehearsal`), at most ``MOST_WALKS``.
Windows of a document start at its words (and at content-defined places of very
long words); an item is hashed at each of its own such places, so a passage is
found by whichever stretch of it is least edited, wherever the passage starts.
Windows that agree with no item in the characters sampled so far stop walking.

Every candidate is verified exactly, by a bit-parallel dynamic program over the
item-sized part of the document it points to; before that, many at once are ruled
out by a lower bound from the item's runs of up to 64 characters (:func:`bounds`),
at first from a few of the runs. Candidates that point to neighbouring places are
one, and its distance is the least over all its surroundings.

Items of fewer than ``LEAST`` bytes are too short to walk on. They are found exactly:
of ``k + 1`` pieces of an item within ``k`` edits one is whole, so the places of all
pieces (found by one automaton) are its candidates.

The benchmark is searched in blocks of bounded size (broadcast); the documents
are read once a block and never shuffled.

Defined cases: null and empty texts hold nothing. Null or blank items are no evidence
and match nothing; those of fewer than 5 characters have no room for an edit and
match as they are. Equal items match separately. Repeated rows match each; null ids
pass through. Of equally close places the first counts. A very long text is searched
whole, in memory of a small multiple of its size. Only the named columns are read, so
others may have any name. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.arrowtext import LOWER, SPACE_WORD, Chunk, map_chunks, mix
from tideline.llm.common import table

APART = 0.2
LEAST = 16
#: By the least bytes of an item, descending: characters that a window's walk covers on average, and sampled characters.
SPANS = ((64, 12, 16), (32, 8, 9), (0, 5, 6))
#: Share of passages at distance ``APART`` that each group of items is to find; passages it is measured on; and walks at most.
RECALL, REHEARSED, MOST_WALKS = 0.985, 400, 64
#: Rehearsed passages are cut to so many characters; longer ones are found more surely.
LONGEST = 512
#: Characters of items that are searched for at once.
BLOCK_CHARS = 4_000_000
FOLD = LOWER.copy()
FOLD[~SPACE_WORD] = 0x20


@dataclass
class Walk:
    """One repetition: random bits per step and byte, the sampled steps, and the items' keys."""

    moves: np.ndarray  # [step, byte]
    steps: np.ndarray  # sampled, ascending
    partial: list[np.ndarray]  # after each sampled step, a bitmap (packed) of the keys that items have
    keys: np.ndarray  # sorted complete keys
    item: np.ndarray  # the item and offset that each key belongs to
    offset: np.ndarray


#: First bytes by which windows are told apart in :class:`Heads`.
HEAD = 5


class Heads:
    """Where windows start, those together that have their first ``HEAD`` bytes in common."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = np.append(data, np.zeros(HEAD, np.uint8))
        head = np.zeros(len(at), np.uint64)
        for k in range(HEAD):
            head |= data[at + k].astype(np.uint64) << np.uint64(8 * k)
        order = np.argsort(head)
        self.at, head = at[order], head[order]
        #: first[i] .. first[i + 1] are the windows of head i.
        self.first = np.append(np.flatnonzero(np.append(True, head[1:] != head[:-1])[: len(at)]), len(at))


@dataclass
class Index:
    ids: list
    texts: list[str]
    walks: list[Walk]
    #: The pieces of short items, each with its (item, offset in the item) pairs.
    short: dict[str, list[tuple[int, int]]] = field(default_factory=dict)

    def automaton(self) -> ahocorasick.Automaton:
        """Finds the pieces; built once in each worker."""
        if not hasattr(self, "_automaton"):
            self._automaton = ahocorasick.Automaton()
            for piece, places in self.short.items():
                self._automaton.add_word(piece, (len(piece), places))
            self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def pieces_of(item: str) -> list[tuple[str, int]]:
    """Pieces of a short item, of which one stands in any text within ``APART`` of it, and where each begins."""
    n = int(APART * len(item)) + 1
    cut = [len(item) * k // n for k in range(n + 1)]
    return [(item[a:b], a) for a, b in zip(cut, cut[1:], strict=False)]


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def _known(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys may be in a packed bitmap, as places in ``key``."""
    b = _bucket(key)
    return np.flatnonzero(bitmap[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & np.uint8(1))


def _walk(data: np.ndarray, at: np.ndarray, walk: Walk) -> np.ndarray:
    """Keys of the windows of items that start at ``at``; ``partial`` gets its bitmaps."""
    p = at.copy()
    key = np.zeros(len(at), np.uint64)
    walk.partial.clear()
    for step in range(int(walk.steps[-1]) + 1):
        c = data[p]
        if step == walk.steps[len(walk.partial)]:
            key = mix(key * np.uint64(257) + c + np.uint64(1))
            seen = np.zeros(1 << 18, bool)
            seen[_bucket(key)] = True
            walk.partial.append(np.packbits(seen, bitorder="little"))
        p += walk.moves[step][c]
    return key


def _search(data: np.ndarray, heads: Heads, walk: Walk) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the windows that may match, and where they start.

    Windows that begin alike are walked as one (``near``) until the walk leaves
    the bytes they have in common.
    """
    near = np.arange(len(heads.first) - 1)
    q = heads.at[heads.first[:-1]]
    key_q = np.zeros(len(q), np.uint64)
    at = p = np.zeros(0, np.int64)
    key = np.zeros(0, np.uint64)
    done = 0
    for step in range(int(walk.steps[-1]) + 1):
        if len(near) and step >= HEAD:
            begin = heads.at[heads.first[near]]
            out = q - begin >= HEAD
            if out.any():
                lo, n = heads.first[near[out]], heads.first[near[out] + 1] - heads.first[near[out]]
                new = heads.at[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
                at, key = np.concatenate([at, new]), np.concatenate([key, np.repeat(key_q[out], n)])
                p = np.concatenate([p, new + np.repeat((q - begin)[out], n)])
                near, q, key_q = near[~out], q[~out], key_q[~out]
        c, c_q = data[p], data[q]
        if step == walk.steps[done]:
            key, key_q = (mix(k * np.uint64(257) + x + np.uint64(1)) for k, x in ((key, c), (key_q, c_q)))
            keep, keep_q = (_known(walk.partial[done], k) for k in (key, key_q))
            at, p, key, c = at[keep], p[keep], key[keep], c[keep]
            near, q, key_q, c_q = near[keep_q], q[keep_q], key_q[keep_q], c_q[keep_q]
            done += 1
        p += walk.moves[step][c]
        q += walk.moves[step][c_q]
    lo, n = heads.first[near], heads.first[near + 1] - heads.first[near]  # walks that never left their heads
    new = heads.at[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))] if len(near) else at[:0]
    return np.concatenate([key, np.repeat(key_q, n)]), np.concatenate([at, new])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where windows start: words, and in words over 24 bytes also places chosen by the 4 bytes there."""
    long = np.flatnonzero(ends - starts > 24)
    if not len(long):
        return starts
    n = (ends - starts)[long] - 4
    inside = np.repeat(starts[long] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    gram = sum(data[inside + k].astype(np.uint64) << np.uint64(8 * k) for k in range(4))
    both = np.concatenate([starts, inside[mix(gram) % np.uint64(8) == 0]])
    both.sort(kind="stable")  # merges the two
    return both[np.append(True, both[1:] != both[:-1])]


def _prepared(texts: pa.Array) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """The chunk, its folded bytes (0 after each document, where walks stay) and the window starts."""
    chunk = Chunk(texts)
    words = chunk.words(SPACE_WORD)
    data = FOLD[chunk.data]
    data[chunk.start[1:] - 1] = 0
    return chunk, np.append(data, np.uint8(0)), anchors(data, words.starts, words.ends)


def edited(text: str, apart: float, rng: np.random.Generator, letters: str = "etaoinsrhdlu ") -> str:
    """``text`` after random edits, at the whole edit distance that ``apart`` allows."""
    most, out, todo = int(apart * len(text)), list(text), int(apart * len(text))
    while todo > 0:
        for _ in range(todo):
            at, kind, c = int(rng.integers(len(out))), int(rng.integers(3)), letters[int(rng.integers(len(letters)))]
            out[at : at + (kind < 2)] = [c, "", c][kind] and [c]
        todo = most - closest(text, "".join(out))[0]
    return "".join(out)


def rehearsal(texts: list[str], rng: np.random.Generator) -> tuple[list[str], list[str]]:
    """Items (a sample, cut to ``LONGEST``), and each one's passage at distance ``APART``."""
    own = [texts[j][:LONGEST] for j in rng.integers(0, len(texts), REHEARSED)]
    return own, [edited(t, APART, rng) for t in own]


def _windows(texts: list[str], span: int = 0) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk, its bytes, window starts and their texts; with ``span``, only windows that stay in their text or begin it."""
    chunk, data, at = _prepared(pa.array(texts, pa.string()))
    of = np.searchsorted(chunk.start, at, side="right") - 1
    if span:
        whole = (chunk.start[of + 1] - 1 - at >= span + span // 4) | (at == chunk.start[of])
        at, of = at[whole], of[whole]
    return chunk, data, at, of


def _found(walk: Walk, own: tuple, passages: tuple) -> np.ndarray:
    """Which passages share a key with their own item at about the same place."""
    (a, data_a, at_a, of_a), (b, data_b, at_b, of_b) = own, passages
    key_a = _walk(data_a, at_a, walk)
    key_b = _walk(data_b, at_b, walk)
    order = np.argsort(key_a)
    lo, hi = np.searchsorted(key_a[order], key_b, side="left"), np.searchsorted(key_a[order], key_b, side="right")
    n = hi - lo
    i = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
    j = np.repeat(np.arange(len(key_b)), n)
    apart = (at_a[i] - a.start[of_a[i]]) - (at_b[j] - b.start[of_b[j]])
    out = np.zeros(b.n, bool)
    out[of_b[j[(of_a[i] == of_b[j]) & (np.abs(apart) <= APART * b.n_bytes[of_b[j]])]]] = True
    return out


def build_index(items: list[tuple], seed: int = 7) -> Index:
    """Of (id, text) items; texts are folded here. Items of a group of lengths share their walks; shorter ones get more."""
    items = [(i, fold(t)) for i, t in items if t is not None]
    items = [(i, t) for i, t in items if t.strip(" ")]
    index = Index([i for i, _ in items], [t for _, t in items], [])
    rng = np.random.default_rng(seed)
    sizes = np.array([len(t.encode()) for t in index.texts], np.int64)
    for j in np.flatnonzero(sizes < LEAST):
        for piece, offset in pieces_of(index.texts[j]):
            index.short.setdefault(piece, []).append((int(j), offset))
    for k, (least, span, bits) in enumerate(SPANS):
        here = (sizes >= max(least, LEAST)) & (sizes < (SPANS[k - 1][0] if k else 1 << 62))
        groups = {}
        for g in np.unique(np.log2(sizes[here]) * 2 // 1):  # lengths within a factor of the square root of 2
            members = np.flatnonzero(here & (np.log2(sizes) * 2 // 1 == g))
            own, passages = rehearsal([index.texts[j] for j in members], rng)
            groups[g] = (members, _windows(own, span), _windows(passages), np.zeros(REHEARSED, bool))
        for _ in range(MOST_WALKS):
            groups = {g: x for g, x in groups.items() if x[3].mean() < RECALL}
            if not groups:
                break
            moves = rng.integers(0, 2, (2 * span, 256)).astype(np.int64)
            moves[:, 0] = 0
            edge = np.arange(bits + 1) * 2 * span // bits
            walk = Walk(moves, rng.integers(edge[:-1], edge[1:]), [], np.zeros(0), np.zeros(0), np.zeros(0))
            for _, own, passages, found in groups.values():
                found |= _found(walk, own, passages)
            members = np.sort(np.concatenate([x[0] for x in groups.values()]))
            chunk, data, at, of = _windows([index.texts[j] for j in members], span)
            key = _walk(data, at, walk)
            order = np.argsort(key)
            walk.keys, walk.item, walk.offset = key[order], members[of[order]], (at - chunk.start[of])[order]
            index.walks.append(walk)
    return index


def fold(text: str) -> str:
    """As documents are folded; characters stay characters."""
    return FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes().decode()


def closest(item: str, text: str) -> tuple[int, int]:
    """The least edit distance between ``item`` and any part of ``text``, and where that part ends (characters)."""
    n = len(item)
    match: dict[str, int] = {}
    for i, c in enumerate(item):
        match[c] = match.get(c, 0) | 1 << i
    ones, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = ones, 0, n
    best, where = n, 0
    for j, c in enumerate(text):
        eq = match.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & ones
        mh = up & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph, mh = ph << 1 & ones, mh << 1 & ones  # the first row is zero: a part may start anywhere
        up = mh | ~(xv | ph) & ones
        down = ph & xv
        if score < best:
            best, where = score, j + 1
    return best, where


def _codes(text: str) -> np.ndarray:
    """One byte a character; equal characters have equal ones."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    return (np.frombuffer(text.encode("utf-32-le"), np.uint32) & 0xFF).astype(np.int64)


def few(item: str, apart: float = APART) -> int:
    """So many of an item's runs are far from other texts by more than the item may be; unlike passages differ in some 36 of 64 characters."""
    return min(-(-len(item) // 64), int(apart * len(item)) // 36 + 1)


def bounds(pairs: list[tuple[str, str]], where: list[list[int]] | None = None) -> np.ndarray:
    """For each (item, text), a lower bound of the item's edit distance to any part of the text.

    The item is cut into runs of up to 64 characters; the least distances of the
    runs to any part of the text, in one machine word each, sum to the bound. With
    ``where`` a few of the runs must do, each at the part of the text where it can
    lie if the item begins between the two given places but for its edits.
    """
    match: dict[str, np.ndarray] = {}
    sizes: dict[str, np.ndarray] = {}
    begins: dict[str, np.ndarray] = {}
    for item in {item for item, _ in pairs}:
        n, m = len(item), -(-len(item) // 64)
        cut = np.arange(m + 1) * n // m
        of = np.repeat(np.arange(m), np.diff(cut))
        size = np.diff(cut)
        # runs stand in the high bits of their words; the bits below match anything at no cost
        own = np.repeat((np.uint64(1) << (64 - size).astype(np.uint64)) - np.uint64(1), 257).reshape(m, 257)
        np.bitwise_or.at(own, (of, _codes(item)), np.uint64(1) << (np.arange(n) - cut[of] + 64 - size[of]).astype(np.uint64))
        use = np.arange(f := few(item)) * m // f if where is not None else np.arange(m)
        match[item], sizes[item], begins[item] = own[use], size[use], cut[use]
    lane = np.repeat(np.arange(len(pairs)), [len(sizes[item]) for item, _ in pairs])
    flat = np.concatenate([match[item] for item, _ in pairs]).reshape(-1)
    score = np.concatenate([sizes[item] for item, _ in pairs]).astype(np.int64)
    parts = []
    for k, (item, t) in enumerate(pairs):
        codes, at = _codes(t), where[k] if where is not None else []
        most = int(APART * len(item))
        for begin, size in zip(begins[item].tolist(), sizes[item].tolist(), strict=True):
            parts.append(codes[max(0, at[0] + begin - most) : max(0, at[1] + begin + size + most)] if at else codes)
    text = np.full((len(lane), max(map(len, parts))), 256, np.int64)
    for row, codes in zip(text, parts, strict=True):
        row[: len(codes)] = codes
    text = np.ascontiguousarray(text.T)
    text += np.arange(len(lane)) * 257
    up, down, best = ~np.uint64(0) << (64 - score).astype(np.uint64), np.zeros(len(lane), np.uint64), score.copy()
    eq, xv, xh, ph, mh = (np.empty_like(up) for _ in range(5))
    p, m, last = ph.view(np.int64), mh.view(np.int64), np.empty_like(score)
    for at in text:
        np.take(flat, at, out=eq, mode="clip")
        np.bitwise_or(eq, down, out=xv)
        np.bitwise_and(eq, up, out=xh)
        xh += up
        xh ^= up
        xh |= eq
        np.bitwise_or(xh, up, out=ph)
        np.invert(ph, out=ph)
        ph |= down
        np.bitwise_and(up, xh, out=mh)
        score -= np.right_shift(p, 63, out=last)  # the highest bit is the run's last row
        score += np.right_shift(m, 63, out=last)
        np.minimum(best, score, out=best)
        np.left_shift(ph, 1, out=ph)
        np.left_shift(mh, 1, out=mh)
        np.bitwise_or(xv, ph, out=up)
        np.invert(up, out=up)
        up |= mh
        np.bitwise_and(ph, xv, out=down)
    return np.bincount(lane, best, len(pairs)).astype(np.int64)


#: Runs of items whose bounds are worked out at once, times characters of text.
LANES = 1 << 21


def candidates(texts: pa.Array, index: Index) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """The chunk, its folded bytes, and distinct (document, item, byte where the item would start, rounded) rows."""
    chunk, data, at = _prepared(texts)
    found = []
    heads = Heads(data, at)
    for walk in index.walks:
        key, start = _search(data, heads, walk)
        lo, hi = np.searchsorted(walk.keys, key, side="left"), np.searchsorted(walk.keys, key, side="right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        n = hi[hit] - lo[hit]
        which = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        place = start[np.repeat(hit, n)]
        doc = np.searchsorted(chunk.start, place, side="right") - 1
        begin = place - chunk.start[doc] - walk.offset[which]
        found.append(((doc * len(index.texts) + walk.item[which]) << 32) + (begin >> 5) + (1 << 31))
    keys = np.sort(np.concatenate([*found, np.zeros(0, np.int64)]))
    keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
    both, cell = keys >> 32, (keys & 0xFFFFFFFF) - (1 << 31)
    return chunk, data, np.stack([both // len(index.texts), both % len(index.texts), cell], axis=1)


def near(places: list[tuple], index: Index, apart: float, some: bool = False) -> list[tuple]:
    """The places (document, item, byte, text, where) that :func:`bounds` doesn't rule out."""
    keep: list[int] = []
    held: list[int] = []
    lanes = 0
    order = sorted(range(len(places)), key=lambda k: len(places[k][3]))
    for k in order:
        item, text = index.texts[places[k][1]], places[k][3]
        lanes += few(item) if some else -(-len(item) // 64)
        held.append(k)
        if lanes * len(text) >= LANES or k == order[-1]:
            least = bounds([(index.texts[places[j][1]], places[j][3]) for j in held], [places[j][4] for j in held] if some else None)
            keep += [j for j, x in zip(held, least.tolist(), strict=True) if x <= int(apart * len(index.texts[places[j][1]]))]
            held, lanes = [], 0
    return [places[k] for k in sorted(keep)]


def surroundings(chunk: Chunk, data: np.ndarray, rows: np.ndarray, index: Index, apart: float) -> list[tuple]:
    """(document, item, byte, text, where) around the cells of candidates; cells whose surroundings meet are one place.

    ``where`` has the first and last character of the text at which a candidate has the item begin.
    """
    high, higher = (np.concatenate([[0], np.cumsum(data >= b, dtype=np.int32)]) for b in (0x80, 0xE0))
    size, most, plain = (np.array(x, np.int64) for x in zip(*((len(t.encode()), int(apart * len(t)), t.isascii()) for t in index.texts), strict=True))
    doc, item, cell = rows.T
    same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (cell[1:] - cell[:-1] <= 1 + most[item[1:]] // 16)
    begins = np.flatnonzero(np.append(True, ~same))
    first, last = cell[begins], cell[np.append(begins[1:], len(rows)) - 1]
    doc, item = doc[begins], item[begins]
    a, b = chunk.start[doc], chunk.start[doc + 1] - 1
    first, begin_last = a + first * 32, a + last * 32 + 32  # bytes
    last = begin_last + size[item]
    lo, hi = np.maximum(a, first - 4 * most[item]), np.minimum(b, last + 4 * most[item])
    hi = np.maximum(hi, lo)
    widest = np.where((plain[item] > 0) & (high[lo] == high[hi]), 1, np.where(higher[lo] == higher[hi], 2, 4))  # bytes of a character
    lo, hi = np.maximum(a, first - widest * most[item]), np.minimum(b, last + widest * most[item])
    # characters before a byte; bytes may drift from characters by what edits change
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
    slack, end = (widest - 1) * most[item], len(data)
    first, last = chars[np.clip(first, 0, end)] - chars[lo] - slack, chars[np.clip(begin_last, 0, end)] - chars[lo] + slack
    places = []
    some = np.flatnonzero(hi > lo)
    for d, i, lo_, hi_, begin, *where in zip(*(x[some].tolist() for x in (doc, item, lo, hi, a, first, last)), strict=True):
        if part := data[lo_:hi_].tobytes().decode(errors="ignore"):
            while lo_ < hi_ and 0x80 <= data[lo_] < 0xC0:  # the rest of a character that the cut went through
                lo_ += 1
            places.append((d, i, lo_ - begin, part, where))
    return places


def short_places(chunk: Chunk, data: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, str]]:
    """(document, item, byte, text) around the pieces of short items."""
    find = index.automaton().iter
    for d in range(chunk.n):
        raw = data[chunk.start[d] : chunk.start[d + 1] - 1].tobytes()
        text = raw.decode()
        seen: set[tuple[int, int]] = set()
        for end, (n, places) in find(text):
            for item, offset in places:
                own = index.texts[item]
                most = int(APART * len(own))
                at = max(0, end + 1 - n - offset - most)
                if (item, at) not in seen:
                    seen.add((item, at))
                    yield d, item, at if len(raw) == len(text) else len(text[:at].encode()), text[at : at + len(own) + 2 * most + 1]


def matches(texts: pa.Array, index: Index, apart: float = APART) -> list[tuple[int, int, int, int, int]]:
    """(document, item, distance, start, end) of every contaminated document and item; bytes of the closest part's surroundings."""
    if not index.texts:
        return []
    chunk, data, rows = candidates(texts, index)
    places = []
    if len(rows):
        places = near(near(surroundings(chunk, data, rows, index, apart), index, apart, some=True), index, apart)
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for doc, item, lo, part in (*(x[:4] for x in places), *(short_places(chunk, data, index) if index.short else ())):
        known = out.get((doc, item), (1 << 30,))[0]
        if not known:
            continue
        text = index.texts[item]
        most, size = int(apart * len(text)), len(text.encode())
        distance, end = closest(text, part)
        if distance <= most and known > distance:
            stop = lo + len(part[:end].encode())
            out[doc, item] = (distance, max(0, stop - size - most), stop)
    return [(d, i, *x) for (d, i), x in sorted(out.items())]


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes over blocks of bounded size that together hold all items."""
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).toArrow()
        found = sorted(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield build_index(found)


SCHEMA = "doc_id long, item_id long, distance int, similarity double, start long, end long"


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item it holds: distance, similarity and the bytes where the passage is."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for index in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            index = shared.value
            got = matches(batch.column(1), index)
            doc, item, distance, start, end = ([x[k] for x in got] for k in range(5))
            near = [1 - d / len(index.texts[i]) for d, i in zip(distance, item, strict=True)]
            return pa.record_batch({"doc_id": batch.column(0).take(pa.array(doc, pa.int64())), "item_id": pa.array([index.ids[i] for i in item], pa.int64()), "distance": pa.array(distance, pa.int32()), "similarity": pa.array(near, pa.float64()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64())})

        rows = map_chunks(docs, run, SCHEMA)
        out = rows if out is None else out.unionByName(rows)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no benchmark passage."""
    at = docs.columns.index(text)
    for index in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            keep = np.ones(batch.num_rows, bool)
            keep[[x[0] for x in matches(batch.column(at), shared.value)]] = False
            return batch.filter(pa.array(keep))

        docs = map_chunks(docs, run, docs.schema, column=text)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
