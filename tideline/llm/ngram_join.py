"""N-gram Jaccard join: universe-partition pigeonhole, exact.

Documents are sets of distinct shingles of some words (4 unless said otherwise);
two link when ``100 * |A & B| >= percent * |A | B|`` (85), that is when their
symmetric difference D is at most ``(100 - percent) * (|A| + |B|) / (100 + percent)``.

* Exact copies of a set are one class from the start. Classes are told apart by two
  independent 64-bit sums of their shingles and their size: where the first alone
  coincides (some hundred times among 10**11 texts), the others are numbered anew.
* Sizes fall into bands. A band's scheme hashes the shingle universe into
  segments whose budgets add up to more than the largest D that linked members
  can have (H): a segment of budget 1 is matched by equal subsets, one of budget
  2 by equal subsets or subsets that are one deletion apart (its one-deletion
  neighbourhood is indexed). By the pigeonhole principle a linked pair agrees in
  a segment. A class is indexed in its own band's scheme, and in the next lower
  one if a partner may be there.
* How budgets are allocated to segments is chosen per band by cost: rows indexed
  against accidental pairs expected from the number of classes in the band.
* ``spare`` budget beyond H + 1 lets a class leave out as many empty segments,
  which would match any other class's empty ones: the pigeonhole still holds.

Links only matter for connected components, so pairs are verified lazily. Buckets
with the same members count once. First each class meets the first one of its
buckets; then the members of buckets of two that are not connected yet; then, for as many rounds as pay, the
classes of buckets that still hold several components meet an anchor drawn anew;
at last, whatever buckets still hold several components are compared in full,
members of different components only. Pairs are first held against odd sketches
(parities of hashed shingle counts: the number of differing parities is a lower
bound of D, so nothing is lost), and what passes is verified on the sets. Large
buckets are compared in blocks, a pair of blocks a task. No bucket is collected
whole and none is capped.

A signature or bucket that many classes share is summed up by minimum, maximum and
xor, all combined before the shuffle, and met again by a join that adaptive
execution splits; no window or list holds a bucket's rows together.

Shingles are compared by 64-bit hashes.

Defined cases: a null text, or one without words, has an empty set and links with
nothing; a text with fewer than 4 words has its whole sequence as one shingle.
Repeated rows are one class, so they are linked and returned once each (unless
empty). Null ids are returned with their size and the component of their class.
Only id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tideline.llm.arrowtext import SPACE_WORD, Chunk, combine, give_back, map_chunks, mix
from tideline.llm.common import BROADCAST_ROWS, cleared, gathered, release, saved, small, table
from tideline.llm.components import labelled, merged

SHINGLE = 4
#: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Rounds of drawn anchors go on while one links at least this share of the classes that met an anchor; then comes full comparison.
ANCHORS_PAY = 0.005
#: Anchors that a class meets in one round, of those of its buckets.
ANCHORS = 6
#: Rows of one block when a bucket is compared, and cost of a row indexed in accidental pairs.
BLOCK, ROW_COST = 1024, 4.0
#: Parity bits of an odd sketch per shingle of the band's first size.
SKETCH_BITS = 2
#: First buckets of a class that its rows name, so that two classes are compared to an end in the first they share.
NAMED = 8
#: Sets or sketches that are broadcast come to so many bytes at most.
BROADCAST_BYTES = 16 << 20
#: Bits of the map by which signatures of a single class are left out before the second shuffle.
MOST_BITS = 1 << 27
_U = np.uint64


def most_apart(a, b, percent: int = PERCENT):
    """The largest symmetric difference that sets of these sizes may have and link."""
    return (100 - percent) * (a + b) // (100 + percent)


@dataclass(frozen=True)
class Scheme:
    band: int
    low: int
    high: int  # sizes low .. high - 1 are the band's own
    exact: int  # segments of budget 1
    deletion: int  # segments of budget 2
    spare: int
    percent: int = PERCENT

    @property
    def budget(self) -> int:
        return self.exact + 2 * self.deletion

    @property
    def words(self) -> int:
        """64-bit words of this band's odd sketches."""
        return -(-SKETCH_BITS * self.low // 64)


def bands(most: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(low, high) of all bands up to sets of ``most`` shingles; below the first there is no linked pair but equal sets.

    A band's sizes span the square of what linked sets may differ by.
    """
    low = next(n for n in range(1, 1000) if most_apart(n, 100 * n // percent, percent) >= 1)
    out = []
    while low <= most:
        high = max(low + 1, math.floor(low * (100 / percent) ** 2))
        out.append((low, high))
        low = high
    return out


def allocate(band: int, low: int, high: int, classes: int, percent: int = PERCENT) -> Scheme:
    """The cheapest division of the needed budget among segments for so many classes."""
    top = high - 1
    need = most_apart(top, 100 * top // percent, percent) + 1
    size = (low + top) / 2
    best: tuple[float, Scheme] | None = None
    for spare in (0, 1, 2, 3):
        total = need + spare
        for deletion in sorted({0, 1, total // 4, total // 2}):
            exact = total - 2 * deletion
            if exact < 0 or deletion < 0:
                continue
            mean = size / total
            rows = exact + deletion * (2 * mean + 1)
            empty = math.exp(-mean)
            p = exact * empty  # expected empty segments; more than are spared happen with about this chance
            kept = 1 - sum(math.exp(-p) * p**k / math.factorial(k) for k in range(spare + 1))
            lone = (mean * empty) ** 2 * 1e-3  # equal by one frequent shingle
            pairs = classes / 2 * (exact * (kept * empty**2 + lone) + deletion * math.exp(-2 * mean) * (1 + 2 * mean) ** 2)
            cost = ROW_COST * rows + pairs
            if best is None or cost < best[0]:
                best = (cost, Scheme(band, low, high, exact, deletion, spare, percent))
    return best[1]


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """For each document its sorted distinct shingle hashes."""
    chunk = Chunk(texts, lower=True)
    words = chunk.words(SPACE_WORD)
    hashes, at = words.windows(size)
    cuts = np.searchsorted(at, words.first)
    out = []
    for i in range(chunk.n):
        n = words.per_doc[i]
        if 0 < n < size:
            first = words.first[i]
            out.append(mix(combine([words.hash[first + k : first + k + 1] for k in range(n)]) + _U(n)))
        else:
            out.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
    return out


def class_of(s: np.ndarray, moved: dict[int, int] | None = None) -> tuple[int, int]:
    """Number of the class of equal sets, and the check that tells classes of one number apart.

    ``moved`` has the numbers that more than one class came to, and the check of the
    one that keeps it; the others are known by their checks.
    """
    both = np.array([s.sum(dtype=_U), mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)])
    cls = int(combine([both[:1], both[1:] + _U(len(s))]).view(np.int64)[0])
    check = int(combine([both[1:] ^ _U(0x2545F4914F6CDD1D), both[:1], np.array([len(s)], _U)]).view(np.int64)[0])
    return (check if moved and moved.get(cls, check) != check else cls), check


def signatures(s: np.ndarray, scheme: Scheme) -> np.ndarray:
    """What a set is indexed under in a scheme."""
    total, exact = scheme.budget, scheme.exact
    place = mix(s + _U(0x632BE59BD9B4E019))
    slot = ((place >> _U(32)) * _U(total) >> _U(32)).astype(np.int64)
    segment = np.where(slot < exact, slot, exact + (slot - exact) // 2)
    n = exact + scheme.deletion
    value = mix(s ^ _U(0x9FB21C651E98DF25))
    sums = np.zeros(n, _U)
    np.add.at(sums, segment, value)
    salt = mix(np.arange(n, dtype=_U) + _U((scheme.band + 1) << 32))
    filled = np.bincount(segment, minlength=n)
    keep = np.ones(n, bool)
    empty = np.flatnonzero(filled[:exact] == 0)
    if len(empty) <= scheme.spare:
        keep[empty] = False
    out = [mix(sums + salt)[keep]]
    if scheme.deletion:
        own = np.flatnonzero(segment >= exact)
        out.append(mix(sums[segment[own]] - value[own] + salt[segment[own]]))
    return np.concatenate(out)


def schemes_of(n: int, schemes: list[Scheme]) -> list[Scheme]:
    """The schemes that a set of ``n`` shingles is indexed in."""
    if not schemes or n < schemes[0].low:
        return []
    k = bisect.bisect_right(schemes, n, key=lambda x: x.low) - 1
    partner = -(-schemes[k].percent * n // 100)  # smallest size that may link
    return [schemes[k], *([schemes[k - 1]] if k and partner < schemes[k].low else [])]


def sketch(s: np.ndarray, words: int) -> np.ndarray:
    """Parities of how many shingles hash to each bit."""
    bit = (mix(s ^ _U(0xD1342543DE82EF95)) >> _U(32)) * _U(64 * words) >> _U(32)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(_U)


def folded(sk: np.ndarray) -> np.ndarray:
    """A sketch of about half the bits: parities that were added up in pairs, so they still differ in no more places than the sets."""
    half = len(sk) // 2
    return np.concatenate([sk[:half] ^ sk[half : 2 * half], sk[2 * half :]])


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link."""
    if not len(a) or not len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int(np.count_nonzero(b[at] == a))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def documents_to_classes(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, cls, chk); the last two are null for empty sets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), size)
        cls, chk = zip(*[class_of(s) if len(s) else (None, None) for s in sets], strict=True)
        return pa.record_batch({"doc_id": batch.column(0), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "cls": pa.array(cls, pa.int64()), "chk": pa.array(chk, pa.int64())})

    return map_chunks(docs, run, "doc_id long, n_shingles long, cls long, chk long")


def bit_of(sigs: np.ndarray, bits: int) -> np.ndarray:
    """Places of signatures in a map of ``bits`` (a power of two)."""
    return sigs.view(np.int64) & (bits - 1)


def marked(common: DataFrame, n: int) -> np.ndarray:
    """A map of bits, set for all of ``n`` stored signatures and few others: what isn't set is none of them."""
    bits = min(MOST_BITS, 1 << max(16, (64 * n).bit_length()))
    at = F.col("sig").bitwiseAND(F.lit(bits - 1))
    got = common.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(sig & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(bits >> 6, np.int64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy()
    return words


def indexed(docs: DataFrame, schemes: list[Scheme], size: int, moved: dict[int, int], wanted: np.ndarray | None = None) -> DataFrame:
    """(sig, cls) of every class; a slice of a task emits a class once, however many copies it reads.

    With a map of bits, only signatures that are set in it.
    """
    shared = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sigs, classes, seen = [], [], set()
        for s in shingle_sets(batch.column(1), size):
            own = schemes_of(len(s), schemes)
            if own and (cls := class_of(s, moved)[0]) not in seen:
                seen.add(cls)
                for scheme in own:
                    got = signatures(s, scheme)
                    if shared is not None:
                        at = bit_of(got, len(shared.value) << 6)
                        got = got[(shared.value[at >> 6] >> (at & 63) & 1).astype(bool)]
                    sigs.append(got), classes.append(np.full(len(got), cls))
        if not sigs:
            return None
        return pa.record_batch({"sig": pa.array(np.concatenate(sigs).view(np.int64)), "cls": pa.array(np.concatenate(classes))})

    return map_chunks(docs, run, "sig long, cls long")


def class_sets(docs: DataFrame, wanted: DataFrame, schemes: list[Scheme], size: int, moved: dict[int, int]) -> DataFrame:
    """(cls, n, band, s, sk, sk_low, half, half_low) of the wanted (doc_id, cls): the set, its sketches for its own and the lower band, and those folded.

    A repeated row gives its class's row again, which does no harm: links are a set.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for cls, s in zip(batch.column(2).to_pylist(), shingle_sets(batch.column(1), size), strict=True):
            if len(s) and class_of(s, moved)[0] == cls:  # another text under the same id is another class
                own = schemes_of(len(s), schemes)
                sketches = [sketch(s, x.words) for x in own]
                lower = None if len(own) < 2 else sketches[1]
                rows.append((cls, len(s), own[0].band, s.tobytes(), *(x if x is None else x.tobytes() for x in (sketches[0], lower, folded(sketches[0]), lower if lower is None else folded(lower)))))
        kinds = (pa.int64(), pa.int64(), pa.int32(), *5 * [pa.binary()])
        columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["cls", "n", "band", "s", "sk", "sk_low", "half", "half_low"])

    return map_chunks(docs.join(small(wanted), "doc_id").select("doc_id", "text", "cls"), run, "cls long, n long, band int, s binary, sk binary, sk_low binary, half binary, half_low binary")


def light(df: DataFrame, weight: Column) -> DataFrame:
    """``df`` marked for broadcast if its rows, of ``weight`` bytes each, are counted to come to ``BROADCAST_BYTES`` at most."""
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0] <= BROADCAST_BYTES else df


def may_link(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored (a, b), a < b, whose sizes and sketches allow a link.

    Sizes and bands are looked at first. Of what is left only the sketch of the lower
    one of the two bands travels, and that of the side with fewer classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny, low = (batch.column(k).to_numpy() for k in range(2, 5))
            keep = np.zeros(batch.num_rows, bool)
            for band in np.unique(low):  # whose sketches have one size
                i = np.flatnonzero(low == band)
                a, b = (np.frombuffer(b"".join(batch.column(k).take(pa.array(i)).to_pylist()), _U).reshape(len(i), -1) for k in (5, 6))
                keep[i] = np.bitwise_count(a ^ b).sum(axis=1) <= most_apart(nx[i], ny[i], percent)
            yield pa.record_batch({c: pc_of(batch.column(0), batch.column(1)).filter(pa.array(keep)) for c, pc_of in (("a", pc.min_element_wise), ("b", pc.max_element_wise))})
        give_back()

    n_pairs = pairs.count()
    few = F.broadcast if n_pairs <= BROADCAST_ROWS else lambda df: df
    of = lambda c: sets.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("band").alias(f"band_{c}"))
    sized = of("b").join(few(of("a").join(few(pairs.select("a", "b")), "a")), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).where("abs(band_a - band_b) <= 1")
    bytes_of = lambda n: F.coalesce(F.sum(F.col(n) * SKETCH_BITS / 8 + 64), F.lit(0.0))
    watch = Observation()
    sized = saved(gathered(sized.select("a", "b", "n_a", "n_b", F.least("band_a", "band_b").alias("low")), n_pairs), watch, a=bytes_of("n_a"), b=bytes_of("n_b"))
    weight = watch.get
    if min(weight.values()) > BROADCAST_BYTES:  # else it is small enough however often a class is in it
        ends = [sized.select(F.lit(c).alias("end"), F.col(c).alias("cls"), F.col(f"n_{c}").alias("n"), "low") for c in "ab"]
        weight = {r.end: r.bytes for r in ends[0].unionByName(ends[1]).distinct().groupBy("end").agg(bytes_of("n").alias("bytes")).collect()}
    x, y = sorted("ab", key=lambda c: -weight[c])
    ordered = sized.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(f"n_{x}").alias("nx"), F.col(f"n_{y}").alias("ny"), "low")
    sketches = lambda c: sets.select(F.col("cls").alias(c), F.col("band").alias(f"band_{c}"), F.col("sk").alias(f"own_{c}"), F.col("sk_low").alias(f"lower_{c}"))
    lower = lambda c: F.expr(f"if(band_{c} = low, own_{c}, lower_{c})").alias(f"sk_{c}")
    # of a class that has pairs in two bands both sketches travel, as rows of their own
    of_x = sketches("x").join(few(ordered), "x").select("x", "y", "nx", "ny", "low", lower("x")).where("sk_x is not null")
    of_y = sketches("y").join(few(ordered.select("y", "low").distinct()), "y").select("y", "low", lower("y")).where("sk_y is not null")
    light = F.broadcast if weight[y] <= BROADCAST_BYTES else lambda df: df
    return of_x.join(light(of_y), ["y", "low"]).select("x", "y", "nx", "ny", "low", "sk_x", "sk_y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) that link. The first one's set goes with the pair to where the second one's is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        give_back()

    left = saved(gathered(may_link(pairs, sets, percent).distinct(), pairs.count()))
    few = F.broadcast if left.count() <= BROADCAST_ROWS else lambda df: df
    of_a = sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")).join(few(left), "a")
    of_b = light(sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")).join(few(left.select("b")), "b", "left_semi"), F.col("nb") * 8 + 96)
    return of_a.join(of_b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def across(members: DataFrame, rows: int, sets: DataFrame, most: int, percent: int) -> DataFrame:
    """(a, b, more): pairs of different components in one bucket that sketches can't rule out.

    ``members`` is (bid, cls, comp) of buckets with several components, ``rows`` of them. For a class
    and a foreign component the ``most`` closest are returned; ``more`` marks pairs
    of which further ones were left for a later round.

    A bucket is of one scheme, so its members are of that scheme's band or the next
    one, and all have a sketch of the lowest band among them: only that one travels,
    folded; :func:`may_link` holds the pairs it passes against the whole ones.
    """
    few = F.broadcast if rows * NAMED <= BROADCAST_ROWS else lambda df: df
    banded = sets.select("cls", "band").join(few(members), "cls")
    size = banded.groupBy("bid").agg(F.count("*").alias("rows"), F.min("band").alias("least"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    dealt = (
        banded.join(few(size), "bid")
        .where("band <= least + 1")
        .withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bid", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "cls", "comp", F.expr("band = least").alias("own"))
    )
    # a class is in as many buckets as its scheme has segments at most
    named = members.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("bid")), 1, NAMED).alias("named"))
    about = sets.select("cls", F.col("n").cast("int").alias("n"), "half", "half_low").join(few(named), "cls")
    rows = dealt.join(about, "cls").withColumn("sk", F.expr("if(own, half, half_low)")).where("sk is not null")
    # of the named buckets only those before this one are looked at
    rows = rows.select("bid", "x", "y", "mine", "cls", "comp", "n", "sk", F.expr("filter(named, b -> b < bid)").alias("earlier")).repartition("bid", "x", "y").sortWithinPartitions("bid", "x", "y")

    def compare(x, y, mine, cls, comp, n, sketches, earlier) -> list[tuple[int, int, bool]]:
        out = []
        earlier = [set(names) for names in earlier]
        for i in range(len(cls) - 1):
            rest = np.arange(i + 1, len(cls))
            rest = rest[comp[rest] != comp[i]]
            if x != y:  # pairs within a block belong to that block's own task
                rest = rest[mine[rest] != mine[i]]
            small, large = np.minimum(n[rest], n[i]), np.maximum(n[rest], n[i])
            rest = rest[100 * small >= percent * large]
            if not len(rest):
                continue
            apart = np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1)
            passed = apart <= most_apart(n[rest], n[i], percent)
            rest, apart = rest[passed], apart[passed]
            # what shares an earlier bucket with this class is answered for there
            first = np.array([earlier[i].isdisjoint(earlier[j]) for j in rest], bool)
            rest, apart = rest[first], apart[first]
            for c in np.unique(comp[rest]):
                of = np.flatnonzero(comp[rest] == c)
                near = of[np.argsort(apart[of], kind="stable")[:most]]
                for j in rest[near]:
                    a, b = sorted((int(cls[i]), int(cls[j])))
                    out.append((a, b, len(of) > most))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(t: pa.Table) -> pa.RecordBatch:
            mine, cls, comp, n = (t[c].to_numpy() for c in ("mine", "cls", "comp", "n"))
            sketches = np.frombuffer(b"".join(t["sk"].to_pylist()), _U).reshape(len(cls), -1)
            got = set(compare(*(t[c][0].as_py() for c in ("x", "y")), mine, cls, comp, n.astype(np.int64), sketches, t["earlier"].to_pylist()))
            a, b, more = zip(*sorted(got), strict=True) if got else ((), (), ())
            return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "more": pa.array(more, pa.bool_())})

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    key = tuple(keys[lo])
                    if key != last and held:
                        yield answer(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(lo, hi - lo))
                    last = key
        if held:
            yield answer(pa.Table.from_batches(held))
        give_back()

    return rows.mapInArrow(run, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def classes_of(known: DataFrame) -> DataFrame:
    """(cls, rep, n, c0, c1): a class's smallest id, its size, and the smallest and largest check under its number."""
    return known.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.min("chk").alias("c0"), F.max("chk").alias("c1"))


def shared_buckets(docs: DataFrame, schemes: list[Scheme], size: int, moved: dict[int, int]) -> DataFrame:
    """(bid, cls, low, size) of the classes of every bucket with at least two; low is the smallest of them.

    A bucket is known by its members: pairs of near copies share many, which count once.
    """
    rows = indexed(docs, schemes, size, moved)
    common = saved(rows.groupBy("sig").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("sig", "low"))
    cleared(docs.sparkSession)
    n = common.count()
    few = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    members = saved(indexed(docs, schemes, size, moved, marked(common, n)).join(few(common), "sig").distinct())
    cleared(docs.sparkSession)
    kinds = members.groupBy("sig").agg(F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.hash("cls")).alias("y"), F.count("*").alias("size"))
    buckets = saved(members.join(few(kinds), "sig").select(F.xxhash64("x", "y", "low", "size").alias("bid"), "cls", "low", "size").distinct())
    release(common, members)
    return buckets


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document, for shingles of ``size`` words and ``percent`` of the union."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = saved(documents_to_classes(docs, size))
    watch = Observation()
    classes = saved(classes_of(known), watch, most=F.max("n"), moved=F.sum(F.expr("if(c0 < c1, 1, 0)")))
    seen = watch.get
    moved = {}
    if seen["moved"]:
        moved = {r.cls: r.c0 for r in classes.where("c0 < c1").select("cls", "c0").collect()}  # next to none, see above
        keeps = docs.sparkSession.createDataFrame(list(moved.items()), "cls long, keeps long")
        known = known.join(F.broadcast(keeps), "cls", "left").withColumn("cls", F.when(F.col("keeps") != F.col("chk"), F.col("chk")).otherwise(F.col("cls"))).drop("keeps")
        classes = saved(classes_of(known))

    # the bands, their populations (a few dozen numbers) and their schemes
    limits = bands(int(seen["most"] or 0), percent)
    lows = F.array(*[F.lit(a) for a, _ in limits]) if limits else F.array().cast("array<int>")
    per_band = {r.band: r["count"] for r in classes.withColumn("band", F.size(F.filter(lows, lambda x: x <= F.col("n"))) - 1).groupBy("band").count().collect()}
    schemes = [allocate(k, a, b, per_band.get(k, 0) + per_band.get(k + 1, 0), percent) for k, (a, b) in enumerate(limits)]

    buckets = shared_buckets(docs, schemes, size, moved)
    candidates = saved(buckets.select("cls").distinct().join(classes.where("rep is not null").select("cls", F.col("rep").alias("doc_id")), "cls"))
    sets = saved(class_sets(docs, candidates, schemes, size, moved))
    others = buckets.where("low < cls")
    stars = others.groupBy(F.col("cls").alias("b")).agg(F.min("low").alias("a")).select("a", "b")
    twos = others.where("size = 2").select(F.col("low").alias("a"), F.col("cls").alias("b"))
    labels = candidates.select(F.col("cls").alias("node"), F.col("cls").alias("label"))
    for pairs, first in ((stars, True), (twos.distinct(), False)):  # the second only where the first has not settled it
        cleared(docs.sparkSession)
        pairs = saved(pairs)
        apart = pairs if first else saved(labelled(pairs, labels))
        links = saved(gathered(verified(apart, sets, percent), apart.count()))
        cleared(docs.sparkSession)
        labels = merged(labels, links)

    members, most_each, turn, drawn = buckets.where("size > 2").select("bid", "cls"), 8, 0, ANCHORS_PAY <= 1
    n_members = members.count()
    unsettled = None  # after a full comparison, the components between which pairs were left
    while True:
        turn += 1
        tagged = members.select("bid", "cls").join(small(labels).select(F.col("node").alias("cls"), F.col("label").alias("comp")), "cls")
        if unsettled is not None:
            tagged = tagged.join(small(unsettled), "comp", "left_semi")
        draw = F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), F.col("cls").alias("anchor"), F.col("comp").alias("anchor_comp")))
        open_ = saved(gathered(tagged.groupBy("bid").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), draw.alias("draw")).where("c0 < c1").select("bid", "draw.*"), n_members))
        watch = Observation()
        before, members = members, saved(gathered(tagged.join(small(open_), "bid"), n_members), watch, rows=F.count(F.lit(1)))
        release(before, open_)
        cleared(docs.sparkSession)  # what follows writes the most
        n_members = watch.get["rows"]
        if not n_members:
            break
        met = Observation()
        if drawn:
            # a class is in as many buckets as its scheme has segments at most
            some = F.slice(F.array_sort(F.collect_set(F.struct("h", "anchor"))), 1, ANCHORS)
            apart = members.where("comp <> anchor_comp").groupBy("cls").agg(some.alias("some")).select("cls", F.explode("some.anchor").alias("anchor"))
            pairs = saved(gathered(apart.select(F.least("cls", "anchor").alias("a"), F.greatest("cls", "anchor").alias("b")).distinct(), n_members), met, rows=F.count(F.lit(1)))
        else:
            pairs = saved(gathered(across(members.select("bid", "cls", "comp"), n_members, sets, most_each, percent), n_members))
        watch = Observation()
        links = saved(gathered(verified(pairs, sets, percent), pairs.count()), watch, rows=F.count(F.lit(1)))
        cleared(docs.sparkSession)
        if watch.get["rows"]:
            labels = merged(labels, links)
        if drawn:
            drawn = watch.get["rows"] >= ANCHORS_PAY * met.get["rows"]
        else:
            left = labelled(pairs.where("more"), labels)
            watch = Observation()
            unsettled = saved(left.select(F.explode(F.array("la", "lb")).alias("comp")).distinct(), watch, rows=F.count(F.lit(1)))
            if not watch.get["rows"]:
                break
            most_each *= 16

    of_class = classes.join(small(labels).withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("label", "cls").alias("label"))
    least = of_class.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(least, "label").select("cls", "component_id")
    release(buckets, sets, links, members)
    return known.join(of_class, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of one document per component: the one with the smallest id.

    Rows without an id are not in any group and stay. Of several rows with the same id one stays.
    """
    key = next(x for k in range(len(docs.columns) + 1) if (x := f"_key{k}") not in docs.columns)
    dropped = small(saved(jaccard_components(docs, size=size, percent=percent).where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()))
    rows = docs.join(dropped, docs["doc_id"] == dropped[key], "left_anti")
    watch = Observation()
    again = saved(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("times")).where("times > 1").select(key), watch, rows=F.count(F.lit(1)))
    if not watch.get["rows"]:
        return rows
    repeated = small(again)
    # which one is settled by a minimum over hashes, combined before the shuffle, so an id that many rows have is no hot key
    whole = F.struct(*[F.col(c) for c in docs.columns])
    one = rows.join(repeated, rows["doc_id"] == repeated[key], "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias(key))
    return rows.join(repeated, rows["doc_id"] == repeated[key], "left_anti").unionByName(one.select(f"{key}.*"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same components in DuckDB's SQL, all pairs that share a shingle."""
    return r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS sh FROM w),
classes AS (SELECT list_sort(sh) AS sh, min(doc_id) AS c, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY ALL),
flat AS (SELECT c, n, unnest(sh) AS x FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM flat a JOIN flat b ON a.x = b.x AND a.c <> b.c GROUP BY 1, 2),
edges AS (SELECT a, b FROM pairs WHERE 100 * i >= 85 * (na + nb - i)),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(component_id, c, doc_id) AS component_id
FROM s LEFT JOIN classes ON len(s.sh) > 0 AND list_sort(s.sh) = classes.sh LEFT JOIN least ON least.a = classes.c"""
