"""Operators against brute force, exact round trips, and held-out accuracy."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import MEDIUM, SMALL, duck_rows, spark_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tideline.llm import arrowtext, attention, common, components, decontaminate, langid, lm_score, ngram_join, packing, quality_gbt, quality_rules, token_counts, toxicity
from tideline.llm.arrowtext import ALNUM_WORD, SPACE_WORD, Chunk
from tideline.llm.bpe import Encoder
from tideline.llm.common import table
from tideline.llm.queries import ORACLE_SQL, QUERIES

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents").collect()}


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == duck_rows(ORACLE_SQL[name], SMALL)


# Text primitives


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \n\té漢|", max_size=30)), max_size=6))
def test_words(rows):
    for lut, pattern in ((SPACE_WORD, SPACE), (ALNUM_WORD, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))):
        chunk = Chunk(pa.array(rows, pa.string()), lower=True)
        w = chunk.words(lut)
        want = [x for t in rows for x in pattern.findall((t or "").translate(LOWER))]
        assert [chunk.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)] == want
        assert w.per_doc.tolist() == [len(pattern.findall((t or "").translate(LOWER))) for t in rows]
        same = collections.defaultdict(set)
        for word, h in zip(want, w.hash.tolist(), strict=True):
            same[word].add(h)
        assert all(len(x) == 1 for x in same.values()) and len({min(x) for x in same.values()}) == len(same)


# Tokens

PIECES = ["a", " ", "  ", "\n", "\t", "'re", "'s", "é", "²", "½", "٣", "中文", " hello", "World", "!!", "<|endoftext|>", "<|endof", "12", "_", "\x1c", "\x85", "ʰ", "́", "🙂", "'", "don't"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12))
def test_encoding_and_every_prefix(parts):
    text = "".join(parts)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_encoding_and_every_prefix, "lib") else test_encoding_and_every_prefix.lib
    test_encoding_and_every_prefix.lib = lib
    own = test_encoding_and_every_prefix.__dict__.setdefault("own", (Encoder("byte_bpe_50k"), token_counts.Counter()))
    assert np.frombuffer(own[0].ids([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
    want = [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    p = own[1].prefixes(text)
    assert p.count.tolist() == want and own[1].n_tokens(text) == want[-1] == p.upto(len(text))
    assert p.longest(2) == max(i for i, n in enumerate(want) if n <= 2)


def test_token_counts(spark, texts, library):
    for r in QUERIES["op3_token_counts"](spark, SMALL).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_truncation(spark, library):
    got = token_counts.truncated(table(spark, SMALL, "documents").limit(20), 50).collect()
    assert all(len(library.encode(r.text, add_special_tokens=False).ids) <= 50 for r in got)


# Packing


def check_packing(rows, ids, capacity):
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.length <= capacity and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    for own in by_bin.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_bin)


def test_packing(spark, texts, library):
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    bins = check_packing(QUERIES["op1_best_fit_packing"](spark, SMALL).collect(), ids, 1024)
    assert bins <= 1.02 * sum(map(len, ids.values())) / 1024 + 1


def test_packed_sequences_hold_their_ids(spark):
    packed = packing.best_fit_packing(table(spark, SMALL, "documents").limit(50), 256, keep_ids=True)
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_is_best_fit_decreasing(counts):
    plan = packing.best_fit(counts, 30)
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in room if r >= length]
            if fits:
                best = min(fits)
                room.remove(best)
                room.append(best - length)
            else:
                room.append(30 - length)
    assert plan.n_bins == len(room)
    pieces = [(n, k) for n, c in counts.items() for k in range(c)]
    if pieces:
        length, rank = np.array(pieces).T
        bins, offset = plan.place(length, rank)
        used = {(b, o + i) for b, o, n in zip(bins, offset, length, strict=True) for i in range(n)}
        assert len(used) == length.sum() and max(o for _, o in used) < 30


# Decontamination


def edit_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=20))
def test_closest_part(a, b):
    assert decontaminate.closest(a, b)[0] == edit_distance(a, b)


def test_planted_passages(spark, texts):
    items = {r.item_id: decontaminate.fold(r.text) for r in table(spark, SMALL, "benchmark").collect()}
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op2_decontamination"](spark, SMALL).collect()}
    folded = {d: decontaminate.fold(t) for d, t in texts.items()}
    assert {(d, i) for d, t in folded.items() for i, x in items.items() if x in t} <= set(got)
    for (d, i), r in got.items():
        assert edit_distance(items[i], folded[d].encode()[r.start : r.end].decode(errors="ignore")) == r.distance <= 0.2 * len(items[i])


def test_recall_of_edited_passages(spark, texts):
    rng = random.Random(2)
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    index = decontaminate.build_index(items)
    hosts = [t for t in texts.values() if len(t) < 3000]
    docs, truth = [], []
    for k in range(120):
        item, text = rng.choice(items)
        s = list(text)
        for _ in range(len(s) // 10):
            q = rng.randrange(len(s))
            s[q : q + 1] = rng.choice(["", "x", "yz"])
        w = hosts[k % len(hosts)].split(" ")
        at = rng.randrange(len(w) + 1)
        docs.append(" ".join([*w[:at], "".join(s), *w[at:]]))
        truth.append(item)
    found = {(d, index.ids[i]) for d, i, *_ in decontaminate.matches(pa.array(docs), index)}
    assert np.mean([(k, i) in found for k, i in enumerate(truth)]) >= 0.9
    clean = pa.array([" ".join(rng.sample("abcdefghijklmnop", 16)) for _ in range(50)])
    assert decontaminate.matches(clean, index) == []


@pytest.mark.parametrize("apart", [0.1, 0.15, 0.2])
def test_recall_at_distance_by_item_length(spark, apart):
    items = sorted(((r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()), key=lambda x: len(x[1]))
    index = decontaminate.build_index(items)
    rng = np.random.default_rng(5)
    for some in (items[:8], items[-8:]):
        truth = [some[k % 8] for k in range(160)]
        docs = pa.array(["Hier und da " + decontaminate.edited(decontaminate.fold(t), apart, rng) + " so und so." for _, t in truth])
        found = {(d, index.ids[i]) for d, i, *_ in decontaminate.matches(docs, index)}
        assert np.mean([(k, i) in found for k, (i, _) in enumerate(truth)]) >= 0.95


def test_recall_of_short_items_among_long_ones():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(60 if k % 4 else 4))[: 300 if k % 4 else 28]) for k in range(80)]
    index = decontaminate.build_index(items)
    numbers = np.random.default_rng(3)
    docs = pa.array(["und da " + decontaminate.edited(decontaminate.fold(t), 0.2, numbers) + " so" for _, t in items for _ in range(4)])
    found = {(d, index.ids[i]) for d, i, *_ in decontaminate.matches(docs, index)}
    assert np.mean([(4 * k + j, k) in found for k in range(0, 80, 4) for j in range(4)]) >= 0.9


@settings(max_examples=100, deadline=None)
@given(st.text("abcé €", min_size=16, max_size=150), st.text("abcé €", min_size=1, max_size=200), st.integers(0, 99))
def test_bound_never_exceeds_the_distance(item, text, seed):
    text += decontaminate.edited(item, 0.2, np.random.default_rng(seed))
    assert decontaminate.bounds([(item, text), ("abc" * 30, "x")])[0] <= decontaminate.closest(item, text)[0]


# N-gram join


def brute_components(sets, percent=85):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        shared = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * shared >= percent * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("seed", "size", "percent"), [(0, 4, 85), (3, 5, 80)])
def test_join_near_the_threshold(spark, seed, size, percent):
    """Families of texts with edits that put pairs on either side of the threshold, hot groups among them."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(5000))
    docs = []
    for length in [4, 5, 8, 9, 10, 12, 15, 20, 33, 60, 150, 400]:
        base = [word() for _ in range(length)]
        for _ in range(40 if length in (20, 60) else 8):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, length // 30))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = w[rng.randrange(0, 2) :] + [word() for _ in range(rng.randrange(0, 2))]
            docs.append(" ".join(w))
    rng.shuffle(docs)
    sets = []
    for t in docs:
        w = SPACE.findall(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)})
    got = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), size=size, percent=percent).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == brute_components(sets, percent)
    assert [r.n_shingles for r in got] == [len(s) for s in sets]


@settings(max_examples=60, deadline=None)
@given(st.integers(6, 120), st.integers(0, 10**6), st.integers(1, 10**7))
def test_pigeonhole(n, seed, classes):
    """Linked sets share a signature in some scheme, however budgets were allocated."""
    rng = np.random.default_rng(seed)
    schemes = [ngram_join.allocate(k, a, b, classes) for k, (a, b) in enumerate(ngram_join.bands(200))]
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    for _ in range(10):
        drop = rng.integers(0, max(1, n // 12) + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, rng.integers(0, max(1, n // 12) + 1)).astype(np.uint64)]))
        if ngram_join.linked(a, b) and not np.array_equal(a, b):
            both = [{int(s) for sch in ngram_join.schemes_of(len(x), schemes) for s in ngram_join.signatures(x, sch)} for x in (a, b)]
            assert both[0] & both[1]
            shared = [x for x in ngram_join.schemes_of(len(a), schemes) if x in ngram_join.schemes_of(len(b), schemes)]
            for x in shared:
                apart = int(np.bitwise_count(ngram_join.sketch(a, x.words) ^ ngram_join.sketch(b, x.words)).sum())
                assert apart <= len(np.setxor1d(a, b)) <= ngram_join.most_apart(len(a), len(b))


def test_full_comparison_alone_finds_all(spark, monkeypatch):
    """Without rounds of anchors, and with tiny blocks and answers, the result is the same."""
    monkeypatch.setattr(ngram_join, "ANCHORS_PAY", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    test_join_near_the_threshold(spark, 1, 4, 85)


def test_equal_class_numbers_are_told_apart(spark, monkeypatch):
    """Numbers that coincide (here: one for all sets of a size) do not join classes."""
    own = ngram_join.class_of
    crowded = lambda s, moved=None: (own(s)[1] if moved and moved.get(len(s), own(s)[1]) != own(s)[1] else len(s), own(s)[1])
    monkeypatch.setattr(ngram_join, "class_of", crowded)
    test_join_near_the_threshold(spark, 2, 4, 85)


def test_one_signature_of_very_many_classes(spark):
    """A passage that 20,000 different texts share: one hot bucket, and no link but the planted ones."""
    common = " ".join(f"c{k}" for k in range(12))
    rows = [(i, f"{common} " + " ".join(f"u{i}x{k}" for k in range(10))) for i in range(20_000)]
    rows += [(20_000 + i, f"{common} " + " ".join(f"u{i}x{k}" for k in range(9))) for i in range(3)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert {d: c for d, c in got.items() if d != c} == {20_000 + i: i for i in range(3)}


def test_few_edges_take_one_task(spark, monkeypatch):
    """A long chain and a star are settled in two tables, not in rounds; over the cluster they come out the same."""
    rng = np.random.default_rng(6)
    chain = rng.permutation(40)
    edges = [*zip(chain[:-1].tolist(), chain[1:].tolist(), strict=True), *[(9_000, 5_000 + k) for k in range(50)], (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    written = []
    own = components.saved
    monkeypatch.setattr(components, "saved", lambda *x, **y: written.append(1) or own(*x, **y))
    got = {r.node: r.label for r in components.connected(df, "a", "b", len(edges)).collect()}
    assert got == {k: 0 for k in range(40)} | {k: 5_000 for k in [9_000, *range(5_000, 5_050)]}
    assert len(written) == 2
    monkeypatch.setattr(components, "EDGES_AT_ONCE", 0)
    assert {r.node: r.label for r in components.connected(df, "a", "b", len(edges)).collect()} == got
    assert components.connected(df.where("a < 0"), "a", "b", 0).count() == 0


def test_join_without_broadcasts(spark, monkeypatch):
    """Tables over every bound are shuffled, and the result is the same."""
    for module in (common, components, ngram_join):
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", -1)
    test_join_near_the_threshold(spark, 3, 5, 80)


def test_rows_are_summed_by_key():
    """Gradients of tokens that a batch holds several times are added up, whatever their order."""
    rng = np.random.default_rng(7)
    keys, rows = rng.integers(0, 50, 400), rng.integers(-9, 10, (400, attention.DIM)).astype(np.float32)
    table = np.zeros((50, attention.DIM), np.float32)
    np.add.at(table, keys, rows)
    got, sums = attention.summed_by(keys, rows)
    assert (got == np.unique(keys)).all() and (sums == table[got]).all()


def test_small_tables_take_few_files(spark):
    """A small table between steps is written by as many tasks as there are cores, and by more only as it grows."""
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(0, 1_000, 1, 8 * cores)
    at = lambda rows: common.gathered(df, rows).rdd.getNumPartitions()
    assert (at(0), at(1_000), at(common.FILE_ROWS * (cores + 1))) == (cores, cores, cores + 1)
    assert at(common.BROADCAST_ROWS) == min(4 * cores, max(cores, common.BROADCAST_ROWS // common.FILE_ROWS))
    assert at(common.BROADCAST_ROWS + 1) == 8 * cores


def test_sketches_of_the_heavier_side_stay(spark, monkeypatch):
    """One class met by very many: its sketch goes to theirs, none of theirs is shuffled, and the pairs that may link are the same."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    sets = [base, *[np.unique(np.concatenate([base[k % 40 :], rng.integers(0, 1 << 63, 10 * (k % 12), dtype=np.uint64)])) for k in range(400)]]
    schemes = [ngram_join.allocate(k, a, b, 400) for k, (a, b) in enumerate(ngram_join.bands(500))]
    rows = []
    for cls, s in enumerate(sets):
        own = ngram_join.schemes_of(len(s), schemes)
        sk = [ngram_join.sketch(s, x.words) for x in own]
        rows.append((cls, len(s), own[0].band, sk[0].tobytes(), sk[1].tobytes() if len(own) > 1 else None))
        for x, y in zip(sk, [ngram_join.sketch(base, x.words) for x in own], strict=True):
            apart = int(np.bitwise_count(ngram_join.folded(x) ^ ngram_join.folded(y)).sum())
            assert apart <= len(np.setxor1d(s, base)) and len(ngram_join.folded(x)) == -(-len(x) // 2)
    table = common.saved(spark.createDataFrame(rows, "cls long, n long, band int, sk binary, sk_low binary"))
    pairs = common.saved(spark.createDataFrame([(0, k) for k in range(1, 401)], "a long, b long"))
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 4_000)  # over the one class's sketches, far under the others'
    got = ngram_join.may_link(pairs, table, 85)
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString() and "ShuffledHashJoin" not in got._jdf.queryExecution().toString()
    found = {(r.a, r.b) for r in got.collect()}
    assert {(0, k) for k in range(1, 401) if ngram_join.linked(base, sets[k])} <= found and len(found) < 400
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", -1)
    assert {(r.a, r.b) for r in ngram_join.may_link(pairs, table, 85).collect()} == found


def test_signatures_of_one_class_are_not_shuffled_again(spark):
    """With the map of shared signatures, all of those are indexed again and next to none of the others."""
    rng = random.Random(8)
    docs = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(200)]
    docs += [f"{t} more" for t in docs[:5]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    schemes = [ngram_join.allocate(k, a, b, 200) for k, (a, b) in enumerate(ngram_join.bands(100))]
    rows = [tuple(r) for r in ngram_join.indexed(df, schemes, 4, {}).collect()]
    times = collections.Counter(sig for sig, _ in set(rows))
    shared = {sig for sig, n in times.items() if n > 1}
    bits = ngram_join.marked(spark.createDataFrame([(x,) for x in shared], "sig long"), len(shared))
    again = [tuple(r) for r in ngram_join.indexed(df, schemes, 4, {}, bits).collect()]
    assert {r for r in rows if r[0] in shared} <= set(again)
    assert len(set(again)) < len(set(r for r in rows if r[0] in shared)) + 0.05 * len(rows)


# Statistics, rules, classifiers


def test_quality_statistics(spark, texts):
    for r in QUERIES["op7_quality_rules"](spark, SMALL).collect():
        t = texts[r.doc_id]
        w = SPACE.findall(t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if SPACE.search(line):
                again += line in seen
                seen.add(line)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {i + k for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(marked), failed)
        assert r.kept == (not failed and r.rule == 0)


def test_rules_are_learned(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_gbt.FEATURES)))
    j, k = quality_gbt.FEATURES.index("upper_ratio"), quality_gbt.FEATURES.index("mean_line")
    bad = (x[:, j] > 0.8) & (x[:, k] < 0.6)
    rules = quality_rules.learn(x, (~bad).astype(float))
    found = np.any([r.holds(x) for r in rules], axis=0)
    assert (found == bad).mean() > 0.98
    frame = spark.createDataFrame([tuple(map(float, row)) for row in x[:200]], quality_gbt.FEATURES)
    assert [r.v > 0 for r in frame.select(quality_rules.verdict(rules).alias("v")).collect()] == found[:200].tolist()
    assert quality_rules.learn(x[:0], bad[:0].astype(float)) == []


def test_trees_learn(spark):
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality_gbt.fit(x[:3000], y[:3000], rounds=40)
    assert ((model.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def area(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    p = label.sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


@pytest.mark.parametrize(("name", "label", "parts", "remainder", "least"), [("op6_quality_classifier", "quality", 3, 1, 0.97), ("op10_toxicity", "toxic", 5, 0, 0.75)])
def test_held_out_ranking(spark, name, label, parts, remainder, least):
    truth = {r.doc_id: r[label] for r in table(spark, MEDIUM, "labels").collect()}
    got = QUERIES[name](spark, MEDIUM).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == remainder) and r.predicted == int(r.score >= 0.5) for r in got)
    pairs = [(r.score, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    score, y = map(np.array, zip(*pairs, strict=True))
    assert area(score, y) >= least


def test_held_out_language(spark):
    lang = {r.doc_id: r.lang for r in table(spark, MEDIUM, "documents").collect()}
    got = [r for r in QUERIES["op5_language_id"](spark, MEDIUM).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.97


def test_letters():
    rows = pa.array(["1 2", "a", "é", "—", "🙂", "漢", None, ""])
    assert langid.has_letter(rows, Chunk(rows)).tolist() == [False, True, True, False, False, True, False, False]


# Language model


def test_baseline_counts(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op8_lm_score"](spark, SMALL).collect()}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 7 == 2}
    tokens = {d: [*SPACE.findall(t.translate(LOWER)), "\0"] for d, t in texts.items()}
    c = collections.Counter(w for d, x in tokens.items() if d not in held for w in x)
    n, v = sum(c.values()), len(c)
    for d, x in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d in held, len(x), sum(c[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), rel=1e-9)
        assert r.score <= 0


def test_rare_words_are_joined(spark, texts, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 16)
    test_baseline_counts(spark, texts)


def test_model_is_a_distribution(monkeypatch):
    """Probabilities of the next token sum to one, windows score each token once, and texts give their ids back."""
    monkeypatch.setattr(attention, "STEPS", 20)
    rng = np.random.default_rng(3)
    vocabulary = 300
    docs = [rng.integers(0, vocabulary, n) for n in (1, 15, 16, 17, 70, 200)]
    cls = attention.sample_classes(docs, vocabulary)
    ids, first = attention.sample_arrays(docs)
    keys, counts = np.unique(attention.pair_keys(ids, first, cls), return_counts=True)
    model = attention.train(docs, cls, keys, counts)
    context, target, doc = attention.blocks(ids, first, vocabulary)
    assert np.bincount(doc, (target >= 0).sum(axis=1)).tolist() == [len(d) for d in docs]
    assert target[target >= 0].tolist() == ids.tolist()
    probe = np.repeat(context[3:4], vocabulary, axis=0)
    goal = np.full((vocabulary, attention.HALF), -1)
    goal[:, 5] = np.arange(vocabulary)
    assert np.exp(model.log_probs(probe, goal)[:, 5]).sum() == pytest.approx(1, abs=1e-3)
    rows = ["", "hello wörld 漢字", "<|endoftext|> x", " \n "]
    packed = pa.array(Encoder("byte_bpe_50k", "H").ids(rows), pa.binary())
    _, _, chunk = lm_score.unpack(packed)
    assert [chunk.data[a : b - 1].tobytes().decode() for a, b in zip(chunk.start, chunk.start[1:], strict=False)] == rows


def test_context_helps(spark, monkeypatch):
    """On held-out documents the model beats an add-one unigram over the same subword ids."""
    monkeypatch.setattr(attention, "STEPS", 600)
    held = {r.doc_id: r.score for r in QUERIES["op8_lm_score"](spark, MEDIUM).collect() if r.held_out}
    rows = table(spark, MEDIUM, "documents").collect()
    ids = {r.doc_id: np.frombuffer(b, "<u4") for r, b in zip(rows, Encoder("byte_bpe_50k").ids([(r.text or "").translate(LOWER) for r in rows]), strict=True)}
    counts = np.bincount(np.concatenate([x for d, x in ids.items() if d not in held]), minlength=50257) + 1.0
    unigram = np.log10(counts / counts.sum())
    assert sum(held.values()) > 0.9 * sum(unigram[ids[d]].sum() for d in held)


# Pipeline


def test_pipeline_is_its_stages_in_brute_force(spark, library):
    """Toxicity and language by their own models; near copies, benchmark and packing by brute force."""
    docs = table(spark, SMALL, "documents")
    kept = corpus_pipeline.drop_unknown_language(spark, corpus_pipeline.drop_toxic(spark, docs, SMALL), SMALL).orderBy("doc_id").collect()
    sets = []
    for r in kept:
        w = SPACE.findall(r.text.translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    one = [r for r, (i, c) in zip(kept, enumerate(brute_components(sets, 80)), strict=True) if i == c]
    items = [decontaminate.fold(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    clean = [r for r in one if not any(x in decontaminate.fold(r.text) for x in items)]
    ids = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 2] for r in clean}
    check_packing(corpus_pipeline.run(spark, SMALL).collect(), ids, 1024)


def test_lm_classes_and_windows(spark, monkeypatch):
    """Classes are of the whole fold; windows come from every document at one rate, and groups' weights are averaged."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 300, n).astype("<u2") for n in (400, 3, 90_000, 1_000)]
    rows = [(k, False, d.tobytes()) for k, d in enumerate(docs)] + [(300, True, np.full(50, 7, "<u2").tobytes())]
    df = spark.createDataFrame(rows, "rid long, held_out boolean, ids binary").repartition(5)
    cls = lm_score.corpus_classes(df, 320)
    assert (cls == attention.sample_classes([d.astype(np.int64) for d in docs], 320)).all()
    whole = lm_score.drawn_windows(df, 320, 1.0, 3).collect()
    n = sum(-(-len(d) // attention.HALF) for d in docs)
    assert len(whole) == n and {r.g for r in whole} == {0, 1, 2}
    targets = np.concatenate([np.frombuffer(bytes(r.w), "<i4")[2 * attention.HALF :] for r in whole])
    assert np.array_equal(np.bincount(targets[targets >= 0]), np.bincount(np.concatenate(docs)))
    assert abs(lm_score.drawn_windows(df, 320, 0.25, 3).count() - n / 4) < 0.05 * n
    monkeypatch.setattr(lm_score, "GROUP", 2_000)
    monkeypatch.setattr(lm_score, "DRAWN", 1.0)
    keys = np.arange(320)
    _, class_sum = attention.shares(cls, keys, np.ones(320))
    w = lm_score.fitted_weights(df, cls, class_sum)
    assert all(np.isfinite(x).all() for x in w.values())
    assert all(np.array_equal(attention.from_rows(attention.as_rows(w), w)[k], w[k]) for k in w)


def test_lm_is_fitted_on_every_window(spark, monkeypatch):
    """Each token stands once in the corpus; all but the documents' last ones are a window's input, and all their embeddings move."""
    monkeypatch.setattr(lm_score, "GROUP", 50)
    docs = np.arange(3_200, dtype="<u2").reshape(40, 80)
    rows = [(k, k == 39, d.tobytes()) for k, d in enumerate(docs)]
    cls = np.arange(3_300) % (attention.HEAD + attention.TAIL)
    class_sum = np.ones(attention.HEAD + attention.TAIL)
    w = lm_score.fitted_weights(spark.createDataFrame(rows, "rid long, held_out boolean, ids binary").repartition(3), cls, class_sum)
    start = attention.begin(cls, class_sum, np.random.default_rng(11))
    moved = (w["emb"] != start["emb"]).any(axis=1)
    assert moved[docs[:39, :-1].ravel()].all()
    assert not moved[docs[39]].any()


def naive_log_probs(model, ids, pad):
    """The model by its definition, token by token."""
    out = []
    before = [pad, *ids[:-1]]
    for t, goal in enumerate(ids):
        begin = max(0, t // attention.HALF - 1) * attention.HALF
        seen = before[begin : t + 1]
        x = model.emb[seen[-1]]
        q = x @ model.wq / math.sqrt(attention.DIM)
        s = np.array([q @ (model.emb[y] @ model.wk) + model.distance[len(seen) - 1 - j] for j, y in enumerate(seen)])
        a = np.exp(s - s.max())
        h = x + (a / a.sum()) @ np.array([model.emb[y] @ model.wv for y in seen])
        z = h @ model.out + model.out_bias
        last = attention.HEAD + attention.TAIL if t == 0 else model.cls[seen[-1]]
        out.append(z[model.cls[goal]] - np.log(np.exp(z).sum()) + model.within[last, goal])
    return out


def test_windows_are_the_model_by_definition():
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 200, n) for n in (1, 16, 17, 75)]
    cls = attention.sample_classes(docs, 200)
    ids, first = attention.sample_arrays(docs)
    model = attention.train(docs, cls, *np.unique(attention.pair_keys(ids, first, cls), return_counts=True))
    context, target, doc = attention.blocks(ids, first, 200)
    lp = model.log_probs(context, target)
    for k, d in enumerate(docs):
        assert lp[doc == k].ravel()[: len(d)] == pytest.approx(naive_log_probs(model, d.tolist(), 200), abs=2e-4)


def test_long_chunks_hash_as_short_ones():
    words = ["ab", "cde", "é漢", "x" * 40]
    long = Chunk(pa.array([" ".join(words * 60_000)])).words(SPACE_WORD)
    assert len(long.chunk.data) > 2 * arrowtext.BLOCK_BYTES
    short = Chunk(pa.array([" ".join(words)])).words(SPACE_WORD)
    assert (long.hash.reshape(-1, 4) == short.hash).all()
    line = Chunk(pa.array(["a" * 3_000_000 + "\nb", "a" * 3_000_000]))
    begin = line.start[:2]
    got = line.span_hash(begin, begin + 3_000_000)
    assert got[0] == got[1] != line.span_hash(begin[:1], begin[:1] + 2_999_999)[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc é", min_size=1, max_size=15), min_size=1, max_size=4), st.lists(st.text("abc é", max_size=40), min_size=1, max_size=4))
def test_short_items_are_found_exactly(items, docs):
    index = decontaminate.build_index(list(enumerate(items)))
    folded = [decontaminate.fold(t) for t in items]
    want = {(d, i): x[0] for d, t in enumerate(docs) for i, item in enumerate(folded) if item.strip(" ") and len(item.encode()) < decontaminate.LEAST and t and (x := decontaminate.closest(item, decontaminate.fold(t)))[0] <= int(0.2 * len(item))}
    got = {(d, index.ids[i]): n for d, i, n, *_ in decontaminate.matches(pa.array(docs), index) if len(index.texts[i].encode()) < decontaminate.LEAST}
    assert got == want


def test_one_toxic_label_and_a_repeated_id(spark):
    """One positive is enough for a defined model; an id that very many rows have is one row of the sample."""
    docs = [(k, f"plain words number {k} here") for k in range(60)] + [(100, "vile trash vile")] * 5_000
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, 0) for k in range(60)] + [(100, 1), (101, 0)], "doc_id long, toxic int")
    for kept in (frame, frame.where("doc_id < 100 or rand(1) < 0.001")):
        model = toxicity.train(kept, labels, parts=1_000_003)
        assert np.isfinite(model.bias) and np.isfinite(model.weight).all()
        assert (model.scores(pa.array(["plain words", None, ""])) < 0.5).all()
