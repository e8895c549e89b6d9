"""License scans: exact containment join of text blocks with license templates.

A block is a line of a document (``\\n``-split). A block meets a template when it
holds at least ``threshold`` of the template's distinct words. The join is the
classic set-similarity join with one small side: the tokens of all templates are
put in order of their frequency over the whole corpus, rarest first, and

* prefix filter: a block that holds none of a template's first
  ``|T| - need + 1`` tokens cannot hold ``need`` of them;
* length filter: a block with fewer than ``need`` words cannot either;
* positional filter: if the first shared token stands at position p of the
  template's order, at most ``|T| - p`` tokens are shared.

Survivors are counted exactly. The templates are a bounded list, so what is
broadcast doesn't grow with the corpus; documents aren't shuffled.

Defined cases: null and empty texts have no words, no places, no labels, score 0.
Repeated rows are scored one by one. A null id is returned as null. Columns other
than id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.arrowtext import ALNUM_WORD, Chunk, hash_of_words, map_chunks
from tideline.llm.common import table

# Phrases and their labels, as the contract of the query states them.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Template texts and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("all-rights-reserved", "all rights reserved"),
]
#: A template counts from this share of its distinct words in one line.
THRESHOLD = 0.8


@dataclass
class Index:
    """Template tokens in global order (rarest first) and each template's filters."""

    tokens: np.ndarray  # sorted hashes
    member: np.ndarray  # [token, template] holds
    prefix: np.ndarray  # [token, template] token is in the template's prefix
    bound: np.ndarray  # [token, template] most shared tokens if this is the first
    size: np.ndarray
    need: np.ndarray
    labels: list[str]
    phrases: list[tuple[np.ndarray, str]]


def vocabulary(templates: list[tuple[str, str]]) -> np.ndarray:
    """Hashes of the distinct words of all templates, sorted."""
    found = [hash_of_words(text, ALNUM_WORD) for _, text in templates]
    return np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))


def token_counts(docs: DataFrame, tokens: np.ndarray, text: str = "text") -> np.ndarray:
    """How often each of the (few) tokens stands in the whole corpus."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = Chunk(batch.column(0), lower=True).words(ALNUM_WORD).hash
        at = np.minimum(np.searchsorted(tokens, got), max(len(tokens) - 1, 0))
        sums = np.bincount(at[tokens[at] == got], minlength=len(tokens)) if len(got) and len(tokens) else np.zeros(len(tokens), np.int64)
        used = np.flatnonzero(sums)
        return pa.record_batch({"k": pa.array(used, pa.int32()), "c": pa.array(sums[used], pa.int64())})

    rows = map_chunks(docs.select(F.col(text).alias("text")), count, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()
    out = np.zeros(len(tokens), dtype=np.int64)
    for r in rows:
        out[r.k] = r.c
    return out


def build_index(templates: list[tuple[str, str]], counts: np.ndarray, threshold: float, phrases: dict[str, str]) -> Index:
    tokens = vocabulary(templates)
    n, m = len(tokens), len(templates)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((tokens, counts))] = np.arange(n)
    member, prefix, bound = np.zeros((n, m), bool), np.zeros((n, m), bool), np.zeros((n, m), np.int64)
    size, need = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for t, (_, words) in enumerate(templates):
        own = np.searchsorted(tokens, np.unique(hash_of_words(words, ALNUM_WORD)))
        own = own[np.argsort(rank[own])]
        size[t], need[t] = len(own), max(1, math.ceil(threshold * len(own) - 1e-9))
        member[own, t] = True
        prefix[own[: size[t] - need[t] + 1], t] = True
        bound[own, t] = size[t] - np.arange(size[t])
    return Index(tokens, member, prefix, bound, size, need, [x for x, _ in templates], [(hash_of_words(p, ALNUM_WORD), x) for p, x in phrases.items()])


def scan_chunk(texts: pa.Array, index: Index) -> dict[str, np.ndarray | list]:
    chunk = Chunk(texts, lower=True)
    words = chunk.words(ALNUM_WORD)
    got, n = words.hash, chunk.n
    first, doc = words.first, words.doc
    n_base = np.zeros(n, np.int64)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    labels: list[set[str]] = [set() for _ in range(n)]
    for phrase, label in index.phrases:
        k = len(phrase)
        if len(got) < k:
            continue
        hit = np.flatnonzero(got[: len(got) - k + 1] == phrase[0])
        for j in range(1, k):
            hit = hit[got[hit + j] == phrase[j]]
        hit = hit[doc[hit] == doc[hit + k - 1]]
        of = doc[hit]
        np.add.at(n_base, of, 1)
        np.minimum.at(low, of, hit - first[of])
        np.maximum.at(high, of, hit - first[of])
        for d in np.unique(of):
            labels[d].add(label)
    base = [",".join(sorted(x)) for x in labels]
    score = np.where(n_base > 0, 1.0, 0.0)
    places: list[list[tuple[int, float, int, int]]] = [[] for _ in range(n)]
    if len(got) and len(index.tokens):
        at = np.minimum(np.searchsorted(index.tokens, got), len(index.tokens) - 1)
        known = np.flatnonzero(index.tokens[at] == got)
        line_ends = np.flatnonzero(chunk.data == 0x0A)  # the added ends of documents are lines' ends too
        line = np.searchsorted(line_ends, words.starts[known])
        pair = np.unique(line * len(index.tokens) + at[known])
        line, token = pair // len(index.tokens), pair % len(index.tokens)
        held = np.flatnonzero(index.prefix[token].any(axis=1))
        some = np.unique(line[held])  # lines with a prefix token of any template
        if len(some):
            n_in_line = np.searchsorted(words.starts, line_ends[some]) - np.searchsorted(words.starts, np.where(some > 0, line_ends[some - 1], 0))
            of_some = np.minimum(np.searchsorted(some, line), len(some) - 1)
            mine = some[of_some] == line
            row, token = of_some[mine], token[mine]
            best = np.zeros((len(some), len(index.size)), np.int64)
            np.maximum.at(best, row, np.where(index.prefix[token], index.bound[token], 0))
            possible = (best >= index.need) & (n_in_line[:, None] >= index.need)
            overlap = np.zeros_like(best)
            np.add.at(overlap, row, index.member[token].astype(np.int64))
            share = np.where(possible, overlap / index.size, 0.0)
            line_doc = np.searchsorted(chunk.start, line_ends[some], side="right") - 1
            np.maximum.at(score, line_doc, np.where(possible & (overlap >= index.need), share, 0.0).max(axis=1))
            for r, t in zip(*np.nonzero(possible & (overlap >= index.need)), strict=True):
                d = line_doc[r]
                labels[d].add(index.labels[t])
                begin = line_ends[some[r] - 1] + 1 if some[r] else 0
                places[d].append((int(t), float(share[r, t]), int(begin - chunk.start[d]), int(line_ends[some[r]] - chunk.start[d])))
    return {"n_words": words.per_doc, "n_base": n_base, "first": low, "last": high, "base_labels": base, "labels": [",".join(sorted(x)) for x in labels], "score": score, "places": places}


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, phrases: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base places, labels, and ``blocks`` (template, share, byte span of the line) that meet the threshold."""
    templates = TEMPLATES if templates is None else templates
    counts = token_counts(docs, vocabulary(templates), text)
    index = build_index(templates, counts, threshold, PHRASES if phrases is None else phrases)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = scan_chunk(batch.column(1), index)
        none = got["n_base"] == 0
        block = pa.struct([("template", pa.int32()), ("share", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.record_batch(
            {
                "doc_id": batch.column(0),
                "n_words": pa.array(got["n_words"], pa.int64()),
                "n_base": pa.array(got["n_base"], pa.int64()),
                "first_word": pa.array(got["first"], pa.int64(), mask=none),
                "last_word": pa.array(got["last"], pa.int64(), mask=none),
                "base_labels": pa.array(got["base_labels"], pa.string()),
                "labels": pa.array(got["labels"], pa.string()),
                "score": pa.array(got["score"], pa.float64()),
                "blocks": pa.array([[dict(zip(("template", "share", "start", "end"), p, strict=True)) for p in ps] for ps in got["places"]], pa.list_(block)),
            }
        )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<template:int,share:double,start:long,end:long>>"
    return map_chunks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, schema)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("blocks")


def oracle() -> str:
    """The same rows in DuckDB's SQL, brute force over all lines and templates."""
    phrases = ", ".join(f"('{p}', {len(p.split())}, '{x}')" for p, x in PHRASES.items())
    templates = ", ".join(f"({k}, '{x}', {sorted(set(t.split()))!r})" for k, (x, t) in enumerate(TEMPLATES))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x{7F}]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {lower} AS t FROM documents),
w AS (SELECT doc_id, r, t, regexp_extract_all(t, '{word}') AS ws FROM d),
phrases(p, k, label) AS (VALUES {phrases}),
places AS (SELECT r, label, unnest(list_filter(range(len(ws)), lambda i: array_to_string(ws[i + 1 : i + k], ' ') = p)) AS pos FROM w, phrases),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM places GROUP BY r),
templates(k, label, ts) AS (VALUES {templates}),
lines AS (SELECT r, list_distinct(regexp_extract_all(line, '{word}')) AS bs FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
met AS (SELECT r, label, len(list_intersect(ts, bs)) / len(ts) AS share FROM lines, templates WHERE len(list_intersect(ts, bs)) >= greatest(1, ceil({THRESHOLD} * len(ts) - 1e-9))),
b AS (SELECT r, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT r, label FROM places) GROUP BY r),
a AS (SELECT r, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT r, label FROM places UNION SELECT r, label FROM met) GROUP BY r),
m AS (SELECT r, max(share) AS share FROM met GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(b.s, '') AS base_labels, coalesce(a.s, '') AS labels,
  CAST(greatest(CASE WHEN n_base > 0 THEN 1 ELSE 0 END, coalesce(share, 0)) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN b USING (r) LEFT JOIN a USING (r) LEFT JOIN m USING (r)"""
