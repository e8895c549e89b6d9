"""Per-document statistics that the quality operators share, computed on Arrow buffers.

Every statistic covers the whole text. Null and empty texts have all counts zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tideline.llm.arrowtext import SPACE_WORD, Chunk, lut, mix

# The symbol characters ``[#*$%&|<>]`` of the contract.
SYMBOLS = lut(lambda b: chr(b) in "#*$%&|<>")
UPPER = lut(lambda b: 0x41 <= b <= 0x5A)
DIGIT = lut(lambda b: 0x30 <= b <= 0x39)
PUNCT = lut(lambda b: 0x21 <= b <= 0x7E and not chr(b).isalnum())
LEAD = lut(lambda b: (b & 0xC0) != 0x80)
EXCLAIM = lut(lambda b: b == 0x21)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "punct_ratio", "exclaim_ratio", "distinct_ratio", "mean_line", "long_word_ratio", "top_word_ratio"]


def _with_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order, where each run of equal keys starts in it, and the runs' sizes."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order, begin, np.diff(np.append(begin, len(keys)))


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS as integers and RATIOS as doubles, one value per document."""
    chunk = Chunk(texts)
    data, n = chunk.data, chunk.n
    words = chunk.words(SPACE_WORD)
    n_words, doc = words.per_doc, words.doc
    word_chars = chunk.count(words.flags & LEAD[data])
    n_symbols = chunk.count(SYMBOLS[data])

    ends = np.flatnonzero(data == 0x0A)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    line_words = np.searchsorted(words.starts, ends) - np.searchsorted(words.starts, begins)
    some = np.flatnonzero(line_words)
    begins, ends = begins[some], ends[some]
    line_doc = np.searchsorted(chunk.start, begins, side="right") - 1
    n_lines = np.bincount(line_doc, minlength=n)
    order, begin, _ = _groups(_with_doc(chunk.span_hash(begins, ends), line_doc))
    n_dup_lines = n_lines - np.bincount(line_doc[order[begin]], minlength=n)

    hashes, at = words.windows(3)
    order, begin, size = _groups(_with_doc(hashes, doc[at]))
    repeated = at[order[np.repeat(size > 1, size)]]
    marked = np.zeros(len(doc) + 1, bool)
    for k in range(3):
        marked[repeated + k] = True
    n_repeat_words = np.bincount(doc[marked[:-1]], minlength=n)

    order, begin, size = _groups(_with_doc(words.hash, doc))
    word_doc = doc[order[begin]]
    n_distinct = np.bincount(word_doc, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, word_doc, size)
    long_words = np.bincount(doc[(words.ends - words.starts) > 20], minlength=n)

    w, c, lines = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(n_lines, 1)
    ratios = [word_chars / w, n_symbols / w, n_dup_lines / lines, n_repeat_words / w, chunk.count(UPPER[data]) / c, chunk.count(DIGIT[data]) / c, chunk.count(PUNCT[data]) / c, chunk.count(EXCLAIM[data]) / w, n_distinct / w, n_words / lines, long_words / w, top / w]
    return dict(zip(COUNTS, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), strict=True)) | dict(zip(RATIOS, ratios, strict=True))


SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATIOS)


def batch_statistics(batch: pa.RecordBatch) -> pa.RecordBatch:
    """For (doc_id, text) batches, rows of SCHEMA."""
    got = statistics(batch.column(1))
    return pa.record_batch({"doc_id": batch.column(0)} | {c: pa.array(got[c], pa.int64() if c in COUNTS else pa.float64()) for c in (*COUNTS, *RATIOS)})
