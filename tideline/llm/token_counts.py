"""Token counts by prefix dynamic programming.

A token list is the byte-pair encoding of its bytes exactly when every two
neighbours are the encoding of theirs. So each prefix of a pre-token has one last
token: the vocabulary entry that ends there and stands validly after the last
token of what is before it. Walking over the prefixes gives

    count[p] = count[p - len(last[p])] + 1

for every p, the exact number of tokens of each prefix, without encoding any of
them. Counts of pre-tokens are remembered (bounded), and a text's counts are
those of its pre-tokens on top of the sum before them; :class:`Prefixes` answers
how many tokens a text has up to any character and where a budget ends.

Defined cases: null and empty texts have 0 bytes and 0 tokens. Special strings
inside texts are one token each, the library's default. Repeated rows are counted
once each; null ids pass through; only id and text are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.arrowtext import map_chunks
from tideline.llm.bpe import MEMO_CHARS, Encoder
from tideline.llm.common import table

VOCABULARY, BUDGET = "byte_bpe_50k", 512
#: Pre-tokens and token pairs that a worker remembers, at most; then it starts anew.
MEMO, PAIRS = 500_000, 500_000


#: White space as the pre-token pattern has it.
BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")


class Counter:
    """Prefix counts of pre-tokens and texts."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.base = Encoder(vocabulary)
        self.ranks = self.base.ranks
        self.longest = max(map(len, self.ranks))
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.fits: dict[int, bool] = {}  # (last token, token) packed in one number -> stands validly
        self.total: dict[str, int] = {}
        self.profile: dict[str, np.ndarray] = {}

    def valid(self, left: int, right: int) -> bool:
        """Whether the two tokens (left -1: none) are the encoding of their bytes."""
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            data = (self.tokens[left] if left >= 0 else b"") + self.tokens[right]
            known = self.fits[key] = self._merged(data) == ([left, right] if left >= 0 else [right])
        return known

    def _merged(self, data: bytes) -> list[int]:
        """Encoding of a few bytes by the merges themselves."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            rank, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)), default=(1 << 30, 0))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def counts(self, data: bytes) -> list[int]:
        """Tokens of every byte prefix of one pre-token, from the empty one on."""
        ranks, fits, longest = self.ranks, self.fits, self.longest
        last, count = [-1], [0]
        for p in range(1, len(data) + 1):
            for s in range(max(0, p - longest), p):
                token = ranks.get(data[s:p])
                if token is None:
                    continue
                left = last[s]
                known = fits.get(left << 20 | token)
                if self.valid(left, token) if known is None else known:
                    last.append(token), count.append(count[s] + 1)
                    break
            else:
                raise ValueError(f"no encoding of {data[:p]!r}")
        return count

    def n_tokens(self, text: str) -> int:
        words, total = self.base.pretokens(text), self.total
        try:
            return sum(map(total.__getitem__, words))
        except KeyError:
            new = {w for w in words if w not in total}
            if len(total) + len(new) > MEMO:
                total.clear()
                new = set(words)
            for w in new:
                total[w] = 1 if w in self.base.special else self.counts(w.encode())[-1]
            out = sum(map(total.__getitem__, words))
            for w in new:
                if len(w) > MEMO_CHARS:
                    del total[w]
            return out

    def prefixes(self, text: str) -> Prefixes:
        return Prefixes(self, text)


class Prefixes:
    """``count[i]``: tokens of the first i characters of a text, as encoding just those gives them."""

    def __init__(self, counter: Counter, text: str):
        out = np.zeros(len(text) + 1, np.int64)
        at, before = 0, 0
        blank_from = 0  # where the run of white space began that the current place continues
        before_blank = 0
        since, before_since = 0, 0  # where the ordinary text began that a partial special string would belong to
        for word in counter.base.pretokens(text):
            if word in counter.base.special:  # a part of a special string is ordinary text
                for k in range(1, len(word)):
                    out[at + k] = before_since + sum(counter.counts(w.encode())[-1] for w in counter.base.split(text[since : at + k]))
                out[at + len(word)] = before + 1
                before += 1
                at += len(word)
                blank_from, before_blank = at, before
                since, before_since = at, before
                continue
            own = self._at_characters(counter, word)
            out[at + 1 : at + len(word) + 1] = before + own[1:]
            if word in ("'re", "'ve", "'ll"):  # cut inside, a contraction is an apostrophe and a letter
                out[at + 2] = before + 2
            lead = len(word) - len(word.lstrip(BLANK))
            if lead:
                if at == since or text[at - 1] not in BLANK:
                    blank_from, before_blank = at, before
                run = self._at_characters(counter, text[blank_from : at + lead])
                out[at + 1 : at + lead + 1] = before_blank + run[at - blank_from + 1 :]
            before += int(own[-1])
            at += len(word)
            out[at] = out[at] if lead == len(word) else before
        self.count = out

    @staticmethod
    def _at_characters(counter: Counter, word: str) -> np.ndarray:
        data = word.encode()
        counts = np.array(counter.counts(data))
        ends = [i for i in range(len(data)) if data[i] & 0xC0 != 0x80] + [len(data)]
        return counts[ends]

    def upto(self, n: int) -> int:
        return int(self.count[n])

    def longest(self, budget: int) -> int:
        """The most characters that have at most ``budget`` tokens."""
        return int(np.flatnonzero(self.count <= budget)[-1])


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> Counter:
    """One for each Python worker."""
    return Counter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, budget: int = BUDGET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        count = counter(vocabulary).n_tokens
        n = np.array([count(t) if t else 0 for t in texts.to_pylist()], dtype=np.int64)
        return pa.record_batch({"doc_id": batch.column(0), "n_bytes": pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > budget)})

    return map_chunks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def truncated(docs: DataFrame, budget: int, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` with every text cut to the most characters that have at most ``budget`` tokens."""
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(vocabulary)
        cut = [t if t is None or c.n_tokens(t) <= budget else t[: c.prefixes(t).longest(budget)] for t in batch.column(at).to_pylist()]
        return batch.set_column(at, batch.schema.field(at), pa.array(cut, batch.schema.field(at).type))

    return map_chunks(docs, run, docs.schema, column=text)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
