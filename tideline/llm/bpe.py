"""Byte-level BPE over whole texts: pre-tokens are encoded once and remembered.

The split into pre-tokens is the tokenizer's own pattern, so a text's ids are
those of its pre-tokens one after another. Most pre-tokens of a corpus repeat, so
a bounded memo in each Python worker turns encoding into dictionary look-ups.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers

#: Pre-tokens that a worker remembers, at most; then it starts anew.
MEMO = 500_000
#: Longer pre-tokens are not remembered.
MEMO_CHARS = 40


def vocabulary_path(name: str) -> str:
    return public_tokenizers.path(name)


# The pre-token pattern of the byte-level vocabularies, with the letter and number classes left open.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{other}+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def splitter() -> Callable[[str], list[str]]:
    """Splits a text into pre-tokens, exactly as the pattern with Unicode classes does.

    Python's ``re`` is several times faster than the Unicode-aware module but has
    no letter class. Its ``[^\\W\\d_]`` differs from letters in other number and
    mark characters, so texts that hold any of those take the slower way.
    """
    import regex

    exact = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", other=r"[^\s\p{L}\p{N}]")).findall
    fast = re.compile(PATTERN.format(L=r"[^\W\d_]", N="[0-9]", other=r"(?:[^\s\w]|_)")).findall
    # characters up to U+024F for which the two modules agree; then those of all for which they don't
    plain = re.compile(r"[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search
    odd = regex.compile(r"[\p{N}--[0-9]]|[[\w]--[\p{L}\p{N}_]]|[\x1c-\x1f]|[\p{L}--[\w]]", regex.V1).search
    return lambda text: fast(text) if plain(text) is None or odd(text) is None else exact(text)


class Encoder:
    """Ids of whole texts as the ``tokenizers`` library gives them for ``name``.json.

    Pre-tokens are encoded by the merges of ``name``.tiktoken, the same vocabulary
    as ranks, which has no cost per call to speak of; tests hold the ids against
    the library's own.
    """

    def __init__(self, name: str, code: str = "I"):
        import tiktoken

        self.code = code  # struct's code of an id: "I" for 32 bits, "H" for 16
        raw = [line.split() for line in open(vocabulary_path(f"{name}.tiktoken"), "rb")]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in raw}
        self.encode = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        self.special = {t["content"]: t["id"] for t in json.load(open(vocabulary_path(f"{name}.json"), encoding="utf-8"))["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.split = splitter()
        self.memo: dict[str, bytes] = {}

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens, special strings among them as the library takes them by default."""
        if self.split_special and any(s in text for s in self.special):
            out: list[str] = []
            for part in self.split_special(text):
                out += [part] if part in self.special else self.split(part)
            return out
        return self.split(text)

    def ids_of(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        return [self.special[word]] if word in self.special else self.encode(word)

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned integers."""
        out, memo = [], self.memo
        for text in texts:
            words = self.pretokens(text)
            try:
                out.append(b"".join(map(memo.__getitem__, words)))
            except KeyError:
                new = {w for w in words if w not in memo}
                if len(memo) + len(new) > MEMO:
                    memo.clear()
                    new = set(words)
                for w in new:
                    own = self.ids_of(w)
                    memo[w] = struct.pack(f"<{len(own)}{self.code}", *own)
                out.append(b"".join(map(memo.__getitem__, words)))
                for w in new:
                    if len(w) > MEMO_CHARS:
                        del memo[w]
        return out


@lru_cache(maxsize=2)
def encoder(name: str, code: str = "I") -> Encoder:
    """One for each Python worker."""
    return Encoder(name, code)
