"""Token counts of a BPE vocabulary with word ends (operator 6).

Rank-synchronous array merging: the distinct pre-tokens of a batch lie in one
ragged numpy array of symbol ids; each round looks up every adjacent pair's
rank, takes each sequence's lowest rank and applies that pair to all its
occurrences at once (left to right), until no sequence has a mergeable pair.
The surviving symbols are the tokens.

Applying all occurrences of a sequence's lowest-rank pair at once equals the
library's one-at-a-time order: a merge can only create pairs that contain the
new symbol, and such a pair has a higher rank than the one that made it.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import per_text

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
# Counted pre-tokens remembered per worker; forgetting them only costs time.
CACHE_WORDS = 400_000
NO_RANK = np.iinfo(np.int64).max


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the rest for
    code points from 256 on, in byte order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merge table of a tokenizer file as sorted arrays for vectorised lookup."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.size = len(ids)
        chars = _byte_chars()
        self.inner = np.array([ids[chars[b]] for b in range(256)], np.int64)
        self.final = np.array([ids[chars[b] + end] for b in range(256)], np.int64)
        merges = model["merges"]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order, made[order]
        self.special = [t["content"] for t in spec["added_tokens"]]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern, regex.V0)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """Number of special strings in ``text`` and the pre-tokens of the rest
        (each stretch normalised on its own)."""
        parts = self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else [text]
        out: list[str] = []
        for part in parts[::2]:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            out += self.words.findall(part.lower())
        return len(parts) // 2, out

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each (non-empty) pre-token."""
        raw = [w.encode("utf-8") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        sym[ends - 1] = self.final[data[ends - 1]]
        seq = np.repeat(np.arange(len(raw)), size)
        counts = size.copy()
        while len(sym) > 1:
            key = sym[:-1] * self.size + sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.ranks[at], NO_RANK)
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(np.r_[rank, NO_RANK], first)
            live = low < NO_RANK
            if not live.any():
                counts[seq[first]] = np.diff(np.r_[first, len(seq)])
                break
            # Sequences with nothing left to merge leave the arrays.
            span = np.diff(np.r_[first, len(seq)])
            counts[seq[first]] = span
            low_of = np.repeat(low, span)
            hit = (rank == low_of[:-1]) & (rank < NO_RANK)
            # Overlapping occurrences (a a a) merge from the left: every second of a run.
            pos = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, np.diff(pos) != 1]) if len(pos) else pos
            start = np.r_[0, np.flatnonzero(np.diff(run)) + 1] if len(pos) else pos
            nth = np.arange(len(pos)) - np.repeat(start, np.diff(np.r_[start, len(pos)]))
            pos = pos[nth % 2 == 0]
            sym[pos] = self.made[at[pos]]
            stay = np.repeat(live, span)
            stay[pos + 1] = False
            sym, seq = sym[stay], seq[stay]
        else:
            if len(seq):
                counts[seq] = 1
        return counts


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=4)
def _cache(path: str) -> dict:
    return {}


def counter(path: str):
    """A function from texts to their token counts."""
    vocab, known = vocabulary(path), _cache(path)

    def count(texts: list[str]) -> list[int]:
        out, held = [], []
        for t in texts:
            specials, words = vocab.pieces(t)
            bag = Counter(words)
            out.append(specials)
            held.append(bag)
        new = list({w for bag in held for w in bag if w not in known})
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list({w for bag in held for w in bag})
        if new:
            known.update(zip(new, vocab.count(new).tolist()))
        return [n + sum(known[w] * k for w, k in bag.items()) for n, bag in zip(out, held)]

    return count


def token_counts(df: DataFrame, vocabulary_path: str | None = None, limit: int = TOKEN_LIMIT,
                 id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit of every whole text.

    A null or empty text has 0 bytes and 0 tokens.  Rows are independent:
    repeated rows and ids (null too) give one result row each; an empty table
    gives none; only ``id_col`` and ``text`` are read, so extra columns of any
    name are ignored.
    """
    path = vocabulary_path or public_tokenizers.path(VOCABULARY)

    def make():
        count = counter(path)

        def run(texts):
            texts = [t or "" for t in texts]
            n = count(texts)
            return {"n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": n,
                    "over_limit": [x > limit for x in n]}
        return run

    return per_text(df, make, "n_bytes bigint, n_tokens bigint, over_limit boolean", (id_col,), text)
