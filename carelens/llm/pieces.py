"""SentencePiece encoding and decoding by a weighted transducer (operator 9).

The model file is compiled into a transducer over characters: a normaliser
(dummy prefix, space to U+2581), one arc per piece, and for a character without
a piece the arcs of its UTF-8 bytes.  The model at hand is of the BPE kind, whose
result is a constraint on neighbours rather than a sum of scores: a sequence of
pieces is the encoding exactly if every piece, and every two neighbouring pieces
joined, encode to themselves.  So arcs remember the piece they end, a step
between neighbours that merging would join differently weighs infinity, any other
step one, and the tropical shortest path through the composition with the input
is the encoding.  Neighbour weights are compiled when first met and kept.

No piece reaches across the end of a word, so composition splits there and a
word's path is found once per worker.  Documents are independent: one pass.
"""

from __future__ import annotations

import array
import functools
import hashlib
import re
import struct

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from .common import per_text

MODEL = "piece_bpe_32k.model"
MARK = "▁"
# Paths and neighbour weights remembered per worker; forgetting only costs time.  Words
# are kept in two generations, so that frequent ones are never forgotten.
CACHE_WORDS, CACHE_STEPS = 250_000, 400_000
LONG_WORD = 256
# Arcs are piece ids, or UNKNOWN + code point; NEVER is infinite weight.
UNKNOWN, ARCS, NEVER = 1 << 20, 1 << 22, 1 << 40
NORMAL, BYTE, BPE = 1, 6, 2
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at:at + size]
            at += size


class Transducer:
    """A BPE model file compiled for shortest-path encoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        spec = dict(x for n, v in message if n == 3 for x in _fields(v))
        trainer = dict(x for n, v in message if n == 2 for x in _fields(v))
        if spec.get(2) or spec.get(4) or not spec.get(3, 1) or trainer.get(3) != BPE:
            raise ValueError("only BPE models with identity normalisation, dummy prefix and kept spaces are compiled")
        self.surface: list[str] = []
        self.raw: list[bytes] = []  # what a piece decodes to
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        for i, piece in enumerate(dict(_fields(v)) for n, v in message if n == 1):
            text, kind = piece[1].decode("utf-8"), piece.get(3, NORMAL)
            self.surface.append(text)
            self.raw.append(bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(MARK, " ").encode("utf-8")
                            if kind == NORMAL else b"")
            if kind == BYTE:
                self.byte[int(text[3:5], 16)] = i
            elif kind == NORMAL:
                self.id[text] = i
                self.score[text] = struct.unpack("<f", piece[2])[0]
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces that reach across words are not compiled")
        self.is_byte = np.zeros(len(self.surface), bool)
        self.is_byte[self.byte] = True
        # Arcs: pieces that encode to themselves.
        tree = {p: self.merged(p, stop=2) for p in self.id if len(p) > 1}
        self.arcs = {p for p in self.id if len(p) == 1 or len(tree[p]) == 2 and "".join(tree[p]) in self.score}
        if any(self.score.get(x, np.inf) < self.score[p] for p, xy in tree.items() for x in xy if len(x) > 1):
            raise ValueError("a piece that outranks its parts is not compiled")
        # States of the piece acceptor: by character the next state, by "" the piece.
        self.first: dict = {}
        for p in self.arcs:
            state = self.first
            for c in p:
                state = state.setdefault(c, {})
            state[""] = self.id[p]
        # The symbols at a piece's two ends while it is being merged, first to last.
        self.starts: dict[str, list[str]] = {}
        self.ends: dict[str, list[str]] = {}
        for p in sorted(self.arcs, key=len):
            x, y = tree[p] if len(p) > 1 else ("", "")
            self.starts[p] = [*self.starts.get(x, [x] * bool(x)), p]
            self.ends[p] = [*self.ends.get(y, [y] * bool(y)), p]
        self.steps: dict[int, bool] = {}
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """The symbols left when the best-scored neighbours are joined (leftmost
        first) until none has a piece or ``stop`` are left; for single pieces."""
        symbols = list(text)
        while len(symbols) > stop:
            best = max(range(len(symbols) - 1), key=lambda i: (
                self.score.get(symbols[i] + symbols[i + 1], -np.inf), -i))
            if symbols[best] + symbols[best + 1] not in self.score:
                break
            symbols[best:best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def arc_text(self, arc: int) -> str:
        """Characters of an arc: a piece id, or UNKNOWN + a code point without piece."""
        return self.surface[arc] if arc < UNKNOWN else chr(arc - UNKNOWN)

    def step(self, a: int, b: int) -> bool:
        """Is the weight of arc ``b`` after arc ``a`` finite?  Compiled once."""
        if len(self.steps) >= CACHE_STEPS:
            self.steps.clear()
        known = self.steps[a * ARCS + b] = self._apart(self.arc_text(a), self.arc_text(b))
        return known

    def _apart(self, a: str, b: str) -> bool:
        """Do ``a`` and ``b`` merge to themselves side by side?  Both grow in order
        of score; they stay apart if, whatever symbols face each other at the
        border, the next step inside either comes before joining those two (equal
        scores go from left to right)."""
        score, left, right = self.score, self.ends.get(a, [a]), self.starts.get(b, [b])
        i = j = 0
        while True:
            grow_a = score[left[i + 1]] if i + 1 < len(left) else -np.inf
            grow_b = score[right[j + 1]] if j + 1 < len(right) else -np.inf
            joined = score.get(left[i] + right[j])
            if joined is not None and joined > grow_a and joined >= grow_b:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if grow_a >= grow_b:
                i += 1
            else:
                j += 1

    def path(self, word: str) -> list[int]:
        """Arcs of the shortest path over one word: at each position the least
        weight and the last arc.  A prefix has one encoding, so one arc reaches a
        position with finite weight, and a position once reached needs no other."""
        n = len(word)
        weight, last = [0] + [NEVER] * n, [-1] * (n + 1)
        first, steps = self.first, self.steps
        for i in range(n):
            total = weight[i] + 1
            if total > NEVER:
                continue
            before, state = last[i], first
            for j in range(i + 1, n + 1):
                c = word[j - 1]
                state = state.get(c)
                if state is None:
                    if j > i + 1:
                        break
                    arc, state = UNKNOWN + ord(c), {}
                else:
                    arc = state.get("")
                    if arc is None:
                        if j > i + 1:
                            continue
                        arc = UNKNOWN + ord(c)
                if last[j] < 0:
                    if before >= 0:
                        fits = steps.get(before * ARCS + arc)
                        if fits is None:
                            fits = self.step(before, arc)
                        if not fits:
                            continue
                    weight[j], last[j] = total, arc
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self.surface[last[at]]) if last[at] < UNKNOWN else 1
        return out[::-1]

    def _ids(self, word: str) -> bytes:
        """Ids of one word's path, bytes for characters without a piece."""
        ids = array.array("i")
        for arc in self.path(word):
            if arc < UNKNOWN:
                ids.append(arc)
            else:
                ids.extend([self.byte[b] for b in chr(arc - UNKNOWN).encode("utf-8")])
        return ids.tobytes()

    def word_ids(self, word: str) -> bytes:
        if len(word) > LONG_WORD:
            return self._long(word)
        if len(self.paths) >= CACHE_WORDS:
            self.older, self.paths = self.paths, {}
        got = self.paths[word] = self.older.get(word) or self._ids(word)
        return got

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as int32."""
        if not text:
            return np.empty(0, np.int32)
        words = SEGMENT.findall(MARK + text.replace(" ", MARK))
        known = self.paths.get
        return np.frombuffer(b"".join([known(w) or self.word_ids(w) for w in words]), np.int32)

    def _long(self, word: str) -> bytes:
        """A very long word, cut wherever two neighbouring characters are side by
        side in no piece, so that memory stays bounded by such a part."""
        parts, start = [], 0
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in self.pairs:
                parts.append(self._ids(word[start:i]))
                start = i
        return b"".join([*parts, self._ids(word[start:])])

    @functools.cached_property
    def pairs(self) -> set[str]:
        return {p[i:i + 2] for p in self.score for i in range(len(p) - 1)}

    def decode(self, ids) -> str:
        """Text of the ids; a byte that is no valid UTF-8 becomes U+FFFD."""
        raw = b"".join([self.raw[i] for i in ids])
        if len(ids) and self.surface[ids[0]].startswith(MARK):
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            pass
        out, held, lead = [], bytearray(), True
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                held += self.raw[i]
                continue
            while held:
                for n in range(min(4, len(held)), 0, -1):
                    try:
                        c = bytes(held[:n]).decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if len(c) == 1:
                        out.append(c)
                        del held[:n]
                        break
                else:
                    out.append("�")
                    del held[:1]
            if i is not None:
                out.append(self.raw[i].decode("utf-8"))
        text = "".join(out)
        return text[1:] if len(ids) and self.surface[ids[0]].startswith(MARK) else text


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


OUT = "ids array<int>, n_pieces bigint, n_byte_pieces bigint, decoded_sha256 string, exact boolean"


def encode_documents(docs: DataFrame, model_path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ids, n_pieces, n_byte_pieces, decoded_sha256 (of the text decoded
    from the ids) and exact (decoded and source text are equal) of every row.

    A null or empty text has no pieces and decodes to the empty text; a text
    that holds U+2581 decodes with spaces in their place (not exact).  Rows are
    independent, so repeated rows and ids (null too) give a result row each; an
    empty table gives none; only ``keep`` and text are read.
    """
    path = model_path or public_tokenizers.path(MODEL)

    def make():
        t = transducer(path)

        def run(texts):
            texts = [x or "" for x in texts]
            ids = [t.encode(x) for x in texts]
            back = [t.decode(i.tolist()) for i in ids]
            return {"ids": ids, "n_pieces": [len(i) for i in ids],
                    "n_byte_pieces": [int(t.is_byte[i].sum()) for i in ids],
                    "decoded_sha256": [hashlib.sha256(b.encode("utf-8")).hexdigest() for b in back],
                    "exact": [b == x for b, x in zip(back, texts)]}
        return run

    return per_text(docs, make, OUT, tuple(keep))
