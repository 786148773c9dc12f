"""Removal of repeated byte strings by a distributed suffix merge sort (operator 2).

Every byte covered by a string of LENGTH bytes that also starts earlier in the
corpus is removed.  Suffixes are sampled by content: of all GRAM-byte strings in
a LENGTH-byte string the one with the smallest hash is its anchor, so two equal
strings have their anchors at the same offset, and only suffixes that start at
anchors (about one position in 35) need sorting.

A first exchange of anchor hashes (a few bytes each) drops anchors that occur
once: a prefix that is unique distinguishes its suffix, which needs no exchange.
Map tasks sort the other suffixes of some megabytes of text per bucket of anchor
strings, front-code each sorted run (common prefix with its predecessor, then
the rest) and exchange it.  One task per bucket merges its runs with a loser tree
that carries common-prefix lengths: of two suffixes with different lengths in
common with the last output the order is known without a look at them, and equal
lengths are compared only behind the known prefix.  Suffixes that come out with
GRAM bytes in common are the occurrences of one anchor; their surrounding
LENGTH-byte strings are compared at each offset, exactly.

Buckets hold a bounded amount of text on average.  Occurrences with equal
surroundings within a run (copied documents, common passages) travel as a
finished interval instead of as suffixes.

An anchor with more than HOT occurrences (a footer, a frequent line) goes to no
bucket, as one task would hold them all.  Its LENGTH-byte strings are exchanged
themselves, one row per run and string with the earliest place in the run, and
every place but the earliest of all is marked: a footer's occurrences spread over
tasks by what surrounds them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # farthest start of a string before its anchor
# Text per sorted run and, on average, per bucket.
RUN_BYTES = 8 << 20
BLOCK = 1 << 22  # positions scanned at once in a very long text
# Text whose anchor hashes are compared by one task, on average.
FILTER_BYTES = 64 << 20
MANY = 2048  # occurrences from which strings are compared as arrays
HOT = 8192  # occurrences of an anchor that one task may hold
CELL_BITS = 24  # hot anchors are told by a bitmap of this many bits of a hash; others that share a bit count as hot
HELD = 1 << 17  # strings of hot anchors per run
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64((1 << 24) - 1)
LAST_ID = (1 << 63) - 1  # stands for a null doc_id; no document may have it


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all LENGTH-byte strings of ``raw``."""
    return anchored(raw)[:2]


def gram_hashes(words: list) -> np.ndarray:
    """Hashes of GRAM-byte strings from their words of 8 bytes, multiplied by the first of _MIX."""
    h = words[0]
    for k in range(1, GRAM // 8):
        h = h ^ (h >> np.uint64(29))
        h *= _MIX[k]
        h += words[k]
    h ^= h >> np.uint64(32)
    h *= _MIX[1]
    return h


def anchored(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of ``raw`` and, for each, the start of the first string it is the anchor
    of; the last one starts before that of the next anchor."""
    pos, hashes, begin = [], [], []
    for base in range(0, max(0, len(raw) - LENGTH + 1), BLOCK):
        part = raw[base:base + BLOCK + LENGTH - 1]
        n = len(part) - GRAM + 1
        words = np.ndarray(len(part) - 7, "<u8", part, 0, 1) * _MIX[0]
        h = gram_hashes([words[k:k + n] for k in range(0, GRAM, 8)])
        # Smallest hash of REACH + 1 neighbours, the leftmost of equals.
        low = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
        size = 1
        while size <= REACH:
            step = min(size, REACH + 1 - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        at = (low & _LOW).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        pos.append(at[first] + base)
        hashes.append(h[at[first]])
        begin.append(first + base)
    if not pos:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(pos) == 1:
        return pos[0], hashes[0], begin[0]
    pos, hashes, begin = np.concatenate(pos), np.concatenate(hashes), np.concatenate(begin)
    pos, first = np.unique(pos, return_index=True)
    return pos, hashes[first], begin[first]


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    n = min(len(a), len(b))
    while known + 8 <= n and a[known:known + 8] == b[known:known + 8]:
        known += 8
    while known < n and a[known] == b[known]:
        known += 1
    return known


def pack_run(entries: list) -> bytes:
    """Front-code a sorted run of (suffix, before, doc_id, text_hash, position);
    later occurrences with equal surroundings become intervals."""
    entries.sort()
    kept, shared, rest, before, done = [], [], [], [], []
    last = (b"", None)
    for e in entries:
        if e[:2] == last:  # sorted, so the kept one is earlier, or the very same place
            if e[2:] != kept[-1][2:] and len(e[0]) + len(e[1]) >= LENGTH:
                done.append((e[2], e[3], e[4] - len(e[1]), e[4] + len(e[0])))
            continue
        lcp = common_prefix(last[0], e[0], 0)
        kept.append(e)
        shared.append(lcp)
        rest.append(e[0][lcp:])
        before.append(e[1])
        last = e[:2]
    heads = [np.array(shared, np.uint8), np.array([len(x) for x in rest], np.uint8), np.array([len(x) for x in before], np.uint8),
             np.array([e[2] for e in kept], np.int64), np.array([e[3] for e in kept], np.int64),
             np.array([e[4] for e in kept], np.int64), np.array(done, np.int64).reshape(-1, 4)]
    raw = b"".join([np.array([len(kept), len(done)], np.int64).tobytes(), *[x.tobytes() for x in heads],
                    b"".join(rest), b"".join(before)])
    return zstandard.ZstdCompressor(level=1).compress(raw)


class Run:
    """Reads a packed run: per suffix its common prefix with the one before it."""

    def __init__(self, packed: bytes):
        raw = zstandard.ZstdDecompressor().decompress(packed)
        n, d = np.frombuffer(raw, np.int64, 2).tolist()
        at = 16

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.shared, size, left = take(np.uint8, n).tolist(), take(np.uint8, n).tolist(), take(np.uint8, n).tolist()
        place = [take(np.int64, n).tolist() for _ in range(3)]
        self.done = take(np.int64, 4 * d).reshape(-1, 4)
        self.place = list(zip(*place))
        self.keys, self.before, key = [], [], b""
        for lcp, k in zip(self.shared, size):
            key = key[:lcp] + raw[at:at + k]
            at += k
            self.keys.append(key)
        for k in left:
            self.before.append(raw[at:at + k])
            at += k


def merge_runs(runs: list[Run]):
    """(common prefix with the previous suffix, run, index) in suffix order.

    Loser tree: inner node i keeps the run that lost there, ``lcp[run]`` being
    its common prefix with the suffix it lost to, which is the last output for all
    nodes on the path that is played again."""
    k = len(runs)
    keys, at = [r.keys for r in runs], [0] * k
    current = [r.keys[0] if r.keys else None for r in runs]
    lcp = [0 if c is not None else -1 for c in current]
    tree = [-1] * k

    def play(cur: int, node: int) -> int:
        while node:
            other = tree[node]
            if other < 0:  # first round: wait for the opponent
                tree[node] = cur
                return -1
            a, b = lcp[cur], lcp[other]
            if a < b:
                tree[node], cur = cur, other
            elif a == b and a >= 0:
                x, y = current[cur], current[other]
                a = common_prefix(x, y, a)
                if y[a:a + 1] < x[a:a + 1]:
                    lcp[cur] = a
                    tree[node], cur = cur, other
                else:
                    lcp[other] = a
            node >>= 1
        return cur

    winner = -1
    for r in range(k):
        w = play(r, (k + r) >> 1) if k > 1 else r
        winner = w if w >= 0 else winner
    while winner >= 0 and current[winner] is not None:
        i = at[winner]
        yield lcp[winner], winner, i
        i += 1
        at[winner] = i
        own = keys[winner]
        if i < len(own):
            current[winner], lcp[winner] = own[i], runs[winner].shared[i]
        else:
            current[winner], lcp[winner] = None, -1
        if k > 1:
            winner = play(winner, (k + winner) >> 1)


def resolve(group: list) -> list[tuple]:
    """(doc_id, text_hash, first, last) covered by strings around one anchor that
    also start earlier; the group's (suffix, before, place) in any order."""
    group = sorted(group, key=lambda g: g[2])
    out = []
    if len(group) < MANY:
        seen: list[dict] = [{} for _ in range(REACH + 1)]
        for key, before, place in group:
            text, n = before + key, len(before)
            low = high = None
            for back in range(max(0, LENGTH - len(key)), min(n, REACH) + 1):
                if seen[back].setdefault(text[n - back:n - back + LENGTH], place) != place:
                    high = back
                    low = back if low is None else low
            if low is not None:
                out.append((place[0], place[1], place[2] - high, place[2] - low + LENGTH))
        return out
    size = np.array([(len(b), len(k)) for k, b, _ in group])
    text = np.frombuffer(b"".join(b.rjust(REACH, b"\0") + k.ljust(LENGTH, b"\0") for k, b, _ in group), np.uint8).reshape(len(group), -1)
    same = {}
    place = np.array([same.setdefault(p, len(same)) for _, _, p in group])
    low, high = np.full(len(group), REACH + 1), np.full(len(group), -1)
    for back in range(REACH + 1):
        has = np.flatnonzero((size[:, 0] >= back) & (size[:, 1] >= LENGTH - back))
        if len(has) < 2:
            continue
        strings = np.ascontiguousarray(text[has, REACH - back:REACH - back + LENGTH]).view(f"V{LENGTH}").ravel()
        _, first, inverse = np.unique(strings, return_index=True, return_inverse=True)
        dup = has[place[has] != place[has[first[inverse.ravel()]]]]
        low[dup], high[dup] = np.minimum(low[dup], back), np.maximum(high[dup], back)
    return [(g[2][0], g[2][1], g[2][2] - int(hi), g[2][2] - int(lo) + LENGTH)
            for g, lo, hi in zip(group, low, high) if hi >= 0]


def merge_bucket(packed: list[bytes]) -> list[tuple]:
    """All intervals of one bucket's runs."""
    runs = [Run(p) for p in packed]
    out = [tuple(x) for r in runs for x in r.done.tolist()]
    group: list = []
    for lcp, r, i in merge_runs(runs):
        if lcp < GRAM:
            if len(group) > 1:
                out += resolve([(runs[a].keys[b], runs[a].before[b], runs[a].place[b]) for a, b in group])
            group = []
        group.append((r, i))
    if len(group) > 1:
        out += resolve([(runs[a].keys[b], runs[a].before[b], runs[a].place[b]) for a, b in group])
    return out


def _pack_hashes(docs: list, counts: list, hashes: np.ndarray, at: np.ndarray, buckets: int):
    """(bucket, packed) of one run's anchors: hashes sorted, with the document and
    the position of the anchor in it."""
    doc = np.repeat(np.arange(len(docs), dtype=np.uint32), counts)
    place = at.astype(np.uint32)
    own = (hashes >> np.uint64(33)) % np.uint64(buckets)
    short = hashes.astype(np.uint32)
    order = np.lexsort((short, own))
    edges = np.searchsorted(own[order], np.arange(buckets + 1, dtype=np.uint64))
    table = np.array(docs, np.int64).reshape(-1, 2)
    for k in range(buckets):
        at = order[edges[k]:edges[k + 1]]
        if len(at):
            used, local = np.unique(doc[at], return_inverse=True)
            raw = [np.array([len(at), len(used)], np.int64), table[used], np.diff(short[at], prepend=np.uint32(0)),
                   local.astype(np.uint32), place[at]]
            yield k, zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x).tobytes() for x in raw))


def _repeated(packed: list[bytes]) -> list[tuple]:
    """(doc, hash, positions of its repeated anchors) within one bucket."""
    tables, hashes, local, place = [], [], [], []
    for p in packed:
        raw = zstandard.ZstdDecompressor().decompress(p)
        n, d = np.frombuffer(raw, np.int64, 2).tolist()
        local.append(np.frombuffer(raw, np.uint32, n, 16 + 16 * d + 4 * n) + sum(map(len, tables)))
        tables.append(np.frombuffer(raw, np.int64, 2 * d, 16).reshape(-1, 2))
        hashes.append(np.cumsum(np.frombuffer(raw, np.uint32, n, 16 + 16 * d), dtype=np.uint32))
        place.append(np.frombuffer(raw, np.uint32, n, 16 + 16 * d + 8 * n))
    h, doc, place, table = np.concatenate(hashes), np.concatenate(local), np.concatenate(place), np.concatenate(tables)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    hit = order[np.r_[same, False] | np.r_[False, same]]
    hit = hit[np.argsort(doc[hit], kind="stable")]
    cuts = np.flatnonzero(np.diff(doc[hit])) + 1
    return [(*table[doc[part[0]]].tolist(), place[part].astype(np.uint32).tobytes()) for part in np.split(hit, cuts) if len(part)]


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _MIX[3]) >> np.uint64(32)


def hot_cells(src: DataFrame, total: int, hot: int) -> bytes | None:
    """Packed bitmap of the cells of anchors with more than ``hot`` occurrences, None
    without such.  Counts are combined per run and map-side; only cells reach the driver."""
    if total <= hot:
        return None

    def count(batches):
        hashes, size = [], 0

        def flush():
            cells, n = np.unique(np.concatenate(hashes), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(n.astype(np.int64))], ["cell", "n"])

        for b in batches:
            for text in b.column(2):
                raw = text.as_py().encode("utf-8")
                hashes.append(_cells(anchors(raw)[1]))
                size += len(raw)
                if size >= 2 * RUN_BYTES:
                    yield flush()
                    hashes, size = [], 0
        if hashes:
            yield flush()

    found = (src.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > hot)
             .select(F.shiftright("cell", 32 - CELL_BITS).alias("cell")).distinct().toArrow().column("cell").to_numpy())
    if not len(found):
        return None
    flags = np.zeros(1 << CELL_BITS, bool)
    flags[found] = True
    return zstandard.ZstdCompressor().compress(np.packbits(flags).tobytes())


def _hot_test(cells: bytes | None):
    """Function from hashes to whether each belongs to a hot anchor."""
    if cells is None:
        return lambda hashes: np.zeros(len(hashes), bool)
    flags = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(cells), np.uint8)).astype(bool)
    return lambda hashes: flags[_cells(hashes) >> np.uint64(32 - CELL_BITS)]


def hot_intervals(src: DataFrame, cells: bytes) -> DataFrame:
    """(doc, hash, first, last) covered by strings of hot anchors that also start earlier.

    A run's rows are its strings with their earliest place there, and, under a shorter key
    of their own, the intervals of its later places.  Strings are compared as bytes."""
    def strings(batches):
        is_hot = _hot_test(cells)
        held: dict[bytes, tuple] = {}
        later: dict[tuple, list] = {}
        marked = 0

        def flush():
            rows = [(k, *place, place[2] + LENGTH) for k, place in held.items()]
            for (doc, text_hash), starts in later.items():
                for a, b in without_intervals(b"", [(s, s + LENGTH) for s in starts])[0]:
                    rows.append((np.array([doc, text_hash, a], np.int64).tobytes(), doc, text_hash, a, b))
            held.clear()
            later.clear()
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                              ["string", "doc", "hash", "first", "last"])

        for b in batches:
            for doc, text_hash, text in zip(*(b.column(i) for i in range(3))):
                raw, doc, text_hash = text.as_py().encode("utf-8"), doc.as_py(), text_hash.as_py()
                _, h, begin = anchored(raw)
                end = np.r_[begin[1:], len(raw) - LENGTH + 1]
                some = is_hot(h)
                for low, high in zip(begin[some].tolist(), end[some].tolist()):
                    for s in range(low, high):
                        place = (doc, text_hash, s)
                        old = held.setdefault(raw[s:s + LENGTH], place)
                        if old != place:
                            if place < old:
                                held[raw[s:s + LENGTH]] = place
                            late = max(old, place)
                            later.setdefault(late[:2], []).append(late[2])
                            marked += 1
                    if len(held) >= HELD or marked >= 4 * HELD:
                        yield flush()
                        marked = 0
        if held:
            yield flush()

    # At most one row per run and string in a window.
    earliest = F.min(F.struct("doc", "hash", "first")).over(Window.partitionBy("string"))
    return (src.mapInArrow(strings, "string binary, doc bigint, hash bigint, first bigint, last bigint")
            .withColumn("earliest", earliest)
            .where((F.length("string") < LENGTH) | (F.struct("doc", "hash", "first") != F.col("earliest")))
            .select("doc", "hash", "first", "last"))


def repeated_anchors(src: DataFrame, total: int, cells: bytes | None = None) -> DataFrame:
    """(doc, hash, at): positions (uint32) of the anchors that are not hot and whose hash occurs
    twice or more in the corpus.  A few others pass (hashes are cut short); none is missed."""
    buckets = int(max(4, -(-total // FILTER_BYTES)))

    def pack(batches):
        is_hot = _hot_test(cells)
        docs, counts, hashes, places, size = [], [], [], [], 0

        def flush():
            rows = list(_pack_hashes(docs, counts, np.concatenate(hashes), np.concatenate(places), buckets))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.binary())],
                                              ["bucket", "run"])

        for b in batches:
            for doc, text_hash, text in zip(*(b.column(i) for i in range(3))):
                raw = text.as_py().encode("utf-8")
                pos, h = anchors(raw)
                cold = ~is_hot(h)
                pos, h = pos[cold], h[cold]
                if len(h):
                    docs.append((doc.as_py(), text_hash.as_py()))
                    counts.append(len(h))
                    hashes.append(h)
                    places.append(pos)
                    size += len(raw)
                if size >= 2 * RUN_BYTES:
                    yield flush()
                    docs, counts, hashes, places, size = [], [], [], [], 0
        if docs:
            yield flush()

    def find(group: pa.Table) -> pa.Table:
        rows = _repeated([x.as_py() for x in group.column("run")])
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.int64(), pa.int64(), pa.binary()))],
                        ["doc", "hash", "at"])

    return (src.mapInArrow(pack, "bucket bigint, run binary").repartition(buckets, "bucket").groupBy("bucket")
            .applyInArrow(find, "doc bigint, hash bigint, at binary"))


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """(doc, hash, first, last): intervals of bytes to remove, possibly overlapping."""
    src = _identified(docs)
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(4, -(-total // RUN_BYTES)))
    cells = hot_cells(src, total, HOT)
    # One document's anchors are bounded by its text.
    wanted = repeated_anchors(src, total, cells).groupBy("doc", "hash").agg(F.collect_list("at").alias("at"))

    def sort_runs(batches):
        held: dict[int, list] = {}
        size = 0

        def flush():
            rows = [(k, pack_run(v)) for k, v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.binary())],
                                              ["bucket", "run"])

        for b in batches:
            for doc, text_hash, text, at in zip(*(b.column(i) for i in range(4))):
                raw, doc, text_hash = text.as_py().encode("utf-8"), doc.as_py(), text_hash.as_py()
                pos = np.unique(np.frombuffer(b"".join(at.as_py()), np.uint32)).astype(np.int64)
                words = np.ndarray(len(raw) - 7, "<u8", raw, 0, 1)
                h = gram_hashes([words[pos + k] * _MIX[0] for k in range(0, GRAM, 8)])
                own = ((h * _MIX[2]) >> np.uint64(33)).astype(np.int64) % buckets
                for p, k in zip(pos.tolist(), own.tolist()):
                    held.setdefault(k, []).append((raw[p:p + LENGTH], raw[max(0, p - REACH):p], doc, text_hash, p))
                    size += LENGTH
                    if size >= 3 * RUN_BYTES:  # suffixes overlap about fivefold
                        yield flush()
                        size = 0
        if held:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        rows = merge_bucket([x.as_py() for x in group.column("run")])
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], [], []))],
                        ["doc", "hash", "first", "last"])

    found = (src.join(wanted, ["doc", "hash"]).select("doc", "hash", "text", "at")
             .mapInArrow(sort_runs, "bucket bigint, run binary").repartition(buckets, "bucket").groupBy("bucket")
             .applyInArrow(merge, "doc bigint, hash bigint, first bigint, last bigint"))
    return found if cells is None else found.unionByName(hot_intervals(src, cells))


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))


def without_intervals(raw: bytes, intervals) -> tuple[list[tuple[int, int]], list[bytes]]:
    """(removed runs, kept parts) of ``raw``; runs that touch are one."""
    runs: list[list[int]] = []
    for a, b in sorted(intervals):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    edge = [0, *[x for r in runs for x in r], len(raw)]
    return [(a, b) for a, b in runs], [raw[a:b] for a, b in zip(edge[::2], edge[1::2])]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) of every row.

    Null text is empty.  Texts under LENGTH bytes keep everything.  Documents
    are ordered by doc_id (null last), texts that share a doc_id by a hash;
    repeated rows of one id and text are one document, each row with its result.
    An empty table gives no rows; only doc_id and text are read.
    """
    found = repeated_intervals(docs).groupBy("doc", "hash").agg(
        F.collect_list(F.struct("first", "last")).alias("spans"))  # bounded by the document's length
    # The same exchange of the texts as for the suffixes: Spark reuses it.
    rows = _identified(docs).join(found, ["doc", "hash"], "left").select(
        F.nullif("doc", F.lit(LAST_ID)).alias("doc_id"), "spans", "text")

    def cut_text(batches):
        for b in batches:
            out = []
            for spans, text in zip(b.column(1), b.column(2)):
                raw = text.as_py().encode("utf-8")
                runs, parts = without_intervals(raw, [(s["first"], s["last"]) for s in spans.as_py() or []])
                kept = b"".join(parts)
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(cut_text, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
