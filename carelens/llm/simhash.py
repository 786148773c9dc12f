"""SimHash near-duplicates by vantage-point trees (operator 1).

Fingerprints of word shingles are reduced to distinct values (exact copies need
no pairs), then searched for pairs within ``RADIUS`` bits.  A shallow
vantage-point tree, built on the driver from a bounded sample, deals the values
into shards: at a node, values nearer to its vantage point than the median go
left, the others right.  A value also visits every shard that the triangle
inequality does not rule out within RADIUS (only those after its own, so a pair
meets once).  In a shard a second tree, built over its members, is searched for
all members and visitors at once; leaves compare exactly.

A shard returns a spanning forest of its links, never pairs: a cluster of copies
within RADIUS / 2 of a vantage point is joined without comparing.  Forests of all
shards are joined by distributed connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import components, cut, fresh, per_text, without

SHINGLE, RADIUS, SEED = 4, 4, 42
# Values sampled for the sharding tree (it steers the split, never the result).
SAMPLE = 4096
# Values per shard aimed at, and values compared directly at a leaf.
SHARD, LEAF = 20_000, 256
MAX_DEPTH = 20
# Where the numbers of rows without doc_id begin in the pipeline stage.
UNNAMED = 1 << 62
HASH_BLOCK = 1 << 16
PAIR_BLOCK = 1 << 21
_BIT = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit set where over half of the shingles' hashes have it; 0 without words."""
    raw = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z, ASCII space
    if not raw:
        return 0
    joined = b" ".join(raw)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(raw))
    first, last = starts[:len(raw) - k + 1].tolist(), ends[k - 1:].tolist()
    h64, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(first), HASH_BLOCK):
        h = np.array([h64(joined[a:b], seed) for a, b in zip(first[i:i + HASH_BLOCK], last[i:i + HASH_BLOCK])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _BIT[2 * total > len(first)]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed bigint) of every row."""
    def make():
        def run(texts):
            return {"fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}
        return run
    return per_text(docs, make, "fp bigint")


def build_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Heap of 2^depth - 1 (vantage value, median distance) nodes over a sample."""
    nodes, parts = [], [sample]
    for _ in range(depth):
        below = []
        for p in parts:
            v = p[len(p) // 2] if len(p) else np.uint64(0)
            d = np.bitwise_count(p ^ v).astype(np.int64)
            mu = int(np.median(d)) if len(p) else 32
            nodes.append((int(v), mu))
            below += [p[d <= mu], p[d > mu]]
        parts = below
    return nodes


def place(values: np.ndarray, nodes, depth: int, radius: int):
    """(row, shard, home) of every shard each value belongs to or may have a
    neighbour in, visits to shards before its own left out."""
    row = np.arange(len(values))
    node, home = np.zeros(len(values), np.int64), np.ones(len(values), bool)
    vantage = np.array([v for v, _ in nodes], np.uint64)
    median = np.array([m for _, m in nodes], np.int64)
    for _ in range(depth):
        d = np.bitwise_count(values[row] ^ vantage[node]).astype(np.int64)
        inner = d <= median[node]
        left = (home & inner) | (~home & (d <= median[node] + radius)) | (home & (d <= median[node] + radius))
        right = (home & ~inner) | (~home & (d > median[node] - radius)) | (home & (d > median[node] - radius))
        row = np.r_[row[left], row[right]]
        node, home = (np.r_[2 * node[left] + 1, 2 * node[right] + 2],
                      np.r_[home[left] & inner[left], home[right] & ~inner[right]])
    shard = node - (len(nodes) if depth else 0)
    own = np.empty(len(values), np.int64)
    own[row[home]] = shard[home]
    keep = shard >= own[row]
    return row[keep], shard[keep], home[keep]


class _Links:
    """Union of links among n values, held as a forest of smallest labels."""

    def __init__(self, n: int):
        self.label, self.held, self.size = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray):
        self.held.append((a, b))
        self.size += len(a)
        if self.size > PAIR_BLOCK:
            self.flush()

    def flush(self):
        if not self.held:
            return
        a, b = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        while len(a):
            la, lb = self.label[a], self.label[b]
            differ = la != lb
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def link(values: np.ndarray, members: np.ndarray, seekers: np.ndarray, radius: int, links: _Links):
    """Link every seeker to every member within ``radius`` (indices into values)."""
    todo = [(members, seekers)]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        v = values[p[len(p) // 2]]
        dp = np.bitwise_count(values[p] ^ v).astype(np.int64)
        far = int(dp.max())
        if 2 * far <= radius:
            # All members link to one another, and seekers this near to each of them.
            links.add(p, np.full(len(p), p[0]))
            dq = np.bitwise_count(values[q] ^ v).astype(np.int64)
            sure = dq + far <= radius
            links.add(q[sure], np.full(int(sure.sum()), p[0]))
            q = q[~sure & (dq - far <= radius)]
            if not len(q):
                continue
        mu = int(np.median(dp))
        inner = dp <= mu
        if len(p) <= LEAF or inner.all():
            step = max(1, PAIR_BLOCK // len(p))
            for i in range(0, len(q), step):
                part = q[i:i + step]
                near = np.bitwise_count(values[part][:, None] ^ values[p][None, :]) <= radius
                x, y = np.nonzero(near)
                links.add(part[x], p[y])
            continue
        dq = np.bitwise_count(values[q] ^ v).astype(np.int64)
        todo += [(p[inner], q[dq <= mu + radius]), (p[~inner], q[dq > mu - radius])]


def shard_links(reps: DataFrame, radius: int, count: int) -> DataFrame:
    """(a, b): forests of the links among ``reps`` (fp, rep), as rep ids."""
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, count) / SHARD)))))
    # A bounded sample, the same for the same rows whatever their order.
    sample = np.array([r.fp for r in reps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    nodes = build_tree(sample, depth)
    placed = T.StructType.fromDDL("shard bigint, fp bigint, rep bigint, home boolean")
    arrow = to_arrow_schema(placed)

    def deal(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            row, shard, home = place(fp.view(np.uint64), nodes, depth, radius)
            rep = b.column("rep").to_numpy(zero_copy_only=False)
            for i in range(0, len(row), 1 << 18):
                s = slice(i, i + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(shard[s]), pa.array(fp[row[s]]), pa.array(rep[row[s]]), pa.array(home[s])], schema=arrow)

    def search(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        rep = group.column("rep").to_numpy()
        home = group.column("home").to_numpy()
        order = np.lexsort((rep, ~home))  # the result does not depend on arrival order
        fp, rep, home = fp[order], rep[order], home[order]
        links = _Links(len(fp))
        link(fp, np.flatnonzero(home), np.arange(len(fp)), radius, links)
        links.flush()
        linked = np.flatnonzero(links.label != np.arange(len(fp)))
        return pa.table({"a": pa.array(rep[linked]), "b": pa.array(rep[links.label[linked]])})

    return (reps.select("fp", "rep").mapInArrow(deal, placed).groupBy("shard")
            .applyInArrow(search, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    component_id is the smallest doc_id reachable over links of at most
    ``radius`` differing bits.  Null, empty and blank texts have fingerprint zero
    and link like any other.  Repeated rows and ids give a result row each (one
    doc_id with two texts joins both groups); a row without doc_id gets the
    component of its fingerprint, or null if no named row is within reach of it by the same
    fingerprint; an empty table gives no rows; only doc_id and text are read.
    """
    fps = cut(fingerprints(docs, shingle))
    reps = cut(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    linked = components(shard_links(reps, radius, reps.count()).union(_same_id(fps, reps)))
    classes = reps.join(linked, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(classes, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _same_id(fps: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the fingerprints of rows that share a doc_id."""
    twice = fps.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    return fps.join(twice, "doc_id", "left_semi").distinct().join(reps, "fp").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, all
    columns as they were.  Rows that repeat a doc_id are one document.  Rows without
    one are documents by their text: any one of those with equal text stays, unless
    it is near a named document or near another such text of smaller digest."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    same = fresh("_same", docs)
    unnamed = docs.where("doc_id IS NULL").withColumn(same, digest).dropDuplicates([same]).select(*docs.columns)
    docs = docs.where("doc_id IS NOT NULL").unionByName(unnamed)
    # Beyond the ids in use, so that a named document is always the smaller one.
    key = F.coalesce(F.col("doc_id").cast("bigint"),
                     F.lit(UNNAMED) + F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))
    gone = near_duplicates(docs.select(key.alias("doc_id"), "text"), shingle, radius).where("doc_id <> component_id").select(
        F.col("doc_id").alias("_gone"))
    return without(docs, gone, key)
