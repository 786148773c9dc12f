"""Conversation prefix trie by double arrays (operator 12).

Conversations are sequences of turns; each distinct prefix is a node.  A turn is
named by 128 bits of the SHA-256 of its role and text, so texts are hashed where
they are read and never moved.  Equal sequences are one sequence with a weight.

Sequences are dealt into shards by their first turns.  A prefix with more than
``SHARD`` distinct sequences is cut deeper (twice as many turns, and so on), so
that a first turn that a third of all conversations share is many shards.  All
nodes below a shard's cut belong to it alone.  A task numbers the turns it meets
densely, packs the tries of its shards into BASE and CHECK arrays
(child = BASE[node] + turn, CHECK[child] = node), traverses them for the nodes, and
sums their subtrees from the leaves up.  The nodes down to the cut are shared:
every shard gives its part of them, and the parts are merged globally.

Their subtree sums need no pass per level: a node counts for the shard that has
its smallest conversation, a shard's own nodes are the end of its path, and so a
sum along each path from the cut upwards, added up by node, meets every node once.

Bounds: a conversation's turns are one row of 16 bytes and a length each; a shard
has ``SHARD`` such rows.  SHA-256 is sequential, so the list of conversations that
end at one node is sorted and joined by ranges, and its pieces hashed one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, in_batches

# Fixed values of the contract: conversations that share a donor, and the turns taken from it.
DONOR_EVERY, TAKE = 5, 9
KEY = 16
# Distinct sequences up to which a prefix is one shard.
SHARD = 2000
# Turns whose tries a task packs at once, and conversations joined into one piece of a list.
BATCH_TURNS, PIECE = 400_000, 50_000
# Shared nodes (about 100 bytes each) up to which they are broadcast.
BROADCAST_NODES = 100_000
# Gaps tried for a node with several children before it goes to the end of the arrays.
TRIES = 8


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, keys (16 bytes a turn, in order) and sizes (UTF-8 bytes of the texts)."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    turn = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), role.alias("role"),
                    key.alias("key"), F.octet_length(text).cast("bigint").alias("size"))
    return (conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
            .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
            .select("conv_id", F.unhex(F.array_join("t.key", "")).alias("keys"), F.col("t.size").alias("sizes")))


def rebuilt(seqs: DataFrame, every: int = DONOR_EVERY, take: int = TAKE) -> DataFrame:
    """Each sequence with its first h turns replaced by those of conversation
    c - c % every (the remainder has the sign of c), h being crc32(c) % take."""
    donor = F.col("conv_id") - F.col("conv_id") % every
    heads = seqs.select(F.col("conv_id").alias("_donor"), F.expr(f"substring(keys, 1, {KEY * (take - 1)})").alias("_keys"),
                        F.slice("sizes", 1, take - 1).alias("_sizes"))
    own = seqs.withColumns({"_h": (F.crc32(F.col("conv_id").cast("string")) % take).cast("int"), "_donor": donor})
    none = F.array().cast("array<bigint>")
    return own.join(heads, "_donor", "left").select(
        "conv_id", F.expr(f"concat(coalesce(substring(_keys, 1, {KEY} * _h), X''), substring(keys, {KEY} * _h + 1))").alias("keys"),
        F.concat(F.coalesce(F.slice("_sizes", F.lit(1), F.col("_h")), none),
                 F.slice("sizes", F.col("_h") + 1, F.greatest(F.size("sizes") - F.col("_h"), F.lit(0)))).alias("sizes"))


def _runs(batches, key, value):
    """(key, list of values) of sorted rows, a key's values in parts of at most PIECE."""
    at, held = None, []
    for b in batches:
        for k, v in zip(b.column(key).to_pylist(), b.column(value).to_pylist()):
            if k != at or len(held) == PIECE:
                if held:
                    yield at, held
                at, held = k, []
            held.append(v)
    if held:
        yield at, held


def ended(convs: DataFrame) -> DataFrame:
    """(whole, conv_id, n, ends) of the conversations (whole, conv_id) with equal
    sequences: the smallest, their number, and the digest of their joined ids."""
    piece = T.StructType.fromDDL("whole string, first bigint, n bigint, ids string")
    out = T.StructType.fromDDL("whole string, conv_id bigint, n bigint, ends string")
    a_piece, a_out = to_arrow_schema(piece), to_arrow_schema(out)

    def join(batches):
        yield from in_batches(((k, v[0], len(v), ",".join(map(str, v))) for k, v in _runs(batches, "whole", "conv_id")),
                               a_piece, 500)

    def digest(batches):
        def rows():
            at = first = total = sha = None
            for b in batches:
                for k, f, n, ids in zip(*(c.to_pylist() for c in b.columns)):
                    if k != at:
                        if at is not None:
                            yield at, first, total, sha.hexdigest()
                        at, first, total, sha = k, f, 0, hashlib.sha256()
                    elif total:
                        sha.update(b",")
                    sha.update(ids.encode())
                    total += n
            if at is not None:
                yield at, first, total, sha.hexdigest()
        yield from in_batches(rows(), a_out)

    return (convs.select("whole", "conv_id").repartitionByRange("whole", "conv_id").sortWithinPartitions("whole", "conv_id")
            .mapInArrow(join, piece).repartition("whole").sortWithinPartitions("whole", "first").mapInArrow(digest, out))


def sharded(distinct: DataFrame, limit: int) -> DataFrame:
    """Add ``cut`` (turns down to which a sequence's nodes are shared) and ``shard``."""
    parts, k = [], 1
    while True:
        # A sequence that ends before the cut is a shard of its own.
        long = F.length("keys") >= k * KEY
        at = F.when(long, F.sha2(F.expr(f"substring(keys, 1, {k * KEY})"), 256)).otherwise(F.col("whole"))
        here = distinct.withColumns({"cut": F.when(long, F.lit(k)).otherwise((F.length("keys") / KEY).cast("int")), "shard": at})
        hot = cut(here.groupBy("shard").count().where(F.col("count") > limit).select(F.col("shard").alias("_hot")))
        if not hot.count():
            parts.append(here)
            break
        parts.append(here.join(hot, F.col("shard") == F.col("_hot"), "left_anti"))
        distinct = cut(here.join(hot, F.col("shard") == F.col("_hot"), "left_semi").drop("cut", "shard"))
        k *= 2
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.union(more)
    return rows


class DoubleArray:
    """A trie over dense symbols: the child of node s by symbol c is BASE[s] + c,
    if CHECK there is s.  Node 0 is the root; ``levels`` are the nodes by depth.
    Symbols are numbered anew as they are met from the root down, children of a
    node one after another, so that siblings lie close together in the arrays."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.symbols, self.starts, self.lengths = symbols.copy(), starts, lengths
        self.base, self.check = np.zeros(64, np.int64), np.full(64, -1, np.int64)
        self.check[0] = 0
        # Slots from ``end`` on were never used; ``free`` are the gaps before it.
        self.end, self.free = 1, np.empty(0, np.int64)
        self.levels = [np.zeros(1, np.int64)]
        number, met = np.full(int(symbols.max(initial=-1)) + 1, -1, np.int64), 0
        at, rows = np.zeros(len(starts), np.int64), np.arange(len(starts))
        for depth in range(int(lengths.max(initial=0))):
            rows = rows[lengths[rows] > depth]
            c = symbols[starts[rows] + depth]
            new = c[np.lexsort((c, at[rows]))]
            new = new[number[new] < 0]
            new = new[np.sort(np.unique(new, return_index=True)[1])]
            number[new] = met + np.arange(len(new))
            met += len(new)
            c = self.symbols[starts[rows] + depth] = number[c]
            order = np.lexsort((c, at[rows]))
            s, c_sorted = at[rows][order], c[order]
            first = np.r_[True, (s[1:] != s[:-1]) | (c_sorted[1:] != c_sorted[:-1])]
            self._pack(s[first], c_sorted[first])
            at[rows] = self.base[at[rows]] + c
            self.levels.append(np.unique(at[rows]))

    def _reach(self, end: int):
        """Move ``end`` up, growing the arrays by doubling."""
        if end > len(self.check):
            size = max(end, 2 * len(self.check))
            self.base = np.r_[self.base, np.zeros(size - len(self.base), np.int64)]
            self.check = np.r_[self.check, np.full(size - len(self.check), -1, np.int64)]
        self.end = max(self.end, end)

    def _pack(self, node: np.ndarray, symbol: np.ndarray):
        """Place the children (sorted node, symbol) of one level."""
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        count = np.diff(np.r_[first, len(node)])
        # Nodes with several children: the first fit among some gaps, or the end.
        at, before = 0, self.end
        for f, n in zip(first[count > 1].tolist(), count[count > 1].tolist()):
            c = symbol[f:f + n]
            while at < len(self.free) and self.check[self.free[at]] >= 0:
                at += 1
            for base in (self.free[at:at + TRIES] - c[0]).tolist():
                if base + c[-1] < self.end and (self.check[base + c] < 0).all():
                    break
            else:
                base = self.end - int(c[0])
                self._reach(base + int(c[-1]) + 1)
            self.base[node[f]] = base
            self.check[base + c] = node[f]
        if (count > 1).any():
            gaps = np.r_[self.free, np.arange(before, self.end)]
            self.free = gaps[self.check[gaps] < 0]
        # An only child fits any free slot.
        one = first[count == 1]
        fresh = max(0, len(one) - len(self.free))
        slot = np.r_[self.free[:len(one)], np.arange(self.end, self.end + fresh)]
        self.free = self.free[len(one):]
        self._reach(self.end + fresh)
        self.base[node[one]] = slot - symbol[one]
        self.check[slot] = node[one]

    def walk(self):
        """(depth, rows still going, the node each has reached), by following the arrays."""
        at, rows = np.zeros(len(self.starts), np.int64), np.arange(len(self.starts))
        depth = 0
        while True:
            rows = rows[self.lengths[rows] > depth]
            if not len(rows):
                return
            child = self.base[at[rows]] + self.symbols[self.starts[rows] + depth]
            if not (self.check[child] == at[rows]).all():
                raise AssertionError("a sequence left the trie")
            at[rows] = child
            depth += 1
            yield depth, rows, child


NODE = ("key string, parent string, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "size bigint, n_leaves bigint, saved_tokens bigint, ends string, owner bigint")


def _tries(rows: dict) -> list[list]:
    """Columns of NODE for some whole shards: nodes below the cut, finished, and
    (with a key) each shard's part of the nodes down to the cut."""
    conv, weight = np.array(rows["conv_id"], np.int64), np.array(rows["n"], np.int64)
    depth_cut = np.array(rows["cut"], np.int64)
    _, head, shard = np.unique(rows["shard"], return_index=True, return_inverse=True)
    length = np.array([len(k) // KEY for k in rows["keys"]], np.int64)
    start = np.cumsum(length) - length
    raw = np.frombuffer(b"".join(rows["keys"]), f"S{KEY}")
    sizes = np.concatenate([np.array(s, np.int64) for s in rows["sizes"]]) if len(raw) else np.empty(0, np.int64)
    dense = np.unique(raw, return_inverse=True)[1].astype(np.int64) + len(head)
    # One trie for all shards: the first symbol of a row is its shard, the others its turns below the cut.
    below = length - depth_cut
    at = np.cumsum(below + 1) - (below + 1)
    symbols = np.empty(int((below + 1).sum()), np.int64)
    size_of = np.zeros(len(symbols), np.int64)
    symbols[at] = shard
    inner = np.ones(len(symbols), bool)
    inner[at] = False
    take = np.repeat(start + depth_cut, below) + np.arange(int(below.sum())) - np.repeat(np.cumsum(below) - below, below)
    symbols[inner], size_of[inner] = dense[take], sizes[take]
    trie = DoubleArray(symbols, at, below + 1)

    slots = len(trie.check)
    n, size, saved, leaves = (np.zeros(slots, np.int64) for _ in range(4))
    least = np.full(slots, np.iinfo(np.int64).max)
    level, last = np.zeros(slots, np.int64), np.zeros(len(conv), np.int64)
    cut_of = np.zeros(slots, np.int64)
    for depth, r, node in trie.walk():
        np.add.at(n, node, weight[r])
        np.minimum.at(least, node, conv[r])
        size[node], level[node], cut_of[node], last[r] = size_of[at[r] + depth - 1], depth, depth_cut[r], node
    used = np.flatnonzero(trie.check >= 0)
    used = used[used != 0]
    children = np.bincount(trie.check[used], minlength=slots)
    deep = used[level[used] > 1]
    saved[deep] = (n[deep] - 1) * size[deep]
    leaves[deep] = children[deep] == 0
    for nodes in trie.levels[:1:-1]:
        np.add.at(saved, trie.check[nodes], saved[nodes])
        np.add.at(leaves, trie.check[nodes], leaves[nodes])
    ends = np.full(slots, None, object)
    ends[last] = rows["ends"]

    none = [None] * len(deep)
    out = [none[:], none[:], (cut_of[deep] + level[deep] - 1).tolist(), least[deep].tolist(), least[trie.check[deep]].tolist(),
           n[deep].tolist(), children[deep].tolist(), size[deep].tolist(), leaves[deep].tolist(), saved[deep].tolist(),
           ends[deep].tolist(), none[:]]
    top = np.empty(len(head), np.int64)
    top[shard] = trie.base[0] + trie.symbols[at]
    for i, h in enumerate(head.tolist()):
        node, cut_at, before, sha = int(top[i]), int(depth_cut[h]), None, hashlib.sha256()
        for d in range(cut_at + 1):
            if d:
                sha.update(rows["keys"][h][KEY * (d - 1):KEY * d])
            key, end = f"{d}:{sha.hexdigest()[:32]}", d == cut_at
            values = (key, before, d, int(least[node]), None, int(n[node]), int(children[node]) if end else 0,
                      int(sizes[start[h] + d - 1]) if d else 0, int(leaves[node]), int(saved[node]),
                      ends[node] if end else None, int(least[node]))
            for column, v in zip(out, values):
                column.append(v)
            before = key
    return out


def shard_nodes(rows: DataFrame) -> DataFrame:
    """The nodes (NODE) of sequences with shard and cut; see ``_tries``."""
    schema = T.StructType.fromDDL(NODE)
    arrow = to_arrow_schema(schema)
    names = ("shard", "cut", "conv_id", "n", "ends", "keys", "sizes")

    def run(batches):
        held = {c: [] for c in names}
        turns = 0

        def flush():
            for i in range(0, len((got := _tries(held))[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 20_000], f.type) for c, f in zip(got, arrow)], schema=arrow)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in names)):
                if turns >= BATCH_TURNS and row[0] != held["shard"][-1]:
                    yield from flush()
                    held, turns = {c: [] for c in names}, 0
                for c, v in zip(names, row):
                    held[c].append(v)
                turns += len(row[5]) // KEY + 1
        if turns:
            yield from flush()

    return rows.select(*names).repartition("shard").sortWithinPartitions("shard", "conv_id").mapInArrow(run, schema)


def _merged(parts: DataFrame) -> DataFrame:
    """The shared nodes, from the shards' parts of them."""
    nodes = cut(parts.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("_below"), F.max("size").alias("size"),
        F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"), F.max("ends").alias("ends")))
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("_kids"))
    nodes = cut(nodes.join(kids, "key", "left").withColumn("n_children", F.col("_below") + F.coalesce("_kids", F.lit(0))).drop("_kids", "_below"))
    own = nodes.select("key", F.col("conv_id").alias("_least"), ((F.col("n_convs") - 1) * F.col("size")).alias("_s"),
                       (F.col("n_children") == 0).cast("bigint").alias("_l"))
    if nodes.count() <= BROADCAST_NODES:
        own = F.broadcast(own)
    # Each node counts once, in the shard of its smallest conversation; the path is summed from the cut upwards.
    mine = F.col("_least") == F.col("owner")
    up = Window.partitionBy("owner").orderBy(F.desc("depth"))
    sums = (parts.select("key", "depth", "owner").join(own, "key")
            .select("key", F.sum(F.when(mine, F.col("_s")).otherwise(0)).over(up).alias("_s"),
                    F.sum(F.when(mine, F.col("_l")).otherwise(0)).over(up).alias("_l"))
            .groupBy("key").agg(F.sum("_s").alias("_s"), F.sum("_l").alias("_l")))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(sums, "key").join(above, "parent", "left")
            .withColumns({"n_leaves": F.col("_leaves") + F.col("_l"), "saved_tokens": F.col("_saved") + F.col("_s")}))


def prefix_trie(conversations: DataFrame, shard: int = SHARD, rebuild: bool = True) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 of every node.

    Turns are ordered by turn (null first), ties by role and then by the digest of
    role and text; repeated rows are turns like any other.  A null role or text is
    empty; a row without conv_id belongs to no conversation and is left out.
    ``rebuild`` False takes the conversations as they are.  An empty table has no
    node, not even a root.  Only conv_id, turn, role and text are read.
    """
    seqs = cut(sequences(conversations))
    convs = rebuilt(seqs) if rebuild else seqs
    convs = cut(convs.withColumn("whole", F.sha2("keys", 256)))
    ends = ended(convs)
    distinct = cut(convs.join(ends.drop("whole"), "conv_id"))
    nodes = cut(shard_nodes(sharded(distinct, shard)))
    done = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    every = nodes.where("key IS NULL").select(*done).union(_merged(nodes.where("key IS NOT NULL")).select(*done))
    return every.withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit(""), 256))).drop("ends")
