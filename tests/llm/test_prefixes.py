import hashlib
import random
import zlib

import numpy as np
import pytest

from carelens.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, depth int, n int"


def brute(rows, rebuild=True):
    """Nodes by plain dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        made[c] = tuple(own.get(c - c % 5, [])[:h] + s[h:]) if rebuild else tuple(s)
    members = {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        saved[p] = sum(saved[k] for k in below) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        leaves[p] = sum(leaves[k] for k in below) or 1
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def nodes(spark, rows, **how):
    table = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in prefixes.prefix_trie(table, **how).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def conversations(seed=3, n=150):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        shared = [("system", "be kind")] * (c % 3 == 0) + [("user", "hi é")] * (c % 7 != 0) + [("user", "same")] * (5 * (c % 4 == 0))
        for i, (r, t) in enumerate(shared + [(rnd.choice(["user", "assistant"]), rnd.choice("abcd") * rnd.randint(0, 2))
                                             for _ in range(rnd.randint(0, 5))]):
            rows.append((c, i, r, t))
    return rows + [(200 + c, i, "user", f"copy {i}") for c in range(0, 60, 5) for i in range(3)]


@pytest.mark.parametrize("limit", [1, 4, 2000])
def test_nodes_equal_brute_force_whatever_the_shards(spark, monkeypatch, limit):
    monkeypatch.setattr(prefixes, "PIECE", 4)
    monkeypatch.setattr(prefixes, "BATCH_TURNS", 60)
    if limit == 4:
        monkeypatch.setattr(prefixes, "BROADCAST_NODES", 0)
    rows = conversations()
    assert nodes(spark, rows, shard=limit) == brute(rows)


def test_awkward_conversations(spark):
    rows = [(0, None, None, None), (0, None, "user", "b"), (0, 1, "user", "x"), (0, 1, "user", "x"), (1, 0, "a", ""), (None, 0, "u", "t"),
            (7, 0, "user", "donor is absent"), (-3, 1, "", "ß" * 30_000), (3, 0, "a", "b"), (3, 1, "ab", "")]
    rows += [(9, i, "user", "long") for i in range(3000)]
    plain = [r for r in rows if r[0] is None or r[0] >= 0]
    assert nodes(spark, plain) == brute(plain)
    assert nodes(spark, rows, rebuild=False) == brute(rows, rebuild=False)
    assert nodes(spark, []) == []


def test_double_array_holds_exactly_its_sequences():
    rnd = np.random.default_rng(1)
    lengths = rnd.integers(0, 9, 400)
    starts = np.cumsum(lengths) - lengths
    symbols = rnd.integers(0, 40, int(lengths.sum())) ** 2 % 37
    trie = prefixes.DoubleArray(symbols, starts, lengths)
    want = {tuple(symbols[s:s + d]) for s, n in zip(starts, lengths) for d in range(n + 1)}
    assert sum(len(x) for x in trie.levels) == len(want) == int((trie.check >= 0).sum())
    assert trie.end < 2 * len(want) + 100
    ends = {}
    for depth, rows, node in trie.walk():
        for r, x in zip(rows.tolist(), node.tolist()):
            assert ends.setdefault(x, tuple(symbols[starts[r]:starts[r] + depth])) == tuple(symbols[starts[r]:starts[r] + depth])
