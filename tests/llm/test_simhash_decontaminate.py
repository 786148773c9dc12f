import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from helpers import awkward, docs

from carelens.llm import decontaminate, simhash
from carelens.llm.common import components


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, radius):
    root = dict.fromkeys(values)
    for a in values:
        root[a] = a
    find = lambda a: a if root[a] == a else find(root[a])
    keys = sorted(values)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {a: find(a) for a in keys}


def test_groups_equal_brute_force(spark):
    rnd = random.Random(1)
    vocab = ["".join(rnd.choice("abcdÉß") for _ in range(4)) for _ in range(300)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 150))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base * 3:
        c = list(b)
        c[rnd.randrange(len(c))] = rnd.choice(vocab)
        texts.append("\n ".join(c).upper() if rnd.random() < .2 else " ".join(c))
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + i, t) for i, (_, t, *_) in enumerate(awkward()) if not t or len(t) < 999]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    values = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == values
    assert {i: r.component_id for i, r in got.items()} == plain_components(values, 4)
    assert simhash.keep_one(docs(spark, rows)).count() == len({r.component_id for r in got.values()})


def test_awkward_and_empty_tables(spark):
    rows = awkward()
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3, 9)} == {1}
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0
    assert simhash.keep_one(docs(spark, [(1, "a b"), (1, "c d"), (2, "c d"), (3, "e")])).count() == 3


def cluster(rng, n):
    """Random values, a dense cluster around one, and chains of 4-bit steps."""
    far = rng.integers(0, 2**63, n, dtype=np.uint64) * 2 + rng.integers(0, 2, n, dtype=np.uint64)
    near = far[0] ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    chain = [int(far[1])]
    for _ in range(30):
        chain.append(chain[-1] ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
    return np.unique(np.r_[far, near, np.array(chain, np.uint64)])


@pytest.mark.parametrize("shard,leaf", [(40, 8), (10**6, 4), (100, 256)])
def test_sharded_search_finds_every_link(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "LEAF", leaf)
    values = cluster(np.random.default_rng(3), 300)
    reps = spark.createDataFrame([(int(v), i) for i, v in enumerate(values.view(np.int64))], "fp bigint, rep bigint")
    edges = simhash.shard_links(reps, 4, len(values))
    got = {r.node: r.root for r in components(edges).collect()}
    want = plain_components({i: int(v) for i, v in enumerate(values)}, 4)
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (9, 9)]
    rnd.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_decontamination(text, items):
    w, hit, ids = plain_words(text), set(), set()
    for item, t in items:
        x = plain_words(t)
        n = min(13, len(x))
        for i in range(len(x) - n + 1 if x else 0):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == x[i:i + n]:
                    hit |= set(range(j, j + n))
                    ids.add(str(item))
    return (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(w))


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_hits_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", broadcast)
    rnd = random.Random(7)
    vocab = ["ab", "É", "c1", "日本", "zz", "the", "x"] + [f"w{i}" for i in range(30)]
    item = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 4, 5, 13, 20, 31])))) for i in range(25)]
    item += [(25, "the the the the the the the the the the the the the the the"), (26, None), (27, "-- !"), (3, "again the zz")]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            x = (item[rnd.randrange(25)][1]).split()
            a = rnd.randrange(len(x))
            parts += x[a:a + rnd.randint(1, 20)] if rnd.random() < .5 else x
            parts += [rnd.choice(vocab) for _ in range(rnd.randint(0, 6))]
        rows.append((i, rnd.choice([" ", ", ", "\n{"]).join(parts).replace("the", "The")))
    rows += [(200, None), (201, "the " * 40), (202, "")]
    bench = spark.createDataFrame([(*x, "c") for x in item], "item_id bigint, text string, window string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()}
    for i, t in rows:
        assert got[i] == plain_decontamination(t, item), t
    kept = decontaminate.drop_contaminated(docs(spark, rows), bench)
    assert kept.count() == sum(not r[-1] for r in got.values())


def test_decontamination_of_awkward_and_empty_tables(spark):
    rows, bench = awkward(), spark.createDataFrame([(1, "one"), (None, "here")], "item_id bigint, text string")
    got = decontaminate.decontaminate(docs(spark, rows), bench).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.contaminated} == {4, 5}
    assert decontaminate.decontaminate(docs(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs(spark, rows).limit(0), bench).count() == 0
