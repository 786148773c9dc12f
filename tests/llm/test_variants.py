import random
import re
import zlib
from collections import Counter

import pytest
from helpers import awkward, docs

from carelens.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(rows):
    n = Counter()
    for doc, text, *_ in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= 2 * n[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def found(spark, rows):
    got = variants.spelling_variants(docs(spark, rows)).collect()
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got)


def test_variants_equal_brute_force(spark):
    rnd = random.Random(4)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 8))) for _ in range(60)]
    rows = [(i, " ".join(rnd.choice(stems[:1 + i % 60]) + rnd.choice(["", "", "s", "É", "ba"]) for _ in range(60))) for i in range(80)]
    rows += [(9, "kette " * 20 + "ketten " * 9 + "kettens " * 4), (None, "Straße straße STRAßE strasse strasse strasse strase strase strase"), (3, "ab" * 5000 + " "), (3, "ab" * 5000), (3, "ab" * 5000),
             (4, ("ab" * 5000 + "x ") * 4), (4, ("ab" * 2000 + "c" + "ab" * 3000 + " ") * 9)]
    want = brute(rows)
    assert len(want) > 100 and any(w[1] and w[2] != w[1] for w in want)
    assert found(spark, rows) == want


@pytest.mark.parametrize("levels", [0, 1, 30])
def test_neighbours_of_all_short_words(spark, levels):
    import itertools
    words = ["".join(x) for n in (1, 2, 3, 4, 5) for x in itertools.product("ab", repeat=n)]
    frame = spark.createDataFrame(list(enumerate(words)), "id bigint, word string")
    got = {(words[r.a], words[r.b]) for r in variants.neighbours(frame, levels).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_awkward_rows(spark):
    assert found(spark, awkward()) == brute(awkward())
    assert found(spark, []) == []
