import hashlib
import random

import numpy as np
import pytest
from helpers import awkward, docs

from carelens.llm import repeats


def plain(rows):
    """Per (doc, text): removed flags by a dictionary over all strings in order."""
    seen, out = {}, []
    order = sorted({(i if i is not None else repeats.LAST_ID, t or "") for i, t in rows}, key=lambda r: (r[0], r[1]))
    for doc, text in order:
        raw = text.encode()
        flags = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if seen.setdefault(raw[p:p + 100], (doc, p)) != (doc, p):
                flags[p:p + 100] = b"\1" * 100
        out.append(((doc, text), flags))
    return dict(out)


def awkward_texts(rnd):
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(40)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [prose(rnd.choice([15, 25, 40, 80])) for _ in range(12)] + ["ab" * 90, "x" * 300]
    texts = []
    for _ in range(120):
        parts = [rnd.choice(passages)[rnd.randint(0, 9):] if rnd.random() < .5 else prose(rnd.randint(1, 40)) for _ in range(rnd.randint(0, 6))]
        texts.append("\n".join(parts))
    for t in texts[:30]:
        i = rnd.randrange(len(t) + 1)
        texts.append(t[:i] + rnd.choice(["", "Z", "é"]) + t[i + 1:])
    return texts + texts[:20]


@pytest.mark.parametrize("run_bytes,many", [(8 << 20, 2048), (2000, 2)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, run_bytes, many):
    rnd = random.Random(3)
    rows = [(i, t) for i, t in enumerate(awkward_texts(rnd))] + [(500, None), (501, ""), (502, "z" * 100), (503, "z" * 99)]
    want = plain(rows)
    # Smaller runs and array comparison: the same result from many runs.
    packed, plain_group = {}, {}
    for i, t in rows:
        raw = (t or "").encode()
        pos, h = repeats.anchors(raw)
        for p, k in zip(pos.tolist(), (h % 5).tolist()):
            packed.setdefault((k, i // (200 if run_bytes > 9999 else 3)), []).append(
                (raw[p:p + 100], raw[max(0, p - repeats.REACH):p], i, 0, p))
    monkeypatch.setattr(repeats, "MANY", many)
    spans = {}
    for k in range(5):
        for d, _, a, b in repeats.merge_bucket([repeats.pack_run(v) for (x, _), v in sorted(packed.items()) if x == k]):
            spans.setdefault(d, []).append((a, b))
    for i, t in rows:
        raw = (t or "").encode()
        runs, _ = repeats.without_intervals(raw, spans.get(i, []))
        flags = bytearray(len(raw))
        for a, b in runs:
            flags[a:b] = b"\1" * (b - a)
        assert flags == want[i, t or ""], i


@pytest.mark.parametrize("run_bytes", [8 << 20, 1500])
def test_rows_equal_brute_force(spark, monkeypatch, run_bytes):
    monkeypatch.setattr(repeats, "RUN_BYTES", run_bytes)
    rnd = random.Random(4)
    rows = [(rnd.randrange(10**6), t) for t in awkward_texts(rnd)[:90]]
    rows += [(i, t) for i, t, *_ in awkward() if not t or len(t) < 9999] + [rows[0], (None, rows[1][1])]
    want = plain(rows)
    got = repeats.remove_repeats(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for i, t in rows:
        flags = want[i if i is not None else repeats.LAST_ID, t or ""]
        raw = (t or "").encode()
        kept = bytes(c for c, f in zip(raw, flags) if not f)
        n_spans = sum(f and (j == 0 or not flags[j - 1]) for j, f in enumerate(flags))
        by_id.setdefault(i, []).append((len(raw), sum(flags), n_spans, hashlib.sha256(kept).hexdigest()))
    for i in by_id:
        assert sorted(by_id[i]) == sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id == i)
    assert repeats.remove_repeats(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("hot,held", [(40, 1 << 17), (2, 50)])
def test_hot_anchors_go_to_no_bucket_and_leave_nothing(spark, monkeypatch, hot, held):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "HELD", held)
    rnd = random.Random(8)
    prose = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    footer, line = prose(150), prose(110)
    # Every occurrence stands in other surroundings; one footer is cut short, one document comes twice.
    texts = [prose(rnd.randint(0, 150)) + (footer if i % 3 else line) + prose(rnd.randint(0, 150)) for i in range(150)]
    rows = [(rnd.randrange(10**6), t) for t in [*texts, footer[:99] + "Z", footer + footer, *awkward_texts(rnd)[:30]]]
    rows += [rows[0], (rows[1][0], rows[2][1]), (None, rows[1][1]), (None, None)]
    table = docs(spark, rows)
    src = repeats._identified(table)
    total = sum(len((t or "").encode()) for _, t in rows)
    cells = repeats.hot_cells(src, total, hot)
    text = {(r.doc, r.hash): r.text for r in src.collect()}
    sent = {}
    for r in repeats.repeated_anchors(src, total, cells).collect():
        raw = text[r.doc, r.hash].encode()
        for p in np.frombuffer(r.at, np.uint32).tolist():
            gram = raw[p:p + repeats.GRAM]
            sent[gram] = sent.get(gram, 0) + 1
    assert max(sent.values(), default=0) <= hot
    want = plain(rows)
    got = repeats.remove_repeats(table).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1], r[2])
    expect = []
    for i, t in rows:
        flags = want[i if i is not None else repeats.LAST_ID, t or ""]
        expect.append((i, len(flags), sum(flags), hashlib.sha256(bytes(c for c, f in zip((t or "").encode(), flags) if not f)).hexdigest()))
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(expect, key=key)


def test_merge_yields_sorted_suffixes_with_their_common_prefixes():
    rnd = random.Random(5)
    runs = []
    for r in range(7):
        runs.append([(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 12))), bytes([r]), i, 0, r) for i in range(rnd.randint(0, 40))])
    read = [repeats.Run(repeats.pack_run(list(r))) for r in runs]
    got = [(lcp, read[r].keys[i]) for lcp, r, i in repeats.merge_runs(read)]
    assert [k for _, k in got] == sorted(k for r in read for k in r.keys)
    for (_, a), (lcp, b) in zip(got, got[1:]):
        assert lcp == repeats.common_prefix(a, b, 0)


def test_very_long_text_in_blocks(monkeypatch):
    raw = bytes(random.Random(6).choices(range(256), k=9000)) * 2
    whole = repeats.anchors(raw)[0].tolist()
    monkeypatch.setattr(repeats, "BLOCK", 1000)
    assert repeats.anchors(raw)[0].tolist() == whole
