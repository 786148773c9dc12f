import hashlib
import random
import re

import pytest
from helpers import awkward, docs

from carelens.llm import chat, secrets


def plain_spans(text):
    out = []
    a = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [("assign", m.start(), m.end()) for m in re.finditer(a, text, re.A) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    out.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
    return ",".join(f"{k}:{i}:{j}" for k, i, j in out)


LIVE, COPIED = "Zx9-kQ2mW7_tB4vN8pL3sR6yD1", "Ab3dEf6hIj9kLm2nOp5qRs8tUv"


@pytest.fixture(scope="module")
def found(spark):
    rnd = random.Random(1)
    bits = ["password", "API_KEY", "toKen", "=", ": ", "'", '"', "abcdef0123456789", "AKIA", "Q7XZ9PLM2RTY5WVU", " ",
            "é", "deadbeef", "ſecret=abcdefghijklmn", "."]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))) for i in range(400)]
    rows += [(1000, f"key {LIVE} here", "en", "a"), (1001, f"again {LIVE}", "en", "a"),
             *[(1010 + i, f"sample {COPIED}", "en", f"s{i}") for i in range(4)],
             (1020, "password=hunter2hunter2", "en", "a"), (1021, "password=hunter2hunter2", "en", "b"), (1022, None)]
    return rows, {r.doc_id: r for r in secrets.scan_secrets(docs(spark, rows)).collect()}


def test_base_spans_equal_brute_force(found):
    rows, got = found
    for i, text, *_ in rows:
        base = plain_spans(text or "")
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), text
        assert ",".join(s for s in got[i].spans.split(",") if not s.startswith("owned")) == base
        assert got[i].n_assign + got[i].n_access + got[i].n_hex == len(base.split(",")) * bool(base)


def test_ownership_separates_live_from_copied(found):
    got = found[1]
    assert got[1000].spans == f"owned:4:{4 + len(LIVE)}" and got[1001].n_owned == 1
    assert all(got[1010 + i].spans == "" for i in range(4))
    assert got[1020].n_examples == 1 and got[1020].spans


def test_repositories_alone_decide(spark):
    """One owner: in two repositories a value is live, in three it is an example."""
    once, wide = "Qm4-tR8wZx1_kB7vN3pL9sD6yF2", "Hn5cV2bX8-jK3mQ7_wE4rT9yU1o"
    rows = [(1, f"a {once}", "en", "a"), (2, f"a {once}", "de", "a"),
            *[(10 + i, f"a {wide} password=hunter2hunter2", lang, "a") for i, lang in enumerate(("en", "de", "fr"))]]
    got = {r.doc_id: r for r in secrets.scan_secrets(docs(spark, rows)).collect()}
    assert all(got[i].n_owned == got[i].n_live == 1 for i in (1, 2))
    assert [(s.kind, s.example, s.live, s.owners, s.repositories) for s in got[1].found] == [("owned", False, True, 1, 2)]
    assert all([(s.kind, s.example, s.live, s.owners, s.repositories) for s in got[i].found]
               == [("assign", True, False, 1, 3)] for i in (10, 11, 12))
    more = {r.doc_id: r for r in secrets.scan_secrets(docs(spark, rows), example_repositories=4).collect()}
    assert all(more[i].n_owned == 1 and more[i].n_examples == 0 for i in (10, 11, 12))


def test_ownership_equals_brute_force(spark):
    """Spans, counts and verdicts of random holdings, against plain sets."""
    rnd = random.Random(6)
    values = ["".join(rnd.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJK23456789-_") for _ in range(24)) for _ in range(12)]
    rows = []
    for i in range(150):
        held = rnd.sample(values, rnd.randint(0, 2))
        if held and rnd.random() < 0.3:
            held[0] = "token=" + held[0]
        k = min((values.index(v.removeprefix("token=")) for v in held), default=0)
        rows.append((i, " | ".join(held), rnd.choice(["en", None, "de", "fr"][:1 + k % 4]), rnd.choice(["a", None, "b"][:1 + k % 3])))
    holders = {}
    for _, text, lang, source in rows:
        for part in text.split(" | "):
            holders.setdefault(part.removeprefix("token="), set()).add((source, lang))
    for r in secrets.scan_secrets(docs(spark, rows)).collect():
        _, text, lang, source = rows[r.doc_id]
        want, at = [], 0
        for part in text.split(" | ") if text else []:
            v = part.removeprefix("token=")
            owners, repos = len({s for s, _ in holders[v]}), len(holders[v])
            example = owners >= 2 or repos >= 3
            live = secrets.live_looking(v) and not example
            if part != v or live:
                want.append(("assign" if part != v else "owned", at, at + len(part), example, live, owners, repos))
            at += len(part) + 3
        assert [tuple(s) for s in r.found] == want
        assert (r.n_examples, r.n_live) == (sum(w[3] for w in want), sum(w[4] for w in want))


def test_examples_may_stay(spark):
    rows = [(1, "password=hunter2hunter2 x", "en", "a"), (2, "password=hunter2hunter2 y", "en", "b"), (3, f"z {LIVE}", "en", "a")]
    out = {r.doc_id: r.text for r in secrets.redact(docs(spark, rows), examples=False).collect()}
    assert out == {1: rows[0][1], 2: rows[1][1], 3: "z [SECRET]"}
    assert secrets.redact(docs(spark, rows)).where("text LIKE '%hunter2%'").count() == 0


def test_redaction_and_awkward_tables(spark, found):
    rows = awkward() + [(50, f"x {LIVE} password=abcdefabcdef0123456789 y")]
    d = docs(spark, rows)
    out = secrets.redact(d)
    assert out.columns == d.columns and out.count() == len(rows)
    r = out.where("doc_id = 50").first()
    assert r.text == "x [SECRET] [SECRET] y" and r.n_chars == len(r.text)
    assert sorted(out.where("doc_id < 50").collect(), key=str) == sorted(d.where("doc_id < 50").collect(), key=str)
    assert secrets.scan_secrets(d.limit(0)).count() == 0 and secrets.redact(d.limit(0)).count() == 0


def test_every_turn_reads_back():
    rnd = random.Random(4)
    bits = ["\\", "###", "#", " </turn>\n", "</turn>", " ", "\n", "### user: ", "é😀", ":", "x"]
    for _ in range(4000):
        role, text = ("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6))) for _ in range(2))
        assert chat.parse(chat.render(role, text) * 2)[1][:2] == (role, text)


def test_conversation_digests_equal_brute_force(spark):
    rows = [(1, 1, "assistant", "\\### ok </turn>\n"), (1, 0, "user", None), (2, 0, None, "a"), (2, 0, None, "a"),
            (None, None, "assistant", "é"), (3, 5, "assistant", ""), (3, 2, "a:b\\", "tail\\")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} ### ") for i in range(3000)]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows],
                                  "conv_id bigint, turn bigint, role string, text string, formatted int, trained string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(chat.with_extra(table))).collect()}
    rows += chat.EXTRA_CONVERSATION
    for conv in {r[0] for r in rows}:
        own = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        r = got.pop(conv)
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x}\n{t}\n" for _, _, x, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.render(x, t)) for _, _, x, t in own)
    assert not got
    assert chat.conversation_digests(chat.format_turns(table.limit(0))).count() == 0
