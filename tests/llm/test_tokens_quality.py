import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, docs
from tokenizers import Tokenizer

from carelens.llm import quality, tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


def test_counts_equal_the_library(spark, library):
    rnd = random.Random(5)
    alpha = "aAbeéΣ1½'stsr \n\t日😀!-"
    texts = [t for _, t, *_ in awkward()] + ["<|endoftext|>x<|startoftext|>", "aaaa aaaaaaa", "I'LL 12 Ⅻ"]
    texts += ["".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 50))) for _ in range(300)]
    got = tokens.token_counts(docs(spark, list(enumerate(texts)))).collect()
    want = {i: len(library.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 2048) for r in got)


def test_tokens_of_awkward_and_empty_tables(spark):
    rows = awkward()
    assert tokens.token_counts(docs(spark, rows)).count() == len(rows)
    assert tokens.token_counts(docs(spark, rows).limit(0)).count() == 0


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit))


def test_statistics_equal_brute_force():
    rnd = random.Random(2)
    texts = [t for _, t, *_ in awkward() if not t or len(t) < 10_000]
    texts += ["".join(rnd.choice("ab# |é\n\n \t") for _ in range(rnd.randint(0, 120))) for _ in range(400)]
    for t in texts:
        assert quality.statistics(t) == plain_statistics(t), t


def prose(rnd, n):
    return " ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_outliers_go_and_clean_documents_stay(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, rnd.randint(60, 400)), "en", f"src{i % 7 if i % 3 else 0}") for i in range(600)]
    rows += [(1000 + i, " | ".join(prose(rnd, 120).split()), "en", "src0") for i in range(40)]
    rows += [(2000 + i, "### ".join(prose(rnd, 120).split()), "xx", "rare") for i in range(3)]
    rows += [(3000, "short one"), (3001, None)]
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows)).collect()}
    assert all(got[i].kept for i in range(600))
    assert not any(r.kept for i, r in got.items() if i >= 1000)
    assert all(got[i].base_failed for i in (3000, 3001)) and not got[1000].base_failed
    kept = quality.keep_good(docs(spark, rows))
    assert kept.count() == 600 and "_g" in kept.columns


def plain_mcd(x, rnd):
    """Mean and regularised covariance of least determinant, exact shares, many starts."""
    best = None
    for start in range(30):
        part = x if start == 0 else x[rnd.choice(len(x), min(len(x), 8), replace=False)]
        for _ in range(25):
            mean, cov = part.mean(0), quality.CONSISTENCY * np.cov(part.T, bias=True) + np.diag(np.square(quality.FLOORS))
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            part = x[np.argsort(d, kind="stable")[:math.ceil(quality.COVERAGE * len(x))]]
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, mean, cov
    return best


def plain_vector(stats):
    n, chars, symbols, lines, repeat = stats
    return math.log1p(n), math.log(chars / n), math.log1p(10 * symbols / n), math.log1p(lines), repeat / n


def mixed_table():
    """Two large groups, one with a fifth of stuffed documents that lie together, and a small one."""
    rnd = random.Random(12)
    rows = []
    for i in range(520):
        lang, source = ("en", "a") if i < 250 else ("en", "b") if i < 450 else ("de", "a") if i < 510 else ("de", "c")
        text = prose(rnd, int(60 * math.exp(rnd.random() * 2)))
        if source == "b" and i % 5 == 0:
            text = " ## ".join(prose(rnd, rnd.randint(300, 340)).split())
        elif i % 41 == 0:
            text += " &&& %%%" * (len(text) // 9)
        elif i % 7 == 0:
            text += "\n" + "\n".join([prose(rnd, 4)] * 2)
        rows.append((i, text, lang, source))
    return rows


def test_verdicts_equal_a_plain_estimate(spark):
    rows, rnd = mixed_table(), np.random.default_rng(2)
    stats = {i: plain_statistics(t) for i, t, *_ in rows}
    x = {i: np.array(plain_vector(s)) for i, s in stats.items()}
    base = {i: s[0] < 50 or 100 * s[4] > 50 * s[0] for i, s in stats.items()}
    fits = {}

    def fit(*group):
        if group not in fits:
            own = np.stack([x[r[0]] for r in rows if r[2:2 + len(group)] == group and not base[r[0]]])
            _, mean, cov = plain_mcd(own, rnd)
            if group:
                wide, w = fit(*group[:-1]), len(own) / (len(own) + quality.PRIOR_ROWS)
                mean, cov = w * mean + (1 - w) * wide[0], w * cov + (1 - w) * wide[1]
            fits[group] = mean, cov
        return fits[group]

    got = {r.doc_id: r for r in quality.judge(docs(spark, rows)).collect()}
    near = 0
    for i, _, lang, source in rows:
        mean, cov = fit(lang, source)
        want = (x[i] - mean) @ np.linalg.inv(cov) @ (x[i] - mean)
        assert got[i].base_failed == base[i]
        assert got[i].distance == pytest.approx(want, rel=0.15, abs=0.3)
        if abs(want / quality.CUTOFF - 1) < 0.15:
            near += 1
        else:
            assert got[i].kept == (not base[i] and want <= quality.CUTOFF)
    assert near < 10 and 40 < sum(not r.kept for r in got.values()) < 70


def test_least_determinant_of_the_starts_is_kept(spark):
    table = docs(spark, mixed_table())
    v = quality._vectors(quality.with_statistics(table)).where("NOT base_failed").selectExpr("'[]' _g", "_draw", *quality.FEATURES).cache()
    params = quality.cut(quality._starts(v))
    assert params.count() == quality.STARTS
    for _ in range(quality.SHORT_STEPS):
        params = quality.cut(quality._concentrate(v, params))
    x = np.array([tuple(r) for r in v.select(*quality.FEATURES).collect()])
    best = quality._fit(v).first()
    assert best.det <= min(r.det for r in params.collect()) + 1e-12
    assert best.det <= plain_mcd(x, np.random.default_rng(4))[0] + 0.02 and best.rows == len(x)


def test_chi_square_quantiles():
    # Printed tables: 5 degrees 11.070 and 20.515, 7 degrees 14.067.
    assert quality.quantile(0.05, 5) == pytest.approx(11.070, abs=1e-3)
    assert quality.quantile(0.001, 5) == pytest.approx(20.515, abs=1e-3)
    assert quality.quantile(0.05, 7) == pytest.approx(14.067, abs=1e-3)


def test_no_size_of_a_group_changes_verdicts_at_once(spark):
    """A group that grows by one row moves every distance a little."""
    rnd = random.Random(21)
    rows = [(i, prose(rnd, rnd.randint(60, 300)), "en", "a" if i < 300 else "b") for i in range(500)]
    one, two = ({r.doc_id: r.distance for r in quality.judge(docs(spark, t)).collect()} for t in (rows[:-1], rows))
    assert all(abs(two[i] - d) < 0.1 + 0.1 * d for i, d in one.items())


def test_quality_of_awkward_and_empty_tables(spark):
    rows = awkward()
    assert quality.judge(docs(spark, rows)).count() == len(rows)
    assert quality.judge(docs(spark, rows).limit(0)).count() == 0


def test_salted_join_gives_the_same_verdicts(spark, monkeypatch):
    rnd = random.Random(8)
    table = docs(spark, [(i, prose(rnd, rnd.randint(40, 90)) + " #" * (i % 9 == 0) * 30, "en", f"s{i % 2}") for i in range(450)])
    plain = sorted(map(tuple, quality.judge(table).collect()))
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, quality.judge(table).collect())) == plain
