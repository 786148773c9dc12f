import zlib

import numpy as np
from helpers import awkward, docs

from carelens.llm import quadratic

SF = "/root/testdata/sf0.01"


def _log_density(x, rows):
    """Plain Gaussian log-density under the shrunk covariance, without shared factors."""
    mean, n, d = rows.mean(0), len(rows), rows.shape[1]
    cov = np.cov(rows.T, bias=True)
    t, q = np.trace(cov), (cov ** 2).sum()
    rho = min(1, ((1 - 2 / d) * q + t * t) / ((n + 1 - 2 / d) * (q - t * t / d)))
    cov = (1 - rho) * cov + (rho * t / d + quadratic.FLOOR) * np.eye(d)
    return -0.5 * np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean) - 0.5 * np.linalg.slogdet(cov)[1]


def test_scores_equal_brute_force_and_held_out_labels_are_found(spark):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    text = {r.doc_id: r.text for r in table.collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in text}
    x = {i: np.array(quadratic.statistics(t)) for i, t in text.items()}
    learned = [i for i in label if i in x and not held[i]]
    base = np.array([x[i] for i in learned])
    z = {i: (v - base.mean(0)) / (base.std(0) + 1e-9) for i, v in x.items()}
    order = sorted(z)
    every = np.array([z[i] for i in order])
    part = [np.log(sum(label[i] == k for i in learned)) + _log_density(every, np.array([z[i] for i in learned if label[i] == k]))
            for k in (0, 1)]
    want = dict(zip(order, 1 / (1 + np.exp(-np.clip(part[1] - part[0], -700, 700)))))
    got = {r.doc_id: r for r in quadratic.classify(table, labels).collect()}
    assert set(got) == set(text)
    for i, r in got.items():
        assert r.held_out == held[i] and abs(r.score - want[i]) < 1e-6 and r.predicted == int(r.score >= .3)
    test = [i for i in label if held[i]]
    assert len(test) > 50 and np.mean([got[i].predicted == label[i] for i in test]) >= .97


def test_awkward_rows_and_missing_classes(spark):
    rows = awkward() + [(40 + i, "fine words of a text. " * (i + 3)) for i in range(6)] + [(60 + i, "&&& ### " * (i + 3)) for i in range(6)]
    schema = "doc_id bigint, quality int, f_words int, score string"
    labels = spark.createDataFrame([(40 + i, 1, 0, "") for i in range(6)] + [(60 + i, 0, 0, "") for i in range(6)]
                                   + [(4, 1, 0, ""), (4, 0, 0, ""), (5, None, 0, ""), (None, 1, 0, ""), (40, 1, 0, "")], schema)
    table = docs(spark, rows)
    got = quadratic.classify(table, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.doc_id < 60) for r in got if (r.doc_id or 0) >= 40)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.score for r in quadratic.classify(table, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quadratic.classify(table, labels.limit(0)).collect()} == {0.5}
    assert quadratic.classify(table.limit(0), labels).count() == 0
