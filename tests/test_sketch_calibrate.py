"""Stored daily sketches, calibrated probabilities and metrics by step."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelens.operators import calibrate, sketches, trust
from carelens.plans.catalog import ScoreCtx
from carelens.sources import store
from settings import SF_SMALL


def _rows(spark, days, per_day=3000, seed=1):
    rnd = random.Random(seed)
    data = [(dt.datetime(2024, 1, 1 + d, rnd.randint(0, 23)), float(rnd.gauss(d, 3)), None if rnd.random() < .5 else float(rnd.randint(0, 9)))
            for d in range(days) for _ in range(per_day)]
    return spark.createDataFrame(data + [(None, 1.0, 2.0)], "charttime timestamp, a double, b double")


def test_merged_daily_sketches_stay_within_the_rank_error(spark, tmp_path):
    rows, path = _rows(spark, 9), str(tmp_path / "s")
    sketches.store_daily(sketches.daily_sketches(rows, ["a", "b"], k=200), path)
    got = {r["name"]: r for r in sketches.sketched_quantiles(sketches.stored_daily(spark, path), {"q50": .5, "q95": .95}).collect()}
    for c in "ab":
        x = np.sort([r[0] for r in rows.select(c).collect() if r[0] is not None])
        assert got[c]["n"] == len(x)
        for name, q in (("q50", .5), ("q95", .95)):
            lo, hi = np.searchsorted(x, got[c][name], "left") / len(x), np.searchsorted(x, got[c][name], "right") / len(x)
            assert lo - 2 * sketches.rank_error(200) <= q <= hi + 2 * sketches.rank_error(200)


def test_a_day_is_replaced_and_spans_are_pruned(spark, tmp_path):
    path = str(tmp_path / "s")
    day = lambda n, v: spark.createDataFrame([(dt.datetime(2024, 3, n), v)], "charttime timestamp, a double")
    for n, v in ((1, 1.0), (2, 5.0), (2, 7.0)):
        sketches.store_daily(sketches.daily_sketches(day(n, v), ["a"]), path)
    every = sketches.sketched_quantiles(sketches.stored_daily(spark, path), {"top": 1.0}).first()
    assert every["n"] == 2 and every["top"] == 7.0
    one = sketches.stored_daily(spark, path, "2024-03-01", "2024-03-01")
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()
    assert sketches.sketched_quantiles(one, {"top": 1.0}).first()["top"] == 1.0


def test_medians_and_threshold_from_sketches(spark):
    ctx = ScoreCtx(spark, SF_SMALL)
    err = ctx.mean_model.error_columns(ctx.train, sketches.VITALS)
    daily = sketches.daily_sketches(ctx.pivot, sketches.VITALS, k=4000).unionByName(
        sketches.daily_sketches(err.select("charttime", "reconstruction_error"), ["reconstruction_error"], k=4000))
    got = sketches.sketched_medians(daily)
    for v, exact in ctx.medians.items():
        x = np.sort([r[0] for r in ctx.pivot.where(F.col(v).isNotNull()).select(v).collect()])
        lo, hi = np.searchsorted(x, got[v], "left") / len(x), np.searchsorted(x, got[v], "right") / len(x)
        assert lo - .005 <= .5 <= hi + .005 and min(x) <= exact <= max(x)
    assert abs(sketches.sketched_threshold(daily) / ctx.mean_model.threshold - 1) < .05
    assert sketches.sketched_medians(daily.limit(0)) == {v: None for v in sketches.VITALS}


def _iso(counts):
    """Plain max-min formula."""
    share = lambda a, b: sum(p for _, p in counts[a:b + 1]) / sum(n for n, _ in counts[a:b + 1])
    k = len(counts)
    return [max(min(share(a, b) for b in range(i, k)) for a in range(i + 1)) for i in range(k)]


def test_pooling_equals_the_max_min_formula():
    rnd = random.Random(3)
    for _ in range(60):
        counts = [(n, rnd.randint(0, n)) for n in (rnd.randint(1, 9) for _ in range(rnd.randint(1, 14)))]
        assert np.allclose(calibrate.pool(counts), _iso(counts))


def test_calibration_mends_a_bent_score(spark):
    p = F.rand(5)
    rows = spark.range(40_000).select(p.alias("p"), F.rand(6).alias("u")).select(
        F.pow("p", F.lit(3)).alias("score"), (F.col("u") < F.col("p")).cast("int").alias("label"))
    fit = calibrate.Calibration.fit(rows)
    assert fit.shares == sorted(fit.shares) and len(fit.shares) == calibrate.BINS
    better = rows.withColumn("score", fit.column(F.col("score")))
    assert calibrate.calibration_error(rows) > .15 and calibrate.calibration_error(better) < .01
    none = calibrate.Calibration.fit(rows.limit(0))
    assert none.shares == [] and rows.select(none.column(F.col("score")) == F.col("score")).distinct().count() == 1
    assert calibrate.calibration_error(rows.limit(0)) == 0.0


@pytest.fixture(scope="module")
def fit(spark):
    ctx = ScoreCtx(spark, SF_SMALL)
    feats = trust.trust_features(ctx.summary_t, ctx.scores)
    return feats, trust.fit_trust(feats, trees=6)


def test_scores_are_calibrated_and_saved_with_the_model(spark, fit, tmp_path):
    feats, f = fit
    assert set(f.calibration_errors) == {"calibration_error", "calibration_error_raw"} and f.calibration.shares == sorted(f.calibration.shares)
    path = str(tmp_path / "trust")
    store.save_trust_model(f.model, path, f.calibration)
    back = store.load_calibration(spark, path)
    assert back == f.calibration and store.load_calibration(spark, path + "-none").shares == []
    a = {r.hadm_id: r.trust_score for r in trust.score_trust(feats, f.model).collect()}
    b = {r.hadm_id: r for r in trust.score_trust(feats, store.load_trust_model(path), back).collect()}
    n = len(back.shares)
    for i, raw in a.items():
        want = 100 * (1 - back.shares[min(int((1 - raw / 100) * n + 1e-9), n - 1)])
        near = 100 * (1 - back.shares[min(int((1 - raw / 100) * n - 1e-9), n - 1)])
        assert min(abs(b[i].trust_score - want), abs(b[i].trust_score - near)) < 1e-9
        assert b[i].dq_flagged == (b[i].trust_score < 60)


def test_loss_is_logged_by_round(spark, fit, tmp_path):
    _, f = fit
    assert len(f.loss_by_round) == 6 and f.loss_by_round[-1] < f.loss_by_round[0]
    path = str(tmp_path / "runs")
    with store.logged_run(spark, path, "r", {"n": 1}) as log:
        log.update(roc_auc=.5, train_loss=f.loss_by_round)
    steps = {r.step: r.value for r in spark.read.parquet(path).where("name = 'train_loss'").collect()}
    assert steps == dict(enumerate(f.loss_by_round, 1))
    assert store.recent_runs(spark, path).first()["train_loss"] == f.loss_by_round[-1]
    assert os.path.isdir(path)
