import itertools
import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelens.operators import anomaly, checks, explain, reconstruct, review, trust
from carelens.plans.catalog import ScoreCtx
from carelens.sources import store
from settings import SF_SMALL


@pytest.fixture(scope="module")
def ctx(spark):
    return ScoreCtx(spark, SF_SMALL)


def test_scaled_matrix_in_unit_range(ctx):
    tm = ctx.train
    assert tm.count() == ctx.pivot.where(" OR ".join(
        f"{v} BETWEEN {lo} AND {hi * 1.5}" for v, (lo, hi) in anomaly.VITAL_RANGES.items())).count()
    agg = tm.agg(*[F.min(v).alias(f"lo_{v}") for v in anomaly.VITALS],
                 *[F.max(v).alias(f"hi_{v}") for v in anomaly.VITALS]).first()
    assert all(0.0 <= agg[f"lo_{v}"] and agg[f"hi_{v}"] <= 1.0 for v in anomaly.VITALS)


def test_reconstruction_is_deterministic_and_reloads(spark, ctx):
    m1 = reconstruct.PcaModel.fit(ctx.train)
    m2 = reconstruct.PcaModel.fit(ctx.train.repartition(5))
    assert math.isfinite(m1.threshold) and abs(m1.threshold - m2.threshold) < 1e-7
    rows = spark.createDataFrame([(0, *m1.means), (1, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)], ["i", *anomaly.VITALS])
    e = {r.i: r.reconstruction_error for r in m1.error_columns(rows, anomaly.VITALS).collect()}
    assert abs(e[0]) < 1e-9 < e[1]
    path = os.path.join(tempfile.mkdtemp(prefix="ae-"), "m")
    store.save_anomaly_model(spark, m1, path)
    m3 = store.load_anomaly_model(spark, path)
    s1 = anomaly.score_anomalies(ctx.vitals_t, m1).orderBy("hadm_id", "charttime").collect()
    s3 = anomaly.score_anomalies(ctx.vitals_t, m3).orderBy("hadm_id", "charttime").collect()
    assert s1 == s3
    assert all(r.reconstruction_error >= 0 for r in s1)


@pytest.fixture(scope="module")
def fitted(spark, ctx):
    feats = trust.trust_features(ctx.summary, ctx.scores).cache()
    fit = trust.fit_trust(feats, trees=8)
    path = os.path.join(tempfile.mkdtemp(prefix="trust-"), "model")
    store.save_trust_model(fit.model, path)
    return feats, fit, path


def test_trust_scores_range_and_flag(fitted):
    feats, fit, _ = fitted
    rows = trust.score_trust(feats, fit.model).collect()
    assert len(rows) == feats.count()
    assert all(0.0 <= r.trust_score <= 100.0 and r.dq_flagged == (r.trust_score < 60) for r in rows)
    assert set(fit.metrics) == {"roc_auc", "f1", "precision", "recall"}
    assert fit.metrics["roc_auc"] > 0.8   # the label is a rule over the features


def test_reloaded_model_scores_the_same(fitted):
    feats, fit, path = fitted
    a = trust.score_trust(feats, fit.model).orderBy("hadm_id").collect()
    b = trust.score_trust(feats, store.load_trust_model(path)).orderBy("hadm_id").collect()
    assert a == b


def test_shap_sums_to_margin_minus_base(fitted):
    feats, fit, path = fitted
    rows = explain.explain_trust(feats, fit.model, path, digits=None).limit(200).collect()
    for r in rows:
        assert set(r.shap_values) == set(trust.TRUST_FEATURES)
        assert abs(sum(r.shap_values.values()) + r.base_value - r.margin) < 1e-6


def _shapley(tree, w, x):
    """Shapley values of one tree by definition: every subset of its features, the
    others integrated out along the covers."""
    used = sorted({n["featureIndex"] for n in tree.values() if n["leftChild"] >= 0})

    def expected(nid, known):
        n = tree[nid]
        if n["leftChild"] < 0:
            return w * n["prediction"]
        a, b = tree[n["leftChild"]], tree[n["rightChild"]]
        if n["featureIndex"] in known:
            return expected((a if x[n["featureIndex"]] <= n["threshold"] else b)["id"], known)
        return sum(c["rawCount"] * expected(c["id"], known) for c in (a, b)) / n["rawCount"]

    value = {s: expected(0, s) for r in range(len(used) + 1) for s in itertools.combinations(used, r)}
    out = np.zeros(len(x))
    for f in used:
        for s, v in value.items():
            if f not in s:
                share = math.factorial(len(s)) * math.factorial(len(used) - len(s) - 1) / math.factorial(len(used))
                out[f] += share * (value[tuple(sorted((*s, f)))] - v)
    return out


@pytest.mark.parametrize("cells", [4096, 16])
def test_shap_equals_shapley_values_by_definition(fitted, monkeypatch, cells):
    feats, fit, path = fitted
    spark = feats.sparkSession
    monkeypatch.setattr(explain, "CELLS", cells)
    monkeypatch.setattr(explain, "_COMPILED", {})
    shap = explain.explain_trust(feats, fit.model, path, digits=None)
    plan = shap._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
    weights, nodes = explain.tree_table(spark, path, fit.model)
    trees = {}
    for n in nodes:
        trees.setdefault(n["treeID"], {})[n["id"]] = n
    x = {r.hadm_id: r.features.toArray() for r in fit.model.transform(trust._filled(feats)).select("hadm_id", "features").collect()}
    got = {r.hadm_id: r for r in shap.collect()}
    assert set(got) == set(x) and len(fit.model.stages[-1].trees) == len(trees)
    for i in sorted(got)[::max(1, len(got) // 25)]:
        want = 2 * sum(_shapley(tree, weights[t], x[i]) for t, tree in trees.items())
        assert np.allclose([got[i].shap_values[f] for f in trust.TRUST_FEATURES], want, atol=1e-9)


def test_shap_of_values_on_thresholds_nan_and_a_tree_of_one_leaf(spark):
    node = lambda i, p, n, kids=(-1, -1), f=-1, t=None, tree=0: {
        "treeID": tree, "id": i, "prediction": p, "rawCount": n, "leftChild": kids[0], "rightChild": kids[1], "featureIndex": f, "threshold": t}
    nodes = [node(0, 0., 10, (1, 4), 0, .5), node(1, 0., 6, (2, 3), 1, .25), node(2, 1., 2), node(3, -2., 4), node(4, 3., 4),
             node(0, 7., 10, tree=1)]
    weights = {0: 1.0, 1: 0.1}
    model = explain.compile_model(explain.leaf_tables(explain.compile_leaves(weights, nodes)))
    xs = [[.5, .25, 0.], [.5, .250001, 1.], [.51, 0., 0.], [float("nan"), .1, 0.], [0., float("nan"), 0.], [-1., -1., 9.]]
    rows = spark.createDataFrame(list(enumerate(xs)), "i int, x array<double>")
    tree = {n["id"]: n for n in nodes if n["treeID"] == 0}
    for r in explain.with_shap(rows, model, "x", 3).collect():
        assert np.allclose([r._phi_0, r._phi_1, r._phi_2], 2 * _shapley(tree, 1.0, xs[r.i]))
    assert abs(model["base"] - ((2 * 1 + 4 * -2 + 4 * 3) / 10 + .7)) < 1e-12
    alone = explain.compile_model(explain.leaf_tables(explain.compile_leaves({1: 0.1}, nodes[-1:])))
    assert {tuple(r) for r in explain.with_shap(rows.select("x"), alone, "x", 2).select("_phi_0", "_phi_1").collect()} == {(0.0, 0.0)}


def test_shap_follows_a_refit_at_the_same_path(fitted, tmp_path):
    feats, _, _ = fitted
    path = str(tmp_path / "trust")
    for trees in (2, 4):
        model = trust.fit_trust(feats, trees=trees).model
        store.save_trust_model(model, path)
        for r in explain.explain_trust(feats, store.load_trust_model(path), path, digits=None).limit(20).collect():
            assert abs(sum(r.shap_values.values()) + r.base_value - r.margin) < 1e-6


def test_score_rows_missing_feature_is_zero(spark, fitted):
    _, fit, _ = fitted
    one = spark.createDataFrame([("x", 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5)],
                                "hadm_id string, total_missing_vitals double, total_chart_rows double, "
                                "hr_oor_count double, spo2_oor_count double, rr_oor_count double, "
                                "invalid_icd_count double, raw_dq_score double, avg_recon_error double")
    r = trust.score_rows(one, fit.model).first()       # los_hours absent -> 0
    assert 0 <= r.trust_score <= 100 and round(r.trust_score, 1) == r.trust_score


def test_reviewer_error_is_isolated(ctx):
    table = review.review_table(ctx.summary, ctx.trust, ctx.charts, top_n=3)
    ids = [r.hadm_id for r in table.collect()]

    def fn(row):
        if row["hadm_id"] == ids[0]:
            raise ValueError("boom")
        return "fine"
    out = {r.hadm_id: r.output for r in review.apply_reviewer(table, fn).collect()}
    assert out[ids[0]] == "Error: boom" and all(out[i] == "fine" for i in ids[1:])


def test_empty_worklist_keeps_schema(ctx):
    none = ctx.trust.withColumn("dq_flagged", F.lit(False))
    t = review.review_table(ctx.summary, none, ctx.charts)
    assert t.count() == 0 and "record_context" in t.columns


def test_gate_raises(spark):
    ok = spark.createDataFrame([("t", "c", "not_null", 0)], checks.RESULT_SCHEMA)
    assert checks.gate(ok) is ok
    bad = spark.createDataFrame([("t", "c", "unique", 2)], checks.RESULT_SCHEMA)
    with pytest.raises(checks.CheckFailed):
        checks.gate(bad)


def test_checks_count_like_dbt(spark):
    df = spark.createDataFrame([("a", "M"), ("a", "x"), (None, "y"), ("b", "y")], "subject_id string, gender string")
    rules = [("p", "subject_id", "not_null"), ("p", "subject_id", "unique"),
             ("p", "gender", "accepted_values", ["M", "F"])]
    got = {(r.column_name, r.test): r.failures for r in checks.run_checks({"p": df}, rules).collect()}
    assert got == {("subject_id", "not_null"): 1, ("subject_id", "unique"): 1, ("gender", "accepted_values"): 2}


def test_scatter_sample_equals_plain_top_n(spark):
    from carelens.operators import dashboard
    df = spark.range(20000).select(F.col("id").cast("string").alias("hadm_id"),
                                   (F.col("id") % 100).cast("double").alias("raw_dq_score"),
                                   (F.col("id") % 97).cast("double").alias("trust_score"),
                                   (F.col("id") % 2 == 0).alias("dq_flagged")).repartition(7)
    got = dashboard.scatter_sample(df, n=100).collect()
    key = F.sha2(F.concat("hadm_id", F.lit(":42")), 256)
    want = df.select("*", key.alias("_r")).orderBy("_r", "hadm_id").limit(100).drop("_r").collect()
    assert len(got) == 100 and sorted(got) == sorted(want)


def test_median_sketch_close_to_exact(ctx):
    exact = anomaly.column_medians(ctx.pivot)
    approx = anomaly.column_medians(ctx.pivot, relative_error=0.001)
    for v in anomaly.VITALS:
        lo, hi = anomaly.VITAL_RANGES[v]
        assert abs(exact[v] - approx[v]) <= 0.02 * (hi - lo)


def test_split_takes_an_exact_share_of_each_label(spark):
    df = spark.range(5003).select(F.col("id").cast("string").alias("hadm_id"),
                                  (F.col("id") % 1000 == 7).cast("int").alias("has_dq_problem"))
    split = trust.stratified_split(df.repartition(7))
    got = {(r.has_dq_problem, r.is_test): r["count"] for r in split.groupBy("has_dq_problem", "is_test").count().collect()}
    assert got == {(0, True): 1000, (0, False): 3998, (1, True): 1, (1, False): 4}
    assert sorted(split.collect()) == sorted(trust.stratified_split(df).collect())
    assert trust.stratified_split(df.limit(0)).count() == 0


def test_scaler_bounds_are_what_the_scaler_learns(fitted):
    feats, fit, _ = fitted
    scaler = fit.model.stages[1]
    got = {r.feature: (r.lo, r.hi) for r in trust.scaler_bounds(trust.stratified_split(feats).where("NOT is_test")).collect()}
    assert [got[f] for f in trust.TRUST_FEATURES] == list(zip(scaler.originalMin.toArray(), scaler.originalMax.toArray()))


def test_metrics_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(y), float(s), int(s > 6)) for y, s in zip(rng.integers(0, 2, 300), rng.integers(0, 12, 300))]
    df = spark.createDataFrame(rows, "label int, score double, predicted int")
    got = {r.metric: r.value for r in trust.classification_metrics(df.repartition(5)).collect()}
    pos, neg = [s for y, s, _ in rows if y], [s for y, s, _ in rows if not y]
    assert abs(got["roc_auc"] - np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])) < 1e-12
    tp, hits = sum(y and p for y, _, p in rows), sum(p for _, _, p in rows)
    assert got["precision"] == tp / hits and got["recall"] == tp / len(pos) and got["n"] == 300
    one = {r.metric: r.value for r in trust.classification_metrics(df.where("label = 0")).collect()}
    assert one["roc_auc"] is None and one["recall"] == 0 and one["positives"] == 0


def test_quantiles_equal_percentile(spark):
    from carelens.operators import ranks
    df = spark.range(4000).select((F.col("id") % 3).cast("double").alias("few"), F.rand(1).alias("many"),
                                  F.when(F.col("id") == 5, 2.5).alias("one"), F.lit(None).cast("double").alias("none"))
    counts = ranks.value_counts(df.repartition(6), df.columns)
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r.name: r.quantile for r in ranks.quantiles(counts, share).collect()}
        want = df.agg(*[F.percentile(c, share).alias(c) for c in df.columns]).first().asDict()
        assert want.pop("none") is None and set(got) == set(want)
        assert all(abs(got[c] - want[c]) < 1e-12 for c in want)


def test_missing_parts_are_named(spark, ctx):
    ids = spark.createDataFrame([("nobody",)], "hadm_id string")
    lost = ids.select("hadm_id", F.lit(1.0).alias("trust_score"), F.lit(True).alias("dq_flagged"))
    assert review.trust_verdict(ctx.trust, ids).first().trust_verdict == "No trust score found for nobody"
    row = review.review_table(ctx.summary, lost, ctx.charts).first()
    assert row.record_context == "No record found for hadm_id=nobody"
    assert row.vitals_sample == "No vitals found for hadm_id=nobody"


def test_a_failed_review_does_not_stop_the_run(spark, ctx):
    import threading

    from carelens.plans import pipeline
    table = review.review_table(ctx.summary, ctx.trust, ctx.charts, top_n=2)
    lock = threading.Lock()          # cannot be sent to executors
    with pytest.warns(RuntimeWarning, match="review failed"):
        assert pipeline.review_step(spark, table, lambda row: str(lock)) is None


def test_a_failed_run_is_logged(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert store.recent_runs(spark, path).count() == 0
    with pytest.raises(ValueError), store.logged_run(spark, path, "r1", {"trees": 3}) as log:
        log["roc_auc"] = 0.5
        raise ValueError
    r = store.recent_runs(spark, path).first()
    assert (r.run, r.status, r.roc_auc, r.train_loss) == ("r1", "FAILED", 0.5, None)
