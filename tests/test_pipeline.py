import tempfile

from pyspark.sql import functions as F

from carelens.plans import pipeline
from carelens.sources import store
from carelens.sources.fixtures import fixture_raw
from settings import SF_SMALL


def test_daily_run_end_to_end(spark):
    root = tempfile.mkdtemp(prefix="run-")
    raw = fixture_raw(spark, SF_SMALL)
    paths = pipeline.Paths(root)
    store.load_raw_tables(spark, raw.as_dict())
    t = pipeline.build_marts(spark, store.read_raw(spark), buckets=8)
    models = pipeline.train(spark, t["mart_icu_vitals"], t["mart_patient_summary"], paths,
                            trees=5)
    out = pipeline.run_pipeline(spark, None, root=root, models=models, top_n=3, buckets=8)  # the stored raw tables
    assert out["check_results"].count() == 21
    n_adm = out["mart_patient_summary"].count()
    assert spark.table("ml_trust_scores").count() == n_adm
    assert spark.table("ml_anomaly_scores").count() == out["mart_icu_vitals"].count()
    assert out["reviewed"].count() <= 3
    runs = store.recent_runs(spark, paths.runs)
    assert runs.count() == 2 and {r.status for r in runs.collect()} == {"FINISHED"}
    names = {r.name for r in spark.read.parquet(paths.runs).select("name").distinct().collect()}
    assert {"roc_auc", "train_loss", "param.max_depth", "shap_raw_dq_score"} <= names
    assert out["trust_summary"].first().n_rows == n_adm
    assert out["mart_patient_summary"].where(F.col("raw_dq_score").isNull()).count() == 0
    assert {r.failure_type for r in out["failure_counts"].collect()} >= {"anomaly", "duplicate", "spike", "missing_vital"}
    assert pipeline.explain_scores(spark, root).count() == n_adm
    # bucketed alike on hadm_id: the dashboard join needs no shuffle
    from carelens.operators import dashboard
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        board = dashboard.dashboard_summary(spark.table("mart_patient_summary"), spark.table("ml_trust_scores"))
        plan = board._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
