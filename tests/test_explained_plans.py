"""The plans of the explanations at size."""
import numpy as np
from pyspark.sql import functions as F

from carelens.operators import explain, trust


def _explained(spark, model_path, model):
    feats = spark.range(50).select(F.concat(F.lit("h"), "id").alias("hadm_id"), *[
        F.rand(i).alias(c) for i, c in enumerate(trust.TRUST_FEATURES)], (F.col("id") % 3 == 0).cast("int").alias("has_dq_problem"))
    return explain.explain_trust(feats, model, model_path)


def test_explanations_are_planned_once_and_compiled_in_small_methods(spark, tmp_path):
    feats = spark.range(600).select(F.concat(F.lit("h"), "id").alias("hadm_id"), *[
        F.rand(i).alias(c) for i, c in enumerate(trust.TRUST_FEATURES)], (F.rand(11) < F.rand(0)).cast("int").alias("has_dq_problem"))
    fit = trust.fit_trust(feats, trees=3)
    assert fit.held_out.count() == sum(r["count"] // 5 + (r["count"] % 5 > 0) for r in feats.groupBy("has_dq_problem").count().collect())
    path = str(tmp_path / "m")
    fit.model.write().overwrite().save(path)
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    shap = _explained(spark, path, fit.model)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    got = explain.global_importance(shap)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.split("Range")[0].replace("Filter isnotnull(importance", "")
    rows = [r.shap_values for r in shap.collect()]
    want = {f: sum(abs(r[f]) for r in rows) / len(rows) for f in trust.TRUST_FEATURES}
    found = got.collect()
    assert all(abs(r.importance - want[r.feature]) < 1e-12 for r in found) and len(found) == len(want)
    assert [r.importance for r in found] == sorted(want.values(), reverse=True) or np.allclose([r.importance for r in found], sorted(want.values(), reverse=True))
    assert explain.global_importance(shap.limit(0)).count() == 0
