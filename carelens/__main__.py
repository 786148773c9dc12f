"""Command line: the daily run, training and explanations.

  spark-submit -m carelens run     --raw-tables        # score stored raw_* tables
  spark-submit -m carelens train   --raw-tables        # fit and save both models
  spark-submit -m carelens explain                     # SHAP values of the stored scores
  python -m carelens run --sf-dir /root/testdata/sf0.01 --local --train

``run`` loads the saved models under ``--root`` unless ``--train`` fits them
first.  Raw tables made from ``--sf-dir`` are anonymised with ``--salt`` or
CARELENS_SALT; the public fixture salt is taken only with ``--local``.
"""

from __future__ import annotations

import argparse
import json
import os

from .constants import FIXTURE_SALT, GBT_TREES, REVIEW_TOP_N


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="carelens")
    p.add_argument("command", choices=["run", "train", "explain"])
    p.add_argument("--sf-dir", help="folder of test Parquet files to derive raw tables from")
    p.add_argument("--raw-tables", action="store_true", help="use the stored raw_* tables")
    p.add_argument("--root", help="shared folder for models and the run log")
    p.add_argument("--train", action="store_true")
    p.add_argument("--trees", type=int, default=GBT_TREES)
    p.add_argument("--top-n", type=int, default=REVIEW_TOP_N)
    p.add_argument("--buckets", type=int, help="buckets of the per-admission tables, about 128 MB each (default: none)")
    p.add_argument("--local", action="store_true", help="local session (tests, laptops)")
    p.add_argument("--salt", default=os.environ.get("CARELENS_SALT"), help="salt of the anonymised ids")
    a = p.parse_args(argv)
    if a.command != "explain" and bool(a.sf_dir) == a.raw_tables:
        p.error("give either --sf-dir or --raw-tables")
    if a.sf_dir and not (a.salt or a.local):
        p.error("--salt or CARELENS_SALT is required to anonymise raw tables")

    from pyspark.sql import SparkSession

    from .operators.trust import TrustFit
    from .plans import pipeline
    from .session import local_session
    from .sources import store
    from .sources.fixtures import fixture_raw
    spark = local_session() if a.local else SparkSession.builder.appName("carelens").getOrCreate()
    root = a.root or pipeline.default_root(spark)
    paths = pipeline.Paths(root)
    if a.command == "explain":
        print(json.dumps({"explained": pipeline.explain_scores(spark, root).count()}))
        return
    raw = None if a.raw_tables else fixture_raw(spark, a.sf_dir, a.salt or FIXTURE_SALT)  # None: the stored tables
    if a.command == "train":
        print(json.dumps({"metrics": pipeline.train_only(spark, raw, root, a.trees).metrics}))
        return
    models = None
    if not a.train:
        ae = store.load_anomaly_model(spark, paths.anomaly_model)
        fit = TrustFit(store.load_trust_model(paths.trust_model), {}, 0, 0)
        models = pipeline.Models(ae, {}, fit, paths.trust_model)
    out = pipeline.run_pipeline(spark, raw, root=root, models=models, top_n=a.top_n,
                                buckets=a.buckets, trees=a.trees)
    scored = out["trust_summary"].first()
    print(json.dumps({
        "admissions": out["mart_patient_summary"].count(),
        "scored": scored.n_rows, "flagged": scored.n_flagged,
        "failures": {r.failure_type: r.failures for r in out["failure_counts"].collect()},
        "reviewed": out["reviewed"] is not None and [r.asDict() for r in out["reviewed"].collect()]}, default=str))


if __name__ == "__main__":
    main()
