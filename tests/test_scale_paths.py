"""The skew-safe formulations equal their plain versions (brute force)."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from carelens.operators import anomaly, detectors
from settings import SF_SMALL


def _readings(spark, n=4000, seed=7, parts=13):
    rnd = random.Random(seed)
    vitals = anomaly.VITALS
    base = dt.datetime(2020, 1, 1)
    rows = []
    for i in range(n):
        # one hot admission holds a third of the rows, spread over days
        h = "hot" if i % 3 == 0 else f"h{rnd.randint(0, 60):02d}"
        t = base + dt.timedelta(minutes=rnd.choice([0, 30, 60, 61, 300, 600, 3000]) * rnd.randint(0, 40))
        v = rnd.choice(vitals)
        x = None if rnd.random() < 0.05 else round(rnd.uniform(0, 300), 1)
        rows.append((h, "s", t, v, x))
    return spark.createDataFrame(rows, "hadm_id string, subject_id string, charttime timestamp, "
                                       "vital_name string, valuenum double").repartition(parts)


def test_gaps_equal_plain_lag(spark):
    ch = _readings(spark)
    got = detectors.time_gaps(ch, minutes=100).collect()
    t = ch.select("hadm_id", "charttime").distinct()
    w = Window.partitionBy("hadm_id").orderBy("charttime")
    want = (t.withColumn("prev_charttime", F.lag("charttime").over(w))
            .where("prev_charttime is not null")
            .withColumn("gap_minutes", (F.unix_micros("charttime") - F.unix_micros("prev_charttime")) / 60e6)
            .where("gap_minutes > 100").select("hadm_id", "prev_charttime", "charttime", "gap_minutes"))
    assert sorted(got) == sorted(want.collect()) and len(got) > 0


def test_spikes_equal_plain_lag(spark):
    base = _readings(spark)
    ch = base.unionByName(base.where("hadm_id = 'hot'"))   # copies of the hot admission
    got = detectors.spikes(ch).collect()
    r = ch.where("valuenum is not null")
    w = Window.partitionBy("hadm_id", "vital_name").orderBy("charttime", "valuenum")
    lim = detectors._spike_limit()
    want = (r.select("hadm_id", "vital_name", F.lag("charttime").over(w).alias("prev_charttime"),
                     "charttime", F.lag("valuenum").over(w).alias("prev_value"), "valuenum")
            .where("prev_value is not null").withColumn("jump", F.col("valuenum") - F.col("prev_value"))
            .where(F.abs("jump") > lim))
    assert sorted(got) == sorted(want.collect()) and len(got) > 0


def test_sample_window_is_group_limited(spark):
    from carelens.operators import review
    ch = _readings(spark)
    ids = ch.select("hadm_id").distinct()
    s = review.vitals_sample(ch, ids, n=15)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert s.groupBy("hadm_id").count().agg(F.max("count")).first()[0] == 15


def test_look_back_needs_one_range_exchange_and_splits_a_hot_admission(spark):
    ch = _readings(spark, n=9000, parts=5)
    t = ch.select("hadm_id", "charttime").distinct()
    seen = []
    from carelens.operators import ranks
    plain = type(t).checkpoint

    def spy(self, *a, **k):
        seen.append(self._jdf.queryExecution().executedPlan().toString())
        return plain(self, *a, **k)
    type(t).checkpoint = spy
    try:
        got = ranks.with_previous(t, ["hadm_id"], ["charttime"], ["charttime"], F.lit(True))
    finally:
        type(t).checkpoint = plain
    assert seen[0].count("rangepartitioning") == 1 and seen[0].count("hashpartitioning") == 1
    w = Window.partitionBy("hadm_id").orderBy("charttime")
    want = t.withColumn("prev_charttime", F.lag("charttime").over(w)).where("prev_charttime is not null")
    assert sorted(got.collect()) == sorted(want.collect())


def test_look_back_of_empty_and_single_rows(spark):
    ch = _readings(spark, n=1)
    assert detectors.time_gaps(ch).count() == 0 and detectors.spikes(ch.limit(0)).count() == 0


def _plans(df):
    """The plan before and after it has run."""
    before = df._jdf.queryExecution().executedPlan().toString()
    df.collect()
    return before + df._jdf.queryExecution().executedPlan().toString()


def _unless_broadcast(spark, make):
    """``make()`` planned with the planner's own broadcasts off: what is small must say so."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        return make()
    finally:
        spark.conf.set(key, was)


def test_split_and_quantiles_send_no_value_to_one_task(spark):
    from carelens.operators import ranks
    df = spark.range(3000).select(F.col("id").cast("string").alias("hadm_id"), (F.col("id") % 7 == 0).cast("int").alias("label"),
                                  (F.col("id") % 50).cast("double").alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("_key"))
    split = _unless_broadcast(spark, lambda: ranks.first_share(df, "label", "_key", 5))
    plan = _unless_broadcast(spark, lambda: _plans(split))
    # Only the start of each range, one row for each, is joined by merging.
    assert all("_range" in x for x in plan.splitlines() if "SortMergeJoin [label" in x)
    keys = {g: sorted(r["_key"] for r in df.where(f"label = {g}").collect()) for g in (0, 1)}
    want = {k for g in keys.values() for k in g[:-(-len(g) // 5)]}
    assert {r["_key"] for r in split.where("is_first").collect()} == want
    counts = ranks.value_counts(df, ["x"])
    plan = _unless_broadcast(spark, lambda: _plans(ranks.quantiles(counts, 0.5)))
    assert all("_range" in x for x in plan.splitlines() if "SortMergeJoin [name" in x)
    assert ranks.quantiles(counts, 0.5).first()["quantile"] == 24.5


class _Stop(Exception):
    pass


def test_boosting_reads_no_more_partitions_than_the_rows_fill(spark, monkeypatch):
    from carelens.operators import trust
    seen = []

    class Pipeline:
        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())
            raise _Stop
    monkeypatch.setattr(trust, "trust_pipeline", lambda *a: Pipeline())
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        feats = spark.range(600).select(F.concat(F.lit("h"), "id").alias("hadm_id"), *[
            F.rand(i).alias(c) for i, c in enumerate(trust.TRUST_FEATURES)], (F.col("id") % 3 == 0).cast("int").alias("has_dq_problem"))
        label = feats.groupBy("hadm_id").agg(F.max("has_dq_problem").alias("has_dq_problem"))
        with pytest.raises(_Stop):
            trust.fit_trust(feats.drop("has_dq_problem").hint("merge").join(label, "hadm_id"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert 1 <= seen[0] < 16


def test_a_query_builds_only_the_tables_it_uses(spark, monkeypatch):
    from carelens.plans import catalog
    from carelens.sources import fixtures
    for module, name in ((catalog, "_MARTS"), (catalog, "_FITTED"), (fixtures, "_INGESTED")):
        monkeypatch.setattr(module, name, {})
    assert catalog.QUERIES["anomalous_rows"](spark, SF_SMALL).count() > 0
    # The pivot is stored: the fits and the scoring do not group the readings again.
    assert {k[0] for k in catalog._MARTS} == {"mart_icu_vitals", "scoring_pivot"}
    assert {k[-1] for k in fixtures._INGESTED} == {"raw_chartevents", "raw_admissions"}
    c = catalog.ScoreCtx(spark, SF_SMALL)
    assert "Exchange" not in c.scores._jdf.queryExecution().executedPlan().toString()
    a, b = (sorted(map(str, catalog.rounded_summary(x).collect())) for x in (c.summary_t, c.summary))
    assert a == b and a
