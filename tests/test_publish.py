"""Write, audit, publish: what readers see when a run fails."""

import pytest

from carelens.operators import checks
from carelens.plans import pipeline
from carelens.sources import store
from carelens.sources.fixtures import fixture_raw
from pyspark.sql import functions as F
from settings import SF_SMALL


def _rows(spark, n):
    return spark.range(n).withColumn("v", F.lit(n))


def _seen(spark, *names):
    return [spark.table(n).count() for n in names]


def test_tables_are_published_together_and_old_versions_go(spark):
    for n in (3, 5, 7):
        with store.Release(spark) as r:
            r.write(_rows(spark, n), "pub_a")
            own = r.write(_rows(spark, n + 1), "pub_b")
            if n > 3:
                assert _seen(spark, "pub_a", "pub_b") == [n - 2, n - 1]   # not visible yet
            assert own.count() == n + 1
            r.publish()
        assert _seen(spark, "pub_a", "pub_b") == [n, n + 1]
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("pub_a__")]
    version, previous = store.published(spark)["pub_a"]
    assert sorted(names) == sorted([f"pub_a__{version}", f"pub_a__{previous}"])


def test_a_crash_leaves_the_published_tables(spark):
    store.save_published(_rows(spark, 4), "pub_c")
    bad = spark.range(8, numPartitions=4).select(
        F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.save_published(bad, "pub_c")
    assert _seen(spark, "pub_c") == [4]
    with pytest.raises(RuntimeError):
        with store.Release(spark) as r:
            r.write(_rows(spark, 9), "pub_c")
            raise RuntimeError("between writing and publishing")
    assert _seen(spark, "pub_c") == [4]
    assert len([t for t in spark.catalog.listTables() if t.name.startswith("pub_c__")]) == 1


def test_repair_finishes_a_publication(spark, monkeypatch):
    store.save_published(_rows(spark, 4), "pub_d")
    monkeypatch.setattr(store, "repair", lambda spark: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.save_published(_rows(spark, 6), "pub_d")
    monkeypatch.undo()
    store.repair(spark)
    assert _seen(spark, "pub_d") == [6]


def test_a_plain_table_of_an_earlier_release_makes_way(spark):
    store.save_table(_rows(spark, 2), "pub_e")
    store.save_published(_rows(spark, 3), "pub_e")
    assert _seen(spark, "pub_e") == [3]


def test_a_failed_gate_keeps_the_marts(spark):
    raw = fixture_raw(spark, SF_SMALL)
    pipeline.build_marts(spark, raw)
    before = store.published(spark)
    good = _seen(spark, "mart_icu_vitals", "mart_patient_summary")
    raw.chartevents = raw.chartevents.limit(50)
    rules = [*checks.RULES, ("mart_icu_vitals", "hadm_id", "accepted_values", ["none"])]
    with pytest.raises(checks.CheckFailed):
        pipeline.build_marts(spark, raw, rules=rules)
    assert store.published(spark) == before
    assert _seen(spark, "mart_icu_vitals", "mart_patient_summary") == good
    versions = [t.name for t in spark.catalog.listTables() if t.name.startswith("mart_icu_vitals__")]
    assert f"mart_icu_vitals__{before['mart_icu_vitals'][0]}" in versions and len(versions) <= 2
