"""Boosted trees on blocks of cells against MLlib's."""
import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from carelens.operators import boosting


@pytest.fixture(scope="module")
def rows(spark):
    cols = [f"c{i}" for i in range(5)]
    df = spark.range(4000).repartition(3).select(
        "id", F.rand(1).alias("c0"), F.round(F.rand(2) * 5).alias("c1"), F.randn(3).alias("c2"), F.lit(1.0).alias("c3"),
        F.round(F.rand(4) * 50).alias("c4"))
    df = df.withColumn("label", ((F.col("c0") > .7) | (F.col("c1") == 2) | (F.col("c2") * F.col("c4") > 30)).cast("double"))
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df).select("id", "features", "label").checkpoint()


SETTINGS = dict(maxIter=5, maxDepth=4, stepSize=.05, subsamplingRate=.8, seed=42)


@pytest.fixture(scope="module")
def plain(rows):
    model = GBTClassifier(**SETTINGS).fit(rows)
    return _p(model, rows), model.evaluateEachIteration(rows)


def _p(model, rows):
    from pyspark.ml.functions import vector_to_array
    return [r.p for r in model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).orderBy("id").collect()]


@pytest.mark.parametrize("alone, block, afresh", [(1 << 20, 1 << 21, 20), (0, 1000, 2)])
def test_trees_are_those_of_mllib(rows, plain, monkeypatch, alone, block, afresh):
    for k, v in {"ALONE": alone, "BLOCK": block, "AFRESH": afresh}.items():
        monkeypatch.setattr(boosting, k, v)
    model = boosting.BoostedTrees(**SETTINGS).fit(rows)
    assert np.allclose(_p(model, rows), plain[0], atol=1e-12)
    assert np.allclose(model.loss_by_round, plain[1], atol=1e-12) and len(model.trees) == 5


def test_subsample_is_that_of_spark(spark):
    jumps = boosting.jump_tables()
    for seed in (42, -7):
        r = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        want = [r.nextDouble() < .8 for _ in range(700)]
        assert boosting.draw(boosting.hash_seed(seed), 0, 700, .8, jumps).tolist() == want
        assert boosting.draw(boosting.hash_seed(seed), 133, 500, .8, jumps).tolist() == want[133:633]


def test_boosting_starts_no_job_for_each_level(spark, rows):
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("boosting", "boosting")
    try:
        boosting.BoostedTrees(**SETTINGS | {"maxIter": 8}).fit(rows)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("boosting")) < 12    # MLlib: more than 32


def test_equal_rows_are_counted_once():
    codes = np.array([[0, 1, 1, 0, 1], [2, 0, 0, 2, 1]], np.uint8)
    b = boosting.Block(0, 0, codes, np.array([1, 0, 0, 1, 0], np.uint8), [2, 3])
    assert sorted(b.rows.tolist()) == [1, 2, 2] and b.cell[1] == b.cell[2] != b.cell[4] and b.cell[0] == b.cell[3]
    counts = b.sampled(0, 1.0, 42, []).counts(True, [], [2, 3])
    assert counts[0, 0].tolist() == [2, 3, 2, 1, 2] and counts[1, 0].tolist() == [2, -3, -2, -1, 2]


def test_no_rows_and_one_label(spark, rows):
    one = boosting.BoostedTrees(**SETTINGS).fit(rows.withColumn("label", F.lit(0.0)))
    assert max(_p(one, rows)) < .2
    with pytest.raises(Exception):
        boosting.BoostedTrees(**SETTINGS).fit(rows.limit(0))
