import datetime as dt
import hashlib

from pyspark.sql import functions as F

from carelens.functions import anon_id, clip01, dq_score, hour_diff, missing_count


def test_hour_diff_counts_boundaries(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 10, 59), dt.datetime(2020, 1, 1, 11, 1)),
                                (dt.datetime(2020, 1, 1, 10, 0), dt.datetime(2020, 1, 1, 10, 59)),
                                (dt.datetime(2020, 1, 1, 10, 5), dt.datetime(2020, 1, 1, 10, 5))],
                               "a timestamp, b timestamp")
    assert [r[0] for r in df.select(hour_diff("a", "b")).collect()] == [1, 0, 0]


def test_anon_id_matches_sha256_prefix(spark):
    ids = [1, 2, 99, 12345]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = [r[0] for r in df.select(anon_id("id", "s")).collect()]
    want = [hashlib.sha256(f"s{i}".encode()).hexdigest()[:16] for i in ids]
    assert got == want
    assert all(len(g) == 16 and g != str(i) for g, i in zip(got, ids))


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.5,), (3.0,)], "x double")
    assert [r[0] for r in df.select(clip01("x")).collect()] == [None, 0.0, 0.5, 1.0]


def test_missing_count(spark):
    df = spark.createDataFrame([(None, 1.0, None)], "a double, b double, c double")
    assert df.select(missing_count(["a", "b", "c"])).first()[0] == 2


def test_dq_score_edges(spark):
    # no diagnoses: a null share counts as 1 -> 80.0 with clean vitals
    # everything wrong: one row, one vital out of range, five missing, all codes invalid -> 35.0
    df = spark.createDataFrame([(0, 10, 0, None, None), (5, 1, 1, 3, 3), (0, 10, 0, 0, 4)],
                               "m long, rows long, oor long, inv long, dx long")
    got = [r[0] for r in df.select(dq_score(F.col("m"), F.col("rows"), F.col("oor"),
                                            F.col("inv"), F.col("dx"))).collect()]
    assert got == [80.0, 35.0, 100.0]


def test_fmt_num_rounds_like_python(spark):
    from carelens.functions import fmt_num
    vals = [0.25, 0.35, 12.45, 59.85, 59.95, 1234.5, 2.5, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(fmt_num("x", 1)).collect()]
    assert got == [("nan" if v is None else f"{v:.1f}") for v in vals]
    got0 = [r[0] for r in df.select(fmt_num("x", 0)).collect()]
    assert got0 == [("nan" if v is None else f"{v:.0f}") for v in vals]
