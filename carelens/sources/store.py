"""Sinks and stores: tables (A1, A4-A7), models (A9, A10), run log.

Tables are Parquet tables in the session catalog, one for each version; readers
see a version through a view of the plain name, once it has been published
(``Release``).  Nothing that readers see is overwritten.  Paths for models and
the run log are folders a cluster shares (e.g. an object store).
"""

from __future__ import annotations

import datetime as _dt
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import RAW_SCHEMAS, conform


def save_table(df: DataFrame, name: str, partition_by=None, bucket_by: str | None = None,
               buckets: int | None = None) -> None:
    """Overwrite a Parquet table.  With ``bucket_by``/``buckets``, tables
    bucketed alike on the same key join without a shuffle."""
    if bucket_by and buckets:
        # one task per bucket (same hash as bucketing): one file per bucket
        df = df.repartition(buckets, bucket_by)
    w = df.write.mode("overwrite").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by and buckets:
        w = w.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    w.saveAsTable(name)


# --- write, audit, publish -----------------------------------------------------

# The view that says which version of each table is published.
CATALOGUE = "carelens_published"


def published(spark: SparkSession) -> dict[str, tuple[str, str | None]]:
    """name -> (published version, the one before); one row a table."""
    if not table_exists(spark, CATALOGUE):
        return {}
    return {r["name"]: (r["version"], r["previous"]) for r in spark.table(CATALOGUE).collect()}


class Release:
    """Tables written together and published together.

    ``write`` puts each under its own version, where no reader looks; ``publish``
    makes all of them current by one catalogue change (the view ``CATALOGUE``),
    then points the plain names, which are views, at them.  What fails or dies
    before that change leaves the published tables as they were; what dies after it
    is finished by ``repair``.  The version before stays for readers that are under
    way and is dropped by the next publication.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.version = uuid.uuid4().hex[:12]
        self.names: list[str] = []

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if kind is not None:
            self.discard()

    def write(self, df: DataFrame, name: str, **how) -> DataFrame:
        """Write ``df`` as this release's version of ``name`` and read it back."""
        self.names.append(name)
        save_table(df, versioned(name, self.version), **how)
        return self.spark.table(versioned(name, self.version))

    def publish(self) -> None:
        old = published(self.spark)
        now = old | {n: (self.version, old.get(n, (None,))[0]) for n in self.names}
        rows = ", ".join(f"({_text(n)}, {_text(v)}, CAST({_text(p)} AS STRING))" for n, (v, p) in sorted(now.items()))
        if rows:
            self.spark.sql(f"CREATE OR REPLACE VIEW {CATALOGUE} AS SELECT * FROM VALUES {rows} AS t(name, version, previous)")
        repair(self.spark)
        for n in self.names:
            before = old.get(n, (None, None))[1]
            if before:
                self.spark.sql(f"DROP TABLE IF EXISTS {versioned(n, before)}")

    def discard(self) -> None:
        """Drop what this release wrote, unless it was published."""
        now = published(self.spark)
        for n in self.names:
            if now.get(n, (None,))[0] != self.version:
                self.spark.sql(f"DROP TABLE IF EXISTS {versioned(n, self.version)}")


def versioned(name: str, version: str) -> str:
    return f"{name}__{version}"


def _text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def repair(spark: SparkSession) -> None:
    """Point the plain names at their published versions.  A table that an earlier
    release of this library wrote under a plain name makes way for the view."""
    kinds = {t.name: t.tableType for t in spark.catalog.listTables()}
    for name, (version, _) in published(spark).items():
        if kinds.get(name, "VIEW") != "VIEW":
            spark.sql(f"DROP TABLE {name}")
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {versioned(name, version)}")


def save_published(df: DataFrame, name: str, **how) -> DataFrame:
    """Write one table and publish it; a failed write leaves the current one."""
    with Release(df.sparkSession) as release:
        release.write(df, name, **how)
        release.publish()
    return df.sparkSession.table(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    """Decides whether the anomaly rollup joins the trust features."""
    return spark.catalog.tableExists(name)


def load_raw_tables(spark: SparkSession, raw: dict[str, DataFrame]) -> None:
    """A1: (re)create the four raw tables, checked against their schemas, as one release."""
    with Release(spark) as release:
        for name, df in raw.items():
            release.write(conform(df, RAW_SCHEMAS[name]), name)
        release.publish()


def read_raw(spark: SparkSession):
    """A2: scan the raw tables (declared schema enforced)."""
    from .fixtures import Raw
    t = {n: conform(spark.table(n), s) for n, s in RAW_SCHEMAS.items()}
    return Raw(t["raw_patients"], t["raw_admissions"], t["raw_diagnoses_icd"], t["raw_chartevents"])


# --- models ------------------------------------------------------------------

def save_trust_model(model, path: str, calibration=None) -> None:
    """A10: the fitted PipelineModel (assembler, scaler, trees) and, beside it, the
    calibration of its probabilities."""
    model.write().overwrite().save(path)
    if calibration is not None:
        SparkSession.getActiveSession().createDataFrame([([float(s) for s in calibration.shares],)], "shares array<double>") \
            .coalesce(1).write.mode("overwrite").parquet(path.rstrip("/") + "_calibration")


def load_trust_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def load_calibration(spark: SparkSession, path: str):
    """The calibration saved with the trust model at ``path``; the one that changes
    nothing for a model saved without."""
    from pyspark.errors import AnalysisException

    from ..operators.calibrate import Calibration
    try:
        return Calibration(list(spark.read.schema("shares array<double>").parquet(path.rstrip("/") + "_calibration").first()["shares"]))
    except AnalysisException:      # the path does not exist
        return Calibration()


def save_anomaly_model(spark: SparkSession, model, path: str) -> None:
    """Weights + threshold as one binary row in Parquet (a sidecar the
    whole cluster can read)."""
    spark.createDataFrame([(model.kind, bytearray(model.to_bytes()))], "kind string, blob binary") \
        .coalesce(1).write.mode("overwrite").parquet(path)


def load_anomaly_model(spark: SparkSession, path: str):
    from ..operators.reconstruct import PcaModel
    row = spark.read.parquet(path).first()
    return PcaModel.from_bytes(bytes(row["blob"]))


# --- run log -------------------------------------------------------------------

RUN_SCHEMA = "run string, name string, value double, step int, ts timestamp, status string"
RUN_COLUMNS = ["roc_auc", "train_loss", "anomaly_threshold_p95"]


def log_run(spark: SparkSession, path: str, run: str, metrics: dict, step: int | None = None,
            params: dict | None = None, status: str = "FINISHED") -> None:
    """Append parameters and metrics of a run (long form) with its status.  A
    metric that is a list has a value for each step, from 1."""
    ts = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rows = [(run, k, float(x), i, ts, status) for k, v in metrics.items() if v is not None
            for i, x in (enumerate(v, 1) if isinstance(v, (list, tuple)) else [(step, v)])]
    rows += [(run, f"param.{k}", float(v), None, ts, status) for k, v in (params or {}).items()
             if isinstance(v, (int, float))]
    spark.createDataFrame(rows, RUN_SCHEMA).write.mode("append").parquet(path)


@contextmanager
def logged_run(spark: SparkSession, path: str, run: str, params: dict):
    """Log ``params`` and the metrics that the body puts into the dict it gets;
    a body that raises is logged as FAILED."""
    metrics: dict = {}
    try:
        yield metrics
    except Exception:
        log_run(spark, path, run, metrics, params=params, status="FAILED")
        raise
    log_run(spark, path, run, metrics, params=params)


def latest_runs(log: DataFrame, n: int = 20, metrics=RUN_COLUMNS) -> DataFrame:
    """the n newest runs (ties by name) with status and chosen metrics, each as
    of its last step.  One map-side combined aggregate; n is the feature."""
    def last(m):
        at = F.when((F.col("name") == m) & F.col("value").isNotNull(), F.struct("step", "ts", "value"))
        return F.max_by("value", at).alias(m)
    return (log.groupBy("run").agg(F.max("ts").alias("ts"), F.max_by("status", F.struct("ts", "status")).alias("status"),
                                   *[last(m) for m in metrics])
            .orderBy(F.desc("ts"), "run").limit(n))


def recent_runs(spark: SparkSession, path: str, n: int = 20, metrics=RUN_COLUMNS) -> DataFrame:
    """F5 over the stored run log; no rows before the first run."""
    from pyspark.errors import AnalysisException
    try:
        log = spark.read.schema(RUN_SCHEMA).parquet(path)
    except AnalysisException:      # the path does not exist yet
        log = spark.createDataFrame([], RUN_SCHEMA)
    return latest_runs(log, n, metrics)
