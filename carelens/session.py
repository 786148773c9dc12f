"""Spark session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# SQL settings the operators need; applied to any session handed to us.
RUNTIME_CONF = {
    # Timestamps are wall-clock (naive) in the source data; hour arithmetic
    # must not move with a local time zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows handed to a Python worker at once: texts may be long, and a batch lies in
    # the executor and in the worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``carelens`` importable by executor Python workers (pandas UDFs
    and mapInPandas functions are pickled by module reference): zip the
    package once per application and add it with addPyFile, as --py-files
    would."""
    import shutil
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="carelens-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "carelens"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir=os.path.basename(pkg))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and ship the package (idempotent, cheap)."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


def small_methods(spark: SparkSession) -> None:
    """Whole-stage code only where its methods are small enough for the JVM to compile
    (8,000 bytes, HotSpot's limit); longer ones would be interpreted, several times slower
    than the split methods that Spark generates instead."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Only when the setting is absent and the master is local (tests, a laptop)
    do we create our own; on a cluster that is an error, as executors would not
    share the folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not spark.conf.get("spark.checkpoint.dir", None):
        d = d or tempfile.mkdtemp(prefix="carelens-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - core settings may be read-only at run time
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder, on whatever file system that is;
    deleted when the application ends."""
    path = os.path.join(checkpoint_dir(spark), name, uuid.uuid4().hex[:12])
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "carelens", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the benchmark (UI off, loopback only)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.host", "127.0.0.1")
         .config("spark.driver.bindAddress", "127.0.0.1")
         .config("spark.driver.memory", os.environ.get("CARELENS_DRIVER_MEM", "16g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="carelens-wh-"))
         .config("spark.driver.extraJavaOptions", "-Dderby.system.home=" + tempfile.mkdtemp(prefix="carelens-derby-")))
    for k, v in RUNTIME_CONF.items():
        b = b.config(k, v)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark
