"""Spark session set-up and table access.

Everything in the library is a DataFrame -> DataFrame function; this module only
builds a session for tests/bench and reads the input tables.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "tracefold") -> SparkSession:
    """Local session with the settings the library assumes (UTC, AQE, no UI)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("TRACEFOLD_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRACEFOLD_DRIVER_MEMORY", "16g"))
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(READ_PARTITIONS, cpus)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Only where it is unset and the
    session is local (tests) a private scratch folder takes its place: on a
    cluster the executors could not share one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="tracefold-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def delete_on_exit(spark: SparkSession, path: str) -> str:
    """Have a scratch path removed when the application ends."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


_SHIPPED = "tracefold.package.shipped"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session, so that
    functions pickled by reference import there too."""
    if spark.conf.get(_SHIPPED, "") == spark.sparkContext.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tracefold-pkg-"), "tracefold.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)  # Spark distributes it to the executors
    spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)


SESSION_SETTINGS = {
    # times are read and printed in UTC
    "spark.sql.session.timeZone": "UTC",
    # keep one parse per row: without these the optimizer copies a parsed
    # JSON/struct expression (and the regexes feeding it) once per accessed field
    "spark.sql.optimizer.expression.nestedPruning.enabled": "false",
    "spark.sql.optimizer.enableJsonExpressionOptimization": "false",
}


def prepare(spark: SparkSession) -> None:
    """Session settings every query relies on."""
    for k, v in SESSION_SETTINGS.items():
        spark.conf.set(k, v)
    ship_package(spark)


#: Session setting: deal a table out to so many partitions when it is read.
#: Unset on a cluster, where inputs have many splits; tests and the benchmark set
#: it, as their tables are single row groups that one task would read.
READ_PARTITIONS = "tracefold.read.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read an input table."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = int(spark.conf.get(READ_PARTITIONS, "0"))
    return df.repartition(n) if n else df
