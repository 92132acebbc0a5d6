"""Session factory and the shared work folder.

Everything in the engine assumes UTC.  ``work_dir`` hands out folders below the
cluster's shared checkpoint folder; a machine-local folder is used only where no
folder is configured, which is the case in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine is designed for.

    On a cluster, pass ``shuffle_partitions`` as about two to three per core; AQE
    coalesces what is too small and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share; set here only where the cluster names none.

    Without a named folder, a local master gets a temporary one, and a cluster its warehouse,
    unless that is on the machines' own disks, which executors do not share: then this refuses.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        return _shared_warehouse(spark.conf.get("spark.sql.warehouse.dir"))
    root = os.path.join(tempfile.gettempdir(), f"tidemark-{uuid.uuid4().hex[:12]}")
    os.makedirs(root, exist_ok=True)
    spark.sparkContext.setCheckpointDir(root)
    return root


def _shared_warehouse(warehouse: str) -> str:
    if warehouse.startswith("file:") or "://" not in warehouse:
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share: {warehouse} is local to each machine")
    return warehouse.rstrip("/")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder below the shared root, which goes with the application that asked for it."""
    path = f"{shared_root(spark)}/tidemark/{purpose}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, so that no executor needs it installed."""
    sc = spark.sparkContext
    name = f"tidemark-{sc.applicationId}.zip"
    if any(name in p for p in sc._python_includes):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-ship-"), name)  # on the driver, which serves it to executors
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("tidemark", os.path.relpath(full, here)))
    sc.addPyFile(path)
