"""Session settings that operators rely on."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in every Python worker, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="kmerloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "kmerloom_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(archive)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Sets a folder for checkpoints where neither spark.checkpoint.dir nor the context has one.

    In local mode that is a temporary folder; on a cluster, a folder of the warehouse, which all executors share.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
        return
    own = tempfile.mkdtemp(prefix="kmerloom-ckpt-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)


def _filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _removed(spark: SparkSession, path: str) -> None:
    try:
        at, fs = _filesystem(spark, path)
        fs.delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def scratch_path(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder; what is written there goes when the driver ends."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, path)
    return path


def renamed_parts(spark: SparkSession, folder: str, ending: str) -> None:
    """Gives Spark's part files in a folder another ending."""
    at, fs = _filesystem(spark, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if name.startswith("part-"):
            fs.rename(f.getPath(), path(at, f"{name.split('.')[0]}.{ending}"))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it has fewer splits than there are (one file of one row group is read by one task); tables of many splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its plan by a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
