"""Session settings, the shared folder, and ways to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "graphloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors see.

    Where the session has none (tests, one machine), a temporary folder is set and removed at exit.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not folder and context.getCheckpointDir().isDefined():
        folder = context.getCheckpointDir().get()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder. Spark removes the files when nothing uses them if the session was
    started with ``spark.cleaner.referenceTracking.cleanCheckpoints``, as ``get_spark`` does; else they stay until the folder goes."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_table(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` written as a Parquet table into the shared folder and read again, so that readers may prune it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(_reordered(df, partition_by)).parquet(path)


def _reordered(df: DataFrame, last: Sequence[str]):
    from pyspark.sql import types as T

    fields = [f for f in df.schema if f.name not in last] + [df.schema[name] for name in last]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is over; the folder's owner removes it
        pass


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="graphloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "graphloom-package.zip")
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._graphloom_shipped = True
