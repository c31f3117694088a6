"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "sessionlens") -> SparkSession:
    """A local session for tests and benchmarks (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's executors, once per application.

    Functions that run in tasks are pickled by name, so workers must be able to import
    them.  Where the package is installed on every machine this only repeats it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    made = os.path.join(tempfile.mkdtemp(prefix="sessionlens-package-"), "sessionlens.zip")  # on the driver; Spark's file server hands it out
    with zipfile.ZipFile(made, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(made)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local-mode session without either gets a private temporary folder; on a
    cluster a missing setting is an error, because a machine-local folder would
    not survive the loss of an executor.
    """
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if got:
        return got
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sessionlens-shared-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet (zstandard) in the shared folder and read back: cuts the lineage, keeps column pruning."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    if _scopes:
        _scopes[-1].append(table)
    return table


_scopes: list[list[DataFrame]] = []


@contextmanager
def written_removed() -> Iterator[None]:
    """Tables that ``written`` makes inside are deleted at the end; results that read them must be stored by then."""
    _scopes.append([])
    try:
        yield
    finally:
        remove_written(*_scopes.pop())


def remove_written(*tables: DataFrame) -> None:
    """Delete what ``written`` made, once nothing reads it any more (only folders directly in the shared folder)."""
    for table in tables:
        spark = table.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        shared = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        fs = shared.getFileSystem(conf)
        shared = fs.makeQualified(shared)
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(folder))
            if path.getParent() is not None and path.getParent().equals(shared):
                fs.delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder, set as the checkpoint folder where the context has none."""
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder
