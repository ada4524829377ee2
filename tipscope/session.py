"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", *, shuffle_partitions: int = 8, app: str = "tipscope",
                  **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, bring your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # The JVM does not compile methods of more than 8000 bytes; past that, generated code
        # in smaller pieces is faster than one method that stays interpreted.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for each Spark context.

    Functions that run in workers are found there by import; without this they are found only if
    the package is installed or on the workers' path.
    """
    context = spark.sparkContext
    if not getattr(context, "_tipscope_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="tipscope-code-"), "tipscope.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, files in os.walk(os.path.join(root, "tipscope")):
                for name in sorted(files):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, root))
        context.addPyFile(archive)  # a driver's file that Spark itself serves to all executors
        context._tipscope_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``) may go without it; then a temporary folder is
    made and registered. Elsewhere executors would each write to a disk of their own, so a missing
    setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tipscope-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_dir(spark).rstrip('/')}/tipscope-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    For results that several branches of a plan use: the lineage ends at the written table, a
    lost executor only re-reads files, and each branch scans just the columns it needs.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._scratch = path
    return stored


def release(*frames: DataFrame) -> None:
    """Delete the files of frames that ``materialize`` returned.

    Only for tables whose every reader has itself been stored: nothing may need them again, not
    even after the loss of an executor.
    """
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
