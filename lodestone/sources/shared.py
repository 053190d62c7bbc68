"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own name for the folder that the driver and all executors share.
CHECKPOINT_CONF = "spark.checkpoint.dir"

#: Drops an execution's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Whether collecting aggregates are tried by hashing first.
BY_HASH = "spark.sql.execution.useObjectHashAggregateExec"


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that outlive an executor.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a session that runs in one local process may go
    without; it gets a temporary folder that is removed at exit.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place below the shared folder."""
    return f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, small_groups: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage is cut and no executor owns it.

    Lists over very many ``small_groups`` are collected by sorting from the start; hashing gives up after 128 groups and sorts then.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    settings = {CLEAN_UP: "true"} | ({BY_HASH: "false"} if small_groups else {})  # what is written needs its shuffle files no longer
    before = {k: spark.conf.get(k, "true") for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
