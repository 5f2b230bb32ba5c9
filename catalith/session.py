"""Session set-up and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "catalith", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; master and conf override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where it is unset, a folder of our own (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"catalith-{os.getuid()}", "shared")
    os.makedirs(own, exist_ok=True)
    return own


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df written once to the shared folder, so that it survives lost executors and is not computed twice."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a table that cut wrote and nothing reads any more."""
    sc = df.sparkSession.sparkContext
    rdd = df._jdf.queryExecution().analyzed().rdd()
    file = rdd.getCheckpointFile()
    if file.isDefined():
        where = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder, with all that is in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions set for the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
