"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import gc
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


# Setting of a session on one machine: tasks that share the rows of a one-split file.
SCAN_TASKS = "spark.parlance.scanTasks"


def local_session(cores: str = "*", app: str = "parlance") -> SparkSession:
    """Session for one machine; on a cluster, pass the session the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(SCAN_TASKS, str(os.cpu_count() if cores == "*" else cores))
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """Rows over as many tasks as the session asks for, as they come where it asks for none."""
    tasks = df.sparkSession.conf.get(SCAN_TASKS, None)
    return df.repartition(int(tasks)) if tasks else df


# Folders of this machine by application, for sessions that have no shared one.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: ``spark.checkpoint.dir``.

    Only a session whose tasks run in this very process gets a folder of this machine when
    the setting is missing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    # The setting cannot be made while a session runs, so the folder is remembered here.
    folder = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="parlance-")
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For results that several later steps use: they are computed once, the plan stays
    short, and lost executors cost no more than the current step.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of queries that are over.

    It does so when the driver has collected the objects that stand for them, which a driver
    with little to do may put off for half an hour. The first collection only lets go of what
    held some of them, as trials show; the second one gets them.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
