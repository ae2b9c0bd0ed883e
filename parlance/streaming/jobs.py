"""Three incremental jobs over file streams: ingest, progress, active visits.

Every job runs with ``availableNow``: it takes the files that are new since its
checkpoint and stops, so a scheduled re-run skips finished work. A batch that is run
again after a failure writes the same result once more, so nothing is counted twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Keys live in RocksDB on the executors; a batch saves its changes, not the whole store.
KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# Batches of daily counts after which they are merged into a snapshot.
SNAPSHOT_EVERY = 32


def read_files(spark: SparkSession, path: str, schema, name: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _start(
    rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
    settings: dict[str, str] | None = None,
) -> StreamingQuery:
    """Starts a query; it keeps the settings it was started with, the session does not."""
    conf = rows.sparkSession.conf
    before = {k: conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        conf.set(k, v)
    try:
        return (
            rows.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _folders(spark: SparkSession, path: str, name: str) -> dict[int, tuple[bool, int]]:
    """Number of each folder ``name=number``: whether it is complete, and when it was changed."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return {}
    found = {}
    for s in files.listStatus(where):
        kind, _, number = s.getPath().getName().partition("=")
        if kind == name:
            mark = jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")
            found[int(number)] = files.exists(mark), s.getModificationTime()
    return found


def _complete(spark: SparkSession, path: str, name: str) -> list[int]:
    return sorted(n for n, (done, _) in _folders(spark, path, name).items() if done)


def _publish(out: str):
    """One folder per batch; a batch that runs again replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def ingest(rows: DataFrame, key: list[str], event_time: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append each key once: the first batch that brings it, the earliest row of that batch.

    Keys are kept for good, so neither late keys are lost nor old ones taken again, however
    late they come. They are state: a batch looks up its own keys where they are stored and
    never reads the output. The state of a key is the time of its batch and its row; a
    batch gives the keys whose time is its own, and writes them into a folder of its own.
    A batch that failed runs again with the same time from the state before it.

    Batches are told apart by their times, so these must not go back: a run whose clock is
    behind the last folder's is refused.
    """
    spark = rows.sparkSession
    last = max((at for _, at in _folders(spark, out, "batch").values()), default=0)
    if time.time() * 1000 < last:
        raise ValueError(f"the clock is behind the last batch in {out}")
    rest = [c for c in rows.columns if c not in (*key, event_time)]
    dated = rows.withColumn("_batch_time", F.current_timestamp())
    first = dated.groupBy(*key).agg(F.min(F.struct("_batch_time", event_time, *rest)).alias("_r"))
    new = first.filter(F.col("_r._batch_time") == F.current_timestamp())
    taken = new.select(*[F.col(c) if c in key else F.col(f"_r.`{c}`") for c in rows.columns])
    return _start(taken, _publish(out), checkpoint, "update", KEYED_STATE)


def newest(spark: SparkSession, out: str) -> DataFrame:
    """The result of the last batch whose folder is complete."""
    return spark.read.parquet(f"{out}/batch={_complete(spark, out, 'batch')[-1]}")


def progress(rows: DataFrame, by: str, out: str, checkpoint: str) -> StreamingQuery:
    """Finished rows per group so far; ``newest`` reads the last complete state."""
    counts = rows.groupBy(by).agg(F.count("*").alias("done"))
    return _start(counts, _publish(out), checkpoint, "complete")


def daily_visits(
    rows: DataFrame, event_time: str, out: str, checkpoint: str, every: int = SNAPSHOT_EVERY
) -> StreamingQuery:
    """Visits per day and batch. No state is kept, so rows may come as late as they like.

    After every ``every`` batches the counts so far are merged into a snapshot.
    """
    spark = rows.sparkSession
    days = rows.select(F.date_trunc("day", F.col(event_time).cast("timestamp")).alias("day"))

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.filter("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("n"))
        _publish(f"{out}/batches")(counts.coalesce(1), batch_id)
        if batch_id % every == every - 1:
            merge_visits(spark, out)

    return _start(days, write, checkpoint)


DAILY = "day timestamp, n long"


def _counted(spark: SparkSession, out: str) -> tuple[DataFrame, int]:
    """Counts of the newest complete snapshot and of the batches after it; the last of these.

    A snapshot that was cut off lacks its mark and is passed over, and so is what it had
    merged: the batches themselves are never changed.
    """
    upto = (_complete(spark, f"{out}/snapshots", "upto") or [-1])[-1]
    later = [b for b in _complete(spark, f"{out}/batches", "batch") if b > upto]
    paths = [f"{out}/batches/batch={b}" for b in later]
    if upto >= 0:
        paths.append(f"{out}/snapshots/upto={upto}")
    rows = spark.read.schema(DAILY).parquet(*paths) if paths else spark.createDataFrame([], DAILY)
    return rows.groupBy("day").agg(F.sum("n").alias("n")), max([upto, *later])


def merge_visits(spark: SparkSession, out: str) -> None:
    """Writes a snapshot of all complete batches: one row a day, in one file."""
    daily, upto = _counted(spark, out)
    if upto >= 0 and upto not in _complete(spark, f"{out}/snapshots", "upto"):
        daily.coalesce(1).write.mode("overwrite").parquet(f"{out}/snapshots/upto={upto}")


def active_visits(spark: SparkSession, out: str, days: int = 7) -> DataFrame:
    """Visits per window of ``days`` days that begins on a day, from the daily counts."""
    daily, _ = _counted(spark, out)
    back = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    start = F.col("day") - F.make_dt_interval(days=F.col("back"))
    return (
        daily.select("day", "n", back.alias("back"))
        .groupBy(start.alias("window_start")).agg(F.sum("n").alias("visits"))
        .select(
            "window_start",
            (F.col("window_start") + F.make_dt_interval(days=F.lit(days))).alias("window_end"),
            "visits",
        )
    )
