"""The state of tasks, followed from a stream of changes.

A change says what a task became and when; it has a key of its own, so that it
can be sent again. The last writer wins, by time and then by key, so neither
repeats nor late or disordered changes alter the outcome: the state kept for a
task is its newest change, one row. Every micro-batch writes what it altered to
a folder of its number, over what an interrupted run of the same batch left
there; readers take the newest change of each task. Records that are no valid
change go to a quarantine folder instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a task can be.
STATUSES = ("queued", "running", "finished", "failed", "cancelled", "interrupted")
CHANGE = "task_id string, status string, progress int, at timestamp, key string"


def valid(statuses: tuple[str, ...] = STATUSES):
    """Whether a row is a change: it names a task, a time, a key and a known status."""
    named = F.col("task_id").isNotNull() & F.col("at").isNotNull() & F.col("key").isNotNull()
    return F.coalesce(named & F.col("status").isin(*statuses), F.lit(False))


def newest(changes: DataFrame) -> DataFrame:
    """The newest change of each task (task_id, status, progress, at, key)."""
    best = changes.groupBy("task_id").agg(F.max_by(F.struct("status", "progress", "at", "key"), F.struct("at", "key")).alias("s"))
    return best.select("task_id", "s.*")


def follow(changes: DataFrame, out: str, statuses: tuple[str, ...] = STATUSES) -> None:
    """Take in all changes that a stream (of CHANGE, and ``raw`` for what could not be read) has now, below the folder ``out``.

    Called again, it takes in what has come since.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/states/batch={number}")

    def put_aside(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")

    good = newest(changes.where(valid(statuses))).writeStream.outputMode("update").foreachBatch(write)
    bad = changes.where(~valid(statuses)).writeStream.outputMode("append").foreachBatch(put_aside)
    runs = [s.option("checkpointLocation", f"{out}/progress/{name}").trigger(availableNow=True).start() for name, s in (("states", good), ("quarantine", bad))]
    for run in runs:
        run.awaitTermination()


def states(spark: SparkSession, out: str) -> DataFrame:
    """The state of every task that ``follow`` has met."""
    return newest(spark.read.parquet(f"{out}/states"))


def quarantined(spark: SparkSession, out: str) -> DataFrame:
    """The records that ``follow`` put aside."""
    return spark.read.parquet(f"{out}/quarantine").drop("batch")


def json_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of changes from files of JSON lines; a line that is no such record is kept in ``raw``."""
    lines = spark.readStream.schema(f"{CHANGE}, raw string").option("columnNameOfCorruptRecord", "raw")
    return lines.json(folder)
