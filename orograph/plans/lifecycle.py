"""The query on the life cycle of tasks, followed as a stream, with its oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.operators.checkpoint import folder
from orograph.operators.registry import Registry
from orograph.sources.fixtures import table
from orograph.streaming import lifecycle

REGISTRY = Registry()
query = REGISTRY.query

#: The events that count as changes of a task; errors are no status and go to quarantine.
KNOWN = ("click", "view", "signup", "purchase")


@query("SELECT user_id AS task_id, arg_max(event_type, (ts, lpad(event_id::VARCHAR, 20, '0'))) AS status, arg_max(event_id, (ts, lpad(event_id::VARCHAR, 20, '0'))) AS last_change FROM events WHERE event_type <> 'error' GROUP BY user_id")
def replayed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of every user, from the events read as a stream of changes, each of them sent twice."""
    kinds = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    key = F.lpad(F.col("event_id").cast("string"), 20, "0")
    changes = events.select(F.col("user_id").cast("string").alias("task_id"), F.col("event_type").alias("status"), F.lit(0).alias("progress"), F.col("ts").alias("at"), key.alias("key"), F.lit(None).cast("string").alias("raw"))
    out = f"{folder(table(spark, sf_dir, 'events'))}/lifecycle-{uuid.uuid4()}"
    lifecycle.follow(changes.union(changes), out, KNOWN)
    done = lifecycle.states(spark, out)
    return done.select(F.col("task_id").cast("long").alias("task_id"), "status", F.col("key").cast("long").alias("last_change"))
