"""Queries on task and artifact records, with their oracle SQL.

Orders are the task log (status O pending, F finished, P failed), line items the
entries of the tasks' artifact manifests (the line number is the kind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orograph.operators.registry import Registry
from orograph.sources.fixtures import table

REGISTRY = Registry()
query = REGISTRY.query

#: Kinds of artifact that a task's contract names: (kind, required).
CONTRACT = ((1, True), (2, True), (3, True), (4, False), (5, False), (8, True))
_CONTRACT_SQL = "contract(kind, required) AS (VALUES " + ", ".join(f"({k}, {str(r).upper()})" for k, r in CONTRACT) + ")"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, dem_id, status, created, cost)."""
    status = F.element_at(F.create_map(*map(F.lit, ("O", "pending", "F", "finished", "P", "failed"))), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 50).alias("dem_id"), status.alias("status"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").alias("cost"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, kind, entries): the manifest of each task, folded by kind."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("kind")).agg(F.count("*").alias("entries"))


TASKS = "WITH tasks AS (SELECT o_orderkey AS task_id, o_custkey % 50 AS dem_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'finished' WHEN 'P' THEN 'failed' END AS status, o_orderdate AS created, o_totalprice AS cost FROM orders), artifacts AS (SELECT l_orderkey AS task_id, l_linenumber AS kind, count(*) AS entries FROM lineitem GROUP BY ALL)"


@query(f"{TASKS} SELECT task_id, status, created FROM tasks ORDER BY created DESC, task_id")
def latest_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).orderBy(F.desc("created"), "task_id").select("task_id", "status", "created")


@query(f"{TASKS} SELECT task_id, status, created FROM tasks ORDER BY created DESC, task_id")
def task_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).orderBy(F.desc("created"), "task_id").select("task_id", "status", "created")


@query(f"{TASKS} SELECT dem_id, count(*) AS tasks, count(*) FILTER (status = 'pending') AS active FROM tasks GROUP BY dem_id")
def dem_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).groupBy("dem_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "pending").alias("active"))


@query(f"{TASKS} SELECT task_id, status, CASE WHEN status = 'pending' THEN 'failed' ELSE status END AS new_status, CASE WHEN status = 'pending' THEN 'interrupted' END AS message FROM tasks")
def recover_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("status") == "pending"
    return tasks(spark, sf_dir).select("task_id", "status", F.when(hit, "failed").otherwise(F.col("status")).alias("new_status"), F.when(hit, "interrupted").alias("message"))


@query(f"{TASKS}, {_CONTRACT_SQL}, e AS (SELECT task_id, kind, required FROM tasks, contract WHERE status = 'finished'), m AS (SELECT a.* FROM artifacts a JOIN tasks USING (task_id) WHERE status = 'finished') SELECT task_id, kind, coalesce(entries, 0) AS entries, CASE WHEN required IS NULL THEN 'unexpected' WHEN entries IS NULL AND required THEN 'missing' WHEN entries IS NULL THEN 'absent' WHEN entries > 1 THEN 'repeated' ELSE 'ok' END AS state FROM e FULL JOIN m USING (task_id, kind)")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tasks(spark, sf_dir).where("status = 'finished'").select("task_id")
    wanted = done.withColumn("k", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(r).alias("required")) for k, r in CONTRACT)))).select("task_id", "k.kind", "k.required")
    there = artifacts(spark, sf_dir).join(done, "task_id", "left_semi")
    state = (
        F.when(F.col("required").isNull(), "unexpected")
        .when(F.col("entries").isNull() & F.col("required"), "missing")
        .when(F.col("entries").isNull(), "absent")
        .when(F.col("entries") > 1, "repeated")
        .otherwise("ok")
    )
    return wanted.join(there, ["task_id", "kind"], "full").select("task_id", "kind", F.coalesce("entries", F.lit(0)).alias("entries"), state.alias("state"))


@query(f"{TASKS} SELECT task_id, status, coalesce(n, 0) AS artifacts, CASE WHEN status = 'pending' THEN 409 WHEN status = 'failed' THEN 410 WHEN n IS NULL THEN 404 ELSE 200 END AS code FROM tasks LEFT JOIN (SELECT task_id, count(*) AS n FROM artifacts GROUP BY task_id) USING (task_id)")
def resolve_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = artifacts(spark, sf_dir).groupBy("task_id").agg(F.count("*").alias("n"))
    code = F.when(F.col("status") == "pending", 409).when(F.col("status") == "failed", 410).when(F.col("n").isNull(), 404).otherwise(200)
    return tasks(spark, sf_dir).join(n, "task_id", "left").select("task_id", "status", F.coalesce("n", F.lit(0)).alias("artifacts"), code.alias("code"))


@query(f"{TASKS}, k AS (SELECT dem_id, status, cost, row_number() OVER (PARTITION BY dem_id ORDER BY created DESC, task_id DESC) AS n FROM tasks WHERE status <> 'pending'), q AS (SELECT dem_id, count(*) AS queued FROM tasks WHERE status = 'pending' GROUP BY dem_id) SELECT dem_id, round(avg(cost), 4) AS run_estimate, round(avg(cost) * coalesce(any_value(queued), 0), 4) AS wait_estimate FROM k LEFT JOIN q USING (dem_id) WHERE n <= 12 GROUP BY dem_id")
def run_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks(spark, sf_dir)
    w = Window.partitionBy("dem_id").orderBy(F.desc("created"), F.desc("task_id"))
    last = rows.where("status <> 'pending'").withColumn("n", F.row_number().over(w)).where("n <= 12").groupBy("dem_id").agg(F.avg("cost").alias("mean"))
    queued = rows.where("status = 'pending'").groupBy("dem_id").agg(F.count("*").alias("queued"))
    return last.join(queued, "dem_id", "left").select("dem_id", F.round("mean", 4).alias("run_estimate"), F.round(F.col("mean") * F.coalesce("queued", F.lit(0)), 4).alias("wait_estimate"))


REQUEST = """'{"dem":' || (o_custkey % 50) || ',"kind":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}'"""


@query(f"WITH h AS (SELECT o_orderkey AS task_id, sha256({REQUEST}) AS request_hash FROM orders) SELECT request_hash, count(*) AS tasks, min(task_id) AS first_task FROM h GROUP BY request_hash")
def request_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = F.to_json(F.struct((F.col("o_custkey") % 50).alias("dem"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status")))
    return table(spark, sf_dir, "orders").groupBy(F.sha2(request, 256).alias("request_hash")).agg(F.count("*").alias("tasks"), F.min("o_orderkey").alias("first_task"))


@query(f"{TASKS} SELECT dem_id FROM tasks GROUP BY dem_id HAVING count(*) FILTER (status = 'pending') = 0 UNION SELECT DISTINCT d::BIGINT FROM (SELECT unnest(range(0, 60)) AS d) WHERE d NOT IN (SELECT dem_id FROM tasks)")
def deletable_dems(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = tasks(spark, sf_dir).where("status = 'pending'").select("dem_id").distinct()
    return spark.range(60).select(F.col("id").alias("dem_id")).join(active, "dem_id", "left_anti")


@query(f"{TASKS}, {_CONTRACT_SQL} SELECT t.task_id, list(c.kind ORDER BY c.kind)::VARCHAR AS missing FROM tasks t, contract c WHERE t.status = 'finished' AND c.required AND NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.task_id = t.task_id AND a.kind = c.kind) GROUP BY t.task_id")
def missing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = artifacts(spark, sf_dir).groupBy("task_id").agg(F.collect_set("kind").alias("kinds"))
    required = F.array(*(F.lit(k) for k, r in CONTRACT if r))
    done = tasks(spark, sf_dir).where("status = 'finished'").join(got, "task_id", "left")
    gone = F.array_sort(F.array_except(required, F.coalesce("kinds", F.array().cast("array<int>"))))
    return done.withColumn("gone", gone).where("size(gone) > 0").select("task_id", F.concat(F.lit("["), F.array_join(F.col("gone").cast("array<string>"), ", "), F.lit("]")).alias("missing"))


@query("WITH g AS (SELECT DISTINCT l_orderkey AS upload_id, l_linenumber::INT AS chunk FROM lineitem), u AS (SELECT DISTINCT upload_id FROM g) SELECT upload_id, chunk::INT AS chunk FROM u, (SELECT unnest(range(1, 8)) AS chunk) EXCEPT SELECT upload_id, chunk FROM g")
def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").cast("int").alias("chunk")).distinct()
    wanted = got.select("upload_id").distinct().withColumn("chunk", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return wanted.join(got, ["upload_id", "chunk"], "left_anti")


@query("SELECT event_id, round(CASE event_type WHEN 'click' THEN 1.6 WHEN 'view' THEN 1.3 WHEN 'purchase' THEN 1.1 ELSE 1.2 END, 2)::DOUBLE AS factor, CASE WHEN value < 0 THEN 'neg_' ELSE '' END || replace(abs(floor(value * 10) / 10)::DECIMAL(18, 1)::VARCHAR, '.', 'p') AS token FROM events")
def class_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = F.create_map(*map(F.lit, ("click", 1.6, "view", 1.3, "purchase", 1.1)))
    number = F.abs(F.floor(F.col("value") * 10) / 10).cast("decimal(18,1)").cast("string")
    token = F.concat(F.when(F.col("value") < 0, "neg_").otherwise(""), F.regexp_replace(number, r"\.", "p"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(factors, F.lower("event_type")), F.lit(1.2)).alias("factor"), token.alias("token"))


@query("SELECT user_id, array_to_string(list(DISTINCT event_type ORDER BY event_type), ',') AS kinds, count(*) AS n, array_to_string(list(event_type ORDER BY ts DESC, event_id DESC)[1:3], ',') AS latest FROM events GROUP BY user_id")
def distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = events.withColumn("nth", nth).where("nth <= 3").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "event_type"))), lambda x: x["event_type"]), ",").alias("latest"))
    kinds = events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.count("*").alias("n"))
    return kinds.join(last, "user_id")
