"""Streams and stateful operators, run to the end over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylane.functions import text
from quarrylane.registry import query
from quarrylane.session import shared_dir
from quarrylane.sources.entities import entity, table
from quarrylane.streaming import ingest
from quarrylane.streaming.tasks import task_stream

STATES = ("READING", "PARSING", "SCRUBBING", "LLM", "PERSIST", "SUCCESS", "FAILURE")
EVENT_STATE = "CASE event_type WHEN 'view' THEN 'READING' WHEN 'click' THEN 'PARSING' WHEN 'signup' THEN 'LLM' WHEN 'purchase' THEN 'SUCCESS' ELSE 'FAILURE' END"
LATEST = f"t AS (SELECT user_id AS task, {EVENT_STATE} AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)"
PROGRESS = "CASE state WHEN 'READING' THEN 10 WHEN 'PARSING' THEN 30 WHEN 'SCRUBBING' THEN 50 WHEN 'LLM' THEN 70 WHEN 'PERSIST' THEN 90 ELSE 100 END"


def tasks(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("task"), F.expr(EVENT_STATE).alias("state"), F.struct("ts", "event_id").alias("ts"))


def stream(spark, sf, name: str):
    """A given table as a stream: Spark writes it to a folder, which the stream reads."""
    rows = table(spark, sf, name)
    folder = shared_dir(spark)
    rows.write.parquet(f"{folder}/in")
    return ingest.rows(spark, f"{folder}/in", rows.schema), folder


@query("st01_ingest_stream", rf"SELECT id, coalesce(nullif(regexp_extract(raw_text, '{text.EMAIL}'), ''), '{text.NO_EMAIL}') AS email FROM resumes", ("resumes",))
def st01(spark, sf):
    """Résumés arrive in two folders' worth of files, are parsed and upserted."""
    resumes = entity(spark, sf, "resumes")
    folder = shared_dir(spark)
    resumes.repartition(2).write.parquet(f"{folder}/in")
    arriving = ingest.rows(spark, f"{folder}/in", resumes.schema)
    parse = lambda batch: batch.select("id", text.email(F.col("raw_text")).alias("email"))
    ingest.drain(arriving, ingest.upsert_into(f"{folder}/store", "id", parse), f"{folder}/state")
    return ingest.latest_versions(spark, f"{folder}/store")


@query("st02_task_state", f"WITH {LATEST} SELECT task, state, {PROGRESS} AS progress FROM t WHERE k = 1")
def st02(spark, sf):
    return ingest.task_states(tasks(spark, sf))


@query("st02_task_timers", f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS task, {EVENT_STATE} AS state, epoch_ms(ts) AS ms FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY CASE WHEN state IN ('SUCCESS', 'FAILURE') THEN 0 ELSE 1 END, CASE WHEN state IN ('SUCCESS', 'FAILURE') THEN ms ELSE -ms END, CASE WHEN state IN ('SUCCESS', 'FAILURE') THEN state END, state DESC) AS k FROM e),
c AS (SELECT task, state, ms FROM r WHERE k = 1)
SELECT task, state, 'event' AS cause FROM c UNION ALL SELECT task, 'TIMEOUT', 'timer' FROM c WHERE state NOT IN ('SUCCESS', 'FAILURE') AND ms + 300000 <= (SELECT max(ms) FROM e) - 10000""")
def st02_timers(spark, sf):
    """Users as tasks of a stream of events: what has ended first stays, what has had no event for 300 seconds is timed out by a timer."""
    rows, folder = stream(spark, sf, "events")
    events = rows.select(F.col("user_id").cast("string").alias("task"), F.expr(EVENT_STATE).alias("state"), F.col("ts").cast("timestamp").alias("at"))
    changes = task_stream(events, kept=10 * 365 * 86400)  # none is cleared within the table's time
    changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("task string, state string, cause string").parquet(f"{folder}/out")


@query("st03_poll_status", f"""WITH {LATEST} SELECT task, CASE WHEN state IN ('SUCCESS', 'FAILURE') THEN state WHEN state = 'READING' THEN 'PENDING' ELSE 'PROGRESS' END AS status,
CASE WHEN state = 'READING' THEN 'Task is queued and waiting for an available worker.' END AS message, CASE WHEN state IN ('PARSING', 'LLM') THEN {PROGRESS} END AS progress FROM t WHERE k = 1""")
def st03(spark, sf):
    s = F.col("state")
    status = F.when(s.isin("SUCCESS", "FAILURE"), s).when(s == "READING", "PENDING").otherwise("PROGRESS")
    return ingest.task_states(tasks(spark, sf)).select("task", status.alias("status"), F.when(s == "READING", "Task is queued and waiting for an available worker.").alias("message"), F.when(status == "PROGRESS", F.col("progress")).alias("progress"))


@query("st04_retry", """WITH r AS (SELECT event_id, event_type = 'error' AS failed, event_id % 7 AS attempts FROM events)
SELECT event_id, CASE WHEN NOT failed THEN 'done' WHEN attempts + 1 <= 5 THEN 'again' ELSE 'given up' END AS fate, CASE WHEN failed AND attempts + 1 <= 5 THEN least(pow(2.0, attempts + 1), 300.0) END AS delay_s FROM r""")
def st04(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 7).alias("attempts"))
    done, again, lost = ingest.with_retries(rows, "ok")
    out = done.select("event_id", F.lit("done").alias("fate"), F.lit(None).cast("double").alias("delay_s"))
    return out.unionByName(again.select("event_id", F.lit("again").alias("fate"), "delay_s")).unionByName(lost.select("event_id", F.lit("given up").alias("fate"), F.lit(None).cast("double").alias("delay_s")))


@query("st05_time_limit", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value * 3 > 240) AS soft, count(*) FILTER (WHERE value * 3 > 300) AS hard FROM events GROUP BY event_type")
def st05(spark, sf):
    seconds = F.col("value") * 3
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(seconds > 240).alias("soft"), F.count_if(seconds > 300).alias("hard"))


@query("st06_dedup_pairs", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def st06(spark, sf):
    """Pairs as a stream, each once: the watermark spans the whole table, so that none comes up again."""
    rows, folder = stream(spark, sf, "events")
    pairs = ingest.unique_pairs(rows.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "event_type"], late="400 days").select("user_id", "event_type")
    pairs.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(f"{folder}/out")


@query("st07_weekly_stream", "SELECT CAST(to_timestamp(floor(epoch(ts) / 604800) * 604800) AT TIME ZONE 'UTC' AS DATE) AS week, count(*) AS n FROM events GROUP BY 1")
def st07(spark, sf):
    """Seven-day windows over the stream of events, in complete mode."""
    rows, folder = stream(spark, sf, "events")
    counts = ingest.weekly(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    out = f"{folder}/out"

    def keep(batch, _):
        batch.select(F.to_date("week").alias("week"), "n").write.mode("overwrite").parquet(out)

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("week date, n long").parquet(out)
