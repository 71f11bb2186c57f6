"""Queries that replay events as a stream to its end; their SQL is the batch equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.sources.tables import r6, s6, table
from millrace.streaming import queue as Q

QUERIES, SQL = {}, {}


def _scratch(spark):
    """A new folder that driver and executors share: in spark.checkpoint.dir, or where that is unset below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/millrace-streams"
    return f"{root}/stream-{uuid.uuid4().hex}"


def _events(s, d):
    return Q.read_stream(s, f"{d}/events*.parquet", table(s, d, "events").schema)


def _replayed(name, build, mode, sql):
    def run(s, d):
        at = _scratch(s)
        return Q.replay(build(_events(s, d)), f"{at}/out", f"{at}/checkpoint", mode)

    QUERIES[name], SQL[name] = run, sql


_replayed("stm_running_accuracy", lambda e: Q.running_accuracy(e.select("event_type", (F.col("user_id") % 5 != 0).alias("answered"), ((F.col("user_id") % 5 != 0) & (F.col("value") > 20)).alias("correct")), "event_type").withColumn("accuracy", r6("accuracy")), "complete",
          f"SELECT event_type, count(*) FILTER (user_id % 5 <> 0) AS total_with_answer, count(*) FILTER (user_id % 5 <> 0 AND value > 20) AS correct, {s6('count(*) FILTER (user_id % 5 <> 0 AND value > 20) / count(*) FILTER (user_id % 5 <> 0)')} AS accuracy FROM events GROUP BY event_type")
_replayed("stm_staleness_quota", lambda e: Q.staleness_quota(e.select(F.get_json_object("props", "$.k").cast("long").alias("version"), F.lit(1).cast("long").alias("n")), 32, 0.5, 2), "complete",
          "SELECT CAST(props->>'$.k' AS BIGINT) AS version, count(*) AS taken, 96::BIGINT AS quota, count(*) >= 96 AS paused FROM events GROUP BY 1")
_replayed("stm_windowed_metrics", lambda e: Q.windowed_metrics(e, "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", r6("total").alias("total")), "complete",
          f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, {s6('sum(value)')} AS total FROM events GROUP BY ALL")


def stm_bounded_queue(s, d):
    at = _scratch(s)
    stream = Q.bounded_queue(_events(s, d).select("user_id", "event_id"), "user_id", "event_id", 16)
    out = Q.replay(stream, f"{at}/out", f"{at}/checkpoint", "update")
    return out.select("user_id", "received", "dropped", F.array_join(F.transform("held", lambda x: x.cast("string")), ",").alias("held"))


QUERIES["stm_bounded_queue"] = stm_bounded_queue
SQL["stm_bounded_queue"] = """SELECT user_id, count(*) AS received, greatest(count(*) - 16, 0) AS dropped, array_to_string(list(event_id ORDER BY event_id)[greatest(len(list(event_id)) - 16, 0) + 1:], ',') AS held FROM events GROUP BY user_id"""


def stm_resumable(s, d):
    at = _scratch(s)
    return Q.replay(Q.resumable(_events(s, d).select("user_id", "event_type"), "user_id", "event_type"), f"{at}/out", f"{at}/checkpoint")


QUERIES["stm_resumable"] = stm_resumable
SQL["stm_resumable"] = "SELECT DISTINCT user_id, event_type FROM events"


def stm_drained(s, d):
    at = _scratch(s)
    return Q.drained(_events(s, d), f"{at}/out", f"{at}/checkpoint", F.col("value") > 20).agg(F.sum("generated").alias("generated"), F.sum("dropped").alias("dropped"))


QUERIES["stm_drained"] = stm_drained
SQL["stm_drained"] = "SELECT count(*) FILTER (value > 20) AS generated, count(*) FILTER (value <= 20 OR value IS NULL) AS dropped FROM events"


def stm_metric_state(s, d):
    at = _scratch(s)
    steps = _events(s, d).select("user_id", F.floor(F.col("event_id") / 500).alias("version"), F.col("event_id").alias("step"), "value", (F.col("event_id") % 3 + 1).alias("samples"))
    out = Q.replay(Q.metric_state(steps, "user_id"), f"{at}/out", f"{at}/checkpoint")
    return out.select("user_id", "version", "steps", "samples", *[r6(c).alias(c) for c in ("mean", "last", "total")])


QUERIES["stm_metric_state"] = stm_metric_state
SQL["stm_metric_state"] = f"""WITH v AS (SELECT user_id, event_id // 500 AS version, count(*) AS steps, CAST(sum(event_id % 3 + 1) AS BIGINT) AS samples, {s6("sum(value * (event_id % 3 + 1)) / sum(event_id % 3 + 1)")} AS mean,
{s6("max_by(value, event_id)")} AS last, {s6("sum(value)")} AS total FROM events GROUP BY ALL)
SELECT * FROM v QUALIFY version < max(version) OVER (PARTITION BY user_id)"""
