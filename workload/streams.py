"""Streaming twins, run to completion over the files that are there."""

from __future__ import annotations

from stepframe.session import scratch_path
from stepframe.streaming import keyed_table, months_so_far, status_now, stream_monthly_usage, stream_status_upsert, stream_usage_limit
from workload.loads import CHANGE_ORDER, UPSERT_SQL, change_log, task_table
from workload.registry import query


def stream_of(t, table: str):
    """The table's file as a stream."""
    reader = t.spark.readStream.schema(getattr(t, table).schema)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(t.folder)


@query("stream_monthly_usage", """
SELECT user_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, COUNT(*) AS request_count
FROM events
GROUP BY user_id, year(ts), month(ts)""")
def usage(t):
    """Days that the watermark has passed and those still open, summed to months."""
    out = scratch_path(t.spark, "usage-days")
    run = stream_monthly_usage(stream_of(t, "events"), out, scratch_path(t.spark, "usage-state"))
    run.awaitTermination()
    days = t.spark.read.schema("user_id bigint, day date, request_count bigint").parquet(out)
    return months_so_far(t.events, days)


@query("stream_status_upsert", UPSERT_SQL)
def status(t):
    fields, buckets, changes = ["status", "target_code"], 8, scratch_path(t.spark, "status-changes")
    path = scratch_path(t.spark, "status_base")
    base = keyed_table(task_table(t), path.rsplit("/", 1)[1].replace("-", "_"), "id", buckets, path)
    run = stream_status_upsert(change_log(stream_of(t, "lineitem")), changes, "id", fields, scratch_path(t.spark, "status-state"),
                               CHANGE_ORDER, ["status"], "target_code", "l_shipdate")
    run.awaitTermination()
    return status_now(base, changes, "id", fields, buckets=buckets)


@query("stream_usage_limit", """
SELECT event_id, user_id, CASE WHEN rn <= 40 THEN 'accepted' ELSE 'refused' END AS decision,
       CAST(least(rn, 40) AS INTEGER) AS used_after
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, year(ts), month(ts) ORDER BY ts, event_id) AS rn
      FROM events)""")
def usage_limit(t):
    out = scratch_path(t.spark, "usage-decisions")
    run = stream_usage_limit(stream_of(t, "events"), 40, out, scratch_path(t.spark, "limit-state"))
    run.awaitTermination()
    return t.spark.read.parquet(out).select("event_id", "user_id", "decision", "used_after")
