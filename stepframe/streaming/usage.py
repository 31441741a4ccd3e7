"""Usage metering on a stream of requests.

A month is too long for a state window, so the stream counts closed days and a month is the
sum of its days when the table is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_usage(requests: DataFrame, user: str = "user_id", at: str = "ts",
                event: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Requests per user and UTC day; repeats of an event inside ``delay`` count once.

    State holds the open days and the events of the last ``delay`` only.
    """
    stamp = F.col(at)
    if requests.schema[at].dataType.typeName() == "timestamp_ntz":
        # A watermark needs an instant: the clock time counts as UTC whatever the session zone.
        stamp = F.from_utc_timestamp(stamp.cast("timestamp"), F.current_timezone())
    stamped = requests.select(user, event, stamp.alias("_at"))
    once = stamped.withWatermark("_at", delay).dropDuplicatesWithinWatermark([event])
    counted = once.groupBy(F.window("_at", "1 day"), user).agg(
        F.count(F.lit(1)).cast("bigint").alias("request_count"))
    day = F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86400).cast("int"))
    return counted.select(user, day.alias("day"), "request_count")


def stream_monthly_usage(requests: DataFrame, out_path: str, checkpoint: str,
                         **options) -> StreamingQuery:
    """Run over what is there now and append the closed days to a parquet table."""
    writer = daily_usage(requests, **options).writeStream.outputMode("append")
    return (writer.format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def months_of(days: DataFrame, user: str = "user_id") -> DataFrame:
    return days.groupBy(user, F.year("day").alias("year"), F.month("day").alias("month")).agg(
        F.sum("request_count").cast("bigint").alias("request_count"))


def months_so_far(requests: DataFrame, days: DataFrame, user: str = "user_id", at: str = "ts",
                  event: str = "event_id") -> DataFrame:
    """Months from the closed days and, counted in batch, the requests of the days that are still open.

    ``requests`` is the table behind the stream; only rows after the last closed day are read.
    """
    day = F.to_date(at)
    last = days.select(F.max("day")).scalar()
    tail = requests.where(last.isNull() | (day > last)).select(user, event, day.alias("day")).dropDuplicates([event])
    still_open = tail.groupBy(user, "day").agg(F.count(F.lit(1)).cast("bigint").alias("request_count"))
    return months_of(days.select(user, "day", "request_count").unionByName(still_open), user)
