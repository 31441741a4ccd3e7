"""Structured Streaming twins of the usage counters and status updates."""

from stepframe.streaming.limits import stream_usage_limit, usage_decisions
from stepframe.streaming.status import keyed_table, status_now, store_changes, stream_status_upsert
from stepframe.streaming.usage import daily_usage, months_of, months_so_far, stream_monthly_usage

__all__ = ["keyed_table", "status_now", "store_changes", "stream_status_upsert", "daily_usage", "months_of", "months_so_far",
           "stream_monthly_usage", "stream_usage_limit", "usage_decisions"]
