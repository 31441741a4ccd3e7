"""Usage limits on a stream of requests: each is accepted or refused when it comes.

State is one small row per user: how much of the limit the two latest months have used.  The first
request of a further month lets the older of them go.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Months that a user's state holds.
MONTHS_HELD = 2


def decide(pages: Iterator[pd.DataFrame], used: dict[int, int], limit: int) -> Iterator[pd.DataFrame]:
    """Decisions for one user's new requests; ``used`` (by month number) is brought up to date.

    A month's first requests in the order of (at, event) are accepted as far as the limit goes.  Only
    those still in question are held, at most ``limit`` per month, and a request that others push out
    is refused at once; so a user with very many requests needs no more memory than others.
    """
    # Rows without a time have month -1.
    oldest = max(max(used, default=0) - MONTHS_HELD + 1, 0)
    held: dict[int, list] = {}

    class Last(tuple):
        """Orders a heap by the last request."""

        def __lt__(self, other):
            return tuple.__gt__(self, other)

    for page in pages:
        out = []
        for user, event, at, month in page.itertuples(index=False):
            if month < oldest:
                out.append((user, event, at, None, "late"))
                continue
            heap = held.setdefault(month, [])
            heapq.heappush(heap, Last((at, event, user)))
            if used.get(month, 0) + len(heap) > limit:
                at, event, user = heapq.heappop(heap)
                out.append((user, event, at, limit, "refused"))
        yield pd.DataFrame(out, columns=COLUMNS)
    for month, heap in held.items():
        before = used.get(month, 0)
        yield pd.DataFrame([(user, event, at, before + k, "accepted") for k, (at, event, user) in enumerate(sorted(heap, key=tuple), 1)],
                           columns=COLUMNS)
        used[month] = before + len(heap)
    for month in sorted(used)[:-MONTHS_HELD]:
        del used[month]


COLUMNS = ["user", "event", "at", "used_after", "decision"]


def usage_decisions(requests: DataFrame, limit: int, user: str = "user_id", at: str = "ts", event: str = "event_id") -> DataFrame:
    """A stream of ``user``, ``event``, ``at``, ``used_after`` and ``decision`` for a stream of requests.

    "accepted" as long as fewer than ``limit`` requests of the user and month were accepted before, else
    "refused"; ``used_after`` counts the accepted ones.  Requests of one micro-batch are taken in the order of
    (at, event), those of an earlier batch come first.  A request of a month before the two latest ones that the
    user's earlier batches had is "late" and counts nowhere.  Rows without a user are one user; a request
    without a time can't be put into a month and is late; repeated events are requests of their own.
    """
    month = F.coalesce((F.year(at) * 12 + F.month(at) - 1), F.lit(-1)).cast("int")
    rows = requests.select(F.col(user), F.col(event), F.col(at), month.alias("month"))
    kind = {c: rows.schema[c].dataType.simpleString() for c in (user, event, at)}

    def judge(key, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = dict(zip(*state.get)) if state.exists else {}

        def typed(page: pd.DataFrame) -> pd.DataFrame:
            return page.astype({"used_after": "Int32"}).set_axis([user, event, at, "used_after", "decision"], axis=1)

        for page in decide(pages, used, limit):
            if len(page):
                yield typed(page)
        if used:
            state.update((list(used), list(used.values())))

    out = f"`{user}` {kind[user]}, `{event}` {kind[event]}, `{at}` {kind[at]}, used_after int, decision string"
    return rows.groupBy(user).applyInPandasWithState(judge, out, "months array<int>, used array<int>", "append",
                                                     GroupStateTimeout.NoTimeout)


def stream_usage_limit(requests: DataFrame, limit: int, out_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Run over what is there now and append the decisions to a table split by ``decision``, so late requests have a part of their own."""
    writer = usage_decisions(requests, limit, **options).writeStream.outputMode("append").partitionBy("decision")
    return (writer.format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
