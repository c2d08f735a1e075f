"""Streaming forms: windowed counts with late data, stateful matching of opens and closes, incremental backfill."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and kind; events later than the watermark are left out."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), kind, "n")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n"))
    return s.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_deliveries(rows: DataFrame, key: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: state is bounded by it."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


MATCHED = "page_id bigint, open_id bigint, open_s bigint, close_id bigint, close_s bigint, outcome string"


def match_opens(events: DataFrame, stale_after_s: int) -> DataFrame:
    """Opens matched with the first later close of their page as both arrive: (page_id, open_id, open_s, close_id, close_s, outcome).

    events: page_id, kind (open or close), id, t in seconds, ts as event time with a watermark set by the caller. State per page
    holds unmatched opens, and closes until the watermark passes them, as an open that is still to come may be earlier. An open gets
    the first later close known when both are there; one the watermark has passed by `stale_after_s` is given out as stale.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, ts, close_ids, close_ts = state.get if state.exists else ([], [], [], [])
        opens, closes = list(zip(ts, ids)), set(zip(close_ts, close_ids))
        for b in batches:
            for kind, i, t in zip(b["kind"], b["id"], b["t"]):
                if kind == "open":
                    opens.append((int(t), int(i)))
                else:
                    closes.add((int(t), int(i)))
        mark = state.getCurrentWatermarkMs() // 1000
        order = sorted(closes)
        times = [t for t, _ in order]
        out, left = [], []
        for t, i in sorted(opens):
            at = bisect_right(times, t)
            if at < len(order):
                out.append((key[0], i, t, order[at][1], order[at][0], "closed"))
            elif mark and t + stale_after_s <= mark:
                out.append((key[0], i, t, None, None, "stale"))
            else:
                left.append((t, i))
        kept = [(t, i) for t, i in order if t > mark]
        if left or kept:
            state.update(([i for _, i in left], [t for t, _ in left], [i for _, i in kept], [t for t, _ in kept]))
            due = [left[0][0] + stale_after_s] if left else []
            due += [kept[-1][0]] if kept else []
            state.setTimeoutTimestamp(max(mark * 1000 + 1, min(due) * 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["page_id", "open_id", "open_s", "close_id", "close_s", "outcome"]).astype({"close_id": "Int64", "close_s": "Int64"})

    held = "ids array<bigint>, ts array<bigint>, close_ids array<bigint>, close_ts array<bigint>"
    return events.groupBy("page_id").applyInPandasWithState(step, MATCHED, held, "append", GroupStateTimeout.EventTimeTimeout)


def backfill(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform=lambda df: df, files: int = 100) -> None:
    """Takes the files not yet taken, in bounded batches, and stops; the checkpoint remembers them, so reruns add nothing twice."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    transform(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
