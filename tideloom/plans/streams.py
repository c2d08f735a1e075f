"""Streaming queries, run to the end of the available input; results are read from the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideloom.functions.timestamps import compact_utc, with_instant
from tideloom.session import scratch_path
from tideloom.sources.tables import table as T
from tideloom.streaming import events as E

Q, S = {}, {}


def reg(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def _stream(s, d, name):
    return s.readStream.schema(T(s, d, name).schema).parquet(f"{d.rstrip('/')}/{name}.parquet*")


def _drain(stream, what):
    s = stream.sparkSession
    out = scratch_path(s, what)
    stream.writeStream.format("parquet").option("checkpointLocation", scratch_path(s, what + "-log")).trigger(availableNow=True).start(out).awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


def _drain_whole(stream, what):
    """The complete result at the end of the input: also of groups the watermark hasn't passed."""
    s = stream.sparkSession
    out = scratch_path(s, what)
    s.createDataFrame([], stream.schema).write.mode("overwrite").parquet(out)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", scratch_path(s, what + "-log")).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


@reg("in01_backfill", "SELECT event_id, user_id, event_type FROM events WHERE value > 50")
def _(s, d):
    """Run twice: the second run finds all files taken."""
    out, log = scratch_path(s, "backfill"), scratch_path(s, "backfill-log")
    keep = lambda df: df.where("value > 50").select("event_id", "user_id", "event_type")
    for _ in range(2):
        E.backfill(s, f"{d.rstrip('/')}/events.parquet*", T(s, d, "events").schema, out, log, keep)
    return s.read.schema("event_id bigint, user_id bigint, event_type string").parquet(out)


@reg("in02_first_deliveries", "SELECT DISTINCT event_id FROM events")
def _(s, d):
    rows = _stream(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return _drain(E.first_deliveries(rows, ["event_id"], "ts", "60 days").select("event_id"), "first-deliveries")


@reg("sw01_windowed_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    rows = _stream(s, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _drain_whole(E.windowed_counts(rows, "ts", "event_type", "1 day"), "windowed-counts").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@reg("sw02_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events), h AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM h GROUP BY user_id, k""")
def _(s, d):
    rows = _stream(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _drain_whole(E.sessions(rows, "ts", "user_id", "6 hours"), "sessions").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@reg("in05_stream_match")
def _(s, d):
    kind = lambda df, i, t, k: df.select("page_id", F.lit(k).alias("kind"), F.col(i).alias("id"), t.alias("t"))
    feeds = T(s, d, "ts_feeds").where("feed IS NOT NULL").groupBy(F.col("feed").alias("_feed")).agg(F.min("tz_name").alias("_tz"), F.min("date_order").alias("_order"))
    timely = with_instant(_stream(s, d, "rfc_opens").join(feeds, F.col("feed") == F.col("_feed"), "left"), "open_ts", "_tz", "_order")
    both = kind(timely, "open_rev_id", F.col("utc_s"), "open").unionByName(kind(_stream(s, d, "rfc_human_closes"), "close_rev_id", compact_utc("close_ts"), "close")).where("t IS NOT NULL AND page_id IS NOT NULL")
    timed = both.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", "30 days").dropDuplicatesWithinWatermark(["kind", "id"])
    return _drain(E.match_opens(timed, 365 * 86_400), "stream-match")


QUERIES, ORACLE = Q, S
