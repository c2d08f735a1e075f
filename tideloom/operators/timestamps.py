"""Problem 3: records whose raw timestamp denotes exactly one UTC instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.functions.timestamps import iso_utc, with_instant


def normalise_instants(df: DataFrame, key: str, value: str, zone: str, order: str = "CAST(NULL AS STRING)", bare_dates: bool = False) -> DataFrame:
    """Per delivered row: (rec_id, utc_s, status); see functions.timestamps.with_instant for the policies.

    Rows without a key are left out, as they name no record. Extra columns are ignored.
    """
    rows = df.where(F.col(key).isNotNull()).selectExpr(f"{key} AS rec_id", f"{value} AS _value", f"{zone} AS _zone", f"{order} AS _date_order")
    return with_instant(rows, "_value", "_zone", "_date_order", bare_dates).select("rec_id", "utc_s", "status")


def one_instant_per_record(rows: DataFrame) -> DataFrame:
    """(rec_id, utc_s) of the records all of whose determined deliveries agree on the second.

    Repeated rows count once; a record delivered with two different instants is undetermined and gives no row.
    """
    agreed = rows.where("utc_s IS NOT NULL").groupBy("rec_id").agg(F.min("utc_s").alias("utc_s"), F.max("utc_s").alias("last"))
    return agreed.where("utc_s = last").select("rec_id", "utc_s")


def feed_instants(opens: DataFrame, feeds: DataFrame) -> DataFrame:
    """Instants of rfc_opens by the clock and date order of the delivering feed (rows of an unknown feed need a stated zone)."""
    dim = feeds.where("feed IS NOT NULL").groupBy(F.col("feed").alias("_feed")).agg(F.min("tz_name").alias("_tz"), F.min("date_order").alias("_order"))
    rows = opens.select("open_rev_id", "open_ts", "feed").join(dim, F.col("feed") == F.col("_feed"), "left")
    return one_instant_per_record(normalise_instants(rows, "open_rev_id", "open_ts", "_tz", "_order"))


def archive_instants(figures: DataFrame) -> DataFrame:
    """Instants of mail dates; an archive without zone ran on UTC."""
    return one_instant_per_record(normalise_instants(figures, "fig_id", "email_date", "coalesce(archive_tz, 'UTC')"))


def venue_instants(editions: DataFrame) -> DataFrame:
    """Instants of conference starts on the venue's clock; a bare date means midnight there."""
    return one_instant_per_record(normalise_instants(editions, "edition_id", "conference_start", "tz_name", bare_dates=True))


def utc_report(opens: DataFrame, feeds: DataFrame, figures: DataFrame, editions: DataFrame) -> DataFrame:
    """(src, rec_id, utc) over the three sources."""
    parts = [("rfc_opens", feed_instants(opens, feeds)), ("wikimania_2017", archive_instants(figures)), ("edition_index", venue_instants(editions))]
    out = None
    for src, df in parts:
        one = df.select(F.lit(src).alias("src"), F.col("rec_id").cast("long").alias("rec_id"), iso_utc(F.col("utc_s")).alias("utc"))
        out = one if out is None else out.unionByName(one)
    return out
