"""Problem 2: what changed between full snapshots delivered per site and year.

A bucketed key-to-hash index of each site's last snapshot is kept in the shared folder, one generation a delivery, its hash
column beside the values. The rows of the next snapshot, bucketed alike, probe it without a shuffle; values are compared by a
64-bit hash of their canonical form, old values are fetched only for changed keys, and then the index of the delivering sites
is swapped: their generation of the new year takes the place of the last one, others keep theirs. Nothing is copied for it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.text import nfc
from tideloom.session import delete_path, materialise, scratch_path

#: Rows of all deliveries a bucket is meant for; Spark allows no more than 100,000 buckets.
ROWS_PER_BUCKET, MOST_BUCKETS = 100_000, 50_000
COMPARED = ("title", "namespace", "is_redirect", "wikidata_qid", "confidence", "admitted_via", "status_tier")


def canonical(df: DataFrame, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """The compared columns as strings in canonical notation; blank and null are one value."""
    out = {c: F.col(c).cast("string") for c in compared}
    if "title" in out:
        out["title"] = F.replace(nfc(F.col("title")), F.lit(" "), F.lit("_"))
    if "status_tier" in out:
        out["status_tier"] = F.lower(F.trim("status_tier"))
    return df.withColumns({c: F.when(F.trim(F.replace(v, F.lit("_"), F.lit(" "))) != "", v) for c, v in out.items()})


class SnapshotIndex:
    """Generations of the index on disk; `advance` takes one delivery, yields its changes and swaps the generations of its sites."""

    def __init__(self, df: DataFrame, compared: tuple[str, ...] = COMPARED):
        self.spark, self.compared = df.sparkSession, compared
        self.root = scratch_path(self.spark, "snapshots")
        self.name = f"tideloom_staged_{uuid.uuid4().hex[:12]}"
        self._stage(df)
        order = Window.partitionBy("wiki").orderBy("year")
        # any row of a site in a year is a delivery, be its key usable or not
        delivered = df.select("wiki", F.col("year").cast("int").alias("year")).dropna().distinct()
        # one row per site and delivery, joined by its measured size: seen is the generation a site's index stands at when the delivery comes
        self.deliveries = materialise(delivered.select("wiki", "year", F.lag("year").over(order).alias("seen")), "deliveries")

    def _stage(self, df: DataFrame) -> None:
        """Clean all deliveries once: the latest row of each key, its canonical values and their hash, laid out by year and bucket."""
        rows = df.select("wiki", "page_id", "year", "loaded_at", *self.compared).where("wiki IS NOT NULL AND page_id IS NOT NULL AND year IS NOT NULL")
        rows = canonical(rows, self.compared)
        values = F.struct(*self.compared)
        # equal load times: the greater values win, so that the choice doesn't depend on the order of rows
        last = rows.groupBy("wiki", "page_id", "year").agg(F.max_by(values, F.struct(F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), values.alias("v"))).alias("v"))
        hashed = F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(f"v.{c}")), F.lit("-")) for c in self.compared])
        staged = last.select("wiki", "page_id", hashed.alias("h"), *[F.col(f"v.{c}").alias(c) for c in self.compared], "year")
        buckets = min(MOST_BUCKETS, df.count() // ROWS_PER_BUCKET + 1)
        w = staged.repartition(buckets, "wiki", "page_id").write.option("path", f"{self.root}/{self.name}").bucketBy(buckets, "wiki", "page_id").partitionBy("year")
        w.saveAsTable(self.name)

    def years(self) -> dict[int, list[int]]:
        """Delivered years with the generations their sites stand at: bounded numbers (a smallint each)."""
        return {r.year: r.seen for r in self.deliveries.groupBy("year").agg(F.collect_set("seen").alias("seen")).orderBy("year").collect()}

    def advance(self, year: int, seen: list[int]) -> DataFrame | None:
        """(wiki, page_id, year, change, seen) of the sites that deliver in the year and have delivered before; null if none has."""
        if not seen:
            return None
        index = self.spark.table(self.name).select("wiki", "page_id", "h", F.col("year").cast("int").alias("seen"), "year")
        sites = self.deliveries.where((F.col("year") == year) & F.col("seen").isNotNull()).select("wiki", "seen")
        new = index.where(F.col("year") == year).drop("seen", "year").withColumnRenamed("h", "new_h").join(sites.select("wiki"), "wiki", "left_semi")
        old = index.where(F.col("year").isin(seen)).drop("year").withColumnRenamed("h", "old_h").join(sites, ["wiki", "seen"], "left_semi")
        probe = new.join(old, ["wiki", "page_id"], "full_outer")
        kind = F.when(F.col("old_h").isNull(), "added").when(F.col("new_h").isNull(), "removed").when(F.col("new_h") != F.col("old_h"), "changed")
        return probe.select("wiki", "page_id", F.lit(year).cast("smallint").alias("year"), kind.alias("change"), "seen").where("change IS NOT NULL")

    def fetch(self, moved: DataFrame) -> DataFrame:
        """moved with the differing values of its changed keys as an array of (field, old, new): only rows of such keys leave the scan."""
        keys = moved.where("change = 'changed'").select("wiki", "page_id", "year", F.explode(F.array(F.struct(F.col("year").cast("int").alias("at"), F.lit(True).alias("new")), F.struct(F.col("seen").alias("at"), F.lit(False).alias("new")))).alias("x"))
        keys = keys.select("wiki", "page_id", "year", "x.at", "x.new")
        values = self.spark.table(self.name).select("wiki", "page_id", F.col("year").cast("int").alias("at"), F.struct(*self.compared).alias("v"))
        side = lambda new: F.max(F.when(F.col("new") == new, F.col("v")))
        pairs = values.join(keys, ["wiki", "page_id", "at"]).groupBy("wiki", "page_id", "year").agg(side(False).alias("o"), side(True).alias("n"))
        each = [F.struct(F.lit(c).alias("field"), F.col(f"o.{c}").alias("old"), F.col(f"n.{c}").alias("new")) for c in self.compared]
        diffs = pairs.select("wiki", "page_id", "year", F.filter(F.array(*each), lambda x: ~x.old.eqNullSafe(x.new)).alias("diffs"))
        return moved.join(diffs, ["wiki", "page_id", "year"], "left")

    def run(self, with_values: bool = False) -> DataFrame:
        """All deliveries in turn. The probes of the years stand in one job, as each only reads the generations it needs."""
        steps = [d for year, seen in self.years().items() if (d := self.advance(year, seen)) is not None]
        moved = self.spark.createDataFrame([], "wiki string, page_id bigint, year smallint, change string, seen int")
        for step in steps:
            moved = moved.unionByName(step)
        moved = materialise(moved, "changes")
        out = materialise(self.fetch(moved), "changed-values") if with_values else moved
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.root)
        return out.drop("seen")


def snapshot_changes(df: DataFrame, compared: tuple[str, ...] = COMPARED, with_values: bool = False) -> DataFrame:
    """(wiki, page_id, year, change[, diffs]) between consecutive delivered years of each wiki.

    Rows lacking a wiki, page id or year name no record and are left out; a wiki's first delivery yields nothing; a null
    load time counts as the oldest. Empty tables give an empty result; extra columns are ignored.
    """
    return SnapshotIndex(df, compared).run(with_values)
