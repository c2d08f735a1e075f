"""Problem 6: references to records that do not exist.

Keys are range-partitioned by their 64-bit hash, which spreads evenly whatever the keys are. The parents of a range form
sorted arrays; batches of references probe them by binary search, keys are compared in full so that equal hashes of
different keys do no harm, and misses come out with the years in which the target does exist.
Ranges are as many as both sides need. A target that draws very many references is split by salt into cells of its own,
and only the parents of such targets are repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.functions.text import page_title
from tideloom.session import materialise, parallelism

#: Rows of both sides a range is meant for; a range of more references than HEAVY is searched for targets of more than HOT.
ROWS_PER_RANGE, HEAVY, HOT = 50_000, 200_000, 50_000

OUT = "wiki string, year smallint, from_page bigint, to_ns int, to_title string, kind string"


def _key(*parts) -> F.Column:
    return F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])


def parent_keys(nodes: DataFrame) -> DataFrame:
    """(key, years): every page under its id and under its title, with the sorted years that hold it. The latest row of a key holds."""
    rows = nodes.where("wiki IS NOT NULL AND page_id IS NOT NULL AND year IS NOT NULL")
    pick = F.struct(F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), "title", "namespace")
    held = rows.groupBy("wiki", "page_id", "year").agg(F.max(pick).alias("r")).select("wiki", "page_id", "year", page_title(F.col("r.title")).alias("title"), F.col("r.namespace").alias("ns"))
    names = F.array(
        _key(F.col("wiki"), F.lit("p"), F.col("page_id")),
        F.when(F.col("title").isNotNull() & F.col("ns").isNotNull(), _key(F.col("wiki"), F.lit("t"), F.col("ns"), F.col("title"))),
    )
    keys = held.select("year", F.explode(names).alias("key")).where("key IS NOT NULL")
    return keys.groupBy("key").agg(F.sort_array(F.collect_set("year")).alias("years"))  # years per key are bounded by smallint


def reference_keys(links: DataFrame) -> DataFrame:
    """Distinct links that claim an admitted target, with the key of that target."""
    rows = links.where("to_admitted").select("wiki", "year", "from_page", "to_ns", "to_title", "to_page").distinct()
    by_page = _key(F.col("wiki"), F.lit("p"), F.col("to_page"))
    by_title = _key(F.col("wiki"), F.lit("t"), F.col("to_ns"), page_title(F.col("to_title")))
    return rows.withColumn("key", F.when(F.col("to_page").isNotNull(), by_page).otherwise(by_title)).drop("to_page")


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    empty = pa.schema([("wiki", pa.string()), ("year", pa.int16()), ("from_page", pa.int64()), ("to_ns", pa.int32()), ("to_title", pa.string()), ("kind", pa.string())])
    n, m = refs.num_rows, parents.num_rows
    if not n:
        return empty.empty_table()
    later = earlier = held = np.zeros(n, bool)
    year = refs["year"].fill_null(0).to_numpy().astype(np.int64)
    if m:
        order = np.argsort(parents["h"].to_numpy(), kind="stable")
        h = parents["h"].to_numpy()[order]
        keys = parents["key"].combine_chunks().take(pa.array(order))
        years = parents["years"].combine_chunks().take(pa.array(order))
        flat = years.flatten().to_numpy().astype(np.int64)
        off = np.concatenate([[0], np.cumsum(pc.list_value_length(years).to_numpy())])
        rh, rkey = refs["h"].to_numpy(), refs["key"].combine_chunks()
        pos = np.searchsorted(h, rh)
        found = np.zeros(n, bool)
        open_ = np.flatnonzero((pos < m) & (h[np.minimum(pos, m - 1)] == rh))
        while len(open_):  # one round, more only where different keys share a hash
            same = pc.equal(keys.take(pa.array(pos[open_])), rkey.take(pa.array(open_))).to_numpy(zero_copy_only=False)
            found[open_[same]] = True
            rest = open_[~same]
            pos[rest] += 1
            open_ = rest[(pos[rest] < m) & (h[np.minimum(pos[rest], m - 1)] == rh[rest])]
        known = np.flatnonzero(found & refs["year"].is_valid().to_numpy())
        at = pos[known]
        # years of all keys in one ascending array: key position times 2^17 plus year
        ladder = np.repeat(np.arange(m), np.diff(off)) * 131072 + flat + 32768
        lo = np.searchsorted(ladder, at * 131072 + year[known] + 32768)
        later, earlier, held = later.copy(), earlier.copy(), held.copy()
        held[known] = (lo < len(flat)) & (ladder[np.minimum(lo, len(flat) - 1)] == at * 131072 + year[known] + 32768)
        later[known] = lo + held[known] < off[at + 1]
        earlier[known] = lo > off[at]
    miss = pa.array(np.flatnonzero(~held))
    kind = np.where(later, "later", np.where(earlier, "deleted", "missing"))
    out = refs.select(["wiki", "year", "from_page", "to_ns", "to_title"]).take(miss)
    return out.append_column("kind", pa.array(kind[miss.to_numpy()], pa.string())).cast(empty)


def spread(refs: DataFrame, parents: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with hash h, range rid and salt: 0, but for hot targets 1 up to as many as their references need."""
    cell = lambda df: df.withColumn("h", F.xxhash64("key")).withColumn("rid", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * ranges).cast("bigint"))
    refs, parents = cell(refs), cell(parents)
    heavy = refs.groupBy("rid").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("rid")
    if heavy.isEmpty():
        return refs.withColumn("salt", F.lit(0)), parents.withColumn("salt", F.lit(0))
    # written, so that their measured size decides how they are joined
    hot = refs.join(heavy, "rid", "left_semi").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = materialise(hot.select("h", F.ceil(F.col("n") / HOT).cast("int").alias("salts")), "hot-targets")
    part = F.pmod(F.xxhash64("from_page", "year", "to_title"), F.col("salts")).cast("int") + 1
    left = refs.join(hot, "h", "left").withColumn("salt", F.coalesce(part, F.lit(0))).drop("salts")
    right = parents.join(hot, "h", "left").withColumn("salt", F.explode(F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("salts"))))).drop("salts")
    return left, right


def orphan_references(links: DataFrame, nodes: DataFrame, ranges: int | None = None) -> DataFrame:
    """Distinct (wiki, year, from_page, to_ns, to_title, kind) of links with to_admitted whose target isn't there in that wiki and year.

    A link without year, or naming no target at all, is missing. Null to_admitted claims nothing. Repeated links count once.
    """
    refs = materialise(reference_keys(links), "references")
    if ranges is None:  # several ranges a task, and more as either side grows; a node has two keys at most
        ranges = max(4 * parallelism(links.sparkSession), (refs.count() + 2 * nodes.count()) // ROWS_PER_RANGE)
    left, right = spread(refs, parent_keys(nodes), ranges)
    found = left.groupBy("rid", "salt").cogroup(right.groupBy("rid", "salt")).applyInArrow(_probe, OUT)
    return found.distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Misses per wiki, year and kind."""
    return orphans.groupBy("wiki", "year", "kind").agg(F.count("*").alias("n_orphans"), F.countDistinct("from_page").alias("n_pages"))
