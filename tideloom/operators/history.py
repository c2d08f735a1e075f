"""Edit-history analytics: volumes, spans, rates, quantiles, event matching and participation windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.session import materialise


def first_seen_volume(df: DataFrame, entity: str, ts: str) -> DataFrame:
    """Per month of first appearance: new entities and all their events. One shuffle by entity, one tiny one by month."""
    per = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(ts).alias("first_ts"), F.count("*").alias("n"))
    return per.groupBy(F.date_format("first_ts", "yyyyMM").alias("ym")).agg(F.count("*").alias("new_entities"), F.sum("n").alias("n_events"), F.max("n").alias("most_events"))


def spans(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def conditional_counts(df: DataFrame, keys: list[str], flag: Column, distinct: str) -> DataFrame:
    """Rows, distinct values, flagged rows and their rate per group."""
    n, hit = F.count("*"), F.sum(F.when(flag, 1).otherwise(0))
    return df.groupBy(*keys).agg(n.alias("n"), F.count_distinct(distinct).alias("n_distinct"), hit.alias("n_flagged"), F.round(hit / n, 3).alias("rate"))


def quantile_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact quartiles (linear interpolation), mean and count. For groups too large to hold, use quantile_sketch."""
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 4)
    return df.groupBy(*keys).agg(q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.round(F.avg(value), 4).alias("mean"), F.count(value).alias("n"))


def quantile_sketch(df: DataFrame, keys: list[str], value: str, accuracy: int = 10000) -> DataFrame:
    """Quartiles by mergeable sketches: memory per group is bounded, error at most 1 / accuracy of the rank."""
    return df.groupBy(*keys).agg(F.percentile_approx(value, [0.25, 0.5, 0.75], accuracy).alias("quartiles"), F.count(value).alias("n"))


def describe_numbers(df: DataFrame, value: str) -> DataFrame:
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 4)
    return df.agg(
        F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("std"), F.min(value).alias("lowest"),
        q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.max(value).alias("highest"),
    )


def pivot_mean(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Rows x columns of means, missing cells 0. The columns are named, so no pass is spent on finding them."""
    out = df.groupBy(row).pivot(column, columns).agg(F.avg(value))
    return out.select(row, *[F.round(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)), 6).alias(f"c_{c}") for c in columns])


def without(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed: an anti-join, so that null keys stay."""
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def tag_flag(df: DataFrame, tags: DataFrame, key: str, tag: str, wanted: str, faithful: bool) -> DataFrame:
    """Marks rows that carry a tag. Faithful: as two outer joins do, a row comes out once for each of its tags; else once."""
    if faithful:
        return df.join(tags.select(key, tag), key, "left").withColumn("flag", F.coalesce(F.col(tag) == wanted, F.lit(False))).drop(tag)
    hit = tags.where(F.col(tag) == wanted).select(key).distinct().withColumn("flag", F.lit(True))
    return df.join(hit, key, "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


def next_event(left: DataFrame, right: DataFrame, entity: str, left_id: str, left_t: str, right_id: str, right_t: str, cell: int = 30 * 86_400) -> DataFrame:
    """Each left row with the first right row of its entity strictly after it, if any: (left_id, left_t, right_id, right_t).

    Times are whole seconds. Both sides are cut into (entity, time cell); an ordered pass in each cell finds the next right
    row, and rows without one in their cell take the first of the next occupied cell, looked up in a summary with one row per
    cell. No pairs are formed, and a hot entity spreads over its cells. Equal right times: the smaller id.
    Left rows with a null entity or time have no partner; right ones are no candidates.
    """
    lhs = left.select(F.col(left_id).alias("lid"), F.col(entity).alias("e"), F.col(left_t).cast("long").alias("t"))
    rhs = right.select(F.col(right_id).alias("rid"), F.col(entity).alias("e"), F.col(right_t).cast("long").alias("t")).dropna()
    c = F.floor(F.col("t") / cell).alias("c")
    rhs = rhs.groupBy("e", "t").agg(F.min("rid").alias("rid"))
    target = F.struct("t", "rid")
    both = lhs.select("e", "t", c, "lid", F.lit(None).cast("struct<t:bigint,rid:bigint>").alias("hit"), F.lit(1).alias("side")).unionByName(
        rhs.select("e", "t", c, F.lit(None).cast("long").alias("lid"), target.alias("hit"), F.lit(0).alias("side"))
    )
    # descending order: the last right row seen before a left row is the next one in time; at equal times the right row comes after
    down = Window.partitionBy("e", "c").orderBy(F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("hit", F.last("hit", ignorenulls=True).over(down)).where("side = 1")
    cells = rhs.select("e", c, "t", "rid").groupBy("e", "c").agg(F.min(target).alias("first"))
    marks = cells.select("e", "c", "first", F.lit(0).alias("side")).unionByName(inside.select("e", "c", F.lit(None).cast("struct<t:bigint,rid:bigint>").alias("first"), F.lit(1).alias("side")).distinct())
    later = Window.partitionBy("e").orderBy(F.desc("c"), F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = marks.withColumn("next", F.last("first", ignorenulls=True).over(later)).where("side = 1").select("e", "c", "next")
    out = inside.join(beyond, (inside.e.eqNullSafe(beyond.e)) & (inside.c.eqNullSafe(beyond.c)), "left").select("lid", "t", F.when(inside.e.isNotNull(), F.coalesce("hit", "next")).alias("hit"))
    return out.select(F.col("lid").alias(left_id), F.col("t").alias(left_t), F.col("hit.rid").alias(right_id), F.col("hit.t").alias(right_t))


def first_outcome(left: DataFrame, first: DataFrame, second: DataFrame, entity: str, left_id: str, left_t: str, right_id: str, right_t: str, names: tuple[str, str, str] = ("closed", "stale", "open")) -> DataFrame:
    """(left_id, left_t, right_id, right_t, outcome): the next event of `first`, whenever it is; only without one the next of `second`; else neither."""
    a = next_event(left, first, entity, left_id, left_t, right_id, right_t)
    b = next_event(left, second, entity, left_id, left_t, right_id, right_t).select(left_id, F.col(left_t).alias("_t"), F.struct(right_id, right_t).alias("_b"))
    both = a.join(b, (a[left_id] == b[left_id]) & a[left_t].eqNullSafe(b["_t"]), "left").drop(b[left_id])
    hit = F.when(F.col(right_t).isNotNull(), F.struct(right_id, right_t)).otherwise(F.col("_b"))
    outcome = F.when(F.col(right_t).isNotNull(), names[0]).when(F.col(f"_b.{right_t}").isNotNull(), names[1]).otherwise(names[2])
    return both.select(left_id, left_t, hit.alias("_h"), outcome.alias("outcome")).select(left_id, left_t, f"_h.{right_id}", f"_h.{right_t}", "outcome")


def paced(df: DataFrame, host: str, at: str, delay: str, order: str) -> DataFrame:
    """When each request of a host may go: not before it is wanted, nor sooner than the host's delay after the one before.

    The k-th start is the greatest of wanted(j) + (k - j) * delay over j up to k, so a running maximum does it. One ordered pass
    a host: its requests are one queue.
    """
    w = Window.partitionBy(host).orderBy(at, order)
    k = F.row_number().over(w) - 1
    shifted = df.withColumn("_k", k).withColumn("_x", F.col(at) - F.col("_k") * F.col(delay))
    return shifted.withColumn("start", F.max("_x").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_k") * F.col(delay)).drop("_k", "_x")


def in_windows(windows: DataFrame, events: DataFrame, window_id: str, entity: str, start: str, end: str, ts: str, cell: int = 30 * 86_400) -> DataFrame:
    """Windows (alias w) left-joined with the events (alias e) of their entity within them, both ends included; a null end is open.

    Both sides are cut into time cells: a window enters each cell it touches, up to the last event, and meets only the events
    of that cell, so a busy entity is spread over its cells and the range check is never run on all its pairs.
    Windows with a null id, entity or start have no events. Events with a null entity or time lie in no window.
    """
    e = events.where(F.col(entity).isNotNull() & F.col(ts).isNotNull())
    last = e.agg(F.max(ts)).first()[0]
    row = F.struct(*events.columns).alias("_row")
    if last is None:
        found = e.select(F.lit(None).cast(windows.schema[window_id].dataType).alias("_id"), row)
    else:
        until = F.least(F.coalesce(F.col(end), F.lit(last)), F.lit(last))
        spans = windows.where(F.col(window_id).isNotNull() & F.col(entity).isNotNull() & (F.col(start) <= until)).select(F.col(window_id).alias("_id"), F.col(entity).alias("_e"), F.col(start).alias("_a"), until.alias("_b"))
        spans = spans.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_a") / cell), F.floor(F.col("_b") / cell))))
        dots = e.select(F.col(entity).alias("_e"), F.floor(F.col(ts) / cell).alias("_c"), F.col(ts).alias("_t"), row)
        found = spans.join(dots, ["_e", "_c"]).where("_t >= _a AND _t <= _b").select("_id", "_row")
    inside = found.select("_id", "_row.*").alias("e")
    return windows.alias("w").join(inside, F.col(f"w.{window_id}") == F.col("e._id"), "left")


def as_of(left: DataFrame, right: DataFrame, entity: str, at: str, ts: str, value: str, cell: int = 365 * 86_400) -> DataFrame:
    """left with as_of_value: the value of the latest right row of its entity not later than `at`, null if there is none.

    Times are timestamps or seconds. Both sides are cut into (entity, time cell): an ordered pass in a cell, and before it the last
    value of the cells that came earlier, so a busy entity is spread over its cells. Right rows without a value don't count;
    equal times: the greater value.
    """
    c = lambda t: F.floor(F.col(t).cast("timestamp").cast("double") / cell)
    kind = right.schema[value].dataType
    facts = right.where(F.col(entity).isNotNull() & F.col(value).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(entity).alias("_e"), F.col(ts).alias("_t")).agg(F.max(value).alias("_v")).withColumn("_c", c("_t"))
    row = F.struct(*left.columns)
    asked = left.select(F.col(entity).alias("_e"), F.col(at).alias("_t"), c(at).alias("_c"), row.alias("_row"), F.lit(None).cast(kind).alias("_v"), F.lit(1).alias("_s"))
    both = asked.unionByName(facts.select("_e", "_t", "_c", "_v", F.lit(0).alias("_s")), allowMissingColumns=True)
    inside = Window.partitionBy("_e", "_c").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).where("_s = 1")
    marks = facts.groupBy("_e", "_c").agg(F.max_by("_v", "_t").alias("_last")).unionByName(here.select("_e", "_c").distinct(), allowMissingColumns=True).groupBy("_e", "_c").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy("_e").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    before = marks.select(F.col("_e").alias("_be"), F.col("_c").alias("_bc"), F.last("_last", ignorenulls=True).over(earlier).alias("_before")).where("_before IS NOT NULL")
    out = here.join(before, (F.col("_e") == F.col("_be")) & (F.col("_c") == F.col("_bc")), "left")
    return out.select("_row.*", F.coalesce("_v", "_before").alias("as_of_value"))


def month_spine(spark, first: str, last: str) -> DataFrame:
    """Months from first up to, not including, last."""
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}' - INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS month")


def islands(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Consecutive runs of an equal value (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(order)
    flag = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    run = df.withColumn("_new", flag).withColumn("run_no", F.sum("_new").over(w))
    return run.groupBy(*keys, "run_no", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def quintile(df: DataFrame, keys: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """Bucket min(4, floor(rank * 5 / n)); unlike ntile the remainder goes to the last rows. Rows are cut into ranges of the whole
    order first, so a large group is ranked by many tasks; the sizes of (group, range) give the offsets."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = materialise(df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = r.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    before = sizes.select(*keys, "_p", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    ranked = r.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order)) - 1).join(before, [*keys, "_p"])
    return ranked.withColumn("quintile", F.least(F.lit(4), F.floor((F.col("_before") + F.col("_r")) * 5 / F.col("_all"))).cast("int")).drop("_p", "_r", "_before", "_all")
