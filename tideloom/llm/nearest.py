"""Problem 1: pairing records with the nearest record in time of the same entity.

Right-side times become nearest-neighbour intervals: from the midpoint with the previous time to the midpoint with the
next, cut at the tolerance. The intervals of an entity are disjoint, so a left time lies in one at most. Both sides are
partitioned by (entity, time cell); an interval enters the index of every cell it touches, and within a cell one ordered
pass finds the last interval that starts at or before each left time. Cells that hold more than a 1/HOT_SHARE of all rows are
cut into equal parts by a power of two; at most HOT_SHARE cells can be so full, which bounds the list of them. As intervals
are disjoint, they enter no more parts than there are intervals and parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A cell of more rows than HOT_LEAST and a 1/HOT_SHARE of all is cut, into 2^MOST parts at most (a cell of 60 days into less than five seconds).
HOT_SHARE, HOT_LEAST, MOST = 500, 100_000, 20


def _hot(both: DataFrame, width: int) -> DataFrame:
    """(e, c, parts) of the overfull cells, a table of at most HOT_SHARE rows."""
    cells = both.groupBy("e", F.floor(F.col("t") / width).alias("c")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n")).first()[0] or 0
    most = max(HOT_LEAST, total / HOT_SHARE)
    full = cells.where(F.col("n") > most).limit(HOT_SHARE).collect()
    rows = [(r.e, r.c, 1 << min(MOST, int(r.n / most).bit_length())) for r in full]
    schema = T.StructType([cells.schema["e"], T.StructField("c", T.LongType()), T.StructField("parts", T.LongType())])
    return both.sparkSession.createDataFrame(rows, schema)


def nearest_in_time(left: DataFrame, right: DataFrame, entity: str, left_id: str, left_t: str, right_id: str, right_t: str, tolerance: int) -> DataFrame:
    """(left_id, right_id) of the right record of the same entity nearest in time, at most `tolerance` away.

    Times are whole numbers of one unit (say, seconds). Rows with a null entity, id or time can't match and give no row.
    Repeated rows count once. Equal distances before and after: the earlier record; equal right times: the smaller id.
    One right record may serve many left ones. Extra columns are ignored, whatever their names.
    """
    lhs = left.select(F.col(entity).alias("e"), F.col(left_id).alias("lid"), F.col(left_t).cast("long").alias("t")).dropna().distinct()
    rhs = right.select(F.col(entity).alias("e"), F.col(right_id).alias("rid"), F.col(right_t).cast("long").alias("t")).dropna()
    rhs = rhs.groupBy("e", "t").agg(F.min("rid").alias("rid"))
    width = 2 * max(1, tolerance)
    hot = F.broadcast(_hot(lhs.select("e", "t").unionByName(rhs.select("e", "t")), width))
    part = lambda t: F.floor((t - F.col("c") * width) * F.col("parts") / width)

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("c", F.floor(F.col("t") / width)).join(hot, ["e", "c"], "left").fillna(1, ["parts"])
        return df.withColumn("s", part(F.col("t"))).drop("parts")

    # neighbours: inside the part of a cell by one ordered pass, beyond it from the summary of parts
    rhs = placed(rhs)
    within = Window.partitionBy("e", "c", "s").orderBy("t")
    near = rhs.select("e", "c", "s", "t", "rid", F.lag("t").over(within).alias("p"), F.lead("t").over(within).alias("n"))
    order = Window.partitionBy("e").orderBy("c", "s")
    summary = rhs.groupBy("e", "c", "s").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("e", "c", "s", F.lag("b").over(order).alias("before"), F.lead("a").over(order).alias("after"))
    near = near.join(summary, ["e", "c", "s"]).select("e", "t", "rid", F.coalesce("p", "before").alias("p"), F.coalesce("n", "after").alias("n"))

    # in doubled time midpoints are whole; the point halfway belongs to the earlier record
    lo, hi = F.greatest(2 * (F.col("t") - tolerance), F.col("p") + F.col("t") + 1), F.least(2 * (F.col("t") + tolerance), F.col("t") + F.col("n"))
    down = lambda x: F.floor(F.col(x) / 2)
    spans = near.select("e", "rid", lo.alias("lo"), hi.alias("hi")).withColumn("c", F.explode(F.sequence(F.floor(down("lo") / width), F.floor(down("hi") / width))))
    spans = spans.join(hot, ["e", "c"], "left").fillna(1, ["parts"])
    first, last = part(F.greatest(down("lo"), F.col("c") * width)), part(F.least(down("hi"), F.col("c") * width + width - 1))
    index = spans.withColumn("s", F.explode(F.sequence(first, last)))
    probes = placed(lhs).select("e", "c", "s", (2 * F.col("t")).alias("at"), "lid", F.lit(None).cast("struct<rid:bigint,hi:bigint>").alias("span"))
    entries = index.select("e", "c", "s", F.col("lo").alias("at"), F.lit(None).cast("long").alias("lid"), F.struct("rid", "hi").alias("span"))
    pass_ = Window.partitionBy("e", "c", "s").orderBy("at", F.col("lid").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = entries.unionByName(probes).withColumn("span", F.last("span", ignorenulls=True).over(pass_))
    return hits.where("lid IS NOT NULL AND span.hi >= at").select(F.col("lid").alias(left_id), F.col("span.rid").alias(right_id))
