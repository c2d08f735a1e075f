"""Problem 7: filling containers of fixed capacity with documents.

Length-histogram planning. Only the number of items of each length goes to the driver (at most `capacity` numbers). Best fit
runs over these counts, whole ranges of equal containers at a time, and yields a plan: which ranks of a length go to which
range of containers. Documents then look up their slot by their rank within their length. A document longer than the capacity
fills containers of its own and leaves one remainder, the only split there is.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideloom.session import parallelism

#: Least number of parts a length is ranked in; more where the session has more shuffle partitions.
SALTS = 64
#: A plan of more rows a length of the capacity is joined instead of broadcast; plans were seen to stay below 8, however many documents.
PLAN_ROWS = 64
#: Ranks in a block of a joined plan.
BLOCK = 100_000


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """(rows of [length, first rank, end rank, first container], containers used) by best fit decreasing over counts.

    Containers of one state form ranges of consecutive numbers; a length takes the fullest state it still fits in.
    """
    room: dict[int, list[list[int]]] = {}  # free space -> ranges [start, end)
    spaces: list[int] = []  # the spaces present, ascending
    rows, used = [], 0

    def put(space: int, start: int, end: int) -> None:
        if space <= 0 or start >= end:
            return
        if space not in room:
            room[space] = []
            insort(spaces, space)
        if room[space] and room[space][-1][1] == start:
            room[space][-1][1] = end
        else:
            room[space].append([start, end])

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                fit = capacity // length
                new = -(-left // fit)
                put(capacity, used, used + new)
                used += new
                continue
            space = spaces[at]
            start, end = room[space][-1]
            take = min(left, end - start)
            room[space][-1][1] = end - take
            if take == end - start:
                room[space].pop()
                if not room[space]:
                    del room[space]
                    spaces.pop(at)
            rows.append((length, rank, rank + take, end - take))
            put(space - length, end - take, end)
            left, rank = left - take, rank + take
    return np.array(rows, np.int64).reshape(-1, 4), used


def pack(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """(container_kind, container_id, doc_id, part_no, n_tokens) for each kind of specs(container_kind, capacity_tokens).

    sizes: (doc_id, n_tokens), one row a document. Every document is placed once in each kind: part 0 if whole; a document
    over the capacity has parts 1.. of which all but the last fill their container. Documents of no tokens take no container
    (container_id null). Kinds without a positive capacity are left out. Equal lengths are placed in the order of a hash of the id.
    """
    out = None
    kinds = specs.where("container_kind IS NOT NULL AND capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("c")).orderBy("container_kind").collect()  # a few kinds
    for kind in kinds:
        one = _pack_kind(sizes, kind.container_kind, int(kind.c))
        out = one if out is None else out.unionByName(one)
    schema = "container_kind string, container_id bigint, doc_id bigint, part_no int, n_tokens bigint"
    return out if out is not None else sizes.sparkSession.createDataFrame([], schema)


def _pack_kind(sizes: DataFrame, kind: str, capacity: int) -> DataFrame:
    over = F.col("n_tokens") > capacity
    items = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.when(over, F.col("n_tokens") % capacity).otherwise(F.col("n_tokens")).alias("length"), F.when(over, F.floor(F.col("n_tokens") / capacity)).otherwise(0).alias("full"))
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(max(SALTS, parallelism(sizes.sparkSession)))).cast("int"))
    counts = items.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row a length up to the capacity
    rows, used = plan(histogram, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]

    # rank within the length: offset of the salt plus rank within (length, salt), so a common length isn't sorted in one task
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    offsets = counts.withColumn("before", before).select("length", "salt", "before")
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")) - 1)
    ranked = ranked.join(offsets, ["length", "salt"]).select("doc_id", "n_tokens", "length", "full", (F.col("rank") + F.col("before")).alias("rank"))
    placed = _by_broadcast(ranked, rows) if len(rows) <= PLAN_ROWS * capacity else _by_join(ranked, rows)
    kind_ = F.lit(kind).alias("container_kind")
    rest = placed.where("length > 0").select(kind_, F.col("slot").alias("container_id"), "doc_id", F.when(F.col("full") > 0, F.col("full") + 1).otherwise(0).cast("int").alias("part_no"), F.col("length").alias("n_tokens"))
    # full parts: numbered after the planned containers by the offset of the document's salt and a running sum within it
    long = items.where("full > 0")
    per = long.groupBy("salt").agg(F.sum("full").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("salt")) - F.col("n")).select("salt", "before")
    within = F.sum("full").over(Window.partitionBy("salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("full")
    numbered = long.withColumn("within", within).join(per, "salt").select("doc_id", (F.lit(used) + F.col("before") + F.col("within")).alias("first"), F.posexplode(F.sequence(F.lit(1), F.col("full").cast("int"))).alias("k", "part_no"))
    full = numbered.select(kind_, (F.col("first") + F.col("k")).alias("container_id"), "doc_id", "part_no", F.lit(capacity).cast("bigint").alias("n_tokens"))
    empty = sizes.where("n_tokens = 0 OR n_tokens IS NULL").select(kind_, F.lit(None).cast("bigint").alias("container_id"), "doc_id", F.lit(0).alias("part_no"), F.lit(0).cast("bigint").alias("n_tokens"))
    return rest.unionByName(full).unionByName(empty)


def _by_broadcast(ranked: DataFrame, rows: np.ndarray) -> DataFrame:
    """ranked with the container of each row, by binary search in a plan of checked size."""
    model = ranked.sparkSession.sparkContext.broadcast(rows)  # at most PLAN_ROWS x capacity rows

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        key = (p[:, 0] << 40) + p[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, (length.astype(np.int64) << 40) + rank, "right") - 1
            at = np.clip(at, 0, max(0, len(p) - 1))
            slot = np.where(length > 0, p[at, 3] + rank - p[at, 1] if len(p) else 0, -1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), b.column("length"), b.column("full"), pa.array(slot, pa.int64())], ["doc_id", "n_tokens", "length", "full", "slot"])

    return ranked.mapInArrow(slots, "doc_id bigint, n_tokens bigint, length bigint, full bigint, slot bigint")


def _by_join(ranked: DataFrame, rows: np.ndarray) -> DataFrame:
    """The same for a plan too large to broadcast: plan rows enter the blocks of ranks they touch, and one ordered pass in a block
    gives each rank the last plan row that starts at or before it."""
    import pandas as pd

    plan_ = ranked.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["length", "first", "end", "container"]))
    blocks = F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)))
    p = plan_.select("length", blocks.alias("block"), F.col("first").alias("rank"), F.struct("first", "container").alias("row"))
    r = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK)).withColumn("row", F.lit(None).cast(p.schema["row"].dataType))
    w = Window.partitionBy("length", "block").orderBy("rank", F.col("doc_id").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = r.unionByName(p, allowMissingColumns=True).withColumn("row", F.last("row", ignorenulls=True).over(w)).where("doc_id IS NOT NULL")
    return both.select("doc_id", "n_tokens", "length", "full", F.when(F.col("length") > 0, F.col("row.container") + F.col("rank") - F.col("row.first")).otherwise(-1).alias("slot"))


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers, tokens and share of used space per kind."""
    caps = specs.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    per = packed.groupBy("container_kind").agg(F.count_distinct("container_id").alias("n_containers"), F.count_distinct("doc_id").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return per.join(caps, "container_kind").withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))
