"""Problem 8: mixing sources to target shares of tokens.

Efraimidis-Spirakis sampling without replacement: each document draws an exponential key divided by its quality weight, and
the smallest keys of a source win until its token budget is full. A budget beyond the source's size is met by complete epochs
first; only the rest is sampled. Keys are cut into ranges, token sums of (source, range) are prefix-summed, and rows are
ordered only within a range. Ranges are equal steps of the logarithm of the key: whatever the weights, the logarithm of an
exponential draw has no more than 0.37 of its mass in a unit, so no range holds more than 0.37 / STEPS of a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least number of ranges a unit of the logarithm; more if a range would hold more than ROWS documents.
STEPS, ROWS = 64, 200_000


def quality() -> F.Column:
    """Weight of a document in 0.05..1: words per token (odd strings break into many tokens), less for very short texts."""
    n = F.col("n_tokens")
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.col("n_words") / n * n / (n + 20)))).otherwise(0.05)


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per target: size, budget, complete epochs and the tokens left to sample. A row per source of the targets.

    Without `total` the mix is as large as the repeat limits of the sources that have any text allow. A target without text
    cannot be met; a share or limit that is null or not positive gives no budget.
    """
    have = sizes.where("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n_docs"))
    t = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(have, "source", "left").fillna(0, ["size", "n_docs"])
    usable = (F.col("size") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    most = t.where(usable).agg(F.min(F.col("size") * F.col("max_repeats") / F.col("target_share")).alias("most"))
    whole = F.lit(float(total)) if total is not None else F.coalesce(F.col("most"), F.lit(0.0))
    t = t.crossJoin(F.broadcast(most))  # one row
    budget = F.when(usable, F.least(F.floor(F.col("target_share") * whole + 1e-6), F.col("size") * F.col("max_repeats"))).otherwise(0).cast("bigint")
    t = t.withColumn("budget", budget).withColumn("epochs", F.when(F.col("budget") > 0, F.expr("budget div size")).otherwise(0).cast("int"))
    return t.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size")).drop("most")


def mix(sizes: DataFrame, plan: DataFrame, seed: int = 42, weight: F.Column | None = None) -> DataFrame:
    """(source, doc_id, n_tokens, copies) of all documents that appear. sizes: (doc_id, source, n_tokens, n_words), one row a document.
    weight is an expression of its columns, quality() if none is given; a weight that is null or not positive counts as the least, 1e-9.

    A document goes into the sampled part if its prefix sum stays within the rest, or exceeds it by less than half of its own
    size while a repeat is still allowed. Documents of unlisted or null sources and without tokens don't appear.
    """
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = sizes.where("n_tokens > 0").withColumn("key", -F.log(draw) / F.greatest(F.coalesce(quality() if weight is None else weight, F.lit(0.0)), F.lit(1e-9)))
    rows = keyed.join(plan.select("source", "epochs", "rest", "max_repeats"), "source")  # a row per target: its size decides on the broadcast
    steps = max(STEPS, sizes.count() * 37 // (100 * ROWS))
    rows = rows.withColumn("range", F.floor(F.log("key") * steps).cast("bigint"))
    sums = rows.groupBy("source", "range").agg(F.sum("n_tokens").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("source").orderBy("range")) - F.col("s")).select("source", "range", "before", "s")
    rows = rows.join(before, ["source", "range"])
    run = F.sum("n_tokens").over(Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("prefix", F.col("before") + run)
    into = (F.col("prefix") - F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("rest") > 0) & (F.col("epochs") < F.col("max_repeats"))
    copies = (F.col("epochs") + into.cast("int")).alias("copies")
    return rows.select("source", "doc_id", "n_tokens", copies).where("copies > 0")


def mix_report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual share per source of the targets, with documents, tokens and the most copies of one document."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("used_docs"), F.max("copies").alias("most_copies"))
    rows = plan.select("source", "target_share", "max_repeats", "size", "n_docs", "budget").join(got, "source", "left").fillna(0, ["tokens", "used_docs", "most_copies"])
    total = rows.agg(F.sum("tokens").alias("total"))
    share = F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(0.0)
    return rows.crossJoin(F.broadcast(total)).withColumn("actual_share", F.round(share, 6)).drop("total")
