"""Sinks: partition replacement, versioned and sorted exports, graph files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_slices(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces exactly the partitions that df holds, each at once; others stay. Rerunning gives the same state."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def expect_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fails loudly when a table doesn't have the columns it should, before anything is written."""
    if sorted(df.columns) != sorted(columns):
        raise ValueError(f"columns {sorted(df.columns)} differ from {sorted(columns)}")
    return df.select(*columns)


def archive(df: DataFrame, path: str, version: str) -> str:
    """An immutable copy under its version; an existing one is an error."""
    target = f"{path.rstrip('/')}/built_at={version}"
    df.write.mode("error").parquet(target)
    return target


def export_csv(df: DataFrame, path: str, sort: list[str] | None = None, single: bool = False) -> None:
    """CSV with header. A single file only for results known to be small, such as reports."""
    df = df.coalesce(1) if single else df
    df = df.sortWithinPartitions(*sort) if sort else df
    df.write.mode("overwrite").csv(path, header=True)


def export_by_group(df: DataFrame, path: str, group: str, sort: str) -> None:
    """One sorted file a group."""
    df.repartition(group).sortWithinPartitions(group, sort).write.mode("overwrite").partitionBy(group).csv(path, header=True)


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line) of a GraphML document's body: nodes(id, label) then edges(source, target)."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.lit(0).alias("part"), F.concat(F.lit('<node id="'), esc("id"), F.lit('"><data key="label">'), esc("label"), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.concat(F.lit('<edge source="'), esc("source"), F.lit('" target="'), esc("target"), F.lit('"/>')).alias("line"))
    return n.unionByName(e)


def rewrite_documents(df: DataFrame, path: str, key: str) -> None:
    """Nested JSON documents, one folder a key; those of df are replaced at once, others stay."""
    df.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log of what failed or is pending; nothing in it is ever changed."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def report_lines(df: DataFrame, group: str, columns: list[str], order: list[str]) -> DataFrame:
    """(place, line) of a Markdown report: a heading and a table per group, rows in order. For results small enough to be read."""
    from pyspark.sql import Window

    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    body = df.select(F.col(group).cast("string").alias("g"), F.lit(1).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], row.alias("line"))
    heads = df.select(F.col(group).cast("string").alias("g")).distinct().select("g", F.lit(0).alias("k"), *[F.lit(None).alias(f"o{i}") for i in range(len(order))], F.concat(F.lit("## "), F.coalesce("g", F.lit("")), F.lit("\n\n| " + " | ".join(columns) + " |\n|" + "---|" * len(columns))).alias("line"))
    both = body.unionByName(heads)
    return both.select(F.row_number().over(Window.orderBy("g", "k", *[f"o{i}" for i in range(len(order))], "line")).alias("place"), "line")
