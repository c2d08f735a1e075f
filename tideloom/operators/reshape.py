"""Packed counts to long and wide form; inverted indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpack_counts(lines: DataFrame, line: str) -> DataFrame:
    """`u1111 22344 22b7` to (actor_id, ym, n): three characters of year and hexadecimal month, then the count."""
    parts = F.split(F.trim(line), r"\s+")
    rows = lines.select(F.expr(f"try_cast(substring(split(trim({line}), ' ')[0], 2) AS BIGINT)").alias("actor_id"), F.explode(F.slice(parts, 2, 1 << 30)).alias("tok"))
    month = F.conv(F.substring("tok", 3, 1), 16, 10)
    return rows.select("actor_id", F.concat(F.lit("20"), F.substring("tok", 1, 2), F.lpad(month, 2, "0")).alias("ym"), F.expr("try_cast(substring(tok, 4) AS BIGINT)").alias("n")).where("actor_id IS NOT NULL AND n IS NOT NULL")


def pack_counts(counts: DataFrame, key: str, ym: str, n: str) -> DataFrame:
    """The inverse: one line a key, tokens in the order of months."""
    month = F.lower(F.conv(F.substring(ym, 5, 2), 10, 16))
    tok = F.concat(F.substring(ym, 3, 2), month, F.col(n).cast("string"))
    lists = counts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(ym).alias("ym"), tok.alias("tok")))).alias("l"))
    return lists.select(F.concat(F.lit("u"), F.col(key).cast("string"), F.lit(" "), F.array_join(F.transform("l", lambda x: x.tok), " ")).alias("line"))


def long_to_wide(df: DataFrame, key: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """One shuffle by key sums all files at once; missing cells are 0."""
    return df.groupBy(key).pivot(column, columns).agg(F.sum(value)).fillna(0, columns).select(key, *[F.col(f"`{c}`").alias(f"m_{c}") for c in columns])


def invert(df: DataFrame, item: str, holder: str) -> DataFrame:
    """(holder, items, n): the inverted index, items in order. For a holder of unbounded many items use counts only."""
    return df.select(item, holder).dropna().distinct().groupBy(holder).agg(F.array_join(F.sort_array(F.collect_list(item)), " | ").alias("items"), F.count("*").alias("n"))


def text_of_index(df: DataFrame, keys: list[str], word: str, places: str) -> DataFrame:
    """(keys, text) of an inverted index of words with their places: words in the order of places, joined by blanks. A text is one row anyway, so its words fit one."""
    pairs = df.select(*keys, F.explode(places).alias("_i"), F.col(word).alias("_w"))
    ordered = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_w"))).alias("_s"))
    return ordered.select(*keys, F.array_join(F.transform("_s", lambda x: x["_w"]), " ").alias("text"))


def flatten_claims(nested: DataFrame, flat: DataFrame, key: str, themes: str, claims: str) -> DataFrame:
    """(key, theme, claim) of two layouts: themes(theme, claims) that hold lists, and claims(theme, claim) that are pairs."""
    a = nested.select(key, F.explode(themes).alias("x")).select(key, "x.theme", F.explode("x.claims").alias("claim"))
    return a.unionByName(flat.select(key, F.explode(claims).alias("x")).select(key, "x.theme", "x.claim"))


def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Top rows with their rank. The limit comes first, so ranking is over `limit` rows only."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rank_rows(df: DataFrame, order: list[Column], name: str = "row_no", parts: int | None = None) -> DataFrame:
    """Row numbers over the whole data without one task holding it: range partitions, their sizes, and a number within each."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    from tideloom.session import materialise

    r = materialise(r, "ranges")  # the cut keeps partition ids fixed between the two uses
    sizes = r.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_before")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return r.withColumn("_r", within).join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_r")).drop("_p", "_r", "_before")
