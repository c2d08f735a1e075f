"""Text drift and coverage: tokens, yearly versions, bag-of-words change, sentence containment, overlap matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.functions.text import hard_form, normal_form
from tideloom.functions.web import unescape


def tokens(c: Column) -> Column:
    """Words of the lower-case text; (?U) makes the classes hold for all scripts."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def sentences(c: Column, longer_than: int = 20) -> Column:
    """Pieces ending in a full stop, question or exclamation mark, longer than the given number of characters."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+"), F.trim), lambda s: F.length(s) > longer_than)


def yearly_versions(df: DataFrame, series: list[str], ts: str, key: str, text: str) -> DataFrame:
    """The last version of each series in each year, with the version before it. Texts move once, to their series."""
    last = df.groupBy(*series, F.year(ts).alias("year")).agg(F.max_by(F.struct(key, text), F.struct(ts, key)).alias("v"))
    w = Window.partitionBy(*series).orderBy("year")
    return last.select(*series, "year", F.col(f"v.{key}").alias(key), F.col(f"v.{text}").alias(text), F.lag(f"v.{text}").over(w).alias("previous"), F.lag("year").over(w).alias("previous_year"))


def word_changes(df: DataFrame, text: str, previous: str, keys: list[str]) -> DataFrame:
    """Per row: words, words added and removed as multisets, cosine of the bags (0 if one is empty, null without a previous text)."""
    counts = df.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(text).alias("t")), F.struct(F.lit(1).alias("side"), F.col(previous).alias("t")))).alias("x")).select(*keys, "x.side", F.explode_outer(tokens(F.col("x.t"))).alias("w"))
    per = counts.where("w IS NOT NULL").groupBy(*keys, "w").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("b"))
    sums = per.groupBy(*keys).agg(
        F.sum("a").alias("n_words"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("removed"),
        F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"),
    )
    has = df.select(*keys, F.col(previous).isNotNull().alias("has"))
    out = has.join(sums, keys, "left")
    cosine = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("dot") / F.sqrt(F.col("aa").cast("double") * F.col("bb"))).otherwise(0.0)
    only = lambda c: F.when(F.col("has"), c)
    return out.select(*keys, F.coalesce("n_words", F.lit(0)).alias("n_words"), only(F.coalesce("added", F.lit(0))).alias("words_added"), only(F.coalesce("removed", F.lit(0))).alias("words_removed"), only(F.round(cosine, 4)).alias("cosine"))


def containment(source: Column, target: Column, head: int = 60) -> Column:
    """Share of the source's sentences whose first characters occur in the target; 1 for a source without sentences. In one row: no join."""
    s = F.transform(sentences(source), lambda x: F.lower(F.substring(x, 1, head)))
    low = F.lower(F.coalesce(target, F.lit("")))
    return F.when(F.size(s) == 0, 1.0).otherwise(F.size(F.filter(s, lambda x: F.contains(low, x))) / F.size(s))


def content_words(c: Column, stop: list[str]) -> Column:
    """Distinct words beyond one character that aren't stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-zà-ÿ0-9%]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(stop))))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two sets: common elements over the smaller size, 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def best_overlap_of_all(statements: DataFrame, units: DataFrame, statement_id: str, unit_id: str, words: str, statement_block: int = 1024, unit_block: int = 4096) -> DataFrame:
    """For each statement the unit among all with the greatest overlap to four places, the smaller id on ties. Exact.

    Every block of statements meets every block of units, whose words are indexed once a meeting; of a pair of blocks one row per
    statement travels on. Work grows with statements times units. `words` are arrays without repeats, the ids of each side
    whole numbers that occur once. Statements that share no word with any unit have no row.
    """

    def blocks(df: DataFrame, key: str, size: int, name: str) -> DataFrame:
        some = df.where((F.size(words) > 0) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(words).alias("w"))
        n = some.count() // size + 1
        return some.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "w")).alias("r")).select(F.col("r.id").alias(f"{name}_ids"), F.col("r.w").alias(f"{name}_words"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for u_ids, u_words, s_ids, s_words in b.itertuples(index=False):
                order = np.argsort(u_ids)
                ids, sizes = np.asarray(u_ids)[order], np.array([len(u_words[i]) for i in order])
                at: dict = {}
                for k, i in enumerate(order):
                    for w in u_words[i]:
                        at.setdefault(w, []).append(k)
                at = {w: np.array(ks) for w, ks in at.items()}
                out = []
                for i, ws in zip(s_ids, s_words):
                    hits = [at[w] for w in ws if w in at]
                    if hits:
                        share = np.floor(np.bincount(np.concatenate(hits), minlength=len(ids)) / np.minimum(sizes, len(ws)) * 1e4 + 0.5)
                        k = share.argmax()  # the first of equal ones has the smallest id
                        out.append((i, ids[k], share[k] / 1e4))
                yield pd.DataFrame(out, columns=["s", "u", "overlap"])

    pairs = blocks(units, unit_id, unit_block, "u").crossJoin(blocks(statements, statement_id, statement_block, "s"))
    each = pairs.mapInPandas(best, "s long, u long, overlap double")
    return each.groupBy(F.col("s").alias(statement_id)).agg(F.max_by(F.struct(F.col("u").alias(unit_id), "overlap"), F.struct("overlap", -F.col("u"))).alias("m")).select(statement_id, f"m.{unit_id}", "m.overlap")


def text_windows(c: Column, width: int, stride: int) -> Column:
    """Overlapping windows of a text as structs (start, text)."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(stride))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), c.substr(i + 1, F.lit(width)).alias("text")))


def strip_html(c: Column) -> Column:
    """Text of a page with a line end at each block element; scripts, styles and tags gone, character references resolved."""
    t = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<(br|p|li|tr|div|h[1-6])\b[^>]*>", "\n")
    t = unescape(F.regexp_replace(t, r"(?s)<[^>]+>", " "))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def strip_wikitext(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?s)<ref[^>/]*>.*?</ref>|<ref[^>]*/>", "")
    t = F.regexp_replace(t, r"\{\{[^{}]*\}\}", "")
    t = F.regexp_replace(t, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    t = F.regexp_replace(t, r"'{2,}", "")
    return F.trim(F.regexp_replace(t, r"(?m)^[=*:#]+ *| *=+$", ""))


def wikilinks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[\[([^\]|#]+)"), F.lit(1))


def verify_passage(passage: Column, document: Column) -> Column:
    """Ladder of ever weaker matches: skipped (under 15 characters), exact but for case, normalized, hard, hard_partial (the first 80
    characters of a longer hard form), not_found. A null document holds nothing."""
    p, d = F.coalesce(passage, F.lit("")), F.coalesce(document, F.lit(""))
    np, hp, hd = normal_form(p), hard_form(p), hard_form(d)
    return (
        F.when(F.length(F.trim(p)) < 15, "skipped").when(F.contains(F.lower(d), F.lower(p)), "exact").when((np != "") & F.contains(normal_form(d), np), "normalized")
        .when((hp != "") & F.contains(hd, hp), "hard").when((F.length(hp) > 80) & F.contains(hd, F.substring(hp, 1, 80)), "hard_partial").otherwise("not_found")
    )


def units(df: DataFrame, key: str, text: str, header: str) -> DataFrame:
    """(key, unit_no, text, is_header): lines that match the pattern at their start are headers, others are cut after . ! ? or : and white space."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("_l", "_t")).withColumn("_t", F.trim("_t")).where("_t <> ''")
    head = F.col("_t").rlike("^(?:" + header + ")")
    pieces = lines.select(key, "_l", head.alias("is_header"), F.posexplode(F.when(head, F.array("_t")).otherwise(F.split("_t", r"(?<=[.!?:])\s+"))).alias("_p", "text"))
    order = Window.partitionBy(key).orderBy("_l", "_p")
    return pieces.withColumn("text", F.trim("text")).where("text <> ''").select(key, F.row_number().over(order).alias("unit_no"), "text", "is_header")


def coverage(best: DataFrame, units_: DataFrame, unit_id: str, floor: float = 0.34) -> DataFrame:
    """(unit_id, n): how many statements have the unit as their best with at least the given overlap; 0 for the rest."""
    hits = best.where(F.col("overlap") >= floor).groupBy(unit_id).agg(F.count("*").alias("n"))
    return units_.select(unit_id).distinct().join(hits, unit_id, "left").fillna(0, ["n"])


def inclusion(blocks: DataFrame, best: DataFrame, block_id: str, text: str, group: str, floor: float = 0.40) -> DataFrame:
    """Per group: blocks, those whose best overlap reaches the floor, and their shares of blocks and characters in whole per cent."""
    b = blocks.select(group, block_id, F.length(text).cast("long").alias("_n")).join(best.where(F.col("overlap") >= floor).select(block_id).distinct().withColumn("_in", F.lit(1)), block_id, "left").fillna(0, ["_in"])
    g = b.groupBy(group).agg(F.count("*").alias("n_blocks"), F.sum("_in").alias("n_in"), F.sum("_n").alias("_all"), F.sum(F.col("_n") * F.col("_in")).alias("_got"))
    percent = lambda a, b: F.when(F.col(b) > 0, F.floor(100 * F.col(a) / F.col(b))).otherwise(0)
    return g.select(group, "n_blocks", "n_in", percent("n_in", "n_blocks").alias("block_percent"), percent("_got", "_all").alias("char_percent"))


def keyword_windows(text: Column, query: list[str], width: int = 600, stride: int = 250) -> Column:
    """Structs (start, score) of the windows that hold any of the words; the score is how many of them."""
    score = lambda t: sum((F.when(F.contains(t, F.lit(w.lower())), 1).otherwise(0) for w in query), F.lit(0))
    scored = F.transform(text_windows(text, width, stride), lambda x: F.struct(score(F.lower(x.text)).alias("score"), x.start.alias("start")))
    return F.filter(scored, lambda x: x.score > 0)


def lifespans(df: DataFrame, series: list[str], year: str, content: Column) -> DataFrame:
    """Versions of a text as runs of an unchanged hash with first and last year: the next version opens where the hash changes."""
    w = Window.partitionBy(*series).orderBy(year)
    h = F.md5(content)
    marked = df.select(*series, year, h.alias("h")).withColumn("new", F.when(F.col("h").eqNullSafe(F.lag("h").over(w)), 0).otherwise(1))
    return marked.withColumn("version", F.sum("new").over(w)).groupBy(*series, "version").agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"))
