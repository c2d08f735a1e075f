"""Curated records and literature: figures, dates, rule cascades, precedence merges, deduplication, matching, tallies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def figure_value(c: Column) -> Column:
    """"~1,762+" to 1762: all digits as one number. Ranges, ordinals and texts without a digit give null. "8 January 2023" gives
    82023; that it is a date is left to the rules that follow."""
    bad = c.rlike(r"\d\s*(to|-|–|—)\s*\d") | c.rlike(r"(?i)\d(st|nd|rd|th)\b")
    digits = F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))
    return F.when(~bad, digits.try_cast("bigint"))


def first_rule(df: DataFrame, rules: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """The name of the first rule that holds, null if none does: one CASE in rule order, so no join is needed."""
    case = F.when(rules[0][1], rules[0][0])
    for label, cond in rules[1:]:
        case = case.when(cond, label)
    return df.withColumn(name, case)


def all_rules(df: DataFrame, rules: list[tuple[str, Column]], name: str = "violation") -> DataFrame:
    """One row for each rule a row meets."""
    each = F.array_compact(F.array(*[F.when(cond, F.lit(label)) for label, cond in rules]))
    return df.withColumn(name, F.explode(each))


def keep_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One row a key, the first in order; rows with a null key are all kept, as they have no identity to share."""
    keyed = df.withColumn("_k", key)
    held = keyed.where("_k IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).where("_r = 1").drop("_r")
    return held.unionByName(keyed.where("_k IS NULL")).drop("_k")


def identity_chain(doi: Column, url: Column, title: Column, head: int = 80) -> Column:
    """Identifier, else address, else title head: the first that isn't blank."""
    d = F.nullif(F.lower(F.trim(F.regexp_replace(doi, r"(?i)^(https?://(dx\.)?doi\.[a-z.]*/|doi:\s*)", ""))), F.lit(""))
    u = F.nullif(F.regexp_replace(F.trim(url), r"/+$", ""), F.lit(""))
    t = F.nullif(F.lower(F.substring(F.trim(title), 1, head)), F.lit(""))
    return F.coalesce(F.concat(F.lit("d:"), d), F.concat(F.lit("u:"), u), F.concat(F.lit("t:"), t))


def fallback_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[tuple[Column, Column]]) -> DataFrame:
    """(left_id, right_id, via): the match by the first pair of keys that finds one; via is its position, null without match."""
    out = left.select(left_id).distinct()
    for i, (a, b) in enumerate(keys):
        r = right.select(b.alias("k"), F.col(right_id)).where("k IS NOT NULL").groupBy("k").agg(F.min(right_id).alias(f"m{i}"))
        l = left.select(left_id, a.alias("k")).where("k IS NOT NULL").join(r, "k").groupBy(left_id).agg(F.min(f"m{i}").alias(f"m{i}"))  # noqa: E741
        out = out.join(l, left_id, "left")
    ms = [F.col(f"m{i}") for i in range(len(keys))]
    via = F.coalesce(*[F.when(m.isNotNull(), F.lit(i)) for i, m in enumerate(ms)])
    return out.select(left_id, F.coalesce(*ms).alias(right_id), via.alias("via"))


def append_unseen(old: DataFrame, new: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Old rows, and of the new ones the first of each key not among the old."""
    fresh = keep_first(new, key, order)
    seen = old.select(key.alias("_seen")).where("_seen IS NOT NULL").distinct()
    return old.unionByName(fresh.join(seen, key == F.col("_seen"), "left_anti"))


def precedence_merge(df: DataFrame, key: list[str], seq: str, value: str, state: str) -> DataFrame:
    """Folds the records of a key in the order of seq to one (value, state); the first is what is there, later ones need a value.

    not_applicable stays for ever, and so does a confirmed record that has a value; an approximate one with a value gives way only
    to a confirmed one; anything else to whatever comes next. The fold needs no order of rows: it ends at the first record
    that stays, or, if that is approximate, at the first confirmed one. Equal seq: the smaller value first.
    """
    rec = F.struct(seq, value, state)
    has = F.col(value).isNotNull()
    least = lambda cond: F.min(F.when(cond, rec))
    g = df.groupBy(*key).agg(
        F.min(rec).alias("first"), F.max(F.when(has, rec)).alias("last"), least(has & F.col(state).isin("not_applicable", "confirmed", "approximate")).alias("stays"), least(has & (F.col(state) == "confirmed")).alias("sure")
    )
    stays = F.when(F.col(f"stays.{state}") == "approximate", F.coalesce("sure", "stays")).otherwise(F.col("stays"))
    kept = F.when(F.col(f"first.{state}") == "not_applicable", F.col("first")).otherwise(F.coalesce(stays, "last", "first"))
    return g.select(*key, kept.alias("m")).select(*key, f"m.{value}", f"m.{state}")


def upsert_sections(old: DataFrame, new: DataFrame, key: str, text: str, seq: str, order: list[str]) -> DataFrame:
    """(place, key, text) of a document of keyed sections: new texts replace old ones, sections in the given order of keys come first,
    others after them as they stood, new ones of unknown keys last; rows of old without a key (the text before the first) stay on top."""
    known = F.create_map(*[F.lit(x) for i, k in enumerate(order) for x in (k, i)])
    top = old.where(F.col(key).isNull()).select(F.lit(-1).alias("_a"), F.col(seq).cast("long").alias("_b"), key, text)
    o = old.where(F.col(key).isNotNull()).select(key, F.col(text).alias("_old"), F.col(seq).cast("long").alias("_s"))
    n = new.where(F.col(key).isNotNull()).select(key, F.col(text).alias("_new"))
    both = o.join(n, key, "full_outer").select(F.coalesce(F.try_element_at(known, F.col(key)), F.lit(len(order))).alias("_a"), F.coalesce("_s", F.lit((1 << 62))).alias("_b"), key, F.coalesce("_new", "_old").alias(text))
    w = Window.orderBy("_a", "_b", key)  # the sections of one document
    return top.unionByName(both).select(F.row_number().over(w).alias("place"), key, text)


def contained_in(value: Column, terms: list[str]) -> Column:
    """The terms that hold the value or are held by it. The list is the program's own, so it stands in the expression and nothing is joined."""
    return F.filter(F.array(*map(F.lit, terms)), lambda w: F.contains(value, w) | F.contains(w, value))


def due_again(wanted: DataFrame, held: DataFrame, key: str, held_at: str, max_age_days: Column, now: Column) -> DataFrame:
    """Rows of wanted whose copy is missing, or older than it may be: max_age_days is an expression of wanted's columns."""
    last = held.groupBy(F.col(key).alias("_k")).agg(F.max(held_at).alias("_at"))
    age = F.datediff(now, F.col("_at"))
    return wanted.join(last, F.col(key) == F.col("_k"), "left").where(F.col("_at").isNull() | (age > max_age_days)).drop("_k", "_at")


def templates(c: Column) -> Column:
    """Distinct names of the templates a wikitext calls, in lower case with single blanks."""
    names = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\{\{\s*([^{}|\n]+)"), F.lit(1))
    return F.array_distinct(F.transform(names, lambda x: F.lower(F.regexp_replace(F.trim(x), "[ _]+", " "))))


def all_labels(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Every label one of whose keywords occurs, in the order of the labels."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(low, w))
    return F.array_compact(F.array(*[F.when(found(ws), F.lit(k)) for k, ws in keywords.items()]))


def listing_events(df: DataFrame, comment: Column, by_bot: Column, bad: str) -> DataFrame:
    """Adds action (open, close, other), target and flag (disqualified, human_close or blank) of listing comments; comments that tell nothing are left out."""
    c = F.coalesce(comment, F.lit(""))
    target = lambda word: F.nullif(F.regexp_extract(c, rf"(?i)^\s*{word}:\s*\[\[([^\]]+)\]\]", 1), F.lit(""))
    added, removed, worse = target("Added"), target("Removed"), c.rlike(f"(?i){bad}") & ~by_bot
    action = F.when(added.isNotNull(), "open").when(removed.isNotNull(), "close").when(worse, "other")
    flag = F.when(added.isNotNull(), "").when(worse, "disqualified").when(by_bot, "").otherwise("human_close")
    return df.select("*", action.alias("action"), F.coalesce(added, removed, F.lit("")).alias("target"), flag.alias("flag")).where("action IS NOT NULL")


def tally(dimension: DataFrame, facts: DataFrame, key: str, counts: dict[str, Column]) -> DataFrame:
    """Counts per member of a dimension, members without facts included with zeros."""
    per = facts.groupBy(key).agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in counts.items()])
    return dimension.join(per, key, "left").fillna(0, list(counts))


def longest_match(df: DataFrame, value: str, rules: list[tuple[str, object]], result: str) -> DataFrame:
    """Adds the result of the longest fragment that occurs in the value, null if none does. The settings are a short list of the
    program's own, so they stand in the expression and nothing is joined; equal lengths: the later in the alphabet."""
    case = F.lit(None)
    for fragment, x in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        case = F.when(F.contains(F.col(value), F.lit(fragment)), F.lit(x)).otherwise(case)
    return df.withColumn(result, case)


def salvage_json(c: Column, schema: str) -> Column:
    """Array of structs from a text that holds JSON somewhere: fences dropped, the widest [...] parsed, else each flat object."""
    plain = F.regexp_replace(c, r"(?s)```[a-z]*", "")
    whole = F.from_json(F.regexp_extract(plain, r"(?s)\[.*\]", 0), f"array<{schema}>")
    single = F.transform(F.regexp_extract_all(plain, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda x: F.from_json(x, schema))
    return F.coalesce(whole, F.filter(single, lambda x: x.isNotNull()))


def _vector_blocks(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(ids, flat, dim): vectors of one length in blocks of about `size`; null, empty and zero vectors and those with null or NaN parts are left out."""
    good = df.where(F.col(key).isNotNull() & (F.size(vector) > 0) & F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    v = good.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dim"))
    n = v.count() // size + 1
    b = v.groupBy("dim", F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return b.select(F.col("r.id").alias("ids"), F.flatten("r.v").alias("flat"), "dim")


def nearest_vectors(queries: DataFrame, vectors: DataFrame, key: str, vector: str, query_block: int = 256, vector_block: int = 2048) -> DataFrame:
    """(q, key, cosine): for each query the other vector with the greatest cosine, to five places, the smaller id on ties. Exact.

    Every block of queries meets every block of vectors as one matrix product; one row per query and pair of blocks travels on.
    Vectors of different lengths aren't compared. A query without any comparable vector has no row.
    """
    qs, vs = _vector_blocks(queries, key, vector, query_block), _vector_blocks(vectors, key, vector, vector_block)
    pairs = vs.crossJoin(qs.select(F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"), F.col("dim").alias("q_dim")))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = lambda flat, dim: (m := np.asarray(flat, dtype="f8").reshape(-1, dim)) / np.linalg.norm(m, axis=1, keepdims=True)
        for b in batches:
            for ids, flat, dim, q_ids, q_flat, q_dim in b.itertuples(index=False):
                if dim != q_dim:
                    continue
                order = np.argsort(ids)
                i, q = np.asarray(ids)[order], np.asarray(q_ids)
                cos = np.floor(unit(q_flat, dim) @ unit(flat, dim)[order].T * 1e5 + 0.5) / 1e5
                cos[q[:, None] == i[None, :]] = -np.inf
                at = cos.argmax(axis=1)  # the first of equal ones has the smallest id
                found = pd.DataFrame({"q": q, "id": i[at], "cosine": cos[np.arange(len(q)), at]})
                yield found[found["cosine"] > -np.inf]

    each = pairs.mapInPandas(best, "q long, id long, cosine double")
    m = each.groupBy("q").agg(F.max_by(F.struct("id", "cosine"), F.struct("cosine", -F.col("id"))).alias("m"))
    return m.select("q", F.col("m.id").alias(key), "m.cosine")
