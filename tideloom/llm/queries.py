"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideloom.functions.timestamps import compact_utc
from tideloom.llm.languages import language_segments, wrong_labels
from tideloom.llm.linkage import link_records
from tideloom.llm.mail import written_lines
from tideloom.llm.mixing import budgets, mix, mix_report
from tideloom.llm.nearest import nearest_in_time
from tideloom.llm.packing import fill_report, pack
from tideloom.llm.tokens import token_sizes
from tideloom.operators.timestamps import feed_instants
from tideloom.session import materialise
from tideloom.sources.tables import table

THIRTY_DAYS = 30 * 86_400


def p1_found(spark, d):
    opens = table(spark, d, "rfc_opens", "open_rev_id", "page_id", "open_ts", "feed")
    when = materialise(feed_instants(opens, table(spark, d, "ts_feeds")), "open-instants")
    pages = opens.select("open_rev_id", "page_id").distinct()
    left = pages.join(when, F.col("open_rev_id") == F.col("rec_id")).select("open_rev_id", "page_id", "utc_s")
    closes = table(spark, d, "rfc_human_closes", "close_rev_id", "page_id", "close_ts")
    right = closes.select("close_rev_id", "page_id", compact_utc("close_ts").alias("utc_s"))
    return nearest_in_time(left, right, "page_id", "open_rev_id", "utc_s", "close_rev_id", "utc_s", THIRTY_DAYS)


def p1_nearest_click(spark, d):
    """Each view with the nearest purchase of its user within two days, in microseconds."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "ts").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    kind = lambda k, name: e.where(F.col("event_type") == k).select(F.col("event_id").alias(name), "user_id", "t")
    return nearest_in_time(kind("view", "view_id"), kind("purchase", "purchase_id"), "user_id", "view_id", "t", "purchase_id", "t", 2 * 86_400_000_000)


def p4_links(spark, d):
    works = table(spark, d, "crossref_work", "work_id", "doi", "title", "authors", "year")
    candidates = table(spark, d, "candidate", "cand_id", "title", "year", "authors", "doi")
    names = "transform(authors, a -> concat_ws(', ', a.family, a.given))"
    return link_records(candidates, works, "cand_id", "work_id", "authors", names)


def p4_found(spark, d):
    return p4_links(spark, d).select("cand_id", "work_id")


def p5_found(spark, d):
    return written_lines(table(spark, d, "parse_messages", "msg_id", "subject", "msg_date", "sender", "body"))


def p9_segments(spark, d):
    return language_segments(table(spark, d, "documents", "doc_id", "text", "lang")).drop("label")


def p9_found(spark, d):
    return wrong_labels(language_segments(table(spark, d, "documents", "doc_id", "text", "lang"))).select("doc_id", "seg_no", "lang")


def _sizes(spark, d, *keep):
    return materialise(token_sizes(table(spark, d, "documents", "doc_id", *keep, "text"), *keep), "token-sizes")


def p7_pack(spark, d):
    return pack(_sizes(spark, d), table(spark, d, "container_spec"))


def p7_report(spark, d):
    return fill_report(p7_pack(spark, d), table(spark, d, "container_spec"))


def p7_promises(spark, d):
    """Per kind: documents placed, containers over their capacity, and documents within the capacity that were split."""
    packed = materialise(p7_pack(spark, d), "packed")
    caps = table(spark, d, "container_spec").groupBy("container_kind").agg(F.max("capacity_tokens").alias("c"))
    load = packed.where("container_id IS NOT NULL").groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n")).join(caps, "container_kind").where("n > c").groupBy("container_kind").agg(F.count("*").alias("n_overfull"))
    docs = packed.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).join(caps, "container_kind")
    per = docs.groupBy("container_kind").agg(F.count("*").alias("n_docs"), F.sum(F.when((F.col("n") <= F.col("c")) & (F.col("k") > 1), 1).otherwise(0)).alias("n_needless"))
    return per.join(load, "container_kind", "left").fillna(0, ["n_overfull"])


def p8_mix(spark, d):
    sizes = _sizes(spark, d, "source")
    return mix(sizes, budgets(sizes, table(spark, d, "mix_targets")))


def p8_report(spark, d):
    sizes = _sizes(spark, d, "source")
    plan = materialise(budgets(sizes, table(spark, d, "mix_targets")), "mix-plan")
    return mix_report(mix(sizes, plan), plan)


def p8_promises(spark, d):
    """Per target source that has text: whether no document appears too often, and tokens differ from the budget by half of the
    source's largest document at most, which is what whole documents allow."""
    sizes = _sizes(spark, d, "source")
    plan = materialise(budgets(sizes, table(spark, d, "mix_targets")), "mix-plan")
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    r = mix_report(mix(sizes, plan), plan).where("size > 0").join(largest, "source")
    return r.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_limit"), (2 * F.abs(F.col("tokens") - F.col("budget")) <= F.col("largest")).alias("on_target"))


QUERIES = {"p1_found": p1_found, "p1_nearest_click": p1_nearest_click, "p4_found": p4_found, "p4_links": p4_links, "p5_found": p5_found, "p7_pack": p7_pack, "p7_report": p7_report, "p7_promises": p7_promises, "p8_mix": p8_mix, "p8_report": p8_report, "p8_promises": p8_promises, "p9_found": p9_found, "p9_segments": p9_segments}
_EVENTS = "(SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = '{0}')"
ORACLE: dict[str, str] = {
    "p1_nearest_click": f"""SELECT v.event_id AS view_id, min_by(p.event_id, (abs(p.t - v.t), p.t, p.event_id)) AS purchase_id FROM {_EVENTS.format('view')} v
JOIN {_EVENTS.format('purchase')} p ON v.user_id = p.user_id AND abs(p.t - v.t) <= 172800000000 GROUP BY 1""",
    "p7_promises": "SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, 0 AS n_needless, 0 AS n_overfull FROM container_spec",
    "p8_promises": "SELECT source, true AS within_limit, true AS on_target FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE length(text) > 0)",
}
