"""Queries of area A (edit histories) and of generic relational operators on the event and order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideloom.functions.timestamps import compact_utc
from tideloom.operators import history as H
from tideloom.operators.timestamps import feed_instants
from tideloom.session import materialise
from tideloom.sources.tables import table as T

Q, S = {}, {}


def reg(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@reg("sc01_scan_project", "SELECT event_id AS id, user_id AS actor, event_type AS kind FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def _(s, d):
    return T(s, d, "events").where("ts >= TIMESTAMP_NTZ'2024-01-10 00:00:00' AND ts < TIMESTAMP_NTZ'2024-01-20 00:00:00'").select(F.col("event_id").alias("id"), F.col("user_id").alias("actor"), F.col("event_type").alias("kind"))


@reg("pf02_not_in_list", "SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN ('NATION_1', 'NATION_3')")
def _(s, d):
    return T(s, d, "nation", "n_nationkey", "n_name").where(~F.col("n_name").isin("NATION_1", "NATION_3"))


@reg("pf04_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def _(s, d):
    keys = T(s, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return T(s, d, "orders", "o_orderkey", "o_custkey").join(keys, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@reg("pf05_row_value_in", "SELECT DISTINCT l.wiki, l.to_ns, l.to_title FROM link l WHERE (l.to_ns, l.to_title) IN (SELECT namespace, title FROM node WHERE year = 2020)")
def _(s, d):
    pairs = T(s, d, "node", "namespace", "title", "year").where("year = 2020").select("namespace", "title")
    return T(s, d, "link", "wiki", "to_ns", "to_title").join(pairs, (F.col("to_ns") == F.col("namespace")) & (F.col("to_title") == F.col("title")), "left_semi").distinct()


@reg("pf06_like", "SELECT DISTINCT page_title FROM rfc_opens WHERE page_title LIKE '%_of_%'")
def _(s, d):
    return T(s, d, "rfc_opens", "page_title").where(F.col("page_title").like("%_of_%")).distinct()


@reg("pf07_regexp", "SELECT DISTINCT close_rev_id, close_comment FROM rfc_human_closes WHERE regexp_matches(lower(close_comment), 'no consensus|withdrawn|rm tag')")
def _(s, d):
    return T(s, d, "rfc_human_closes", "close_rev_id", "close_comment").where(F.lower("close_comment").rlike("no consensus|withdrawn|rm tag")).distinct()


@reg("pf08_string_range", "SELECT DISTINCT close_rev_id, close_ts FROM rfc_human_closes WHERE close_ts >= '20150101000000' AND close_ts < '20160101000000'")
def _(s, d):
    return T(s, d, "rfc_human_closes", "close_rev_id", "close_ts").where("close_ts >= '20150101000000' AND close_ts < '20160101000000'").distinct()


@reg("pf11_case_label", "SELECT CASE WHEN event_type = 'error' THEN 'bad' WHEN value > 50 THEN 'large' ELSE 'plain' END AS label, 'events' AS origin, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    label = F.when(F.col("event_type") == "error", "bad").when(F.col("value") > 50, "large").otherwise("plain")
    return T(s, d, "events", "event_type", "value").groupBy(label.alias("label"), F.lit("events").alias("origin")).agg(F.count("*").alias("n"))


@reg("pf12_drop_all_null", "SELECT DISTINCT fig_id FROM wikimania_2017 WHERE email_date IS NOT NULL OR archive_tz IS NOT NULL OR figure_numeric IS NOT NULL")
def _(s, d):
    return T(s, d, "wikimania_2017", "fig_id", "email_date", "archive_tz", "figure_numeric").na.drop(how="all", subset=["email_date", "archive_tz", "figure_numeric"]).select("fig_id").distinct()


@reg("pf14_keywords", "SELECT DISTINCT msg_id FROM parse_messages WHERE contains(lower(coalesce(subject, '') || ' ' || coalesce(body, '')), 'deadline') OR contains(lower(coalesce(subject, '') || ' ' || coalesce(body, '')), 'scholarship')")
def _(s, d):
    text = F.lower(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))))
    words = F.array(F.lit("deadline"), F.lit("scholarship"))
    return T(s, d, "parse_messages", "msg_id", "subject", "body").where(F.exists(words, lambda w: F.contains(text, w))).select("msg_id").distinct()


@reg("pf17_worklist", "SELECT DISTINCT cand_id FROM candidate c WHERE strategy NOT IN ('S5_topic') AND NOT EXISTS (SELECT 1 FROM crossref_work w WHERE lower(w.doi) = lower(c.doi))")
def _(s, d):
    done = T(s, d, "crossref_work", "doi").select(F.lower("doi").alias("k")).distinct()
    return T(s, d, "candidate", "cand_id", "strategy", "doi").where("strategy <> 'S5_topic'").join(done, F.lower("doi") == F.col("k"), "left_anti").select("cand_id").distinct()


@reg("pf18_plausible_year", "SELECT DISTINCT edition_id, year FROM edition_index WHERE try_cast(substr(conference_start, 1, 4) AS INTEGER) BETWEEN year - 1 AND year")
def _(s, d):
    return T(s, d, "edition_index").where(F.substring("conference_start", 1, 4).try_cast("int").between(F.col("year") - 1, F.col("year"))).select("edition_id", "year").distinct()


@reg("j01_inner_chain", """SELECT n.n_name, o.o_orderpriority, count(*) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2""")
def _(s, d):
    li, o = T(s, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount"), T(s, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    # lines are summed per order before anything else moves
    per = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    c, n = T(s, d, "customer", "c_custkey", "c_nationkey"), T(s, d, "nation", "n_nationkey", "n_name")
    rows = per.join(o, per.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.groupBy("n_name", "o_orderpriority").agg(F.sum("n").alias("n"), F.round(F.sum("r"), 2).alias("revenue"))


@reg("j02_anti_join", "SELECT user_id, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 90) b WHERE b.user_id = e.user_id) GROUP BY 1")
def _(s, d):
    ev = T(s, d, "events", "user_id", "event_type", "value")
    return H.without(ev, ev.where("event_type = 'error' AND value > 90"), "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


_TAGS = "SELECT l_orderkey AS o_orderkey, l_returnflag AS tag FROM lineitem"


@reg("j03_tag_fanout", f"SELECT o.o_orderpriority, count(*) AS n, sum(CASE WHEN t.tag = 'R' THEN 1 ELSE 0 END)::BIGINT AS n_flagged FROM orders o LEFT JOIN ({_TAGS}) t USING (o_orderkey) GROUP BY 1")
def _(s, d):
    tags = T(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("tag"))
    rows = H.tag_flag(T(s, d, "orders", "o_orderkey", "o_orderpriority"), tags, "o_orderkey", "tag", "R", True)
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("flag").cast("long")).alias("n_flagged"))


@reg("j03_tag_once", f"SELECT o.o_orderpriority, count(*) AS n, count(*) FILTER (o_orderkey IN (SELECT o_orderkey FROM ({_TAGS}) WHERE tag = 'R')) AS n_flagged FROM orders o GROUP BY 1")
def _(s, d):
    tags = T(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("tag"))
    rows = H.tag_flag(T(s, d, "orders", "o_orderkey", "o_orderpriority"), tags, "o_orderkey", "tag", "R", False)
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("flag").cast("long")).alias("n_flagged"))


_CLOSE = "SELECT DISTINCT close_rev_id, page_id, close_ts FROM rfc_human_closes WHERE regexp_matches(close_ts, '^[0-9]{14}$') AND try_strptime(close_ts, '%Y%m%d%H%M%S') IS NOT NULL"


def _opens(s, d):
    """The opens of all feeds with their instants, as p1_found has them; SQL can't read the eight habits, so these queries are tested by brute force. Opens without one instant have no row."""
    o = T(s, d, "rfc_opens", "open_rev_id", "page_id", "open_ts", "feed")
    when = feed_instants(o, T(s, d, "ts_feeds"))
    pages = o.select("open_rev_id", "page_id").distinct()
    return materialise(pages.join(when, F.col("open_rev_id") == F.col("rec_id")).select("open_rev_id", "page_id", F.col("utc_s").alias("open_s")), "opens")


def _closes(s, d):
    c = T(s, d, "rfc_human_closes", "close_rev_id", "page_id", "close_ts", "closer")
    return c.select("close_rev_id", "page_id", "closer", compact_utc("close_ts").alias("close_s")).where("close_s IS NOT NULL").distinct()


def _matched(s, d, opens=None):
    return H.next_event(opens if opens is not None else _opens(s, d), _closes(s, d), "page_id", "open_rev_id", "open_s", "close_rev_id", "close_s")


@reg("j06_next_close")
def _(s, d):
    return _matched(s, d)


@reg("j06_outcomes")
def _(s, d):
    m = _matched(s, d).withColumn("days", F.floor((F.col("close_s") - F.col("open_s")) / 86400))
    return m.groupBy(F.when(F.col("close_rev_id").isNull(), "open").otherwise("closed").alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("days"), 4).alias("mean_days"))


@reg("j07_participation")
def _(s, d):
    opens = _opens(s, d)
    windows = _matched(s, d, opens).join(opens.select("open_rev_id", "page_id"), "open_rev_id")
    edits = _closes(s, d).select(F.col("close_rev_id").alias("rev"), "page_id", "closer", F.col("close_s").alias("t"))
    rows = H.in_windows(windows, edits, "open_rev_id", "page_id", "open_s", "close_s", "t")
    return rows.groupBy("w.open_rev_id").agg(F.count("e.rev").alias("n_edits"), F.count_distinct("e.closer").alias("n_participants"), F.min_by("e.closer", F.struct("e.t", "e.rev")).alias("initiator"))


@reg("x06_comment_timing")
def _(s, d):
    opens = _opens(s, d)
    windows = _matched(s, d, opens).where("close_s IS NOT NULL").join(opens.select("open_rev_id", "page_id"), "open_rev_id")
    rows = H.in_windows(windows, _closes(s, d).select("close_rev_id", "page_id", F.col("close_s").alias("t")), "open_rev_id", "page_id", "open_s", "close_s", "t").where("e.t IS NOT NULL")
    x = rows.select(((F.col("e.t") - F.col("w.open_s")) / (F.col("w.close_s") - F.col("w.open_s"))).alias("x"))
    return x.agg(F.count("*").alias("n"), F.round(F.percentile("x", F.lit(0.5)), 4).alias("median"), F.round(F.avg("x"), 4).alias("mean"))


@reg("ag01_first_seen", "SELECT strftime(f, '%Y%m') AS ym, count(*) AS new_entities, sum(n)::BIGINT AS n_events, max(n) AS most_events FROM (SELECT o_custkey, min(o_orderdate) AS f, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def _(s, d):
    return H.first_seen_volume(T(s, d, "orders", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate")


@reg("ag02_spans", "SELECT user_id, event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    return H.spans(T(s, d, "events", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts")


@reg("ag03_conditional", "SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT l_suppkey) AS n_distinct, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS n_flagged, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*), 3) AS rate FROM lineitem GROUP BY 1")
def _(s, d):
    rows = T(s, d, "lineitem", "l_shipdate", "l_suppkey", "l_returnflag").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return H.conditional_counts(rows, ["day"], F.col("l_returnflag") == "R", "l_suppkey")


@reg("ag04_having", "SELECT c_custkey, c_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) >= 2")
def _(s, d):
    per = T(s, d, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).where("n >= 2")
    return per.join(T(s, d, "customer", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "n", "total")


_QU = "round(quantile_cont({v}, 0.25), 4) AS p25, round(quantile_cont({v}, 0.5), 4) AS median, round(quantile_cont({v}, 0.75), 4) AS p75"


@reg("ag05_quantiles", f"SELECT event_type, {_QU.format(v='value')}, round(avg(value), 4) AS mean, count(value) AS n FROM events GROUP BY 1")
def _(s, d):
    return H.quantile_table(T(s, d, "events", "event_type", "value"), ["event_type"], "value")


@reg("ag06_two_populations", f"SELECT process, {_QU.format(v='v')}, round(avg(v), 4) AS mean, count(v) AS n FROM (SELECT 'orders' AS process, o_totalprice AS v FROM orders UNION ALL SELECT 'lines', l_extendedprice FROM lineitem) GROUP BY 1")
def _(s, d):
    a = T(s, d, "orders").select(F.lit("orders").alias("process"), F.col("o_totalprice").alias("v"))
    return H.quantile_table(a.unionByName(T(s, d, "lineitem").select(F.lit("lines").alias("process"), F.col("l_extendedprice").alias("v"))), ["process"], "v")


@reg("ag07_describe", f"SELECT count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS lowest, {_QU.format(v='value')}, max(value) AS highest FROM events")
def _(s, d):
    return H.describe_numbers(T(s, d, "events", "value"), "value")


@reg("ag08_year_sums", "SELECT year(o_orderdate)::INTEGER AS year, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return T(s, d, "orders", "o_orderdate", "o_totalprice").groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


_PRI = ["view", "click", "error", "purchase", "signup"]


@reg("ag10_pivot", "SELECT user_id, " + ", ".join(f"round(coalesce(avg(CASE WHEN event_type = '{c}' THEN value END), 0), 6) AS c_{c}" for c in _PRI) + " FROM events GROUP BY 1")
def _(s, d):
    return H.pivot_mean(T(s, d, "events", "user_id", "event_type", "value"), "user_id", "event_type", "value", _PRI)


@reg("ag11_value_counts", "SELECT strategy, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, strategy)::INTEGER AS rank FROM candidate GROUP BY 1")
def _(s, d):
    c = T(s, d, "candidate", "strategy").groupBy("strategy").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "strategy")))


@reg("ag12_profiles", "SELECT closer, count(*) AS n, min(close_ts) AS first_ts, max(close_ts) AS last_ts FROM rfc_human_closes WHERE closer IS NOT NULL GROUP BY 1")
def _(s, d):
    return H.spans(T(s, d, "rfc_human_closes", "closer", "close_ts").where("closer IS NOT NULL"), ["closer"], "close_ts")


@reg("ag22_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 4) AS r, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 3 AND stddev_pop(l_quantity) > 0 AND stddev_pop(l_extendedprice) > 0")
def _(s, d):
    g = T(s, d, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 4).alias("r"), F.count("*").alias("n"), F.stddev_pop("l_quantity").alias("a"), F.stddev_pop("l_extendedprice").alias("b"))
    return g.where("n > 3 AND a > 0 AND b > 0").select("l_returnflag", "r", "n")


@reg("ag24_histogram", "SELECT least(29, floor((value - lo) / (hi - lo) * 30))::INTEGER AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1")
def _(s, d):
    ev = T(s, d, "events", "value")
    ends = ev.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 30
    return ev.crossJoin(F.broadcast(ends)).groupBy(F.least(F.lit(29), F.floor(x)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@reg("ag25_floor_percent", "SELECT wiki, status, n, (100 * n // sum(n) OVER (PARTITION BY wiki))::BIGINT AS percent FROM (SELECT wiki, coalesce(admitted_via, '?') AS status, count(*) AS n FROM node GROUP BY 1, 2)")
def _(s, d):
    g = T(s, d, "node", "wiki", "admitted_via").groupBy("wiki", F.coalesce("admitted_via", F.lit("?")).alias("status")).agg(F.count("*").alias("n"))
    return g.withColumn("t", F.sum("n").over(Window.partitionBy("wiki"))).select("wiki", "status", "n", F.expr("100 * n div t").alias("percent"))


@reg("ag34_by_year", "SELECT substr(close_ts, 1, 4) AS year, count(*) AS n FROM rfc_human_closes WHERE close_ts IS NOT NULL GROUP BY 1")
def _(s, d):
    return T(s, d, "rfc_human_closes", "close_ts").where("close_ts IS NOT NULL").groupBy(F.substring("close_ts", 1, 4).alias("year")).agg(F.count("*").alias("n"))


@reg("ag36_rollup", "SELECT coalesce(source_type, 'all') AS source_type, count(*) AS n, sum(CASE WHEN verified THEN 1 ELSE 0 END)::BIGINT AS n_verified, sum(CASE WHEN needs_review THEN 1 ELSE 0 END)::BIGINT AS n_review FROM wikimania_2017 WHERE source_type IS NOT NULL GROUP BY ROLLUP (source_type)")
def _(s, d):
    f = T(s, d, "wikimania_2017", "source_type", "verified", "needs_review").where("source_type IS NOT NULL").rollup("source_type")
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    return f.agg(F.count("*").alias("n"), one("verified").alias("n_verified"), one("needs_review").alias("n_review")).withColumn("source_type", F.coalesce("source_type", F.lit("all")))


@reg("w03_last_in_year", "SELECT wiki, page_title, year(rev_ts)::INTEGER AS year, max_by(doc_id, (rev_ts, doc_id)) AS doc_id FROM documents WHERE page_title IS NOT NULL GROUP BY 1, 2, 3")
def _(s, d):
    r = T(s, d, "documents", "wiki", "page_title", "rev_ts", "doc_id").where("page_title IS NOT NULL")
    return r.groupBy("wiki", "page_title", F.year("rev_ts").alias("year")).agg(F.max_by("doc_id", F.struct("rev_ts", "doc_id")).alias("doc_id"))


@reg("w04_as_of", "SELECT c.c_custkey, y.y::TIMESTAMP AS at, max_by(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) AS as_of_value FROM customer c CROSS JOIN (SELECT unnest([DATE '1997-01-01', DATE '1999-01-01']) AS y) y LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderdate <= y.y GROUP BY 1, 2")
def _(s, d):
    left = T(s, d, "customer", "c_custkey").withColumn("at", F.explode(F.expr("array(TIMESTAMP_NTZ'1997-01-01 00:00:00', TIMESTAMP_NTZ'1999-01-01 00:00:00')")))
    right = T(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return H.as_of(left, right, "c_custkey", "at", "o_orderdate", "o_orderkey")


@reg("w06_age", "SELECT wiki, page_id, year, (year - min(year) OVER (PARTITION BY wiki, page_id))::INTEGER AS age FROM (SELECT DISTINCT wiki, page_id, year FROM node)")
def _(s, d):
    n = T(s, d, "node", "wiki", "page_id", "year").distinct()
    return n.withColumn("age", (F.col("year") - F.min("year").over(Window.partitionBy("wiki", "page_id"))).cast("int"))


@reg("w08_quintile", "SELECT c_custkey, c_nationkey, least(4, ((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) * 5) // count(*) OVER (PARTITION BY c_nationkey))::INTEGER AS quintile FROM customer")
def _(s, d):
    return H.quintile(T(s, d, "customer", "c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], [F.col("c_acctbal"), F.col("c_custkey")]).drop("c_acctbal")


@reg("w15_islands", """WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS f FROM events), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run_no FROM a)
SELECT user_id, run_no, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM b GROUP BY 1, 2, 3""")
def _(s, d):
    return H.islands(T(s, d, "events", "user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@reg("w18_previous_duplicate", "SELECT msg_id, sender, lag(msg_id) OVER (PARTITION BY sender, subject ORDER BY msg_id) AS previous FROM (SELECT DISTINCT msg_id, sender, subject FROM parse_messages WHERE subject IS NOT NULL)")
def _(s, d):
    m = T(s, d, "parse_messages", "msg_id", "sender", "subject").where("subject IS NOT NULL").distinct()
    return m.select("msg_id", "sender", F.lag("msg_id").over(Window.partitionBy("sender", "subject").orderBy("msg_id")).alias("previous"))


@reg("tk03_top_n", "SELECT page_title, count(*) AS n FROM documents WHERE page_title IS NOT NULL GROUP BY 1 ORDER BY n DESC, page_title LIMIT 25")
def _(s, d):
    return T(s, d, "documents", "page_title").where("page_title IS NOT NULL").groupBy("page_title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "page_title").limit(25)


@reg("tk05_tiered_sort", "SELECT cand_id, strategy, year FROM (SELECT DISTINCT cand_id, strategy, year FROM candidate) ORDER BY CASE strategy WHEN 'S3_keyword' THEN 0 WHEN 'S2_forward' THEN 1 ELSE 9 END, year DESC NULLS LAST, cand_id LIMIT 50")
def _(s, d):
    tier = F.when(F.col("strategy") == "S3_keyword", 0).when(F.col("strategy") == "S2_forward", 1).otherwise(9)
    return T(s, d, "candidate", "cand_id", "strategy", "year").distinct().orderBy(tier, F.desc_nulls_last("year"), "cand_id").limit(50)


@reg("d01_calendar_days", "SELECT close_rev_id, datediff('day', DATE '2010-01-01', strptime(close_ts, '%Y%m%d%H%M%S')::DATE)::INTEGER AS days FROM (" + _CLOSE + ")")
def _(s, d):
    return _closes(s, d).select("close_rev_id", F.datediff(F.date_from_unix_date(F.floor(F.col("close_s") / 86400).cast("int")), F.lit("2010-01-01").cast("date")).alias("days")).distinct()


@reg("d03_months", "SELECT unnest(generate_series(DATE '2011-01-01', DATE '2026-06-01', INTERVAL 1 MONTH))::DATE::VARCHAR AS month")
def _(s, d):
    return H.month_spine(s, "2011-01-01", "2026-07-01").select(F.col("month").cast("string").alias("month"))


QUERIES, ORACLE = Q, S
