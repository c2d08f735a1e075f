"""Further queries over all areas: filters, defaults, rankings, merges, classifiers and iterative helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideloom.operators import drift as D
from tideloom.operators import graph as G
from tideloom.operators import records as R
from tideloom.operators import sequences as Z
from tideloom.plans.graphs import _BASE, _nodes, _pairs
from tideloom.sources.tables import table as T

Q, S = {}, {}


def reg(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@reg("pf15_skip_patterns", "SELECT DISTINCT page_title FROM documents WHERE page_title IS NOT NULL AND NOT regexp_matches(page_title, '(?i)proposal|noticeboard|/')")
def _(s, d):
    return T(s, d, "documents", "page_title").where(F.col("page_title").isNotNull() & ~F.col("page_title").rlike("(?i)proposal|noticeboard|/")).distinct()


@reg("pf19_hosts", "SELECT DISTINCT url FROM candidate WHERE regexp_extract(url, '^https?://([^/?#]+)', 1) = 'example.org' OR regexp_extract(url, '^https?://([^/?#]+)', 1) LIKE '%.example.org'")
def _(s, d):
    host = F.expr("parse_url(nullif(url, ''), 'HOST')")
    return T(s, d, "candidate", "url").where((host == "example.org") | host.endswith(".example.org")).distinct()


@reg("j16_default", "SELECT c.c_custkey, coalesce(n.n_name, '?') AS n_name FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c.c_nationkey = n.n_nationkey")
def _(s, d):
    n = T(s, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return T(s, d, "customer", "c_custkey", "c_nationkey").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("?")).alias("n_name"))


@reg("j21_containment", "SELECT DISTINCT p.p_partkey, w.w FROM part p JOIN (VALUES ('ring'), ('widget'), ('blue small ring of part')) w(w) ON contains(p.p_name, w.w) OR contains(w.w, p.p_name)")
def _(s, d):
    return T(s, d, "part", "p_partkey", "p_name").select("p_partkey", F.explode(R.contained_in(F.col("p_name"), ["ring", "widget", "blue small ring of part"])).alias("w")).distinct()


@reg("ag14_last_value_pivot", "SELECT user_id, " + ", ".join(f"max_by(value, event_id) FILTER (event_type = '{c}') AS c_{c}" for c in ("view", "click")) + " FROM events GROUP BY 1")
def _(s, d):
    last = lambda c: F.max_by(F.when(F.col("event_type") == c, F.col("value")), F.when(F.col("event_type") == c, F.col("event_id"))).alias(f"c_{c}")
    return T(s, d, "events", "user_id", "event_id", "event_type", "value").groupBy("user_id").agg(last("view"), last("click"))


@reg("ag20_named_aggs", "SELECT wiki, count(*) AS n, round(avg(CASE WHEN is_redirect THEN 1.0 ELSE 0.0 END), 6) AS redirect_share, round(avg(namespace), 6) AS mean_ns FROM node GROUP BY 1")
def _(s, d):
    return T(s, d, "node", "wiki", "is_redirect", "namespace").groupBy("wiki").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("is_redirect"), 1.0).otherwise(0.0)), 6).alias("redirect_share"), F.round(F.avg("namespace"), 6).alias("mean_ns"))


@reg("ag23_nunique", "SELECT wiki, count(DISTINCT page_id) AS pages, count(DISTINCT title) AS titles, count(DISTINCT year) AS years FROM node GROUP BY 1")
def _(s, d):
    n = lambda c: F.count_distinct(c)
    return T(s, d, "node", "wiki", "page_id", "title", "year").groupBy("wiki").agg(n("page_id").alias("pages"), n("title").alias("titles"), n("year").alias("years"))


@reg("ag26_coverage", "SELECT 'start' AS field, count(conference_start) AS good, count(*) AS relevant FROM edition_index UNION ALL SELECT 'end', count(conference_end), count(*) FILTER (conference_start IS NOT NULL) FROM edition_index UNION ALL SELECT 'confidence', count(date_confidence), count(*) FROM edition_index")
def _(s, d):
    e = T(s, d, "edition_index")
    cells = F.array(
        F.struct(F.lit("start").alias("field"), F.col("conference_start").isNotNull().alias("ok"), F.lit(True).alias("rel")), F.struct(F.lit("end").alias("field"), F.col("conference_end").isNotNull().alias("ok"), F.col("conference_start").isNotNull().alias("rel")),
        F.struct(F.lit("confidence").alias("field"), F.col("date_confidence").isNotNull().alias("ok"), F.lit(True).alias("rel")),
    )
    n = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    return e.select(F.explode(cells).alias("x")).select("x.*").groupBy("field").agg(n("ok").alias("good"), n("rel").alias("relevant"))


@reg("ag28_flagged_share", "SELECT source, round(100.0 * sum(CASE WHEN lang IN ('mul', 'und') THEN length(text) ELSE 0 END) / sum(length(text)), 4) AS percent FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING sum(length(text)) > 0")
def _(s, d):
    n = F.length("text").cast("long")
    g = T(s, d, "documents", "source", "lang", "text").where("source IS NOT NULL").groupBy("source").agg(F.sum(F.when(F.col("lang").isin("mul", "und"), n).otherwise(0)).alias("a"), F.sum(n).alias("b")).where("b > 0")
    return g.select("source", F.round(100.0 * F.col("a") / F.col("b"), 4).alias("percent"))


@reg("ag33_best_with_default", "SELECT c.c_custkey, coalesce(max_by(o.o_orderpriority, (o.o_totalprice, o.o_orderkey)), 'none') AS best FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def _(s, d):
    best = T(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("best"))
    return T(s, d, "customer", "c_custkey").join(best, "c_custkey", "left").fillna("none", ["best"])


@reg("ag37_purity", "WITH g AS (SELECT c_nationkey AS comm, c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1, 2), m AS (SELECT comm, max(n) AS top, sum(n) AS size FROM g GROUP BY 1) SELECT round(sum(top) / sum(size), 6) AS purity FROM m")
def _(s, d):
    g = T(s, d, "customer", "c_nationkey", "c_mktsegment").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return g.groupBy("c_nationkey").agg(F.max("n").alias("top"), F.sum("n").alias("size")).agg(F.round(F.sum("top") / F.sum("size"), 6).alias("purity"))


@reg("ag38_build_summary", "SELECT wiki, year, count(*) FILTER (confidence = 'confirmed') AS n_confirmed, count(*) FILTER (confidence = 'suspect') AS n_suspect, count(nullif(wikidata_qid, '')) AS n_qid FROM node GROUP BY 1, 2")
def _(s, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return T(s, d, "node", "wiki", "year", "confidence", "wikidata_qid").groupBy("wiki", "year").agg(n(F.col("confidence") == "confirmed").alias("n_confirmed"), n(F.col("confidence") == "suspect").alias("n_suspect"), n(F.col("wikidata_qid") != "").alias("n_qid"))


@reg("w11_greedy_batches", """WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY list_name ORDER BY msg_id, n) AS k FROM (SELECT list_name, msg_id, max(length(body))::INTEGER AS n FROM parse_messages WHERE body IS NOT NULL GROUP BY 1, 2)),
r AS (SELECT list_name, msg_id, n, k, 1 AS batch_no, n AS load FROM m WHERE k = 1 UNION ALL SELECT m.list_name, m.msg_id, m.n, m.k, CASE WHEN r.load > 0 AND r.load + m.n > 18000 THEN r.batch_no + 1 ELSE r.batch_no END, CASE WHEN r.load > 0 AND r.load + m.n > 18000 THEN m.n ELSE r.load + m.n END FROM r JOIN m ON m.list_name IS NOT DISTINCT FROM r.list_name AND m.k = r.k + 1)
SELECT list_name, msg_id, n, batch_no FROM r""")
def _(s, d):
    m = T(s, d, "parse_messages", "list_name", "msg_id", "body").where("body IS NOT NULL").groupBy("list_name", "msg_id").agg(F.max(F.length("body")).alias("n"))
    return Z.greedy_batches(m, "list_name", "msg_id", "n", 18_000)


@reg("w14_apart", """WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL), c AS (SELECT * FROM (SELECT r, doc_id, i::INTEGER AS start, len(regexp_extract_all(lower(substr(text, i + 1, 600)), 'consensus|vote'))::INTEGER AS score FROM (SELECT *, unnest(generate_series(0, greatest(length(text) - 1, 0), 250)) AS i FROM d)) WHERE score > 0),
a AS (SELECT r, max_by(start, (score, -start)) AS s1 FROM c GROUP BY 1), b AS (SELECT c.r, any_value(s1) AS s1, max_by(start, (score, -start)) AS s2 FROM c JOIN a USING (r) WHERE abs(start - s1) >= 300 GROUP BY 1), e AS (SELECT c.r, max_by(start, (score, -start)) AS s3 FROM c JOIN b USING (r) WHERE abs(start - s1) >= 300 AND abs(start - s2) >= 300 GROUP BY 1),
x AS (SELECT r, s1 AS start FROM a UNION ALL SELECT r, s2 FROM b UNION ALL SELECT r, s3 FROM e) SELECT doc_id, score, start FROM c JOIN x USING (r, start)""")
def _(s, d):
    w = T(s, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", D.text_windows(F.col("text"), 600, 250).alias("ws"))
    scored = F.transform("ws", lambda x: F.struct(F.size(F.regexp_extract_all(F.lower(x.text), F.lit("consensus|vote"), F.lit(0))).alias("score"), x.start.alias("start")))
    return w.select("doc_id", F.explode(Z.apart(F.filter(scored, lambda x: x.score > 0), 300, 3)).alias("p")).select("doc_id", "p.score", "p.start")


@reg("w16_renumber", "SELECT wiki, year, dense_rank() OVER (ORDER BY wiki, year)::INTEGER AS no, sum(n) OVER (ORDER BY wiki, year)::BIGINT AS running FROM (SELECT wiki, year, count(*) AS n FROM node GROUP BY 1, 2)")
def _(s, d):
    g = T(s, d, "node", "wiki", "year").groupBy("wiki", "year").agg(F.count("*").alias("n"))
    w = Window.orderBy("wiki", "year")  # one row a section
    return g.select("wiki", "year", F.dense_rank().over(w).alias("no"), F.sum("n").over(w).alias("running"))


@reg("w17_first_number", "SELECT DISTINCT doi, min(cand_id) OVER (PARTITION BY doi) AS no FROM candidate WHERE doi <> ''")
def _(s, d):
    return T(s, d, "candidate", "cand_id", "doi").where("doi <> ''").groupBy("doi").agg(F.min("cand_id").alias("no"))


@reg("tk07_both_ends", "(SELECT 'head' AS part, title FROM (SELECT DISTINCT title FROM node WHERE title IS NOT NULL) ORDER BY encode(title) LIMIT 20) UNION ALL (SELECT 'tail', title FROM (SELECT DISTINCT title FROM node WHERE title IS NOT NULL) ORDER BY encode(title) DESC LIMIT 8)")
def _(s, d):
    t = T(s, d, "node", "title").where("title IS NOT NULL").distinct()
    return t.orderBy("title").limit(20).select(F.lit("head").alias("part"), "title").unionAll(t.orderBy(F.desc("title")).limit(8).select(F.lit("tail"), "title"))


@reg("tk12_recent", "SELECT page_title, doc_id FROM (SELECT page_title, doc_id, row_number() OVER (PARTITION BY page_title ORDER BY rev_ts DESC, doc_id) AS r FROM documents WHERE page_title IS NOT NULL AND rev_ts >= TIMESTAMP '2015-01-01') WHERE r <= 5")
def _(s, d):
    r = T(s, d, "documents", "page_title", "doc_id", "rev_ts").where("page_title IS NOT NULL AND rev_ts >= TIMESTAMP_NTZ'2015-01-01 00:00:00'")
    return r.withColumn("r", F.row_number().over(Window.partitionBy("page_title").orderBy(F.desc("rev_ts"), "doc_id"))).where("r <= 5").select("page_title", "doc_id")


@reg("u11_protective_merge", "SELECT fig_id, true AS kept FROM (SELECT DISTINCT fig_id FROM wikimania_2017 WHERE verified) UNION ALL SELECT DISTINCT fig_id, false FROM wikimania_2017 WHERE coalesce(verified, false) = false AND source_url NOT IN (SELECT source_url FROM wikimania_2017 WHERE verified AND source_url IS NOT NULL)")
def _(s, d):
    f = T(s, d, "wikimania_2017", "fig_id", "source_url", "verified")
    kept = f.where("verified")
    rest = f.where("NOT coalesce(verified, false) AND source_url IS NOT NULL").join(kept.select("source_url").distinct(), "source_url", "left_anti")
    return kept.select("fig_id").distinct().withColumn("kept", F.lit(True)).unionByName(rest.select("fig_id").distinct().withColumn("kept", F.lit(False)))


@reg("u13_confirmed_else_last", "SELECT edition, coalesce(min_by(conference_start, edition_id) FILTER (date_confidence = 'confirmed'), max_by(conference_start, edition_id)) AS chosen FROM edition_index WHERE conference_start IS NOT NULL GROUP BY 1")
def _(s, d):
    sure = F.col("date_confidence") == "confirmed"
    e = T(s, d, "edition_index", "edition", "edition_id", "conference_start", "date_confidence").where("conference_start IS NOT NULL").groupBy("edition")
    return e.agg(F.coalesce(F.min_by(F.when(sure, F.col("conference_start")), F.when(sure, F.col("edition_id"))), F.max_by("conference_start", "edition_id")).alias("chosen"))


@reg("u14_override_chain", "SELECT c.cand_id, coalesce(min(b.year), min(a.year), min(c.year)) AS year FROM candidate c LEFT JOIN (SELECT title, year FROM crossref_work) a ON a.title = c.title LEFT JOIN (SELECT doi, year FROM crossref_work) b ON b.doi = c.doi GROUP BY 1")
def _(s, d):
    w = T(s, d, "crossref_work", "title", "doi", "year")
    c = T(s, d, "candidate", "cand_id", "title", "doi", "year")
    a = w.where("title IS NOT NULL").groupBy("title").agg(F.min("year").alias("ya"))
    b = w.where("doi IS NOT NULL").groupBy("doi").agg(F.min("year").alias("yb"))
    return c.join(a, "title", "left").join(b, "doi", "left").groupBy("cand_id").agg(F.coalesce(F.min("yb"), F.min("ya"), F.min("year")).alias("year"))


@reg("u15_distinct_links", "SELECT wiki, year, from_page, count(*) AS n FROM (SELECT DISTINCT wiki, year, from_page, to_ns, to_title FROM link) GROUP BY 1, 2, 3")
def _(s, d):
    return T(s, d, "link", "wiki", "year", "from_page", "to_ns", "to_title").distinct().groupBy("wiki", "year", "from_page").agg(F.count("*").alias("n"))


@reg("u21_section_upsert", "SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM (SELECT edition AS k, min(location) AS v FROM edition_index WHERE year < 2018 GROUP BY 1) o FULL JOIN (SELECT edition AS k, max(location) AS v FROM edition_index WHERE year >= 2017 GROUP BY 1) n ON o.k = n.k")
def _(s, d):
    e = T(s, d, "edition_index", "edition", "location", "year")
    o = e.where("year < 2018").groupBy(F.col("edition").alias("k")).agg(F.min("location").alias("ov"))
    n = e.where("year >= 2017").groupBy(F.col("edition").alias("k")).agg(F.max("location").alias("nv"))
    return o.join(n, "k", "full_outer").select("k", F.coalesce("nv", "ov").alias("v"))


@reg("u23_expected_present", "SELECT r.wiki, r.year, n.wiki IS NOT NULL AS present FROM (SELECT * FROM (SELECT DISTINCT wiki FROM node), (SELECT DISTINCT year FROM node)) r LEFT JOIN (SELECT DISTINCT wiki, year FROM node) n USING (wiki, year)")
def _(s, d):
    n = T(s, d, "node", "wiki", "year").distinct()
    spine = n.select("wiki").distinct().join(n.select("year").distinct(), F.lit(True))  # sites by years, both few
    return spine.join(n.withColumn("present", F.lit(True)), ["wiki", "year"], "left").fillna(False, ["present"])


@reg("f12_html_lines", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def _(s, d):
    """Pages of paragraphs and line breaks come out as the lines they were made of."""
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<style>p {}</style><div><p>"), F.regexp_replace(F.regexp_replace(esc, "\n\n", "</p><p>"), "\n", "<br/>"), F.lit("</p></div>"))
    return T(s, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.md5(D.strip_html(page)).alias("digest"))


@reg("f18_templates", "SELECT CASE WHEN regexp_matches(lower(text), 'guideline|policy') THEN 'core' WHEN contains(lower(text), 'essay') THEN 'essay' ELSE 'none' END AS tier, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(s, d):
    t = F.lower("text")
    rules = [("core", t.rlike("guideline|policy")), ("essay", F.contains(t, F.lit("essay"))), ("none", F.lit(True))]
    return R.first_rule(T(s, d, "documents", "text").where("text IS NOT NULL"), rules, "tier").groupBy("tier").agg(F.count("*").alias("n"))


@reg("f22_doi", "SELECT DISTINCT cand_id, lower(regexp_replace(doi, '^(https?://(dx\\.)?doi\\.[a-z.]+/|doi:)', '')) AS doi FROM candidate WHERE doi <> ''")
def _(s, d):
    return T(s, d, "candidate", "cand_id", "doi").where("doi <> ''").select("cand_id", F.lower(F.regexp_replace("doi", r"^(https?://(dx\.)?doi\.[a-z.]+/|doi:)", "")).alias("doi")).distinct()


@reg("f25_citekey_validity", "SELECT regexp_matches(k, '^[a-z][a-z0-9]+\\d{4}[a-z][a-z0-9]*$') AS valid, count(*) AS n FROM (SELECT work_id, lower(coalesce(authors[1].family, '')) || coalesce(year, 0) || lower(split_part(title, ' ', 1)) AS k FROM crossref_work) GROUP BY 1")
def _(s, d):
    k = F.concat(F.lower(F.coalesce(F.get(F.col("authors"), F.lit(0))["family"], F.lit(""))), F.coalesce("year", F.lit(0)).cast("string"), F.lower(F.split_part("title", F.lit(" "), F.lit(1))))
    return T(s, d, "crossref_work", "work_id", "title", "authors", "year").groupBy(k.rlike(r"^[a-z][a-z0-9]+\d{4}[a-z][a-z0-9]*$").alias("valid")).agg(F.count("*").alias("n"))


@reg("f26_subjects", "SELECT DISTINCT msg_id, trim(regexp_replace(regexp_replace(lower(subject), '\\[[^\\]]*\\]|\\b(re|fwd|aw|sv)\\s*:', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM parse_messages WHERE subject IS NOT NULL")
def _(s, d):
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower("subject"), r"\[[^\]]*\]|\b(re|fwd|aw|sv)\s*:", " "), r"\s+", " "))
    return T(s, d, "parse_messages", "msg_id", "subject").where("subject IS NOT NULL").select("msg_id", t.alias("norm")).distinct()


@reg("d04_month_windows", "SELECT c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderdate >= DATE '1998-06-01' - INTERVAL 9 MONTH AND o.o_orderdate < DATE '1998-06-01' + INTERVAL 2 MONTH GROUP BY 1")
def _(s, d):
    o = T(s, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").where("o_orderdate >= add_months(DATE'1998-06-01', -9) AND o_orderdate < add_months(DATE'1998-06-01', 2)")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return T(s, d, "customer", "c_custkey").join(per, "c_custkey", "left").fillna(0, ["n"])


@reg("d11_age_days", "SELECT DISTINCT doc_id, datediff('day', rev_ts::DATE, DATE '2026-01-01')::INTEGER AS age FROM documents WHERE rev_ts IS NOT NULL")
def _(s, d):
    return T(s, d, "documents", "doc_id", "rev_ts").where("rev_ts IS NOT NULL").select("doc_id", F.datediff(F.lit("2026-01-01").cast("date"), F.to_date("rev_ts")).alias("age")).distinct()


@reg("a01_multiset_difference", "SELECT a.wiki, sum(greatest(a.n - coalesce(b.n, 0), 0))::BIGINT AS more FROM (SELECT wiki, to_ns, count(*) AS n FROM link WHERE year = 2021 GROUP BY 1, 2) a LEFT JOIN (SELECT wiki, to_ns, count(*) AS n FROM link WHERE year = 2020 GROUP BY 1, 2) b USING (wiki, to_ns) GROUP BY 1")
def _(s, d):
    # both years in one scan and one shuffle
    g = T(s, d, "link", "wiki", "year", "to_ns").where("year IN (2020, 2021)").groupBy("wiki", "to_ns").agg(F.sum(F.when(F.col("year") == 2021, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("year") == 2020, 1).otherwise(0)).alias("b"))
    return g.where("a > 0").groupBy("wiki").agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("more"))


@reg("a06_json_get", "SELECT event_type, sum(coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0))::BIGINT AS total, count(*) FILTER (json_extract(props, '$.none') IS NULL) AS absent FROM events GROUP BY 1")
def _(s, d):
    x = F.from_json("props", "k bigint, none string")
    return T(s, d, "events", "event_type", "props").select("event_type", x.alias("x")).groupBy("event_type").agg(F.sum(F.coalesce("x.k", F.lit(0))).alias("total"), F.sum(F.when(F.col("x.none").isNull(), 1).otherwise(0)).alias("absent"))


@reg("a09_key_values", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS k, split_part(o_orderpriority, '-', 2) AS v FROM orders")
def _(s, d):
    m = F.map_entries(F.str_to_map("o_orderpriority", F.lit(";"), F.lit("-")))[0]
    return T(s, d, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", m["key"].alias("k"), m["value"].alias("v"))


@reg("a11_nested_rewrite", "SELECT DISTINCT work_id, len(list_filter(authors, lambda a: length(a.family) > 8)) > 0 AS any_long, len(list_filter(authors, lambda a: length(a.family) > 8))::INTEGER AS n_long FROM crossref_work WHERE authors IS NOT NULL")
def _(s, d):
    marked = F.transform("authors", lambda a: a.withField("long", F.length(a.family) > 8))
    w = T(s, d, "crossref_work", "work_id", "authors").where("authors IS NOT NULL").select("work_id", marked.alias("m"))
    return w.select("work_id", F.exists("m", lambda a: a["long"]).alias("any_long"), F.size(F.filter("m", lambda a: a["long"])).alias("n_long")).distinct()


@reg("tx08_theme", "SELECT CASE WHEN regexp_matches(lower(title), 'quality|reliability') THEN 'quality' WHEN regexp_matches(lower(title), 'retention|onboarding') THEN 'people' ELSE 'other' END AS theme, count(DISTINCT work_id) AS n FROM crossref_work GROUP BY 1")
def _(s, d):
    t = F.lower("title")
    rules = [("quality", t.rlike("quality|reliability")), ("people", t.rlike("retention|onboarding")), ("other", F.lit(True))]
    return R.first_rule(T(s, d, "crossref_work", "work_id", "title"), rules, "theme").groupBy("theme").agg(F.count_distinct("work_id").alias("n"))


@reg("gr06_density", f"{_BASE}, x AS (SELECT id FROM n WHERE wiki <> 'dewiki'), ux AS (SELECT * FROM u WHERE a IN (SELECT id FROM x) AND b IN (SELECT id FROM x)) SELECT round((SELECT count(*) FROM u) / (SELECT count(*) FROM n), 6) AS mean_degree, round((SELECT count(*) FROM ux) / (SELECT count(*) FROM x), 6) AS without")
def _(s, d):
    n, u = _nodes(s, d), _pairs(s, d)
    x = n.where("wiki <> 'dewiki'")
    one = lambda pairs, nodes, name: pairs.agg(F.count("*").alias("e")).join(nodes.agg(F.count("*").alias("v")), F.lit(True)).select(F.round(F.col("e") / F.col("v"), 6).alias(name))
    return one(u, n, "mean_degree").join(one(G.known_ends(u, x, "a", "b", "id"), x, "without"), F.lit(True))


@reg("st03_null_model")
def _(s, d):
    pairs = _pairs(s, d).withColumn("g", F.expr("a div 1000000000"))
    hub = lambda e: e.groupBy("a").agg(F.count("*").alias("k")).agg(F.sum(F.when(F.col("k") >= 3, 1).otherwise(0)).alias("v"))
    null = G.rewire(pairs, "g", "a", "b", 500, hubs=3).groupBy("rep").agg(F.sum("v").alias("v"))  # a node is in one group
    return Z.empirical_test(hub(pairs.where("a < b")), null, [], "v")


@reg("st04_feature_weights")
def _(s, d):
    w = T(s, d, "crossref_work", "work_id", "title", "type").dropDuplicates(["work_id"])
    return Z.feature_weights(w.select(D.content_words(F.col("title"), ["the", "and"]).alias("fs"), (F.col("type") == "journal-article").alias("y")), "fs", "y")


@reg("x01_cidr", "SELECT p AS cidr, CASE WHEN contains(p, '/') THEN pow(2, 32 - CAST(split_part(p, '/', 2) AS INTEGER))::BIGINT ELSE 1 END AS n FROM (VALUES ('10.0.0.0/8'), ('10.1.2.3'), ('10.0.0.0/32'), ('1.0.0.0/0')) v(p)")
def _(s, d):
    v = s.createDataFrame([("10.0.0.0/8",), ("10.1.2.3",), ("10.0.0.0/32",), ("1.0.0.0/0",)], "cidr string")
    return v.withColumn("n", Z.cidr_size(F.col("cidr")))


@reg("x03_change_points", """WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y%m') AS ym, avg(o_totalprice) / 100000 AS v FROM orders GROUP BY 1, 2), p AS (SELECT *, row_number() OVER w AS k, sum(v) OVER w AS s, count(*) OVER (PARTITION BY o_orderpriority) AS n, sum(v) OVER (PARTITION BY o_orderpriority) AS t FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY ym)),
g AS (SELECT *, round(s * s / k + (t - s) * (t - s) / (n - k) - t * t / n, 6) AS gain FROM p WHERE k < n) SELECT o_orderpriority, max_by(ym, (gain, -k)) AS last_before, round(max(gain), 4) AS gain FROM g GROUP BY 1""")
def _(s, d):
    m = T(s, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyyMM").alias("ym")).agg((F.avg("o_totalprice") / 100_000).alias("v"))
    return Z.change_points(m, ["o_orderpriority"], "ym", "v").withColumn("gain", F.round("gain", 4))


QUERIES, ORACLE = Q, S
