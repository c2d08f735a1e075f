"""Queries of areas B, C and D: reshaping, inversion, text drift, coverage and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideloom.functions.text import page_title
from tideloom.operators import drift as D
from tideloom.operators import reshape as R
from tideloom.sources.tables import table as T

Q, S = {}, {}


def reg(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


_YM = "strftime(o_orderdate, '%Y%m')"
_LONG = f"SELECT o_custkey AS actor_id, {_YM} AS ym, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1, 2"


def _long(s, d):
    o = T(s, d, "orders", "o_custkey", "o_orderdate").where("o_orderdate < TIMESTAMP_NTZ'1996-01-01 00:00:00'")
    return o.groupBy(F.col("o_custkey").alias("actor_id"), F.date_format("o_orderdate", "yyyyMM").alias("ym")).agg(F.count("*").alias("n"))


@reg("sc04_pack_unpack", f"SELECT actor_id, '20' || substr(ym, 3) AS ym, n FROM ({_LONG})")
def _(s, d):
    return R.unpack_counts(R.pack_counts(_long(s, d), "actor_id", "ym", "n"), "line")


_MONTHS = [f"1995{m:02d}" for m in range(1, 13)]


@reg("ag13_wide", "SELECT actor_id, " + ", ".join(f"coalesce(sum(CASE WHEN ym = '{m}' THEN n END), 0)::BIGINT AS m_{m}" for m in _MONTHS) + f" FROM ({_LONG}) GROUP BY 1")
def _(s, d):
    return R.long_to_wide(_long(s, d), "actor_id", "ym", "n", _MONTHS)


@reg("ag18_inverted", "SELECT wiki || ':' || from_page AS page, count(*) AS n, string_agg(to_title, ' | ' ORDER BY to_title) AS items FROM (SELECT DISTINCT wiki, from_page, to_title FROM link WHERE to_title IS NOT NULL AND from_page IS NOT NULL AND wiki IS NOT NULL) GROUP BY 1")
def _(s, d):
    return R.invert(T(s, d, "link", "wiki", "from_page", "to_title").select("to_title", F.concat("wiki", F.lit(":"), F.col("from_page").cast("string")).alias("page")), "to_title", "page")


@reg("w07_ranked", "SELECT to_title, n, row_number() OVER (ORDER BY n DESC, to_title)::INTEGER AS rank FROM (SELECT to_title, count(*) AS n FROM link WHERE to_title IS NOT NULL GROUP BY 1 ORDER BY n DESC, to_title LIMIT 40)")
def _(s, d):
    return R.ranked(T(s, d, "link", "to_title").where("to_title IS NOT NULL").groupBy("to_title").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("to_title")], 40)


@reg("w12_chunks", "SELECT chunk, count(*) AS n, min(c_custkey) AS lowest FROM (SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) // 50)::BIGINT AS chunk FROM customer) GROUP BY 1")
def _(s, d):
    n = R.rank_rows(T(s, d, "customer", "c_custkey"), [F.asc("c_custkey")])
    return n.groupBy(F.expr("(row_no - 1) div 50").alias("chunk")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("lowest"))


_VERS = """v AS (SELECT wiki, page_title, year(rev_ts)::INTEGER AS year, max_by(doc_id, (rev_ts, doc_id)) AS doc_id, max_by(coalesce(text, ''), (rev_ts, doc_id)) AS text FROM documents WHERE page_title IS NOT NULL AND wiki IS NOT NULL AND rev_ts IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT *, lag(text) OVER w AS previous, lag(year) OVER w AS previous_year FROM v WINDOW w AS (PARTITION BY wiki, page_title ORDER BY year))"""


def _versions(s, d):
    docs = T(s, d, "documents", "wiki", "page_title", "rev_ts", "doc_id", "text").where("page_title IS NOT NULL AND wiki IS NOT NULL AND rev_ts IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    return D.yearly_versions(docs, ["wiki", "page_title"], "rev_ts", "doc_id", "text")


@reg("w01_versions", f"WITH {_VERS} SELECT wiki, page_title, year, doc_id, previous_year, length(text) AS n_chars, length(previous) AS previous_chars FROM p")
def _(s, d):
    return _versions(s, d).select("wiki", "page_title", "year", "doc_id", "previous_year", F.length("text").cast("long").alias("n_chars"), F.length("previous").cast("long").alias("previous_chars"))


_TOK = "regexp_extract_all(lower({0}), '[a-z0-9_]+')"


@reg("tx01_word_changes", f"""WITH {_VERS}, x AS (SELECT doc_id, previous, lower(text) AS t, lower(previous) AS q FROM p),
a AS (SELECT doc_id, w, count(*) AS a FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[\\pL\\pM\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+')) AS w FROM x) GROUP BY 1, 2), b AS (SELECT doc_id, w, count(*) AS b FROM (SELECT doc_id, unnest(regexp_extract_all(q, '[\\pL\\pM\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+')) AS w FROM x WHERE q IS NOT NULL) GROUP BY 1, 2),
m AS (SELECT doc_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (doc_id, w)), g AS (SELECT doc_id, sum(a) AS n_words, sum(greatest(a - b, 0)) AS ad, sum(greatest(b - a, 0)) AS re, sum(a * b) AS dot, sum(a * a) AS aa, sum(b * b) AS bb FROM m GROUP BY 1)
SELECT x.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, CASE WHEN previous IS NOT NULL THEN coalesce(ad, 0)::BIGINT END AS words_added, CASE WHEN previous IS NOT NULL THEN coalesce(re, 0)::BIGINT END AS words_removed,
CASE WHEN previous IS NOT NULL THEN round(CASE WHEN aa > 0 AND bb > 0 THEN dot / sqrt(aa::DOUBLE * bb) ELSE 0 END, 4) END AS cosine FROM x LEFT JOIN g USING (doc_id)""")
def _(s, d):
    return D.word_changes(_versions(s, d), "text", "previous", ["doc_id"])


@reg("tx02_containment", f"""WITH {_VERS}, c AS (SELECT doc_id, lower(previous) AS target, list_filter(list_transform(string_split_regex(text, '\\s+'), lambda z: z), lambda z: false) AS none, text, previous FROM p WHERE previous IS NOT NULL),
s AS (SELECT doc_id, target, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda z: trim(z)), lambda z: length(z) > 20)) AS sent FROM c),
g AS (SELECT doc_id, avg(CASE WHEN contains(target, lower(substr(sent, 1, 60))) THEN 1.0 ELSE 0.0 END) AS share FROM s GROUP BY 1) SELECT c.doc_id, round(coalesce(g.share, 1.0), 4) AS containment FROM c LEFT JOIN g USING (doc_id)""")
def _(s, d):
    return _versions(s, d).where("previous IS NOT NULL").select("doc_id", F.round(D.containment(F.col("text"), F.col("previous")), 4).alias("containment"))


@reg("f08_sentences", "SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda z: trim(z)), lambda z: length(z) > 20))::INTEGER AS n_sentences FROM documents")
def _(s, d):
    return T(s, d, "documents", "doc_id", "text").select("doc_id", F.size(D.sentences(F.col("text"))).alias("n_sentences"))


_STOP = ["the", "and", "for", "from", "with", "was", "has"]


_BAG = "list_distinct(list_filter(regexp_extract_all(lower(title), '[a-zà-ÿ0-9%]+'), lambda z: length(z) > 1 AND z NOT IN ({0})))".format(", ".join(repr(x) for x in _STOP))


@reg("tx04_best_overlap", f"""WITH w AS (SELECT DISTINCT cand_id, len({_BAG}) AS n, unnest({_BAG}) AS w FROM candidate), v AS (SELECT DISTINCT work_id, len({_BAG}) AS n, unnest({_BAG}) AS w FROM crossref_work),
c AS (SELECT cand_id, work_id, round(count(*) / least(min(w.n), min(v.n)), 4) AS overlap FROM w JOIN v USING (w) GROUP BY 1, 2) SELECT cand_id, max_by(work_id, (overlap, -work_id)) AS work_id, max(overlap) AS overlap FROM c GROUP BY 1""")
def _(s, d):
    words = lambda name, key: T(s, d, name, key, "title").dropDuplicates([key]).withColumn("w", D.content_words(F.col("title"), _STOP))
    return D.best_overlap_of_all(words("candidate", "cand_id"), words("crossref_work", "work_id"), "cand_id", "work_id", "w")


@reg("w13_windows", "SELECT doc_id, unnest(generate_series(0, greatest(length(text) - 1, 0), 250))::INTEGER AS start FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return T(s, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.explode(D.text_windows(F.col("text"), 600, 250)).alias("w")).select("doc_id", F.col("w.start").cast("int").alias("start"))


@reg("f03_titles", """SELECT DISTINCT wiki, to_title, upper(substr(t, 1, 1)) || substr(t, 2) AS norm FROM (SELECT wiki, to_title, replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(to_title), '#.*$', '', 's'), '^[\\s_ ]+|[\\s_ ]+$', '', 'g'), '^:[\\s_ ]*', ''), ' ', '_') AS t FROM link) WHERE to_title IS NOT NULL""")
def _(s, d):
    return T(s, d, "link", "wiki", "to_title").where("to_title IS NOT NULL").distinct().withColumn("norm", page_title(F.col("to_title")))


@reg("f05_byte_length", "SELECT DISTINCT title, octet_length(encode(title))::INTEGER AS n_bytes FROM node WHERE title IS NOT NULL AND octet_length(encode(title)) > 30")
def _(s, d):
    return T(s, d, "node", "title").where(F.octet_length("title") > 30).distinct().withColumn("n_bytes", F.octet_length("title"))


@reg("f06_slug", "SELECT DISTINCT edition_id, substr(trim(regexp_replace(edition, '[^A-Za-z0-9_]+', '_', 'g'), '_'), 1, 80) AS slug FROM edition_index")
def _(s, d):
    return T(s, d, "edition_index", "edition_id", "edition").distinct().select("edition_id", F.substring(F.expr("trim(BOTH '_' FROM regexp_replace(edition, '[^A-Za-z0-9_]+', '_'))"), 1, 80).alias("slug"))


@reg("f16_plain_wikitext", "SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)<ref[^>/]*>.*?</ref>|<ref[^>]*/>', '', 'g'), '\\{\\{[^{}]*\\}\\}', '', 'g'), '\\[\\[(?:[^\\]|]*\\|)?([^\\]]*)\\]\\]', '\\1', 'g'), '''{2,}', '', 'g'), '(?m)^[=*:#]+ *| *=+$', '', 'g'), '[^A-Za-z]', '', 'g')) AS n FROM documents")
def _(s, d):
    rows = T(s, d, "documents", "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("doc_id", F.length(F.regexp_replace(D.strip_wikitext(F.col("text")), "[^A-Za-z]", "")).cast("long").alias("n"))


@reg("f17_wikilinks", "SELECT doc_id, unnest(regexp_extract_all(text, '\\[\\[([^\\]|#]+)', 1)) AS target FROM documents")
def _(s, d):
    return T(s, d, "documents", "doc_id", "text").select("doc_id", F.explode(D.wikilinks(F.col("text"))).alias("target"))


@reg("f19_summary_classes", "SELECT CASE WHEN regexp_matches(lower(close_comment), '^\\s*added:') THEN 'open' WHEN regexp_matches(lower(close_comment), 'clos(ed|ing)|rm tag') THEN 'close' ELSE 'other' END AS action, count(*) AS n FROM rfc_human_closes GROUP BY 1")
def _(s, d):
    c = F.lower("close_comment")
    action = F.when(c.rlike(r"^\s*added:"), "open").when(c.rlike("clos(ed|ing)|rm tag"), "close").otherwise("other")
    return T(s, d, "rfc_human_closes", "close_comment").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@reg("f27_url_parts", "SELECT DISTINCT url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM candidate WHERE url LIKE 'http%'")
def _(s, d):
    return T(s, d, "candidate", "url").where("url LIKE 'http%'").distinct().select("url", F.expr("parse_url(url, 'HOST')").alias("host"), F.expr("parse_url(url, 'PATH')").alias("path"))


@reg("a04_inverted_text", "SELECT DISTINCT work_id, title AS text FROM crossref_work WHERE title IS NOT NULL")
def _(s, d):
    """To an index of words and their places and back: the text of each work comes out as it was."""
    w = T(s, d, "crossref_work", "work_id", "title").where("title IS NOT NULL").distinct().withColumn("k", F.xxhash64("title"))
    index = w.select("work_id", "k", F.posexplode(F.split("title", " ")).alias("i", "w")).groupBy("work_id", "k", "w").agg(F.collect_list("i").alias("at"))
    return R.text_of_index(index, ["work_id", "k"], "w", "at").drop("k")


@reg("x02_lifespans", f"""WITH {_VERS}, m AS (SELECT wiki, page_title, year, md5(text) AS h FROM v), f AS (SELECT *, CASE WHEN h IS NOT DISTINCT FROM lag(h) OVER (PARTITION BY wiki, page_title ORDER BY year) THEN 0 ELSE 1 END AS n FROM m),
g AS (SELECT *, sum(n) OVER (PARTITION BY wiki, page_title ORDER BY year)::BIGINT AS version FROM f) SELECT wiki, page_title, version, min(year) AS first_year, max(year) AS last_year FROM g GROUP BY 1, 2, 3""")
def _(s, d):
    return D.lifespans(_versions(s, d), ["wiki", "page_title"], "year", F.col("text"))


@reg("ag19_group_means", f"WITH {_VERS} SELECT wiki, year, count(*) AS n, round(avg(length(text)), 4) AS mean_chars FROM p GROUP BY 1, 2")
def _(s, d):
    return _versions(s, d).groupBy("wiki", "year").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


QUERIES, ORACLE = Q, S
