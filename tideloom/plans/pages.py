"""Queries on pages, addresses, units of texts, templates, nested records and tallies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideloom.functions import web as W
from tideloom.operators import drift as D
from tideloom.operators import history as H
from tideloom.operators import records as R
from tideloom.operators import reshape as RS
from tideloom.operators import sequences as Z
from tideloom.plans.records import ORACLE as _RECORD_SQL
from tideloom.plans.texts import _BAG, _STOP, _VERS, ORACLE as _TEXT_SQL, _versions
from tideloom.session import materialise
from tideloom.sources.api import link_target
from tideloom.sources.tables import table as T

Q, S = {}, {}
_J22 = _RECORD_SQL["j22_passages"]


def reg(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _page(c):
    """A page of the text: a block a paragraph, with a style and reference marks that aren't to be seen."""
    return F.concat(F.lit("<html><style>p {}</style><div><p>"), F.replace(_escaped(c), F.lit("\n\n"), F.lit('<sup class="reference">[1]</sup></p>\n<p>')), F.lit("</p></div></html>"))


@reg("f11_html_text", r"SELECT doc_id, md5(left(trim(regexp_replace(replace(text, chr(160), ' '), '\s+', ' ', 'g')), 120000)) AS digest FROM documents WHERE text IS NOT NULL")
def _(s, d):
    page = F.concat(F.lit("<script>var x;</script><body class='a'>"), F.replace(_escaped(F.col("text")), F.lit("\n"), F.lit("<br/>\n")), F.lit("</body>"))
    return T(s, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.md5(W.html_text(page)).alias("digest"))


@reg("f13_visible_blocks", r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id, i ORDER BY p)::INTEGER AS block_no, text FROM (SELECT doc_id, i, p, trim(regexp_replace(replace(t, chr(160), ' '), '\s+', ' ', 'g')) AS text FROM (SELECT doc_id, i, unnest(string_split(text, chr(10) || chr(10))) AS t, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS p
FROM (SELECT doc_id, text, row_number() OVER () AS i FROM documents WHERE text IS NOT NULL))) WHERE text <> ''""")
def _(s, d):
    docs = T(s, d, "documents", "doc_id", "text").select("doc_id", _page(F.col("text")).alias("page"))
    return W.visible_blocks(docs, "doc_id", "page")


@reg("f14_charsets", "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def _(s, d):
    """Texts in three encodings, told by a mark, by a header and by nothing, come out as they were."""
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-16BE")).otherwise(F.encode("text", "UTF-8"))
    kind = F.when(F.col("doc_id") % 3 == 1, F.lit('text/html; charset="utf-16-be"'))
    return T(s, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.md5(W.decode_bytes(raw, kind)).alias("digest"))


@reg("f10_units", r"""WITH l AS (SELECT k, doc_id, i AS l, trim(t) AS t FROM (SELECT row_number() OVER () AS k, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) WHERE trim(t) <> ''),
h AS (SELECT *, regexp_matches(t, '^(?:=|\[|\*)') AS is_header FROM l), u AS (SELECT k, doc_id, is_header, trim(unnest(CASE WHEN is_header THEN [t] ELSE string_split(regexp_replace(t, '([.!?:])\s+', '\1' || chr(1), 'g'), chr(1)) END)) AS x FROM h)
SELECT doc_id, count(*) AS n_units, count(*) FILTER (is_header) AS n_headers, max(length(x))::INTEGER AS longest FROM u WHERE x <> '' GROUP BY doc_id""")
def _(s, d):
    u = D.units(T(s, d, "documents", "doc_id", "text"), "doc_id", "text", r"=|\[|\*")
    return u.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum(F.col("is_header").cast("int")).alias("n_headers"), F.max(F.length("text")).alias("longest"))


_BEST = _TEXT_SQL["tx04_best_overlap"]


def _titles(s, d, name, key, *more):
    return T(s, d, name, key, "title", *more).dropDuplicates([key]).withColumn("w", D.content_words(F.col("title"), _STOP))


@reg("tx04_coverage", f"WITH b AS ({_BEST}) SELECT w.work_id, count(b.cand_id) AS n FROM (SELECT DISTINCT work_id FROM crossref_work) w LEFT JOIN b ON b.work_id = w.work_id AND b.overlap >= 0.34 GROUP BY 1")
def _(s, d):
    works = materialise(_titles(s, d, "crossref_work", "work_id"), "units")
    return D.coverage(D.best_overlap_of_all(_titles(s, d, "candidate", "cand_id"), works, "cand_id", "work_id", "w"), works, "work_id")


@reg("tx05_inclusion", f"""WITH w AS (SELECT DISTINCT cand_id, len({_BAG}) AS n, unnest({_BAG}) AS w FROM candidate), v AS (SELECT DISTINCT work_id, len({_BAG}) AS n, unnest({_BAG}) AS w FROM crossref_work), c AS (SELECT work_id, cand_id, round(count(*) / least(min(w.n), min(v.n)), 4) AS o FROM w JOIN v USING (w) GROUP BY 1, 2),
i AS (SELECT DISTINCT work_id FROM c WHERE o >= 0.4), b AS (SELECT DISTINCT work_id, type, title FROM crossref_work) SELECT type, count(*) AS n_blocks, count(i.work_id) AS n_in, (100 * count(i.work_id)) // count(*) AS block_percent, ((100 * sum(CASE WHEN i.work_id IS NOT NULL THEN length(title) ELSE 0 END)) // sum(length(title)))::BIGINT AS char_percent FROM b LEFT JOIN i USING (work_id) GROUP BY 1""")
def _(s, d):
    works = materialise(_titles(s, d, "crossref_work", "work_id", "type"), "blocks")
    best = D.best_overlap_of_all(works, _titles(s, d, "candidate", "cand_id"), "work_id", "cand_id", "w")
    return D.inclusion(works, best, "work_id", "title", "type")


_WORDS = ["consensus", "vote", "archive", "older"]


@reg("w13_scored_windows", "SELECT * FROM (SELECT doc_id, i::INTEGER AS start, (" + " + ".join(f"contains(lower(substr(text, i + 1, 600)), '{w}')::INTEGER" for w in _WORDS) + ")::INTEGER AS score FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 250)) AS i FROM documents WHERE text IS NOT NULL)) WHERE score > 0")
def _(s, d):
    w = T(s, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.explode(D.keyword_windows(F.col("text"), _WORDS)).alias("w"))
    return w.select("doc_id", "w.start", "w.score")


@reg("tx07_keyword_passages")
def _(s, d):
    """The best five windows of each text, at least 300 characters apart."""
    w = T(s, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.explode(Z.apart(D.keyword_windows(F.col("text"), _WORDS), 300, 5)).alias("w"))
    return w.select("doc_id", "w.start", "w.score")


_TX01, _TX02 = _TEXT_SQL["tx01_word_changes"], _TEXT_SQL["tx02_containment"]
_OLD_IN_NEW = f"""WITH {_VERS}, c AS (SELECT doc_id, lower(text) AS target, text, previous FROM p WHERE previous IS NOT NULL), s AS (SELECT doc_id, target, unnest(list_filter(list_transform(string_split(regexp_replace(previous, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda z: trim(z)), lambda z: length(z) > 20)) AS sent FROM c),
g AS (SELECT doc_id, avg(CASE WHEN contains(target, lower(substr(sent, 1, 60))) THEN 1.0 ELSE 0.0 END) AS share FROM s GROUP BY 1) SELECT c.doc_id, coalesce(g.share, 1.0) AS kept FROM c LEFT JOIN g USING (doc_id)"""
_REFORM = f"k AS ({_OLD_IN_NEW}), x AS (SELECT k.doc_id, kept, cosine, words_added, words_removed, (SELECT any_value(wiki) FROM documents dd WHERE dd.doc_id = k.doc_id) AS wiki FROM k JOIN ({_TX01}) t USING (doc_id))"


def _drift(s, d):
    v = materialise(_versions(s, d), "versions")
    kept = v.where("previous IS NOT NULL").select("doc_id", "wiki", D.containment(F.col("previous"), F.col("text")).alias("kept"))
    return kept.join(D.word_changes(v, "text", "previous", ["doc_id"]), "doc_id")


@reg("m03_reform", f"WITH {_REFORM} SELECT wiki, count(*) AS n, round(avg(CASE WHEN kept < 0.8 THEN 1.0 ELSE 0.0 END), 3) AS reform_rate, round(avg(kept), 3) AS mean_kept, round(avg(words_added), 3) AS mean_added, round(avg(words_removed), 3) AS mean_removed FROM x GROUP BY 1")
def _(s, d):
    mean = lambda c, n: F.round(F.avg(c), 3).alias(n)
    return _drift(s, d).groupBy("wiki").agg(F.count("*").alias("n"), mean(F.when(F.col("kept") < 0.8, 1.0).otherwise(0.0), "reform_rate"), mean("kept", "mean_kept"), mean("words_added", "mean_added"), mean("words_removed", "mean_removed"))


@reg("tk04_reform_scores", f"WITH {_REFORM} SELECT doc_id, round((1 - kept) * (1 - cosine), 3) AS score FROM x ORDER BY (1 - kept) * (1 - cosine) DESC, doc_id LIMIT 25")
def _(s, d):
    score = (1 - F.col("kept")) * (1 - F.col("cosine"))
    return _drift(s, d).orderBy(score.desc(), "doc_id").limit(25).select("doc_id", F.round(score, 3).alias("score"))


@reg("m05_scaled", "SELECT c_custkey, round(2 + 8 * (c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer)), 4) AS mark FROM customer")
def _(s, d):
    c = T(s, d, "customer", "c_custkey", "c_acctbal")
    ends = c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))  # one row
    mark = F.when(F.col("hi") > F.col("lo"), 2 + 8 * (F.col("c_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(2.0)
    return c.crossJoin(F.broadcast(ends)).select("c_custkey", F.round(mark, 4).alias("mark"))


@reg("m02_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half, round_even(l_quantity / 4, 1) AS quarter FROM lineitem")
def _(s, d):
    return T(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 2, 0).alias("half"), F.bround(F.col("l_quantity") / 4, 1).alias("quarter"))


_MADE = "CASE cand_id % 3 WHEN 0 THEN 'https://arxiv.org/abs/' || coalesce(year, 0) || '.' || cand_id ELSE url END AS u, CASE cand_id % 3 WHEN 1 THEN '10.48550/arXiv.2101.' || cand_id WHEN 2 THEN 'arXiv:2101.' || cand_id || 'v2' ELSE doi END AS i"


@reg("f23_preprints", f"SELECT DISTINCT cand_id, coalesce(nullif(regexp_extract(lower(coalesce(u, '')), 'arxiv\\.org/abs/([0-9]+\\.[0-9]+)', 1), ''), nullif(regexp_extract(lower(coalesce(i, '')), '10\\.48550/arxiv\\.([0-9]+\\.[0-9]+)', 1), ''), nullif(regexp_extract(lower(coalesce(i, '')) || lower(coalesce(u, '')), 'arxiv[:/]([0-9]{{4}}\\.[0-9]+)', 1), '')) AS arxiv FROM (SELECT cand_id, {_MADE} FROM candidate)")
def _(s, d):
    c = T(s, d, "candidate", "cand_id", "doi", "url", "year")
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    k, i = F.col("cand_id") % 3, F.col("cand_id")
    url = F.when(k == 0, say("https://arxiv.org/abs/", F.coalesce("year", F.lit(0)), ".", i)).otherwise(F.col("url"))
    doi = F.when(k == 1, say("10.48550/arXiv.2101.", i)).when(k == 2, say("arXiv:2101.", i, "v2")).otherwise(F.col("doi"))
    return c.select("cand_id", W.arxiv_id(doi, url).alias("arxiv")).distinct()


_GOOD = "list_filter(ws, lambda w: length(w) > 3 AND w NOT IN (" + ", ".join(repr(x) for x in W._VAGUE) + "))[1]"


@reg("f24_citekeys", f"""SELECT DISTINCT cand_id, regexp_replace(lower(list_extract(string_split_regex(trim(coalesce(authors[1], 'unknown')), '\\s+'), -1)), '[^a-z0-9]', '', 'g') || coalesce(CAST(year AS VARCHAR), '0000') || coalesce({_GOOD}, ws[1], 'x') AS citekey
FROM (SELECT *, list_filter(string_split_regex(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]', '', 'g'), ' +'), lambda w: w <> '') AS ws FROM candidate)""")
def _(s, d):
    return T(s, d, "candidate", "cand_id", "title", "authors", "year").select("cand_id", W.citekey(F.col("authors"), F.col("year"), F.col("title")).alias("citekey")).distinct()


@reg("f27_url_queries", "SELECT DISTINCT cand_id, 'https' AS scheme, 'example.org' AS host, '/find' AS path, query AS q, strategy AS b FROM candidate WHERE query IS NOT NULL AND strategy IS NOT NULL")
def _(s, d):
    """Addresses built with encoded values and taken apart again."""
    c = T(s, d, "candidate", "cand_id", "query", "strategy").where("query IS NOT NULL AND strategy IS NOT NULL")
    url = F.concat(F.lit("https://Example.org/find?q=none&a=1&q="), F.url_encode("query"), F.lit("&b="), F.url_encode("strategy"), F.lit("#top"))
    return c.select("cand_id", W.url_parts(url).alias("p")).select("cand_id", "p.scheme", "p.host", "p.path", F.col("p.query")["q"].alias("q"), F.col("p.query")["b"].alias("b")).distinct()


_FRESH = "CASE WHEN p LIKE '%.pdf' OR regexp_matches(p, '/\\d{4}[-/]\\d{2}|/v\\d+[./]|/\\d{4}-[a-z]|[_-]\\d{4}\\.') OR contains(h, 'medium.com') THEN 'specific' WHEN contains(h, 'arxiv.org') OR contains(h, 'doi.org') OR contains(h, 'zenodo.org') OR contains(h, 'osf.io') THEN 'immutable' WHEN contains(p, '/docs/') OR contains(p, '/wiki/') OR contains(p, '/documentation/') OR contains(p, '/book/') OR contains(p, '/help/') OR contains(p, '/manual/') THEN 'docs' ELSE 'rolling' END"
_VARIED = "source_url || CASE fig_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '/2021-08/x' WHEN 2 THEN '/wiki/x' WHEN 3 THEN '/v2/x' WHEN 4 THEN '_2021.html' ELSE '?a=/docs/' END"


@reg("cl07_freshness", f"SELECT kind, CASE kind WHEN 'specific' THEN 3650 WHEN 'immutable' THEN 365 WHEN 'docs' THEN 30 ELSE 14 END AS days, count(*) AS n FROM (SELECT {_FRESH} AS kind FROM (SELECT lower(regexp_extract(u, '^https?://([^/?#]*)', 1)) AS h, lower(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1)) AS p FROM (SELECT DISTINCT fig_id, {_VARIED} AS u FROM wikimania_2017 WHERE source_url IS NOT NULL))) GROUP BY 1, 2")
def _(s, d):
    u = T(s, d, "wikimania_2017", "fig_id", "source_url").where("source_url IS NOT NULL").select("fig_id", F.expr("source_url || CASE fig_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '/2021-08/x' WHEN 2 THEN '/wiki/x' WHEN 3 THEN '/v2/x' WHEN 4 THEN '_2021.html' ELSE '?a=/docs/' END").alias("u")).distinct()
    return u.groupBy(W.freshness(F.col("u")).alias("kind"), W.max_age_days(F.col("u")).alias("days")).agg(F.count("*").alias("n"))


@reg("sc30_due_again", "WITH h AS (SELECT doc_id % 1000 AS k, max(rev_ts)::DATE AS at FROM documents GROUP BY 1), w AS (SELECT DISTINCT cand_id, url, CASE WHEN url LIKE '%.pdf' THEN 3650 ELSE 14 END AS days FROM candidate WHERE url <> '') SELECT w.cand_id FROM w LEFT JOIN h ON h.k = w.cand_id WHERE h.at IS NULL OR date_diff('day', h.at, DATE '2025-06-01') > w.days")
def _(s, d):
    """Addresses without a copy, or with one older than their kind allows."""
    held = T(s, d, "documents", "doc_id", "rev_ts").select((F.col("doc_id") % 1000).alias("cand_id"), "rev_ts")
    wanted = T(s, d, "candidate", "cand_id", "url").where("url <> ''").distinct()
    return R.due_again(wanted, held, "cand_id", "rev_ts", W.max_age_days(F.col("url")), F.lit("2025-06-01").cast("date")).select("cand_id")


@reg("f29_raw_snapshots", "SELECT DISTINCT fig_id, 'https://web.example.org/web/20170102030405id_/' || source_url AS raw FROM wikimania_2017 WHERE source_url IS NOT NULL")
def _(s, d):
    f = T(s, d, "wikimania_2017", "fig_id", "source_url").where("source_url IS NOT NULL").distinct()
    return f.select("fig_id", W.raw_snapshot(F.concat(F.lit("https://web.example.org/web/20170102030405/"), "source_url")).alias("raw"))


@reg("f30_source_types", "SELECT CASE WHEN contains(source_url, 'wiki.example.net') THEN 'meta_wiki' WHEN contains(source_url, 'lists.example.org') THEN 'mailing_list' WHEN contains(source_url, 'blog.example.org') THEN 'blog' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT DISTINCT fig_id, source_url FROM wikimania_2017) GROUP BY 1")
def _(s, d):
    rules = [("wiki.example.net", "meta_wiki"), ("lists.example.org", "mailing_list"), ("blog.example.org", "blog")]
    return T(s, d, "wikimania_2017", "fig_id", "source_url").distinct().groupBy(W.source_type(F.col("source_url"), rules).alias("kind")).agg(F.count("*").alias("n"))


@reg("f32_plain_latex", r"SELECT DISTINCT work_id, trim(regexp_replace(replace(title, '--', '–'), '\s+', ' ', 'g')) || ' & more' AS plain FROM crossref_work WHERE title IS NOT NULL AND NOT regexp_matches(title, '[{}\\]')")
def _(s, d):
    w = T(s, d, "crossref_work", "work_id", "title").where(F.col("title").isNotNull() & ~F.col("title").rlike(r"[{}\\]"))
    return w.select("work_id", W.plain_latex(F.concat(F.lit("{\\emph{"), "title", F.lit("}}  \\& more"))).alias("plain")).distinct()


@reg("f34_labels", "SELECT DISTINCT work_id, rpad(left(title, 34), 34, ' ') AS label FROM crossref_work WHERE title IS NOT NULL")
def _(s, d):
    return T(s, d, "crossref_work", "work_id", "title").where("title IS NOT NULL").select("work_id", W.label(F.col("title"), 34).alias("label")).distinct()


@reg("f35_retry_after", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(user_id AS DOUBLE) WHEN 1 THEN greatest(0.0, epoch(date_trunc('second', ts)) - 1706000000.0) ELSE 5.0 END AS wait FROM events")
def _(s, d):
    e = T(s, d, "events", "event_id", "user_id", "ts")
    header = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    return e.select("event_id", W.retry_after(header, F.lit(1706000000.0)).alias("wait"))


@reg("in04_paced_requests", """WITH k AS (SELECT event_id, user_id, epoch(date_trunc('second', ts)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)), event_id) - 1 AS k FROM events)
SELECT event_id, (max(t - k * 90000) OVER (PARTITION BY user_id ORDER BY k) + k * 90000)::BIGINT AS start FROM k""")
def _(s, d):
    e = T(s, d, "events", "event_id", "user_id", "ts").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.lit(90_000).alias("delay"))
    return H.paced(e, "user_id", "at", "delay", "event_id").select("event_id", "start")


_EV = "(SELECT event_id, user_id, epoch_ms(ts) AS t FROM events WHERE event_type = '{0}')"


@reg("j06_priority", f"""WITH a AS {_EV.format('view')}, h AS (SELECT a.event_id, min_by(b.event_id, (b.t, b.event_id)) AS hit, min(b.t) AS t FROM a JOIN {_EV.format('purchase')} b ON a.user_id = b.user_id AND b.t > a.t GROUP BY 1), z AS (SELECT a.event_id, min_by(b.event_id, (b.t, b.event_id)) AS hit, min(b.t) AS t FROM a JOIN {_EV.format('click')} b ON a.user_id = b.user_id AND b.t > a.t GROUP BY 1)
SELECT a.event_id, coalesce(h.hit, z.hit) AS hit, coalesce(h.t, z.t) AS hit_t, CASE WHEN h.hit IS NOT NULL THEN 'closed' WHEN z.hit IS NOT NULL THEN 'stale' ELSE 'open' END AS outcome FROM a LEFT JOIN h USING (event_id) LEFT JOIN z USING (event_id)""")
def _(s, d):
    """An event of the first kind wins over any of the second, however early."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))  # milliseconds are rounded, half of one away from 1970, as the SQL's are
    e = T(s, d, "events", "event_id", "user_id", "event_type", "ts").select("event_id", "user_id", "event_type", micros.alias("u")).withColumn("t", F.expr("(u div 500 + if(u < 0, -1, 1)) div 2"))
    kind = lambda k, i, t: e.where(F.col("event_type") == k).select(F.col("event_id").alias(i), "user_id", F.col("t").alias(t))
    return H.first_outcome(kind("view", "event_id", "t"), kind("purchase", "hit", "hit_t"), kind("click", "hit", "hit_t"), "user_id", "event_id", "t", "hit", "hit_t").drop("t")


@reg("ag32_found_share", "WITH t AS (" + _J22 + ") SELECT round(sum(CASE WHEN tier NOT IN ('not_found', 'skipped') THEN n ELSE 0 END) / sum(CASE WHEN tier <> 'skipped' THEN n ELSE 0 END), 4) AS found, sum(n)::BIGINT AS n FROM t")
def _(s, d):
    from tideloom.plans.records import QUERIES

    t = QUERIES["j22_passages"](s, d)
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return t.agg(F.round(n(~F.col("tier").isin("not_found", "skipped")) / n(F.col("tier") != "skipped"), 4).alias("found"), F.sum("n").alias("n"))


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "node", "link", "candidate", "crossref_work"]


@reg("ag35_table_sizes", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def _(s, d):
    out = None
    for t in _TABLES:  # counts come from the files' footers
        one = T(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_REL = "CASE strategy WHEN 'S5_topic' THEN 'contradicting' WHEN 'C2_gap' THEN 'qualifying' ELSE 'supporting' END"


@reg("ag29_claims", f"SELECT query AS claim, count(DISTINCT cand_id) AS n_papers, count(DISTINCT cand_id) FILTER ({_REL} = 'contradicting') AS n_contradicting, count(DISTINCT cand_id) FILTER ({_REL} = 'qualifying') AS n_qualifying, CASE WHEN count(DISTINCT cand_id) >= 8 THEN 'STRONG' WHEN count(DISTINCT cand_id) >= 4 THEN 'PARTIAL' WHEN count(DISTINCT cand_id) >= 1 THEN 'THIN' ELSE 'NONE' END AS strength FROM candidate GROUP BY 1")
def _(s, d):
    c = T(s, d, "candidate", "cand_id", "query", "strategy").distinct().withColumn("rel", F.expr(_REL))
    n = lambda r: F.count_distinct(F.when(F.col("rel") == r, F.col("cand_id")))
    g = c.groupBy(F.col("query").alias("claim")).agg(F.count_distinct("cand_id").alias("n_papers"), n("contradicting").alias("n_contradicting"), n("qualifying").alias("n_qualifying"))
    return g.withColumn("strength", F.when(F.col("n_papers") >= 8, "STRONG").when(F.col("n_papers") >= 4, "PARTIAL").when(F.col("n_papers") >= 1, "THIN").otherwise("NONE"))


@reg("ag30_themes", "SELECT theme, strategy, count(DISTINCT cand_id) AS n FROM (SELECT cand_id, strategy, unnest(string_split(query, ' ')) AS theme FROM candidate) GROUP BY GROUPING SETS ((theme), (theme, strategy))")
def _(s, d):
    c = T(s, d, "candidate", "cand_id", "strategy", "query").distinct().select("cand_id", "strategy", F.explode(F.split("query", " ")).alias("theme"))
    per = c.groupBy("theme", "strategy").agg(F.count_distinct("cand_id").alias("n"))
    return per.unionByName(c.groupBy("theme").agg(F.count_distinct("cand_id").alias("n")).withColumn("strategy", F.lit(None).cast("string")))


@reg("ag18_used_share", "SELECT n.wiki, count(*) AS n_titles, count(l.t) AS n_used, round(count(l.t) / count(*), 4) AS used FROM (SELECT DISTINCT wiki, title FROM node WHERE title IS NOT NULL AND wiki IS NOT NULL) n LEFT JOIN (SELECT DISTINCT wiki, to_title AS t FROM link WHERE to_title IS NOT NULL) l ON l.wiki = n.wiki AND l.t = n.title GROUP BY 1")
def _(s, d):
    used = T(s, d, "link", "wiki", F.col("to_title").alias("title")).dropna().distinct().withColumn("used", F.lit(1))
    n = T(s, d, "node", "wiki", "title").dropna().distinct().join(used, ["wiki", "title"], "left")
    return n.groupBy("wiki").agg(F.count("*").alias("n_titles"), F.count("used").alias("n_used"), F.round(F.count("used") / F.count("*"), 4).alias("used"))


@reg("ag38_link_summary", "WITH n AS (SELECT wiki, year, count(*) AS n_nodes, count(DISTINCT namespace) AS n_namespaces, count(DISTINCT admitted_via) AS n_roles FROM node GROUP BY 1, 2), l AS (SELECT wiki, year, count(*) AS n_links, count(*) FILTER (to_admitted) AS n_admitted FROM link GROUP BY 1, 2) SELECT n.wiki, n.year, n_nodes, n_namespaces, n_roles, coalesce(n_links, 0) AS n_links, coalesce(n_admitted, 0) AS n_admitted FROM n LEFT JOIN l ON n.wiki IS NOT DISTINCT FROM l.wiki AND n.year IS NOT DISTINCT FROM l.year")
def _(s, d):
    n = T(s, d, "node", "wiki", "year", "namespace", "admitted_via").groupBy("wiki", "year").agg(F.count("*").alias("n_nodes"), F.count_distinct("namespace").alias("n_namespaces"), F.count_distinct("admitted_via").alias("n_roles"))
    l = T(s, d, "link", "wiki", "year", "to_admitted").groupBy(F.col("wiki").alias("w"), F.col("year").alias("y")).agg(F.count("*").alias("n_links"), F.sum(F.when(F.col("to_admitted"), 1).otherwise(0)).alias("n_admitted"))  # noqa: E741
    return n.join(l, n.wiki.eqNullSafe(l.w) & n.year.eqNullSafe(l.y), "left").drop("w", "y").fillna(0, ["n_links", "n_admitted"])


@reg("a05_nested_explode", "SELECT DISTINCT work_id, (a.i - 1)::INTEGER AS author_no, (b.i - 1)::INTEGER AS part_no, part FROM (SELECT work_id, unnest(authors) AS au, generate_subscripts(authors, 1) AS i FROM crossref_work) a, LATERAL (SELECT unnest(string_split(a.au.given, ' ')) AS part, generate_subscripts(string_split(a.au.given, ' '), 1) AS i) b")
def _(s, d):
    """Names in names: authors hold lists of given names."""
    w = T(s, d, "crossref_work", "work_id", "authors").select("work_id", F.transform("authors", lambda a: F.struct(a.family.alias("family"), F.split(a.given, " ").alias("parts"))).alias("authors"))
    a = w.select("work_id", F.posexplode("authors").alias("author_no", "a"))
    return a.select("work_id", "author_no", F.posexplode("a.parts").alias("part_no", "part")).distinct()


@reg("a07_two_layouts", "SELECT DISTINCT work_id, a.family AS theme, a.given AS claim FROM (SELECT work_id, unnest(authors) AS a FROM crossref_work)")
def _(s, d):
    """Half of the records nest claims in themes, the other half list pairs; both come out flat."""
    w = T(s, d, "crossref_work", "work_id", "authors").where("authors IS NOT NULL")
    nested = w.where("work_id % 2 = 0").select("work_id", F.transform("authors", lambda a: F.struct(a.family.alias("theme"), F.array(a.given).alias("claims"))).alias("themes"))
    flat = w.where("work_id % 2 = 1").select("work_id", F.transform("authors", lambda a: F.struct(a.family.alias("theme"), a.given.alias("claim"))).alias("claims"))
    return RS.flatten_claims(nested, flat, "work_id", "themes", "claims").distinct()


@reg("a12_optional_fields", "SELECT DISTINCT work_id, array_to_string(list_transform(authors, lambda a: a.family || CASE WHEN length(a.family) > 8 THEN '!long name' ELSE '' END), ';') AS shown FROM crossref_work WHERE authors IS NOT NULL")
def _(s, d):
    """A reason is set where it applies and absent elsewhere; the given name is removed."""
    long = lambda a: F.length(a.family) > 8
    marked = F.transform("authors", lambda a: a.withField("excluded", F.when(long(a), True)).withField("reason", F.when(long(a), F.lit("long name"))).dropFields("given"))
    w = T(s, d, "crossref_work", "work_id", "authors").where("authors IS NOT NULL").select("work_id", marked.alias("m"))
    return w.select("work_id", F.array_join(F.transform("m", lambda a: F.concat(a.family, F.coalesce(F.concat(F.lit("!"), a.reason), F.lit("")))), ";").alias("shown")).distinct()


@reg("tk11_capped_lists", "SELECT DISTINCT work_id, array_to_string(list_transform(authors[1:2], lambda a: a.family), ', ') || CASE WHEN len(authors) > 2 THEN ' et al.' ELSE '' END AS names FROM crossref_work WHERE authors IS NOT NULL")
def _(s, d):
    names = F.array_join(F.transform(F.slice("authors", 1, 2), lambda a: a.family), ", ")
    return T(s, d, "crossref_work", "work_id", "authors").where("authors IS NOT NULL").select("work_id", F.concat(names, F.when(F.size("authors") > 2, " et al.").otherwise("")).alias("names")).distinct()


@reg("tk10_next_batch", "SELECT DISTINCT cand_id FROM candidate WHERE cand_id NOT IN (SELECT cand_id FROM candidate WHERE strategy = 'S3_keyword') ORDER BY cand_id LIMIT 25")
def _(s, d):
    c = T(s, d, "candidate", "cand_id", "strategy")
    return H.without(c, c.where("strategy = 'S3_keyword'"), "cand_id").select("cand_id").distinct().orderBy("cand_id").limit(25)


@reg("u17_file_order", "SELECT k, cand_id FROM (SELECT lower(trim(title)) AS k, cand_id, row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY CASE strategy WHEN 'S3_keyword' THEN 0 ELSE 1 END, strategy, cand_id) AS r FROM candidate WHERE trim(title) <> '' AND strategy IS NOT NULL) WHERE r = 1")
def _(s, d):
    """The consolidated file first, then the parts in their order; of a key the first holds."""
    c = T(s, d, "candidate", "cand_id", "title", "strategy").where("trim(title) <> '' AND strategy IS NOT NULL").withColumn("k", F.lower(F.trim("title")))
    return R.keep_first(c, F.col("k"), [F.when(F.col("strategy") == "S3_keyword", 0).otherwise(1), F.asc("strategy"), F.asc("cand_id")]).select("k", "cand_id")


@reg("u19_moved", "SELECT fig_id, min(coalesce(CASE WHEN coalesce(verified, false) THEN source_type ELSE m.kind END, 'unclassified')) AS kind FROM wikimania_2017 f LEFT JOIN (SELECT DISTINCT edition_id AS fig_id, 'moved' AS kind FROM edition_index) m USING (fig_id) GROUP BY 1")
def _(s, d):
    """Unclassified records go to the group their id is listed for."""
    f = T(s, d, "wikimania_2017", "fig_id", "source_type", "verified").withColumn("kind", F.when(F.coalesce("verified", F.lit(False)), F.col("source_type")))
    m = T(s, d, "edition_index", F.col("edition_id").alias("fig_id")).distinct().withColumn("to", F.lit("moved"))
    to = F.when(F.coalesce("verified", F.lit(False)), F.col("kind")).otherwise(F.col("to"))
    return f.join(m, "fig_id", "left").groupBy("fig_id").agg(F.min(F.coalesce(to, F.lit("unclassified"))).alias("kind"))


_ORDER = [f"Wikimania {y}" for y in (2017, 2015, 2019)]


@reg("u21_ordered_sections", """WITH o AS (SELECT edition AS k, min(location) AS t, min(edition_id) AS q FROM edition_index WHERE year < 2018 GROUP BY 1), n AS (SELECT edition AS k, max(location) AS t FROM edition_index WHERE year >= 2017 GROUP BY 1),
b AS (SELECT coalesce(o.k, n.k) AS k, coalesce(n.t, o.t) AS t, q, coalesce(list_position([""" + ", ".join(repr(x) for x in _ORDER) + """], coalesce(o.k, n.k)), 99) AS p FROM o FULL JOIN n ON o.k = n.k), a AS (SELECT NULL AS k, 'before all' AS t, 0 AS q, -1 AS p UNION ALL SELECT k, t, q, p FROM b) SELECT row_number() OVER (ORDER BY p, q NULLS LAST, encode(k))::INTEGER AS place, k, t FROM a""")
def _(s, d):
    e = T(s, d, "edition_index", "edition", "location", "year", "edition_id")
    old = e.where("year < 2018").groupBy(F.col("edition").alias("k")).agg(F.min("location").alias("t"), F.min("edition_id").alias("q"))
    top = s.createDataFrame([(None, "before all", 0)], "k string, t string, q bigint")
    new = e.where("year >= 2017").groupBy(F.col("edition").alias("k")).agg(F.max("location").alias("t"))
    return R.upsert_sections(old.unionByName(top), new, "k", "t", "q", _ORDER)


@reg("w10_first_non_empty", "SELECT DISTINCT cand_id, coalesce(nullif(trim(abstract), ''), nullif(trim(url), ''), nullif(trim(title), ''), 'none') AS chosen FROM candidate")
def _(s, d):
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    return T(s, d, "candidate", "cand_id", "abstract", "url", "title").select("cand_id", F.coalesce(full("abstract"), full("url"), full("title"), F.lit("none")).alias("chosen")).distinct()


_CALLS = "SELECT DISTINCT doc_id, wiki, lower(regexp_replace(trim(unnest(regexp_extract_all(coalesce(text, ''), '\\{\\{\\s*([^{}|\\n]+)', 1))), '[ _]+', ' ', 'g')) AS t FROM documents"


def _calls(s, d):
    return T(s, d, "documents", "doc_id", "wiki", "text").select("doc_id", "wiki", F.explode(R.templates(F.col("text"))).alias("t")).distinct()


@reg("j11_template_hosts", f"WITH c AS ({_CALLS}) SELECT t, wiki, count(*) AS n_hosts FROM c GROUP BY 1, 2")
def _(s, d):
    return _calls(s, d).groupBy("t", "wiki").agg(F.count("*").alias("n_hosts"))


@reg("j10_category_members", "SELECT lower(list_extract(string_split_regex(n.title, '[ _]+'), -2)) AS category, n.wiki, count(DISTINCT n.page_id) AS n_pages, count(DISTINCT l.from_page) AS n_hosts FROM node n JOIN link l ON l.wiki = n.wiki AND l.year = n.year AND l.to_page = n.page_id WHERE n.namespace = 4 GROUP BY 1, 2")
def _(s, d):
    """Members of a kind of page with what points at them: link, target and page joined by id, one namespace."""
    n = T(s, d, "node", "wiki", "year", "page_id", "title", "namespace").where("namespace = 4").withColumn("category", F.lower(F.try_element_at(F.split("title", "[ _]+"), F.lit(-2))))
    l = T(s, d, "link", "wiki", "year", F.col("to_page").alias("page_id"), "from_page")  # noqa: E741
    return n.join(l, ["wiki", "year", "page_id"]).groupBy("category", "wiki").agg(F.count_distinct("page_id").alias("n_pages"), F.count_distinct("from_page").alias("n_hosts"))


_ROLE = "CASE WHEN regexp_matches(t, 'navigat|navbox|sidebar|zijbalk', 'i') THEN 'navigation' WHEN regexp_matches(t, 'polic|guideline|richtlin|beleid|notice', 'i') THEN 'status' ELSE 'noise' END"


@reg("cl03_template_roles", f"WITH c AS ({_CALLS}) SELECT {_ROLE} AS role, count(*) AS n, count(DISTINCT t) AS n_templates FROM c GROUP BY 1")
def _(s, d):
    t = F.col("t")
    rules = [("navigation", t.rlike("(?i)navigat|navbox|sidebar|zijbalk")), ("status", t.rlike("(?i)polic|guideline|richtlin|beleid|notice")), ("noise", F.lit(True))]
    return R.first_rule(_calls(s, d), rules, "role").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("t").alias("n_templates"))


@reg("cl04_membership", """WITH n AS (SELECT wiki, year, page_id, bool_or(confidence = 'confirmed') AS c, bool_or(admitted_via = 'wikidata') AS w, bool_or(lower(trim(status_tier)) = 'essay') AS e FROM node WHERE page_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT CASE WHEN e THEN 'essay' WHEN c THEN 'core:status' WHEN w THEN 'core:item' ELSE 'candidate' END AS tier, count(*) AS n FROM n GROUP BY 1""")
def _(s, d):
    """An essay mark overrides; then status, then the item of another site's core."""
    n = T(s, d, "node", "wiki", "year", "page_id", "confidence", "admitted_via", "status_tier").where("page_id IS NOT NULL").groupBy("wiki", "year", "page_id")
    n = n.agg(F.max(F.col("confidence") == "confirmed").alias("c"), F.max(F.col("admitted_via") == "wikidata").alias("w"), F.max(F.lower(F.trim("status_tier")) == "essay").alias("e"))
    return R.first_rule(n, [("essay", F.col("e")), ("core:status", F.col("c")), ("core:item", F.col("w")), ("candidate", F.lit(True))], "tier").groupBy("tier").agg(F.count("*").alias("n"))


_KINDS = {"deadline": ["deadline", "before the"], "extended": ["extended", "expire after"], "notification": ["notified", "will be"], "schedule": ["schedule", "months", "weeks"]}


@reg("cl02_all_labels", "SELECT doc_id, unnest(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in _KINDS.items()) + "], lambda x: x IS NOT NULL)) AS label FROM (SELECT DISTINCT doc_id, text FROM documents)")
def _(s, d):
    return T(s, d, "documents", "doc_id", "text").distinct().select("doc_id", F.explode(R.all_labels(F.col("text"), _KINDS)).alias("label"))


@reg("cl08_settings", "SELECT DISTINCT url, CASE WHEN contains(url, 'klider') THEN 9 WHEN contains(url, 'repo7.example.org') THEN 5 WHEN contains(url, 'example.org') THEN 3 ELSE 1 END AS delay, CASE WHEN contains(url, 'klider') THEN 'override' WHEN contains(url, 'example.org') THEN 'table' ELSE 'constant' END AS origin FROM candidate WHERE url <> ''")
def _(s, d):
    """An override of the entry, else the longest matching fragment of the table, else the constant."""
    u = R.longest_match(T(s, d, "candidate", "url").where("url <> ''").distinct(), "url", [("example.org", 3), ("repo7.example.org", 5)], "found")
    own = F.when(F.contains("url", F.lit("klider")), 9)
    return u.select("url", F.coalesce(own, "found", F.lit(1)).alias("delay"), F.when(own.isNotNull(), "override").when(F.col("found").isNotNull(), "table").otherwise("constant").alias("origin"))


_BAD = "disqualif|malform|invalid|not a (policy|guideline|rfc|valid|dr)|incorrectly placed|improper|not an rfc|withdrawn|rant"
_LISTED = "CASE close_rev_id % 3 WHEN 0 THEN 'Added: [[Talk:' || coalesce(closer, '') || ']]' WHEN 1 THEN ' removed:  [[Talk:' || coalesce(closer, '') || ']] ' || coalesce(close_comment, '') ELSE coalesce(close_comment, '') END"


@reg("cl11_listing_events", f"""SELECT action, flag, count(*) AS n, count(DISTINCT target) AS n_targets FROM (SELECT CASE WHEN a <> '' THEN 'open' WHEN r <> '' THEN 'close' WHEN bad AND NOT bot THEN 'other' END AS action, coalesce(nullif(a, ''), r) AS target, CASE WHEN a <> '' THEN '' WHEN r <> '' AND bot THEN '' WHEN r <> '' THEN CASE WHEN bad THEN 'disqualified' ELSE 'human_close' END WHEN bad AND NOT bot THEN 'disqualified' END AS flag
FROM (SELECT regexp_extract(c, '(?i)^\\s*Added:\\s*\\[\\[([^\\]]+)\\]\\]', 1) AS a, regexp_extract(c, '(?i)^\\s*Removed:\\s*\\[\\[([^\\]]+)\\]\\]', 1) AS r, regexp_matches(c, '(?i){_BAD}') AS bad, coalesce(closer LIKE 'B%', false) AS bot FROM (SELECT *, {_LISTED} AS c FROM (SELECT DISTINCT close_rev_id, closer, close_comment FROM rfc_human_closes)))) WHERE action IS NOT NULL GROUP BY 1, 2""")
def _(s, d):
    c = T(s, d, "rfc_human_closes", "close_rev_id", "closer", "close_comment").distinct().withColumn("c", F.expr(_LISTED))
    events = R.listing_events(c, F.col("c"), F.coalesce(F.col("closer").startswith("B"), F.lit(False)), _BAD)
    return events.groupBy("action", "flag").agg(F.count("*").alias("n"), F.count_distinct("target").alias("n_targets"))


@reg("cl01_all_groups", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN contains(def, 'online') THEN 'unit:online' WHEN regexp_matches(def, 'people from|countries') THEN 'unit:places' WHEN regexp_matches(raw, '^[0-9]{1,2}(st|nd|rd|th)') THEN 'ordinal' WHEN contains(ctx, 'unique visitors') THEN 'context:visitors'
WHEN verified THEN 'kept:verified' WHEN contains(def, 'scholarship') THEN 'review:part' WHEN figure_numeric IS NULL THEN 'no_number' WHEN figure_numeric < 20 THEN 'too_small' WHEN year < 2012 AND figure_numeric > 2000 AND source_type = 'mailing_list' THEN 'too_large_early' ELSE 'kept' END AS reason
FROM (SELECT DISTINCT fig_id, lower(coalesce(definition_as_reported, '')) AS def, lower(coalesce(figure_raw, '')) AS raw, lower(coalesce(context, '')) AS ctx, verified, figure_numeric, year, source_type FROM wikimania_2017)) GROUP BY 1""")
def _(s, d):
    f = T(s, d, "wikimania_2017", "fig_id", "definition_as_reported", "figure_raw", "context", "verified", "figure_numeric", "year", "source_type")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    f = f.select("fig_id", low("definition_as_reported").alias("def"), low("figure_raw").alias("raw"), low("context").alias("ctx"), "verified", "figure_numeric", "year", "source_type").distinct()
    rules = [
        ("unit:online", F.contains("def", F.lit("online"))), ("unit:places", F.col("def").rlike("people from|countries")), ("ordinal", F.col("raw").rlike("^[0-9]{1,2}(st|nd|rd|th)")), ("context:visitors", F.contains("ctx", F.lit("unique visitors"))), ("kept:verified", F.col("verified")),
        ("review:part", F.contains("def", F.lit("scholarship"))), ("no_number", F.col("figure_numeric").isNull()), ("too_small", F.col("figure_numeric") < 20), ("too_large_early", (F.col("year") < 2012) & (F.col("figure_numeric") > 2000) & (F.col("source_type") == "mailing_list")), ("kept", F.lit(True)),
    ]
    return R.first_rule(f, rules).groupBy("reason").agg(F.count("*").alias("n"))


@reg("f04_target_numbers", "SELECT DISTINCT to_title, CASE WHEN strpos(t, ':') > 1 AND p IN ('user', 'project', 'help') THEN CASE p WHEN 'user' THEN 2 WHEN 'project' THEN 4 ELSE 12 END ELSE 0 END AS ns, CASE WHEN strpos(t, ':') > 1 AND p IN ('user', 'project', 'help') THEN regexp_replace(regexp_extract(t, '^[^:]*:(.*)$', 1), '^_+', '') ELSE t END AS title FROM (SELECT *, lower(rtrim(replace(split_part(t, ':', 1), '_', ' '))) AS p FROM (SELECT to_title, replace(trim(CASE WHEN to_ns = 2 THEN 'User :' ELSE '' END || to_title), ' ', '_') AS t FROM link WHERE to_title IS NOT NULL))")
def _(s, d):
    """Titles with and without a prefix to namespace number and rest, by a prefix table."""
    t = F.concat(F.when(F.col("to_ns") == 2, "User :").otherwise(""), "to_title")
    x = link_target(t, {"user": 2, "project": 4, "help": 12})
    return T(s, d, "link", "to_ns", "to_title").where("to_title IS NOT NULL").select("to_title", x.alias("x")).select("to_title", "x.ns", "x.title").distinct()


@reg("pf13_each_column", "SELECT count(year) AS n_year, round(avg(year), 4) AS mean_year, count(figure_numeric) AS n_figure, round(avg(figure_numeric), 4) AS mean_figure FROM wikimania_2017")
def _(s, d):
    """Nulls of each column are left out on their own."""
    return T(s, d, "wikimania_2017", "year", "figure_numeric").agg(F.count("year").alias("n_year"), F.round(F.avg("year"), 4).alias("mean_year"), F.count("figure_numeric").alias("n_figure"), F.round(F.avg("figure_numeric"), 4).alias("mean_figure"))


@reg("pf16_after_join", "SELECT DISTINCT l.wiki, l.year, l.to_page FROM link l JOIN node n ON l.wiki = n.wiki AND l.year = n.year AND l.to_page = n.page_id WHERE n.namespace IN (4, 12) AND NOT regexp_matches(n.title, '(?i)archiv|/')")
def _(s, d):
    n = T(s, d, "node", "wiki", "year", F.col("page_id").alias("to_page"), "namespace", "title").where(F.col("namespace").isin(4, 12) & ~F.col("title").rlike("(?i)archiv|/")).select("wiki", "year", "to_page").distinct()
    return T(s, d, "link", "wiki", "year", "to_page").join(n, ["wiki", "year", "to_page"]).distinct()


@reg("pf20_two_tiers", "SELECT DISTINCT cand_id FROM candidate WHERE strategy IN ('S2_forward', 'S3_keyword') AND query IN ('policy change', 'quality of generated text')")
def _(s, d):
    return T(s, d, "candidate", "cand_id", "strategy", "query").where(F.col("strategy").isin("S2_forward", "S3_keyword") & F.col("query").isin("policy change", "quality of generated text")).select("cand_id").distinct()


@reg("d12_year_month", "SELECT (substr(ym, 1, 4))::INTEGER AS year, (substr(ym, 5, 2))::INTEGER AS month, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y%m') AS ym FROM orders) GROUP BY 1, 2")
def _(s, d):
    ym = F.date_format("o_orderdate", "yyyyMM")
    return T(s, d, "orders", "o_orderdate").groupBy(F.substring(ym, 1, 4).cast("int").alias("year"), F.substring(ym, 5, 2).cast("int").alias("month")).agg(F.count("*").alias("n"))


@reg("w19_sequential_ids", "SELECT fig_id, 'F' || lpad(CAST(row_number() OVER (ORDER BY edition, fig_id) AS VARCHAR), 6, '0') AS no FROM (SELECT DISTINCT fig_id, edition FROM wikimania_2017)")
def _(s, d):
    n = RS.rank_rows(T(s, d, "wikimania_2017", "fig_id", "edition").distinct(), [F.asc("edition"), F.asc("fig_id")])
    return n.select("fig_id", F.concat(F.lit("F"), F.lpad(F.col("row_no").cast("string"), 6, "0")).alias("no"))


QUERIES, ORACLE = Q, S
