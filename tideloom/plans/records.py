"""Queries of areas F and G: figures, editions, candidates and works."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideloom.operators import dates as DT
from tideloom.operators import drift as D
from tideloom.operators import records as R
from tideloom.sources.tables import table as T

Q, S = {}, {}
URL_HEAD = 60  # of source_url


def reg(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@reg("f20_figures", """SELECT DISTINCT fig_id, figure_raw, CASE WHEN regexp_matches(figure_raw, '[0-9]\\s*(to|-|–|—)\\s*[0-9]') THEN NULL WHEN regexp_matches(figure_raw, '[0-9](st|nd|rd|th)\\b', 'i') THEN NULL
ELSE try_cast(regexp_replace(figure_raw, '[^0-9]', '', 'g') AS BIGINT) END AS value FROM wikimania_2017""")
def _(s, d):
    return T(s, d, "wikimania_2017", "fig_id", "figure_raw").distinct().withColumn("value", R.figure_value(F.col("figure_raw")))


_EN, _FR = "|".join(DT.ENGLISH), "|".join(DT.FRENCH)


def _mon(x):
    return f"lpad(CAST(coalesce(nullif(list_position([{', '.join(repr(n) for n in DT.ENGLISH)}], lower({x})), 0), list_position([{', '.join(repr(n) for n in DT.FRENCH)}], lower({x}))) AS VARCHAR), 2, '0')"


def _ymd(y, m, d):
    return f"{y} || '-' || {_mon(m)} || '-' || lpad({d}, 2, '0')"


def _x(t, p, k):
    return f"regexp_extract({t}, '{p}', {k})"


_MDY, _DMY = f"(?i)({_EN})\\s+(\\d{{1,2}})(?:st|nd|rd|th)?,?\\s+(\\d{{4}})".replace("\\\\", "\\"), f"(?i)(\\d{{1,2}})(?:st|nd|rd|th)?\\s+({_EN})\\s+(\\d{{4}})".replace("\\\\", "\\")
_DM = f"list_filter(regexp_extract_all(t, '(?i)\\d{{1,2}}\\s+(?:{_EN})\\s*\\d{{0,3}}'), lambda x: NOT regexp_matches(x, '[a-z]\\s*\\d{{3}}$', 'i'))[1]".replace("\\\\", "\\")
_MD = f"list_filter(regexp_extract_all(t, '(?i)(?:{_EN})\\s+\\d{{1,2}}(?:st|nd|rd|th)?\\s*,?\\s*\\d{{0,3}}'), lambda x: NOT regexp_matches(x, '\\d(st|nd|rd|th)?(\\s*,\\s*|\\s+)\\d{{3}}$', 'i'))[1]".replace("\\\\", "\\")
_D05 = f"""WITH e AS (SELECT DISTINCT edition_id, conference_start AS t, CAST(year AS VARCHAR) AS y FROM edition_index), g AS (SELECT *, {_DM} AS dm, {_MD} AS md FROM e),
r AS (SELECT edition_id, CASE WHEN regexp_matches(t, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b') THEN regexp_extract(t, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b') WHEN regexp_matches(t, '{_MDY}') THEN {_ymd(_x('t', _MDY, 3), _x('t', _MDY, 1), _x('t', _MDY, 2))}
WHEN regexp_matches(t, '{_DMY}') THEN {_ymd(_x('t', _DMY, 3), _x('t', _DMY, 2), _x('t', _DMY, 1))} END AS sure, CASE WHEN dm IS NOT NULL THEN {_ymd('y', "regexp_extract(dm, '(?i)(" + _EN + ")', 1)", "regexp_extract(dm, '^(\\\\d+)', 1)")}
WHEN md IS NOT NULL THEN {_ymd('y', "regexp_extract(md, '(?i)(" + _EN + ")', 1)", "regexp_extract(md, '(\\\\d{1,2})', 1)")} END AS rough FROM g)
SELECT edition_id, coalesce(sure, rough) AS date, CASE WHEN sure IS NOT NULL THEN 'confirmed' WHEN rough IS NOT NULL THEN 'approximate' ELSE 'unknown' END AS confidence FROM r""".replace("\\\\", "\\")


@reg("d05_first_date", _D05)
def _(s, d):
    e = T(s, d, "edition_index", "edition_id", "conference_start", "year").distinct()
    return e.select("edition_id", DT.first_date(F.col("conference_start"), F.col("year")).alias("x")).select("edition_id", "x.date", "x.confidence")


_TEXT = f"""SELECT DISTINCT edition_id, CAST(year AS VARCHAR) AS y, CASE edition_id % 4 WHEN 0 THEN day(b) || '–' || day(c) || ' ' || strftime(c, '%B') || ' ' || year(c) WHEN 1 THEN '1–2 May 1999; ' || strftime(c, '%B') || ' ' || day(b) || ' to ' || day(c) || ', ' || year(c)
WHEN 2 THEN 'du ' || day(b) || ' au ' || day(c) || ' ' || [{', '.join(repr(n) for n in DT.FRENCH)}][month(c)] || ' ' || year(c) ELSE 'some time in ' || strftime(c, '%B') || ' ' || year END AS t
FROM (SELECT *, try_cast(conference_end AS DATE) AS c, try_cast(conference_end AS DATE) - INTERVAL 2 DAY AS b FROM edition_index)"""
_ANY = f"{_EN}|{_FR}"
_FORMS = [(f"(?i)(\\d{{1,2}})\\s*[–-]\\s*(\\d{{1,2}})\\s+({_ANY})\\s+(\\d{{4}})", 4, 3, 1, 2), (f"(?i)({_ANY})\\s+(\\d{{1,2}})\\s+to\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})", 4, 1, 2, 3), (f"(?i)du\\s+(\\d{{1,2}})\\s+au\\s+(\\d{{1,2}})\\s+({_ANY})\\s+(\\d{{4}})", 4, 3, 1, 2)]
_HITS = " || ".join(f"list_transform(regexp_extract_all(t, '{p}'), lambda x: {{'s': {_ymd(_x('x', p, y), _x('x', p, m), _x('x', p, a))}, 'e': {_ymd(_x('x', p, y), _x('x', p, m), _x('x', p, b))}, 'y': {_x('x', p, y)}}})" for p, y, m, a, b in _FORMS)
_D06 = f"""WITH e AS ({_TEXT}), h AS (SELECT *, {_HITS} AS hits FROM e), b AS (SELECT *, coalesce(list_filter(hits, lambda x: x.y = y)[1], hits[1]) AS best FROM h)
SELECT edition_id, best.s AS first_day, best.e AS last_day, CASE WHEN best IS NOT NULL THEN 'confirmed' WHEN regexp_matches(t, '(?i)({_ANY})\\s+' || y) THEN 'approximate' ELSE 'unknown' END AS confidence FROM b"""


@reg("d06_date_range", _D06)
def _(s, d):
    e = T(s, d, "edition_index", "edition_id", "year", "conference_end").distinct()
    c = F.col("conference_end").try_cast("date")
    b = F.date_sub(c, 2)
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    name, mois = F.date_format(c, "MMMM"), F.element_at(F.array(*map(F.lit, DT.FRENCH)), F.month(c))
    k = F.col("edition_id") % 4
    text = F.when(k == 0, say(F.day(b), "–", F.day(c), " ", name, " ", F.year(c))).when(k == 1, say("1–2 May 1999; ", name, " ", F.day(b), " to ", F.day(c), ", ", F.year(c)))
    text = text.when(k == 2, say("du ", F.day(b), " au ", F.day(c), " ", mois, " ", F.year(c))).otherwise(say("some time in ", name, " ", F.col("year")))
    return e.select("edition_id", DT.date_range(text, F.col("year")).alias("x")).select("edition_id", F.col("x.start").alias("first_day"), F.col("x.end").alias("last_day"), "x.confidence")


@reg("d07_partial_dates", """SELECT DISTINCT edition_id, CASE WHEN least(length(conference_start), length(conference_end)) IN (7, 10) THEN substr(conference_start, 1, least(length(conference_start), length(conference_end))) = substr(conference_end, 1, least(length(conference_start), length(conference_end))) ELSE false END AS same
FROM edition_index""")
def _(s, d):
    e = T(s, d, "edition_index", "edition_id", "conference_start", "conference_end")
    return e.select("edition_id", DT.partial_equal(F.col("conference_start"), F.col("conference_end")).alias("same")).distinct()


_LABEL = "CASE WHEN regexp_matches({0}, '^\\d{{4}}-\\d{{2}}$') THEN substr({0}, 6, 2) || '/' || substr({0}, 3, 2) WHEN try_cast(substr({0}, 1, 10) AS DATE) IS NOT NULL THEN strftime(try_cast(substr({0}, 1, 10) AS DATE), '%d/%m') END"
_ISO = "CASE WHEN regexp_matches(conference_start, '^\\d{4}-\\d{2}(-\\d{2})?') THEN conference_start END"


@reg("d08_date_format", f"""SELECT DISTINCT edition_id, CASE WHEN t IS NULL OR coalesce(date_confidence = 'not_applicable', false) THEN '—' WHEN date_confidence = 'unknown' THEN '?' ELSE coalesce(CASE WHEN date_confidence = 'approximate' THEN '~' ELSE '' END || {_LABEL.format('t')}, substr(t, 1, 10)) END AS shown
FROM (SELECT *, {_ISO} AS t FROM edition_index)""")
def _(s, d):
    iso = F.when(F.col("conference_start").rlike(r"^\d{4}-\d{2}(-\d{2})?"), F.col("conference_start"))
    return T(s, d, "edition_index", "edition_id", "conference_start", "date_confidence").select("edition_id", DT.show_date(iso, F.col("date_confidence")).alias("shown")).distinct()


_END = "coalesce(date_confidence, 'unknown')"


@reg("d09_days_open", f"""SELECT DISTINCT edition_id, CASE WHEN {_END} = 'not_applicable' THEN '—' WHEN {_END} = 'unknown' THEN '?' WHEN n IS NULL OR n < 0 THEN '?' ELSE CASE WHEN {_END} = 'approximate' THEN '~' ELSE '' END || n || 'd' END AS shown
FROM (SELECT *, date_diff('day', try_cast(CASE WHEN length({_ISO}) = 7 THEN {_ISO} || '-01' ELSE substr({_ISO}, 1, 10) END AS DATE), try_cast(conference_end AS DATE)) AS n FROM edition_index)""")
def _(s, d):
    iso = F.when(F.col("conference_start").rlike(r"^\d{4}-\d{2}(-\d{2})?"), F.col("conference_start"))
    state, end = F.col("date_confidence"), F.col("conference_end")
    shown = DT.days_open(iso, state, F.lit("1999-01-01"), state, end, F.lit("confirmed"))
    return T(s, d, "edition_index", "edition_id", "conference_start", "conference_end", "date_confidence").select("edition_id", shown.alias("shown")).distinct()


@reg("d10_settle_month", f"SELECT DISTINCT edition_id, CASE WHEN regexp_matches(conference_start, '^\\d{{4}}-\\d{{2}}$') THEN conference_start || '-01' ELSE conference_start END AS date, CASE WHEN regexp_matches(conference_start, '^\\d{{4}}-\\d{{2}}$') THEN 'approximate' ELSE date_confidence END AS confidence FROM edition_index")
def _(s, d):
    e = T(s, d, "edition_index", "edition_id", "conference_start", "date_confidence").distinct()
    return e.select("edition_id", DT.settle_month(F.col("conference_start"), F.col("date_confidence")).alias("x")).select("edition_id", "x.date", "x.confidence")


@reg("cl05_cell_states", "SELECT state, count(*) AS n FROM (SELECT DISTINCT edition_id, CASE WHEN date_confidence = 'not_applicable' THEN 'not_applicable' WHEN date_confidence = 'confirmed' AND conference_start IS NOT NULL THEN 'confirmed' WHEN date_confidence = 'approximate' AND conference_start IS NOT NULL THEN 'approximate' ELSE 'unknown' END AS state FROM edition_index) GROUP BY 1")
def _(s, d):
    e = T(s, d, "edition_index", "edition_id", "conference_start", "date_confidence")
    return e.select("edition_id", DT.cell_state(F.col("conference_start"), F.col("date_confidence")).alias("state")).distinct().groupBy("state").agg(F.count("*").alias("n"))


@reg("cl06_date_checks", """WITH v AS (SELECT DISTINCT edition_id, substr(conference_start, 1, 10) AS a, conference_end AS b, substr(conference_end, 1, 7) AS c, year % 5 = 0 AS noted FROM edition_index),
m AS (SELECT *, lambda_ab, lambda_ac, lambda_bc FROM (SELECT *, CASE WHEN least(length(a), length(b)) IN (7, 10) THEN substr(a, 1, least(length(a), length(b))) = substr(b, 1, least(length(a), length(b))) ELSE false END AS lambda_ab,
CASE WHEN least(length(a), length(c)) IN (7, 10) THEN substr(a, 1, least(length(a), length(c))) = substr(c, 1, least(length(a), length(c))) ELSE false END AS lambda_ac, CASE WHEN least(length(b), length(c)) IN (7, 10) THEN substr(b, 1, least(length(b), length(c))) = substr(c, 1, least(length(b), length(c))) ELSE false END AS lambda_bc FROM v))
SELECT CASE WHEN a IS NULL THEN 'nothing_stored' WHEN b IS NULL THEN 'not_found' WHEN lambda_ab THEN 'pass' WHEN noted THEN 'noted' WHEN c IS NULL THEN 'inconclusive' WHEN lambda_ac THEN 'stored_confirmed' WHEN lambda_bc THEN 'corrected' ELSE 'third_date' END AS verdict, count(*) AS n FROM m GROUP BY 1""")
def _(s, d):
    e = T(s, d, "edition_index", "edition_id", "conference_start", "conference_end", "year").distinct()
    v = DT.verdict(F.substring("conference_start", 1, 10), F.col("conference_end"), F.substring("conference_end", 1, 7), F.col("year") % 5 == 0)
    return e.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


_RULES_SQL = "CASE WHEN contains(lower(definition_as_reported), 'online') THEN 'online' WHEN regexp_matches(lower(definition_as_reported), 'countries|volunteers') THEN 'other_unit' WHEN verified THEN 'kept' WHEN figure_numeric IS NULL THEN 'no_number' WHEN figure_numeric < 20 THEN 'too_small' ELSE 'kept' END"


@reg("cl01_rule_cascade", f"SELECT {_RULES_SQL} AS reason, count(*) AS n FROM (SELECT DISTINCT fig_id, definition_as_reported, verified, figure_numeric FROM wikimania_2017) GROUP BY 1")
def _(s, d):
    low = F.lower("definition_as_reported")
    rules = [
        ("online", F.contains(low, F.lit("online"))), ("other_unit", low.rlike("countries|volunteers")), ("kept", F.col("verified")),
        ("no_number", F.col("figure_numeric").isNull()), ("too_small", F.col("figure_numeric") < 20), ("kept", F.lit(True)),
    ]
    rows = T(s, d, "wikimania_2017", "fig_id", "definition_as_reported", "verified", "figure_numeric").distinct()
    return R.first_rule(rows, rules).groupBy("reason").agg(F.count("*").alias("n"))


@reg("cl09_lint", "SELECT violation, count(*) AS n FROM (SELECT DISTINCT cand_id, unnest(list_filter([CASE WHEN coalesce(trim(title), '') = '' THEN 'no_title' END, CASE WHEN coalesce(url, '') = '' AND coalesce(doi, '') = '' THEN 'no_locator' END, CASE WHEN year IS NULL THEN 'no_year' END, CASE WHEN NOT regexp_matches(doi, '^10\\.\\d+/\\S+$') AND doi <> '' THEN 'odd_doi' END], lambda x: x IS NOT NULL)) AS violation FROM candidate) GROUP BY 1")
def _(s, d):
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = [("no_title", blank("title")), ("no_locator", blank("url") & blank("doi")), ("no_year", F.col("year").isNull()), ("odd_doi", ~F.col("doi").rlike(r"^10\.\d+/\S+$") & (F.col("doi") != ""))]
    rows = T(s, d, "candidate", "cand_id", "title", "url", "doi", "year")
    return R.all_rules(rows, rules).select("cand_id", "violation").distinct().groupBy("violation").agg(F.count("*").alias("n"))


_KEY = "CASE WHEN coalesce(trim(lower(regexp_replace(doi, '(?i)^(https?://(dx\\.)?doi\\.[a-z.]*/|doi:\\s*)', ''))), '') <> '' THEN 'd:' || trim(lower(regexp_replace(doi, '(?i)^(https?://(dx\\.)?doi\\.[a-z.]*/|doi:\\s*)', ''))) WHEN coalesce(trim(url), '') <> '' THEN 'u:' || regexp_replace(trim(url), '/+$', '') WHEN coalesce(trim(title), '') <> '' THEN 't:' || lower(substr(trim(title), 1, 80)) END"


def _cands(s, d):
    return T(s, d, "candidate", "cand_id", "title", "year", "doi", "url", "strategy", "abstract").distinct()


@reg("u04_dedup_chain", f"SELECT cand_id FROM (SELECT cand_id, k, row_number() OVER (PARTITION BY k ORDER BY cand_id, title) AS r FROM (SELECT DISTINCT cand_id, title, year, doi, url, strategy, abstract, {_KEY} AS k FROM candidate)) WHERE r = 1 OR k IS NULL")
def _(s, d):
    return R.keep_first(_cands(s, d), R.identity_chain(F.col("doi"), F.col("url"), F.col("title")), [F.asc("cand_id"), F.asc("title")]).select("cand_id")


@reg("u07_best_rank", "SELECT k, cand_id FROM (SELECT lower(trim(title)) AS k, cand_id, row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY CASE strategy WHEN 'S3_keyword' THEN 0 WHEN 'S2_forward' THEN 1 ELSE 9 END, cand_id) AS r FROM candidate WHERE trim(title) <> '') WHERE r = 1")
def _(s, d):
    rank = F.when(F.col("strategy") == "S3_keyword", 0).when(F.col("strategy") == "S2_forward", 1).otherwise(9)
    rows = T(s, d, "candidate", "cand_id", "title", "strategy").where("trim(title) <> ''").withColumn("k", F.lower(F.trim("title")))
    return R.keep_first(rows, F.col("k"), [rank, F.asc("cand_id")]).select("k", "cand_id")


@reg("u08_longest_context", "SELECT figure_numeric, u, fig_id FROM (SELECT figure_numeric, substr(source_url, 1, 60) AS u, fig_id, row_number() OVER (PARTITION BY figure_numeric, substr(source_url, 1, 60) ORDER BY length(context) DESC NULLS LAST, fig_id) AS r FROM (SELECT DISTINCT fig_id, figure_numeric, source_url, context FROM wikimania_2017 WHERE figure_numeric IS NOT NULL)) WHERE r = 1")
def _(s, d):
    f = T(s, d, "wikimania_2017", "fig_id", "figure_numeric", "source_url", "context").where("figure_numeric IS NOT NULL").distinct().withColumn("u", F.substring("source_url", 1, URL_HEAD))
    # length first: only it and the id are compared, contexts don't travel
    f = f.select("figure_numeric", "u", "fig_id", F.length("context").alias("n"))
    w = Window.partitionBy("figure_numeric", "u").orderBy(F.desc_nulls_last("n"), "fig_id")
    return f.withColumn("r", F.row_number().over(w)).where("r = 1").select("figure_numeric", "u", "fig_id")


@reg("u09_message_dedup", "SELECT min(msg_id) AS msg_id FROM parse_messages WHERE subject IS NOT NULL AND msg_date IS NOT NULL GROUP BY substr(subject, 1, 60), substr(msg_date, 1, 16)")
def _(s, d):
    m = T(s, d, "parse_messages", "msg_id", "subject", "msg_date").dropna()
    return m.groupBy(F.substring("subject", 1, 60), F.substring("msg_date", 1, 16)).agg(F.min("msg_id").alias("msg_id")).select("msg_id")


@reg("u10_append_unseen", "SELECT DISTINCT cand_id FROM candidate WHERE strategy = 'S3_keyword' AND doi <> '' UNION ALL SELECT min(cand_id) FROM candidate WHERE strategy = 'S2_forward' AND doi <> '' AND lower(doi) NOT IN (SELECT lower(doi) FROM candidate WHERE strategy = 'S3_keyword' AND doi <> '') GROUP BY lower(doi)")
def _(s, d):
    c = T(s, d, "candidate", "cand_id", "doi", "strategy").where("doi <> ''").distinct()
    return R.append_unseen(c.where("strategy = 'S3_keyword'"), c.where("strategy = 'S2_forward'"), F.lower("doi"), [F.asc("cand_id")]).select("cand_id")


_STATE = "CASE WHEN confidence = 'confirmed' THEN 'confirmed' WHEN admitted_via LIKE 'scored%' THEN 'approximate' WHEN admitted_via = 'wikidata' THEN 'not_applicable' ELSE 'unknown' END"


@reg("u12_precedence_merge", f"""WITH r AS (SELECT wiki, page_id, year AS seq, min(nullif(trim(status_tier), '')) AS v, min({_STATE}) AS st FROM node WHERE year IS NOT NULL GROUP BY 1, 2, 3)
SELECT wiki, page_id, m.v AS v, m.st AS st FROM (SELECT wiki, page_id, list_reduce(list({{'v': v, 'st': st}} ORDER BY seq), lambda a, x: CASE WHEN x.v IS NULL OR a.st = 'not_applicable' OR (a.st = 'confirmed' AND a.v IS NOT NULL) OR (a.st = 'approximate' AND a.v IS NOT NULL AND x.st <> 'confirmed') THEN a ELSE x END) AS m FROM r GROUP BY 1, 2)""")
def _(s, d):
    st = F.expr(_STATE)
    n = T(s, d, "node", "wiki", "page_id", "year", "status_tier", "confidence", "admitted_via").where("year IS NOT NULL").groupBy("wiki", "page_id", F.col("year").alias("seq")).agg(F.min(F.nullif(F.trim("status_tier"), F.lit(""))).alias("v"), F.min(st).alias("st"))
    return R.precedence_merge(n, ["wiki", "page_id"], "seq", "v", "st")


@reg("u18_fill_missing", "SELECT c.cand_id, coalesce(min(c.year), min(w.year)) AS year FROM candidate c LEFT JOIN crossref_work w ON lower(c.doi) = lower(w.doi) GROUP BY 1")
def _(s, d):
    w = T(s, d, "crossref_work", "doi", "year").select(F.lower("doi").alias("k"), F.col("year").alias("wy"))
    c = T(s, d, "candidate", "cand_id", "doi", "year").join(w, F.lower("doi") == F.col("k"), "left")
    return c.groupBy("cand_id").agg(F.coalesce(F.min("year"), F.min("wy")).alias("year"))


_DOI = "nullif(lower(trim(regexp_replace({0}, '(?i)^(https?://(dx\\.)?doi\\.[a-z.]*/|doi:\\s*)', ''))), '')"
_LOC = "nullif(lower(regexp_replace(regexp_replace(trim({0}), '^https?://', ''), '/+$', '')), '')"


@reg("j17_fallback_match", f"""WITH k AS (SELECT DISTINCT cand_id, doi AS a, {_DOI.format('doi')} AS b, {_LOC.format('url')} AS c FROM candidate), w AS (SELECT work_id, doi AS a, {_DOI.format('doi')} AS b, {_LOC.format('url')} AS c FROM crossref_work),
wa AS (SELECT a, min(work_id) AS w FROM w GROUP BY 1), wb AS (SELECT b, min(work_id) AS w FROM w GROUP BY 1), wc AS (SELECT c, min(work_id) AS w FROM w GROUP BY 1), m AS (SELECT k.cand_id, min(wa.w) AS a, min(wb.w) AS b, min(wc.w) AS c FROM k LEFT JOIN wa USING (a) LEFT JOIN wb USING (b) LEFT JOIN wc USING (c) GROUP BY 1)
SELECT cand_id, coalesce(a, b, c) AS work_id, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 WHEN c IS NOT NULL THEN 2 END::INTEGER AS via FROM m""")
def _(s, d):
    """The identifier as written, then normalised, then the address, else none."""
    c, w = T(s, d, "candidate", "cand_id", "doi", "url"), T(s, d, "crossref_work", "work_id", "doi", "url")
    doi, loc = F.expr(_DOI.format("doi").replace("\\", "\\\\")), F.expr(_LOC.format("url"))
    return R.fallback_match(c, w, "cand_id", "work_id", [(F.col("doi"), F.col("doi")), (doi, doi), (loc, loc)])


@reg("j18_split", "SELECT strategy, count(DISTINCT cand_id) FILTER (lower(doi) IN (SELECT lower(doi) FROM crossref_work)) AS n_known, count(DISTINCT cand_id) FILTER (doi IS NULL OR lower(doi) NOT IN (SELECT lower(doi) FROM crossref_work)) AS n_new FROM candidate GROUP BY 1")
def _(s, d):
    w = T(s, d, "crossref_work", "doi").select(F.lower("doi").alias("k")).distinct().withColumn("hit", F.lit(True))
    c = T(s, d, "candidate", "cand_id", "doi", "strategy").distinct().join(w, F.lower("doi") == F.col("k"), "left")
    return c.groupBy("strategy").agg(F.count_distinct(F.when(F.col("hit"), F.col("cand_id"))).alias("n_known"), F.count_distinct(F.when(F.col("hit").isNull(), F.col("cand_id"))).alias("n_new"))


_NORM = "trim(regexp_replace(lower(replace({0}, chr(160), ' ')), '\\s+', ' ', 'g'))"
_HARD = "trim(regexp_replace(regexp_replace(regexp_replace(translate({0}, '‘’“”–—', '""\"\"--'), '-\\s+', '', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))".replace('""', "''" * 2, 1)
_TIER = f"""CASE WHEN length(trim(p)) < 15 THEN 'skipped' WHEN contains(lower(t), lower(p)) THEN 'exact' WHEN np <> '' AND contains(nt, np) THEN 'normalized' WHEN hp <> '' AND contains(ht, hp) THEN 'hard' WHEN length(hp) > 80 AND contains(ht, substr(hp, 1, 80)) THEN 'hard_partial' ELSE 'not_found' END"""


@reg("j22_passages", f"""WITH r AS (SELECT DISTINCT w.work_id, c.cand_id, coalesce(c.title, '') AS p, coalesce(w.title, '') AS t FROM candidate c JOIN crossref_work w ON lower(c.doi) = lower(w.doi)), n AS (SELECT *, {_NORM.format('p')} AS np, {_NORM.format('t')} AS nt FROM r), h AS (SELECT *, {_HARD.format('np')} AS hp, {_HARD.format('nt')} AS ht FROM n)
SELECT {_TIER} AS tier, count(*) AS n FROM h GROUP BY 1""")
def _(s, d):
    c = T(s, d, "candidate", "cand_id", "doi", "title").select("cand_id", F.lower("doi").alias("k"), F.col("title").alias("p"))
    w = T(s, d, "crossref_work", "work_id", "doi", "title").select("work_id", F.lower("doi").alias("k"), F.col("title").alias("t"))
    rows = c.join(w, "k").select("work_id", "cand_id", "p", "t").distinct()
    return rows.groupBy(D.verify_passage(F.col("p"), F.col("t")).alias("tier")).agg(F.count("*").alias("n"))


@reg("j24_longest_fragment", "WITH r(fragment, delay) AS (VALUES ('example.org', 1), ('repo7.example.org', 5), ('papers.', 3)), c AS (SELECT DISTINCT url FROM candidate WHERE url <> '') SELECT c.url, max_by(r.delay, (length(r.fragment), r.fragment)) AS delay FROM c LEFT JOIN r ON contains(c.url, r.fragment) GROUP BY 1")
def _(s, d):
    rules = [("example.org", 1), ("repo7.example.org", 5), ("papers.", 3)]
    return R.longest_match(T(s, d, "candidate", "url").where("url <> ''").distinct(), "url", rules, "delay")


@reg("j25_zero_rows", "WITH k(source_type) AS (VALUES ('mailing_list'), ('news'), ('podcast')), f AS (SELECT DISTINCT fig_id, source_type, verified, needs_review FROM wikimania_2017) SELECT k.source_type, count(*) FILTER (verified) AS n_verified, count(*) FILTER (needs_review) AS n_review FROM k LEFT JOIN f USING (source_type) GROUP BY 1")
def _(s, d):
    k = s.createDataFrame([("mailing_list",), ("news",), ("podcast",)], "source_type string")
    f = T(s, d, "wikimania_2017", "fig_id", "source_type", "verified", "needs_review").distinct()
    return R.tally(k, f, "source_type", {"n_verified": F.col("verified"), "n_review": F.col("needs_review")})


@reg("ag29_strength", "SELECT n, CASE WHEN n >= 8 THEN 'strong' WHEN n >= 4 THEN 'moderate' WHEN n >= 1 THEN 'weak' ELSE 'none' END AS strength, count(*) AS n_authors FROM (SELECT a.family AS f, count(DISTINCT work_id) AS n FROM (SELECT work_id, unnest(authors) AS a FROM crossref_work) GROUP BY 1) GROUP BY 1, 2")
def _(s, d):
    a = T(s, d, "crossref_work", "work_id", "authors").select("work_id", F.explode("authors").alias("a")).groupBy(F.col("a.family").alias("f")).agg(F.count_distinct("work_id").alias("n"))
    strength = F.when(F.col("n") >= 8, "strong").when(F.col("n") >= 4, "moderate").when(F.col("n") >= 1, "weak").otherwise("none")
    return a.groupBy("n", strength.alias("strength")).agg(F.count("*").alias("n_authors"))


@reg("ag30_nested_counts", "SELECT strategy, year, count(DISTINCT cand_id) AS n FROM candidate GROUP BY GROUPING SETS ((strategy), (strategy, year))")
def _(s, d):
    c = T(s, d, "candidate", "cand_id", "strategy", "year").distinct()
    per = c.groupBy("strategy", "year").agg(F.count_distinct("cand_id").alias("n"))
    return per.unionByName(c.groupBy("strategy").agg(F.count_distinct("cand_id").alias("n")).withColumn("year", F.lit(None).cast("int")).select("strategy", "year", "n"))


@reg("f23_identifiers", "SELECT DISTINCT cand_id, coalesce(nullif(regexp_extract(doi, '(10\\.\\d{4,9}/\\S+)', 1), ''), nullif(regexp_extract(url, '/item/([a-z]+)', 1), '')) AS ident FROM candidate")
def _(s, d):
    ident = F.coalesce(F.nullif(F.regexp_extract("doi", r"(10\.\d{4,9}/\S+)", 1), F.lit("")), F.nullif(F.regexp_extract("url", "/item/([a-z]+)", 1), F.lit("")))
    return T(s, d, "candidate", "cand_id", "doi", "url").select("cand_id", ident.alias("ident")).distinct()


@reg("sk10_citations", "SELECT DISTINCT work_id, array_to_string(list_transform(authors, lambda a: a.family || ', ' || a.given), ' and ') || '. ' || title || '. ' || coalesce(journal, '') || coalesce(' (' || year || ')', '') AS citation FROM crossref_work")
def _(s, d):
    w = T(s, d, "crossref_work", "work_id", "title", "authors", "year", "journal")
    names = F.array_join(F.transform("authors", lambda a: F.concat(a.family, F.lit(", "), a.given)), " and ")
    text = F.concat(names, F.lit(". "), "title", F.lit(". "), F.coalesce("journal", F.lit("")), F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit("")))
    return w.select("work_id", text.alias("citation")).distinct()


@reg("tk08_source_order", "SELECT fig_id, source_type, figure_numeric, row_number() OVER (ORDER BY CASE source_type WHEN 'meta_wiki' THEN 0 WHEN 'wikipedia' THEN 1 ELSE 2 END, coalesce(figure_numeric, 0) DESC, fig_id)::INTEGER AS rank FROM (SELECT DISTINCT fig_id, source_type, figure_numeric FROM wikimania_2017) ORDER BY rank LIMIT 100")
def _(s, d):
    tier = F.when(F.col("source_type") == "meta_wiki", 0).when(F.col("source_type") == "wikipedia", 1).otherwise(2)
    order = [tier, F.coalesce("figure_numeric", F.lit(0)).desc(), F.asc("fig_id")]
    f = T(s, d, "wikimania_2017", "fig_id", "source_type", "figure_numeric").distinct().orderBy(*order).limit(100)
    return f.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@reg("x04_vector_pairs")
def _(s, d):
    """Exact search: the vectors with ids divisible by 100 against all vectors of any label; the nearest by cosine, the smaller id on ties."""
    e = T(s, d, "embeddings")
    return R.nearest_vectors(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding")


QUERIES, ORACLE = Q, S
