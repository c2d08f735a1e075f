"""Registered queries of the core training-data operators (problems 2, 3, 6) and their SQL."""

from __future__ import annotations

from tideloom.operators.references import orphan_counts, orphan_references
from tideloom.operators.snapshots import snapshot_changes
from tideloom.operators.timestamps import utc_report
from tideloom.sources.tables import table

NODE = ("wiki", "page_id", "year", "loaded_at", "title", "namespace", "is_redirect", "wikidata_qid", "confidence", "admitted_via", "status_tier")


def p2_found(spark, d):
    return snapshot_changes(table(spark, d, "node", *NODE))


def p2_diffs(spark, d):
    changes = snapshot_changes(table(spark, d, "node", *NODE), with_values=True)
    return changes.where("change = 'changed'").selectExpr("wiki", "page_id", "year", "inline(diffs)").selectExpr("wiki", "page_id", "year", "field", "old AS old_value", "new AS new_value")


def p3_found(spark, d):
    return utc_report(table(spark, d, "rfc_opens"), table(spark, d, "ts_feeds"), table(spark, d, "wikimania_2017"), table(spark, d, "edition_index"))


def p6_found(spark, d):
    return orphan_references(table(spark, d, "link"), table(spark, d, "node"))


def p6_counts(spark, d):
    return orphan_counts(p6_found(spark, d))


QUERIES = {"p2_found": p2_found, "p2_diffs": p2_diffs, "p3_found": p3_found, "p6_found": p6_found, "p6_counts": p6_counts}

_HELD = """held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wiki, page_id, year ORDER BY loaded_at DESC) AS rn FROM node) WHERE rn = 1)"""
_CANON = """c AS (SELECT wiki, page_id, year, nullif(replace(nfc_normalize(title), ' ', '_'), '') AS title, CAST(namespace AS VARCHAR) AS namespace, CAST(is_redirect AS VARCHAR) AS is_redirect, CASE WHEN trim(wikidata_qid) <> '' THEN wikidata_qid END AS wikidata_qid,
  CASE WHEN trim(confidence) <> '' THEN confidence END AS confidence, CASE WHEN trim(admitted_via) <> '' THEN admitted_via END AS admitted_via, nullif(lower(trim(status_tier)), '') AS status_tier FROM held),
years AS (SELECT wiki, year, lead(year) OVER (PARTITION BY wiki ORDER BY year) AS next_year FROM (SELECT DISTINCT wiki, year FROM node)),
a AS (SELECT c.*, y.next_year FROM c JOIN years y USING (wiki, year)),
first_year AS (SELECT wiki, min(year) AS year FROM node GROUP BY wiki)"""
_SAME = " AND ".join(f"o.{x} IS NOT DISTINCT FROM n.{x}" for x in ("title", "namespace", "is_redirect", "wikidata_qid", "confidence", "admitted_via", "status_tier"))
_P2 = f"""WITH {_HELD}, {_CANON}
SELECT n.wiki, n.page_id, n.year, 'added' AS change FROM c n WHERE NOT EXISTS (SELECT 1 FROM a o WHERE o.wiki = n.wiki AND o.page_id = n.page_id AND o.next_year = n.year) AND NOT EXISTS (SELECT 1 FROM first_year f WHERE f.wiki = n.wiki AND f.year = n.year)
UNION ALL SELECT o.wiki, o.page_id, o.next_year, 'removed' FROM a o WHERE o.next_year IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c n WHERE o.wiki = n.wiki AND o.page_id = n.page_id AND o.next_year = n.year)
UNION ALL SELECT n.wiki, n.page_id, n.year, 'changed' FROM a o JOIN c n ON o.wiki = n.wiki AND o.page_id = n.page_id AND o.next_year = n.year WHERE NOT ({_SAME})"""
_FIELD = " UNION ALL ".join(
    f"SELECT n.wiki, n.page_id, n.year, '{x}' AS field, o.{x} AS old_value, n.{x} AS new_value FROM a o JOIN c n ON o.wiki = n.wiki AND o.page_id = n.page_id AND o.next_year = n.year WHERE o.{x} IS DISTINCT FROM n.{x}"
    for x in ("title", "namespace", "is_redirect", "wikidata_qid", "confidence", "admitted_via", "status_tier")
)
_RULE = "regexp_replace(regexp_replace(regexp_replace(nfc_normalize({0}), '#.*$', '', 's'), '^[\\s_ ]+|[\\s_ ]+$', '', 'g'), '^:[\\s_ ]*', '')"
_P6 = f"""WITH {_HELD}, n AS (SELECT wiki, page_id, year, namespace AS ns, replace({_RULE.format('title')}, ' ', '_') AS t FROM held), nn AS (SELECT *, upper(substr(t, 1, 1)) || substr(t, 2) AS title FROM n),
l AS (SELECT DISTINCT wiki, year, from_page, to_ns, to_title, to_page, replace({_RULE.format('to_title')}, ' ', '_') AS t FROM link WHERE to_admitted), ll AS (SELECT *, upper(substr(t, 1, 1)) || substr(t, 2) AS title FROM l),
k AS (SELECT wiki, year, 'p' || CAST(page_id AS VARCHAR) AS k FROM nn UNION SELECT wiki, year, 't' || CAST(ns AS VARCHAR) || ':' || title FROM nn),
g AS (SELECT wiki, k, list(year) AS years, min(year) AS lo, max(year) AS hi FROM k GROUP BY wiki, k),
r AS (SELECT ll.*, CASE WHEN to_page IS NOT NULL THEN 'p' || CAST(to_page AS VARCHAR) ELSE 't' || CAST(to_ns AS VARCHAR) || ':' || title END AS k FROM ll)
SELECT DISTINCT r.wiki, r.year, r.from_page, r.to_ns, r.to_title, CASE WHEN g.hi > r.year THEN 'later' WHEN g.lo < r.year THEN 'deleted' ELSE 'missing' END AS kind
FROM r LEFT JOIN g ON r.wiki = g.wiki AND r.k = g.k WHERE g.k IS NULL OR NOT list_contains(g.years, r.year)"""
ORACLE = {
    "p2_found": _P2,
    "p2_diffs": f"WITH {_HELD}, {_CANON} {_FIELD}",
    "p6_found": _P6,
    "p6_counts": f"SELECT wiki, year, kind, count(*) AS n_orphans, count(DISTINCT from_page) AS n_pages FROM ({_P6}) GROUP BY wiki, year, kind",
}
