"""Queries of area E: links and nodes as graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideloom.functions.text import page_title
from tideloom.operators import graph as G
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


# The sites of the data, numbered; a node is a page of a site in a year, so years are graphs of their own.
_WIKI = "CAST(CASE wiki WHEN 'enwiki' THEN 1 WHEN 'dewiki' THEN 2 WHEN 'frwiki' THEN 3 WHEN 'eswiki' THEN 4 WHEN 'nlwiki' THEN 5 WHEN 'svwiki' THEN 6 END AS BIGINT) * 1000000000 + CAST(year AS BIGINT) * 100000000000"
_N = f"n AS (SELECT DISTINCT wiki, year, {_WIKI} + page_id AS id FROM node WHERE year IS NOT NULL AND page_id IS NOT NULL)"
_E = f"e AS (SELECT DISTINCT {_WIKI} + from_page AS a, {_WIKI} + to_page AS b FROM link WHERE year IS NOT NULL AND to_page IS NOT NULL AND from_page IS NOT NULL)"
_K = "k AS (SELECT * FROM e WHERE a IN (SELECT id FROM n) AND b IN (SELECT id FROM n)), u AS (SELECT a, b FROM k UNION SELECT b, a FROM k)"
_BASE = f"WITH RECURSIVE {_N}, {_E}, {_K}"
_SITE = "node div 1000000000"


def _nodes(s, d):
    n = T(s, d, "node", "wiki", "year", "page_id").where("year IS NOT NULL AND page_id IS NOT NULL")
    return n.select("wiki", F.concat_ws(":", "wiki", F.col("year").cast("string")).alias("site"), F.expr(f"{_WIKI} + page_id").alias("id")).distinct()


def _edges(s, d):
    l = T(s, d, "link", "wiki", "year", "from_page", "to_page").where("year IS NOT NULL AND to_page IS NOT NULL AND from_page IS NOT NULL")  # noqa: E741
    return l.select(F.expr(f"{_WIKI} + from_page").alias("a"), F.expr(f"{_WIKI} + to_page").alias("b")).distinct()


def _pairs(s, d):
    return G.undirected(G.known_ends(_edges(s, d), _nodes(s, d), "a", "b", "id"), "a", "b")


@reg("gr01_undirected", f"{_BASE} SELECT a, b FROM u")
def _(s, d):
    return _pairs(s, d)


@reg("gr03_degrees", f"{_BASE}, g AS (SELECT a AS id, count(*) AS degree FROM u GROUP BY 1), m AS (SELECT n.id, n.wiki || ':' || n.year AS site, coalesce(degree, 0) AS degree FROM n LEFT JOIN g USING (id)) SELECT id, site, degree, round(CASE WHEN avg(degree) OVER (PARTITION BY site) > 0 THEN degree / avg(degree) OVER (PARTITION BY site) ELSE 0 END, 4) AS relative FROM m")
def _(s, d):
    return G.degrees(_pairs(s, d), _nodes(s, d), "id", "site")


@reg("gr02_components", f"{_BASE}, r(node, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1")
def _(s, d):
    return G.components(_pairs(s, d))


@reg("gr07_shared_neighbours", """WITH x AS (SELECT DISTINCT wiki || year || ':' || from_page AS k, to_ns AS g, wiki || year || to_title AS f FROM link WHERE from_page IS NOT NULL AND to_ns IS NOT NULL AND to_title IS NOT NULL AND wiki IS NOT NULL AND year IS NOT NULL), c AS (SELECT k, g, list(f) AS s, count(*) AS n FROM x GROUP BY 1, 2 HAVING count(*) >= 2),
p AS (SELECT a.k AS ka, a.g AS ga, b.k AS kb, b.g AS gb, count(*) AS shared FROM x a JOIN x b ON a.f = b.f AND a.k < b.k AND a.g <> b.g GROUP BY 1, 2, 3, 4) SELECT ka AS a, kb AS b, round(shared / (ca.n + cb.n - shared), 4) AS jaccard FROM p JOIN c ca ON ca.k = ka AND ca.g = ga JOIN c cb ON cb.k = kb AND cb.g = gb WHERE shared / (ca.n + cb.n - shared) >= 0.3""")
def _(s, d):
    l = T(s, d, "link", "wiki", "year", "from_page", "to_ns", "to_title")  # noqa: E741
    y = F.col("year").cast("string")
    m = l.select(F.concat("wiki", y, F.lit(":"), F.col("from_page").cast("string")).alias("k"), F.col("to_ns").alias("g"), F.concat("wiki", y, "to_title").alias("f"))
    return G.shared_neighbours(m, "k", "f", "g", 2, 0.3).select("a", "b", F.round("jaccard", 4).alias("jaccard"))


def _interwiki(s, d):
    """Both directions of pages of two sites and one year that have the same item."""
    n = T(s, d, "node", "wiki", "year", "page_id", "wikidata_qid").where("wikidata_qid <> '' AND year IS NOT NULL AND page_id IS NOT NULL").select("wiki", F.concat("year", F.lit(":"), "wikidata_qid").alias("q"), F.expr(f"{_WIKI} + page_id").alias("id")).distinct()
    both = n.alias("x").join(n.alias("y"), (F.col("x.q") == F.col("y.q")) & (F.col("x.wiki") != F.col("y.wiki")))
    return both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


_IW = f"""{_BASE}, q AS (SELECT DISTINCT wiki, year || ':' || wikidata_qid AS q, {_WIKI} + page_id AS id FROM node WHERE wikidata_qid <> '' AND year IS NOT NULL AND page_id IS NOT NULL), w AS (SELECT DISTINCT x.id AS a, y.id AS b FROM q x JOIN q y ON x.q = y.q AND x.wiki <> y.wiki),
r(node, c) AS (SELECT a, a FROM w UNION SELECT w.b, r.c FROM r JOIN w ON w.a = r.node), cl AS (SELECT node, min(c) AS component FROM r GROUP BY 1)"""


def _clusters(s, d):
    return materialise(G.components(_interwiki(s, d)), "clusters")


@reg("gr04_spanning_components", f"{_IW} SELECT component, count(DISTINCT wiki) AS n_wikis, coalesce(min(id) FILTER (wiki = 'enwiki'), min(id)) AS label FROM cl JOIN n ON n.id = cl.node GROUP BY 1 HAVING count(DISTINCT wiki) >= 3")
def _(s, d):
    c = _clusters(s, d).join(_nodes(s, d), F.col("node") == F.col("id")).groupBy("component")
    return c.agg(F.count_distinct("wiki").alias("n_wikis"), F.coalesce(F.min(F.when(F.col("wiki") == "enwiki", F.col("id"))), F.min("id")).alias("label")).where("n_wikis >= 3")


def _titled(s, d):
    n = T(s, d, "node", "wiki", "year", "page_id", "title").where("year IS NOT NULL AND page_id IS NOT NULL")
    style = F.replace("title", F.lit(" "), F.lit("_")).startswith("How_to_treat") | F.replace("title", F.lit(" "), F.lit("_")).startswith("Advice")
    return n.select("wiki", F.expr(f"{_WIKI} + page_id").alias("node"), style.alias("style")).groupBy("wiki", "node").agg(F.coalesce(F.max("style"), F.lit(False)).alias("style"))


def _topics(s, d):
    """Clusters of pages of one year that are about one topic, the last word but one of the title. (The data's sites share no items.)"""
    n = T(s, d, "node", "wiki", "year", "page_id", "title").where("title IS NOT NULL AND year IS NOT NULL AND page_id IS NOT NULL")
    w = F.split(F.lower("title"), "[ _]+")
    n = n.select(F.expr(f"{_WIKI} + page_id").alias("node"), "year", F.try_element_at(w, F.lit(-2)).alias("topic")).groupBy("node", "year").agg(F.min("topic").alias("topic")).where("topic IS NOT NULL")
    least = n.groupBy("year", "topic").agg(F.min("node").alias("component"))
    return materialise(n.join(least, ["year", "topic"]).select("node", "component"), "topics")


_TOPICS = f"""{_BASE}, tw AS (SELECT {_WIKI} + page_id AS node, year, min(list_extract(regexp_split_to_array(lower(title), '[ _]+'), -2)) AS topic FROM node WHERE title IS NOT NULL AND year IS NOT NULL AND page_id IS NOT NULL GROUP BY 1, 2),
cl AS (SELECT node, min(node) OVER (PARTITION BY year, topic) AS component FROM tw WHERE topic IS NOT NULL)"""
_TITLED = f"t AS (SELECT wiki, {_WIKI} + page_id AS node, coalesce(bool_or(replace(title, ' ', '_') LIKE 'How\\_to\\_treat%' ESCAPE '\\' OR title LIKE 'Advice%'), false) AS style FROM node WHERE year IS NOT NULL AND page_id IS NOT NULL GROUP BY 1, 2)"


@reg("gr05_style_shares", f"""{_TOPICS}, {_TITLED}, x AS (SELECT t.*, coalesce(component, t.node) AS c FROM t LEFT JOIN cl ON cl.node = t.node), p AS (SELECT c, bool_or(style AND wiki = 'enwiki') AS styled, count(DISTINCT wiki) AS k FROM x GROUP BY 1)
SELECT wiki, count(*) AS n_pages, count(*) FILTER (styled) AS n_styled, count(*) FILTER (style AND wiki = 'enwiki') AS n_style, count(*) FILTER (style AND wiki = 'enwiki' AND k = 1) AS n_only_here FROM x JOIN p USING (c) GROUP BY 1""")
def _(s, d):
    return G.style_shares(_titled(s, d), _topics(s, d), F.col("style"), "wiki", "enwiki")


_PRINTS = f"""{_TOPICS}, z AS (SELECT id AS node, wiki, coalesce(component, id) AS component FROM (SELECT DISTINCT id, wiki FROM n) LEFT JOIN cl ON cl.node = id), wide AS (SELECT component AS f FROM z GROUP BY 1 HAVING count(DISTINCT wiki) >= 2),
fp AS (SELECT DISTINCT u.a AS node, z.component AS f FROM u JOIN z ON z.node = u.b WHERE z.component IN (SELECT f FROM wide))"""


def _prints(s, d):
    n = _nodes(s, d).select("wiki", F.col("id").alias("node"))
    return G.cluster_fingerprints(_pairs(s, d), _topics(s, d), n, "wiki")


@reg("gr07_fingerprints", f"{_PRINTS} SELECT node, count(*) AS n_clusters, min(f) AS least FROM fp GROUP BY 1")
def _(s, d):
    return _prints(s, d).groupBy("node").agg(F.count("*").alias("n_clusters"), F.min("f").alias("least"))


@reg("gr08_hidden_equivalents", f"""{_PRINTS}, g AS (SELECT node, list(f) AS s FROM fp GROUP BY 1 HAVING count(*) >= 3), p AS (SELECT DISTINCT x.node AS a, y.node AS b FROM fp x JOIN fp y ON x.f = y.f AND x.node < y.node JOIN z zx ON zx.node = x.node JOIN z zy ON zy.node = y.node WHERE zx.wiki <> zy.wiki AND zx.component <> zy.component)
SELECT a, b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(x.s || y.s)), 4) AS jaccard FROM p JOIN g x ON x.node = a JOIN g y ON y.node = b WHERE len(list_intersect(x.s, y.s)) / len(list_distinct(x.s || y.s)) >= 0.45""")
def _(s, d):
    return G.hidden_equivalents(materialise(_prints(s, d), "prints"), "wiki", 3, 0.45).select("a", "b", F.round("jaccard", 4).alias("jaccard"))


@reg("gr09_pagerank")
def _(s, d):
    return G.pagerank(_edges(s, d), group=F.expr(_SITE)).withColumn("rank", F.round("rank", 8))


_ANCHORS = {"content": ["sourcing", "neutrality", "notability"], "user_user": ["civility", "disambiguation"], "user_admin": ["blocking", "copyright"]}


def _anchors(s, d):
    """Anchor nodes: pages whose title names one of the words, and all of their clusters."""
    words = s.createDataFrame([(w, a) for a, ws in _ANCHORS.items() for w in ws], "w string, anchor string")
    n = T(s, d, "node", "wiki", "year", "page_id", "title").where("wiki = 'enwiki' AND year IS NOT NULL AND page_id IS NOT NULL AND title IS NOT NULL")
    n = n.select(F.expr(f"{_WIKI} + page_id").alias("node"), F.explode(F.split(F.lower("title"), "[ _]+")).alias("w")).join(words, "w").select("node", "anchor").distinct()
    c = _clusters(s, d)
    seeds = n.join(c, "node", "left").select(F.coalesce("component", "node").alias("component"), "anchor").distinct()
    members = _nodes(s, d).select(F.col("id").alias("node")).join(c, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return members.join(seeds, "component").select("node", "anchor").distinct()


@reg("gr10_anchor_members", f"""{_IW}, a(w, anchor) AS (VALUES {', '.join(f"('{w}', '{a}')" for a, ws in _ANCHORS.items() for w in ws)}), t AS (SELECT DISTINCT {_WIKI} + page_id AS node, unnest(regexp_split_to_array(lower(title), '[ _]+')) AS w FROM node WHERE wiki = 'enwiki' AND year IS NOT NULL AND page_id IS NOT NULL AND title IS NOT NULL),
s AS (SELECT DISTINCT coalesce(component, t.node) AS component, anchor FROM t JOIN a USING (w) LEFT JOIN cl ON cl.node = t.node) SELECT DISTINCT id AS node, anchor FROM n LEFT JOIN cl ON cl.node = id JOIN s ON s.component = coalesce(cl.component, id)""")
def _(s, d):
    return _anchors(s, d)


@reg("gr09_anchors")
def _(s, d):
    """Each node with the anchor of the greatest personalised rank in its site and year, Other if none reaches it."""
    pairs = materialise(_pairs(s, d), "pairs")
    ranks = G.pagerank(pairs, materialise(_anchors(s, d), "anchors"), F.expr(_SITE))
    return G.strongest_anchor(_nodes(s, d).select(F.col("id").alias("node")), ranks, list(_ANCHORS))


@reg("gr11_communities")
def _(s, d):
    return G.label_communities(_pairs(s, d))


@reg("gr12_rewired_degrees", f"{_BASE} SELECT a AS id, count(*) AS degree FROM u WHERE a <> b GROUP BY 1")
def _(s, d):
    """Degrees survive rewiring, so each replica must give those of the graph."""
    pairs = _pairs(s, d).withColumn("g", F.expr("a div 1000000000"))
    r = G.rewire(pairs, "g", "a", "b", 1)
    both = r.select(F.col("a").alias("id")).unionAll(r.select(F.col("b").alias("id")))
    return both.groupBy("id").agg(F.count("*").alias("degree"))


@reg("gr14_reach", f"{_BASE}, r(node, depth) AS (SELECT id, 0 FROM n WHERE id % 100000000000 = 1000000777 UNION SELECT u.b, depth + 1 FROM r JOIN u ON u.a = r.node WHERE depth < 2) SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY 1")
def _(s, d):
    return G.reach(_pairs(s, d), _nodes(s, d).where("id % 100000000000 = 1000000777").select(F.col("id").alias("node")), 2)


_M = """m AS (SELECT DISTINCT wiki || ':' || year AS site, wiki || ':' || year || ':' || from_page AS k, to_title AS t FROM link WHERE from_page IS NOT NULL AND wiki IS NOT NULL AND year IS NOT NULL AND to_title IS NOT NULL), c AS (SELECT DISTINCT wiki || ':' || year || ':' || page_id AS k FROM node WHERE confidence = 'confirmed' AND wiki IS NOT NULL AND year IS NOT NULL AND page_id IS NOT NULL),
b AS (SELECT site, avg(CASE WHEN c.k IS NOT NULL THEN 1.0 ELSE 0.0 END) AS base FROM (SELECT DISTINCT site, k FROM m) LEFT JOIN c USING (k) GROUP BY 1), lf AS (SELECT site, t AS f, count(*) AS has, count(c.k) AS has_core, round(CASE WHEN base > 0 THEN count(c.k) / count(*) / base ELSE 0 END, 4) AS lift FROM m JOIN b USING (site) LEFT JOIN c USING (k) GROUP BY site, t, base HAVING count(*) >= 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY lift DESC, has DESC, encode(f)) AS place FROM lf) WHERE place <= 40)"""


def _features(s, d):
    site = F.concat_ws(":", "wiki", F.col("year").cast("string"))
    l = T(s, d, "link", "wiki", "year", "from_page", "to_title").dropna()  # noqa: E741
    core = T(s, d, "node", "wiki", "year", "page_id", "confidence").where("confidence = 'confirmed'").dropna()
    return l.select(site.alias("site"), F.concat(site, F.lit(":"), F.col("from_page").cast("string")).alias("k"), F.col("to_title").alias("f")), core.select(F.concat(site, F.lit(":"), F.col("page_id").cast("string")).alias("k"))


@reg("ag17_support_density", f"""WITH {_M} SELECT site || '|' || t AS f, count(*) AS n_members, count(c.k) AS support, round(count(c.k) / count(*), 4) AS density, (count(c.k) >= 2 AND count(c.k) / count(*) >= 0.5) AS is_indicator FROM m LEFT JOIN c USING (k) GROUP BY 1""")
def _(s, d):
    members, core = _features(s, d)
    return G.support_density(members.withColumn("f", F.concat("site", F.lit("|"), "f")), core, "k", "f", 2, 0.5)


@reg("j23_evidence", f"""WITH {_M}, d AS (SELECT site, t, round(count(c.k) / count(*), 4) AS density FROM m LEFT JOIN c USING (k) GROUP BY 1, 2 HAVING count(c.k) >= 2 AND count(c.k) / count(*) >= 0.5)
SELECT k, count(*) AS n_signs, max(density) AS best FROM m JOIN d USING (site, t) WHERE k NOT IN (SELECT k FROM c) GROUP BY 1""")
def _(s, d):
    """Pages outside the core with the indicators they hold, joined back to the members."""
    members, core = _features(s, d)
    m = members.withColumn("f", F.concat("site", F.lit("|"), "f")).distinct()
    signs = G.support_density(m, core, "k", "f", 2, 0.5).where("is_indicator").select("f", "density")
    return m.join(signs, "f").join(core.distinct(), "k", "left_anti").groupBy("k").agg(F.count("*").alias("n_signs"), F.max("density").alias("best"))


def _lifts(s, d):
    return G.lift(*_features(s, d), "k", "f", "site", 2)


@reg("ag27_lift", f"WITH {_M} SELECT * FROM lf")
def _(s, d):
    return _lifts(s, d)


@reg("tk06_best_features", f"WITH {_M} SELECT site, f, has, has_core, lift, place::INTEGER AS place FROM best WHERE place <= 20")
def _(s, d):
    return G.best_features(_lifts(s, d), "site", "f", 20)


@reg("st05_likely_misses", f"WITH {_M} SELECT m.site, k, count(*) AS n FROM m JOIN best ON best.site = m.site AND best.f = m.t WHERE k NOT IN (SELECT k FROM c) GROUP BY 1, 2 HAVING count(*) >= 2")
def _(s, d):
    members, core = _features(s, d)
    return G.likely_misses(members, core, G.best_features(_lifts(s, d), "site", "f", 40), "k", "f", "site")


@reg("j09_title_lookup", """WITH n AS (SELECT wiki, year, namespace, title, min(page_id) AS page_id FROM node WHERE title IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT DISTINCT l.wiki, l.year, l.from_page, l.to_ns, l.to_title, n.page_id FROM link l LEFT JOIN n ON l.wiki = n.wiki AND l.year = n.year AND l.to_ns = n.namespace AND l.to_title = n.title""")
def _(s, d):
    n = T(s, d, "node", "wiki", "year", "namespace", "title", "page_id").where("title IS NOT NULL").groupBy("wiki", "year", F.col("namespace").alias("to_ns"), F.col("title").alias("to_title")).agg(F.min("page_id").alias("page_id"))
    l = T(s, d, "link", "wiki", "year", "from_page", "to_ns", "to_title")  # noqa: E741
    return l.join(n, ["wiki", "year", "to_ns", "to_title"], "left").select("wiki", "year", "from_page", "to_ns", "to_title", "page_id").distinct()


@reg("j13_alias_over_canonical", "SELECT wiki, year, namespace, title, max_by(page_id, (is_redirect::INTEGER, page_id)) AS page_id FROM node WHERE title IS NOT NULL AND is_redirect IS NOT NULL GROUP BY 1, 2, 3, 4")
def _(s, d):
    n = T(s, d, "node", "wiki", "year", "namespace", "title", "page_id", "is_redirect").where("title IS NOT NULL AND is_redirect IS NOT NULL")
    return n.groupBy("wiki", "year", "namespace", "title").agg(F.max_by("page_id", F.struct(F.col("is_redirect").cast("int"), "page_id")).alias("page_id"))


@reg("j14_interwiki_pairs", """SELECT DISTINCT a.year, least(a.wiki || ':' || a.page_id, b.wiki || ':' || b.page_id) AS x, greatest(a.wiki || ':' || a.page_id, b.wiki || ':' || b.page_id) AS y FROM node a JOIN node b ON a.wikidata_qid = b.wikidata_qid AND a.year = b.year AND a.wiki < b.wiki WHERE a.wikidata_qid <> ''""")
def _(s, d):
    n = T(s, d, "node", "wiki", "year", "page_id", "wikidata_qid").where("wikidata_qid <> ''").select("wiki", "year", "wikidata_qid", F.concat_ws(":", "wiki", "page_id").alias("id")).distinct()
    a, b = n.alias("a"), n.alias("b")
    j = a.join(b, (F.col("a.wikidata_qid") == F.col("b.wikidata_qid")) & (F.col("a.year") == F.col("b.year")) & (F.col("a.wiki") < F.col("b.wiki")))
    return j.select("a.year", F.least("a.id", "b.id").alias("x"), F.greatest("a.id", "b.id").alias("y")).distinct()


@reg("u02_set_algebra", "SELECT wiki, year, page_id FROM node WHERE confidence = 'confirmed' UNION SELECT wiki, year, page_id FROM node WHERE admitted_via = 'wikidata' EXCEPT SELECT wiki, year, page_id FROM node WHERE trim(lower(status_tier)) = 'essay'")
def _(s, d):
    n = T(s, d, "node", "wiki", "year", "page_id", "confidence", "admitted_via", "status_tier")
    ids = lambda c: n.where(c).select("wiki", "year", "page_id")
    return ids("confidence = 'confirmed'").union(ids("admitted_via = 'wikidata'")).distinct().exceptAll(ids("trim(lower(status_tier)) = 'essay'").distinct())


@reg("u03_first_writer", "SELECT wiki, page_id, min_by(admitted_via, (CASE admitted_via WHEN 'status_template' THEN 0 WHEN 'wikidata' THEN 1 ELSE 2 END, admitted_via)) AS via FROM node WHERE admitted_via IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    rank = F.when(F.col("admitted_via") == "status_template", 0).when(F.col("admitted_via") == "wikidata", 1).otherwise(2)
    return T(s, d, "node", "wiki", "page_id", "admitted_via").where("admitted_via IS NOT NULL").groupBy("wiki", "page_id").agg(F.min_by("admitted_via", F.struct(rank.alias("r"), "admitted_via")).alias("via"))


@reg("ag39_year_counts", "WITH y AS (SELECT unnest(generate_series(2010, 2026))::INTEGER AS year), n AS (SELECT year, count(page_id) AS n_nodes, count(*) FILTER (confidence = 'confirmed') AS n_confirmed FROM node GROUP BY 1), l AS (SELECT year, count(*) AS n_links FROM link GROUP BY 1) SELECT y.year, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_confirmed, 0) AS n_confirmed, coalesce(n_links, 0) AS n_links FROM y LEFT JOIN n USING (year) LEFT JOIN l USING (year)")
def _(s, d):
    spine = s.range(2010, 2027).select(F.col("id").cast("int").alias("year"))
    y = F.col("year").cast("int").alias("year")
    nodes = T(s, d, "node", "year", "page_id", "confidence").groupBy(y).agg(F.count("page_id").alias("n_nodes"), F.sum(F.when(F.col("confidence") == "confirmed", 1).otherwise(0)).alias("n_confirmed"))
    links = T(s, d, "link", "year").groupBy(y).agg(F.count("*").alias("n_links"))
    return spine.join(nodes, "year", "left").join(links, "year", "left").fillna(0, ["n_nodes", "n_confirmed", "n_links"])


@reg("f04_link_targets", "SELECT DISTINCT to_title, CASE WHEN strpos(to_title, ':') > 1 THEN lower(split_part(to_title, ':', 1)) ELSE '' END AS prefix FROM link WHERE to_title IS NOT NULL")
def _(s, d):
    t = T(s, d, "link", "to_title").where("to_title IS NOT NULL").distinct()
    return t.select("to_title", F.when(F.instr("to_title", ":") > 1, F.lower(F.split_part("to_title", F.lit(":"), F.lit(1)))).otherwise("").alias("prefix"))


@reg("st01_bootstrap")
def _(s, d):
    deg = _pairs(s, d).groupBy("a").agg(F.count("*").alias("degree"))
    return G.bootstrap_mean(deg, "degree", "a", 500)


@reg("st02_permutation")
def _(s, d):
    return G.permutation_test(T(s, d, "events").select("event_id", "event_type", "value", (F.col("value") > 50).alias("flag")), "event_type", "value", "flag", "event_id", 500)


QUERIES, ORACLE = Q, S
