import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideloom.operators import dates, drift, graph, history, records, reshape


def test_next_event_against_brute_force(spark):
    rng = random.Random(1)
    opens = [(i, rng.randrange(6) or None, rng.randrange(0, 300) * 40_000) for i in range(300)]
    closes = [(1000 + i, rng.randrange(6) or None, rng.randrange(0, 300) * 40_000) for i in range(200)] + [(5000, 1, None)]
    lhs, rhs = spark.createDataFrame(opens, "oid long, p long, t long"), spark.createDataFrame(closes, "cid long, p long, t long")
    out = history.next_event(lhs.withColumnRenamed("t", "a"), rhs.withColumnRenamed("t", "b"), "p", "oid", "a", "cid", "b")
    got = {r.oid: r.cid for r in out.collect()}
    for i, p, t in opens:
        later = [(ct, c) for c, cp, ct in closes if p and cp == p and ct is not None and ct > t]
        assert got[i] == (min(later)[1] if later else None)


def test_packed_round_trip(spark):
    rows = [(1111, "202203", 44), (1111, "202211", 7), (2, "201912", 5)]
    df = spark.createDataFrame(rows, "k long, ym string, n long")
    packed = reshape.pack_counts(df, "k", "ym", "n")
    assert {r.line for r in packed.collect()} == {"u1111 22344 22b7", "u2 19c5"}
    assert sorted(map(tuple, reshape.unpack_counts(packed, "line").collect())) == sorted(rows)


def test_rank_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert [r.row_no for r in reshape.rank_rows(df, [F.asc("x")]).orderBy("x").collect()] == list(range(1, 1001))


def test_components_and_reach(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (200, 200), (None, 3)]
    pairs = graph.undirected(spark.createDataFrame(edges, "s long, t long"), "s", "t")
    got = {r.node: r.component for r in graph.components(pairs).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 200
    seen = {r.node: r.depth for r in graph.reach(pairs, spark.createDataFrame([(5,)], "node long"), 2).collect()}
    assert seen == {5: 0, 4: 1, 6: 1, 3: 2, 7: 2}


def test_pagerank_against_power_iteration(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)]
    got = {r.node: r.rank for r in graph.pagerank(spark.createDataFrame(edges, "a long, b long"), tolerance=1e-6).collect()}
    nodes, out = [1, 2, 3, 4, 5], {a: [b for x, b in edges if x == a] for a in range(1, 6)}
    r = {v: 0.2 for v in nodes}
    for _ in range(200):
        f = {v: 0.85 * sum(r[a] / len(out[a]) for a in nodes if v in out[a]) for v in nodes}
        r = {v: f[v] + (1 - sum(f.values())) * 0.2 for v in nodes}
    assert all(abs(got[v] - r[v]) < 1e-5 for v in nodes)
    two = [(a + 10 * k, b + 10 * k) for a, b in edges for k in (0, 1)]
    pairs, group = spark.createDataFrame(two, "a long, b long"), F.expr("node div 10")
    both = {x.node: x.rank for x in graph.pagerank(pairs, group=group, tolerance=1e-6).collect()}
    assert all(abs(both[v + k] - r[v]) < 1e-5 for v in nodes for k in (0, 10))
    seeds = spark.createDataFrame([(5, "x"), (2, "y")], "node long, anchor string")
    ranks = graph.pagerank(pairs, seeds, group, tolerance=1e-5)
    near = {x.node: x.anchor for x in graph.strongest_anchor(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), ranks, ["x", "y"]).collect()}
    own = {}
    for start in (5, 2):
        q = {v: 0.2 for v in nodes}
        for _ in range(200):
            f = {v: 0.85 * sum(q[a] / len(out[a]) for a in nodes if v in out[a]) for v in nodes}
            q = {v: f[v] + (1 - sum(f.values())) * (v == start) for v in nodes}
        own[start] = q
    assert near == {**{v: "xy"[own[5][v] < own[2][v]] for v in nodes}, **{v: "Other" for v in range(11, 16)}}


def test_rewire_keeps_degrees(spark):
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(80)}
    df = spark.createDataFrame([("g", a, b) for a, b in edges], "g string, a long, b long")
    new = [(r.a, r.b) for r in graph.rewire(df, "g", "a", "b", 1).collect()]
    deg = lambda es: sorted(sum(v in e for e in es) for v in range(30))
    assert deg(new) == deg(edges) and len(set(new)) == len(edges) and set(new) != edges


def test_hubs_of_replicas_are_those_of_their_edges(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(g, *sorted(rng.sample(range(30), 2))) for g in "gh" for _ in range(80)], "g string, a long, b long")
    per = graph.rewire(df, "g", "a", "b", 3).groupBy("g", "rep", "a").count().where("count >= 3").groupBy("g", "rep").count()
    assert sorted(map(tuple, graph.rewire(df, "g", "a", "b", 3, hubs=3).collect())) == sorted(map(tuple, per.collect()))


def test_bootstrap_and_permutation(spark):
    df = spark.createDataFrame([("g" if i % 2 else "h", float(i), i > 150, i) for i in range(200)], "g string, v double, f boolean, i long")
    ci = graph.bootstrap_mean(df, "v", "i", 200).first()
    assert graph.bootstrap_mean(df.repartition(7), "v", "i", 200).first() == pytest.approx(ci)
    assert 85 < ci.low < 99.5 < ci.high < 115
    p = graph.permutation_test(df, "g", "v", "f", "i", 30).first()
    assert p.p == pytest.approx(1 / 31) and p.observed > p.null_mean and 90 < p.null_mean < 110
    even = graph.permutation_test(df.withColumn("f", F.col("i") % 3 == 0), "g", "v", "f", "i", 200).first()
    assert 0.05 < even.p < 0.95
    close = lambda *ps: graph.undirected(spark.createDataFrame([(b + i, b + j) for b in (0, 10, 20) for i in range(6) for j in range(i)] + list(ps), "s long, t long"), "s", "t")
    got = {r.node: r.community for r in graph.label_communities(close((0, 10), (15, 20))).collect()}
    assert len(set(got.values())) == 3 and all(len({got[b + i] for i in range(6)}) == 1 for b in (0, 10, 20))


def test_shared_neighbours_against_brute_force(spark):
    rng = random.Random(3)
    sets = {f"n{i}": {rng.randrange(25) for _ in range(rng.randrange(3, 12))} for i in range(40)}
    rows = [(k, f"f{x}", int(k[1:]) % 3) for k, s in sets.items() for x in s] + [(None, "f1", 1), ("n1", None, 1)]
    got = {(r.a, r.b) for r in graph.shared_neighbours(spark.createDataFrame(rows, "k string, f string, g int"), "k", "f", "g", 3, 0.45).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and int(a[1:]) % 3 != int(b[1:]) % 3 and min(len(sets[a]), len(sets[b])) >= 3 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.45}
    assert got == want and want


def test_common_features_are_compared_in_blocks(spark, monkeypatch):
    """Pairs met in many features and blocks come once; only those that pass leave a block."""
    rng = random.Random(4)
    for name, n in (("LISTED", 3), ("SLICE", 7)):
        monkeypatch.setattr(graph, name, n)
    sets = {i: {rng.randrange(9) for _ in range(rng.randrange(2, 9))} | {100 + i // 2} for i in range(60)}
    kinds = {i: (i % 3, i % 4) for i in sets}
    rows = spark.createDataFrame([(k, x, *kinds[k]) for k, s in sets.items() for x in s], "k long, f long, g int, c long")
    got = sorted((r.a, r.b, r.jaccard) for r in graph.shared_neighbours(rows, "k", "f", "g", 3, 0.45, ("c",)).collect())
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = sorted((a, b, alike(a, b)) for a in sets for b in sets if a < b and all(x != y for x, y in zip(kinds[a], kinds[b])) and min(len(sets[a]), len(sets[b])) >= 3 and alike(a, b) >= 0.45)
    assert got == want and len(want) > 40


def test_nodes_of_equal_sets_share_a_row(spark, monkeypatch):
    """Many nodes with few sets, more than a row holds: every pair once, and blocks get each set once for its nodes."""
    monkeypatch.setattr(graph, "LISTED", 3)
    monkeypatch.setattr(graph, "HELD", 50)
    written, kept = {}, graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, what, **k: [x := kept(df, what, **k), written.update({what: x.count()})][0])
    kinds = [{1, 2, 3}, {1, 2, 3, 4}, {7, 8, 9}, {4, 5, 6, 9}]
    sets = {i: kinds[0 if i < 130 else i % 4] for i in range(240)}
    rows = spark.createDataFrame([(f"n{k}", x, k % 3) for k, s in sets.items() for x in s], "k string, f long, g int")
    got = sorted((r.a, r.b, r.jaccard) for r in graph.shared_neighbours(rows, "k", "f", "g", 3, 0.45).collect())
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = sorted((*sorted((f"n{a}", f"n{b}")), alike(a, b)) for a in sets for b in sets if a < b and a % 3 != b % 3 and alike(a, b) >= 0.45)
    assert got == want and len(want) > 8000
    assert written["prefixes"] < 40  # a row a node would be over 500


def test_clusters_of_sites(spark):
    rng = random.Random(5)
    site = {v: "abc"[v % 3] for v in range(60)}
    cluster = {v: v - v % 3 if v < 45 else v for v in site if v % 7}  # clusters of three sites; some nodes in none
    edges = {tuple(rng.sample(range(60), 2)) for _ in range(700)}
    nodes, cl = spark.createDataFrame(list(site.items()), "node long, site string"), spark.createDataFrame(list(cluster.items()), "node long, component long")
    pairs = graph.undirected(spark.createDataFrame(list(edges), "s long, t long"), "s", "t")
    comp = {v: cluster.get(v, v) for v in site}
    wide = {c for c in comp.values() if len({site[v] for v in site if comp[v] == c}) >= 2}
    near = {v: {comp[b] for a, b in edges | {(b, a) for a, b in edges} if a == v} & wide for v in site}
    prints = graph.cluster_fingerprints(pairs, cl, nodes, "site")
    got = {}
    for r in prints.collect():
        got.setdefault(r.node, set()).add(r.f)
    assert got == {v: f for v, f in near.items() if f}
    alike = {(a, b) for a in site for b in site if a < b and site[a] != site[b] and comp[a] != comp[b] and min(len(near[a]), len(near[b])) >= 6 and len(near[a] & near[b]) / len(near[a] | near[b]) >= 0.45}
    assert {(r.a, r.b) for r in graph.hidden_equivalents(prints, "site").collect()} == alike and alike
    shares = {r.site: tuple(r)[1:] for r in graph.style_shares(nodes, cl, F.col("node") % 5 == 0, "site", "a").collect()}
    styled = {comp[v] for v in site if site[v] == "a" and v % 5 == 0}
    alone = [v for v in site if site[v] == "a" and v % 5 == 0 and {site[w] for w in site if comp[w] == comp[v]} == {"a"}]
    for x in "abc":
        own = [v for v in site if site[v] == x]
        assert shares[x] == (len(own), sum(comp[v] in styled for v in own), sum(v % 5 == 0 for v in own) if x == "a" else 0, len(alone) if x == "a" else 0)


def test_figures_dates_and_merges(spark):
    figures = {"~1,762+": 1762, "600 to 1,400": None, "600–1,400": None, "15th": None, "8 January 2023": 82023, "none": None, "": None, None: None, "≈ 1 762": 1762, "about 20 people": 20, "9" * 40: None}
    df = spark.createDataFrame([(k,) for k in figures], "v string")
    assert {r.v: r.n for r in df.withColumn("n", records.figure_value(F.col("v"))).collect()} == figures
    found = {
        "on 2017-02-02": ("2017-02-02", "confirmed"), "February 2nd, 2017": ("2017-02-02", "confirmed"), "2 February 2017": ("2017-02-02", "confirmed"), "31 March": ("2019-03-31", "approximate"), "March 31st": ("2019-03-31", "approximate"),
        "2 Feb": (None, "unknown"), "2 Foo": (None, "unknown"), "": (None, "unknown"), None: (None, "unknown"), "closed 1 May, then 3 June 2018": ("2018-06-03", "confirmed"),
    }
    assert {r.v: tuple(r.x) for r in spark.createDataFrame([(k,) for k in found], "v string").withColumn("x", dates.first_date(F.col("v"), F.lit(2019))).collect()} == found
    ranges = {
        "5–8 August 2005": ("2005-08-05", "2005-08-08", "confirmed"), "du 3 au 7 août 2026": ("2026-08-03", "2026-08-07", "confirmed"), "du 30 juillet au 2 août 2026": ("2026-07-30", "2026-08-02", "confirmed"),
        "1–2 May 1999, July 10 to 14, 2005": ("2005-07-10", "2005-07-14", "confirmed"), "1&ndash;2 May 1999": ("1999-05-01", "1999-05-02", "confirmed"), "in August 2005": (None, None, "approximate"), "August 2004": (None, None, "unknown"),
        "July 9 through Sunday, July 12": ("2005-07-09", "2005-07-12", "confirmed"), "3rd to 7th of August 2005": ("2005-08-03", "2005-08-07", "confirmed"), None: (None, None, "unknown"),
    }
    assert {r.v: tuple(r.x) for r in spark.createDataFrame([(k,) for k in ranges], "v string").withColumn("x", dates.date_range(F.col("v"), F.lit(2005))).collect()} == ranges
    assert [tuple(r[0]) for r in spark.sql("SELECT '2017-02' d, 'confirmed' c UNION ALL SELECT '2017-02-03', 'confirmed' ORDER BY d").select(dates.settle_month(F.col("d"), F.col("c"))).collect()] == [("2017-02-01", "approximate"), ("2017-02-03", "confirmed")]
    span = spark.createDataFrame([("2017-02-01", "confirmed", "2017-02-11", "confirmed", "2017-03-01", "approximate"), ("2017-02-20", "confirmed", "2017-02-11", "confirmed", None, "unknown"), (None, "not_applicable", "2017-02-11", None, None, None), (None, None, None, None, None, None)], "a string, b string, c string, d string, e string, f string")
    assert [r[0] for r in span.select(dates.days_open(*map(F.col, "abcdef"))).collect()] == ["~28d", "?", "—", "?"]
    rng = random.Random(11)
    states = ["confirmed", "approximate", "unknown", "not_applicable", None]
    rows = [(k, s, rng.choice([None, f"v{s}"]), rng.choice(states)) for k in range(400) for s in range(rng.randrange(1, 7))]
    want = {}
    for k, _, v, st in rows:
        if k not in want:
            want[k] = (v, st)
        elif v is not None:
            cv, cs = want[k]
            if not (cs == "not_applicable" or cs == "confirmed" and cv or cs == "approximate" and cv and st != "confirmed"):
                want[k] = (v, st)
    out = records.precedence_merge(spark.createDataFrame(rows, "k long, s int, v string, st string"), ["k"], "s", "v", "st")
    assert {r.k: (r.v, r.st) for r in out.collect()} == want
    keep = records.keep_first(spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None)], "i int, k string"), F.col("k"), [F.asc("i")])
    assert sorted(r.i for r in keep.collect()) == [1, 3, 4]
    js = spark.createDataFrame([('```json\n[{"a": 1}, {"a": 2}]\n```',), ('text {"a": 5} and {bad} {"a": 6}',)], "t string")
    assert [[x.a for x in r[0]] for r in js.select(records.salvage_json(F.col("t"), "struct<a:int>")).collect()][0] == [1, 2]


def test_drift_functions(spark):
    df = spark.createDataFrame([("The first sentence is here. And a second one follows!", "the first sentence is HERE. nothing"), ("", "x"), (None, None)], "a string, b string")
    assert [round(r[0], 3) for r in df.select(drift.containment(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 1.0]
    html = spark.createDataFrame([("<p>One</p><script>x</script><ul><li>Two <b>bold</b></li></ul>",)], "h string")
    assert html.select(drift.strip_html(F.col("h"))).first()[0].split() == ["One", "Two", "bold"]
    words = drift.word_changes(spark.createDataFrame([(1, "a b b", "b c"), (2, "x", None), (3, "", "")], "i int, t string, p string"), "t", "p", ["i"])
    got = {r.i: (r.n_words, r.words_added, r.words_removed, r.cosine) for r in words.collect()}
    assert got == {1: (3, 2, 1, 0.6325), 2: (1, None, None, None), 3: (0, 0, 0, 0.0)}
