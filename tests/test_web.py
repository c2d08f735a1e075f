import json
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tideloom.functions import text, web
from tideloom.operators import drift, history, records
from tideloom.plans.pages import QUERIES
from tideloom.sources import api, sinks


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values[0]))]
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r.x for r in rows.select("i", f(*map(F.col, names)).alias("x")).orderBy("i").collect()]


def test_pages(spark):
    assert one(spark, web.html_text, ("<p>a &amp; b&nbsp;<b>c</b></p><script>x</script>",), (None,), ("",)) == ["a & b c", None, ""]
    df = spark.createDataFrame([(1, '<h2>T<span class="mw-editsection">[edit]</span></h2><p>One <sup class="reference">[1]</sup>two</p>tail<style>p{}</style>'), (2, None), (3, "")], "k int, page string")
    assert [tuple(r) for r in web.visible_blocks(df, "k", "page").orderBy("k", "block_no").collect()] == [(1, 1, "T"), (1, 2, "One two"), (1, 3, "tail")]
    assert web.charset_of(b"\xef\xbb\xbfx", None) == "utf-8-sig" and web.charset_of(b'<meta charset="latin-1">', "charset=utf-8") == "iso8859-1"
    assert web.charset_of("é".encode("cp1252") + b"x", None) == "cp1252" and web.charset_of("é".encode(), "text/html; charset=utf-16") == "utf-16" and web.charset_of(b"x", "charset=nope") == "utf-8"
    assert one(spark, text.hard_form, ("The  “ﬁrst” re-\nform — of​ Élan",), (None,)) == ["the first reform of lan", None]
    long = "Some longer passage of a text, which goes on for more than eighty characters and then ends otherwise."
    got = one(spark, drift.verify_passage, ("short", "short"), ("some LONGER passage", long), ("some  longer passage", long), ("Some longer passage — of a text", long), (long.replace("otherwise", "so"), long), ("nothing of the kind", long), (None, long), ("nothing of the kind", None))
    assert got == ["skipped", "exact", "normalized", "hard", "hard_partial", "not_found", "skipped", "not_found"]


def test_addresses(spark):
    parts = one(spark, web.url_parts, ("HTTPS://A.org/p/q?x=1&x=%C3%A9&y=%zz&=3#f",), ("no address",), (None,))
    assert tuple(parts[0])[:3] == ("https", "a.org", "/p/q") and parts[0].query["x"] == "é" and set(parts[0].query) == {"x", "y"}
    assert parts[1].host == "" and parts[1].query == {}
    assert one(spark, web.freshness, ("https://x.org/a.PDF",), ("https://x.org/2021/08/x",), ("https://arxiv.org/abs/1",), ("https://x.org/wiki/A",), ("https://x.org/",), ("https://me.medium.com/a",)) == ["specific", "specific", "immutable", "docs", "rolling", "specific"]
    assert one(spark, web.raw_snapshot, ("https://w.org/web/20170102030405/http://w.org/web/20170102030405/",)) == ["https://w.org/web/20170102030405id_/http://w.org/web/20170102030405/"]
    assert one(spark, lambda h: web.retry_after(h, F.lit(0.0)), ("120",), ("Thu, 01 Jan 1970 00:01:00 GMT",), ("Wed, 31 Dec 1969 00:00:00 GMT",), ("soon",), (None,)) == [120, 60, 0, 5, 5]
    assert one(spark, web.arxiv_id, (None, "http://arxiv.org/abs/2101.00001v2"), ("10.48550/ARXIV.2101.2", None), ("arXiv:2101.3", ""), (None, None)) == ["2101.00001", "2101.2", "2101.3", None]
    assert one(spark, web.plain_latex, ("{\\emph{A}} \\& {B}--C",), (None,)) == ["A & B–C", None]
    key = spark.sql("SELECT array('Ann van Holt') a, 2010 y, 'The Effects of Trust' t UNION ALL SELECT array(), null, 'An it' UNION ALL SELECT null, null, null").select(web.citekey(F.col("a"), F.col("y"), F.col("t")))
    assert [r[0] for r in key.collect()] == ["holt2010trust", "unknown0000an", "unknown0000x"]
    assert one(spark, lambda t: api.link_target(t, {"user": 2}), ("User : A b",), ("Other:X",), (":X",), (None,)) == [(2, "A_b"), (0, "Other:X"), (0, ":X"), (0, None)]


def test_dates_in_a_new_worker():
    """A worker that has imported nothing yet finds all that the function needs."""
    read = "import pickle, sys\nimport pandas as pd\nprint(pickle.load(sys.stdin.buffer)(pd.Series(['Thu, 01 Jan 1970 00:01:00 GMT', 'soon'])).fillna(-1).tolist())"
    got = subprocess.run([sys.executable, "-c", read], input=cloudpickle.dumps(web._http_date.func), capture_output=True, check=False)
    assert got.stdout.decode().strip() == "[60.0, -1.0]", got.stderr.decode()


def answers(spark, *bodies):
    return spark.createDataFrame([(json.dumps(b) if not isinstance(b, str) else b,) for b in bodies], "body string")


def test_answers(spark):
    page = {"query": {"pages": [{"pageid": 1, "title": "A", "revisions": [{"revid": 5, "timestamp": "t", "user": "u", "slots": {"main": {"content": "x"}}}, {"revid": 6, "content": "y"}]}, {"title": "B"}]}, "continue": {"rvcontinue": "n"}}
    assert [(r.title, r.rev_id, r.text, r.next_offset) for r in api.revisions(answers(spark, page, "no json", {})).orderBy("rev_id").collect()] == [("A", 5, "x", "n"), ("A", 6, "y", "n")]
    assert [tuple(r) for r in api.category_members(answers(spark, {"query": {"categorymembers": [{"pageid": 1, "ns": 4, "title": "T"}]}})).collect()] == [(1, 4, "T", None)]
    usage = answers(spark, {"query": {"pages": [{"title": "F", "globalusage": [{"wiki": "en", "title": "A"}, {"wiki": "de", "title": "B"}]}, {"title": "G"}]}})
    assert [tuple(r) for r in api.file_usage(usage, "en").collect()] == [("F", "en", "A")] and api.files(usage).count() == 2
    spaces = {"query": {"namespaces": {"-1": {"id": -1, "name": "Special"}, "2": {"id": 2, "name": "Benutzer", "canonical": "User"}, "0": {"id": 0, "name": ""}}, "namespacealiases": [{"id": 4, "alias": "WP x"}]}}
    assert {tuple(r) for r in api.namespaces(answers(spark, spaces)).collect()} == {("benutzer", 2), ("user", 2), ("wp_x", 4)}
    item = {"entities": {"Q1": {"claims": {"P31": [{"mainsnak": {"datavalue": {"value": {"id": "Q5"}}}}]}, "sitelinks": {"enwiki": {"title": "T"}}}, "Q2": {}}}
    assert {r.qid: (r.classes, r.sitelinks) for r in api.entities(answers(spark, item)).collect()} == {"Q1": (["Q5"], {"enwiki": "T"}), "Q2": ([], None)}
    assert [tuple(r) for r in api.language_links(answers(spark, {"query": {"pages": [{"title": "A", "langlinks": [{"lang": "de", "title": "B"}]}]}})).collect()] == [("A", "de", "B")]
    found = {"results": [{"title": "T", "publication_year": 2020, "doi": "d", "authorships": [{"author": {"display_name": "N"}}], "abstract_inverted_index": {"hello": [0, 2], "world": [1]}}, {"title": "U"}], "meta": {"next_cursor": "c"}}
    assert {r.title: (r.year, r.authors, r.abstract) for r in api.search_results(answers(spark, found)).collect()} == {"T": (2020, ["N"], "hello world hello"), "U": (None, None, "")}
    work = {"message": {"DOI": "10.1/X", "title": ["T"], "author": [{"given": "A", "family": "B"}], "issued": {"date-parts": [[2020, 5]]}, "container-title": ["J"], "type": "journal-article"}}
    r = api.works(answers(spark, work)).first()
    assert (r.doi, r.title, r.year, r.journal, r.authors[0].family) == ("10.1/x", "T", 2020, "J", "B")
    b = api.blocks(answers(spark, {"query": {"blocks": [{"user": "10.0.0.0/24", "by": "x", "timestamp": "2020-01-01T00:00:00Z", "expiry": "infinity"}, {"user": "Name", "expiry": "2021-01-01T00:00:00Z"}]}})).orderBy("target").collect()
    assert [(x.n_addresses, x.until is None) for x in b] == [(256, True), (None, False)]


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, "x|y"), ("a", 1, None), ("b", 3, "z")], "g string, n int, t string")
    sinks.export_csv(df, str(tmp_path / "c"), ["n"], single=True)
    assert [r.n for r in spark.read.csv(str(tmp_path / "c"), header=True, schema="g string, n int, t string").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        sinks.expect_columns(df, ["g"])
    assert sinks.expect_columns(df, ["t", "g", "n"]).columns == ["t", "g", "n"]
    docs = lambda *x: spark.createDataFrame(x, "k string, v struct<a:int>")
    sinks.rewrite_documents(docs(("p", (1,)), ("q", (2,))), str(tmp_path / "d"), "k")
    sinks.rewrite_documents(docs(("q", (5,))), str(tmp_path / "d"), "k")
    assert {r.k: r.v.a for r in spark.read.json(str(tmp_path / "d")).collect()} == {"p": 1, "q": 5}
    for _ in range(2):
        sinks.append_log(df.limit(1), str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    lines = [r.line for r in sinks.report_lines(df, "g", ["n", "t"], ["n"]).orderBy("place").collect()]
    assert lines == ["## a\n\n| n | t |\n|---|---|", "| 1 |  |", "| 2 | x\\|y |", "## b\n\n| n | t |\n|---|---|", "| 3 | z |"]


def test_keyword_passages_against_brute_force(spark, tmp_path):
    body = ("filler words " * 60 + "Consensus and a vote. " + "more text " * 70) * 3
    spark.createDataFrame([(1, body), (2, "none"), (3, None), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hits = sorted(((-sum(w in body[i : i + 600].lower() for w in ("consensus", "vote", "archive", "older")), i) for i in range(0, len(body), 250)))
    want = []
    for n, i in hits:
        if n < 0 and len(want) < 5 and all(abs(i - j) >= 300 for _, j in want):
            want.append((-n, i))
    got = sorted((-r.score, r.start) for r in QUERIES["tx07_keyword_passages"](spark, str(tmp_path)).collect())
    assert got == sorted((-n, i) for n, i in want) and len(got) > 2


def test_priority_by_rounded_milliseconds(spark, tmp_path):
    """Half a millisecond goes away from 1970; events of one rounded millisecond do not follow each other."""
    rows = [(1, 7, "view", 500), (2, 7, "purchase", 1_499), (3, 7, "purchase", 1_500), (4, 8, "view", -1_501), (5, 8, "purchase", -1_500), (6, 8, "click", -500), (7, 8, "click", -499), (8, 9, "view", 0), (9, 9, "purchase", 499)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, u long").selectExpr("event_id", "user_id", "event_type", "cast(timestamp_micros(u) AS timestamp_ntz) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in QUERIES["j06_priority"](spark, str(tmp_path)).collect())
    assert got == [(1, 3, 2, "closed"), (4, 6, -1, "stale"), (8, None, None, "open")]


def test_small_operators(spark):
    left = spark.createDataFrame([(1, 7, 10), (2, 7, 50), (3, 8, 10), (4, None, 1)], "i long, p long, t long")
    human, stale = spark.createDataFrame([(100, 7, 40)], "r long, p long, rt long"), spark.createDataFrame([(200, 7, 12), (201, 7, 60), (202, 8, 10)], "r long, p long, rt long")
    out = history.first_outcome(left, human, stale, "p", "i", "t", "r", "rt")
    assert {r.i: (r.r, r.outcome) for r in out.collect()} == {1: (100, "closed"), 2: (201, "stale"), 3: (None, "open"), 4: (None, "open")}
    old = spark.createDataFrame([(None, "head", 0), ("b", "old b", 1), ("x", "old x", 2), ("a", "old a", 3)], "k string, t string, q int")
    new = spark.createDataFrame([("a", "new a"), ("y", "new y"), (None, "lost")], "k string, t string")
    assert [(r.k, r.t) for r in records.upsert_sections(old, new, "k", "t", "q", ["a", "b"]).orderBy("place").collect()] == [(None, "head"), ("a", "new a"), ("b", "old b"), ("x", "old x"), ("y", "new y")]
    calls = spark.createDataFrame([("{{Policy_page |x}} {{policy page}} {{ cite\n|a={{b}}}}",), (None,)], "t string")
    assert [sorted(r[0]) for r in calls.select(records.templates(F.col("t"))).collect()] == [["b", "cite", "policy page"], []]
    q = spark.createDataFrame([(i, f"g{i % 3}", i * 7919 % 500) for i in range(1000)], "i int, g string, v int")
    got = {r.i: r.quintile for r in history.quintile(q, ["g"], [F.col("v"), F.col("i")], 5).collect()}
    for g in range(3):
        rows = sorted((i * 7919 % 500, i) for i in range(1000) if i % 3 == g)
        assert all(got[i] == min(4, k * 5 // len(rows)) for k, (_, i) in enumerate(rows))
    assert history.quantile_sketch(q, ["g"], "v").count() == 3
    paced = spark.createDataFrame([(1, "h", 0), (2, "h", 1), (3, "h", 100), (4, "h", 100), (5, "k", 5)], "i int, h string, t int").withColumn("d", F.lit(10))
    assert {r.i: r.start for r in history.paced(paced, "h", "t", "d", "i").collect()} == {1: 0, 2: 10, 3: 100, 4: 110, 5: 5}


def test_as_of_against_brute_force(spark):
    import random

    rng = random.Random(13)
    facts = [(rng.randrange(3), rng.randrange(10_000), rng.choice([None, rng.randrange(100)])) for _ in range(200)] + [(None, 5, 1)]
    asked = [(i, rng.choice([0, 1, 2, 9, None]), rng.randrange(10_000)) for i in range(100)]
    left, right = spark.createDataFrame(asked, "i int, e int, at long"), spark.createDataFrame(facts, "e int, t long, v int")
    got = {r.i: r.as_of_value for r in history.as_of(left, right, "e", "at", "t", "v", 500).collect()}
    for i, e, at in asked:
        known = [(t, v) for x, t, v in facts if x == e and e is not None and v is not None and t <= at]
        assert got[i] == (max(known)[1] if known else None)


def test_portable_definitions(spark):
    ddl = "CREATE TABLE `t` (\n  `a` bigint(20) unsigned NOT NULL AUTO_INCREMENT,\n  `b` varchar(255) COLLATE utf8_bin DEFAULT NULL COMMENT 'it''s',\n  `c` longtext,\n  PRIMARY KEY (`a`),\n  KEY `k` (`b`),\n  UNIQUE KEY `u` (`c`(20))\n) ENGINE=InnoDB AUTO_INCREMENT=5 DEFAULT CHARSET=utf8;"
    assert one(spark, text.portable_ddl, (ddl,), (None,)) == ['CREATE TABLE "t" (\n  "a" BIGINT NOT NULL,\n  "b" VARCHAR DEFAULT NULL,\n  "c" VARCHAR,\n  PRIMARY KEY ("a")\n);', None]
