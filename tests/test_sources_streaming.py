import datetime as dt
import json
import mailbox
from email.message import EmailMessage

from pyspark.sql import functions as F

from tideloom.sources import readers, sinks
from tideloom.streaming import events as st


def test_text_formats(spark, tmp_path):
    (tmp_path / "c.dat").write_text("u1111 22344 22b7\n\nu5\nbroken line\n")
    assert sorted((r.ym, r.n) for r in readers.read_packed(spark, str(tmp_path / "c.dat")).collect()) == [("202203", 44), ("202211", 7)]
    (tmp_path / "s.txt").write_text("note\n---\ncitekey: a2020x\ntitle: T: one\nurl: http://x\n---\ntitle: no key\n")
    assert [r.fields for r in readers.read_blocks(spark, str(tmp_path / "s.txt")).collect()] == [{"citekey": "a2020x", "title": "T: one", "url": "http://x"}]
    (tmp_path / "b.bib").write_text('﻿@misc{k1,\n title = {A {B} c},\n year = 2020}\n@article{k2, doi = "10.1/x"}\n', encoding="utf-8")
    got = {r.citekey: (r.kind, r.fields) for r in readers.read_bibtex(spark, str(tmp_path / "b.bib")).collect()}
    assert got == {"k1": ("misc", {"title": "A {B} c", "year": "2020"}), "k2": ("article", {"doi": "10.1/x"})}
    (tmp_path / "d.sql").write_text("CREATE TABLE `t` (a int);\nINSERT INTO `t` VALUES (1,'it''s; a \\'q\\''),(2,NULL);\nINSERT INTO `u` VALUES (9,'x');\n")
    assert sorted(map(tuple, readers.read_sql_dump(spark, str(tmp_path / "d.sql"), "t", ["a", "b"]).collect())) == [("1", "it's; a 'q'"), ("2", None)]
    (tmp_path / "cdx.json").write_text(json.dumps([["timestamp", "statuscode"], ["2020", "200"], ["2021", "404"]]))
    assert [r.fields["statuscode"] for r in readers.read_header_rows(spark, str(tmp_path / "cdx.json")).collect()] == ["200", "404"]
    (tmp_path / "f.xml").write_text("<feed><entry><title>A</title><author><name>N</name></author><author><name>M</name></author></entry><entry><title>B</title></entry></feed>")
    assert {r.title: [a.name for a in r.author or []] for r in readers.read_feed(spark, str(tmp_path / "f.xml")).collect()} == {"A": ["N", "M"], "B": []}
    (tmp_path / "x.csv").write_text('a,b\n1,"q, ""z"""\nbad,y\n')
    assert [(r.a, r.b) for r in readers.read_csv(spark, str(tmp_path / "x.csv"), "a int, b string").collect()] == [(1, 'q, "z"'), (None, "y")]
    (tmp_path / "e.json").write_text(json.dumps({"edition": "E", "buckets": {"p": {"deadlines": [{"type": "t"}]}}}))
    assert readers.read_documents(spark, str(tmp_path / "e.json"), "edition string, buckets map<string, struct<deadlines: array<struct<type: string>>>>").select(F.explode("buckets")).first()["value"].deadlines[0].type == "t"


def test_mailbox(spark, tmp_path):
    box = mailbox.mbox(str(tmp_path / "m.mbox"))
    for i in range(3):
        m = EmailMessage()
        m["From"], m["Subject"], m["Date"] = "a@example.org", f"Grüße {i}", "Fri, 10 Feb 2017 09:16:28 +0530"
        m.set_content(f"text {i} ä")
        m.add_alternative("<p>html</p>", subtype="html")
        box.add(m)
    box.flush()
    got = readers.read_mailbox(spark, str(tmp_path / "m.mbox")).orderBy("no").collect()
    assert [(r.subject, r.body.strip()) for r in got] == [(f"Grüße {i}", f"text {i} ä") for i in range(3)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(x, "wiki string, year int, v int")
    sinks.replace_slices(rows(("a", 1, 1), ("b", 1, 2)), path, ["wiki", "year"])
    sinks.replace_slices(rows(("b", 1, 5)), path, ["wiki", "year"])
    assert sorted((r.wiki, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 5)]
    assert spark.read.parquet(sinks.archive(rows(("a", 1, 1)), str(tmp_path / "arc"), "v1")).count() == 1
    sinks.export_by_group(rows(("a", 1, 2), ("a", 1, 1)), str(tmp_path / "g"), "wiki", "v")
    lines = sinks.graphml_lines(spark.createDataFrame([("1", 'a<"b"')], "id string, label string"), spark.createDataFrame([("1", "2")], "source string, target string"))
    assert [r.line for r in lines.orderBy("part").collect()] == ['<node id="1"><data key="label">a&lt;&quot;b&quot;</data></node>', '<edge source="1" target="2"/>']


def test_streams(spark, tmp_path):
    src, t0 = str(tmp_path / "src"), dt.datetime(2024, 1, 1)
    schema = "page_id bigint, kind string, id bigint, t bigint, ts timestamp"
    row = lambda p, k, i, h: (p, k, i, int((t0 + dt.timedelta(hours=h)).replace(tzinfo=dt.timezone.utc).timestamp()), t0 + dt.timedelta(hours=h))
    put = lambda *x: spark.createDataFrame(x, schema).coalesce(1).write.mode("append").parquet(src)
    put(row(1, "open", 1, 0), row(1, "open", 2, 1), row(2, "open", 3, 0))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withWatermark("ts", "1 hour")
    run = lambda: st.match_opens(stream, 48 * 3600).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    run()
    put(row(1, "close", 9, 2))
    run()
    put(row(3, "open", 4, 200))
    run()
    put(row(3, "close", 10, 201))
    run()
    got = {(r.open_id, r.close_id, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(1, 9, "closed"), (2, 9, "closed"), (4, 10, "closed"), (3, None, "stale")} == got
    st.backfill(spark, src, schema, str(tmp_path / "bf"), str(tmp_path / "bfcp"))
    st.backfill(spark, src, schema, str(tmp_path / "bf"), str(tmp_path / "bfcp"))
    assert spark.read.parquet(str(tmp_path / "bf")).count() == 6
    counts = st.windowed_counts(spark.readStream.schema(schema).parquet(src), "ts", "kind")
    q = counts.writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM wc").first()[0] == 6


def test_awkward_sources(spark, tmp_path):
    import gzip

    (tmp_path / "s.txt").write_text("citekey: a\ntitle: Pros --- and cons\nurl: u\n---\ncitekey: b\ncitekey: c\n")
    assert [r.fields for r in readers.read_blocks(spark, str(tmp_path / "s.txt")).collect()] == [{"citekey": "a", "title": "Pros --- and cons", "url": "u"}, {"citekey": "c"}]
    (tmp_path / "b.bib").write_text("@misc{k, year = 2019, year = {2020}}\n")
    assert readers.read_bibtex(spark, str(tmp_path / "b.bib")).first().fields == {"year": "2020"}
    (tmp_path / "c.json").write_text(json.dumps([["a", "b"], ["1"], ["1", "2", "3"], []]))
    assert [r.fields for r in readers.read_header_rows(spark, str(tmp_path / "c.json")).collect()] == [{"a": "1"}, {"a": "1", "b": "2"}, {}]
    dump = "-- it's a dump\nINSERT INTO `t` VALUES (1,'one;\nstill one'),\n(2,'two','extra'),(3);\nINSERT INTO `t` (`b`, `a`) VALUES ('x', 4);\nINSERT INTO `tt` VALUES (9,'x');\n"
    for name, opened in (("d.sql", open), ("d.sql.gz", gzip.open)):
        with opened(tmp_path / name, "wt") as f:
            f.write(dump)
        got = sorted(map(tuple, readers.read_sql_dump(spark, str(tmp_path / name), "t", ["a", "b"]).collect()))
        assert got == [("1", "one;\nstill one"), ("2", "two"), ("3", None), ("4", "x")]
    with gzip.open(tmp_path / "m.mbox.gz", "wb") as f:
        f.write(b"From x Fri\nFrom: a@example.org\nSubject: one\n\ntext\n\nFrom y Sat\nSubject: two\n\nmore\n")
    assert [(r.no, r.subject, r.body.strip()) for r in readers.read_mailbox(spark, str(tmp_path / "m.mbox.gz")).orderBy("no").collect()] == [(1, "one", "text"), (2, "two", "more")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2, "b": 3}\n')
    assert [r.a for r in readers.read_json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()] == [1, None, 2]


def test_closes_that_arrive_before_their_open(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "page_id bigint, kind string, id bigint, t bigint"
    put = lambda *x: spark.createDataFrame(x, schema).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", "3000 seconds")
    run = lambda: st.match_opens(stream(), 9000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    put((1, "close", 9, 2000), (1, "close", 8, 2500))
    run()
    put((1, "open", 1, 1000), (1, "open", 2, 2200))
    run()
    put((2, "open", 3, 90_000))
    run()
    put((1, "open", 4, 100_000))
    run()
    got = {(r.open_id, r.close_id, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 9, "closed"), (2, 8, "closed")}


def test_many_files_with_their_names(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.csv").write_text("a,b\n" + (f"{i},x\n" if i else ""))
    rows = readers.read_csv(spark, str(tmp_path / "p*.csv"), "a int, b string", provenance=True).collect()
    assert sorted((r.a, r.source_file.rsplit("/", 1)[1]) for r in rows) == [(1, "p1.csv"), (2, "p2.csv")]
