import datetime as dt

from tideloom.operators.references import _probe, orphan_counts, orphan_references
from tideloom.operators.snapshots import snapshot_changes

NODE = "wiki string, page_id bigint, year smallint, title string, namespace int, is_redirect boolean, wikidata_qid string, confidence string, admitted_via string, status_tier string, loaded_at timestamp_ntz, change string"
LINK = "wiki string, year smallint, from_page bigint, to_ns int, to_title string, to_page bigint, to_admitted boolean, loaded_at timestamp_ntz, key string"
T0 = dt.datetime(2020, 1, 1)


def node(wiki, page, year, title="A", tier="policy", qid=None, at=T0):
    return (wiki, page, year, title, 4, False, qid, "confirmed", "wikidata", tier, at, "clash")


def changes(spark, rows, **kw):
    return {tuple(r)[:4] for r in snapshot_changes(spark.createDataFrame(rows, NODE), **kw).collect()}


def test_snapshot_changes(spark):
    rows = [
        node("a", 1, 2015), node("a", 2, 2015, "Straße x"), node("a", 3, 2015), node("a", 9, 2015, qid=""),
        node("a", 1, 2017, tier=" POLICY "), node("a", 2, 2017, "Straße_x"), node("a", 4, 2017), node("a", 9, 2017, qid=None), node("a", 9, 2017, qid=None),
        node("a", 1, 2018, tier="essay", at=T0 + dt.timedelta(1)), node("a", 1, 2018, tier="policy"), node("a", 2, 2018, "Straße_x"), node("a", 4, 2018), node("a", 9, 2018, qid=" "),
        node("b", 1, 2016), node("b", 1, 2017), node(None, 1, 2017), node("b", None, 2017), node("b", 1, None),
    ]
    want = {("a", 3, 2017, "removed"), ("a", 4, 2017, "added"), ("a", 1, 2018, "changed")}
    assert changes(spark, rows) == want
    full = snapshot_changes(spark.createDataFrame(rows, NODE), with_values=True).where("change = 'changed'").collect()
    assert [(d.field, d.old, d.new) for r in full for d in r.diffs] == [("status_tier", "policy", "essay")]


def test_delivery_without_usable_keys_removes_all(spark):
    rows = [node("a", 1, 2015), node("a", None, 2016), node("a", 1, 2017)]
    assert changes(spark, rows) == {("a", 1, 2016, "removed"), ("a", 1, 2017, "added")}


def test_snapshot_changes_unicode_and_empty(spark):
    assert changes(spark, [node("a", 1, 2015, "é"), node("a", 1, 2016, "é")]) == set()
    assert changes(spark, []) == set()
    assert changes(spark, [node("a", 1, 2015, None), node("a", 1, 2016, "x" * 50_000)]) == {("a", 1, 2016, "changed")}


def test_orphans(spark):
    nodes = [node("a", 1, 2015, "Foo_bar"), node("a", 1, 2017, "Foo_bar"), node("a", 2, 2016, "Él"), node("b", 1, 2016, None)]
    link = lambda *x: (*x, T0, "clash")
    links = [
        link("a", 2015, 7, 4, "zz", 1, True), link("a", 2016, 7, 4, "zz", 1, True), link("a", 2018, 7, 4, "zz", 1, True), link("a", 2018, 7, 4, "zz", 1, True), link("a", 2016, 7, 4, "qq", 99, True),
        link("a", 2015, 8, 4, " :foo bar#x", None, True), link("a", 2016, 8, 4, "foo bar", None, True), link("a", 2016, 8, 0, "foo bar", None, True), link("a", 2016, 8, 4, "él", None, True),
        link("a", 2016, 9, 4, "nope", None, False), link("a", 2016, 9, 4, "nope", None, None), link("b", 2016, 9, 4, None, None, True), link("a", None, 9, 4, "n", 1, True),
    ]
    out = orphan_references(spark.createDataFrame(links, LINK), spark.createDataFrame(nodes, NODE))
    got = sorted((r.wiki, r.year or 0, r.from_page, r.to_ns, r.to_title or "", r.kind) for r in out.collect())
    assert got == sorted([
        ("a", 2016, 7, 4, "zz", "later"), ("a", 2018, 7, 4, "zz", "deleted"), ("a", 2016, 7, 4, "qq", "missing"), ("a", 2016, 8, 4, "foo bar", "later"), ("a", 2016, 8, 0, "foo bar", "missing"),
        ("b", 2016, 9, 4, "", "missing"), ("a", 0, 9, 4, "n", "missing"),
    ])
    assert {r.kind: r.n_orphans for r in orphan_counts(out).where("wiki = 'a' AND year = 2016").collect()} == {"later": 2, "missing": 2}
    assert orphan_references(spark.createDataFrame([], LINK), spark.createDataFrame(nodes, NODE)).count() == 0
    assert orphan_references(spark.createDataFrame(links, LINK), spark.createDataFrame([], NODE)).where("kind <> 'missing'").count() == 0


def test_orphans_hot_target(spark, monkeypatch):
    from tideloom.operators import references

    monkeypatch.setattr(references, "HEAVY", 50)
    monkeypatch.setattr(references, "HOT", 20)
    links = [("a", 2016, i, 4, "t", 1 if i % 3 else 2, True, T0, "k") for i in range(900)]
    out = orphan_references(spark.createDataFrame(links, LINK), spark.createDataFrame([node("a", 2, 2016), node("a", 1, 2017)], NODE))
    assert out.count() == 600 and {r.kind for r in out.select("kind").distinct().collect()} == {"later"}


def test_only_parents_of_hot_targets_are_repeated(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tideloom.operators import references

    monkeypatch.setattr(references, "HEAVY", 10)
    monkeypatch.setattr(references, "HOT", 25)
    # 1,000 ranges, each heavy by its many references; three targets are hot
    refs = spark.range(60_000).select((F.col("id") % 20_000).cast("string").alias("key"), F.col("id").alias("from_page"), F.lit(1).alias("year"), F.lit("t").alias("to_title"))
    hot = spark.range(3_000).select(F.concat(F.lit("hot"), (F.col("id") % 3).cast("string")).alias("key"), F.col("id").alias("from_page"), F.lit(1).alias("year"), F.lit("t").alias("to_title"))
    parents = refs.select("key").union(hot.select("key")).distinct()
    left, right = references.spread(refs.union(hot), parents, 1000)
    assert left.groupBy("rid").count().where("count > 10").count() > 990
    per = {r.key: r["count"] for r in right.groupBy("key").count().where("count > 1").collect()}
    assert per == {f"hot{i}": 40 for i in range(3)} and left.where("salt > 0").count() == 3000
    assert left.groupBy("rid", "salt").count().where("salt > 0 AND count > 100").count() == 0
    assert left.join(right, ["rid", "salt", "h", "key"]).count() == 63_000


def test_equal_hashes_of_different_keys():
    import pyarrow as pa

    refs = pa.table({"wiki": ["a"] * 3, "year": pa.array([1, 1, 1], pa.int16()), "from_page": [1, 2, 3], "to_ns": pa.array([0] * 3, pa.int32()), "to_title": ["x", "y", "z"], "h": [5, 5, 5], "key": ["k1", "k2", "k3"]})
    parents = pa.table({"h": [5, 5], "key": ["k2", "k1"], "years": pa.array([[1], [2]], pa.list_(pa.int16()))})
    assert [(r["from_page"], r["kind"]) for r in _probe(refs, parents).to_pylist()] == [(1, "later"), (3, "missing")]
