"""Text queries on scripts, templates and rows that their SQL can't follow, against brute force."""

import datetime as dt
import re
from collections import Counter

from tideloom.plans import more, texts


def test_whole_texts(spark, tmp_path):
    base, day = str(tmp_path), lambda y: dt.datetime(y, 5, 1)
    old, new = "Café über Straße статья статья", "Café статья naïve {{cite|x}} <ref>note</ref> vote 中文"
    docs = [(1, "w", "p", day(2019), old), (2, "w", "p", day(2020), new), (3, "w", "q", day(2020), None)]
    spark.createDataFrame(docs, "doc_id long, wiki string, page_title string, rev_ts timestamp_ntz, text string").write.parquet(f"{base}/documents.parquet")
    links = [("w", 2020, 1, 4, "A_b"), ("w", 2013, 1, 0, "Straße"), ("w", 2020, 1, 0, "A-1"), ("w", 2020, None, 0, "Z"), ("v", 2021, 2, 4, "статья")]
    spark.createDataFrame(links, "wiki string, year int, from_page long, to_ns int, to_title string").write.parquet(f"{base}/link.parquet")
    spark.createDataFrame([(1, "Re: [wiki] Über  uns"), (2, "AW: plain"), (3, None)], "msg_id long, subject string").write.parquet(f"{base}/parse_messages.parquet")
    a, b = Counter(re.findall(r"\w+", new.lower())), Counter(re.findall(r"\w+", old.lower()))
    got = {r.doc_id: r for r in texts.QUERIES["tx01_word_changes"](spark, base).collect()}
    assert (got[2].n_words, got[2].words_added, got[2].words_removed) == (a.total(), (a - b).total(), (b - a).total())
    assert got[2].cosine == round(sum(a[w] * b[w] for w in a) / (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5, 4)
    assert got[1].n_words == 5 and got[3].n_words == 0
    got = {r.doc_id: r.n for r in texts.QUERIES["f16_plain_wikitext"](spark, base).collect()}
    letters = lambda t: len(re.sub("[^A-Za-z]", "", t))
    assert got == {1: letters(old), 2: letters("Café статья naïve vote"), 3: 0}
    assert {r.page: r["items"] for r in texts.QUERIES["ag18_inverted"](spark, base).collect()} == {"w:1": "A-1 | A_b | Straße", "v:2": "статья"}
    assert {r.msg_id: r.norm for r in more.QUERIES["f26_subjects"](spark, base).collect()} == {1: "über uns", 2: "plain"}
    assert [tuple(r) for r in more.QUERIES["w14_apart"](spark, base).collect()] == [(2, 1, 0)]
