import base64
import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideloom.llm import languages, linkage, mail, mixing, packing, tokens
from tideloom.llm import nearest
from tideloom.llm.nearest import nearest_in_time


def brute_nearest(opens, closes, tol):
    out = {}
    for i, p, t in set(opens):
        if None in (i, p, t):
            continue
        near = [(abs(ct - t), ct, c) for c, cp, ct in closes if cp == p and ct is not None and c is not None and abs(ct - t) <= tol]
        if near:
            out[i] = min(near)[2]
    return out


@pytest.mark.parametrize("tol", [0, 1, 50, 5000])
def test_nearest_against_brute_force(spark, monkeypatch, tol):
    rng = random.Random(tol)
    opens = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([rng.randrange(20_000), None])) for i in range(400)] + [(None, 1, 5)]
    closes = [(9000 + i, rng.choice([1, 1, 1, 2, 4, None]), rng.choice([rng.randrange(20_000), None])) for i in range(300)]
    opens += opens[:20]
    lhs = spark.createDataFrame(opens, "oid long, p long, t long").withColumn("rid", F.lit("clash")).withColumn("e", F.lit(1))
    rhs = spark.createDataFrame(closes + closes[:9], "cid long, p long, t long").withColumn("lid", F.lit(2))
    want = brute_nearest(opens, closes, tol)
    for least in (100_000, 40, 3):
        monkeypatch.setattr(nearest, "HOT_LEAST", least)
        monkeypatch.setattr(nearest, "HOT_SHARE", 500 if least > 1000 else 1000)
        got = [(r.oid, r.cid) for r in nearest_in_time(lhs, rhs, "p", "oid", "t", "cid", "t", tol).collect()]
        assert len(got) == len(dict(got)) and dict(got) == want


def test_nearest_in_a_burst(spark, monkeypatch):
    rng = random.Random(9)
    opens = [(i, 1, 5_000_000 + rng.randrange(300)) for i in range(500)] + [(1000 + i, 1, rng.randrange(10_000_000)) for i in range(60)]
    closes = [(9000 + i, 1, 5_000_000 + rng.randrange(300)) for i in range(200)] + [(9500 + i, 1, rng.randrange(10_000_000)) for i in range(60)]
    monkeypatch.setattr(nearest, "HOT_LEAST", 50)
    lhs, rhs = spark.createDataFrame(opens, "oid long, p long, t long"), spark.createDataFrame(closes, "cid long, p long, t long")
    hot = nearest._hot(lhs.select(F.col("p").alias("e"), "t"), 100_000).collect()
    assert [(r.c, r.parts) for r in hot] == [(50, 16)]
    got = [(r.oid, r.cid) for r in nearest_in_time(lhs, rhs, "p", "oid", "t", "cid", "t", 50_000).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute_nearest(opens, closes, 50_000)


def test_nearest_ties_and_empty(spark):
    lhs = spark.createDataFrame([(1, 1, 10), (2, 1, 30)], "oid long, p long, t long")
    rhs = spark.createDataFrame([(7, 1, 5), (8, 1, 15), (6, 1, 30), (5, 1, 30)], "cid long, p long, t long")
    assert dict(map(tuple, nearest_in_time(lhs, rhs, "p", "oid", "t", "cid", "t", 100).collect())) == {1: 7, 2: 5}
    assert nearest_in_time(lhs, rhs.limit(0), "p", "oid", "t", "cid", "t", 100).count() == 0


CAND = "cand_id long, title string, year int, authors array<string>, doi string, lid string, weight int"
WORK = "work_id long, title string, year int, authors array<struct<given:string,family:string>>, doi string, rid string"


def test_linkage(spark):
    works = [
        (101, "Peer review under link structure: a survey", 2010, [("Anna B.", "Grødal"), ("Tim", "van Holt")], "10.1234/ab1"),
        (102, "Correction to: Peer review under link structure: a survey", 2011, [("Anna B.", "Grødal"), ("Tim", "van Holt")], "10.1234/ab2"),
        (103, "Peer review under link structure: a survey, Part 2", 2012, [("Anna B.", "Grødal"), ("Tim", "van Holt")], "10.1234/ab3"),
        (104, "Peer review under link structure: a survey", 2019, [("Olaf", "Pedersen")], "10.1234/ab4"), (105, None, None, None, None),
    ]
    cands = [
        (1, "PEER REVIEW UNDER LINK STRUCTURE - A SURVEY", 2010, ["A. B. Grodal", "T. van Holt"], None), (2, "Correction to: peer  review under link structure: a survey", None, ["Grodal AB", "van Holt T"], "doi:10.1234/AB2."),
        (3, "Peer review under link structure: a survey, part 2 *", 2012, ["GRODAL, A. B.; VAN HOLT, T."], None), (4, "Peer review under link strcuture: a survey", 2019, ["Olaf Pedersen"], "10.1234/ab1"),
        (5, "Peer review under link structure: a survey", 2010, ["Nobody, Known"], None), (6, None, None, None, None), (7, "", 2010, [], ""), (8, "x" * 40_000, 2010, ["A. B. Grodal"], None),
    ]
    c = spark.createDataFrame([(*x, "clash", 1) for x in cands + cands[:2]], CAND)
    w = spark.createDataFrame([(*x, "clash") for x in works + works[:1]], WORK)
    names = "transform(authors, a -> concat_ws(', ', a.family, a.given))"
    got = {r.cand_id: r.work_id for r in linkage.link_records(c, w, "cand_id", "work_id", "authors", names).collect()}
    assert got == {1: 101, 2: 102, 3: 103, 4: 104}
    assert linkage.link_records(c.limit(0), w, "cand_id", "work_id", "authors", names).count() == 0


def test_linkage_common_keys_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(linkage, "COMMON", 3)
    works = [(i, f"Bot governance in {'abcdefghij'[i % 10] * 6}{i}", 2000 + i % 3, [("Ann", "Miller"), ("Bo", f"Fam{'abcdefghijklmnopqrst'[i]}x")], None, "r") for i in range(20)]
    cands = [(100 + i, t, y, [f"Ann Miller", f"Bo {a[1][1]}"], None, "l", 1) for i, t, y, a, _, _ in works]
    names = "transform(authors, a -> concat_ws(', ', a.family, a.given))"
    got = {r.cand_id: r.work_id for r in linkage.link_records(spark.createDataFrame(cands, CAND), spark.createDataFrame(works, WORK), "cand_id", "work_id", "authors", names).collect()}
    assert got == {100 + i: i for i in range(20)}


def test_author_forms():
    for form in (["Grødal, Anna B."], ["A. B. Grødal"], ["Grødal AB"], ["Anna B. Grødal"], ["GRØDAL, A. B."], ["A. Grødal et al."]):
        assert linkage.families(form) == [("grodal", "a")], form
    assert linkage.families(["van Holt, T.; Grødal, A."]) == [("holt", "t"), ("grodal", "a")]
    assert linkage.clean_doi("DOI 10.1234 / x.1.") == "10.1234/x.1" and linkage.clean_doi("none") is None


MAIL = "msg_id long, subject string, msg_date string, sender string, body string, thread string, old string"


def test_mail_lines(spark):
    first = "Hi all,\n\nThe second option removed the template after a long debate and nobody at the noticeboard objected to it at all.\n\nBest,\nAnna\n\n-- \nAnna Berg\nTreasurer\n"
    quoted = "Dear Anna,\r\n\r\nI agree.\r\nSee below.\r\n\r\nOn Fri, 3 May 2013 10:00, Anna Berg wrote:\r\n> Hi all,\r\n>\r\n> The second option removed the template\r\n\r\nKind regards,\r\nBo Lind\r\n\r\nPS: one more point.\r\n"
    bare = "Thanks for this.\n\n-----Original Message-----\nFrom: Anna Berg <a@x.org>\nSubject: plan\n\n" + first + "\n_____\nx-l mailing list\nhttps://lists.x.org/x-l\n"
    coded = "Gr=C3=BC=C3=9Fe an alle, die diesen Text noch sehr =\nlange lesen.\n\nMfG\nBo\n"
    rows = [
        (1, "[x-l] plan", "Fri, 3 May 2013 10:00:00 +0000", "Anna Berg <a@x.org>", first), (2, "Re: [x-l] plan", "Fri, 3 May 2013 11:00:00 +0000", "Bo Lind <b@x.org>", quoted), (3, "AW: plan", "Fri, 3 May 2013 12:00:00 +0000", "Bo Lind <b@x.org>", bare),
        (4, None, None, None, coded), (5, "x", "y", "z", None), (6, "x", "y", "z", " \n "), (7, "", "bad", "", "word " * 30_000),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows + rows[:2]], MAIL)
    got = {}
    for r in mail.written_lines(df).collect():
        got.setdefault(r.msg_id, []).append(r.line_no)
    assert {k: sorted(v) for k, v in got.items()} == {1: [1, 3], 2: [1, 3, 4, 14], 3: [1], 4: [1, 2], 7: [1]}
    assert mail.written_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(10))
def test_mail_of_few_words(spark, n):
    body = " ".join("yes please see you there then at the old place".split()[:n])
    rows = [(i, "Re: plan", f"Fri, 3 May 2013 1{i}:00:00 +0000", "Bo <b@x.org>", b, None, None) for i, b in enumerate([body, body, "> " + body, body + "\n\n" + body])]
    got = {(r.msg_id, r.line_no) for r in mail.written_lines(spark.createDataFrame(rows, MAIL)).collect()}
    assert got == ({(0, 1), (1, 1), (3, 1), (3, 3)} if n else set())
    assert len(mail.rolling(mail.word_hashes(mail.words(body)))) == max(0, n - 7)


def test_rolling_hash_is_that_of_each_run():
    h = np.array([random.Random(i).getrandbits(32) for i in range(50)], np.uint64)
    every = mail.rolling(h, 8)
    assert len(every) == 43 and all(mail.rolling(h[i : i + 8], 8)[0] == every[i] for i in range(43))
    assert mail.thread_subject("Re[2]: [a-l] AW: =?utf-8?Q?caf=C3=A9?=") == "café"


def test_token_counts_are_exact():
    c = tokens.Counter()
    rng = random.Random(5)
    texts = ["", " ", "a", "  a", "a  b", "a \n b", "don't 12,5 %\n\nÜber  x", " lead", "trail ", "a\n\n b\t c", "".join(rng.choice("ab \n.,é'1") for _ in range(3000))]
    texts += ["".join(rng.choice(["word", " ", "\n", "1", "'s", "é", "—", "\t"]) for _ in range(60)) for _ in range(300)]
    assert [c.count(t) for t in texts] == [len(c.encoding.encode_ordinary(t)) for t in texts] and c.count(None) == 0


def test_plan_covers_and_never_overfills():
    rng = random.Random(9)
    for capacity in (1, 7, 64, 512):
        hist = Counter(rng.randrange(1, capacity + 1) for _ in range(2000))
        rows, used = packing.plan(dict(hist), capacity)
        load, seen = Counter(), Counter()
        for n, a, b, c in rows.tolist():
            seen[n] += b - a
            for k in range(b - a):
                load[c + k] += n
        assert seen == hist and max(load.values()) <= capacity and set(load) == set(range(used))
        assert used <= -(-sum(n * k for n, k in hist.items()) // capacity) * 1.05 + 1 or capacity < 64
    assert packing.plan({}, 5)[1] == 0


def test_pack(spark):
    sizes = [(i, n) for i, n in enumerate([5, 5, 5, 3, 2, 10, 23, 0, None, 20, 1])]
    specs = spark.createDataFrame([("s", 10), ("s", 10), ("t", 7), ("bad", 0), (None, 4)], "container_kind string, capacity_tokens int")
    out = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens long").withColumn("salt", F.lit(1)), specs).collect()
    for kind, cap in (("s", 10), ("t", 7)):
        rows = [r for r in out if r.container_kind == kind]
        load, per, parts = Counter(), Counter(), Counter()
        for r in rows:
            per[r.doc_id] += r.n_tokens
            parts[r.doc_id] += 1
            if r.container_id is not None:
                load[r.container_id] += r.n_tokens
        assert dict(per) == {i: n or 0 for i, n in sizes} and max(load.values()) <= cap
        assert all(parts[i] == 1 for i, n in sizes if (n or 0) <= cap)
    assert {r.container_kind for r in out} == {"s", "t"}
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), specs).count() == 0


def test_mix(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice("aab"), rng.randrange(50, 150), 40) for i in range(900)] + [(1000, None, 50, 9), (1001, "zz", 50, 9), (1002, "a", 0, 0)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, n_tokens long, n_words long").withColumn("range", F.lit(0)).withColumn("key", F.lit(0))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2), ("c", None, None)], "source string, target_share double, max_repeats int")
    plan = mixing.budgets(df, targets)
    rows = mixing.mix(df, plan)
    got = rows.collect()
    assert len({r.doc_id for r in got}) == len(got) and {r.source for r in got} == {"a", "b"}
    size = Counter()
    for _, s, n, _ in sizes:
        size[s] += n
    copies = {s: {r.copies for r in got if r.source == s} for s in "ab"}
    used = {s: sum(r.copies * r.n_tokens for r in got if r.source == s) for s in "ab"}
    assert max(copies["a"]) == 1 and max(copies["b"]) <= 3 and max(copies["b"]) - min(copies["b"]) <= 1
    assert used["a"] == size["a"] and abs(used["b"] / used["a"] - 0.8) < 0.01
    assert {r.source: r.actual_share for r in mixing.mix_report(rows, plan).collect()}["none"] == 0.0
    assert sorted(map(tuple, mixing.mix(df, plan).collect())) == sorted(map(tuple, got))
    assert mixing.mix(df.limit(0), mixing.budgets(df.limit(0), targets)).count() == 0


def test_joined_plan_gives_the_same_slots(spark, monkeypatch):
    rng = random.Random(12)
    sizes = spark.createDataFrame([(i, rng.choice([0, 5, 5, 5, 7, 30, 64, 65, 200, rng.randrange(1, 64)])) for i in range(900)], "doc_id long, n_tokens long")
    specs = spark.createDataFrame([("s", 64)], "container_kind string, capacity_tokens int")
    rows = lambda: sorted(map(str, packing.pack(sizes, specs).collect()))
    want = rows()
    monkeypatch.setattr(packing, "PLAN_ROWS", 0)
    monkeypatch.setattr(packing, "BLOCK", 7)
    assert rows() == want
    # plans stay below 8 rows a length however many documents there are
    for times in (1, 10, 1000):
        assert len(packing.plan({n: times * rng.randrange(1, 40) for n in range(1, 2049)}, 2048)[0]) < 8 * 2048


def test_no_range_of_keys_is_crowded(spark):
    """Whatever the weights: half of the documents a twentieth of the weight of the others."""
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).cast("long").alias("n_tokens"), F.lit(1).cast("long").alias("n_words"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.05).alias("w"))
    plan = mixing.budgets(df, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"), total=100_000)
    got = mixing.mix(df, plan, weight=F.col("w"))
    assert abs(got.count() - 10_000) <= 1 and got.where("doc_id % 2 = 1").count() < 1_000
    draw = np.random.default_rng(1).exponential(size=200_000) / np.where(np.arange(200_000) % 2, 1, 0.05)
    _, n = np.unique(np.floor(np.log(draw) * mixing.STEPS), return_counts=True)
    assert n.max() / 200_000 < 0.37 / mixing.STEPS * 1.2
    none = mixing.mix(df, plan, weight=F.lit(None).cast("double"))
    assert abs(none.count() - 10_000) <= 1


def test_sampling_follows_weights(spark):
    """Of documents of one length those with four times the weight are drawn far more often."""
    rows = [(i, "a", 100, 100 if i % 2 else 25) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, n_words long")
    plan = mixing.budgets(df, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"), total=40_000)
    got = [r.doc_id for r in mixing.mix(df, plan).collect()]
    assert abs(len(got) - 400) <= 1 and sum(i % 2 for i in got) / len(got) == pytest.approx(0.8, abs=0.06)


WORDS = {
    "en": "the committee found that this proposal was not ready and many readers asked for more time with their comments".split(),
    "de": "der ausschuss fand dass dieser vorschlag noch nicht fertig war und viele leser baten um mehr zeit mit ihren worten".split(),
    "fr": "le comité trouve que cette proposition est encore trop courte et beaucoup de lecteurs veulent plus de temps avec leurs mots".split(),
}


def _text(lang, rng, n=25):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)) + "."


def test_languages(spark):
    rng = random.Random(6)
    names = {"en": ["en", "English", "en_US", " EN "], "de": ["de", "ger", "Deutsch"], "fr": ["fr", "fr-CA", "français"]}
    rows = [(i, _text(c, rng), rng.choice(names[c])) for i, c in enumerate(rng.choice(list(WORDS)) for _ in range(240))]
    truth = {}
    odd = [("en", "de"), ("de", None), ("fr", "xx"), ("fr", "")]
    for k, (c, label) in enumerate(odd):
        rows.append((1000 + k, _text(c, rng), label))
        truth[(1000 + k, 0)] = c
    rows.append((2000, _text("en", rng) + "\n\n" + _text("de", rng) + "\n\n\n\n" + _text("fr", rng), "en"))
    truth |= {(2000, 1): "en", (2000, 2): "de", (2000, 4): "fr"}
    rows += [(3000, "", "en"), (3001, None, "en"), (3002, "12 34 \n\n --", None), (None, "x", "en"), (3003, _text("en", rng, 20_000), "en")]
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:3]], "doc_id long, text string, lang string, label string").repartition(3)
    got = languages.wrong_labels(languages.language_segments(df))
    assert {(r.doc_id, r.seg_no): r.lang for r in got.collect()} == truth
    assert languages.language_segments(df.limit(0)).count() == 0


def test_paragraphs_are_those_of_split():
    rng = random.Random(8)
    texts = ["".join(rng.choice("a\n") for _ in range(rng.randrange(0, 30))) for _ in range(500)]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    b = np.frombuffer(b"".join(raw), np.uint8)
    starts, owner = languages.paragraph_bounds(b, off)
    ends = np.r_[starts[1:], len(b)]
    for i, t in enumerate(texts):
        mine = [bytes(b[s:e]).decode() for s, e, o in zip(starts, ends, owner) if o == i]
        want = t.split("\n\n")
        # cuts are at the same places; only empty paragraphs at the end of a text have no bytes of their own
        assert [m.removesuffix("\n\n") if k + 1 < len(mine) else m for k, m in enumerate(mine)] == want[: len(mine)] or "".join(want[len(mine) :]) == ""


def test_presence_is_a_set():
    b = np.frombuffer(b"abcabcabc xyz", np.uint8)
    ids, first = languages.presence(b, np.array([0, 9]))
    assert len(set(ids[: first[1]])) == first[1] and first[-1] == len(ids)
    again, f2 = languages.presence(np.frombuffer(b"abcabc xyz", np.uint8), np.array([0, 6]))
    assert set(ids[: first[1]]) == set(again[: f2[1]])


def test_long_even_mails_take_time_in_proportion():
    import time

    body = "on and " * 100_000
    grams = mail.thread_grams(mail.words(body), "t")
    h, place = np.unique(grams, return_index=True)
    start = time.time()
    assert mail.new_lines(body, "Bo", "t", (h, np.full(len(h), 7), place)) == [1]
    again = "The second option removed the template after a long debate and nobody objected to it.\n\n" * 20_000
    h, place = np.unique(mail.thread_grams(mail.words(again), "t"), return_index=True)
    assert mail.new_lines(again + "New.", "Bo", "t", (h, np.full(len(h), 7), place)) == [40_001]
    lines = "yes\n\n" * 40_000 + "-- \nBo\n"
    assert len(mail.new_lines(lines, "Bo")) == 40_000
    footers = "x mailing list\n\nshort text here\n\n" * 10_000
    mail.new_lines(footers, "Bo")
    assert time.time() - start < 20


def test_chains_follow_one_diagonal():
    ws = [f"w{i}" for i in range(60)]
    mine = ws[5:25] + ["other"] * 3 + ws[40:46]
    theirs = mail.thread_grams(ws, "t")
    hit = mail.inherited(len(mine), mail.thread_grams(mine, "t"), theirs, np.ones(len(theirs), np.int64), np.arange(len(theirs)))
    assert hit.tolist() == [20] * 20 + [0] * 9
    edited = ws[:20] + ["new"] + ws[21:50]  # an edited word is bridged, a removed one starts another chain
    hit = mail.inherited(50, mail.thread_grams(edited, "t"), theirs, np.ones(len(theirs), np.int64), np.arange(len(theirs)))
    assert hit.tolist() == [20] * 20 + [0] + [29] * 29 or hit.tolist() == [50] * 50


def test_hot_threads_give_the_same_lines(spark, monkeypatch):
    text = "The second option removed the template after a long debate and nobody at the noticeboard objected to it at all number {}."
    rows = [(i, "Re: plan", f"Fri, {3 + i % 9} May 2013 10:00:{i % 60:02d} +0000", "Bo <b@x.org>", (text.format(i % 4) + "\n\n") * 2 + f"Word {i} is new.", None, None) for i in range(60)]
    df = spark.createDataFrame(rows, MAIL)
    cold = sorted(map(tuple, mail.written_lines(df).collect()))
    monkeypatch.setattr(mail, "HOT_LEAST", 1)
    assert sorted(map(tuple, mail.written_lines(df).collect())) == cold and len(cold) < 80


def test_standing_matter_is_learned_from_repetition(spark):
    """Closings, device notes and notices in forms no list has; sentences that many have, but not at the end, stay new."""
    rng = random.Random(14)
    words = "kala vene talo metsä järvi kivi puu tie silta kylä ranta saari".split()
    say = lambda: " ".join(rng.choice(words) for _ in range(12)) + "."
    rows, want = [], set()
    for i in range(60):
        name = rng.choice(["Aino Virta", "Eero Salo", "Liisa Niemi", "Matti Koski"])
        body = ["Hei kaikki,", "", say(), "", "Asia on vielä auki.", "", say(), "", say(), "", say(), "", "Ystävällisin terveisin,", name, "", "Lähetetty taskustani", "", "Tämä viesti kuuluu vain sen saajalle eikä", "sitä saa jakaa muille."]
        want |= {(i, k) for k in (1, 3, 5, 7, 9, 11)}
        rows.append((i, f"asia {i}", f"Fri, 3 May 2013 10:00:{i:02d} +0000", f"{name} <x{i % 4}@x.org>", "\n".join(body), None, None))
    df = spark.createDataFrame(rows, MAIL)
    for lists in (True, False):
        assert {(r.msg_id, r.line_no) for r in mail.written_lines(df, lists=lists).collect()} == want
