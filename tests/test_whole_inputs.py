"""Queries on small tables whose rows a narrower query would leave out, against brute force."""

import datetime as dt
import math
import random
import re
from zoneinfo import ZoneInfo

from tideloom.operators import drift, records
from tideloom.plans import history, streams
from tideloom.plans import records as record_plans
from tideloom.plans import texts


def _save(spark, base, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{base}/{name}.parquet")


def _opens(spark, base):
    """Opens of three feeds on a page each hour, one undated, one delivered twice; closes on two pages. Returns {open: (page, second)} and the closes."""
    at = lambda h: dt.datetime(2018, 5, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=h)
    form = {"botlog": ("UTC", "%Y%m%d%H%M%S"), "mirror_eu": ("Europe/Berlin", "%d.%m.%Y %H:%M:%S"), "mirror_us": ("America/New_York", "%m/%d/%Y %H:%M:%S")}
    rows, want = [], {}
    for i in range(30):
        feed = list(form)[i % 3]
        zone, f = form[feed]
        rows.append((i, i % 4, at(37 * i).astimezone(ZoneInfo(zone)).strftime(f), feed))
        want[i] = (i % 4, int(at(37 * i).timestamp()))
    rows += [(99, 1, None, "mirror_eu"), rows[1]]
    closes = [(500 + i, i % 3, at(37 * i + 20).strftime("%Y%m%d%H%M%S"), f"u{i % 5}") for i in range(0, 30, 2)]
    _save(spark, base, "rfc_opens", rows, "open_rev_id long, page_id long, open_ts string, feed string")
    _save(spark, base, "rfc_human_closes", closes, "close_rev_id long, page_id long, close_ts string, closer string")
    _save(spark, base, "ts_feeds", [(k, v[0], "MDY" if k == "mirror_us" else "DMY") for k, v in form.items()], "feed string, tz_name string, date_order string")
    return want, [(c, p, int(dt.datetime.strptime(t, "%Y%m%d%H%M%S").replace(tzinfo=dt.timezone.utc).timestamp()), u) for c, p, t, u in closes]


def test_opens_of_all_feeds(spark, tmp_path):
    base = str(tmp_path)
    opens, closes = _opens(spark, base)
    first = {i: min(((t, c) for c, q, t, _ in closes if q == p and t > s), default=None) for i, (p, s) in opens.items()}
    got = {r.open_rev_id: (r.open_s, r.close_rev_id, r.close_s) for r in history.QUERIES["j06_next_close"](spark, base).collect()}
    assert got == {i: (s, *(first[i][::-1] if first[i] else (None, None))) for i, (p, s) in opens.items()}
    outcomes = {r.outcome: r.n for r in history.QUERIES["j06_outcomes"](spark, base).collect()}
    assert outcomes == {"closed": sum(x is not None for x in first.values()), "open": sum(x is None for x in first.values())}
    inside = {i: sorted((t, c, u) for c, q, t, u in closes if q == p and s <= t <= (first[i][0] if first[i] else t)) for i, (p, s) in opens.items()}
    got = {r.open_rev_id: (r.n_edits, r.n_participants, r.initiator) for r in history.QUERIES["j07_participation"](spark, base).collect()}
    assert got == {i: (len(x), len({u for *_, u in x}), x[0][2] if x else None) for i, x in inside.items()}
    assert history.QUERIES["x06_comment_timing"](spark, base).first().n == sum(len(x) for i, x in inside.items() if first[i])
    matched = {r.open_id: (r.open_s, r.close_id) for r in streams.QUERIES["in05_stream_match"](spark, base).where("outcome = 'closed'").collect()}
    assert matched == {i: (s, first[i][1]) for i, (p, s) in opens.items() if first[i]}


def test_nearest_vectors_of_any_label(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], i % 10 if i % 7 else None) for i in range(350)]
    rows += [(701, [0.0, 0.0, 0.0], 1), (702, None, 1), (703, [1.0, 2.0], 1), (704, rows[200][1], 5), (705, rows[200][1], 6)]
    _save(spark, str(tmp_path), "embeddings", rows, "vec_id long, embedding array<float>, label int")
    f4 = {r.vec_id: r.embedding for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect() if r.embedding and len(r.embedding) == 3 and any(r.embedding)}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {q: min((-round(cos(f4[q], v), 5), i) for i, v in f4.items() if i != q) for q in f4 if q % 100 == 0}
    got = {r.q: (-r.cosine, r.vec_id) for r in record_plans.QUERIES["x04_vector_pairs"](spark, str(tmp_path)).collect()}
    assert got == want and got[200][1] == 704
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.q: (-r.cosine, r.vec_id) for r in records.nearest_vectors(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 1, 20).collect()}
    assert got == want


def test_best_overlap_over_all_years(spark, tmp_path):
    rng = random.Random(6)
    words = "wiki open the quality edits of editors survey trust model growth bots study".split()
    title = lambda: " ".join(rng.sample(words, rng.randrange(1, 5)))
    year = lambda: rng.choice([None, 1999, 2011, 2020, 2021])
    cands = [(i, year(), title()) for i in range(60)] + [(90, 2021, "Zebra crossings"), (91, 2020, None), (92, None, "<i>Wiki</i> growth model")]
    works = [(700 + i, year(), title()) for i in range(80)] + [(990, None, None)]
    _save(spark, str(tmp_path), "candidate", cands, "cand_id long, year int, title string")
    _save(spark, str(tmp_path), "crossref_work", works, "work_id long, year int, title string")
    bag = lambda t: {w for w in re.findall("[a-z]+", (t or "").lower()) if len(w) > 1 and w not in texts._STOP}
    want = {}
    for i, _, t in cands:
        c = bag(t)
        scores = [(-round(len(c & bag(u)) / min(len(c), len(bag(u))), 4), k) for k, _, u in works if c & bag(u)]
        if scores:
            want[i] = min(scores)
    got = {r.cand_id: (-r.overlap, r.work_id) for r in texts.QUERIES["tx04_best_overlap"](spark, str(tmp_path)).collect()}
    assert got == want and 92 in got and 90 not in got
    sets = lambda rows: spark.createDataFrame([(i, sorted(bag(t))) for i, _, t in rows], "i long, w array<string>")
    got = {r.s: (-r.overlap, r.u) for r in drift.best_overlap_of_all(sets(cands).withColumnRenamed("i", "s"), sets(works).withColumnRenamed("i", "u"), "s", "u", "w", 7, 9).collect()}
    assert got == want
