import datetime as dt
import random
from collections import Counter

from tideloom.plans import more, streams


def test_windows_to_the_end_of_the_input(spark, tmp_path):
    rows = [(i, "ab"[i % 2], dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i)) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.day, r.event_type): r.n for r in streams.QUERIES["sw01_windowed_counts"](spark, str(tmp_path)).collect()}
    assert got == Counter((str(t.date()), k) for _, k, t in rows)


def test_batches_over_whole_lists(spark, tmp_path):
    rng = random.Random(3)
    rows = [("xy"[i % 2], i, "m" * rng.randrange(100, 4000)) for i in range(150, 650, 3)] + [("x", 153, "m" * 5), ("y", 9, None)]
    spark.createDataFrame(rows, "list_name string, msg_id long, body string").write.parquet(f"{tmp_path}/parse_messages.parquet")
    sizes, want = {}, {}
    for g, i, b in rows:
        if b is not None:
            sizes[g, i] = max(sizes.get((g, i), 0), len(b))
    for g in "xy":
        no, load = 1, 0
        for k in sorted(k for k in sizes if k[0] == g):
            if load and load + sizes[k] > 18_000:
                no, load = no + 1, 0
            load += sizes[k]
            want[k] = no
    # Arrow batches far smaller than a list: the open batch is carried over
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {(r.list_name, r.msg_id): r.batch_no for r in more.QUERIES["w11_greedy_batches"](spark, str(tmp_path)).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
