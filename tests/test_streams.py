"""Streams with typed state: initial state, restarts, blocks that end."""

import datetime as dt

import pandas as pd

from joblode.streaming import jobs

START = dt.datetime(2024, 1, 1)


def at(days):
    return START + dt.timedelta(days=days)


def test_intake_policy_over_restarts(spark, tmp_path):
    history = [("added", "added", at(-5).date(), None), ("old", "added", at(-40).date(), None), ("cool", "cooldown", None, at(3).date()), ("gone", "expired", at(-900).date(), None), ("two", "added", at(-29).date(), None), ("two", "cooldown", None, at(20).date()), (None, "added", at(0).date(), None)]
    known = spark.createDataFrame(history, "key string, status string, day date, until date")
    batches = [
        [("added", at(0)), ("old", at(0)), ("cool", at(1)), ("cool", at(4)), ("gone", at(0)), ("two", at(2)), ("new", at(0)), ("new", at(1)), (None, at(0)), ("null", None)],
        [("old", at(10)), ("new", at(29)), ("new", at(31)), ("added", at(24)), ("added", at(26)), ("two", at(21)), ("gone", at(33))],
        [("cool", at(33)), ("cool", at(35)), ("late", at(40)), ("gone", at(100)), ("new", at(90))],
    ]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    blocked = {"added": 25, "cool": 3, "gone": None, "two": 20}
    want = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = jobs.drained(jobs.intake_with_history(stream, known, 30, "200 days"), str(tmp_path / "out")).collect()
        for key, ts in sorted((r for r in rows if None not in r), key=lambda r: r[1]):
            day = (ts - START).days
            if key not in blocked or (blocked[key] is not None and day >= blocked[key]):
                want.append((key, ts))
                blocked[key] = day + 30
        assert sorted((r.key, r.ts) for r in got) == sorted(want), n


def test_blocks_end_with_the_watermark(spark, tmp_path):
    """The timer clears a block that the watermark has passed, and the key comes in again."""
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    none = spark.createDataFrame([], "key string, status string, day date, until date")
    for rows in ([("a", at(0)), ("b", at(0))], [("c", at(60))], [("a", at(61)), ("a", at(62))]):
        spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = jobs.drained(jobs.intake_with_history(stream, none), str(tmp_path / "out")).collect()
    assert sorted((r.key, (r.ts - START).days) for r in got) == [("a", 0), ("a", 61), ("b", 0), ("c", 60)]


def test_transitions_keep_state_over_restarts(spark, tmp_path):
    schema = "num long, seq long, state string, day date"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    tracked = spark.createDataFrame([(2, "Interview", at(-3).date())], "num long, state string, day date")
    for rows in ([(1, 1, "Applied", at(0).date()), (1, 2, "Offer", at(5).date()), (2, 3, "Applied", at(1).date())], [(1, 4, "Applied", at(6).date()), (1, 5, "Offer", at(7).date()), (2, 6, "Offer", at(2).date()), (3, 7, "Rejected", at(0).date())]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = jobs.drained(jobs.transitions(stream, tracked=tracked), str(tmp_path / "out")).collect()
    assert sorted((r.num, r.seq, r.verdict, r.reason, r.first_day and (r.first_day - START.date()).days) for r in got) == [
        (1, 1, "accepted", "", 0), (1, 2, "accepted", "", 5), (1, 4, "illegal", "Offer is not followed by Applied", 0), (1, 5, "repeated", "already Offer", 5),
        (2, 3, "illegal", "Interview is not followed by Applied", None), (2, 6, "accepted", "", 2), (3, 7, "illegal", "nothing is not followed by Rejected", None),
    ]
    assert spark.conf.get(jobs.ROCKS[0], None) != jobs.ROCKS[1]


def test_windows_close_and_late_rows_are_told(spark, tmp_path):
    """Batches of which one comes late: closed, late and open counts make up the batch twin; closed windows leave the state."""
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))
    rows = [[(at(d + h / 24), k) for d in days for h in range(0, 24, 5) for k in ("a", "a", None)] for days in ((0, 1), range(2, 8))]
    rows.append([(at(0.5), "a"), (at(1), "b"), (at(7.5), "a"), (None, "a")])
    rows.append([(at(9.5), "a")])
    told = []
    for batch in rows:
        spark.createDataFrame(batch, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = jobs.drained(jobs.closed_counts(stream, "ts", "1 day", by=("kind",)), str(tmp_path / "closed")).collect()
        latest = jobs.latest_counts(jobs.counts(stream, "ts", "1 day", by=("kind",)), str(tmp_path / "latest")).collect()
        told.append({(r.begin, r.kind, r.late): r.n for r in got})
        assert all(told[-1].get(k) == n for k, n in (told[-2] if len(told) > 1 else {}).items() if not k[2]), "told once"
    want = {}
    for ts, kind in (r for b in rows for r in b):
        if ts is not None:
            k = (at((ts - START).days), kind)
            want[k] = want.get(k, 0) + 1
    sums = {}
    for (begin, kind, _), n in told[-1].items():
        sums[begin, kind] = sums.get((begin, kind), 0) + n
    # the watermark stands at 8.5 days, so the windows of days 0 to 7 are told
    assert sums == {k: n for k, n in want.items() if k[0] <= at(7)}
    assert {k[:2]: n for k, n in told[-1].items() if k[2]} == {(at(0), "a"): 1, (at(1), "b"): 1}
    # natively, late rows go and open windows are there
    assert {(r.begin, r.kind): r.n for r in latest} == {k: n - (1 if k == (at(0), "a") else 0) for k, n in want.items() if k != (at(1), "b")}


def test_state_of_windows_stays_bounded(spark, tmp_path):
    """Ten days in batches of one: the state never holds more than the open windows."""
    (tmp_path / "in").mkdir()
    for d in range(10):
        spark.createDataFrame([(at(d + 0.1),), (at(d + 0.9),)], "ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get(jobs.ROCKS[0], None)
    spark.conf.set(*jobs.ROCKS)
    try:
        q = jobs.closed_counts(stream, "ts", "1 day").writeStream.format("memory").queryName("bounded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(jobs.ROCKS[0], before) if before else spark.conf.unset(jobs.ROCKS[0])
    assert len(q.recentProgress) > 10
    got = spark.table("bounded").collect()
    assert all(r.n == 2 for r in got) and len(got) == 8
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 8


def test_a_key_reads_its_state_once_a_batch():
    """Each call of a typed state is a message to the JVM; many events of a key make no more of them."""
    calls = []

    class Value:
        def __init__(self):
            self.row = None

        def get(self):
            calls.append("get")
            return self.row

        def exists(self):
            calls.append("exists")
            return self.row is not None

        def update(self, row):
            calls.append("update")
            self.row = row

    class Map(dict):
        def iterator(self):
            calls.append("iterator")
            return iter(list(self.items()))

        def containsKey(self, k):
            calls.append("containsKey")
            return k in self

        def getValue(self, k):
            calls.append("getValue")
            return self[k]

        def updateValue(self, k, v):
            calls.append("updateValue")
            self[k] = v

    job = jobs._Transitions(jobs.ALLOWED)
    job.now, job.first = Value(), Map()
    run = lambda seqs, states: next(job.handleInputRows((7,), iter([pd.DataFrame({"seq": seqs, "state": states, "day": [f"2024-01-{s:02d}" for s in seqs]})]), None))
    out = run([2, 1, 3], ["Applied", "Offer", "Responded"])
    assert out["verdict"].tolist() == ["illegal", "accepted", "accepted"] and out["first_day"].tolist() == [None, "2024-01-02", "2024-01-03"]
    assert (job.now.row, dict(job.first)) == (("Responded",), {("Applied",): ("2024-01-02",), ("Responded",): ("2024-01-03",)})
    calls.clear()
    out = run(list(range(4, 24)), ["Responded", "Applied"] * 10)
    assert out["verdict"].tolist() == ["repeated", "illegal"] * 10 and out["first_day"].tolist() == ["2024-01-03", "2024-01-02"] * 10
    assert sorted(calls) == ["get", "iterator"]
