"""Streaming intake, life cycles, counts, alerts and folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from joblode.operators.windows import fold_ledger
from joblode.store import shared_dir


#: The state store that processors with typed state need.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, to Parquet under path, and read the result.

    Each batch has a folder of its own, so a batch that runs again replaces its rows; a source without rows gives an
    empty table. In update mode the result holds all changed rows of all batches. Run again with the same path, a stream goes on from its
    checkpoint with what is new.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/out/batch=-1")
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        _run(stream, path, mode)
    finally:
        spark.conf.set(ROCKS[0], before) if before else spark.conf.unset(ROCKS[0])
    return spark.read.schema(stream.schema).option("basePath", f"{path}/out").parquet(f"{path}/out").select(*stream.columns)


def _run(stream: DataFrame, path: str, mode: str) -> None:

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()


def fresh_dir(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/joblode-{name}-{uuid.uuid4().hex}"


def intake(postings: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """The keys of arriving postings, once each within the watermark."""
    return postings.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys).select(*keys)


class _Policy(StatefulProcessor):
    """Whether a key may come in: state until (milliseconds) or ever, cleared by a timer when the block is over."""

    def __init__(self, recheck: int):
        self.recheck = recheck

    def init(self, handle) -> None:
        self.handle, self.blocked = handle, handle.getValueState("blocked", "until long, ever boolean")

    def _block(self, until: int, ever: bool) -> None:
        self.blocked.update((until, ever))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if not ever:
            self.handle.registerTimer(until)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, ever = self.blocked.get() if self.blocked.exists() else (None, False)
        taken = []
        for ms in sorted(int(x) for b in rows for x in b["ms"]):
            if not ever and (until is None or ms >= until):
                taken.append(ms)
                until = ms + self.recheck
        if taken:
            self._block(until, False)
            yield pd.DataFrame({"key": pd.Series([key[0]] * len(taken), dtype=object), "ms": taken})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.blocked.clear()
        yield from ()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._block(int(initialState["until"].iloc[0]), bool(initialState["ever"].iloc[0]))

    def close(self) -> None:
        pass


def intake_with_history(postings: DataFrame, history: DataFrame, recheck: int = 30, delay: str = "1 day") -> DataFrame:
    """Key, ts of arriving postings (key string, ts) that neither the history nor this stream blocks.

    The history (key, status, day, until) of earlier runs is the initial state, under J1's policy: an added key is
    blocked for ``recheck`` days from its day, a cooldown until its day, any other status for ever. A posting that comes in
    blocks its key for ``recheck`` days. Blocks that the watermark has passed leave the state, so it holds live ones only.
    """
    day = 86_400_000
    start = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    until = F.when(F.col("status") == "added", start("day") + recheck * day).when(F.col("status") == "cooldown", start("until"))
    known = history.where("key is not null").select("key", until.alias("until")).groupBy("key").agg(F.coalesce(F.max("until"), F.lit(0)).alias("until"), F.max(F.col("until").isNull()).alias("ever"))
    rows = postings.where("key is not null and ts is not null").withWatermark("ts", delay).select("key", "ts", F.unix_millis("ts").alias("ms"))
    out = rows.groupBy("key").transformWithStateInPandas(_Policy(recheck * day), "key string, ms long", "append", "eventTime", initialState=known.groupBy("key"))
    return out.select("key", F.timestamp_millis("ms").alias("ts"))


#: The state of a key in a bucket of keys: its last sighting (microseconds) and how many of stale and closed are told.
_KEY = np.dtype([("key", "<i8"), ("last", "<i8"), ("told", "<i8")])
_STATES = np.array(["active", "stale", "closed"], dtype=object)


def _changes(now: np.ndarray, key: np.ndarray, us: np.ndarray, mark: int, after: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The state of a bucket (_KEY, sorted by key) after sightings and the watermark, and key, at, state of its changes."""
    seen = np.unique(np.rec.fromarrays([np.concatenate((now["key"], key)), np.concatenate((now["last"], us))], names="key,us"))
    # sightings behind the last one that the state holds change nothing
    at = np.searchsorted(now["key"], seen["key"])
    known = at < len(now)
    known[known] = now["key"][at[known]] == seen["key"][known]
    fresh = np.ones(len(seen), bool)
    fresh[known] = seen["us"][known] >= now["last"][at[known]]
    seen, at, known = seen[fresh], at[fresh], known[fresh]
    begins = np.ones(len(seen), bool)
    begins[1:] = seen["key"][1:] != seen["key"][:-1]
    ends = np.append(begins[1:], True)[: len(seen)]
    # what the state has told counts until the next sighting
    told = np.zeros(len(seen), np.int64)
    held = begins & known
    told[held] = now["told"][at[held]]
    until = np.where(ends, mark, np.append(seen["us"][1:], 0)[: len(seen)])
    out, last = [(seen["key"][begins & ~known], seen["us"][begins & ~known], 0)], told.copy()
    for i, wait in enumerate(after.tolist()):
        passed = (last == i) & (until > seen["us"] + wait)
        out.append((seen["key"][passed], seen["us"][passed] + wait, i + 1))
        last[passed] += 1
    again = np.flatnonzero(~ends & (last > 0)) + 1
    out.append((seen["key"][again], seen["us"][again], 0))
    state = np.zeros(int(ends.sum()), _KEY)
    state["key"], state["last"], state["told"] = seen["key"][ends], seen["us"][ends], last[ends]
    return state, [np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), np.concatenate([np.full(len(o[0]), o[2]) for o in out])]


def lifecycle(sightings: DataFrame, stale: float, closed: float, delay: str = "1 day", buckets: int = 1024) -> DataFrame:
    """Key, at, state: changes of state of each key (key, ts).

    Active when first seen; unseen for ``stale`` days stale, for ``closed`` days closed, each from the moment it
    holds; a sighting makes it active again. A key that stays away is told by the watermark (the latest sighting of
    all less ``delay``), without a sighting of its own. Sightings behind the key's last one change nothing, those
    behind the watermark and those without a time are dropped.

    Python works on ``buckets`` groups of keys, not on a group for each key: a bucket holds its keys' states and has one timer,
    that of the key that is due first. A stream goes on with the number of buckets it began with.
    """
    after = np.array([round(x * 86_400_000_000) for x in (stale, closed)], np.int64)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = np.frombuffer(bytes(state.get[0]), _KEY) if state.exists else np.zeros(0, _KEY)
        rows = [(b["key"].to_numpy(np.int64), b["us"].to_numpy(np.int64)) for b in batches if len(b)]
        new = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 2
        mark = state.getCurrentWatermarkMs()
        now, (keys, at, kind) = _changes(now, *new, mark * 1000, after)
        state.update((now.tobytes(),))
        due = now[now["told"] < 2]
        if len(due):
            # the timer goes off once the watermark is beyond it
            state.setTimeoutTimestamp(max(int((due["last"] + after[due["told"]]).min()) // 1000, mark + 1))
        # keys that are null have a bucket of their own
        names = pd.Series([None] * len(keys) if key[0] < 0 else keys, dtype="Int64")
        yield pd.DataFrame({"key": names, "at": at, "state": _STATES[kind]})

    rows = sightings.where("ts is not null").withWatermark("ts", delay)
    bucket = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets))).cast("long")
    rows = rows.select(bucket.alias("bucket"), F.coalesce(F.col("key").cast("long"), F.lit(0)).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts")
    out = rows.groupBy("bucket").applyInPandasWithState(step, "key long, at long, state string", "keys binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("key", F.timestamp_micros("at").alias("at"), "state")


def counts(rows: DataFrame, time: str, width: str, slide: str | None = None, by: tuple[str, ...] = (), delay: str = "1 day") -> DataFrame:
    """Begin, n of tumbling (or sliding) windows. In update mode a window leaves the state with the watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.withWatermark(time, delay).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), *by, "n")


def latest_counts(rows: DataFrame, path: str) -> DataFrame:
    """The windows of ``counts`` after all batches, open ones included, each with its last count.

    A batch writes the windows that it changed; counts only grow, so the last is the greatest.
    """
    changed = drained(rows, path, "update")
    return changed.groupBy(*[c for c in changed.columns if c != "n"]).agg(F.max("n").alias("n"))


class _Windows(StatefulProcessor):
    """The count of one window, told when the watermark passes its end; counts that come after that are told as late."""

    def __init__(self, by: list[str]):
        self.by = by

    def init(self, handle) -> None:
        self.handle, self.n = handle, handle.getValueState("n", "n long")

    def _row(self, key, n: int, late: bool) -> pd.DataFrame:
        values = {"begin": pd.Series([key[0]], dtype="int64"), **{c: pd.Series([v], dtype=object) for c, v in zip(self.by, key[2:], strict=True)}}
        return pd.DataFrame({**values, "n": [n], "late": [late]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        more = sum(int(b["n"].sum()) for b in rows)
        if key[1] <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, more, True)
            return
        if self.n.exists():
            more += self.n.get()[0]
        else:
            self.handle.registerTimer(int(key[1]))
        self.n.update((more,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.n.get()[0]
        self.n.clear()
        yield self._row(key, n, False)

    def close(self) -> None:
        pass


def closed_counts(rows: DataFrame, time: str, width: str, slide: str | None = None, by: tuple[str, ...] = (), delay: str = "1 day") -> DataFrame:
    """Begin, by (strings), n, late of windows, in append mode.

    A window is told once (late false), when the watermark (the latest time of earlier batches less ``delay``) reaches
    its end, and leaves the state then. Rows that come for a window behind the watermark aren't dropped: each batch
    tells their number (late true). So the sum of a window's rows is its count, late ones included; windows that are
    still open are not there yet. Tasks count their batches first, so a busy window ships a row a batch and task, not
    a row an event. Rows without a time have no window.
    """
    w = F.window(time, width, slide) if slide else F.window(time, width)
    ends = rows.where(F.col(time).isNotNull()).withWatermark(time, delay).select(w.alias("w"), *[F.col(c).cast("string").alias(c) for c in by])
    flat = ends.select(F.unix_millis("w.start").alias("begin"), F.unix_millis("w.end").alias("end"), *by)
    key = ["begin", "end", *by]

    def counted(batches: Iterator) -> Iterator:
        for b in batches:
            yield from pa.Table.from_batches([b]).group_by(key).aggregate([([], "count_all")]).rename_columns([*key, "n"]).to_batches()

    some = ", ".join(f"`{c}` string" for c in by)
    shape = "begin long, end long, " + (some + ", " if some else "")
    partial = flat.mapInArrow(counted, shape + "n long")
    out = partial.groupBy(*key).transformWithStateInPandas(_Windows(list(by)), shape.replace("end long, ", "") + "n long, late boolean", "append", "eventTime")
    return out.withColumn("begin", F.timestamp_millis("begin"))


def failure_alerts(rows: DataFrame, least: int = 3) -> DataFrame:
    """T4: portal, seq where a run of failures reaches ``least`` (rows: portal, seq, ok)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        out = []
        for seq, ok in sorted((s, o) for b in batches for s, o in zip(b["seq"], b["ok"], strict=True)):
            run = 0 if ok else run + 1
            if run == least:
                out.append((key[0], seq))
        state.update((run,))
        yield pd.DataFrame(out, columns=["portal", "seq"])

    return rows.groupBy("portal").applyInPandasWithState(step, "portal long, seq long", "run long", "append", GroupStateTimeout.NoTimeout)


#: Transitions that an application may make.
ALLOWED = {"": ("Applied",), "Applied": ("Responded", "Interview", "Rejected", "Offer"), "Responded": ("Interview", "Offer", "Rejected"), "Interview": ("Offer", "Rejected"), "Offer": (), "Rejected": ()}


class _Transitions(StatefulProcessor):
    """The state of an application (value) and the day on which it first came to each of its states (map)."""

    def __init__(self, allowed: dict[str, tuple[str, ...]]):
        self.allowed = allowed

    def init(self, handle) -> None:
        self.now, self.first = handle.getValueState("now", "state string"), handle.getMapState("first", "state string", "day string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # each call of a state is a message to the JVM, so both are read once a key and batch, not once an event
        held, days, out = self.now.get(), {k[0]: v[0] for k, v in self.first.iterator()}, []
        before = now = held[0] if held else ""
        for seq, new, day in sorted((s, t, d) for b in rows for s, t, d in zip(b["seq"], b["state"], b["day"], strict=True)):
            if new == now:
                verdict, reason = "repeated", f"already {now}"
            elif new in self.allowed.get(now, ()):
                verdict, reason, now = "accepted", "", new
                if new not in days:
                    days[new] = day
                    self.first.updateValue((new,), (day,))
            else:
                verdict, reason = "illegal", f"{now or 'nothing'} is not followed by {new}"
            out.append((key[0], seq, new, verdict, reason, days.get(new)))
        if now != before:
            self.now.update((now,))
        yield pd.DataFrame(out, columns=["num", "seq", "state", "verdict", "reason", "first_day"])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.now.update((initialState["state"].iloc[0],))
        self.first.updateValue((initialState["state"].iloc[0],), (initialState["day"].iloc[0],))

    def close(self) -> None:
        pass


def transitions(rows: DataFrame, allowed: dict[str, tuple[str, ...]] = ALLOWED, tracked: DataFrame | None = None) -> DataFrame:
    """T5: num, seq, state, verdict (accepted, repeated or illegal), reason and first_day of events in order.

    rows: num, seq, state, day. first_day is the day on which the application first came to the event's state, null if it
    never did. tracked: num, state, day of applications that stood in a state before the stream began (one row each).
    """
    shape = "num long, seq long, state string, verdict string, reason string, first_day string"
    text = F.date_format("day", "yyyy-MM-dd").alias("day")
    initial = None if tracked is None else tracked.select("num", "state", text).groupBy("num")
    out = rows.select("num", "seq", "state", text).groupBy("num").transformWithStateInPandas(_Transitions(allowed), shape, "append", "none", initialState=initial)
    return out.withColumn("first_day", F.to_date("first_day"))


def _with(schema: StructType, **more: str) -> str:
    """A schema with further columns."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"{n} {t}" for n, t in more.items()])


def corrected_ledger(stream: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Num, timeline after all batches of a ledger stream (seq, num, day, state, source).

    Each batch is kept and the keys that it touches are folded again over all their entries, late ones included. The
    log lies in buckets of keys; a batch reads those of its keys. Batches that run again replace what they wrote; a
    source without rows gives an empty table.
    """
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64("num"), F.lit(buckets)).cast("int").alias("bucket")
    shape = fold_ledger(spark.createDataFrame([], stream.schema)).schema
    spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{path}/folded/batch=-1")

    def put(df: DataFrame, batch: int) -> None:
        df.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/log/batch={batch}")
        mine = spark.read.schema(_with(df.schema, bucket="int")).option("basePath", f"{path}/log").parquet(f"{path}/log/batch={batch}")
        touched = [r.bucket for r in mine.select("bucket").distinct().collect()]
        # as many values as there are buckets, so the scan lists only their folders
        log = spark.read.schema(_with(df.schema, bucket="int", batch="bigint")).parquet(f"{path}/log").where(F.col("bucket").isin(touched))
        entries = log.join(mine.select("num").distinct(), "num", "left_semi").dropDuplicates(["seq"]).select(*df.columns)
        fold_ledger(entries).write.mode("overwrite").parquet(f"{path}/folded/batch={batch}")

    stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    folded = spark.read.schema(_with(shape, batch="bigint")).parquet(f"{path}/folded")
    return folded.groupBy("num").agg(F.max_by("timeline", "batch").alias("timeline"))
