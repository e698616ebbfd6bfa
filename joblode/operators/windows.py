"""Ordered groups: clusters, folds, streaks, latest rows, merged spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def repost_clusters(rows: DataFrame, window: int = 90, least: int = 1) -> DataFrame:
    """G1: company_key, title_key, first_day, last_day, n_urls of re-posted openings.

    rows: company_key, title_key, url, day. Days sorted; a cluster runs to ``window`` days from its first row; on
    overflow it ends, and the next begins with its rows still within the window of the new row. Rows of a URL count
    once, from its earliest day. At least two URLs over ``least`` days. The distinct (day, url) pairs of a company and
    title stand in order in one task, which reads them as a stream and holds those of one window.
    """

    def clusters(batches):
        import datetime

        import pyarrow as pa

        epoch, key, now, out = datetime.date(1970, 1, 1), None, [], []

        def emit():
            first = {}
            for day, url in now:
                first.setdefault(url, day)
            days = first.values()
            if len(first) >= 2 and max(days) - min(days) >= least:
                out.append((*key, epoch + datetime.timedelta(min(days)), epoch + datetime.timedelta(max(days)), len(first)))

        def told():
            cols = zip(*out, strict=True) if out else ([],) * 5
            types = (pa.string(), pa.string(), pa.date32(), pa.date32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["company_key", "title_key", "first_day", "last_day", "n_urls"])

        for batch in batches:
            company, title, day, url = (batch.column(i).to_pylist() for i in range(4))
            for *own, d, u in zip(company, title, day, url, strict=True):
                if own != key:
                    emit()
                    key, now = own, []
                elif d - now[0][0] > window:
                    emit()
                    now = [x for x in now if d - x[0] <= window]
                now.append((d, u))
            if out:
                yield told()
                out.clear()
        emit()
        if out:
            yield told()

    real = rows.where("company_key <> '' and title_key <> '' and url <> '' and day is not null")
    real = real.select("company_key", "title_key", F.unix_date("day").alias("day"), "url").distinct()
    ordered = real.repartition("company_key", "title_key").sortWithinPartitions("company_key", "title_key", "day", "url")
    return ordered.mapInArrow(clusters, "company_key string, title_key string, first_day date, last_day date, n_urls long")


FOLD = "array<struct<state:string,day:date,counts:boolean>>"


def fold_ledger(rows: DataFrame) -> DataFrame:
    """Num, timeline (state, day, counts; by day, ties in entry order) of an append-only ledger.

    rows: seq, num, day, state, source. In entry order a ``-`` takes back the last entry, a correction replaces the
    last entry of its state (else it is added), anything else is added. Days of a known source count for time.
    """
    entry = F.struct("seq", "day", "state", "source")
    listed = rows.groupBy("num").agg(F.array_sort(F.collect_list(entry)).alias("log"))

    def step(acc, e):
        item = F.struct(e["state"].alias("state"), e["day"].alias("day"), e["source"].isin("manual", "agent", "correction").alias("counts"))
        back = F.array_position(F.reverse(F.transform(acc, lambda x: x["state"])), e["state"])
        at = F.when(back > 0, F.size(acc) - back + 1).otherwise(0)
        swapped = F.transform(acc, lambda x, i: F.when(i + 1 == at, item).otherwise(x))
        popped = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(e["state"] == "-", popped).when((e["source"] == "correction") & (at > 0), swapped).otherwise(F.concat(acc, F.array(item)))

    folded = listed.select("num", F.aggregate("log", F.array().cast(FOLD), step).alias("t"))
    numbered = F.transform("t", lambda x, i: F.struct(x["day"].alias("day"), i.alias("i"), x["state"].alias("state"), x["counts"].alias("counts")))
    return folded.select("num", F.transform(F.array_sort(numbered), lambda x: F.struct(x["state"].alias("state"), x["day"].alias("day"), x["counts"].alias("counts"))).alias("timeline"))


HOPS = (("Applied", "Responded"), ("Responded", "Interview"), ("Interview", "Offer"), ("Applied", "Rejected"))


def stage_velocity(timelines: DataFrame, least: int = 3) -> DataFrame:
    """Hop, n, median, p75, same_day, censored of each hop between states.

    The first counting entry of the one state, the first later counting entry of the other. Hops of no days are
    counted apart; a row whose last state is the first one is censored (not for rejections).
    """
    hops = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in HOPS])).alias("hop")
    t = timelines.select("num", "timeline", hops)
    at = F.array_min(F.filter(F.transform("timeline", lambda x, i: F.when((x["state"] == F.col("hop.a")) & x["counts"], i + 1)), lambda i: i.isNotNull()))
    t = t.withColumn("at", at).where("at is not null")
    nxt = F.filter(F.slice("timeline", F.col("at") + 1, F.size("timeline")), lambda x: (x["state"] == F.col("hop.b")) & x["counts"])
    t = t.withColumn("days", F.datediff(F.get(nxt, F.lit(0))["day"], F.element_at("timeline", F.col("at").cast("int"))["day"]))
    waits = F.col("days").isNull() & (F.col("at") == F.size("timeline")) & (F.col("hop.b") != "Rejected")
    real = F.when(F.col("days") > 0, F.col("days"))
    out = t.groupBy(F.concat_ws(">", "hop.a", "hop.b").alias("hop")).agg(F.count(real).alias("n"), F.median(real).alias("m"), F.percentile(real, F.lit(0.75)).alias("q"), F.count_if(F.col("days") == 0).alias("same_day"), F.count_if(waits).alias("censored"))
    return out.select("hop", "n", F.when(F.col("n") >= least, F.col("m")).alias("median"), F.when(F.col("n") >= least, F.col("q")).alias("p75"), "same_day", "censored")


def trailing_streak(rows: DataFrame, key: str, order: str, good: Column) -> DataFrame:
    """Key, streak: rows after the last good one. Counts beyond the greatest good order need no window."""
    last = rows.groupBy(key).agg(F.max(F.when(good, F.col(order))).alias("last"))
    after = rows.join(last, key).where(F.col("last").isNull() | (F.col(order) > F.col("last")))
    return last.select(key).join(after.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("streak"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(*order)).alias("r")).select(*key, "r.*")


def recent(rows: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """Key, values: the last n values of each key in order. Ranks cut each key before its rows are gathered."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    top = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def merged_years(spans: DataFrame, key: str) -> DataFrame:
    """Key, years: length of the union of [begin, end) spans (both whole years)."""
    w = W.partitionBy(key).orderBy("begin", "end").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max("end").over(w)
    own = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(reach, F.col("begin"))))
    return spans.where(F.col("end") > F.col("begin")).withColumn("own", own).groupBy(key).agg(F.sum("own").alias("years"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key and how many rows it replaces."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"), (F.count("*") - 1).alias("replaced")).select(key, "r.*", "replaced")


def status_changes(rows: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Rows whose state differs from the one before."""
    before = F.lag(state).over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(state)))


def upsert_history(history: DataFrame, now: DataFrame, day: Column) -> DataFrame:
    """Match history (profile_id, id, score, hash, first_seen) after new scores, with what changed."""
    n = now.select("profile_id", "id", F.col("score").alias("new_score"), F.col("hash").alias("new_hash"))
    j = history.join(n, ["profile_id", "id"], "full_outer")
    return j.select("profile_id", "id", F.coalesce("new_score", "score").alias("score"), F.coalesce("first_seen", day).alias("first_seen"), F.coalesce(F.col("hash") != F.col("new_hash"), F.lit(False)).alias("changed"), F.coalesce(F.col("new_score") > F.col("score"), F.lit(False)).alias("improved"))
