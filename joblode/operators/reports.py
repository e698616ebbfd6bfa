"""Further tables of the reports: totals, run averages, signals, gates and wrong matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblode.functions.money import half_up, one_decimal

C = F.col

#: Outcomes of a match, in the order of the funnel; "rejected" ends it.
OUTCOMES = ("surfaced", "viewed", "saved", "applied", "interview", "offer", "hired", "rejected")


def scan_totals(rows: DataFrame) -> DataFrame:
    """Kind, value, n, companies, first_day, last_day: of all rows, of each portal and of each status, in one pass.

    rows: portal, status (missing: added), company, day. Companies count without case.
    """
    parts = [("all", F.lit("")), ("portal", F.coalesce("portal", F.lit(""))), ("status", F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("added")))]
    each = rows.select("day", F.lower("company").alias("company"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in parts])).alias("d")).where("d.kind <> 'portal' or d.value <> ''")
    return each.groupBy("d.kind", "d.value").agg(F.count("*").alias("n"), F.count_distinct(F.nullif("company", F.lit(""))).alias("companies"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def run_averages(runs: DataFrame) -> DataFrame:
    """Runs, failed, last_day, found, added (averages of completed runs), removed_pct (filtered of found).

    runs: day, status, found, filtered, added. Only completed runs count in averages.
    """
    done = C("status") == "completed"
    over = lambda c: F.sum(F.when(done, C(c)))
    n = F.count_if(done)
    return runs.agg(
        F.count("*").alias("runs"), (F.count("*") - n).alias("failed"), F.max("day").alias("last_day"), F.coalesce(one_decimal(over("found") / F.nullif(n, F.lit(0))), F.lit(0.0)).alias("found"),
        F.coalesce(one_decimal(over("added") / F.nullif(n, F.lit(0))), F.lit(0.0)).alias("added"), one_decimal(100.0 * over("filtered") / F.nullif(over("found"), F.lit(0))).alias("removed_pct"),
    )


def query_stats(trace: DataFrame, stages: list[str]) -> DataFrame:
    """Query, keys, and how many of its keys reached each stage. trace: query, key, stage (0-based)."""
    furthest = trace.groupBy("query", "key").agg(F.max("stage").alias("stage"))
    return furthest.groupBy("query").agg(F.count("*").alias("keys"), *[F.count_if(C("stage") >= i).alias(s) for i, s in enumerate(stages)])


def _by_signal(entries: DataFrame, most: int) -> DataFrame:
    return entries.select("outcome", F.explode(F.slice("signals", 1, most)).alias("signal")).withColumn("signal", F.lower("signal"))


def outcome_signals(entries: DataFrame, most: int = 10, top: int = 25, least: int = 30) -> DataFrame:
    """Signal, samples, one count for each outcome, enough: the signals with the most samples.

    entries: outcome, signals (array; the first ``most`` count). An unknown outcome counts as a sample alone.
    """
    n = _by_signal(entries, most).groupBy("signal").agg(F.count("*").alias("samples"), *[F.count_if(C("outcome") == o).alias(o) for o in OUTCOMES])
    return n.withColumn("enough", C("samples") >= least).orderBy(F.desc("samples"), "signal").limit(top)


def profiles_per_job(entries: DataFrame) -> DataFrame:
    """Profiles, jobs: how many jobs were matched by so many profiles. entries: job_id, profile_id."""
    return entries.where("job_id is not null").groupBy("job_id").agg(F.count_distinct("profile_id").alias("profiles")).groupBy("profiles").agg(F.count("*").alias("jobs"))


def high_score_rejections(entries: DataFrame, least: int = 75) -> DataFrame:
    """job_id, profile_id, score of rejected matches that scored well."""
    return entries.where((C("score") >= least) & (C("outcome") == "rejected")).select("job_id", "profile_id", "score")


def cold_start(entries: DataFrame) -> DataFrame:
    """profile_id, outcomes, stage of each profile by how many outcomes beyond surfacing it has."""
    n = entries.groupBy("profile_id").agg(F.count_if(C("outcome") != "surfaced").alias("outcomes"))
    stage = F.when(C("outcomes") == 0, "zero").when(C("outcomes") == 1, "one").when(C("outcomes") < 10, "few").when(C("outcomes") < 30, "growing").otherwise("established")
    return n.withColumn("stage", stage)


def rounds(sessions: DataFrame, begin: Column, end: Column) -> DataFrame:
    """Company, role, rounds (in order of day, then name), days between the first and the last, gap (the longest wait).

    sessions: company, role, round, day.
    """
    mine = sessions.where(C("day").between(begin, end))
    wait = F.datediff("day", F.lag("day").over(W.partitionBy("company", "role").orderBy("day", "round")))
    out = mine.withColumn("wait", wait).groupBy("company", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "round"))), lambda x: x["round"]).alias("rounds"), F.datediff(F.max("day"), F.min("day")).alias("days"), F.coalesce(F.max("wait"), F.lit(0)).alias("gap"))
    return out


def wrong_matches(rows: DataFrame, strong: int = 75) -> DataFrame:
    """Kind, n, mean: clear matches below a strong score (missed) and clear mismatches at it or above (false)."""
    kind = F.when((C("label") == "CLEAR_MATCH") & (C("score") < strong), "missed").when((C("label") == "CLEAR_MISMATCH") & (C("score") >= strong), "false")
    return rows.select(kind.alias("kind"), "score").where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"), (half_up(F.avg("score") * 1000) / 1000).alias("mean"))


def shared_plans(queries: DataFrame) -> DataFrame:
    """Profiles, queries, sources: how many search queries are shared by so many profiles, and in how many sources.

    queries: profile_id, query, source.
    """
    one = queries.select("profile_id", F.lower(F.trim("query")).alias("query"), "source").groupBy("query").agg(F.count_distinct("profile_id").alias("profiles"), F.count_distinct("source").alias("s"))
    return one.groupBy("profiles").agg(F.count("*").alias("queries"), F.max("s").alias("sources"))
