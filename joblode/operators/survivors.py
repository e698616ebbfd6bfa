"""Who survives when rows are judged in order against those that survived before them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblode.operators.filters import cooldown, first_fail
from joblode.store import stored

KEYS = ("url_key", "role_key", "canonical_key")


def _earliest(key: str, among: Column, reach: int | None) -> Column:
    """The least id among the rows of a key (and no more than ``reach`` places away); rows without the key stand alone."""
    alone = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col("id").cast("string")))
    near = W.partitionBy(alone) if reach is None else W.partitionBy(alone).orderBy("place").rangeBetween(-reach, reach)
    return F.min(F.when(among, F.col("id"))).over(near)


def _firsts(rows: DataFrame, key: str, reach: int | None) -> DataFrame:
    by = [F.col(key).alias("k")] + ([] if reach is None else [F.col("place").alias("at")])
    return rows.where(F.col(key).isNotNull()).groupBy(*by).agg(F.min("id").alias("first"))


def _met(key: str, reach: int | None) -> Column:
    after = (F.col(key) == F.col("k")) & (F.col("id") > F.col("first"))
    return after if reach is None else after & (F.abs(F.col("place") - F.col("at")) <= reach)


def _matched(rows: DataFrame, reach: int | None = None) -> DataFrame:
    """rows with by_url_key, by_role_key, by_canonical_key: the first survivor before each row that it meets by the key.

    A round judges all rows that wait for no earlier one, so the number of rounds is that of the longest chain of rows that
    decide about each other, whatever the size of a group: all later rows of a key go with its first survivor.
    """
    todo = stored(rows.groupBy(*KEYS, "barred", "place").agg(F.min("id").alias("id")))
    judged = []
    while not todo.isEmpty():
        free = ~F.col("barred")
        marked = todo.withColumns({"u": _earliest("url_key", free, reach), "r": _earliest("role_key", free, reach), "c": _earliest("canonical_key", F.lit(True), reach)})
        waits = (F.col("u") < F.col("id")) | (F.col("r") < F.col("id"))
        now = ~F.coalesce(waits, F.lit(False)) & (F.col("barred") | (F.col("c") >= F.col("id")))
        marked = stored(marked.withColumn("now", now).drop("u", "r", "c"))
        new, todo = marked.where("now").drop("now"), marked.where("not now").drop("now")
        judged.append(new)
        for key, firsts in (("url_key", new.where(free)), ("role_key", new.where(free)), ("canonical_key", new)):
            todo = todo.join(_firsts(firsts, key, reach), _met(key, reach), "left_anti")
        todo = stored(todo)
    reached = reduce(DataFrame.union, judged) if judged else todo
    out = rows
    for key, firsts in zip(KEYS, (reached.where("not barred"), reached.where("not barred"), reached), strict=True):
        known = _firsts(firsts, key, reach)
        if reach is not None:  # a row may meet several
            known = rows.join(known, _met(key, reach)).groupBy(F.col("id").alias("k")).agg(F.min("first").alias("first"))
            out = out.join(known, F.col("id") == F.col("k"), "left")
        else:
            out = out.join(known, F.col(key) == F.col("k"), "left").withColumn("first", F.when(F.col("first") < F.col("id"), F.col("first")))
        out = out.withColumnRenamed("first", f"by_{key}").drop("k")
    return out


def survivors(rows: DataFrame) -> DataFrame:
    """id, duplicate ('url', 'role', 'canonical' or null), kept_id (the row that it repeats) of rows judged in id order.

    rows: id (distinct), url_key, role_key, canonical_key (null or empty: none), barred. A row is a duplicate by URL or role of
    an accepted row before it, or by canonical key of a row before it that is no duplicate by the other two; barred rows
    are never accepted. Rows with the same keys are judged as one.
    """
    rows = rows.select("id", *[F.nullif(k, F.lit("")).alias(k) for k in KEYS], F.coalesce("barred", F.lit(False)).alias("barred"), F.lit(0).alias("place"))
    by = [F.col(f"by_{k}") for k in KEYS]
    name = F.when(by[0].isNotNull(), "url").when(by[1].isNotNull(), "role").when(by[2].isNotNull(), "canonical")
    return _matched(rows).select("id", name.alias("duplicate"), F.coalesce(*by).alias("kept_id"))


#: Notes that say nothing.
EMPTY_NOTES = ("", "N/A", "❌", "pending", "-")


def dedup_applications(rows: DataFrame, days: int = 90) -> DataFrame:
    """Num, n (rows merged), score, status, notes, anchor of each cluster of tracker rows of one opening.

    rows: seq (order of the lines, distinct), num, company (text), company_key, via, role, report (number or null), score,
    status, stage (its rank), notes, day. In order, a row that no cluster takes is the anchor of a new one and takes the
    later rows of its employer that match it: those with its report number, those with its number and role, and those with
    its role where neither has been applied to (stage 3 or more), so nothing in flight is merged by name alone. Clusters
    aren't transitive; a row that several anchors match goes to the first. Rows of an unknown employer ("?") belong to their
    channel and match within ``days`` only, without a day never. The row with the best score (null: 0; ties: the first)
    stays; it takes the status of the furthest stage and the notes of the others that it does not hold yet, best first.
    """
    blind = F.trim(F.coalesce("company", F.lit(""))) == "?"
    via = F.lower(F.trim(F.coalesce("via", F.lit(""))))
    owner = F.when(blind, F.concat(F.lit("\0via:"), F.when(via == "—", "").otherwise(via))).otherwise(F.coalesce("company_key", F.lit("")))
    role = F.lower(F.trim(F.regexp_replace(F.coalesce("role", F.lit("")), r"\s+", " ")))
    rows = stored(rows.withColumns({"owner": owner, "line": role, "place": F.when(blind, F.unix_date("day")).otherwise(F.lit(0))}))
    key = lambda *parts: F.when(F.col("place").isNotNull(), F.concat_ws("\x1f", "owner", *parts))
    keyed = rows.select(
        F.col("seq").alias("id"), F.when(F.col("report").isNotNull(), key(F.col("report").cast("string"))).alias("url_key"), F.when(F.coalesce(F.col("stage") < 3, F.lit(True)), key(F.lit("role"), "line")).alias("role_key"),
        key(F.col("num").cast("string"), "line").alias("canonical_key"), F.lit(False).alias("barred"), F.coalesce("place", F.lit(0)).alias("place"),
    )
    anchor = _matched(keyed, days).select(F.col("id").alias("seq"), F.coalesce(F.least(*[f"by_{k}" for k in KEYS]), F.col("id")).alias("anchor"))
    points = F.coalesce("score", F.lit(0.0))
    rows = rows.join(anchor, "seq").withColumns({"at": F.struct((-points).alias("score"), F.col("seq").alias("seq")), "notes": F.trim(F.coalesce("notes", F.lit("")))})
    best = F.min_by(F.struct("num", "score", "notes"), "at")
    furthest = F.max_by("status", F.struct(F.col("stage").alias("stage"), points.alias("score"), (-F.col("seq")).alias("seq")))
    clusters = rows.groupBy("anchor").agg(best.alias("kept"), F.min("at").alias("first"), F.count("*").alias("n"), furthest.alias("status"))
    # equal notes are one before they meet
    said = rows.where(~F.col("notes").isin(*EMPTY_NOTES)).groupBy("anchor", "notes").agg(F.sort_array(F.collect_set("at"))[0].alias("at"))
    said = said.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "notes"))), lambda x: x["notes"]).alias("said"))
    merged = lambda acc, x: F.when(F.contains(acc, x), acc).when(acc.isin("", "N/A", "-"), x).otherwise(F.concat(acc, F.lit("; "), x))
    notes = F.aggregate(F.coalesce("said", F.array().cast("array<string>")), F.col("kept.notes"), merged)
    return clusters.join(said, "anchor", "left").select(F.col("kept.num").alias("num"), "n", F.col("kept.score").alias("score"), "status", notes.alias("notes"), "anchor")


def _tested(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """rows with stage: the first test that is not true, null if all are.

    Each test is a projection of its own over rows that have passed so far (it names stage twice, so Spark doesn't merge it
    with the one before): all in one are more code than the JVM compiles.
    """
    rows = rows.withColumn("stage", F.lit(None).cast("string"))
    for name, test in stages:
        rows = rows.withColumn("stage", F.when(F.col("stage").isNull(), first_fail([(name, test)])).otherwise(F.col("stage")))
    return rows


def staged_funnel(rows: DataFrame, stages: list[tuple[str, Column]], listed: DataFrame, seen: DataFrame, windows: DataFrame, as_of: Column, annotate: bool = False, keyed: Callable[[DataFrame], DataFrame] = lambda df: df, carried: Sequence[str] | None = None) -> DataFrame:
    """rows with stage (the first that they fail, else 'accepted'), note and kept_id, in the order of id.

    The stages are: blacklist, the given row tests, url_dup, role_dup, canonical_dup, cooldown. rows: id, company_key, title,
    url_key, role_key, canonical_key and what the tests read. listed: company_key, reason of employers to leave out; with
    ``annotate`` they pass and the note names the reason. seen: url_key, role_key of earlier runs. windows: rules of
    cooldown(). Duplicates count only against rows that got through the stages before; kept_id is the row that a
    duplicate repeats (null: one of an earlier run). Row tests are evaluated once; keyed stages see keys only. ``keyed``
    adds the three keys to rows that passed all row tests, where rows don't have them yet. Of the columns of rows,
    ``carried`` (None: all) are in the result.
    """
    reasons = listed.where("company_key <> ''").groupBy("company_key").agg(F.min(F.coalesce("reason", F.lit(""))).alias("reason"))
    rows = _tested(rows, stages).withColumnRenamed("stage", "failed")
    note = F.when(F.col("reason").isNotNull(), F.concat(F.lit("blacklisted"), F.when(F.col("reason") != "", F.concat(F.lit(": "), F.col("reason"))).otherwise("")))
    black = F.lit(False) if annotate else F.col("reason").isNotNull()
    told = [c for c in rows.columns if c != "failed"] if carried is None else ["id", *(c for c in carried if c != "id")]
    rest = [c for c in rows.columns if c not in (*told, "failed")]
    rows = rows.join(reasons, "company_key", "left").withColumns({"stage": F.when(black, "blacklist").otherwise(F.col("failed")), "note": note})
    # what is not carried is kept where the keys need it
    rows = stored(rows.select(*told, "stage", "note", F.when(F.col("stage").isNull(), F.struct(*rest) if rest else None).alias("own")))
    alive = keyed(rows.where("stage is null").select(*told, *[F.col(f"own.{c}") for c in rest])).select("id", "company_key", "title", *KEYS)
    cooled = cooldown(alive, windows, as_of).select("id", *KEYS, F.col("cooldown_until").isNotNull().alias("barred"))
    for key in KEYS[:2]:
        known = seen.where(F.col(key) != "").select(key).distinct().withColumn(f"old_{key}", F.lit(True))
        cooled = cooled.join(known, key, "left")
    keyed = stored(cooled)
    old_url, old_role = (F.coalesce(f"old_{k}", F.lit(False)) for k in KEYS[:2])
    fresh = survivors(keyed.where(~old_url & ~old_role))
    # rows of an earlier run's role may still repeat a URL of this run, which is asked first
    kept_urls = fresh.where("duplicate is null").join(keyed.where(~F.col("barred")).select("id", "url_key"), "id").where("url_key <> ''").groupBy("url_key").agg(F.min("id").alias("by_url"))
    old = keyed.where(old_url | old_role).join(kept_urls, "url_key", "left")
    own = (F.col("by_url") < F.col("id")) & ~old_url
    old = old.select("id", F.when(old_url | own, "url").otherwise("role").alias("duplicate"), F.when(own, F.col("by_url")).alias("kept_id"))
    verdict = fresh.union(old).join(keyed.select("id", "barred"), "id")
    late = F.when(F.col("duplicate").isNotNull(), F.concat("duplicate", F.lit("_dup"))).when(F.col("barred"), "cooldown")
    verdict = verdict.select("id", late.alias("late"), "kept_id")
    return rows.join(verdict, "id", "left").withColumn("stage", F.coalesce("stage", "late", F.lit("accepted"))).drop("late", "own")
