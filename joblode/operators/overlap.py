"""The best partner by words in common, where some words stand nearly everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word in more sets of a group than this is frequent.
FREQUENT = 1000


def _split(sets: DataFrame, often: DataFrame) -> DataFrame:
    """sets (group, words) with rare and common: the words that are not, and are, frequent in their group."""
    mine = sets.select("group", "words", F.explode("words").alias("w")).join(often, ["group", "w"]).groupBy("group", "words").agg(F.array_sort(F.collect_list("w")).alias("common"))
    both = sets.join(mine, ["group", "words"], "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))
    return both.withColumn("rare", F.array_except("words", "common"))


def _top(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, score, item: the greatest score of each key, and of its items the least."""
    return rows.groupBy(*by, "score").agg(F.min("item").alias("item")).groupBy(*by).agg(F.max_by(F.struct("score", "item"), "score").alias("t")).select(*by, "t.score", "t.item")


def best_overlap(queries: DataFrame, items: DataFrame, jaccard: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """group, words, score, item: for each distinct word set of the queries the item of its group with the most words in
    common (``jaccard``: the greatest share of all words), ties by the least item; none without a word in common.

    queries: group, words (distinct); items: group, words (distinct), item (a struct that begins with its id). Equal sets are
    one. Sets meet by their rare words, of which each stands in ``frequent`` sets at most. What a set shares by
    frequent words alone depends on its frequent words only, so for these the distinct sets of frequent words meet, once each,
    and only for queries that a partner by rare words can't already be the best of; so hot words never multiply rows.
    """
    order = lambda df: df.withColumns({"group": F.coalesce(F.col("group").cast("string"), F.lit("")), "words": F.array_sort("words")}).where(F.size("words") > 0)
    q, i = order(queries).select("group", "words").distinct(), order(items).groupBy("group", "words").agg(F.min("item").alias("item"))
    often = i.select("group", F.explode("words").alias("w")).groupBy("group", "w").agg(F.count("*").alias("n")).where(F.col("n") > frequent).select("group", "w")
    q, i = _split(q, often), _split(i, often).withColumnsRenamed({"words": "have", "common": "have_common", "rare": "have_rare"})

    def scored(c, n, m):
        return (c / (n + m - c)).cast("double") if jaccard else c.cast("double")

    met = q.select("group", "words", F.explode("rare").alias("w")).join(i.select("group", "have", "item", F.explode("have_rare").alias("w")), ["group", "w"]).select("group", "words", "have", "item").distinct()
    near = met.withColumn("score", scored(F.size(F.array_intersect("words", "have")), F.size("words"), F.size("have"))).select("group", "words", "score", "item")

    first = _top(near, ["group", "words"])
    bound = F.size("common") / F.size("words") if jaccard else F.size("common")
    todo = q.where(F.size("common") > 0).join(first.select("group", "words", "score"), ["group", "words"], "left").where(F.col("score").isNull() | (F.col("score") <= bound)).select("group", "words", "common", F.size("words").alias("n"))
    classes = todo.select("group", "common", *(["n"] if jaccard else [])).distinct()
    have = i.where(F.size("have_common") > 0).select("group", "have_common", *([F.size("have").alias("m")] if jaccard else []), "item")
    have = have.groupBy("group", "have_common", *(["m"] if jaccard else [])).agg(F.min("item").alias("item"))
    keys, own = [c for c in classes.columns], [c for c in have.columns if c != "group"]
    met = classes.select(*keys, F.explode("common").alias("w")).join(have.select("group", *own, F.explode("have_common").alias("w")), ["group", "w"]).select(*keys, *own).distinct()
    by_class = _top(met.withColumn("score", scored(F.size(F.array_intersect("common", "have_common")), F.col("n") if jaccard else F.lit(0), F.col("m") if jaccard else F.lit(0))).select(*keys, "score", "item"), keys)
    second = todo.join(by_class, keys).select("group", "words", "score", "item")
    return _top(first.union(second), ["group", "words"])
