"""Extension points: provider normalisers, classifiers, weights, extraction."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_by_provider(rows: DataFrame, hooks: dict[str, Callable[[DataFrame], DataFrame]], default: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of each source through its own function, all others through the default.

    A hook's rows without a title or URL fall back to the default, so a broken hook loses nothing. rows: id, source,
    title, url and whatever hooks read; hooks and default return id, title, url.
    """
    parts = [default(rows.where(~F.coalesce(F.col("source").isin(*hooks), F.lit(False))))]
    for source, hook in hooks.items():
        own = rows.where(F.col("source") == source)
        made = hook(own).where("coalesce(title, '') <> '' and coalesce(url, '') <> ''")
        parts += [made, default(own.join(made.select("id"), "id", "left_anti"))]
    return reduce(lambda a, b: a.unionByName(b), parts)


def classified(rows: DataFrame, column: str, classify: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Rows with the class that a vectorised function of a column gives."""
    return rows.withColumn("class", F.pandas_udf(classify, "string")(F.col(column)))


def weighted(parts: dict[str, Column], weights: dict[str, float], overrides: dict[str, float]) -> Column:
    """Weighted sum of parts; overrides replace default weights, unknown names are an error."""
    unknown = set(overrides) - set(weights)
    if unknown:
        raise ValueError(f"no such weight: {sorted(unknown)}")
    both = weights | overrides
    return reduce(lambda a, b: a + b, (parts[k] * F.lit(float(both[k])) for k in weights))


def extracted(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Key, nth (0-based), value of each match of a pattern's first group in a text."""
    return rows.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias("nth", "value"))
