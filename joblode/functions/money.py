"""Money, rates, buckets and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(c: Column) -> Column:
    """A number with either separator convention: the last of two kinds is the decimal point; a lone one groups
    if exactly three digits follow."""
    comma, dot = F.instr(c, ",") > 0, F.instr(c, ".") > 0
    last_comma = F.length(c) - F.instr(F.reverse(c), ",") > F.length(c) - F.instr(F.reverse(c), ".")
    both = F.when(last_comma, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(c, F.lit(","), F.lit("")))
    one = F.replace(F.regexp_replace(c, r"[.,](\d{3})(?!\d)", "$1"), F.lit(","), F.lit("."))
    return F.when(comma & dot, both).otherwise(one).try_cast("double")


def amounts(raw: Column) -> tuple[Column, Column, Column]:
    """Low, high and middle of a pay text; k counts for both ends; null if it is no amount."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[€$£¥]", ""), r"\s*[A-Za-z]{3}\s*$", ""))
    pattern = r"^([\d.,]+)\s*([kK]?)\s*(?:[-–—]\s*([\d.,]+)\s*([kK]?))?$"
    a, ka, b, kb = (F.regexp_extract(s, pattern, i) for i in (1, 2, 3, 4))
    kilo = F.when((ka != "") | (kb != ""), 1000.0).otherwise(1.0)
    first = F.when(a != "", _number(a) * kilo)
    second = F.when(b != "", _number(b) * kilo).otherwise(first)
    low = F.when(first.isNotNull() & second.isNotNull(), F.least(first, second))
    high = F.when(first.isNotNull() & second.isNotNull(), F.greatest(first, second))
    return low, high, (low + high) / 2


def freshness(posted: Column, as_of: Column) -> Column:
    d = F.datediff(as_of, posted)
    return F.when(d.isNull() | (d > 14), "older/unknown").when(d <= 1, "<=24h").when(d <= 3, "<=3d").when(d <= 7, "<=7d").otherwise("<=14d")


def pay_band(pay: Column) -> Column:
    return F.when(pay.isNull(), "unknown").when(pay < 50000, "<50k").when(pay < 100000, "50-100k").when(pay < 150000, "100-150k").when(pay < 200000, "150-200k").otherwise("200k+")


def score_band(score: Column) -> Column:
    """Bands of a match score out of 100."""
    return F.when(score >= 95, "exceptional").when(score >= 85, "strong").when(score >= 75, "review").when(score >= 60, "weak").otherwise("reject")


def half_up(c: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(c + 0.5)


def one_decimal(c: Column) -> Column:
    return half_up(c * 10) / 10


def whole(c: Column) -> Column:
    return half_up(c).cast("int")


def upper_median(column: str, kind: str = "double") -> Column:
    """The element at floor(n / 2) of the sorted values of a column; tasks count equal values first."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)").cast(kind)


def token_cost(usage: DataFrame, rates: DataFrame, default: tuple[float, float], free: list[str]) -> DataFrame:
    """Usage with cost. rates: the first model name that the row's model holds; distinct models are compared once."""
    r = rates.withColumnRenamed("model", "rate_model")
    one = usage.select("model").distinct().join(r, F.contains(F.col("model"), F.col("rate_model")))
    one = one.groupBy("model").agg(F.min(F.struct((F.col("model") != F.col("rate_model")).alias("o"), F.length("rate_model").alias("n"), "rate_model", "input_rate", "output_rate")).alias("r"))
    joined = usage.join(one, "model", "left")
    i, o = F.coalesce("r.input_rate", F.lit(default[0])), F.coalesce("r.output_rate", F.lit(default[1]))
    cost = ((F.col("input") - F.col("cached")) * i + F.col("cached") * i * 0.1 + F.col("output") * o) / 1e6
    return joined.withColumn("cost", F.when(F.col("provider").isin(*free), 0.0).otherwise(cost)).drop("r")
