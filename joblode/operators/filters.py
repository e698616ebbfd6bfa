"""Filters of postings and applications, and their funnel counts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblode.functions import place, title as titles
from joblode.functions.text import anchored, any_anchored, any_of, once


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def keyword(c: Column, word: str) -> Column:
    """One title keyword on lower-cased text: ``word:`` anchored, ``stem:`` anchored at its start, two or three
    letters anchored, ``a + b`` all of them, anything else a substring."""
    word = word.strip().lower()
    if " + " in word:
        return reduce(lambda a, b: a & b, [keyword(c, w) for w in word.split(" + ") if w.strip()])
    if word.startswith("word:"):
        bare = word[5:].strip()
        return c.rlike(anchored(bare)) if bare else F.lit(False)
    if word.startswith("stem:"):
        bare = word[5:].strip()
        return c.rlike(anchored(bare).removesuffix("([^a-z0-9]|$)")) if bare else F.lit(False)
    if len(word) in (2, 3) and word.isascii() and word.isalpha():
        return c.rlike(anchored(word))
    return F.contains(c, F.lit(word))


def title_filter(title: Column, positive: list[str], negative: list[str]) -> Column:
    """no positives or one of them, and no negative."""
    t = F.lower(F.coalesce(title, F.lit("")))
    good = _any([keyword(t, k) for k in positive]) if positive else F.lit(True)
    return good & ~_any([keyword(t, k) for k in negative])


def matched_keywords(title: Column, positive: list[str]) -> Column:
    """the positives that hit."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.array_compact(F.array(*[F.when(keyword(t, k), k) for k in positive]))


def location_filter(location: Column, url: Column, title: Column, allow=(), block=(), always=(), hard=()) -> Column:
    """hard blocks, then what is always allowed, then blocks, then allowed; a remote title passes."""
    # a line end stands between the two as the ends of a text do
    both = F.concat(F.lower(F.trim(F.coalesce(location, F.lit("")))), F.lit("\n"), place.location_hint(url))

    def passes(places: Column) -> Column:
        hit = lambda words: any_anchored(places, words)
        rest = hit(allow) | F.lower(F.coalesce(title, F.lit(""))).rlike(r"\bremote\b") if allow else F.lit(True)
        return F.when(places == "\n", True).when(hit(hard), False).when(hit(always), True).when(hit(block), False).otherwise(rest)

    return once(both, passes)


def domestic_only(location: Column, url: Column) -> Column:
    """no foreign marker, and a country or state named."""
    both = F.concat_ws(" | ", F.lower(F.coalesce(location, F.lit(""))), place.location_hint(url))
    return (F.regexp_extract(both, place.FOREIGN_RE, 2) == "") & (both.rlike(place.US_RE) | both.rlike(place.STATE_RE) | both.rlike(place.CODE_RE))


def date_window(day: Column, after: Column | None = None, before: Column | None = None) -> Column:
    """an unknown day passes; both ends are inclusive."""
    tests = [x for x in (None if after is None else day >= after, None if before is None else day <= before) if x is not None]
    return day.isNull() | reduce(lambda a, b: a & b, tests, F.lit(True))


def content_filter(text: Column, matched: Column, positive=(), negative=(), overrides: dict[str, tuple[list, list]] | None = None) -> Column:
    """an override of a matched title keyword decides (any may pass), else negatives, then positives.

    A missing text passes.
    """
    rule = lambda pos, neg: ~any_of(text, neg) & (any_of(text, pos) if pos else F.lit(True))
    overrides = overrides or {}
    chosen = [(F.array_contains(matched, k), rule(*r)) for k, r in overrides.items()]
    governed, passed = _any([a for a, _ in chosen]), _any([a & b for a, b in chosen])
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", True).when(governed, passed).otherwise(rule(list(positive), list(negative)))


def country_eligible(text: Column, country: str, exclusive: list[str], inclusive: list[str]) -> Column:
    """an exclusive phrase fails unless an inclusive one or the candidate's country stands there too."""
    if country.lower() == "united states":
        return F.lit(True)
    saved = any_of(text, [*inclusive, country])
    return (F.trim(F.coalesce(text, F.lit(""))) == "") | ~any_of(text, exclusive) | saved


#: Phrases about sponsorship.
SPONSORS = ("visa sponsorship", "sponsor a visa", "sponsor visas", "will sponsor", "sponsorship available", "sponsorship is available", "eligible for sponsorship", "provide sponsorship", "offer sponsorship", "immigration support", "h-1b", "h1b", "o-1 visa")
SPONSORS_NOT = ("no visa sponsorship", "no sponsorship", "without sponsorship", "unable to sponsor", "not able to sponsor", "cannot sponsor", "do not sponsor", "does not sponsor", "not offer sponsorship", "not provide sponsorship", "sponsorship is not available", "sponsorship not available", "not offer visa sponsorship")


def sponsorship(text: Column, require: bool) -> Column:
    """F8: a refusal fails; if a mention is required, one must stand there."""
    empty = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.when(empty, not require).when(any_of(text, SPONSORS_NOT), False).otherwise(any_of(text, SPONSORS) if require else F.lit(True))


def salary_filter(low: Column, high: Column, currency: Column, least: float, most: float, wanted: str) -> Column:
    """ranges overlap; one end stands for both; another currency fails; unknown pay passes."""
    a, b = F.coalesce(low, high), F.coalesce(high, low)
    cur = F.upper(F.trim(F.coalesce(currency, F.lit(""))))
    foreign = (cur != "") & (cur != wanted.upper()) if wanted else F.lit(False)
    return F.when(b.isNull(), True).otherwise(~foreign & ~((b < least) if least > 0 else F.lit(False)) & ~((a > most) if most > 0 else F.lit(False)))


def without_listed(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """rows whose key is not on a list (key); the list's size decides how Spark joins."""
    return rows.join(listed.select(key).distinct(), key, "left_anti")


def cooldown(rows: DataFrame, windows: DataFrame, as_of) -> DataFrame:
    """rows with the end of the cooldown that applies, null if none.

    rows: id, company_key, title; windows: rule, company (a key), until, title_word. A rule applies while it lasts, if
    the words of one company name stand in a row within the other's (a name of less than four letters only as a whole),
    and its title word (or none) is in the title. Names meet by the first word of the shorter.
    """
    words = lambda c: F.split(c, " ")
    own = rows.select("company_key").where("company_key <> ''").distinct()
    rules = windows.where(F.col("until") > as_of).groupBy("company", "title_word").agg(F.max("until").alias("until")).where("company <> ''")
    names = rules.select("company").distinct()
    inside = lambda a, b: F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))
    head, every = lambda df, c: df.select(c, words(F.col(c))[0].alias("w")), lambda df, c: df.select(c, F.explode(F.array_distinct(words(F.col(c)))).alias("w"))
    met = head(own, "company_key").join(every(names, "company"), "w").union(every(own, "company_key").join(head(names, "company"), "w")).select("company_key", "company").distinct()
    a, b = F.col("company_key"), F.col("company")
    met = met.where((a == b) | ((F.length(a) >= 4) & inside(a, b)) | ((F.length(b) >= 4) & inside(b, a)))
    hit = rows.join(met.join(rules, "company"), "company_key").where((F.col("title_word") == "") | F.contains(F.lower("title"), F.col("title_word")))
    return rows.join(hit.groupBy("id").agg(F.max("until").alias("cooldown_until")), "id", "left")


def first_fail(stages: list[tuple[str, Column]]) -> Column:
    """name of the first stage whose test is not true, null if all are."""
    return F.coalesce(*[F.when(~F.coalesce(test, F.lit(False)), name) for name, test in stages])


def opportunity_filter(rows: DataFrame, as_of: Column | None = None, **want) -> DataFrame:
    """optional predicates on scored postings; what is not asked for is not tested.

    min_score, high_confidence (75 or more), level, location, workplace and company (parts of the text), employment,
    max_age (days before as_of; an unknown day passes), source, since, is_new, changed, min_delta (of the score), term
    (in the title), min_profiles, state.
    """
    c, text = F.col, lambda n: F.lower(F.coalesce(n, F.lit("")))
    within = lambda n: lambda v: F.contains(text(n), F.lit(str(v).lower()))
    least = lambda n: lambda v: c(n) >= v
    equal = lambda n: lambda v: c(n) == v
    flag = lambda n: lambda v: c(n) if v else F.lit(True)
    tests = {
        "min_score": least("score"), "high_confidence": lambda v: c("score") >= 75 if v else F.lit(True), "level": equal("level"), "source": equal("source"), "state": equal("state"), "since": lambda v: c("posted") >= F.lit(v).cast("date"),
        "location": within("location"), "workplace": within("workplace"), "company": within("company"), "term": within("title"), "employment": lambda v: text("employment") == str(v).lower(),
        "max_age": lambda v: c("posted").isNull() | (F.datediff(as_of, "posted") <= v), "is_new": flag("is_new"), "changed": flag("changed"), "min_delta": least("delta"), "min_profiles": least("profiles"),
    }
    return reduce(lambda df, kv: df.where(tests[kv[0]](kv[1])), ((k, v) for k, v in want.items() if v is not None), rows)


def application_rules(rows: DataFrame, daily: int, least: float) -> DataFrame:
    """rows with failed (names of rules that fail) and decision; at most ``daily`` go out for a day and person.

    rows: num, person, applied, score, report, status.
    """
    rules = F.array_compact(F.array(
        F.when(F.coalesce(F.col("score") < least, F.lit(True)), "score"), F.when(F.coalesce(F.col("report"), F.lit("")) == "", "report"),
        F.when(F.coalesce(F.col("status").isin("Discarded", "SKIP", "Rejected"), F.lit(False)), "closed"),
    ))
    rows = rows.withColumn("failed", rules).withColumn("ok", F.size("failed") == 0)
    order = W.partitionBy("person", "applied", "ok").orderBy(F.desc("score"), "num")
    over = F.col("ok") & (F.row_number().over(order) > daily)
    return rows.withColumn("decision", F.when(~F.col("ok"), "reject").when(over, "defer").otherwise("apply")).drop("ok")


def find_applications(rows: DataFrame, status=None, company=None, since=None, limit: int = 20) -> DataFrame:
    """the newest applications with a status, a part of a company's name and a first day."""
    tests = (status and (F.col("status") == status), company and F.contains(F.lower("company"), F.lit(company.lower())), since and (F.col("applied") >= F.lit(since).cast("date")))
    return reduce(lambda df, t: df.where(t), (t for t in tests if t is not None), rows).orderBy(F.desc("applied"), F.desc("num")).limit(limit)


def title_gate(title: Column, family: list[str], exclusions: list[str], senior: bool) -> Column:
    """F16: reason why a title fails for a family of titles, null if it passes."""
    t = F.lower(F.coalesce(title, F.lit("")))
    words = sorted({w for f in family for w in re.split("[^a-z0-9+#]+", f.lower()) if len(w) > 2})
    overlap = F.arrays_overlap(F.filter(F.split(t, "[^a-z0-9+#]+"), lambda w: F.length(w) > 2), F.array(*map(F.lit, words)))
    out = F.when(any_of(t, exclusions), "exclusion")
    if senior:
        w = titles.padded(title)
        ranked = titles.has(w, [r for r in titles.RANKED if r not in ("vice president", "chief")])
        out = out.when(titles.has(w, ("junior",)) & ~ranked, "junior").when(titles.has(w, ("intern", "internship", "interns")), "intern")
        out = out.when(titles.has(w, ("associate",)) & ~titles.has(w, [f"associate {o}" for o in titles.ASSOCIATES if o not in ("counsel", "general manager")]), "associate")
    return out.when(~F.coalesce(overlap, F.lit(False)), "no overlap")


def tier_allowed(title: Column, skipped) -> Column:
    return ~titles.tier(title).isin(*skipped)
