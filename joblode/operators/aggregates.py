"""Aggregations: opportunities, funnels, rates, quality and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblode.functions.money import half_up, one_decimal, upper_median, whole
from joblode.operators.graph import components
from joblode.store import stored

C = F.col


def rate(part: Column, total: Column, digits: int = 0) -> Column:
    """Percentage of a total, halves up, null without one."""
    x = F.when(total > 0, 100.0 * part / total)
    return one_decimal(x) if digits == 1 else whole(x)


def merge_opportunities(rows: DataFrame) -> DataFrame:
    """A1: opportunity, n, sources, urls, first_day, last_day.

    rows: id, canonical, company_key, native_id, source, url, day. Postings with one canonical key, or one company
    and native id, are one opportunity (its least id), however long the chain of keys between them. Keys are the
    nodes, so a hot key is one row and its members are counted by tasks first. A posting without a canonical key
    counts by its URL, one without either by itself.
    """
    bare = (F.coalesce(C("canonical"), F.lit("")) == "") & (F.coalesce(C("url"), F.lit("")) == "")
    key1 = F.when(bare, F.concat(F.lit("i:"), C("id").cast("string"))).otherwise(F.concat(F.lit("c:"), F.when(C("canonical") != "", C("canonical")).otherwise(C("url"))))
    key2 = F.when((C("native_id") != "") & (C("company_key") != ""), F.concat_ws(":", F.lit("n"), "company_key", "native_id"))
    keyed = stored(rows.select("id", key1.alias("k1"), key2.alias("k2"), "source", "url", "day"))
    # every (k1, k2) pair that stands in a row is an edge
    comp = components(keyed.where("k2 is not null").select(C("k1").alias("u"), C("k2").alias("v")))
    full = keyed.join(comp, keyed["k1"] == comp["node"], "left").withColumn("label", F.coalesce("component", "k1"))
    out = full.groupBy("label").agg(F.min("id").alias("opportunity"), F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"), F.count_distinct("url").alias("urls"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return out.drop("label")


def employers(rows: DataFrame) -> DataFrame:
    """A2: company_key, jobs, sources, name (longest, then least), confidence, tier, reason.

    rows: company_key, name, source, verdict, board, generic, staffing.
    """
    one = rows.where("company_key <> ''").groupBy("company_key").agg(
        F.count("*").alias("jobs"), F.count_distinct("source").alias("sources"), F.min_by("name", F.struct(-F.length("name"), "name")).alias("name"),
        F.max(C("verdict") == "us").alias("us"), F.min(C("verdict") == "non-us").alias("foreign"), F.max("board").alias("board"), F.max("generic").alias("generic"), F.max("staffing").alias("staffing"),
    )
    raw = 0.5 - F.when(C("staffing"), 0.15).otherwise(0.0) + F.when(C("us"), 0.2).when(C("foreign"), -0.3).otherwise(0.0) + F.when(C("sources") > 1, 0.05).otherwise(0.0)
    value = F.round(F.when(C("board") | C("generic"), 0.0).otherwise(raw), 2)
    tier = F.when(C("confidence") >= 0.75, "high").when(C("confidence") >= 0.5, "medium").otherwise("low")
    reason = F.when(C("board"), "board-as-employer").when(C("generic"), "generic-name").when(C("tier") != "low", "").when(C("staffing"), "staffing-unverified").when(C("foreign"), "non-us-employer").otherwise("weak-evidence")
    return one.withColumn("confidence", value).withColumn("tier", tier).withColumn("reason", reason).select("company_key", "jobs", "sources", "name", "confidence", "tier", "reason")


def merge_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """A3: company_key, jobs, sources, confidence, first_day, last_day of two review queues together."""
    both = old.unionByName(new)
    return both.groupBy("company_key").agg(F.sum("jobs").alias("jobs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"), F.max("confidence").alias("confidence"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def tracker_stats(rows: DataFrame, states: DataFrame) -> DataFrame:
    """A4: state, n, mean_score, reports_pct of every known state (zero if it has no rows)."""
    own = rows.groupBy("state").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.count_if(C("report") != "").alias("r"))
    out = states.join(own, "state", "left")
    return out.select("state", F.coalesce("n", F.lit(0)).alias("n"), one_decimal(C("mean_score")).alias("mean_score"), rate(C("r"), C("n"), 1).alias("reports_pct"))


def funnel(rows: DataFrame, stage: str) -> DataFrame:
    """A5: stage, reached, pct of the stage before, from each row's highest stage (1 applied to 5 hired)."""
    counts = rows.agg(*[F.count_if(C(stage) >= i).alias(f"s{i}") for i in range(1, 6)])
    parts = [F.struct(F.lit(i).alias("stage"), C(f"s{i}").alias("reached"), rate(C(f"s{i}"), C(f"s{i - 1}" if i > 1 else "s1"), 1).alias("pct")) for i in range(1, 6)]
    return counts.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def weekly_added(rows: DataFrame, weeks: int = 8) -> DataFrame:
    """Week, added, companies of the newest weeks (rows: week, company_key)."""
    return rows.groupBy("week").agg(F.count("*").alias("added"), F.count_distinct("company_key").alias("companies")).orderBy(F.desc("week")).limit(weeks)


def source_health(configured: DataFrame, rows: DataFrame) -> DataFrame:
    """Source, produced, dead of each configured source."""
    own = rows.groupBy("source").agg(F.count("*").alias("produced"))
    return configured.join(own, "source", "left").select("source", F.coalesce("produced", F.lit(0)).alias("produced"), C("produced").isNull().alias("dead"))


def provider_signal(rows: DataFrame) -> DataFrame:
    """Source, raw, accepted, employers, signal (0-100), health. rows: source, accepted, company_key."""
    out = rows.groupBy("source").agg(F.count("*").alias("raw"), F.count_if("accepted").alias("accepted"), F.count_distinct(F.when(C("accepted"), C("company_key"))).alias("employers"))
    signal = half_up(100 * (0.7 * C("accepted") / C("raw") + 0.3 * F.least(F.lit(1.0), C("employers") / 10)))
    return out.withColumn("signal", signal.cast("int")).withColumn("health", F.when(C("accepted") == 0, "barren").when(C("signal") >= 50, "good").otherwise("weak"))


def trace_status(events: DataFrame, names: list[str]) -> DataFrame:
    """Key, status: name of the furthest stage (0-based) that a key reached."""
    return events.groupBy("key").agg(F.element_at(F.array(*map(F.lit, names)), F.max("stage") + 1).alias("status"))


def search_quality(rows: DataFrame, by: str, outcomes: list[str], least: int = 30) -> DataFrame:
    """A10: by, shown, one count for each outcome, enough (whether the sample suffices)."""
    return rows.groupBy(by).agg(F.count("*").alias("shown"), *[F.count_if(C("outcome") == o).alias(o) for o in outcomes]).withColumn("enough", C("shown") >= least)


def search_quality_by(rows: DataFrame, dims: list[str], outcomes: list[str], least: int = 30) -> DataFrame:
    """A10: dim, value, retrieved, tracked, one count for each outcome, coverage (whole per cent tracked), enough.

    rows: what searches retrieved, with an outcome where it is tracked. All dimensions are counted in one shuffle, by
    grouping sets; a null value of a dimension is ``unknown``.
    """
    filled = rows.select(*[F.coalesce(C(d).cast("string"), F.lit("unknown")).alias(d) for d in dims], "outcome")
    counted = [F.count("*").alias("retrieved"), F.count("outcome").alias("tracked"), *[F.count_if(C("outcome") == o).alias(o) for o in outcomes]]
    dim = F.coalesce(*[F.when(F.grouping(d) == 0, d) for d in dims]).alias("dim")
    sets = filled.groupingSets([[C(d)] for d in dims], *[C(d) for d in dims]).agg(dim, *counted)
    return sets.select("dim", F.coalesce(*dims).alias("value"), "retrieved", "tracked", *outcomes, half_up(100 * C("tracked") / C("retrieved")).cast("int").alias("coverage"), (C("tracked") >= least).alias("enough"))


def conversions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Hop, value: share (three decimals) of those at or beyond an outcome that went beyond it."""
    n = rows.agg(*[F.count_if(C("outcome").isin(*order[i:])).alias(f"n{i}") for i in range(len(order))])
    hops = [F.struct(F.lit(f"{order[i]}>{order[i + 1]}").alias("hop"), (half_up(1000 * C(f"n{i + 1}") / F.greatest(C(f"n{i}"), F.lit(1))) / 1000).alias("value")) for i in range(len(order) - 1)]
    return n.select(F.explode(F.array(*hops)).alias("h")).select("h.*")


def cross_tab(rows: DataFrame, side: str, top: str, values: list[str]) -> DataFrame:
    """Side and one count for each value of the other column."""
    return rows.groupBy(side).pivot(top, values).agg(F.count(F.lit(1))).na.fill(0)


def readiness(rows: DataFrame, least: dict[str, int]) -> DataFrame:
    """Gate, n, enough: counts of outcomes against their minimums, and how many kinds there are."""
    n = rows.agg(*[F.count_if(C("outcome") == k).alias(k) for k in least], F.count_distinct("outcome").alias("kinds"))
    gates = [F.struct(F.lit(k).alias("gate"), C(k).alias("n"), (C(k) >= v).alias("enough")) for k, v in ({**least, "kinds": 3}).items()]
    return n.select(F.explode(F.array(*gates)).alias("g")).select("g.*")


def breakdown(rows: DataFrame, dims: list[str], good: Column) -> DataFrame:
    """Dim, value, total, positive, conversion (whole %) over several dimensions in one pass."""
    long = rows.withColumn("_good", good).select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), C(d).cast("string").alias("value")) for d in dims])).alias("d"), "_good")
    out = long.groupBy("d.dim", "d.value").agg(F.count("*").alias("total"), F.count_if("_good").alias("positive"))
    return out.withColumn("conversion", rate(C("positive"), C("total")))


def frequency(rows: DataFrame, key: str, items: str, top: int) -> DataFrame:
    """Item, n, pct of the rows that have it (once each), the most frequent ones."""
    total = rows.agg(F.count("*").alias("total"))
    n = rows.select(key, F.explode(F.array_distinct(items)).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total)).select("item", "n", rate(C("n"), C("total")).alias("pct")).orderBy(F.desc("n"), "item").limit(top)


def channels(rows: DataFrame, least: int = 5) -> DataFrame:
    """Via, total, advanced, pct, share, enough, dead (none advanced, though a tenth of the rest did)."""
    one = rows.where("via <> ''").groupBy("via").agg(F.count("*").alias("total"), F.count_if("advanced").alias("adv"))
    both = rows.agg(F.count("*").alias("all_n"), F.count_if("advanced").alias("all_adv"))
    j = one.join(F.broadcast(both))
    rest = (C("all_adv") - C("adv")) / F.greatest(C("all_n") - C("total"), F.lit(1))
    return j.select("via", "total", C("adv").alias("advanced"), rate(C("adv"), C("total")).alias("pct"), rate(C("total"), C("all_n")).alias("share"), (C("total") >= least).alias("enough"), ((C("adv") == 0) & (C("total") >= least) & (rest >= 0.1)).alias("dead"))


def calibration(rows: DataFrame, least: int = 5) -> DataFrame:
    """Band, n, interviews, pct of resolved applications by score band; no rate below the least sample.

    rows: score, verdict (reached an interview: true or false; null is not resolved).
    """
    band = F.when(C("score") < 3.5, "<3.5").when(C("score") < 4.0, "3.5-3.9").when(C("score") < 4.5, "4.0-4.4").otherwise(">=4.5")
    out = rows.where("verdict is not null and score > 0").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if("verdict").alias("interviews"))
    return out.withColumn("pct", F.when(C("n") >= least, rate(C("interviews"), C("n"))))


def salary_gaps(rows: DataFrame, trust: dict[str, int]) -> DataFrame:
    """Currency, confirmed, mean_pct, median_pct between advertised and actual pay of the same currency.

    rows: num, type, source, day, value, currency. Of each number and type the most trusted, then the latest counts.
    """
    level = F.create_map(*[F.lit(x) for kv in trust.items() for x in kv])[C("source")]
    best = rows.withColumn("level", level).where("level is not null and value is not null").groupBy("num", "type").agg(F.max_by(F.struct("value", "currency"), F.struct("level", "day")).alias("v"))
    wide = best.groupBy("num").pivot("type", ["advertised", "actual"]).agg(F.first("v")).where("actual is not null")
    pct = F.when(C("advertised.currency") == C("actual.currency"), 100 * (C("actual.value") - C("advertised.value")) / C("advertised.value"))
    return wide.groupBy(C("actual.currency").alias("currency")).agg(F.count("*").alias("confirmed"), F.round(F.avg(pct), 6).alias("mean_pct"), F.round(F.median(pct), 6).alias("median_pct"))


def skill_gaps(rows: DataFrame, known: DataFrame, low: float = 3.5) -> DataFrame:
    """Skill, reports, weight, low_reports, tier of skills that reports miss and a person lacks.

    rows: num, score, skills. A report weighs what its score lacks to 5 (1 without a score).
    """
    total = rows.agg(F.count_if(C("score") < low).alias("total"))
    each = rows.select("num", "score", F.explode(F.array_distinct("skills")).alias("skill")).join(known.select("skill").distinct(), "skill", "left_anti")
    weight = F.coalesce(F.greatest(F.lit(0.0), 5.0 - C("score")), F.lit(1.0))
    out = each.groupBy("skill").agg(F.count("*").alias("reports"), F.round(F.sum(weight), 2).alias("weight"), F.count_if(C("score") < low).alias("low_reports")).join(F.broadcast(total))
    share = C("low_reports") / C("total")
    return out.select("skill", "reports", "weight", "low_reports", F.when((share >= 0.5) & (C("low_reports") >= 3), "Critical").when((share >= 0.3) & (C("low_reports") >= 2), "High").when(C("low_reports") >= 2, "Medium").otherwise("Low").alias("tier"))


def skill_coverage(required: DataFrame, have: DataFrame, text: Column) -> DataFrame:
    """Id, skill, state: existing (listed), supported (in the text), gap. required: id, skill; have: id, listed, text."""
    j = required.join(have, "id")
    return j.select("id", "skill", F.when(F.array_contains("listed", C("skill")), "existing").when(F.contains(F.lower(text), F.lower("skill")), "supported").otherwise("gap").alias("state"))


def friction(rows: DataFrame) -> DataFrame:
    """Company, interviews, frictions, share (two decimals). Nameless employers count by their channel."""
    bare = C("company").rlike(r"[\p{L}\p{N}]")
    label = F.when(bare, C("company")).when(C("via") != "", F.concat(F.lit("? (via "), "via", F.lit(")")))
    out = rows.withColumn("label", label).where("label is not null").groupBy(F.lower("label").alias("company")).agg(F.count("*").alias("interviews"), F.count_if("friction").alias("frictions"))
    return out.withColumn("share", half_up(100 * C("frictions") / C("interviews")) / 100)


def assessments(rows: DataFrame, as_of: Column) -> DataFrame:
    """Platform, n, stale (over 180 days), passed, failed, unknown. rows: platform, day, score, threshold."""
    known = C("score").isNotNull() & C("threshold").isNotNull()
    return rows.groupBy("platform").agg(F.count("*").alias("n"), F.count_if(F.datediff(as_of, "day") > 180).alias("stale"), F.count_if(known & (C("score") >= C("threshold"))).alias("passed"), F.count_if(known & (C("score") < C("threshold"))).alias("failed"), F.count_if(~known).alias("unknown"))


def digest(rows: DataFrame, begin: Column, end: Column) -> DataFrame:
    """Tag, n, recurring, companies of tags in a period's sessions. rows: day, company, tags."""
    each = rows.where(C("day").between(begin, end)).select("company", F.explode("tags").alias("tag"))
    return each.groupBy("tag").agg(F.count("*").alias("n"), (F.count("*") >= 2).alias("recurring"), F.count_distinct("company").alias("companies"))


def funded(rows: DataFrame) -> DataFrame:
    """company_key, mentions (distinct evidence), amount and round of the first one, score.

    rows: id, company_key, evidence, amount, round.
    """
    once = rows.groupBy("company_key", "evidence").agg(F.min(F.struct("id", "amount", "round")).alias("f"))
    out = once.groupBy("company_key").agg(F.count("*").alias("mentions"), F.min(F.when(C("f.amount").isNotNull(), C("f"))).alias("a"), F.min(F.when(C("f.round") != "", C("f"))).alias("r"))
    return out.select("company_key", "mentions", C("a.amount").alias("amount"), C("r.round").alias("round"), (F.least(C("mentions"), F.lit(5)) * 10 + F.when(C("a").isNotNull(), 30).otherwise(0) + F.when(C("r").isNotNull(), 20).otherwise(0)).cast("int").alias("score"))


def company_cards(rows: DataFrame, as_of: Column) -> DataFrame:
    """company_key, applications, silent (28 to 365 days in Applied), answers, label, severity.

    rows: company_key, state, applied.
    """
    age = F.datediff(as_of, "applied")
    out = rows.groupBy("company_key").agg(F.count("*").alias("applications"), F.count_if((C("state") == "Applied") & (age >= 28) & (age <= 365)).alias("silent"), F.count_if(C("state").isin("Responded", "Interview", "Offer", "Hired", "Rejected")).alias("answers"))
    label = F.when(C("answers") * 2 >= C("applications"), "responsive").when(C("silent") > 0, "silent").otherwise("quiet")
    return out.select("*", label.alias("label"), F.when(C("silent") >= 2, "pattern").when(C("silent") == 1, "single").otherwise("none").alias("severity"))


def silence(interviews: DataFrame, applications: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Num, last_talk, waited of open applications whose last interview is ``days`` or more ago."""
    last = interviews.groupBy("num").agg(F.max("day").alias("last_talk"))
    open_ = applications.where(C("state").isin("Applied", "Responded", "Interview")).select("num")
    return open_.join(last, "num").withColumn("waited", F.datediff(as_of, "last_talk")).where(C("waited") >= days)


def match_matrix(rows: DataFrame) -> DataFrame:
    """Label, band, n, mean, upper_mid score of labelled matches."""
    return rows.groupBy("label", "band").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), upper_median("score", "int").alias("upper_mid"))


def audit_reasons(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Reason, given, wrong: reasons of scores, and how often the posting does not bear them out."""
    each = rows.select("*", F.explode("reasons").alias("reason")).where(C("reason").isin(*checks))
    holds = F.lit(True)
    for name, test in checks.items():
        holds = F.when(C("reason") == name, F.coalesce(test, F.lit(False))).otherwise(holds)
    return each.groupBy("reason").agg(F.count("*").alias("given"), F.count_if(~holds).alias("wrong"))


def losses(rows: DataFrame) -> DataFrame:
    """Source, n (rows), no_place, undated, stale, several (rows whose opening other sources show too).

    rows: source, location, age (days, null: unknown), opening (a key; empty: none).
    """
    shown = rows.where(F.coalesce("opening", F.lit("")) != "").groupBy("opening").agg(F.count_distinct("source").alias("sources")).where("sources > 1").select("opening", F.lit(True).alias("shared"))
    all_ = rows.join(shown, "opening", "left")
    return all_.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.coalesce("location", F.lit("")) == "").alias("no_place"), F.count_if(C("age").isNull()).alias("undated"), F.count_if(C("age") > 365).alias("stale"), F.count_if(C("shared")).alias("several"))


def confusion(rows: DataFrame, least: int = 30) -> DataFrame:
    """Observed, n, right, precision, enough. rows: observed, confirmed (null: not yet)."""
    out = rows.groupBy("observed").agg(F.count("*").alias("n"), F.count("confirmed").alias("known"), F.count_if(C("observed") == C("confirmed")).alias("right"))
    return out.select("observed", "n", "right", F.when(C("known") > 0, C("right") / C("known")).alias("precision"), (C("known") >= least).alias("enough"))


def agreement(rows: DataFrame) -> DataFrame:
    """N, category_pct, mean_delta, unscored, passes (80 % or more). rows: label, own, label_score, own_score."""
    delta = F.abs(C("label_score") - C("own_score"))
    out = rows.agg(F.count("*").alias("n"), F.count_if(C("label") == C("own")).alias("same"), F.round(F.avg(delta), 6).alias("mean_delta"), F.count_if(delta.isNull()).alias("unscored"), F.count_if(delta <= 0.5).alias("near"))
    return out.select("n", rate(C("same"), C("n"), 1).alias("category_pct"), "mean_delta", "unscored", "near", (C("same") * 100 >= C("n") * 80).alias("passes"))


def density(rows: DataFrame, signals: list[str], length: str) -> DataFrame:
    """Signal, pct of presence, and the mean and upper median length (one row for each signal)."""
    n = rows.agg(F.count("*").alias("n"), *[F.count_if(s).alias(s) for s in signals], F.round(F.avg(length), 6).alias("mean_length"), upper_median(length, "int").alias("mid_length"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), rate(C(s), C("n"), 1).alias("pct")) for s in signals])).alias("s"), "mean_length", "mid_length").select("s.*", "mean_length", "mid_length")


def dashboard(rows: DataFrame, top: int = 8) -> DataFrame:
    """Dim, value, n, mid_pay: tier, mode and the most frequent places, with the median pay."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), C(d).alias("value")) for d in ("tier", "mode", "place")])).alias("d"), "pay")
    out = long.groupBy("d.dim", "d.value").agg(F.count("*").alias("n"), F.median("pay").alias("mid_pay"))
    rank = F.row_number().over(W.partitionBy("dim").orderBy(F.desc("n"), "value"))
    return out.withColumn("r", rank).where((C("dim") != "place") | (C("r") <= top)).drop("r")


def usage(rows: DataFrame) -> DataFrame:
    """Model, step, tokens, cost, with a total of each model and of all (nulls stand for all)."""
    return rows.rollup("model", "step").agg(F.sum(C("input") + C("output")).alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))


def table_freshness(rows: DataFrame, as_of: Column, months: int = 12) -> DataFrame:
    """Id, finding: expired (next day passed), review (older than the months), ok."""
    return rows.select("id", F.when(C("next_day") <= as_of, "expired").when(F.add_months("day", months) <= as_of, "review").otherwise("ok").alias("finding"))


def search_evaluation(rows: DataFrame, items: str, top: int = 15) -> DataFrame:
    """profile_id, item, n, rank: the most frequent reasons or penalties of each profile."""
    n = rows.select("profile_id", F.explode(items).alias("item")).groupBy("profile_id", "item").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("profile_id").orderBy(F.desc("n"), "item"))).where(C("rank") <= top)


def against_benchmark(own: DataFrame, benchmark: DataFrame, least: int = 20) -> DataFrame:
    """Metric, pct, band, times (of the typical value), small. benchmark (few rows): metric, low, high, typical."""
    j = own.join(benchmark, "metric")
    return j.select("metric", "pct", F.when(C("pct") < C("low"), "below-range").when(C("pct") > C("high"), "above-range").otherwise("within-range").alias("band"), F.when(C("typical") > 0, one_decimal(C("pct") / C("typical"))).alias("times"), (C("n") < least).alias("small"))
