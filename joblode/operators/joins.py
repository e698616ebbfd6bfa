"""Joins: seen postings, scoring, fuzzy matches, upserts, diffs and checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblode.functions import title as titles
from joblode.functions.money import half_up, score_band
from joblode.functions.text import tokens, words_only
from joblode.operators.overlap import best_overlap
from joblode.store import stored


def unseen(batch: DataFrame, history: DataFrame, as_of: Column, recheck: int = 30) -> DataFrame:
    """Rows of a batch (id, key) whose key the history (key, status, day, until) does not hold any more.

    Added rows count for ``recheck`` days, cooldowns until their day, any other status for ever. The history is cut
    to the batch's keys first, so that its size does not decide the shuffle.
    """
    live = F.when(F.col("status") == "added", F.datediff(as_of, F.col("day")) < recheck).when(F.col("status") == "cooldown", F.col("until") > as_of).otherwise(True)
    held = history.join(batch.select("key").distinct(), "key", "left_semi").where(live).select("key").distinct()
    return batch.join(held, "key", "left_anti")


def unseen_roles(batch: DataFrame, history: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows (id, company_key, role_key) whose company and role are not in the history.

    aliases (alias, company_key): aliases of more than one company are ignored.
    """
    one = aliases.groupBy("alias").agg(F.count_distinct("company_key").alias("n"), F.min("company_key").alias("target")).where("n = 1").select("alias", "target")
    named = lambda df: df.join(one, df["company_key"] == one["alias"], "left").withColumn("k", F.coalesce("target", "company_key")).drop("alias", "target")
    return named(batch).join(named(history).select("k", "role_key").distinct(), ["k", "role_key"], "left_anti")


#: Weights of the parts of a match score (100 in all).
WEIGHTS = {"title": 25, "seniority": 12, "skills": 18, "functional": 10, "experience": 5, "company": 6, "compensation": 7, "location": 10, "employment": 4, "leadership": 3}


def _fraction(term: Column, hay: Column) -> Column:
    """Part of a term's tokens in a text: all of one token, at least half of several, else nothing."""
    part = F.size(F.filter(term, lambda t: F.array_contains(hay, t))) / F.size(term)
    return F.when(F.size(term) == 0, 0.0).when(F.size(term) == 1, part).otherwise(F.when(part >= 0.5, part).otherwise(0.0))


def _hits(terms: Column, hay: Column) -> Column:
    return F.size(F.filter(terms, lambda t: _fraction(t, hay) > 0))


#: Profiles that meet all postings at once; more go in blocks.
PROFILES = 500


def score(postings: DataFrame, profiles: DataFrame, weights: dict[str, int] | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """Id, profile_id, score, band, reasons, penalties of each posting and profile.

    postings: id, title, description, company, location, country, employment, pay_min. profiles (the requests):
    profile_id, roles, skills, areas, leadership (arrays of token arrays), exclusions (array), seniority, years, pay.
    Each text is tokenised once, before the profiles multiply it; profiles go out in blocks of a checked size.
    ``carried`` columns of postings follow in the result.
    """
    blocks = -(-profiles.count() // PROFILES)
    if blocks <= 1:
        return _score(postings, profiles, weights, carried)
    parts = [_score(postings, profiles.where(F.pmod(F.xxhash64("profile_id"), F.lit(blocks)) == i), weights, carried) for i in range(blocks)]
    return reduce(DataFrame.union, parts)


def _score(postings: DataFrame, profiles: DataFrame, weights: dict[str, int] | None, carried: Sequence[str] = ()) -> DataFrame:
    w = WEIGHTS | (weights or {})
    text = F.concat_ws(" ", "title", "description")
    level = titles.seniority(F.col("title"))
    ladder = F.array(*map(F.lit, titles.LADDER))
    p = postings.select("*", tokens(F.col("title")).alias("tt"), F.array_distinct(tokens(text)).alias("ft"), level.alias("level"), F.array_position(ladder, level).alias("got"), F.lower("title").alias("lt"))
    p = p.join(F.broadcast(profiles), F.lit(True))
    c = F.col
    want = F.when(F.array_position(ladder, c("seniority")) > 0, F.array_position(ladder, c("seniority"))).otherwise(5)
    known = F.array_position(ladder, c("seniority")) > 0
    excluded = F.exists("exclusions", lambda x: F.contains(c("lt"), x))
    veto = excluded | (known & (want >= 4) & (titles.beginner(c("title")) | titles.plain_associate(c("title"))))
    p = p.withColumns({
        "fit": F.when(F.size("roles") == 0, 1.0).otherwise(F.aggregate(F.transform("roles", lambda r: _fraction(r, c("tt"))), F.lit(0.0), lambda a, x: F.greatest(a, x))),
        "n_skill": _hits(c("skills"), c("ft")), "n_area": _hits(c("areas"), c("ft")), "n_lead": _hits(c("leadership"), c("ft")), "veto": veto, "want": want,
    })
    early, late = c("level").isin("intern", "entry", "junior"), c("level").isin("director", "head", "vp", "executive")
    remote, us = F.coalesce(F.lower("location").rlike(r"\bremote\b"), F.lit(False)), c("country") == "US"
    misfit = (F.coalesce(c("years") >= 8, F.lit(False)) & early) | (F.coalesce(c("years") <= 2, F.lit(False)) & late)
    priced = c("pay_min").isNotNull() & (c("pay") > 0)
    parts = {
        "title": half_up(c("fit") * w["title"]), "seniority": half_up(F.greatest(F.lit(0), w["seniority"] - F.abs(c("got") - c("want")) * 3)),
        "skills": F.when(F.size("skills") == 0, half_up(F.lit(w["skills"] * 0.5))).otherwise(half_up(F.least(F.lit(1.0), c("n_skill") / 3) * w["skills"])),
        "functional": F.when(F.size("areas") == 0, half_up(F.lit(w["functional"] * 0.5))).otherwise(half_up(F.least(F.lit(1.0), c("n_area") / 2) * w["functional"])),
        "experience": F.when(misfit, 1).otherwise(w["experience"]), "company": F.least(F.lit(w["company"]), half_up(F.lit(w["company"] * 0.5)) + F.when(c("company") != "", 2).otherwise(0)),
        "compensation": F.when(priced, F.when(c("pay_min") >= c("pay"), w["compensation"]).otherwise(1)).otherwise(half_up(F.lit(w["compensation"] * 0.6))),
        "location": F.when(us & remote, w["location"]).when(us, w["location"] - 3).otherwise(half_up(F.lit(w["location"] * 0.4))),
        "employment": F.when(c("employment") == "", half_up(F.lit(w["employment"] * 0.6))).when(c("employment") == "full-time", w["employment"]).otherwise(1),
        "leadership": F.when((c("n_lead") > 0) & (c("got") >= 5), w["leadership"]).otherwise(1),
    }
    total = sum(x.cast("int") for x in parts.values())
    p = p.withColumn("score", F.least(F.lit(100), F.when(c("veto"), F.least(total, F.lit(20))).otherwise(total)))
    reasons = F.array_compact(F.array(F.when(c("fit") >= 0.6, "title"), F.when(c("got") >= c("want"), "seniority"), F.when(c("n_skill") > 0, "skill"), F.when(c("n_area") > 0, "domain"), F.when(us & remote, "us remote"), F.when(priced & (c("pay_min") >= c("pay")), "pay")))
    penalties = F.array_compact(F.array(F.when(c("fit") <= 0.2, "weak title"), F.when(c("got") < c("want"), "below seniority"), F.when((c("n_skill") == 0) & (F.size("skills") > 0), "no skill"), F.when(misfit, "experience"), F.when(c("company") == "", "unknown employer"), F.when(c("veto"), "veto")))
    return p.select("id", "profile_id", "score", score_band(c("score")).alias("band"), reasons.alias("reasons"), penalties.alias("penalties"), *carried)


def best_profile(scored: DataFrame, least: int = 0) -> DataFrame:
    """Id, profile_id, score, profiles (how many reach ``least``) of each posting; ties by profile_id."""
    best = F.max_by(F.struct("profile_id", "score"), F.struct("score", -F.col("profile_id")))
    return scored.where(F.col("score") >= least).groupBy("id").agg(best.alias("b"), F.count("*").alias("profiles")).select("id", "b.profile_id", "b.score", "profiles")


#: Words of company names that tell nothing apart.
COMMON = ("the", "inc", "llc", "ltd", "group", "co", "corp", "company", "holdings", "labs", "lab", "technology", "technologies", "solutions", "services", "systems", "partners", "and", "of", "global", "international", "jobs")


def company_tokens(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(words_only(F.coalesce(name, F.lit(""))), " "), lambda w: (w != "") & ~w.isin(*COMMON))))


def company_links(a: DataFrame, b: DataFrame) -> DataFrame:
    """A, b, tier of company names (a: name; b: name): exact (equal words), strong (equal distinctive words, one of
    three characters or more), weak (a distinctive word in common). Names are distinct; words join them, so names without
    words ("?") match nothing."""
    key = lambda df, x: df.select(F.col("name").alias(x)).where("name <> ''").distinct().select(x, words_only(F.col(x)).alias(f"k{x}"), company_tokens(F.col(x)).alias(f"t{x}"))
    ka, kb = key(a, "a"), key(b, "b")
    near = ka.select("a", F.explode("ta").alias("t")).join(kb.select("b", F.explode("tb").alias("t")), "t").select("a", "b").distinct()
    near = near.union(ka.join(kb, (ka["ka"] == kb["kb"]) & (ka["ka"] != "")).select("a", "b")).distinct()
    both = near.join(ka, "a").join(kb, "b")
    strong = (F.col("ta") == F.col("tb")) & F.exists("ta", lambda w: F.length(w) >= 3)
    return both.select("a", "b", F.when(F.col("ka") == F.col("kb"), "exact").when(strong, "strong").otherwise("weak").alias("tier"))


def invite_matches(invites: DataFrame, applications: DataFrame) -> DataFrame:
    """invite_id, num, points of the best application for an invite.

    Points: twice the words in common over all words of both company names, and a half if the requisition stands in
    the notes. Ties: the smaller num.
    """
    i = invites.select("invite_id", "req", company_tokens(F.col("company")).alias("ti"))
    names = applications.select("company").distinct().select("company", company_tokens(F.col("company")).alias("ta"))
    words = i.select("ti").distinct().select("ti", F.explode("ti").alias("t")).join(names.select("company", "ta", F.explode("ta").alias("t")), "t")
    alike = words.groupBy("ti", "company").agg(F.count("*").alias("n"), F.first("ta").alias("ta")).select("ti", "company", (2 * F.col("n") / (F.size("ti") + F.size("ta"))).alias("dice"))
    best = applications.groupBy("company").agg(F.min("num").alias("num"))
    by_req = i.where("req <> ''").join(applications.select("company", "num", "req"), "req").join(alike, ["ti", "company"]).select("invite_id", "num", (F.col("dice") + 0.5).alias("points"))
    plain = i.join(alike, "ti").join(best, "company").select("invite_id", "num", F.col("dice").alias("points"))
    return plain.union(by_req).groupBy("invite_id").agg(F.max(F.struct("points", -F.col("num"))).alias("b")).select("invite_id", (-F.col("b.col2")).alias("num"), "b.points")


def _grams(x: Column, size: int) -> Column:
    """Every run of so many characters of a text, each once."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?s)(?=({'.' * size}))"), F.lit(1)))


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """part, whole of texts (parts: part; wholes: whole; distinct, not empty) of which the whole holds the part, at any place.

    A part meets the wholes by the rarest of its runs of three characters (of shorter ones, by itself); no pair is lost,
    since a whole that holds the part holds all its runs.
    """
    own = F.when(F.length("part") < 3, F.array("part")).otherwise(_grams(F.col("part"), 3))
    runs = parts.select("part", F.explode(own).alias("g"))
    held = wholes.select("whole", F.explode(F.concat(*[_grams(F.col("whole"), n) for n in (1, 2, 3)])).alias("g"))
    often = held.join(runs.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count("*").alias("often"))
    rarest = runs.join(often, "g", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g")).alias("r"))
    return held.join(rarest.select("part", F.col("r.g").alias("g")), "g").where(F.contains("whole", "part")).select("part", "whole")


def reply_matches(replies: DataFrame, applications: DataFrame) -> DataFrame:
    """message_id, num, points of each reply; num is null if two applications match as well, or none does (0 points).

    Points: company named 2, sender's domain 2, role named 1.5; a match has 2 at least. A name without a letter or digit
    ("?") names nobody.
    """
    site = F.lower(F.regexp_extract("sender", r"@(?:[^@]*\.)?([^.@]+)\.[^.@]+$", 1))
    r = replies.select("message_id", F.coalesce(F.lower("text"), F.lit("")).alias("lower"), F.coalesce(site, F.lit("")).alias("site"))
    # a company's applications count as their distinct roles until one is wanted; several steps read these and the texts
    roles = stored(applications.groupBy("company", F.lower("role").alias("lr")).agg(F.count("*").alias("many"), F.min("num").alias("num")))
    names = roles.select("company").distinct().where(words_only(F.col("company")) != "").select("company", F.lower("company").alias("lc"))
    # equal texts from one site are matched once
    said = ["lower", "site"]
    words = stored(r.select(*said).distinct())
    only = lambda df, c, name: df.select(F.col(c).alias(name)).where(F.col(name) != "").distinct()
    named = contained(only(names, "lc", "part"), only(words, "lower", "whole")).select(F.col("whole").alias("lower"), F.col("part").alias("lc"))
    from_site = contained(only(words, "site", "part"), only(names, "lc", "whole")).select(F.col("part").alias("site"), F.col("whole").alias("lc"))
    hits = words.join(named, "lower").select(*said, "lc", F.lit(2.0).alias("base")).union(words.join(from_site, "site").select(*said, "lc", F.lit(2.0)))
    hits = hits.groupBy(*said, "lc").agg(F.sum("base").alias("base")).join(names, "lc")
    points = F.col("base") + F.when(F.contains("lower", "lr"), 1.5).otherwise(0.0)
    each = hits.join(roles, "company").withColumn("points", points).groupBy(*said, "points").agg(F.sum("many").alias("many"), F.min("num").alias("num"))
    best = each.groupBy(*said).agg(F.max(F.struct("points", "many", "num")).alias("t")).select(*said, F.when(F.col("t.many") == 1, F.col("t.num")).alias("num"), "t.points")
    return r.join(best, said, "left").select("message_id", "num", F.coalesce("points", F.lit(0.0)).alias("points"))


#: What the round of an interview says about an application; any other round says that there is an interview.
ROUNDS = {"rejected": "Rejected", "declined": "Discarded", "withdrawn": "Discarded", "cancelled": "Discarded", "canceled": "Discarded", "ghosted": "Discarded", "offer": "Offer", "offered": "Offer"}
#: Open states in order, and states that no further one follows.
OPEN_STATES = ("Evaluated", "Applied", "Responded", "Interview")
END_STATES = ("Offer", "Rejected", "Discarded", "SKIP", "Hired")


def _name_words(name: Column) -> Column:
    """The words of an employer's name, each once, without what stands in parentheses and legal last words."""
    raw = F.replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\([^)]*\)", " "), F.lit("&"), F.lit(" and "))
    legal = "inc|incorporated|llc|ltd|limited|corp|corporation|co|company|plc|gmbh|ag|sa|bv|nv|pty"
    return F.array_distinct(F.filter(F.split(F.regexp_replace(words_only(raw), f"( ({legal}))+$", ""), " "), lambda w: w != ""))


def _rarest(sets: DataFrame, keep) -> DataFrame:
    """sets (name, words) with w: those of a set's rarest words that it needs to meet another, ``keep`` of its size."""
    each = sets.select("name", F.explode("words").alias("w"))
    often = each.groupBy("w").agg(F.count("*").alias("often"))
    ranked = each.join(often, "w").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("often", "w"))).alias("r"))
    return ranked.select("name", F.explode(F.slice("r", F.lit(1), keep(F.size("r")).cast("int"))).alias("x")).select("name", F.col("x.w").alias("w"))


def similar_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b, similarity of names (a: name; b: name) whose words agree by half (Dice: twice the common words over all).

    Names of n words that agree by half share a third of n words at least, so they share one of the rarest
    n - ceil(n / 3) + 1 words of both; names three times as long as the other never agree.
    """
    names = lambda df: df.where("name <> ''").select("name").distinct().withColumn("words", _name_words(F.col("name")))
    one, two = names(a).where(F.size("words") > 0), names(b).where(F.size("words") > 0)
    need = _rarest(one.union(two).dropDuplicates(["name"]), lambda n: n - F.ceil(n / 3) + 1)
    left, right = one.join(need, "name").select(F.col("name").alias("a"), F.col("words").alias("wa"), "w"), two.join(need, "name").select(F.col("name").alias("b"), F.col("words").alias("wb"), "w")
    near = (F.size("wa") <= 3 * F.size("wb")) & (F.size("wb") <= 3 * F.size("wa"))
    pairs = left.join(right, "w").where(near).select("a", "b", "wa", "wb").distinct()
    alike = pairs.select("a", "b", (2 * F.size(F.array_intersect("wa", "wb")) / (F.size("wa") + F.size("wb"))).alias("similarity"))
    return alike.where("similarity >= 0.5")


def tracker_drift(interviews: DataFrame, applications: DataFrame) -> DataFrame:
    """interview_id, num, method, confidence, action, suggested of each interview.

    interviews: interview_id, company, role, notes, round; applications: num, company, role, status (canonical or null). A
    note "#7 in tracker" names the application, if one row has that number; else there is one if exactly one row's company
    agrees by half and its role names the same opening (J10). Methods are tracker-ref, fuzzy, unmatched; confidence is 1,
    the similarity, or for several fuzzy matches the best one's. The states are compared: ok if they are equal, auto with
    the later state as suggested if one is later (an end is later than any other), review if both are ends, or if a state is
    unknown and the other no end.
    """
    i = interviews.withColumn("ref", F.regexp_extract(F.coalesce("notes", F.lit("")), r"(?i)#\s*([0-9]+)\s+in\s+tracker", 1).try_cast("long"))
    # both are read by several steps below, and notes and states are costly to read
    i = stored(i.select("interview_id", "company", "role", "round", "ref"))
    applications = stored(applications.select("num", "company", "role", "status"))
    single = applications.groupBy("num").agg(F.count("*").alias("many"), F.min("status").alias("own")).where("many = 1").select(F.col("num").alias("hit"), "own")
    named = i.where("ref is not null").join(single, F.col("ref") == F.col("hit"), "left").select("interview_id", "round", F.col("hit").alias("num"), "own", F.when(F.col("hit").isNotNull(), 1.0).otherwise(0.0).alias("confidence"), F.when(F.col("hit").isNotNull(), "tracker-ref").otherwise("unmatched").alias("method"))
    free = i.where("ref is null")
    firms = similar_names(free.select(F.col("company").alias("name")), applications.select(F.col("company").alias("name")))
    asked = free.select(F.col("company").alias("a"), F.col("role").alias("ra")).distinct()
    held = applications.groupBy(F.col("company").alias("b"), F.col("role").alias("rb")).agg(F.count("*").alias("many"), F.min("num").alias("num"), F.min("status").alias("own"))
    # roles that name one opening share one of their rarest words, or are one text
    texts = asked.select(F.col("ra").alias("name")).union(held.select("rb")).where("name is not null").distinct().withColumn("words", F.array_distinct(titles.role_tokens(F.col("name"))))
    keys = _rarest(texts, lambda n: n - F.ceil(n * 0.6) + 1).union(texts.select("name", F.concat(F.lit("="), F.lower(F.trim("name")))))
    roles = keys.alias("x").join(keys.alias("y"), "w").select(F.col("x.name").alias("ra"), F.col("y.name").alias("rb"))
    roles = roles.join(asked.select("ra").distinct(), "ra", "left_semi").join(held.select("rb").distinct(), "rb", "left_semi").distinct()
    side = lambda n: texts.select(F.col("name").alias(f"r{n}"), F.col("words").alias(f"t{n}"), titles.seniority_words(F.col("name")).alias(f"s{n}"))
    c = F.col
    roles = roles.join(side("a"), "ra").join(side("b"), "rb").where(titles.same_role(c("ra"), c("rb"), c("ta"), c("tb"), c("sa"), c("sb"))).select("ra", "rb")
    fits = asked.join(firms, "a").join(roles, "ra").join(held, ["b", "rb"]).groupBy("a", "ra").agg(F.sum("many").alias("n"), F.min("num").alias("hit"), F.min("own").alias("own"), F.max("similarity").alias("s"))
    found = free.join(fits, (free["company"] == fits["a"]) & (free["role"] == fits["ra"]), "left")
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    fuzzy = found.select("interview_id", "round", F.when(one, F.col("hit")).alias("num"), F.when(one, F.col("own")).alias("own"), F.coalesce(F.when(one, F.round("s", 3)).otherwise(F.col("s")), F.lit(0.0)).alias("confidence"), F.when(one, "fuzzy").otherwise("unmatched").alias("method"))
    both = named.union(fuzzy)
    table = F.create_map(*[F.lit(x) for kv in ROUNDS.items() for x in kv])
    says = F.coalesce(F.element_at(table, F.lower(F.trim(F.replace(F.coalesce("round", F.lit("")), F.lit("**"), F.lit(""))))), F.lit("Interview"))
    place = lambda x: F.when(x.isin(*END_STATES), 100).otherwise(F.coalesce(*[F.when(x == st, n) for n, st in enumerate(OPEN_STATES)]))
    # an unknown state is earlier than an end, and no more is known of it
    own, theirs = F.coalesce(place(F.col("own")), F.when(place(says) == 100, -1)), place(says)
    later = F.when(F.col("own") == says, "ok").when(own.isNull() | (own == theirs), "review").otherwise("auto")
    action = F.when(F.col("num").isNull(), "unmatched").otherwise(later)
    return both.select("interview_id", "num", "method", "confidence", action.alias("action"), F.when(action == "auto", F.when(own > theirs, F.col("own")).otherwise(says)).alias("suggested"))


def same_openings(rows: DataFrame) -> DataFrame:
    """company_key, a, b: pairs of distinct titles of a company that name one opening (a < b).

    Titles that match share three words of five, so they share one of the rarest words of each: in an order of all
    words, telling ones first and rare ones before frequent ones, only a title's first n - ceil(0.6 n) + 1 words join.
    Titles of one text but for case join by that text.
    """
    t = rows.select("company_key", "title").where("company_key <> ''").distinct()
    t = t.select("*", F.array_distinct(titles.role_tokens(F.col("title"))).alias("t"), titles.seniority_words(F.col("title")).alias("s"))
    each = t.select("company_key", "title", F.explode("t").alias("w"))
    often = each.groupBy("w").agg(F.count("*").alias("often"))
    ranked = each.join(often, "w").groupBy("company_key", "title").agg(F.array_sort(F.collect_list(F.struct(F.col("w").isin(*titles.BASELINE).alias("common"), "often", "w"))).alias("r"))
    rare = ranked.select("company_key", "title", F.explode(F.slice("r", F.lit(1), (F.size("r") - F.ceil(F.size("r") * 0.6) + 1).cast("int"))).alias("x")).where("not x.common").select("company_key", "title", F.col("x.w").alias("w"))
    words = rare.union(t.select("company_key", "title", F.concat(F.lit("="), F.lower(F.trim("title")))))
    near = words.alias("x").join(words.alias("y"), (F.col("x.company_key") == F.col("y.company_key")) & (F.col("x.w") == F.col("y.w")) & (F.col("x.title") < F.col("y.title")))
    near = near.select(F.col("x.company_key").alias("company_key"), F.col("x.title").alias("a"), F.col("y.title").alias("b")).distinct()
    one, two = (t.select("company_key", F.col("title").alias(n), F.col("t").alias(f"t{n}"), F.col("s").alias(f"s{n}")) for n in "ab")
    full = near.join(one, ["company_key", "a"]).join(two, ["company_key", "b"])
    c = F.col
    return full.where(titles.same_role(c("a"), c("b"), c("ta"), c("tb"), c("sa"), c("sb"))).select("company_key", "a", "b")


def reconcile_inbox(inbox: DataFrame, state: DataFrame, reports: DataFrame) -> DataFrame:
    """Pending inbox rows (url) with what the batch did: drop, keep, and whether its report exists.

    state: url, status, report; reports: report.
    """
    s = state.join(reports.select("report").distinct().withColumn("has", F.lit(True)), "report", "left")
    return inbox.join(s, "url", "left").select("id", "url", F.when(F.col("status").isin("completed", "skipped"), "drop").otherwise("keep").alias("action"), F.coalesce("has", F.lit(False)).alias("has_report"))


def backfill_url(applications: DataFrame, postings: DataFrame) -> DataFrame:
    """Num, url: the posting of the same company with the most shared role words, then the first.

    applications: num, company_key, role; postings: id, company_key, title, url. Roles and titles are compared once.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(words_only(F.col(c)), " "), lambda w: F.length(w) > 2))
    p = postings.where("coalesce(url, '') <> '' and company_key <> ''").groupBy("company_key", "title").agg(F.min(F.struct("id", "url")).alias("item"))
    r = applications.select("company_key", "role").distinct().withColumns({"group": F.col("company_key"), "words": F.array_sort(words("role"))})
    best = best_overlap(r, p.select(F.col("company_key").alias("group"), words("title").alias("words"), "item"))
    # a company with one title needs no word in common
    lone = p.groupBy(F.col("company_key").alias("group")).agg(F.count("*").alias("many"), F.min("item").alias("only")).where("many = 1").select("group", "only")
    urls = r.join(best.select("group", "words", "item"), ["group", "words"], "left").join(lone, "group", "left").select("company_key", "role", F.coalesce("item", "only")["url"].alias("url")).where("url is not null")
    return applications.join(urls, ["company_key", "role"]).select("num", "url")


def findings(applications: DataFrame, reports: DataFrame, ledger: DataFrame, valid: Column) -> DataFrame:
    """Kind, key of what does not fit: missing and orphan reports, orphan ledger numbers, repeated numbers,
    repeated company and role, unknown states, malformed scores."""
    say = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"))
    a, named = applications, applications.where("report <> ''")
    return (
        say(named.join(reports, "report", "left_anti"), "missing report", "num")
        .union(say(reports.join(named, "report", "left_anti"), "orphan report", "report"))
        .union(say(ledger.select("num").distinct().join(a, "num", "left_anti"), "orphan ledger number", "num"))
        .union(say(a.groupBy("num").count().where("count > 1"), "duplicate number", "num"))
        .union(say(a.groupBy("company_key", "role").agg(F.count("*").alias("n"), F.min("num").alias("num")).where("n > 1"), "duplicate company and role", "num"))
        .union(say(a.where(~F.coalesce(valid, F.lit(False))), "unknown state", "num"))
        .union(say(a.where(F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 5)), "malformed score", "num"))
    )


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Id, state (new, unchanged, missing) between two complete runs' ids."""
    b, a = before.select("id").distinct().withColumn("b", F.lit(1)), after.select("id").distinct().withColumn("a", F.lit(1))
    return b.join(a, "id", "full_outer").select("id", F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "missing").otherwise("unchanged").alias("state"))


def snapshot_diff(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """Id, state, changed (names of fields that differ) of the rows of the later snapshot."""
    b = before.select("id", F.struct(*fields).alias("old"))
    joined = after.join(b, "id", "left")
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"old.{f}")), f) for f in fields]))
    return joined.select("id", F.when(F.col("old").isNull(), "NEW").when(F.size(changed) > 0, "CHANGED").otherwise("UNCHANGED").alias("state"), F.when(F.col("old").isNull(), F.array().cast("array<string>")).otherwise(changed).alias("changed"))


def upsert_store(store: DataFrame, batch: DataFrame, day: Column, cap: int = 10) -> DataFrame:
    """The store after a batch, with state added, updated or unchanged.

    store: id, url, urls, first_seen, last_seen, seen, lifecycle, closed; batch: id, url. A posting goes to the
    record of its id, else to the one that holds its URL, else it is new. Copies in a batch count once each.
    """
    urls = store.select(F.col("id").alias("owner"), F.explode("urls").alias("url")).groupBy("url").agg(F.min("owner").alias("owner"))
    b = batch.join(store.select(F.col("id").alias("same")), F.col("id") == F.col("same"), "left").join(urls, "url", "left")
    b = b.groupBy(F.coalesce("same", "owner", "id").alias("id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("url")).alias("new_urls"))
    joined = store.join(b, "id", "full_outer")
    seen = F.col("n").isNotNull()
    return joined.select(
        "id", F.slice(F.array_union(F.coalesce("urls", F.array().cast("array<string>")), F.coalesce("new_urls", F.array().cast("array<string>"))), 1, cap).alias("urls"),
        F.coalesce("first_seen", day).alias("first_seen"), F.when(seen, day).otherwise(F.col("last_seen")).alias("last_seen"), (F.coalesce("seen", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("seen"),
        F.when(F.coalesce("closed", F.lit(False)), "closed").when(seen, "active").otherwise(F.col("lifecycle")).alias("lifecycle"),
        F.when(F.col("first_seen").isNull(), "added").when(seen, "updated").otherwise("unchanged").alias("state"),
    )


def reuse_documents(a: DataFrame, b: DataFrame, high: float = 0.72, low: float = 0.45) -> DataFrame:
    """Id, other, similarity, action for the best other document by shared distinct words (ties: smaller).

    a, b: id, level, words (array). Other levels force a new document. Rows without a word in common with any are left out.
    """
    group = F.lit("").alias("group")
    best = best_overlap(a.select(group, "words"), b.select(group, "words", F.struct(F.col("id").alias("other"), F.col("level").alias("other_level")).alias("item")), jaccard=True)
    rows = a.select("id", "level", F.array_sort("words").alias("words")).join(best, "words")
    action = F.when(F.col("level") != F.col("item.other_level"), "regenerate").when(F.col("score") >= high, "reuse").when(F.col("score") >= low, "adapt").otherwise("regenerate")
    return rows.select("id", "item.other", F.col("score").alias("similarity"), action.alias("action"))


def verify_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """claim_id, bucket: confirmed (a source has the number and two context words), number-only, context-only,
    unsupported. claims: claim_id, number, words; sources: source_id, numbers, words.

    A source confirms a claim if it has the number with two of the claim's words, so claims and sources never meet: the
    pairs of words that a number has in some source do, each once, of the words that claims of the number have.
    """
    s = sources.select("source_id", "words", F.explode(F.array_distinct("numbers")).alias("number"))
    told = claims.select("number", F.explode("words").alias("w")).distinct()
    have = s.select("source_id", "number", F.explode("words").alias("w")).join(told, ["number", "w"], "left_semi").groupBy("source_id", "number").agg(F.array_sort(F.collect_set("w")).alias("words"))
    # equal sets of a number are one
    have = have.select("number", "words").distinct()
    two = lambda df, *more: df.select(*more, "number", F.posexplode("words").alias("i", "a"), "words").select(*more, "number", "a", F.explode(F.slice("words", F.col("i") + 2, F.greatest(F.size("words"), F.lit(1)))).alias("b"))
    pairs = two(have).distinct()
    own = claims.select("claim_id", "number", F.array_sort(F.array_distinct("words")).alias("words"))
    sure = two(own, "claim_id").join(pairs, ["number", "a", "b"], "left_semi").select("claim_id").distinct().withColumn("sure", F.lit(True))
    known = claims.select("claim_id", "number").join(s.select("number").distinct(), "number", "left_semi").select("claim_id").distinct().withColumn("known", F.lit(True))
    every = sources.select(F.explode("words").alias("w")).distinct()
    context = claims.select("claim_id", F.explode("words").alias("w")).join(every, "w").groupBy("claim_id").agg(F.count("*").alias("context"))
    out = claims.select("claim_id").join(sure, "claim_id", "left").join(known, "claim_id", "left").join(context, "claim_id", "left")
    return out.select("claim_id", F.when(F.col("sure"), "confirmed").when(F.col("known"), "number-only").when(F.col("context") >= 2, "context-only").otherwise("unsupported").alias("bucket"))


def undiscovered(found: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Found companies (id, name_key, careers, api) that no key of the portfolio holds, first of each name."""
    out = found
    for key in ("name_key", "careers", "api"):
        out = out.join(portfolio.select(key).where(f"coalesce({key}, '') <> ''").distinct(), key, "left_anti")
    return out.groupBy("name_key").agg(F.min("id").alias("id"))


def seed_followups(applications: DataFrame, followups: DataFrame, pins: DataFrame, days: int = 7) -> DataFrame:
    """Num, due: first due day of open applications that have neither a follow-up nor a pin."""
    open_ = applications.where(F.col("status").isin("Applied", "Responded", "Interview"))
    bare = open_.join(followups.select("num").distinct(), "num", "left_anti").join(pins.select("num").distinct(), "num", "left_anti")
    return bare.select("num", F.date_add("applied", days).alias("due"))
