"""Funding news: who was funded, with how much, in which round.

A headline is read as a string of one letter a word, its class; what is said about whom is then a short pattern over
these letters, and a company is a run of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a headline by class.
CLASSES = {
    "r": ("raise", "raises"),
    "V": ("raised", "lands", "landed", "secure", "secures", "secured", "close", "closes", "closed", "nab", "nabs", "nabbed", "bag", "bags", "bagged"),
    "A": ("announce", "announces", "announced"),
    "G": ("gets", "got", "receive", "receives", "received"),
    "H": ("hit", "hits", "reach", "reaches", "reached"),
    "v": ("valued",), "y": ("at",), "E": ("emerge", "emerges"), "s": ("from",), "Z": ("stealth",), "i": ("in",), "L": ("talks",), "t": ("to",), "q": ("unicorn",), "w": ("status",),
    "U": ("billion", "million", "bn", "m", "k"),
    "a": ("a", "an"), "o": ("over",), "m": ("more",), "h": ("than",), "u": ("up",), "f": ("for",), "p": ("reportedly",), "I": ("ai",),
    "S": ("startup",), "C": ("company", "agency", "platform"),
    "F": ("funding", "financing"), "O": ("round", "seed", "pre-seed"), "Y": ("valuation",), "K": ("investment",), "R": ("series",), "l": ("b", "c", "d", "e", "f", "g", "h"),
    "c": ("cut", "cuts", "axes", "slashes", "eliminates", "sheds"), "e": ("of",), "j": ("its", "the", "their"), "P": ("%",),
    "W": ("jobs", "roles", "positions", "staff", "employees", "workers", "workforce", "headcount"), "B": ("fund",),
}
LETTERS = {word: letter for letter, words in CLASSES.items() for word in words}
_GOT, _SUM, _ABOUT = "[rV]", "M[Ul]?", "(?:a|o|mh|ut)?"
#: Who is named, in the order in which it is tried: the words before the name, then the name.
NAMED = (
    f"(.*?{_GOT}{_ABOUT}{_SUM}fa?I?S)(.+)$",  # raises $5M for startup X
    f"(.*?S)(.+?)p?{_GOT}",  # startup X raises
    "(.*?[SC])(.+?)Hqw.*r",  # company X hits unicorn status, raises
    f"()(.+?){_GOT}{_ABOUT}M",  # X raises $5M
    f"()(.+?){_GOT}a?.{{0,4}}?([FOYK]|R[al])",  # X closes a large seed round
    f"()(.+?)A({_SUM})?.{{0,4}}?([FO]|R[al])",  # X announces $5M in seed funding
    f"()(.+?)G({_SUM})?i?[FK]",  # X gets $5M in funding
    f"()(.+?)Ha?{_SUM}Y",  # X hits $1B valuation
    "()(.+?)vyM",  # X valued at $1B
    "()(.+?)EsZ",  # X emerges from stealth
    "()(.+?)iLtr",  # X in talks to raise
)
#: A share or number of the staff goes; a fund is raised.
STAFF_CUT, FUND_RAISED = "c#P?e?j?W", "rM[Ul]?B"
#: Words and phrases that speak of funding.
FUNDING = (
    "funding", "funded", "raise", "raises", "raised", *(f"series {x}" for x in "abcdefgh"), "seed round", "pre seed", "venture round", "investment", "financing", "valuation", "valued at", "land", "lands", "landed",
    "secure", "secures", "secured", "close", "closes", "closed", "nab", "nabs", "nabbed", "bag", "bags", "bagged", "emerge from stealth", "emerges from stealth", "in talks to raise",
)
#: Words and phrases of news about other money.
OTHER_NEWS = (
    "acquire", "acquires", "acquired", "acquisition", "merger", "spac", "ipo", "bankruptcy", "layoff", "layoffs", "earnings", "quarterly results", "lay off", "lays off", "laying off", "laid off", "job cuts",
    *(f"{x} reduction{s}" for x in ("workforce", "headcount", "staff") for s in ("", "s")), "public offering", "registered direct offering", "private placement", "atm offering", "offering of common stock",
    "venture fund", "vc fund", "investment fund", "private equity fund", "capital fund", "fund ii", "fund iii", "fund iv", "new fund", "grant", "grants", "scholarship", "scholarships", "award", "awards", "donation", "donate", "donates",
    "how to raise", "ways to raise", "guide to fundraising", "startup valuations", "bubble fears",
)
#: How threads of a forum begin that are no news, and beginnings that say nothing.
THREADS = ("ask hn", "tell hn", "who is hiring", "launch hn")
OPENERS = ("Show HN:", "Ask HN:")
#: Publishers named behind a headline.
PUBLISHERS = ("TechCrunch", "Crunchbase", "Forbes", "Reuters", "Bloomberg", "BusinessWire", "PR Newswire", "SiliconANGLE", "VentureBeat", "The Guardian")
#: Sectors before "startup", "company" or "platform" and a name.
SECTORS = ("ai", "genai", "agentic", "coding", "developer", "tools", "data", "security", "fintech", "startup", "software", "robotics", "defense", "healthcare", "biotech", "open-source", "enterprise", "infrastructure", "crypto", "climate")
KINDS = ("startup", "company", "platform")
#: Names of nobody.
NOBODY = (
    "ai", "startup", "startups", "company", "companies", "founder", "founders", "developer", "developers", "edtech platform", "fintech platform", "healthcare platform", "security platform", "techcrunch", "pr newswire",
    "business wire", "globenewswire", "crunchbase", "hacker news", "valuation", "valuations", "bubble", "fears", "funding", "fund", "round",
    *(f"{s} {k}" for s in ("ai", "genai", "agentic", "edtech", "fintech", "security", "healthcare", "biotech", "robotics", "climate", "crypto", "developer tool", "developer tools") for k in KINDS),
)
#: Words that no company's name has.
MARKET = ("valuation", "valuations", "bubble", "fears", "earnings", "fund")
#: Rounds, and sources whose headlines are checked by an editor.
ROUNDS = ("pre seed", "seed", *(f"series {x}" for x in "abcdefgh"), "strategic", "venture", "growth")
SURE_SOURCES = ("techcrunch", "prnewswire", "guardian")
#: Units of money.
UNITS = {"k": 1e3, "m": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9}
#: What is no part of a word at its ends.
EDGES = ",;:!?.()\"'`"
MONEY = r"^\$[0-9.,]+(billion|million|bn|[bkmt])?$"
AMOUNT = r"\$([0-9,.]*[0-9])\s*(billion|million|bn|[mbk])?"


def _letters(words: Column) -> Column:
    """A letter for each word."""
    table = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    bare = lambda w: F.btrim(F.lower(w), F.lit(EDGES))
    of = lambda w: F.coalesce(F.element_at(table, bare(w)), F.when(bare(w).rlike(MONEY), "M").when(bare(w).rlike("^[0-9][0-9,.]*%?$"), "#").otherwise("n"))
    return F.array_join(F.transform(words, of), "")


def _from(words: Column, first: Column) -> Column:
    return F.slice(words, first + 1, F.greatest(F.size(words), F.lit(1)))


def _position(words: Column, test) -> Column:
    """The place (from 0) of the first word that fits, else null."""
    return F.get(F.filter(F.transform(words, lambda w, i: F.when(test(w, i), i)), lambda i: i.isNotNull()), F.lit(0))


def _spaced(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def _any(text: Column, phrases) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, F.concat(F.lit(" "), p, F.lit(" "))))


def company_names(df: DataFrame, words: str) -> DataFrame:
    """df with name: the company that a run of a headline's words means, empty if it means none."""
    low = lambda c: F.transform(c, lambda w: F.lower(w))
    text = F.btrim(F.array_join(words, " "), F.lit("\"'`"))
    text = F.trim(F.substring_index(F.regexp_replace(F.regexp_replace(text, "['’][sS]$", ""), r" *\([^()]*\)$", ""), ",", 1))
    df = df.withColumn("_w", F.filter(F.split(text, " "), lambda w: w != ""))
    # what follows "startup" is the name; a company's or startup's owner is not
    last = F.size("_w") - 1
    df = df.withColumn("_w", _from(F.col("_w"), F.coalesce(_position(F.col("_w"), lambda w, i: (F.lower(w) == "startup") & (i < last)) + 1, F.lit(0))))
    owner = _position(F.col("_w"), lambda w, i: F.lower(w).rlike("['’]s$"))
    owned = F.exists(F.transform("_w", lambda w, i: F.lower(w).isin("company", "startup") & (i > owner)), lambda x: x)
    df = df.withColumn("_w", F.when(F.coalesce(owned, F.lit(False)), F.array().cast("array<string>")).otherwise(F.col("_w")))
    tail = F.array_join(F.slice(low(F.col("_w")), F.greatest(F.size("_w") - 2, F.lit(1)), 3), " ")
    df = df.withColumn("_w", F.when((F.size("_w") > 3) & (tail == "in talks to"), F.slice("_w", 1, F.greatest(F.size("_w") - 3, F.lit(0)))).when((F.size("_w") > 1) & (F.lower(F.element_at("_w", -1)) == "reportedly"), F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0)))).otherwise(F.col("_w")))
    n = F.size("_w")
    defies = _position(F.col("_w"), lambda w, i: (F.lower(w) == "defies") & (i > 0) & (i < n - 1))
    df = df.withColumn("_w", F.slice("_w", 1, F.coalesce(defies, n)))
    backed = (F.size("_w") > 1) & F.get("_w", F.lit(0)).rlike("^[A-Z][A-Za-z0-9&.-]+-[bB]acked$")
    df = df.withColumn("_w", F.when(backed, _from(F.col("_w"), F.lit(1))).otherwise(F.col("_w")))
    n = F.size("_w")
    makes = _position(F.col("_w"), lambda w, i: F.lower(w).isin("maker", "creator") & (F.lower(F.get("_w", i + 1)) == "of") & (i < n - 2))
    df = df.withColumn("_w", F.slice("_w", 1, F.coalesce(makes, n)))
    # the sectors of a startup, company or platform go before its name
    kinds = F.array_join(F.transform("_w", lambda w: F.when(F.lower(w) == "the", "d").when(F.lower(w).isin(*KINDS), F.when(F.lower(w).isin(*SECTORS), "b").otherwise("k")).when(F.lower(w).isin(*SECTORS), "z").otherwise("n")), "")
    df = df.withColumn("_w", _from(F.col("_w"), F.length(F.regexp_extract(kinds, "^(d?[zb]+[kb]).", 1))))
    n = F.size("_w")
    maker = F.array_max(F.filter(F.transform("_w", lambda w, i: F.when((F.lower(w) == "maker") & (i > 0) & (i < n - 1), i)), lambda i: i.isNotNull()))
    df = df.withColumn("_w", _from(F.col("_w"), F.coalesce(maker + 1, F.lit(0))))
    df = df.withColumn("_w", _from(F.col("_w"), F.when((F.size("_w") > 1) & F.lower(F.get("_w", F.lit(0))).isin(*KINDS), 1).otherwise(0)))
    df = df.withColumn("name", F.array_join("_w", " "))
    none = ~F.length("name").between(2, 70) | F.col("name").rlike("[<>]") | F.lower("name").isin(*NOBODY) | _any(_spaced(F.col("name")), MARKET) | ~F.col("name").rlike("[A-Za-z0-9]")
    return df.withColumn("name", F.when(none, "").otherwise(F.col("name"))).drop("_w")


def funding(df: DataFrame, headline: str, source: str) -> DataFrame:
    """Df with company, amount, round and confidence of a funding headline; an empty company if it is none.

    Confidence is high if the source is sure and an amount or round is named, medium with one of both, else low. A null
    headline names nobody; columns of the result's names are replaced.
    """
    h = F.trim(F.regexp_replace(F.coalesce(F.col(headline), F.lit("")), r"\s+", " "))
    cut = F.regexp_replace(F.substring_index(h, " | ", 1), "(?i) - (" + "|".join(PUBLISHERS) + ").*$", "")
    df = df.withColumns({"_all": _spaced(h), "_h": F.regexp_replace(cut, "(?i)^(" + "|".join(OPENERS) + ") *", "")})
    df = df.withColumn("_t", F.split("_h", " ")).withColumn("_c", _letters(F.col("_t")))
    found = F.coalesce(*[F.when(F.col("_c").rlike(f"^{p}"), F.struct(F.length(F.regexp_extract("_c", f"^{p}", 1)).alias("at"), F.length(F.regexp_extract("_c", f"^{p}", 2)).alias("n"))) for p in NAMED])
    df = df.withColumn("_r", found).withColumn("_n", F.coalesce(F.slice("_t", F.col("_r.at") + 1, F.greatest(F.col("_r.n"), F.lit(0))), F.array().cast("array<string>")))
    df = company_names(df, "_n")
    thread = F.lower("_h").rlike("^(" + "|".join(THREADS) + ")([^a-z0-9]|$)")
    other = _any(F.col("_all"), OTHER_NEWS) | F.col("_c").rlike(STAFF_CUT) | F.col("_c").rlike(FUND_RAISED) | ~_any(F.col("_all"), FUNDING)
    df = df.withColumn("name", F.when(thread | other, "").otherwise(F.col("name")))
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    scale = F.coalesce(F.element_at(unit, F.lower(F.regexp_extract(h, f"(?i){AMOUNT}", 2))), F.lit(1.0))
    amount = F.replace(F.regexp_extract(h, f"(?i){AMOUNT}", 1), F.lit(","), F.lit("")).try_cast("double") * scale
    first = F.array_min(F.transform(F.filter(F.array(*map(F.lit, ROUNDS)), lambda p: F.contains(F.col("_all"), F.concat(F.lit(" "), p, F.lit(" ")))), lambda p: F.struct(F.instr(F.col("_all"), F.concat(F.lit(" "), p, F.lit(" "))).alias("at"), p.alias("p"))))
    stage = F.coalesce(F.when(first["p"] == "pre seed", "pre-seed").otherwise(first["p"]), F.lit(""))
    df = df.withColumns({"_a": amount, "_s": stage})
    sure, told, named = F.col(source).isin(*SURE_SOURCES), F.col("_a").isNotNull() | (F.col("_s") != ""), F.col("name") != ""
    trust = F.when(sure & told, "high").when(sure | told, "medium").otherwise("low")
    out = {"company": F.col("name"), "amount": F.when(named, F.col("_a")), "round": F.when(named, F.col("_s")).otherwise(""), "confidence": F.when(named, trust).otherwise("")}
    return df.withColumns(out).drop("_all", "_h", "_t", "_c", "_r", "_n", "_a", "_s", "name")
