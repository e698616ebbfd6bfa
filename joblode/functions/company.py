"""Employer identity keys and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblode.functions.text import once, words_only

#: Legal and generic last words of company names.
SUFFIXES = (
    "incorporated", "corporation", "technologies", "technology", "solutions", "services", "systems", "labs", "studio", "ventures", "capital",
    "partners", "group", "holdings", "company", "limited", "inc", "corp", "llc", "ltd", "plc", "gmbh", "pty", "bv", "sas", "ab",
)
#: Plural and singular forms that name one company.
STEMS = {"technologies": "technology", "solutions": "solution", "services": "service", "systems": "system", "labs": "lab", "ventures": "venture", "partners": "partner", "holdings": "holding"}
#: Abbreviations and their companies.
ABBREVIATIONS = {
    "ibm": "international business machines", "hp": "hewlett packard", "hpe": "hewlett packard enterprise", "jpmc": "jpmorgan chase",
    "jpmorgan": "jpmorgan chase", "bny": "bny mellon", "amzn": "amazon", "msft": "microsoft", "goog": "google",
}
#: Job boards, which are never the employer.
BOARDS = ("dice", "linkedin", "indeed", "ziprecruiter", "careerbuilder", "monster", "benchinfo", "techfetch", "solidjobs", "glassdoor", "simplyhired")
#: Names without an employer behind them.
GENERIC = ("unknown", "confidential", "confidential company", "stealth", "stealth startup", "stealth mode startup", "staffing agency", "multiple companies", "private employer", "undisclosed")
#: What stands in the spaced words of a staffing company's name.
STAFFING = (
    "staffing", " talent solutions ", " talent group ", " talent acquisition firm ", " consulting firm ", " consulting group ", " consulting services ", " employment agency ", " headhunter ", " job consultancy ", " job placement ",
    " staff aug ", " staff solutions ", " staff firm ", " staff agency ", " tekpartners ", " teksystems ", " randstad ", " adecco ", " manpower ", " hays ", " kelly services ", " insight global ", " modis ", " apex systems ", " kforce ",
    " robert half ", " aerotek ", " actalent ", " aston carter ", " motion recruitment ", " diverse lynx ", " collabera ", " artech ", " syntel ", " ustech ",
)


def mapped(c: Column, table: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(m, c), c)


#: A closing "S.A.", then one or two closing words of SUFFIXES behind another word.
_CLOSING = (r"(^| )(sa|s a)$", r"(?<=\S)( (" + "|".join(SUFFIXES) + r")){1,2}$")


def company_key(c: Column, normal=lambda x: x) -> Column:
    """Identity key of an employer; empty without usable words.

    normal: NFKC where names may need it (joblode.functions.text.nfkc). Of the words of a name, what stands in
    parentheses goes, a closing "Co." or "S.A." too, then up to two closing words of SUFFIXES as long as a word is left;
    words take the form of STEMS, whole names that of ABBREVIATIONS.
    """
    raw = F.replace(F.trim(F.lower(normal(F.coalesce(c, F.lit(""))))), F.lit("&"), F.lit(" and "))
    words = words_only(F.regexp_replace(raw, r"\([^)]*\)|\bco\.$", " "))
    for closing in _CLOSING:
        words = F.regexp_replace(words, closing, "")
    return once(F.array_join(F.transform(F.split(words, " "), lambda w: mapped(w, STEMS)), " "), lambda k: mapped(k, ABBREVIATIONS))


def loose_company_key(c: Column) -> Column:
    """All trailing legal words go, then one generic word."""
    s = words_only(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(s, r"^(.+?)( (inc|incorporated|llc|ltd|limited|corp|corporation|co|company|plc|gmbh|ag|sa|bv|nv|pty|oy|ab|as))+$", "$1")
    return F.regexp_replace(s, r"^(.+) (group|holdings|technologies|technology|solutions|labs|software|systems|services|international|global)$", "$1")


def is_board(key: Column) -> Column:
    names = [x for b in BOARDS for x in (b, f"{b} employer", f"{b} jobs", f"{b} job")]
    return (key == "") | key.isin(names)


def is_staffing(name: Column) -> Column:
    words = F.concat(F.lit(" "), words_only(F.coalesce(name, F.lit(""))), F.lit(" "))
    # recruiting is another's business unless the name goes on to say whose
    rest = F.when(F.contains(words, F.lit("recruiting")), F.substring_index(words, "recruiting", -1))
    own = F.contains(rest, F.lit(" internal ")) | F.contains(rest, F.lit(" in house "))
    return reduce(lambda a, b: a | b, (F.contains(words, F.lit(p)) for p in STAFFING)) | ~F.coalesce(own, F.lit(True))


def is_generic(key: Column) -> Column:
    return (key == "") | key.isin(*GENERIC)
