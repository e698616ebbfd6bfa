"""Phrases in one pass, and the page and mail rules that read them."""

import random

from pyspark.sql import functions as F

from joblode.functions import company, misc, phrases, place, web


def test_hits_match_plain_search(spark):
    rnd = random.Random(2)
    tables = {"a": ("ab", "abc", "b", "c a"), "w": ("ab", "ca"), "none": ()}
    texts = ["".join(rnd.choice("abc  é1") for _ in range(rnd.randint(0, 40))) for _ in range(80)] + ["", None, "ab" * 50]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", phrases.hits(F.col("t"), tables, ("w",)).alias("h")).collect()
    for r in got:
        t = texts[r.i] or ""
        lone = lambda a, b, t=t: not (a and t[a - 1].isalnum()) and not (b < len(t) and t[b].isalnum())
        want = [(k, p, a) for k, ps in tables.items() for p in ps for a in range(len(t)) if t.startswith(p, a) and (k != "w" or lone(a, a + len(p)))]
        assert sorted((h.kind, h.phrase, h.at) for h in r.h) == sorted(want)
        assert [h.at for h in r.h] == sorted(h.at for h in r.h)


def test_folding():
    assert phrases.plain("  Offre  Expirée\n l’offre “n’est PLUS” ") == 'offre expiree l\'offre "n\'est plus"'
    assert phrases.plain(None) == ""


LONG = " text" * 80
PAGES = [
    ("The job is no longer available" + LONG, "expired_body"), ("Jobs: this one is no longer open" + LONG, "expired_body"), ("The position you want has been filled." + LONG, "expired_body"),
    ("The job: once the application form has been filled you hear from us" + LONG, "no_apply_control"), ("the role card has been filled out by many" + LONG, "no_apply_control"), ("A role" + " x" * 40 + " has been filled" + LONG, "no_apply_control"),
    ("Applications are closed" + LONG, "expired_body"), ("Closed on 12 March" + LONG, "expired_body"), ("closed on Mar 3" + LONG, "expired_body"), ("closed on Monday" + LONG, "no_apply_control"),
    ("Diese Stelle ist bereits besetzt" + LONG, "expired_body"), ("Cette offre n’est plus disponible" + LONG, "expired_body"), ("Poste déjà pourvu" + LONG, "expired_body"), ("Recrutement terminé" + LONG, "expired_body"), ("Candidatures clôturées" + LONG, "expired_body"),
    ("Just a moment...", "bot_challenge"), ("Attention Required! | Cloudflare" + LONG, "bot_challenge"), ("Ray ID: 7" + LONG, "bot_challenge"), ("Cf-Ray: 7", "bot_challenge"), ("array idea" + LONG, "no_apply_control"),
    ("24 jobs found" + LONG, "listing_page"), ("no jobs found" + LONG, "no_apply_control"), ("short", "insufficient_content"), ("" + LONG, "no_apply_control"),
]


def test_closed_pages_in_several_languages(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(PAGES)], "i int, b string")
    got = {r.i: r.code for r in web.liveness(df, F.lit(200), F.lit("u"), F.lit("u"), F.col("b"), F.lit(None).cast("string")).collect()}
    assert [(PAGES[i][0][:50], got[i]) for i in got] == [(b[:50], c) for b, c in PAGES]
    controls = [("Apply now", "apply_control_visible"), ("Wyślij CV", "apply_control_visible"), ("Bewerben", "apply_control_visible"), ("applying", "no_apply_control"), ("Start application", "apply_control_visible")]
    df = spark.createDataFrame([(c,) for c, _ in controls], "c string")
    got = {r.c: r.code for r in web.liveness(df, F.lit(200), F.lit("u"), F.lit("u"), F.lit(LONG), F.col("c")).collect()}
    assert got == dict(controls)


def test_staffing_names_and_kinds_of_work(spark):
    names = {"Apex Staffing": True, "Kelly Services, Inc.": True, "TEKsystems": True, "Hays plc": True, "Acme Recruiting": True, "Recruiting (in-house) Acme": False, "Haystack": False, "Acme": False, "Talent Group LLC": True, "Consulting Firm X": True}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", company.is_staffing(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == names
    texts = {"Contractor, full-time": "contract", "Part-Time job": "part-time", "Internship": "internship", "full time": "full-time", "temporary": "", "temp role": "contract", "international": ""}
    rows = spark.createDataFrame([(n,) for n in texts], "n string").select("n", place.employment(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == texts


def test_mails_that_invite_or_reject(spark):
    mails = {
        "Thank you for interviewing with us. Unfortunately, we regret to inform you": ("rejection", "unfortunately,regret to inform", "weak"), "Unfortunately we need to move your interview": ("unknown", "", None),
        "We decided NOT to move forward": ("rejection", "decided not to move forward", "strong"), "you have not been selected to advance": ("rejection", "not been selected to advance,not been selected", "strong"),
        "We would like to invite you; unfortunately not on Monday": ("invite", "would like to invite you", None), "": ("unknown", "", None), None: ("unknown", "", None),
    }
    got = misc.mail_class(spark.createDataFrame([(m,) for m in mails], "m string"), "m").collect()
    assert {r.m: (r.classification, ",".join(r.matched), r.strength) for r in got} == mails
