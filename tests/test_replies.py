"""Replies meet every application that they name, against a plain scan of all pairs."""

import random
import re

from joblode.operators import joins


def plain(replies, tracked):
    out = []
    for message, sender, text in replies:
        lower, found = (text or "").lower(), {}
        site = re.search(r"@(?:[^@]*\.)?([^.@]+)\.[^.@]+$", sender or "")
        site = site[1].lower() if site else ""
        for num, company, role in tracked:
            if not company or not re.search(r"[^\W_]", company):
                continue
            base = 2.0 * (company.lower() in lower) + 2.0 * (site != "" and site in company.lower())
            if base:
                found.setdefault(base + 1.5 * (role is not None and role.lower() in lower), []).append(num)
        best = max(found, default=0.0)
        out.append((message, found[best][0] if len(found.get(best, ())) == 1 else None, best))
    return out


def check(spark, replies, tracked):
    got = joins.reply_matches(spark.createDataFrame(replies, "message_id long, sender string, text string"), spark.createDataFrame(tracked, "num long, company string, role string"))
    assert sorted(map(tuple, got.collect())) == plain(replies, tracked)


def test_names_meet_at_any_place(spark):
    """only replies with the first telling word of a name met it."""
    tracked = [(1, "Wayne Enterprises", "Chief"), (2, "The Group", "Cook"), (3, "Acme", "Data Engineer"), (4, "HP", "Boss"), (5, "?", "x"), (6, "Ünïted 株式会社", None), (7, "Three\nLines", ""), (8, "", "y"), (9, None, "z"), (10, "👍X", "q")]
    replies = [(1, "hr@wayne.org", "hello?"), (2, "a@b.c", "A cook at the group"), (3, "a@b.c", "from acmecorp: DATA ENGINEER"), (4, "x@hp.com", None), (5, "a@nterpr.co", "x"), (6, "", "we are ÜNÏTED 株式会社"), (7, None, "three\nlines"), (8, "a@b.c", "say 👍x"), (9, "a@b.c", "hp and acme"), (10, "a@b.c", "")]
    check(spark, replies, tracked)
    got = {m: (num, points) for m, num, points in plain(replies, tracked)}
    assert got == {1: (1, 2.0), 2: (2, 3.5), 3: (3, 3.5), 4: (4, 2.0), 5: (1, 2.0), 6: (6, 2.0), 7: (7, 3.5), 8: (10, 2.0), 9: (None, 2.0), 10: (None, 0.0)}


def test_random_names_and_replies(spark):
    rng = random.Random(8)
    text = lambda least, most, letters="aab c.-é?": "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
    tracked = [(i, text(0, 5), rng.choice([text(0, 4), None])) for i in range(60)]
    replies = [(i, f"{text(0, 3)}@{text(0, 2)}{text(0, 3, 'abc')}.{text(0, 2, 'ab')}", rng.choice([text(0, 12), None])) for i in range(300)]
    check(spark, replies, tracked)
    parts, wholes = ({x for _, x, _ in tracked if x}, {x for _, _, x in replies if x})
    got = joins.contained(spark.createDataFrame([(x,) for x in parts], "part string"), spark.createDataFrame([(x,) for x in wholes], "whole string")).collect()
    assert sorted(map(tuple, got)) == sorted((p, w) for p in parts for w in wholes if p in w)
