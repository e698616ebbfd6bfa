"""Text keys and cleaning."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; Spark SQL has no function for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _fold(x: str | None) -> str | None:
    if x is None:
        return None
    # fixed values: Latin letters that don't decompose
    x = x.translate(str.maketrans({"ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ı": "i"}))
    return "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def ascii_letters(s: pd.Series) -> pd.Series:
    return s.map(_fold)


@F.pandas_udf(T.StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """Character references decoded."""
    return s.map(lambda x: None if x is None else html.unescape(x))


def once(value: Column, then) -> Column:
    """then(value), with the value computed once however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def words_only(c: Column, gap: str = " ") -> Column:
    """Lower case; runs of other than letters, marks and digits become one gap."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", gap))


def text_key(c: Column, gap: str = " ") -> Column:
    """Comparison key of any text; a dotted capital I loses its dot."""
    return words_only(F.regexp_replace(F.lower(nfkc(c)), "̇", ""), gap)


def ascii_fold(c: Column, punctuation: str = "space") -> Column:
    """Lower-cased ASCII words; punctuation becomes a space or goes."""
    folded = F.lower(ascii_letters(c))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^a-z0-9\s]", " " if punctuation == "space" else ""), r"\s+", " "))


def html_text(c: Column, limit: int = 4000) -> Column:
    """Text of a posting's markup, decoded twice, at most ``limit`` characters."""
    for _ in range(2):
        c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
        c = F.regexp_replace(c, r"<[^>]*>", " ")
        c = unescaped(c)
    return F.substring(F.trim(F.regexp_replace(c, r"[\s ]+", " ")), 1, limit)


def description_key(c: Column) -> Column:
    """A description without markup, campaign parameters and invisible characters."""
    c = F.regexp_replace(F.lower(c), r"<[^>]*>", " ")
    c = F.regexp_replace(c, r"[?&](utm_[a-z]+|ref|source)=[^\s&\"']*", "")
    c = F.regexp_replace(c, "[​-‍﻿]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-cased tokens of letters, digits, plus and hash, at least two characters long."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9+#]+"), lambda t: F.length(t) > 1)


def any_of(c: Column, phrases) -> Column:
    """Whether the lower-cased text holds any of the phrases (false for none)."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(F.lower(c), F.lit(p.lower()))
    return found


def anchored(*keywords: str) -> str:
    """A pattern that finds one of the keywords between other than letters and digits (no look-around needed)."""
    special = set(r"\.^$*+?{}[]|()-#&~")
    quoted = ["".join("\\" + x if x in special else x for x in k) for k in keywords]
    return "(^|[^a-z0-9])" + (quoted[0] if len(quoted) == 1 else "(" + "|".join(quoted) + ")") + "([^a-z0-9]|$)"


def any_anchored(c: Column, keywords) -> Column:
    return F.lower(c).rlike(anchored(*keywords)) if keywords else F.lit(False)
