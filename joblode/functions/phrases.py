"""Phrases of several tables, found in one pass over a text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Quotes of all kinds and their plain form.
QUOTES = {"‘": "'", "’": "'", "ʼ": "'", "′": "'", "´": "'", "`": "'", "“": '"', "”": '"', "″": '"'}
_PLAIN = str.maketrans(QUOTES)

_HITS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("at", T.IntegerType())]))


def plain(text: str | None) -> str:
    """Lower case without accents, one space between words, plain quotes."""
    text = unicodedata.normalize("NFD", (text or "").translate(_PLAIN)).lower()
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


@F.pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    """plain() of each text; Spark SQL has no function that takes letters and accents apart."""
    return s.map(plain)


@lru_cache(8)
def _automaton(tables: tuple[tuple[str, tuple[str, ...]], ...]):
    import ahocorasick

    found: dict[str, list[str]] = {}
    for kind, phrases in tables:
        for p in phrases:
            found.setdefault(p, []).append(kind)
    trie = ahocorasick.Automaton()
    for p, kinds in found.items():
        trie.add_word(p, (p, tuple(kinds)))
    trie.make_automaton()
    return trie


def hits(text: Column, tables: dict[str, tuple[str, ...]], whole: tuple[str, ...] = ()) -> Column:
    """kind, phrase, at (from 0, in characters) of each phrase of the tables (kind: phrases) in a text, in text order.

    A trie with failure links over all phrases reads a text once. Texts are compared as they are: fold them first.
    Phrases of the kinds in ``whole`` count only between characters that are neither letters nor digits. A null text
    has none.
    """
    known = tuple((k, tuple(v)) for k, v in tables.items() if v)

    @F.pandas_udf(_HITS)
    def scan(s: pd.Series) -> pd.Series:
        trie = _automaton(known)

        def of(x: str | None) -> list[dict]:
            out = []
            for end, (phrase, kinds) in trie.iter(x) if x else ():
                at = end - len(phrase) + 1
                lone = not (at and x[at - 1].isalnum()) and not (end + 1 < len(x) and x[end + 1].isalnum())
                out += [{"kind": k, "phrase": phrase, "at": at} for k in kinds if lone or k not in whole]
            return sorted(out, key=lambda h: h["at"])

        return s.map(of)

    return scan(text)


def of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda h: h["kind"] == kind)


def any_of_kind(found: Column, kind: str) -> Column:
    return F.exists(found, lambda h: h["kind"] == kind)
