"""Application states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The states in the order of their life cycle, and their aliases.
STATES = {
    "Evaluated": ("evaluated", "evaluada", "condicional", "hold", "evaluar", "verificar", "değerlendirildi", "degerlendirildi"),
    "Applied": ("applied", "aplicado", "enviada", "aplicada", "sent", "başvuruldu", "basvuruldu"),
    "Responded": ("responded", "respondido", "yanıt verildi", "yanit verildi"),
    "Interview": ("interview", "entrevista", "mülakat", "mulakat"),
    "Offer": ("offer", "oferta", "teklif"),
    "Hired": ("hired", "contratado", "contratada", "accepted", "accept", "kabul edildi"),
    "Rejected": ("rejected", "rechazado", "rechazada", "reddedildi"),
    "Discarded": ("discarded", "descartado", "descartada", "cerrada", "cancelada", "iptal edildi"),
    "SKIP": ("skip", "no aplicar", "no_aplicar", "monitor", "geo blocker", "geo_blocker", "uygun değil", "uygun degil"),
}
ALIASES = {alias: state for state, names in STATES.items() for alias in names}
#: Rank of a state in the funnel; closed states have none.
STAGES = {"Evaluated": 0, "Applied": 1, "Responded": 2, "Interview": 3, "Offer": 4, "Hired": 5}


def bare(raw: Column) -> Column:
    """Lower-cased text without bold markers and a trailing date."""
    s = F.trim(F.replace(F.coalesce(raw, F.lit("")), F.lit("**"), F.lit("")))
    return F.lower(F.trim(F.regexp_replace(s, r"\s+\d{4}(-\d{2}-\d{2}.*)?$", "")))


def canonical(raw: Column) -> tuple[Column, Column]:
    """P20: the state (null if unknown), and whether the text moves to the notes."""
    s = bare(raw)
    moved = s.rlike(r"^(duplicad|dup\b|repost)")
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.when(moved | s.isin("", "-", "—"), "Discarded").otherwise(F.element_at(table, s)), moved


def rank(state: Column) -> Column:
    out = None
    for name, r in STAGES.items():
        out = F.when(state == name, r) if out is None else out.when(state == name, r)
    return out.otherwise(-1)
