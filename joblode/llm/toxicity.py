"""Toxicity: a linear classifier on word presence, regularised by identity-term swaps.

Each labelled sentence that names an identity group is paired with the same sentence naming another group of its
kind; the loss adds the squared difference of the two scores, so a neutral mention does not raise the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm._words import Text, Words, mixed, powers, slices

#: Labelled rows that the fit may use: those with the least hash of doc_id.
SAMPLE = 12_000
BITS = 22
FEATURES = 6000
LEAST_ROWS = 4
THRESHOLD = 0.3
SWAP_WEIGHT = 4.0
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (5, 6, 7)
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Groups of identity terms that may stand for each other in a sentence.
IDENTITIES = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male", "nonbinary", "transgender"),
    ("gay", "straight", "lesbian", "bisexual", "queer"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino", "arab"),
    ("african", "european", "american", "mexican", "chinese", "indian"), ("immigrants", "refugees", "citizens", "foreigners"),
    ("disabled", "blind", "deaf", "autistic"), ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "athées"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "atheisten"), ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
)
_OTHER = {w: group[(i + 1) % len(group)] for group in IDENTITIES for i, w in enumerate(group)}
_NAMES = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, _OTHER), key=len, reverse=True)) + r")(?!\w)")


def swapped(text: str) -> str:
    """The lower-cased text with each identity term replaced by the next of its group."""
    return _NAMES.sub(lambda m: _OTHER[m[1]], text.lower())


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """row, slot of the distinct features of each row: words and beginnings of longer words."""
    words = Words(Text(pc.utf8_lower(column.fill_null("").cast(pa.string()))), _GAP)
    slot, row = [mixed(words.hash, 1)], [words.row]
    back = powers(len(words.sums))[1]
    for n in PREFIXES:
        long = np.flatnonzero(words.end - words.start > n)
        begin = words.start[long]
        slot.append(mixed((words.sums[begin + n] - words.sums[begin]) * back[begin], 100 + n))
        row.append(words.row[long])
    both = np.unique(np.concatenate(row).astype(np.uint64) << np.uint64(BITS) | np.concatenate(slot) >> np.uint64(64 - BITS))
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(column: pa.Array) -> list[bytes]:
        row, slot = features(column)
        cut = np.searchsorted(row, np.arange(len(column) + 1))
        return [slot[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]

    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column(0).to_pylist()
            named = [i for i, t in enumerate(texts) if t and _NAMES.search(t.lower())]
            other: list[bytes | None] = [None] * len(texts)
            for i, x in zip(named, packed(pa.array([swapped(texts[i]) for i in named], pa.string())), strict=True):
                other[i] = x
            yield pa.RecordBatch.from_arrays([pa.array(packed(part.column(0)), pa.binary()), pa.array(other, pa.binary()), part.column(1)], ["own", "other", "toxic"])


class Model:
    """slots (sorted), weights, bias of the fitted classifier."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, bias: float):
        self.slots, self.weights, self.bias = slots, weights, bias
        self.dense = np.zeros(1 << BITS, np.float32)
        self.dense[slots] = weights

    def score(self, column: pa.Array) -> np.ndarray:
        row, slot = features(column)
        z = np.bincount(row, weights=self.dense[slot], minlength=len(column)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _choose(rows: list[np.ndarray], y: np.ndarray, named: np.ndarray) -> np.ndarray:
    """The features with the highest chi-squared statistic, and the identity terms' own."""
    slots = np.concatenate(rows)
    at, where = np.unique(slots, return_inverse=True)
    n1 = np.bincount(where, weights=np.repeat(y, [len(r) for r in rows]), minlength=len(at))
    n = np.bincount(where, minlength=len(at))
    p, total = y.mean(), len(y)
    odds = (n1 - n * p) ** 2 / np.maximum(n * p * (1 - p) * (1 - n / total), 1e-9)
    odds[n < LEAST_ROWS] = 0
    best = np.argsort(-odds, kind="stable")[:FEATURES]
    return np.unique(np.concatenate([at[best[odds[best] > 6]], at[np.isin(at, named)]]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, swap_weight: float = SWAP_WEIGHT, seed: int = 7) -> Model:
    """A classifier of labels.toxic; only rows whose crc32(doc_id as text) mod 4 is not 2 are learnt from.

    At most ``sample`` labelled rows (least hash of doc_id first) reach the driver, as feature slots. Of rows that share
    a doc_id the text with the least hash is learnt from.
    """
    rows = labels.where("toxic is not null and doc_id is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int"))
    rows = rows.orderBy(F.xxhash64("id"), "toxic").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # rows that share an id are one before they leave their tasks, so no more than the sample arrives
    once = texts.join(F.broadcast(rows.distinct()), "id").groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = once.select("text", "toxic").mapInArrow(_collect, "own binary, other binary, toxic int").toArrow()
    y = np.array(got.column(2).to_pylist(), np.float64)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(p / (1 - p))))
    own = [np.frombuffer(x, np.uint32).astype(np.int64) for x in got.column(0).to_pylist()]
    other = got.column(1).to_pylist()
    pairs = [(i, np.frombuffer(x, np.uint32).astype(np.int64)) for i, x in enumerate(other) if x is not None]
    named = features(pa.array(sorted(_OTHER)))[1]
    slots = _choose(own, y, named)

    def csr(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        slot = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        j = np.minimum(np.searchsorted(slots, slot), max(0, len(slots) - 1))
        ok = slots[j] == slot if len(slots) else np.zeros(len(slot), bool)
        return row[ok], j[ok]

    row, col = csr(own)
    row2, col2 = csr([x for _, x in pairs])
    first = np.array([i for i, _ in pairs], np.int64)
    w, b, n = np.zeros(len(slots)), float(np.log(y.mean() / (1 - y.mean()))), len(y)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, 401):
        z = np.bincount(row, weights=w[col], minlength=n) + b
        p = 1 / (1 + np.exp(-z))
        e = (p - y) / n
        g = np.bincount(col, weights=e[row], minlength=len(w)) + 1e-4 * w
        gb = e.sum()
        if len(first):
            p2 = 1 / (1 + np.exp(-(np.bincount(row2, weights=w[col2], minlength=len(first)) + b)))
            d = 2 * swap_weight * (p[first] - p2) / len(first)
            full, part = np.zeros(n), -d * p2 * (1 - p2)
            np.add.at(full, first, d * p[first] * (1 - p[first]))
            g += np.bincount(col, weights=full[row], minlength=len(w)) + np.bincount(col2, weights=part[row2], minlength=len(w))
            gb += full.sum() + part.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model(slots, w, b)


def held_out():
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 == 2


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1)))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_score(shared), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs.

    Scores come from texts alone. Null and empty texts get a score; repeated rows repeat; a null doc_id has a null
    held_out; with no usable labels every score is the base rate; an empty table gives an empty one.
    """
    scored = score(docs, fit(docs, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
