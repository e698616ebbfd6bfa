"""Quality rules: repetition and length rules, then language-specific perplexity bands of a byte n-gram model.

The model is interpolated modified Kneser-Ney over byte 5-grams, one for each language. One pass over the documents
measures the base rules and lists each block's distinct n-grams, with counts from the documents fit to learn from (the
others ask with a count of zero). Spark sums the counts and derives continuation counts, discounts and probabilities;
each shard of the model is a sorted hash array that answers the blocks' lists. A second pass sums each document's bits
from its block's answers. So nothing is pruned or broadcast, and what a task holds depends on its block alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblode.llm._store import bucketed, free_name, remove, scratch, stored
from joblode.llm._words import SPACE, Text, Words, cover, mixed, slices, windows

ORDER = 5
#: Half width of a band in robust standard deviations of the language's log-perplexity.
BAND = 5.0
#: The lower half is wider by this factor: well-known lines (licences, greetings) make short clean texts predictable.
LOWER = 1.6
#: Standard deviation that a text of one byte adds; it falls with the square root of the length.
SHORT = 2.0
#: A document with more symbols than this for each word is not learnt from (it is scored all the same).
SYMBOLS = 0.1
#: Bytes of text in a block, whose distinct n-grams are looked up together.
BLOCK = 64 << 20
#: Bytes of text whose n-grams one group of a shard holds on average.
SHARD = 64 << 20
#: Log-probabilities are whole numbers of this part of a bit, so sums do not depend on their order.
UNIT = 1 << 16
#: Medians are over bits per byte in steps of this part of a bit.
STEP = 1 << 12
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CODE = np.uint64((1 << 40) - 1)


def _shard(g, shards: int):
    """Shard of an n-gram, for arrays of integers (the same as _shard_of)."""
    return (g.astype(np.int64) * 1664525 >> 16) % shards


def _shard_of(g: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(g * 1664525, 16), F.lit(shards)).cast("int")


def _five(codes: np.ndarray) -> bytes:
    """40-bit integers, five bytes each."""
    return codes.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unfive(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view(np.uint64)[:, 0]


def _grams(text: Text, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams of each row as integers, and the row of each."""
    n = len(text.data) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.zeros(n, np.uint64)
    for i in range(order):
        code = code << np.uint64(8) | text.data[i : n + i]
    row = np.repeat(np.arange(text.n), np.diff(text.at))
    whole = row[:n] == row[order - 1 :]
    return code[whole], row[:n][whole]


def base_fails(n_words, n_repeat_words):
    """The base rules, for arrays and for columns alike."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def repeat_words(words: Words, rows: int, width: int = 5) -> np.ndarray:
    """Words of each row in windows of ``width`` words that the row holds twice or more."""
    h, whole = windows(words, width)
    if not len(h):
        return np.zeros(rows, np.int64)
    key = mixed(h + mixed(words.row[: len(h)].astype(np.uint64) + np.uint64(1), 3), 9)
    order = np.sort(key[whole])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(rows, np.int64)
    at = np.flatnonzero(whole)
    i = np.minimum(np.searchsorted(twice, key[at]), len(twice) - 1)
    at = at[twice[i] == key[at]]
    return np.bincount(words.row[cover(len(words.row), at, at + width)], minlength=rows)


def dup_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in (text or "").split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\r\x0b\f"):
            seen.add(line)
    return n


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.diff(k, prepend=k[:1] ^ np.uint64(1)))
    return k[first], np.add.reduceat(c, first) if len(first) else c


def _distinct(full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each stands."""
    full = np.sort(full)
    first = np.flatnonzero(np.diff(full, prepend=full[:1] ^ np.uint64(1)))
    return full[first], np.diff(np.append(first, len(full))).astype(np.int64)


_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long"
_DOC = f"doc_id long, lang string, text string, k1 long, k2 long, {_BASE}"
_LIST = "shard int, keys binary, counts binary"
_PREPARED = f"kind string, block long, {_DOC}, {_LIST}"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _prepared(shards: int, symbols: float, block_bytes: int):
    """Rows of kind doc (a document with its base measures) and gram (a block's n-grams of a language and shard)."""
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _PREPARED.split(", "))])

    def batch_of(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        block = held = n = 0
        languages: dict[str, int] = {}
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def lists() -> pa.RecordBatch:
            k, c = _summed(keys, counts)
            slot, code = (k >> np.uint64(40)).astype(np.int64), k & _CODE
            shard = _shard(code, shards)
            order = np.lexsort((code, shard, slot))
            slot, code, shard, c = slot[order], code[order], shard[order], c[order]
            edge = np.flatnonzero((np.diff(slot, prepend=-1) != 0) | (np.diff(shard, prepend=-1) != 0)).tolist()
            spans = list(zip(edge, [*edge[1:], len(k)], strict=True))
            name = list(languages)
            out = {"kind": ["gram"] * len(spans), "block": [first + block] * len(spans), "lang": [name[slot[a]] for a, _ in spans], "shard": shard[edge], "keys": [_five(code[a:b]) for a, b in spans], "counts": [c[a:b].astype(np.uint32).tobytes() for a, b in spans]}
            keys.clear()
            counts.clear()
            languages.clear()
            return batch_of(len(spans), out)

        for batch in batches:
            for part in slices(batch, "text"):
                column, lang = part.column(2), part.column(1).to_pylist()
                text = Text(column)
                words = Words(text)
                n_words, n_symbols, again = np.diff(words.first), text.per_row(_SYMBOL[text.data]), repeat_words(words, text.n)
                code, row = _grams(text)
                fit = (~base_fails(n_words, again) & (n_symbols <= symbols * n_words))[row]
                slot = np.array([languages.setdefault(x, len(languages)) for x in lang], np.uint64)
                full = slot[row] << np.uint64(40) | code
                for k, c in (_distinct(full[fit]), (_distinct(full[~fit])[0], None)):
                    keys.append(k)
                    counts.append(np.zeros(len(k), np.int64) if c is None else c)
                    n += len(k)
                if n > 1_500_000:
                    k, c = _summed(keys, counts)
                    keys[:], counts[:], n = [k], [c], len(k)
                yield batch_of(text.n, {
                    "kind": ["doc"] * text.n, "block": [first + block] * text.n, "doc_id": part.column(0), "lang": lang, "text": column, "k1": part.column(3), "k2": part.column(4), "n_words": n_words, "word_chars": text.per_row(((text.data & 0xC0) != 0x80) & ~SPACE[text.data]),
                    "n_symbols": n_symbols, "n_dup_lines": [dup_lines(t) for t in column.to_pylist()], "n_repeat_words": again, "n_grams": np.bincount(row, minlength=text.n),
                })
                held += len(text.data)
                if held >= block_bytes:
                    yield lists()
                    block, held, n = block + 1, 0, 0
        if keys:
            yield lists()

    return run


def _merged(table: pa.Table) -> pa.Table:
    """lang, g, c: a shard's n-grams with their counts over all blocks."""
    k, c = _summed([_unfive(x) for x in table.column("keys").to_pylist()], [np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("counts").to_pylist()])
    return pa.table({"lang": pa.repeat(table.column("lang")[0], len(k)), "g": k.astype(np.int64), "c": c})


def counted(lists: DataFrame, parts: int = 1) -> DataFrame:
    """lang, g, c of all blocks' lists; a shard of very many blocks is summed in ``parts``."""
    each = lists.groupBy("lang", "shard", F.pmod("block", F.lit(parts)).alias("part")).applyInArrow(_merged, "lang string, g long, c long")
    return each if parts == 1 else each.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _few(languages: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of one row for each language, broadcast while it is small, so that no language's rows are shuffled."""
    return F.broadcast(languages) if languages.count() <= most else languages


def kneser_ney(counts: DataFrame, order: int = ORDER, under: str | None = None) -> DataFrame:
    """lang, g, p: the probability of the last byte given the others of each n-gram (lang, g, c: count) of counts.

    Rows with a count of zero only ask. Lower orders use continuation counts. Discounts follow from counts of counts;
    where those vanish, the discount is one half. An n-gram whose context was never counted backs off as a whole.
    """
    keep = lambda df: stored(df, under)
    low = lambda n: F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        levels[n] = keep(levels[n + 1].groupBy("lang", low(n).alias("g")).agg(F.count_if(F.col("c") > 0).alias("c")))
    lower = None
    for n in range(1, order + 1):
        some = levels[n].groupBy("lang").agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))
        own = lambda i: F.least(F.greatest(F.coalesce(i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)), F.lit(0.5)), F.lit(0.05)), F.lit(i - 0.05))
        discounts = _few(keep(some.select("lang", own(1).alias("d1"), own(2).alias("d2"), own(3).alias("d3"))))
        c, of_ctx = F.col("c"), W.partitionBy("lang", F.shiftright("g", 8))
        cut = F.when(c == 0, 0.0).when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        table = levels[n].join(discounts, "lang").withColumn("cut", cut)
        table = table.select("lang", "g", (c - F.col("cut")).alias("own"), F.sum("c").over(of_ctx).alias("s"), F.sum("cut").over(of_ctx).alias("left"))
        if lower is None:
            table = table.withColumn("q", F.lit(1 / 256))
        else:
            table = table.withColumn("h", low(n - 1)).join(lower.select("lang", F.col("g").alias("h"), F.col("p").alias("q")), ["lang", "h"])
        p = F.when(F.col("s") > 0, (F.col("own") + F.col("left") * F.col("q")) / F.col("s")).otherwise(F.col("q"))
        lower = keep(table.select("lang", "g", p.alias("p")))
    return lower


def _answered(lists: pa.Table, model: pa.Table) -> pa.Table:
    """The blocks' lists (block, lang, keys) of a shard with the values of the shard's sorted array."""
    g, v = model.column("g").to_numpy().astype(np.uint64), model.column("v").to_numpy()
    order = np.argsort(g)
    g, v = g[order], v[order]
    values = []
    for x in lists.column("keys").to_pylist():
        k = _unfive(x)
        at = np.searchsorted(g, k)
        if len(k) and (at[-1] >= len(g) or not np.array_equal(g[at], k)):
            raise ValueError("an n-gram is missing from the model")
        values.append(v[at].astype(np.int32).tobytes())
    return pa.table({"block": lists.column("block"), "lang": lists.column("lang"), "keys": lists.column("keys"), "values": pa.array(values, pa.binary())})


_SCORED = f"doc_id long, lang string, k1 long, k2 long, {_BASE}, bits long"


def _scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's documents with the sums of their n-grams' values."""
    languages: dict[str, int] = {}
    keys, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for lang, k, v in zip(*(answers.column(c).to_pylist() for c in ("lang", "keys", "values")), strict=True):
        keys.append(np.uint64(languages.setdefault(lang, len(languages)) << 40) | _unfive(k))
        values.append(np.frombuffer(v, np.int32))
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key)
    key, value = key[order], value[order]
    out = []
    for batch in docs.to_batches():
        for part in slices(batch, "text"):
            names = part.schema.names
            text = Text(part.column(names.index("text")))
            code, row = _grams(text)
            # a language without an answer has no n-grams
            slot = np.array([languages.get(x, 0) for x in part.column(names.index("lang")).to_pylist()], np.uint64)
            full = slot[row] << np.uint64(40) | code
            i = np.argsort(full)
            first = np.flatnonzero(np.diff(full[i], prepend=full[i][:1] ^ np.uint64(1)))
            bits = np.empty(len(full))
            bits[i] = np.repeat(value[np.searchsorted(key, full[i][first])], np.diff(np.append(first, len(full))))
            total = -np.bincount(row, weights=bits, minlength=text.n)
            out.append(pa.RecordBatch.from_arrays([*(part.column(names.index(n)) for n in _names(_SCORED)[:-1]), pa.array(total.astype(np.int64))], _names(_SCORED)))
    return pa.Table.from_batches(out) if out else pa.table({n: pa.array([], pa.string() if n == "lang" else pa.int64()) for n in _names(_SCORED)})


def _row_key() -> tuple[Column, Column, Column, Column]:
    """A row's language and text as they count, and 128 bits of both."""
    lang, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "text"))
    return lang, text, F.xxhash64(lang, text), F.xxhash64(F.lit("k2"), lang, text)


def measures(docs: DataFrame, under: str, symbols: float = SYMBOLS, block_bytes: int = BLOCK) -> DataFrame:
    """The 128 bits of language and text, the base measures, the number of n-grams and their bits (in UNIT parts) under the model, of each row.

    Everything is written below the folder ``under``.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    # odd, so that shards depend on all bits; beyond the most, a shard's blocks are dealt to parts
    shards = min(4095, max(63, size // SHARD)) | 1
    parts = max(1, size // (SHARD * shards))
    buckets = min(50_000, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), size // block_bytes))
    lang, text, k1, k2 = _row_key()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text.alias("text"), k1.alias("k1"), k2.alias("k2"))
    ready = bucketed(rows.mapInArrow(_prepared(shards, symbols, block_bytes), _PREPARED), under, "kind", "block", buckets)
    lists = ready.where("kind = 'gram'").select("block", "lang", "shard", "keys", "counts")
    model = kneser_ney(stored(counted(lists, parts), under), under=under)
    # both sides' keys have one type, or their hashes would differ
    part = F.pmod("block", F.lit(parts)).cast("int").alias("part")
    shard = model.select("lang", "g", F.floor(F.log2("p") * UNIT + 0.5).cast("int").alias("v"), _shard_of(F.col("g"), shards).alias("shard"), (F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)).cast("int").alias("part"))
    answers = lists.select("block", "lang", "shard", "keys", part).groupBy("lang", "shard", "part").cogroup(shard.groupBy("lang", "shard", "part")).applyInArrow(_answered, "block long, lang string, keys binary, values binary")
    # the documents lie in buckets by block, so only the answers move
    texts = ready.where("kind = 'doc'").select("block", *_names(_DOC))
    return stored(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored, _SCORED), under)


def _middle(counts: DataFrame) -> DataFrame:
    """lang, at: the lower median of each language's values (lang, at, n)."""
    of_lang = W.partitionBy("lang")
    up_to = of_lang.orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.select("lang", "at", F.sum("n").over(up_to).alias("below"), F.sum("n").over(of_lang).alias("all")).where("2 * below >= all").groupBy("lang").agg(F.min("at").alias("at"))


def bands(rows: DataFrame) -> DataFrame:
    """lang, middle, spread: median and robust deviation of the bits per byte of the rows that pass the base rules.

    Both are exact medians of values in steps of 1/4096 bit, so a language has some tens of thousands of counts at most.
    """
    counts = rows.where(~F.col("base_failed") & F.col("bits_per_byte").isNotNull()).groupBy("lang", F.floor(F.col("bits_per_byte") * STEP + 0.5).alias("at")).agg(F.count("*").alias("n"))
    middle = _middle(counts)
    off = counts.join(middle.select("lang", F.col("at").alias("middle")), "lang").groupBy("lang", F.abs(F.col("at") - F.col("middle")).alias("at")).agg(F.sum("n").alias("n"))
    return middle.join(_middle(off).select("lang", F.col("at").alias("off")), "lang").select("lang", (F.col("at") / STEP).alias("middle"), (1.4826 * F.col("off") / STEP).alias("spread"))


def _judged(docs: DataFrame, band: float, symbols: float, block_bytes: int) -> DataFrame:
    """verdicts() with the 128 bits k1, k2 of each row's language and text."""
    spark = docs.sparkSession
    work = scratch(spark, "quality")
    rows = measures(docs, work, symbols, block_bytes)
    rows = stored(rows.withColumns({"base_failed": base_fails(F.col("n_words"), F.col("n_repeat_words")), "bits_per_byte": F.when(F.col("n_grams") > 0, F.col("bits") / UNIT / F.col("n_grams"))}).drop("bits"))
    remove(spark, work)
    spread = _few(stored(bands(rows)))
    wide = band * F.sqrt(F.col("spread") * F.col("spread") + SHORT * SHORT / F.greatest(F.col("n_grams"), F.lit(1)))
    rows = rows.join(spread, "lang", "left").withColumns({"low": F.col("middle") - LOWER * wide, "high": F.col("middle") + wide})
    inside = F.coalesce(F.col("bits_per_byte").between(F.col("low"), F.col("high")), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & inside).drop("middle", "spread")


def verdicts(docs: DataFrame, band: float = BAND, symbols: float = SYMBOLS, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_grams, base_failed, bits_per_byte,
    low, high, kept.

    A text fails the base rules with fewer than 10 words, or with more than a fifth of its words in repeated
    5-word windows. Else it is kept if its bits per byte lie in its language's band: the median, plus and minus
    ``band`` robust deviations (1.4826 times the median absolute deviation), wider for short texts. The median
    is over texts that pass the base rules. The model learns from the texts that pass the base rules and hold at most
    ``symbols`` symbols a word. Null and empty texts have no words and fail. A null language counts as the empty
    one. Repeated rows repeat; an empty table gives an empty one.
    """
    return _judged(docs, band, symbols, block_bytes).drop("k1", "k2")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that verdicts() keeps; columns unchanged. Each row goes or stays by its own text, whatever its doc_id."""
    own, found = ([free_name(docs, f"{c}_{side}") for c in ("id", "k1", "k2")] for side in ("own", "kept"))
    _, _, k1, k2 = _row_key()
    kept = _judged(docs, BAND, SYMBOLS, BLOCK).where("kept").select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "k1", "k2"), found, strict=True)]).distinct()
    rows = docs.withColumns(dict(zip(own, (F.col("doc_id").cast("long"), k1, k2), strict=True)))
    same = F.col(own[0]).eqNullSafe(F.col(found[0])) & (F.col(own[1]) == F.col(found[1])) & (F.col(own[2]) == F.col(found[2]))
    return rows.join(kept, same, "left_semi").select(*docs.columns)
