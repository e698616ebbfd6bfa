"""Text fingerprints and cross-listing near-duplicates."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblode.functions.text import words_only
from joblode.store import stored

#: The 64 bits in eight blocks, of which five differing bits leave three untouched.
BLOCKS, WIDTH = 8, 8
LEAST = 200


def _simhash(text: str) -> str:
    raw = text.encode()
    starts = [0, *(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1).tolist(), len(raw) + 1]
    digest = b"".join([hashlib.sha1(raw[i : j - 1]).digest()[:8] for i, j in zip(starts, starts[3:] or starts[-1:])])
    bits = np.unpackbits(np.frombuffer(digest, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > len(bits)).tobytes().hex()


@F.pandas_udf(T.StringType())
def _hashed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "" if x is None or len(x) < LEAST else _simhash(x))


def sha_simhash(text: Column) -> Column:
    """64-bit SimHash (16 hexadecimal digits) of three-word shingles; empty for texts under 200 characters."""
    return _hashed(words_only(F.coalesce(text, F.lit(""))))


def near_fingerprints(fps: DataFrame, bits: int) -> DataFrame:
    """fa, fb, distance: pairs fa <= fb (a fingerprint with itself too) of distinct fingerprints fp at most ``bits`` apart.

    At most five bits: any two such fingerprints agree on three of eight blocks, so each stands under 56 keys of 24 bits.
    """
    part = lambda i: F.shiftrightunsigned("fp", i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))
    keys = []
    for n, (i, j, k) in enumerate(combinations(range(BLOCKS), BLOCKS - 5)):
        keys.append(F.shiftleft(F.lit(n).cast("long"), 24).bitwiseOR(F.shiftleft(part(i), 16)).bitwiseOR(F.shiftleft(part(j), 8)).bitwiseOR(part(k)))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("k"))
    # keys of one fingerprint meet nothing
    keyed = keyed.join(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "k", "left_semi")
    near = keyed.alias("a").join(keyed.alias("b"), "k").where("a.fp < b.fp").select(F.col("a.fp").alias("fa"), F.col("b.fp").alias("fb"))
    near = near.withColumn("distance", F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))).where(F.col("distance") <= bits).distinct()
    return near.union(fps.select("fp", "fp", F.lit(0)))


def link_classes(rows: DataFrame, bits: int = 5) -> DataFrame:
    """fp_a, fp_b, distance, n_a, n_b: pairs of fingerprints (each with itself too) at most ``bits`` apart, with their rows.

    rows: fingerprint. A class is all rows of one fingerprint, so copies of a text cost no pairs.
    """
    # read by several steps below, and fingerprints are costly
    sizes = stored(rows.where("fingerprint <> ''").groupBy(F.conv("fingerprint", 16, -10).cast("long").alias("fp")).agg(F.count("*").alias("n")))
    pairs = near_fingerprints(sizes.select("fp"), bits)
    name = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    a, b = sizes.select(F.col("fp").alias("fa"), F.struct(name("fp").alias("fp"), "n").alias("a")), sizes.select(F.col("fp").alias("fb"), F.struct(name("fp").alias("fp"), "n").alias("b"))
    both = pairs.join(a, "fa").join(b, "fb").select("distance", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return both.select(F.col("a.fp").alias("fp_a"), F.col("b.fp").alias("fp_b"), "distance", F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


def cross_listings(rows: DataFrame, days: int = 90, bits: int = 5) -> DataFrame:
    """Id, fingerprint, n_links, least_distance of each posting with cross-listings: postings with a near-equal
    fingerprint (at most ``bits`` bits apart), another company and another URL, at most ``days`` apart.

    rows: id, fingerprint, company, url, day. Copies of one fingerprint, company, URL and day are one posting, that of the
    least id; a null company or URL counts as empty, rows without a day have no links. Postings are never paired: all
    of a class within reach are counted, less those of the own company and those of the own URL, plus those of both; each
    count is a sum over neighbouring days of (class, company, URL) totals, so 600 equal texts cost 600 rows, not 180,000.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    real = rows.where("fingerprint <> '' and day is not null").select("id", F.conv("fingerprint", 16, -10).cast("long").alias("fp"), text("company").alias("company"), text("url").alias("url"), F.unix_date(F.col("day").cast("date")).alias("day"))
    real = stored(real.groupBy("fp", "company", "url", "day").agg(F.min("id").alias("id")))
    pairs = near_fingerprints(real.select("fp").distinct(), bits)
    pairs = stored(pairs.union(pairs.where("fa <> fb").select("fb", "fa", "distance")))
    out = real.withColumn("distance", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    total = F.lit(0)
    # where all rows of a URL have one company, those of the URL are those of both and cancel out
    several = real.groupBy("url").agg(F.min("company").alias("a"), F.max("company").alias("b")).where("a <> b").select("url")
    for sign, by in ((1, []), (-1, ["company"]), (-1, ["url"]), (1, ["company", "url"])):
        each = (real.join(several, "url", "left_semi") if "url" in by else real).groupBy(F.col("fp").alias("f"), *by, "day").agg(F.count("*").alias("n"))
        theirs = pairs.join(each, F.col("fb") == F.col("f")).select("fa", "distance", *by, "day", "n").groupBy("fa", "distance", *by, "day").agg(F.sum("n").alias("n"))
        mine = pairs.select("fa", "distance").distinct().join(each, F.col("fa") == F.col("f")).select("fa", "distance", *by, "day", F.lit(0).cast("long").alias("n"))
        reach = W.partitionBy("fa", "distance", *by).orderBy("day").rangeBetween(-days, days)
        met = theirs.union(mine).groupBy("fa", "distance", *by, "day").agg(F.sum("n").alias("n")).withColumn("n", F.sum("n").over(reach))
        name = "n_" + "_".join(by)
        out = out.join(met.select(F.col("fa").alias("fp"), "distance", *by, "day", F.col("n").alias(name)), ["fp", "distance", *by, "day"], "left")
        total = total + sign * F.coalesce(name, F.lit(0))
    found = out.withColumn("n", total).where("n > 0").groupBy("id", "fp").agg(F.sum("n").alias("n_links"), F.min("distance").alias("least_distance"))
    return found.select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_links", "least_distance")
