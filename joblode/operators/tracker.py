"""Merging additions into the tracker."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblode.functions import title as titles
from joblode.functions.text import words_only
from joblode.operators.graph import components
from joblode.store import stored


def _known(df: DataFrame, name: str) -> Column:
    """A text column, empty where it is null or missing."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def _sides(df: DataFrame, *own: str) -> DataFrame:
    """The columns that matching reads; employer: the company, or the channel of an employer without a name."""
    key, via = _known(df, "company_key"), words_only(_known(df, "via"))
    employer = F.when(key != "", F.concat(F.lit("c:"), key)).when((F.trim("company") == "?") & (via != ""), F.concat(F.lit("v:"), via)).otherwise("")
    return df.select(*own, "num", "company", "role", "score", _known(df, "report").alias("report"), _known(df, "url").alias("url"), _known(df, "req").alias("req"), employer.alias("employer"))


def role_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """employer, role_a, role_b: roles (employer, role) of both sides that name one opening, distinct roles once each."""
    one, two = (x.select("employer", F.col("role").alias(f"role_{n}")).where("employer <> ''").distinct() for x, n in ((a, "a"), (b, "b")))
    tokens = lambda df, n: df.select("*", F.array_distinct(titles.role_tokens(F.col(f"role_{n}"))).alias(f"t{n}"), titles.seniority_words(F.col(f"role_{n}")).alias(f"s{n}"), F.lower(F.trim(f"role_{n}")).alias(f"l{n}"))
    one, two = tokens(one, "a"), tokens(two, "b")
    # openings that match share a telling word, if they are not the same text
    telling = lambda n: F.array_except(f"t{n}", F.array(*map(F.lit, titles.BASELINE)))
    words = lambda df, n: df.select("employer", f"role_{n}", F.explode(F.concat(telling(n), F.array(F.concat(F.lit("="), f"l{n}")))).alias("w"))
    near = words(one, "a").join(words(two, "b"), ["employer", "w"]).select("employer", "role_a", "role_b").distinct()
    full = near.join(one, ["employer", "role_a"]).join(two, ["employer", "role_b"])
    c = F.col
    return full.where(titles.same_role(c("role_a"), c("role_b"), c("ta"), c("tb"), c("sa"), c("sb"))).select("employer", "role_a", "role_b")


def merge_additions(tracker: DataFrame, additions: DataFrame) -> DataFrame:
    """Num, company, role, score, merged, rule of the tracker after the additions.

    tracker: num, company, company_key, role, score, report, url, and req and via where known; additions: these and
    seq. An addition updates the first row (least num) that its URL names, else its report and employer, else its
    number and employer, else its employer and an opening like its role; else it is new. An empty URL, report or
    employer names nothing; employers without a name ("?") are told apart by their channel. Two URLs that differ are
    two postings, whatever else agrees; numbers and roles, which are guesses, also need a row without a URL where the
    addition has none. Requisitions that are both known and differ veto a match of roles. Additions of one run that share a
    URL, or without one employer, role words and requisition, are one. A match by URL or report takes over the newest role, any match the newest
    score there is. A new row keeps its number if it is free, else takes the next free one in order of seq.
    """
    t, a = _sides(tracker), _sides(additions, "seq")
    first = lambda df, name, *keys: df.groupBy(*keys).agg(F.min("num").alias(name))
    bare = t.where("url = ''")
    named = t.where("employer <> ''")
    pairs = role_pairs(a, bare)
    like = pairs.join(bare.select("employer", F.col("role").alias("role_b"), "req", "num"), ["employer", "role_b"]).withColumnRenamed("role_a", "role")
    hit = (
        a.join(first(t.where("url <> ''"), "by_url", "url"), "url", "left")
        # of equal URLs the first rule tells; a differing one is no match, so a row without one is left
        .join(first(named.where("report <> ''"), "any_report", "report", "employer"), ["report", "employer"], "left")
        .join(first(named.where("report <> '' and url = ''"), "bare_report", "report", "employer"), ["report", "employer"], "left")
        .join(first(named.where("url = ''").withColumn("own", F.col("num")), "by_num", "own", "employer").withColumnRenamed("own", "num"), ["num", "employer"], "left")
        .join(first(like, "any_role", "employer", "role"), ["employer", "role"], "left")
        .join(first(like.where("req = ''"), "plain_role", "employer", "role"), ["employer", "role"], "left")
        .join(first(like.where("req <> ''"), "req_role", "employer", "role", "req"), ["employer", "role", "req"], "left")
    )
    by_report = F.when(F.col("url") == "", F.col("any_report")).otherwise(F.col("bare_report"))
    by_role = F.when(F.col("req") == "", F.col("any_role")).otherwise(F.least("plain_role", "req_role"))
    target = F.coalesce("by_url", by_report, "by_num", by_role)
    rule = F.when(F.col("by_url").isNotNull(), "url").when(by_report.isNotNull(), "report").when(F.col("by_num").isNotNull(), "number").when(by_role.isNotNull(), "role").otherwise("new")
    hit = hit.select("seq", "num", "company", "role", "score", "url", "req", "employer", target.alias("target"), rule.alias("rule"))
    newest = lambda c, test=F.lit(True): F.max_by(F.when(test, F.col(c)), F.when(test & F.col(c).isNotNull(), F.col("seq")))
    sure = F.col("rule").isin("url", "report")
    updates = hit.where("target is not null").groupBy(F.col("target").alias("num")).agg(newest("score").alias("new_score"), newest("role", sure).alias("new_role"), F.count("*").alias("merged"), F.min_by("rule", "seq").alias("rule"))
    kept = tracker.select("num", "company", "role", "score").join(updates, "num", "left")
    kept = kept.select("num", "company", F.coalesce("new_role", "role").alias("role"), F.coalesce("new_score", "score").alias("score"), F.coalesce("merged", F.lit(0)).alias("merged"), F.coalesce("rule", F.lit("")).alias("rule"))
    # what names one posting in a run; an addition that nothing names stands alone
    key = F.when(F.col("url") != "", F.concat(F.lit("u:"), "url")).when(F.col("employer") != "", F.concat_ws("\u0000", "employer", words_only(F.col("role")), "req")).otherwise(F.concat(F.lit("s:"), F.col("seq").cast("string")))
    fresh = hit.where("target is null").groupBy(key.alias("key")).agg(F.min("seq").alias("head"), F.min_by(F.struct("num", "company", "role"), "seq").alias("r"), newest("score").alias("score"), F.count("*").alias("merged"))
    free, conflicts = _numbered(fresh, tracker, additions)
    shape = lambda df: df.select("own", "r.company", "r.role", "score", "merged", F.lit("new").alias("rule"))
    return kept.union(shape(free)).union(shape(conflicts))


def _numbered(fresh: DataFrame, tracker: DataFrame, additions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows (head, r.num asked for) with the number that each gets (own): those whose number is free, and the others."""
    # a number goes to the first that asks for it
    fresh = fresh.join(tracker.select(F.col("num").alias("taken")), F.col("r.num") == F.col("taken"), "left")
    asked = fresh.where("taken is null").groupBy("r.num").agg(F.min("head").alias("head")).select("head", F.lit(True).alias("free"))
    fresh = fresh.join(asked, "head", "left")
    top = tracker.select("num").union(additions.select("num")).agg(F.max("num").alias("top"))
    # numbers in order of seq: rows are numbered within ranges of seq, and only the ranges' sizes meet in one task
    taken = fresh.where("free is null").withColumn("range", F.floor(F.col("head") / 65536))
    sizes = taken.groupBy("range").agg(F.count("*").alias("size"))
    before = sizes.select("range", F.coalesce(F.sum("size").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("range").orderBy("head"))
    conflicts = taken.join(before, "range").withColumn("n", F.col("before") + own).join(F.broadcast(top))
    return fresh.where("free").withColumn("own", F.col("r.num")), conflicts.withColumn("own", F.col("top") + F.col("n"))


class _Rows:
    """Tracker rows of a unit, in order, found by what they name.

    A list for each column, since a unit may have millions of rows. What a row names leads to heaps of row
    numbers; those that no longer name it are dropped when they come up.
    """

    def __init__(self):
        self.like: dict[str, set[str]] = {}
        self.reports: dict[str, str] = {}
        self.head, self.num, self.company, self.role, self.score, self.report, self.url, self.req, self.employer, self.merged, self.rule = ([] for _ in range(11))
        self.skipped: dict[int, int] = {}
        self.superseded: dict[int, list[str]] = {}
        self.by_url: dict[str, int] = {}
        # of rows with any URL, and of rows without one
        self.by_report: dict[tuple, tuple[list[int], list[int]]] = {}
        # rows without a URL; of any requisition, and by requisition
        self.by_role: dict[str, dict[str, tuple[list[int], dict[str, list[int]]]]] = {}
        self.old_number: dict[int, int] = {}
        self.new_number: dict[tuple, dict[str, list[int]]] = {}

    def pair(self, role: str, like: str) -> None:
        self.like.setdefault(role, set()).add(like)

    def _name_report(self, i: int) -> None:
        e, report = self.employer[i], self.report[i]
        if e and report:
            both = self.by_report.setdefault((e, report), ([], []))
            heappush(both[0], i)
            if not self.url[i]:
                heappush(both[1], i)

    def _name_role(self, i: int) -> None:
        e, role = self.employer[i], self.role[i]
        if e and not self.url[i]:
            every, by_req = self.by_role.setdefault(e, {}).setdefault(role, ([], {}))
            heappush(every, i)
            heappush(by_req.setdefault(self.req[i], []), i)
            if self.head[i] is not None and self.num[i] is not None:
                heappush(self.new_number.setdefault((e, self.num[i]), {}).setdefault(role, []), i)

    def put(self, head: int | None, cells: tuple) -> None:
        """A row of the tracker, or of an addition (head: its seq)."""
        _, num, company, role, score, report, url, req, employer = cells
        i = len(self.num)
        for column, v in ((self.head, head), (self.num, num), (self.company, company), (self.role, role), (self.score, score), (self.report, self.reports.setdefault(report, report)), (self.url, url), (self.req, req), (self.employer, employer)):
            column.append(v)
        self.merged.append(0 if head is None else 1)
        self.rule.append("" if head is None else "new")
        if url:
            self.by_url.setdefault(url, i)
        if head is None and not url:
            self.old_number.setdefault(num, i)
        self._name_report(i)
        self._name_role(i)

    def _by_report(self, e: str, report: str, bare: bool) -> int | None:
        heap = self.by_report.get((e, report), ((), ()))[bare]
        while heap:
            i = heap[0]
            if self.report[i] == report and self.employer[i] == e and not (bare and self.url[i]):
                return i
            heappop(heap)
        return None

    def _bare(self, heap: list[int], role: str, req: str | None = None) -> int:
        """The first row of a heap that has no URL and still has the role (and the requisition); else more than any."""
        while heap:
            i = heap[0]
            if not self.url[i] and self.role[i] == role and (req is None or self.req[i] == req):
                return i
            heappop(heap)
        return len(self.num)

    def find(self, num: int | None, role: str, report: str, url: str, req: str, e: str) -> tuple[int | None, str]:
        """The first row that an addition means, and the rule that says so."""
        if url and (i := self.by_url.get(url)) is not None:
            return i, "url"
        if not e:
            return None, "new"
        # no row has the addition's URL, so one with a URL has another
        if report and (i := self._by_report(e, report, bool(url))) is not None:
            return i, "report"
        none, near = len(self.num), self.like.get(role, ())
        if num is not None:
            old = self.old_number.get(num, none)
            first = old if old < none and self.employer[old] == e and not self.url[old] else none
            # a number asked for in this run may be asked for twice
            if asked := self.new_number.get((e, num)):
                for x in near if len(near) < len(asked) else asked:
                    if x in asked and x in near:
                        first = min(first, self._bare(asked[x], x))
            if first < none:
                return first, "number"
        first, roles = none, self.by_role.get(e, {})
        for x in near if len(near) < len(roles) else roles:
            if x in roles and x in near:
                every, by_req = roles[x]
                if not req:
                    first = min(first, self._bare(every, x))
                else:
                    for q in ("", req):
                        if q in by_req:
                            first = min(first, self._bare(by_req[q], x, q))
        return (first, "role") if first < none else (None, "new")

    def add(self, cells: tuple) -> None:
        seq, num, company, role, score, report, url, req, employer = cells
        i, rule = self.find(num, role, report, url, req, employer)
        if i is None:
            self.put(seq, cells)
            return
        self.rule[i] = self.rule[i] or rule
        before = self.score[i]
        if score is None and before is not None:
            self.skipped[i] = self.skipped.get(i, 0) + 1
            return
        if score is not None and before is not None and score < before and self.report[i] not in ("", report):
            self.superseded.setdefault(i, []).append(f"{self.report[i]} (was {before:g})")
        was = (self.employer[i], self.report[i], self.role[i], self.req[i])
        if rule in ("url", "report"):
            self.role[i] = role
        self.company[i], self.score[i], self.report[i] = company, score, self.reports.setdefault(report, report)
        self.employer[i] = employer or self.employer[i]
        self.req[i] = self.req[i] or req
        if url and not self.url[i]:
            self.url[i] = url
            self.by_url.setdefault(url, i)
        self.merged[i] += 1
        if (self.employer[i], self.report[i]) != was[:2]:
            self._name_report(i)
        if (self.role[i], self.req[i]) != was[2:]:
            self._name_role(i)

    def columns(self, start: int, stop: int) -> list[list]:
        """A slice of what becomes of the rows, in the order of _FOLDED."""
        span = range(start, min(stop, len(self.num)))
        plain = [c[start:stop] for c in (self.head, self.num, self.company, self.role, self.score, self.report, self.url, self.merged)]
        return [*plain, [self.skipped.get(i, 0) for i in span], [self.superseded.get(i, []) for i in span], self.rule[start:stop]]


_CELLS = ("seq", "num", "company", "role", "score", "report", "url", "req", "employer")
_FOLDED = "head long, num long, company string, role string, score double, report string, url string, merged long, skipped long, superseded array<string>, rule string"
#: Kinds of a unit's rows, in the order in which they come.
_PAIR, _OLD, _ADDED = -1, 0, 1


def _values(c: pa.Array) -> list:
    """The values of a column; a text that repeats in it is one object."""
    if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
        coded = c.dictionary_encode(null_encoding="encode")
        texts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        return [texts[i] for i in coded.indices.to_numpy().tolist()]
    plain = c.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    return [None if n else v for n, v in zip(c.is_null().to_numpy(zero_copy_only=False).tolist(), plain, strict=True)] if c.null_count else plain


def _fold(rows: Iterator[tuple]) -> _Rows:
    """The rows of a unit after its additions, one after the other."""
    state = _Rows()
    for _, kind, *cells, near in rows:
        if kind == _PAIR:
            state.pair(cells[3], near)
        elif kind == _OLD:
            state.put(None, cells)
        else:
            state.add(cells)
    return state


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the units of a partition that is sorted by unit, kind and order; one unit is held at a time."""
    schema = pa.schema([(n, pa.list_(pa.string()) if n == "superseded" else pa.string() if n in ("company", "role", "report", "url", "rule") else pa.float64() if n == "score" else pa.int64()) for n in (c.split()[0] for c in _FOLDED.split(", "))])
    done: list[list] = [[] for _ in schema]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, schema, strict=True)], schema=schema)
    rows = (r for b in batches for r in zip(*map(_values, b.columns), strict=True))
    for _, unit in groupby(rows, itemgetter(0)):
        state = _fold(unit)
        for start in range(0, len(state.num), 10_000):
            for column, more in zip(done, state.columns(start, start + 10_000), strict=True):
                column += more
            if len(done[0]) >= 10_000:
                yield batch()
                done = [[] for _ in schema]
    yield batch()


def merge_in_order(tracker: DataFrame, additions: DataFrame) -> DataFrame:
    """J11 in the order of seq: num, company, role, score, report, url, merged, skipped, superseded, rule.

    Takes what ``merge_additions`` takes and matches by the same four rules, but each addition sees what the earlier
    ones of the run did: rows that they added, and roles, reports, URLs and requisitions that they changed. So a match
    takes over company, score and report (by URL or report the role too) and fills an empty URL or requisition. An
    addition without a score leaves a scored row as it is (skipped); a lower score is noted with the report that it
    supersedes. The number of a row that this run added names it only together with a role like its own, and is
    the number that it asked for: numbers are dealt out afterwards, to free ones first, then above the greatest.

    Rows can only meet within an employer, or between employers that share a URL: such a unit is folded by one task,
    with only its matching pairs of distinct roles. Units without an addition stay where they are. A null company or
    role is empty, a null number names nothing. seq is unique and not null, as is the tracker's num.
    """
    num = F.col("num").cast("long").alias("num")
    text = [F.col(c) for c in ("company", "role", "report", "url", "req", "employer")]
    unit = F.when(F.col("employer") != "", F.col("employer")).when(F.col("url") != "", F.concat(F.lit("u:"), "url")).otherwise(F.concat(F.lit("s:"), F.col("seq").cast("string"), F.lit(":"), F.col("num").cast("string"), F.lit(":"), F.col("old").cast("string")))
    side = lambda df, seq, old: _sides(df.fillna("", ["company", "role"]), *seq).select(F.col("seq").cast("long").alias("seq") if seq else F.lit(0).cast("long").alias("seq"), num, *text, F.nanvl(F.col("score").cast("double"), F.lit(None)).alias("score"), F.lit(old).alias("old")).withColumn("own", unit)
    # read by several steps below
    both = stored(side(tracker, (), True).unionByName(side(additions, ("seq",), False)))
    # employers that share a URL are one unit
    owners = both.where("url <> ''").select("url", "own").distinct()
    ties = owners.join(owners.groupBy("url").agg(F.min("own").alias("least")), "url").where("own <> least").select(F.col("own").alias("u"), F.col("least").alias("v"))
    joined = components(ties).select(F.col("node").alias("own"), F.col("component").alias("unit"))
    placed = both.join(joined, "own", "left").withColumn("unit", F.coalesce("unit", "own")).drop("own")
    t, a = placed.where("old"), placed.where("not old")
    busy = a.select("unit").distinct()
    moved = t.join(busy, "unit", "left_semi")
    rest = t.join(busy, "unit", "left_anti")
    # roles may move between the employers of a unit, so they are compared by unit
    roles = lambda df: df.where("employer <> ''").select(F.col("unit").alias("employer"), "role")
    pairs = role_pairs(roles(a), roles(moved.unionByName(a)))
    cells = ["unit", "kind", *_CELLS, "like"]
    blank = {c: F.lit(None).cast("long" if c in ("seq", "num") else "double" if c == "score" else "string").alias(c) for c in cells[2:]}
    rows = lambda df, kind: df.select("*", F.lit(kind).alias("kind"), blank["like"]).select(*cells)
    like = pairs.select(F.col("employer").alias("unit"), F.lit(_PAIR).alias("kind"), F.col("role_a").alias("role"), F.col("role_b").alias("like"), *[v for c, v in blank.items() if c not in ("role", "like")]).select(*cells)
    # pairs of roles come first, tracker rows (seq 0) by number, additions by seq
    everything = rows(moved, _OLD).union(rows(a, _ADDED)).union(like).repartition("unit").sortWithinPartitions("unit", "kind", "seq", "num")
    done = stored(everything.mapInArrow(_folds, _FOLDED))
    free, others = _numbered(done.where("head is not null").withColumn("r", F.struct("num")), tracker, additions)
    out = ("company", "role", "score", "report", "url", "merged", "skipped", "superseded", "rule")
    idle = rest.select("num", "company", "role", "score", "report", "url", F.lit(0).cast("long"), F.lit(0).cast("long"), F.array().cast("array<string>"), F.lit(""))
    fresh = free.select(F.col("own").alias("num"), *out).union(others.select(F.col("own").alias("num"), *out))
    return done.where("head is null").select("num", *out).union(idle).union(fresh)
