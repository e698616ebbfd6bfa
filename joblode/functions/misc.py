"""Postings, replies, funding news, profiles, dates and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode.functions import phrases, place, web
from joblode.functions.company import company_key
from joblode.functions.text import once, words_only

#: A fetched page as the liveness rules see it, from the pages table.
FETCHED = "SELECT page_id, CASE CAST(page_id % 17 AS INT) WHEN 3 THEN 404 WHEN 5 THEN 503 WHEN 7 THEN 502 ELSE 200 END AS st, concat(url, '/1234567') AS req, CASE CAST(page_id % 13 AS INT) WHEN 2 THEN 'https://x.example/search' WHEN 4 THEN concat(url, '/1234567?error=true') ELSE concat(url, '/1234567') END AS fin, concat(CASE CAST(page_id % 11 AS INT) WHEN 1 THEN 'Just a moment... ' WHEN 2 THEN 'This job has expired. ' WHEN 3 THEN 'Apply now ' WHEN 4 THEN '24 jobs found ' WHEN 5 THEN 'The position you want has been filled ' ELSE '' END, CASE WHEN page_id % 3 = 0 THEN html ELSE 'short' END) AS body FROM pages"


def normalised_posting(df: DataFrame) -> DataFrame:
    """Raw postings (id, title, company, location, description, url, source, pay_min, pay_max, currency, posted)
    in the common shape, with a salary struct and a posting_id of source and native id, URL or title."""
    native, title, url = web.native_id(F.col("url")), F.trim("title"), F.trim(F.coalesce("url", F.lit("")))
    city, state, country = place.city_state_country(F.col("location"))
    text = F.concat(title, F.lit(" "), F.coalesce("description", F.lit("")))
    own = F.when(native != "", native).when(url != "", url).otherwise(title)
    return df.select(
        "id", F.concat("source", F.lit(":"), own).alias("posting_id"), title.alias("title"), F.trim(F.coalesce("company", F.lit(""))).alias("company"), F.trim(F.coalesce("location", F.lit(""))).alias("location"),
        city.alias("city"), state.alias("state"), country.alias("country"), place.workplace(F.col("location"), title).alias("workplace"), place.employment(text).alias("employment"),
        F.struct(F.col("pay_min").alias("min"), F.col("pay_max").alias("max"), F.upper("currency").alias("currency")).alias("salary"), F.trim(F.coalesce("description", F.lit(""))).alias("description"),
        url.alias("url"), "source", native.alias("native_id"), "posted",
    )


def provenance(posting: DataFrame) -> DataFrame:
    """P5: normalised postings with where they came from."""
    return posting.withColumn("provenance", F.struct(F.col("url").alias("origin_url"), F.col("url").alias("apply_url"), "source", F.array("source").alias("sources"), "native_id", F.col("company").alias("employer"), "posted"))


def location_area(location: Column) -> Column:
    loc = F.lower(F.coalesce(location, F.lit("")))
    code = F.regexp_extract(loc, r",\s*([a-z]{2})\b", 1)
    words = F.substring(F.trim(F.regexp_replace(loc, "[^a-z]+", " ")), 1, 40)
    plain = once(words, lambda w: F.when(w == "", "unknown").otherwise(w))
    return once(code, lambda c: F.when(c != "", c).when(loc.rlike(r"\bremote\b"), "remote").otherwise(plain))


def canonical_key(company: Column, title: Column, location: Column, posted: Column, name: Column | None = None) -> Column:
    """Employer, title, area and day of an opportunity; empty without a title. name: the company's key where it is known."""
    name, words = company_key(company) if name is None else name, words_only(title)
    day = F.coalesce(F.date_format(posted, "yyyy-MM-dd"), F.lit("undated"))
    employer = once(name, lambda n: F.when(n == "", "unknown-employer").otherwise(n))
    return once(F.coalesce(words, F.lit("")), lambda w: F.when(w == "", "").otherwise(F.concat_ws("::", employer, w, location_area(location), day)))


def vendor(host: Column) -> Column:
    """Kind of site by host."""
    return F.when(host.rlike(r"(^|\.)(greenhouse\.io|lever\.co|ashbyhq\.com)$"), "ats").when(host.rlike(r"^blog\."), "blog").when(host.rlike(r"^m\."), "mobile").when(host == "", "unknown").otherwise("site")


def size_band(text: Column) -> Column:
    n = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), 1), lambda x: x.try_cast("long")))
    return F.when(n.isNull(), "unknown").when(n < 50, "small").when(n < 500, "medium").otherwise("large")


APPLIED = r"(?i)\bapplied\s+~?(\d{4}-\d{2}-\d{2})"


def applied_date(notes: Column, num: Column, fallback: Column) -> Column:
    """The day an application went out by its notes, else the fallback.

    The first applied date in a clause that refers to no other entry (``#12``).
    """

    def own(clause: Column) -> Column:
        others = F.filter(F.regexp_extract_all(clause, F.lit(r"#(\d+)\b"), 1), lambda x: x != num.cast("string"))
        return F.when(clause.rlike(APPLIED) & (F.size(others) == 0), F.regexp_extract(clause, APPLIED, 1))

    found = F.filter(F.transform(F.split(F.coalesce(notes, F.lit("")), r"[;.\n]"), own), lambda x: x.isNotNull())
    return F.coalesce(F.try_to_date(F.get(found, F.lit(0)), "yyyy-MM-dd"), fallback)


#: Kind of reply, state that it suggests (None: by its words), signal of a mail filter, and phrases; the
#: first kind that fits is the reply's.
REPLIES = (
    ("Noise", "none", "", (
        "邀请投递", "抢面试先机", "近期热招", "立即投递", "热招职位", "订阅职位", "职位推荐", "推荐职位",
        "job alert", "invitation to apply", "recommended jobs", "newsletter", "marketing digest", "job recommendation", "suggested jobs",
    )),
    ("Rejected", "Rejected", "rejection", (
        "很遗憾", "暂不匹配", "不合适", "未能进入下一轮", "感谢您的时间", "未通过", "不再考虑", "决定不推进",
        "unfortunately", "not a match", "not matching", "decided not to proceed", "will not be moving forward", "position has been filled", "role has been closed", "unable to offer",
    )),
    ("Offer", "Offer", "offer", (
        "录取通知书", "录用信", "录用通知", "录用", "薪资确认", "入职协议", "意向书",
        "offer letter", "employment agreement", "job offer", "congratulations on the offer", "compensation details", "pleased to offer",
    )),
    ("Auto-confirmation", "none", "", (
        "自动回复", "收到您的申请", "申请已收到", "投递成功", "确认收到",
        "thank you for applying", "application received", "received your application", "auto-confirmation", "confirmation of application", "automatic reply",
    )),
    ("Need Action", None, "", (
        "补充信息", "提供信息", "完成测评", "在线测评", "笔试题", "做个测试", "截止日期前", "截止时间",
        "complete a form", "provide information", "finish an assessment", "coding challenge", "online test", "respond by a deadline", "pick a time", "schedule a time", "book a time",
        "complete assessment", "take a test", "assessment", "coding test", "deadline", "fill out", "complete the form", "provide details", "submit info",
    )),
    ("Interview", "Interview", "interview_invite", (
        "邀您面试", "邀约面试", "微信小程序面试", "ai微信小程序", "面试形式", "面试时间", "面试时长", "安排面试", "预约面试", "首轮面试", "视频面试", "电话面试", "现场面试", "面试邀请", "面试流程", "简历通过",
        "interview invitation", "schedule an interview", "scheduling link", "ai interview", "video interview", "phone screen", "onsite interview", "final round", "invite you to interview", "interview request", "interview schedule",
    )),
    ("Responded", "Responded", "update", ("联系您", "回复您", "想沟通", "想聊聊", "进一步沟通", "would like to chat", "reach out", "connect with you", "hiring manager responded")),
)
#: Words of a reply that wants an action, by which it is about a time to meet.
SCHEDULING = ("schedule", "pick a time", "book a time", "book a slot", "choose a time", "select a time", "appointment", "预约", "选择时间", "选择面试", "安排时间")


def reply_class(text: Column, signal: Column | None = None) -> tuple[Column, Column, Column]:
    """Kind of a reply by the first family with a phrase in it (or with its signal), the phrases found, and the
    state that it suggests."""
    t, sign = F.lower(F.coalesce(text, F.lit(""))), F.coalesce(signal, F.lit("")) if signal is not None else F.lit("")
    soon = F.when(F.exists(F.array(*map(F.lit, SCHEDULING)), lambda w: F.contains(t, w)), "Interview").otherwise("Responded")
    kind = evidence = state = None
    for name, suggests, own, said in REPLIES:
        signed = (sign == own) & F.lit(own != "")
        hits = F.filter(F.array(*map(F.lit, said)), lambda p: F.contains(t, p))
        hits = F.when(signed, F.array_union(hits, F.array(F.lit(own)))).otherwise(hits) if own else hits
        test = F.size(hits) > 0
        after = soon if suggests is None else F.lit(suggests)
        kind, evidence, state = ((F.when(test, x) if y is None else y.when(test, x)) for x, y in ((F.lit(name), kind), (hits, evidence), (after, state)))
    return kind.otherwise("Unknown"), evidence.otherwise(F.array().cast("array<string>")), state.otherwise("Needs Review")


#: Phrases of mails: those that reject by themselves, those that do by two, and those that invite.
MAIL_PHRASES = {
    "strong": (
        "not been selected to advance", "not selected for this position", "not selected for this role", "not moving forward with your application", "decided not to move forward", "decided to move forward with other candidates",
        "pursue other candidates", "pursuing other candidates", "other candidates whose qualifications", "not able to offer you a position",
    ),
    "weak": ("unfortunately", "not been selected", "will not be moving forward", "not successful", "regret to inform", "will not be proceeding", "unable to offer you"),
    "invite": (
        "schedule your phone screen", "schedule your interview", "phone screen", "interviewing with", "interview with", "would like to invite you", "invite you to interview", "next steps in the interview process",
        "move you forward to the next round", "like to set up a time", "like to set up a call", "book a time",
    ),
}


def mail_class(df: DataFrame, text: str) -> DataFrame:
    """Mails with classification (invite, rejection or unknown), matched (phrases) and strength (strong, weak or null).

    One strong phrase rejects, or two different weak ones; a rejection goes before an invitation.
    """
    found = df.withColumn("_hits", phrases.hits(F.lower(F.coalesce(F.col(text), F.lit(""))), MAIL_PHRASES))
    of = lambda kind: F.filter(F.array(*map(F.lit, MAIL_PHRASES[kind])), lambda p: F.exists("_hits", lambda h: h["phrase"] == p))
    found = found.withColumns({f"_{k}": of(k) for k in MAIL_PHRASES})
    sure = F.size("_strong") > 0
    rejects, invites = sure | (F.size("_weak") >= 2), F.size("_invite") > 0
    named = F.when(rejects, "rejection").when(invites, "invite").otherwise("unknown")
    matched = F.when(rejects, F.concat("_strong", "_weak")).when(invites, F.col("_invite")).otherwise(F.array().cast("array<string>"))
    out = found.withColumns({"classification": named, "matched": matched, "strength": F.when(sure, "strong").when(rejects, "weak")})
    return out.drop("_hits", *[f"_{k}" for k in MAIL_PHRASES])


def board_comments(df: DataFrame, body: str) -> DataFrame:
    """Company, role and location (without web addresses) of a comment's first line, and its first URL.

    The line reads ``company | role | location``; without a bar it names none of them.
    """
    first = F.split(F.split(F.coalesce(body, F.lit("")), "\n")[0], r"\|")
    cell = lambda i: F.trim(F.coalesce(F.get(first, F.lit(i)), F.lit("")))
    barred = F.size(first) > 1
    place = F.trim(F.regexp_replace(cell(2), r"(?i)https?://\S+", ""))
    return df.select("*", F.when(barred, cell(0)).otherwise("").alias("company"), F.when(barred, cell(1)).otherwise("").alias("role"), place.alias("location"), F.regexp_extract(body, r"(?i)(https?://[^\s<>\"]+)", 1).alias("url"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"


def hygiene(text: Column) -> tuple[Column, Column]:
    """Text without mail addresses and phone numbers, and the names of what was wrong."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, EMAIL, " "), PHONE, " "), r"\s+", " "))
    return clean, F.array_compact(F.array(F.when(F.trim(text) == "", "empty"), F.when(text.rlike(EMAIL), "email"), F.when(text.rlike(PHONE), "phone")))


def evidence(posting: DataFrame) -> DataFrame:
    """Which fields and signals a posting has."""
    d = F.lower(F.coalesce("description", F.lit("")))
    return posting.select(
        "*", (F.trim(d) != "").alias("has_text"), (F.coalesce("url", F.lit("")) != "").alias("has_url"), F.col("pay_min").isNotNull().alias("has_pay"),
        d.rlike(r"\b\d+\+?\s+years?\b").alias("years"), d.rlike(r"\b(degree|bachelor|master|phd)\b").alias("degree"), d.rlike(r"\b(certified|certification|certificate)\b").alias("cert"),
    )


def iso_week(day: Column) -> Column:
    """ISO year and week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def week_range(day: Column) -> tuple[Column, Column]:
    start = F.date_trunc("week", day).cast("date")
    return start, F.date_add(start, 6)


def profiles(df: DataFrame) -> DataFrame:
    """Profiles with trimmed lists and a completeness between 0 and 1, the share of seven checks that hold.

    roles, seniority, skills (technologies count too), areas (of work or domains), years, pay, and places (or ways of
    work); lists are written with semicolons.
    """
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    df = df.select("*", *[listed(F.col(c)).alias(n) for c, n in (("roles", "target_roles"), ("skills", "skill_list"), ("areas", "area_list"), ("places", "place_list"))])
    df = df.withColumn("seniority", F.lower(F.trim(F.coalesce("seniority", F.lit("")))))
    checks = (*(F.size(n) > 0 for n in ("target_roles", "skill_list", "area_list", "place_list")), F.col("seniority") != "", F.col("years") >= 0, F.col("pay") > 0)
    hits = sum(F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0) for c in checks)
    return df.withColumn("confidence", F.floor(100 * hits / F.lit(float(len(checks))) + 0.5) / 100)


def json_map(c: Column) -> Column:
    """A JSON object as a map of strings; anything else is an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def typed_companies(df: DataFrame, typed: str) -> DataFrame:
    """One row for each company that a person typed."""
    names = df.withColumn("name", F.explode(F.split(typed, r"\s*(,|;|\band\b)\s*")))
    return names.withColumn("name", F.trim(F.regexp_replace("name", r"(?i)^(please |add |scan |also )+", ""))).where("name <> ''")


def company_match(a: Column, b: Column) -> Column:
    """Equal keys, or the shorter (4 characters or more) within the longer."""
    return F.when(a == b, True).when(F.length(a) < F.length(b), (F.length(a) >= 4) & F.contains(b, a)).otherwise((F.length(b) >= 4) & F.contains(a, b))
