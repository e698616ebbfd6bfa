"""Operator inputs derived from the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def pick(key: str, values) -> str:
    """The value that an integer key deals out, as a CASE expression."""
    lines = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)) for i, v in enumerate(values))
    return f"CASE CAST(({key}) % {len(values)} AS INT) {lines} END"


LEVELS = ("", "Senior ", "Junior ", "Staff ", "Principal ", "Lead ", "Associate ", "Head of ", "Sr. ", "Intern, ", "Entry-Level ")
ROLES = ("Software Engineer", "Data Engineer", "Solutions Architect", "Sales Lead", "Product Manager", "AI Engineer", "QA Analyst", "Customer Success Manager", "Director of Engineering", "SRE", "Machine Learning Engineer", "Member of Technical Staff", "Graduate Program Analyst")
TAILS = ("", " - Remote", " (Austin, TX)", ", Platform", ", Payments (CI/CD)", " II", " - Contract", " Part-time")
COMPANIES = (
    "Acme Inc.", "ACME, Inc", "Globex Technologies LLC", "Globex Technology", "Initech Co.", "AT&T", "IBM", "International Business Machines Corp", "Umbrella Group Ltd", "Stark Labs",
    "Wayne Holdings", "Hooli (formerly Nucleus)", "Soylent S.A.", "LinkedIn Jobs", "Confidential", "Apex Staffing Solutions", "Widget Partners", "Epic Systems", "Epic Games", "?", "",
)
PLACES = (
    "Austin, TX", "Remote", "Remote - United States", "Berlin, Germany", "New York, New York", "London, UK", "Bangalore, India", "", "Hybrid - Boston, MA", "Toronto, Canada",
    "San Francisco, CA, USA", "US Remote", "Worldwide", "On-site, Denver, Colorado", None, "EMEA",
)
TEXTS = (
    "We use Python, SQL and Apache Spark on AWS. Full-time role. Visa sponsorship available for strong people.",
    "Contract role with Kubernetes, Docker and Go. No sponsorship is offered. You must be located in Germany.",
    "Our stack is Java, Kafka and React. Part-time is possible. We will sponsor an H-1B.",
    "Design platform services in Rust and PostgreSQL; lead a team of 8 people. 5+ years of experience, degree required.",
    "", None,
    "Sales of cloud products. PHP is a plus. Only open to candidates in France; unable to sponsor.",
    "Machine learning with PyTorch and TensorFlow, internship of 3 months. Remote within the United States.",
)
PAYS = ("$120,000 - $150,000", "80-90k EUR", "45.000,00 EUR", "450k SEK", "", "competitive", "82.5k", "$95,500", None, "n/a")
STATUSES = ("Applied", "**Applied**", "aplicado 2024-01-05", "Interview", "entrevista", "Rejected", "rechazado", "Offer", "Evaluated", "HOLD", "duplicado #12", "geo blocker", "Responded", "", "Hired", "mystery", "SKIP", "descartada")
HOSTS = ("jobs.example.com", "boards.greenhouse.io", "www.acme.com", "bit.ly", "careers.globex.io", "acme.wd5.myworkdayjobs.com")

POSTINGS = f"""
SELECT o_orderkey AS id,
  concat({pick("o_orderkey * 7 + 3", LEVELS)}, {pick("o_orderkey * 5 + o_custkey", ROLES)}, {pick("o_orderkey * 3 + 1", TAILS)}) AS title,
  {pick("o_custkey", COMPANIES)} AS company,
  {pick("o_orderkey * 3 + o_custkey", PLACES)} AS location,
  {pick("o_orderkey + 2 * o_custkey", TEXTS)} AS description,
  {pick("o_orderkey + o_custkey", PAYS)} AS pay,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 'not a url' ELSE
    concat(CASE WHEN o_orderkey % 2 = 0 THEN 'https://' ELSE 'HTTP://' END, {pick("o_custkey + o_orderkey", HOSTS)},
      {pick("o_orderkey * 11 + 5", ("/jobs/view/", "/Careers/Job/", "/job/Hyderabad-Telangana-India/Req-", "/p/", "/job/Austin-TX/"))}, CAST(o_orderkey % 5000 AS VARCHAR(20)),
      {pick("o_orderkey * 13 + 7", ("", "/", "?utm_source=feed&gh_jid=77", "?b=2&a=1#top", "?ref=x", "/?lang=en&trk=9"))}) END AS url,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS posted,
  {pick("o_orderkey", ("board_a", "board_b", "site", "feed", "mail"))} AS source,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE round(o_totalprice / 4, 0) END AS pay_min,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice / 3, 0) END AS pay_max,
  {pick("o_orderkey", ("USD", "EUR", "", "usd"))} AS currency
FROM orders"""

APPLICATIONS = f"""
SELECT o_orderkey AS num, CAST(o_orderdate AS DATE) AS applied, {pick("o_custkey", COMPANIES)} AS company, o_custkey AS company_id,
  concat({pick("o_orderkey * 7 + 3", LEVELS)}, {pick("o_orderkey * 5 + o_custkey", ROLES)}) AS role,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE round(CAST(1 + (o_orderkey * 37 % 41) / 10.0 AS DOUBLE), 1) END AS score,
  {pick("o_orderkey * 11 + o_custkey", STATUSES)} AS status_text,
  {pick("o_orderkey * 3 + o_custkey", ("board", "agency", "referral", "", "direct"))} AS via,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('r', CAST(o_orderkey % 9000 AS VARCHAR(20)), '.md') END AS report,
  {pick("o_orderkey", ("Applied 2001-09-01", "sent; applied ~2001-08-20 by mail", "see #12 applied 2001-01-01", "", "no date"))} AS notes
FROM orders"""

#: One row a user and event: an append-only ledger whose order is seq.
LEDGER = f"""
SELECT event_id AS seq, user_id AS num, CAST(ts AS DATE) AS day,
  CASE WHEN event_id % 23 = 0 THEN '-' ELSE CASE event_type WHEN 'view' THEN 'Applied' WHEN 'click' THEN 'Responded' WHEN 'signup' THEN 'Interview' WHEN 'purchase' THEN 'Offer' ELSE 'Rejected' END END AS state,
  {pick("event_id * 3 + user_id", ("manual", "agent", "correction", "import", "guess"))} AS source
FROM events"""

HEALTH = """
SELECT event_id AS seq, ts, user_id % 40 AS portal,
  CASE event_type WHEN 'view' THEN 'reachable' WHEN 'click' THEN 'empty' WHEN 'signup' THEN 'timeout' WHEN 'purchase' THEN 'blocked' ELSE 'error' END AS status
FROM events"""

VIEWS = {"postings": POSTINGS, "applications": APPLICATIONS, "ledger": LEDGER, "health": HEALTH}


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a query over the driver's tables and the derived views that it names."""
    import re

    names = {}
    for _ in range(3):
        for view, text in VIEWS.items():
            sql = re.sub(rf"\b(FROM|JOIN) {view}\b", lambda m, t=text, v=view: f"{m[1]} ({t}) {v}", sql)
    for table in TABLES:
        if re.search(rf"\b(FROM|JOIN) {table}\b", sql):
            names[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)
    return spark.sql(sql, **names)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frame(spark, sf_dir, VIEWS[name])


def _filters(sql: str) -> str:
    """count_if(test) as a filtered count, whose type in DuckDB is a plain long."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + 9 : end - 1]}){sql[end:]}"
    return sql


def duck(sql: str) -> str:
    """SQL for DuckDB, with the views that it names as common table expressions."""
    import re

    sql = _filters(sql)
    used = [v for v in VIEWS if re.search(rf"\b(FROM|JOIN) {v}\b", sql)]
    if not used:
        return sql
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    return f"WITH {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"
