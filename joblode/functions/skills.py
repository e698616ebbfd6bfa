"""Skills named in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Skills, certificates and methods, longer forms of a family first.
NAMES = (
    "JavaScript", "TypeScript", "Python", "Ruby", "Java", "Rust", "PHP", "Kotlin", "Swift", "Scala", "Elixir", "C++", "C#", ".NET", "SQL",
    "React Native", "React", "Angular", "Vue.js", "Svelte", "Next.js", "Django", "Flask", "FastAPI", "Rails", "Laravel", "Symfony", "Spring", "Node.js",
    "MongoDB", "MySQL", "PostgreSQL", "Redis", "Elasticsearch", "Snowflake", "BigQuery", "Databricks", "DynamoDB", "Cassandra", "GraphQL", "gRPC", "Kafka", "RabbitMQ",
    "AWS", "GCP", "Azure", "Docker", "Kubernetes", "Terraform", "Ansible", "Helm", "Jenkins", "GitHub Actions", "GitLab CI", "CI/CD", "Prometheus", "Grafana", "Datadog", "Supabase", "Inngest",
    "PyTorch", "TensorFlow", "scikit-learn", "Pandas", "NumPy", "Spark", "Airflow", "dbt", "MLOps", "MLflow", "LangChain", "LlamaIndex", "Hugging Face", "RAG", "LLMs", "Prompt Engineering", "Fine-tuning", "Computer Vision", "NLP",
    "Tableau", "Power BI", "Looker", "Salesforce", "SAP",
    "PMI-ACP", "PgMP", "CAPM", "PMBOK", "PMP", "PRINCE2", "Certified ScrumMaster", "CSPO", "ITIL", "COBIT", "TOGAF", "Lean Six Sigma", "Six Sigma", "CISSP", "CISM", "CIPP",
)
#: Other spellings of them.
SPELLINGS = {
    "golang": "Go", "vuejs": "Vue.js", "nextjs": "Next.js", "nodejs": "Node.js", "postgres": "PostgreSQL", "k8s": "Kubernetes", "llm": "LLMs", "finetuning": "Fine-tuning",
    "pmi acp": "PMI-ACP", "prince 2": "PRINCE2", "certified scrum product owner": "CSPO", "certified scrum master": "Certified ScrumMaster", "lean six-sigma": "Lean Six Sigma", "six-sigma": "Six Sigma",
}
SKILLS = {n.lower(): n for n in NAMES} | SPELLINGS
#: Names that are common words in any other spelling.
EXACT = ("Go", "SAFe")


def _quoted(x: str) -> str:
    return "".join("\\" + c if c in r"\.^$*+?{}[]|()-#&~/" else c for c in x)


def _branches(words: list[str]) -> str:
    """A pattern of the words that tries each first letter once, and longer words first, as an alternation of them would."""
    heads = sorted({w[0] for w in words if w}, reverse=True)
    found = [_quoted(h) + _branches([w[1:] for w in words if w[:1] == h]) for h in heads]
    if "" in words:
        return "(?:" + "|".join(found) + ")?" if found else ""
    return found[0] if len(found) == 1 else "(?:" + "|".join(found) + ")"


PATTERN = "(?:^|[^a-z0-9])(" + _branches(list(SKILLS)) + ")(?=[^a-z0-9+#]|$)"


def extract(text: Column) -> Column:
    """Distinct canonical skills in order of mention; one pass of one alternation, longest first.

    ``Go`` and ``SAFe`` count only in these spellings, after the others.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PATTERN), 1)
    table = F.create_map(*[F.lit(x) for kv in SKILLS.items() for x in kv])
    exact = F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(rf"(^|[^A-Za-z0-9]){n}([^A-Za-z0-9-]|$)"), n) for n in EXACT]))
    return F.array_distinct(F.concat(F.transform(found, lambda w: F.element_at(table, w)), exact))


HEADING = r"(?i)^\s*#*\s*\**(requirements|qualifications|what you.ll need|what you bring|must have|skills)\b.*$"
OTHER = r"(?i)^\s*#*\s*\**(about|benefits|responsibilities|what we offer|who we are|perks|how to apply)\b.*$"


def requirement_candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, candidate, n: capitalised terms in bullets below requirement headings.

    A line belongs to the last heading above it.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    kind = F.when(F.col("line").rlike(HEADING), True).when(F.col("line").rlike(OTHER), False)
    lines = lines.withColumn("wanted", F.last(kind, ignorenulls=True).over(W.partitionBy(key).orderBy("at")))
    bullets = lines.where(F.col("wanted") & F.col("line").rlike(r"^\s*[-*•]\s"))
    terms = F.regexp_extract_all("line", F.lit(r"\b([A-Z][A-Za-z0-9+#.]{2,})\b"), 1)
    stop = ("The", "And", "You", "Your", "With", "For", "Our", "Have", "This", "That")
    return bullets.select(key, F.explode(terms).alias("candidate")).where(~F.col("candidate").isin(*stop)).groupBy(key, "candidate").agg(F.count("*").alias("n"))
