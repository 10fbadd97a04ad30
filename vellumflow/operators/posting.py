"""Job postings: the gate of the domain, blocks by heading, requirement rows by block, level, organisation and degree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions import text as T
from vellumflow.operators import extract as E
from vellumflow.operators.parse import BULLET, segments

# Words of technical and of other occupations, each counted at most three times.
TECH_TERMS = [
    "engineer", "engineering", "developer", "development", "sde", "software", "programmer", "data scientist", "machine learning", "deep learning",
    "ml", "ai", "artificial intelligence", "devops", "sre", "site reliability", "cloud", "backend", "back end", "frontend", "front end",
    "full stack", "qa", "quality assurance", "test engineer", "data engineer", "platform engineer", "architect", "technical", "codebase", "api",
]
OTHER_TERMS = [
    "sales", "salesperson", "marketing", "human resources", "hr", "recruiter", "recruitment", "accountant", "accounting", "bookkeeping", "nurse",
    "nursing", "patient care", "teacher", "teaching", "tutor", "driver", "driving", "chef", "cook", "culinary", "customer support",
    "customer service", "receptionist", "cashier", "retail", "hospitality", "waiter", "housekeeping",
]
ANALYST_TERMS = [
    "analyst", "analytics",
]
ANALYST_TOOLS = [
    "sql", "python", "tableau", "power bi", "pandas", "numpy", "spark", "etl",
]
CAP, LEAST_SKILLS = 3, 3
# Headings of blocks, the preferred ones first.
BLOCKS = {
    "preferred": [
        "preferred qualifications", "preferred skills", "nice to have", "bonus points", "bonus", "desired skills", "good to have",
        "preferred experience", "pluses",
    ],
    "required": [
        "basic qualifications", "minimum qualifications", "required qualifications", "requirements", "qualifications", "what you need", "must have",
        "who you are", "required skills", "essential skills", "we are looking for",
    ],
    "responsibilities": [
        "responsibilities", "what you'll do", "what you will do", "the role", "your impact", "duties", "job description", "about the role",
        "day to day",
    ],
}
BASES = {"required": 0.9, "preferred": 0.7}
FALLBACK = 0.6
# Fixed value: what a heading looks like.
HEADING = r"^[ \t#*>-]*[A-Za-z][A-Za-z'’ \t/&]{3,45}[ \t]*:?[ \t]*$"
# Degrees from the highest, and what stands for them.
DEGREES = (
    ("phd", r"(?i)\b(?:ph\.? ?d\.?|doctorate|doctoral +degree)(?:$|[^a-z])"),
    ("master", r"(?i)\b(?:master'?s?(?: +degree)?|m\.?sc\.?|m\.?tech\.?|mba)\b|\b(?:m\.?s\.?|m\.?a\.?)(?: */ *(?:b\.?s\.?|ph\.?d\.?))? *(?:degree *)?in\b"),
    ("bachelor", r"(?i)\b(?:bachelor'?s?(?: +degree)?|b\.?sc\.?|b\.?tech\.?|undergraduate +degree)\b|\b(?:b\.?s\.?|b\.?a\.?|b\.?e\.?)(?: */ *(?:m\.?s\.?|m\.?a\.?))? *(?:degree *)?in\b"),
)


def signal_counts(df: DataFrame, key: str, column: str, groups: dict[str, list[str]]) -> DataFrame:
    """key and for each group of terms the sum of their whole-word occurrences, each term at most CAP.

    A text is cut into words once; its runs of up to as many words as the longest term has are looked up in a map.
    """
    terms = {t: g for g, ts in groups.items() for t in ts}
    most = max(len(t.split(" ")) for t in terms)
    words = df.select(key, F.regexp_extract_all(F.lower(F.regexp_replace(column, r"\s", " ")), F.lit(r"[a-z0-9_]+|[^a-z0-9_]+"), F.lit(0)).alias("w"))
    # a run of n words is 2n - 1 pieces, words and what stands between them
    pieces = [F.col("w") if n == 1 else F.when(F.size("w") >= 2 * n - 1, _runs_of(2 * n - 1)).otherwise(F.array().cast("array<string>")) for n in range(1, most + 1)]
    hits = words.select(key, F.filter(F.concat(*pieces), lambda x: x.isin(list(terms))).alias("h"))
    return hits.select(key, *[T.sum_columns([F.least(F.size(F.filter("h", _same(t))), F.lit(CAP)) for t in ts]).alias(g) for g, ts in groups.items()])


def _same(term: str):
    return lambda x: x == term


def _runs_of(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), ""))


def domain(df: DataFrame, key: str, column: str, n_skills: DataFrame) -> DataFrame:
    """key, n_tech, n_other, n_skills, is_tech, confidence of each posting. n_skills: key and how many listed skills it names."""
    s = signal_counts(df, key, column, {"a": TECH_TERMS, "n_other": OTHER_TERMS, "b": ANALYST_TERMS, "c": ANALYST_TOOLS})
    s = s.withColumn("n_tech", F.col("a") + F.when((F.col("b") > 0) & (F.col("c") > 0), F.col("b")).otherwise(0))
    s = s.join(n_skills.select(key, "n_skills"), key, "left").na.fill(0, ["n_skills"])
    tech = ~((F.col("n_skills") < LEAST_SKILLS) & (F.col("n_other") > F.col("n_tech")))
    share = F.least(F.lit(1.0), F.col("n_skills") / (2 * LEAST_SKILLS))
    margin = (F.col("n_tech") - F.col("n_other")) / 4
    yes = 50 + 35 * share + 15 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), margin))
    no = 50 + 35 * F.least(F.lit(1.0), -margin) + 15 * (1 - share)
    return s.select(key, F.col("n_tech").cast("bigint").alias("n_tech"), F.col("n_other").cast("bigint").alias("n_other"), F.col("n_skills").cast("bigint").alias("n_skills"), tech.alias("is_tech"), F.round(T.clamp(F.when(tech, yes).otherwise(no)), 4).alias("confidence"))


def block_of(line: Column) -> Column:
    """Block that a line opens, null if it's no heading."""
    low = F.lower(F.trim(F.trim(line, F.lit(" \t")), F.lit(":")))
    ok = F.length(low).between(1, 60) & ~line.rlike(BULLET) & (line.rlike(HEADING) | F.endswith(F.trim(line, F.lit(" \t")), F.lit(":")))
    kind = F.lit(None).cast("string")
    for name in reversed(list(BLOCKS)):
        kind = F.when(low.rlike("|".join(BLOCKS[name])), name).otherwise(kind)
    return F.when(ok, kind)


def blocks(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, pos, line, section (the block), is_bullet, is_blank of each line that isn't a heading."""
    t = df.where(F.col(column).isNotNull()).select(key, F.split(T.normalised(F.col(column)), "\n").alias("__l"))
    found = F.transform("__l", lambda x, i: F.struct(i.alias("i"), F.when(F.length(x) <= 120, block_of(x)).alias("section")))
    s = segments(t, key, "__l", F.filter(found, lambda m: m["section"].isNotNull()), "other").where("not mark")
    return s.select(key, "pos", "line", "section", F.col("line").rlike(BULLET).alias("is_bullet"), (F.trim("line", F.lit(" \t")) == "").alias("is_blank"))


def requirements(found: DataFrame, key: str) -> DataFrame:
    """key, skill, importance, tier out of the mentions by block: required before preferred before the rest, more for repeated mentions."""
    rank = F.when(F.col("section") == "required", 0).when(F.col("section") == "preferred", 1).otherwise(2)
    base = F.when(F.col("section") == "required", BASES["required"]).when(F.col("section") == "preferred", BASES["preferred"]).otherwise(FALLBACK)
    f = found.withColumn("r", rank).groupBy(key, "skill", "r").agg(F.sum("n").alias("n"), F.first(base).alias("base"))
    best = f.groupBy(key, "skill").agg(F.min(F.struct("r", "n", "base")).alias("x"))
    return best.select(key, "skill", F.round(F.least(F.lit(1.0), F.col("x.base") + F.least(F.lit(0.09), 0.03 * (F.col("x.n") - 1))), 3).alias("importance"), F.when(F.col("x.r") == 0, "required").otherwise("preferred").alias("tier"))


def level(text: Column, requested: str = "mid") -> Column:
    """Level that a posting asks for, by its words and its years."""
    low, years = F.lower(text), T.years_claimed(text)
    return (
        F.when(low.rlike("intern|internship|co-op"), "intern")
        .when(low.rlike("senior|staff|principal|lead engineer") | (years >= 5), "senior")
        .when(low.rlike("entry level|new grad|graduate|junior") | (years <= 1), "entry")
        .when((years >= 2) & (years < 5), "mid")
        .otherwise(requested)
    )


def degree(text: Column) -> Column:
    out = F.lit("none")
    for name, pattern in reversed(DEGREES):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def organisation(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"\bat[ \t]+([A-Z][A-Za-z0-9&.-]+(?:[ \t]+[A-Z][A-Za-z0-9&.-]+){0,2})", 1))


def role(text: Column) -> Column:
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 6), "\n")
    return F.trim(F.regexp_extract(head, r"\b((?:Senior|Staff|Lead|Junior)? *[A-Z][A-Za-z]+ +(?:Engineer|Developer|Scientist|Analyst|Architect))\b", 1))


def skills_named(df: DataFrame, key: str, column: str, ontology: DataFrame) -> DataFrame:
    """EXT-4: key, n_skills: distinct listed skills, without soft ones, that each text names."""
    lines = df.where(F.col(column).isNotNull()).select(key, F.col(column).alias("line"), F.lit("other").alias("section"), F.lit(False).alias("is_blank"))
    return E.mentions(lines, key, ontology).where("category <> 'soft'").groupBy(key).agg(F.count_distinct("skill").alias("n_skills"))
