"""Queries of document parsing: lines, sections, bullets, entries and contact details of all résumés."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.operators import parse as P
from vellumflow.plans import sqltwin as Q
from vellumflow.sources.files import read_files
from vellumflow.sources.tables import distinct_rows, table

AS_OF = "2026-01-01"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_rows(table(spark, sf_dir, "resumes").select("resume_id", "raw_text").where("raw_text is not null"), "resume_id")


def _lines(spark, sf_dir):
    return P.lines(_texts(spark, sf_dir), "resume_id", "raw_text")


def parsed_files(spark: SparkSession, path: str):
    """CPL-2: files below `path` to text and on to lines with their sections: path, pos, line, section, is_bullet, is_blank."""
    return P.lines(read_files(spark, path).where("text is not null").select("path", "text"), "path", "text")


def doc_sections(spark, sf_dir):
    """PRS-1, 2: lines, bullets and blanks of each section of each résumé."""
    n = _lines(spark, sf_dir).groupBy("resume_id", "section")
    return n.agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("is_bullet").alias("n_bullets"), F.count_if("is_blank").alias("n_blank"))


def doc_bullets(spark, sf_dir):
    """PRS-3: bullets of three words or more."""
    b = _lines(spark, sf_dir).where("is_bullet").select("resume_id", F.col("pos").cast("bigint").alias("pos"), P.bullet_text(F.col("line")).alias("bullet"))
    return b.where(F.size(F.filter(F.split("bullet", "[ \t]+"), lambda w: w != "")) >= 3)


def entry_islands(spark, sf_dir):
    """PRS-4, 5, 8: entries of experience and projects with their lines and bullets."""
    base = _lines(spark, sf_dir)
    both = [P.entries(base, "resume_id", s).withColumn("section", F.lit(s)) for s in ("experience", "projects")]
    e = both[0].unionByName(both[1])
    return e.groupBy("resume_id", "section", F.col("entry").cast("bigint").alias("entry")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("is_bullet").alias("n_bullets"), F.min("pos").cast("bigint").alias("first_pos"))


def experience_entries(spark, sf_dir):
    """PRS-6, 7, 15: jobs with title, organisation, dates, months and bullets."""
    e = P.experience(P.entries(_lines(spark, sf_dir), "resume_id", "experience"), "resume_id", AS_OF)
    return e.select("resume_id", F.col("entry").cast("bigint").alias("entry"), "title", "organisation", "date_range", F.col("months").cast("bigint").alias("months"), F.size("bullets").cast("bigint").alias("n_bullets"))


def project_entries(spark, sf_dir):
    """PRS-8: projects with name, technologies, bullets and a description (the bullets in one, or else the name)."""
    e = P.projects(P.entries(_lines(spark, sf_dir), "resume_id", "projects"), "resume_id")
    told = F.substring(F.when(F.size("bullets") > 0, F.array_join("bullets", " ")).otherwise(F.col("name")), 1, 600)
    return e.select("resume_id", F.col("entry").cast("bigint").alias("entry"), "name", "tech_hint", F.size("bullets").cast("bigint").alias("n_bullets"), told.alias("description"))


def education_entries(spark, sf_dir):
    """PRS-9: degrees with field, institution, year and score."""
    e = P.education(P.entries(_lines(spark, sf_dir), "resume_id", "education"), "resume_id")
    return e.select("resume_id", F.col("entry").cast("bigint").alias("entry"), "degree", "field", "institution", "year", "score")


def declared_terms(spark, sf_dir):
    """PRS-11: declared skills in order."""
    return P.skill_terms(_lines(spark, sf_dir), "resume_id").select("resume_id", F.col("ord").cast("bigint").alias("ord"), "term")


def total_experience(spark, sf_dir):
    """PRS-16, 17: months and entries of each résumé from its entry table, overlaps counted twice."""
    e = table(spark, sf_dir, "doc_entry").select("doc_id", "section", "entry", "duration_months").distinct()
    return e.groupBy("doc_id").agg(
        F.coalesce(F.sum(F.when(F.col("section") == "experience", F.col("duration_months"))), F.lit(0)).cast("bigint").alias("months"),
        *[F.count_if(F.col("section") == s).alias(f"n_{s}") for s in ("experience", "projects", "education")],
    )


_TEXTS = "(SELECT DISTINCT resume_id, raw_text FROM resumes WHERE raw_text IS NOT NULL)"
_WORDS = "len([w FOR w IN regexp_split_to_array({x}, '[ \\t]+') IF w <> ''])"


def _heading(line: str) -> str:
    cases = " ".join(f"WHEN {Q.quoted(p)} THEN {Q.quoted(s)}" for p, s in P.PHRASES)
    return f"""CASE WHEN length(st) BETWEEN 1 AND 60 AND NOT regexp_matches({line}, {Q.quoted(P.BULLET)}) AND ph <> '' AND (pl = ph OR (length(pl) - length(ph) <= 12 AND (upper(st) = st OR ends_with(st, ':') OR {_WORDS.format(x='st')} <= 4)))
      THEN CASE ph {cases} END END"""


_SQL_LINES = f"""
  t AS (SELECT resume_id, {Q.normalised('raw_text')} AS n FROM {_TEXTS}),
  l0 AS (SELECT resume_id, unnest(range(0, len(string_split(n, chr(10))))) AS pos, unnest(string_split(n, chr(10))) AS line FROM t),
  l1 AS (SELECT *, trim(line, ' |' || chr(9)) AS st FROM l0),
  l2 AS (SELECT *, lower(trim(regexp_replace(regexp_replace(st, '[^a-zA-Z& ]', ' ', 'g'), ' +', ' ', 'g'), ' ')) AS pl FROM l1),
  l3 AS (SELECT *, regexp_extract(pl, '^({P.LONGEST_FIRST})', 1) AS ph FROM l2),
  l4 AS (SELECT resume_id, pos, line, {_heading('line')} AS heading FROM l3),
  l5 AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY resume_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'header') AS section, trim(regexp_replace(line, '^[^A-Za-z]*[A-Za-z &/]+[:-][ \\t]*', ''), ' ') AS rest FROM l4),
  l6 AS (SELECT resume_id, pos, section, CASE WHEN heading IS NULL THEN line WHEN length(rest) > 3 AND contains(line, ':') THEN rest END AS line FROM l5),
  l AS (SELECT *, regexp_matches(line, {Q.quoted(P.BULLET)}) AS is_bullet, trim(line, ' ' || chr(9)) = '' AS is_blank FROM l6 WHERE line IS NOT NULL)
"""
_BTEXT = f"trim(regexp_replace(line, {Q.quoted(P.BULLET)}, ''), ' ' || chr(9))"


def _entries(section: str) -> str:
    detail = "is_bullet" + (f" OR regexp_matches(trim(line, ' ' || chr(9)), {Q.quoted(P.META)})" if section == "projects" else "")
    return f"""
  a1 AS (SELECT *, coalesce(lag(is_blank) OVER w, false) OR (coalesce(lag(is_bullet) OVER w, false) AND NOT is_bullet AND NOT is_blank) AS gap FROM l WHERE section = '{section}' WINDOW w AS (PARTITION BY resume_id ORDER BY pos)),
  a2 AS (SELECT *, sum(gap::INT) OVER (PARTITION BY resume_id ORDER BY pos) AS chunk FROM a1),
  a3 AS (SELECT *, bool_and({detail}) OVER (PARTITION BY resume_id, chunk) AS joins, row_number() OVER (PARTITION BY resume_id, chunk ORDER BY pos) AS r, dense_rank() OVER (PARTITION BY resume_id ORDER BY chunk) AS c FROM a2 WHERE NOT is_blank),
  e AS (SELECT resume_id, pos, line, is_bullet, chunk, (sum((r = 1 AND (c = 1 OR NOT joins))::INT) OVER (PARTITION BY resume_id ORDER BY pos) - 1)::BIGINT AS entry FROM a3)
"""


def _month(p: str) -> str:
    months = " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(P.MONTHS))
    x = f"lower(replace(trim({p}, ' '), '''', ''))"
    y = f"try_cast(regexp_extract({x}, '^[a-z]+[.]? *([0-9]{{2,4}})', 1) AS INT)"
    return f"""CASE WHEN {x} IN ('present', 'current', 'now', 'ongoing') THEN {int(AS_OF[:4]) * 12 + int(AS_OF[5:7])}
      WHEN regexp_extract({x}, '^([a-z]{{3}})[a-z]*[.]? *[0-9]{{2,4}}', 1) <> '' THEN (CASE WHEN {y} < 100 THEN {y} + 2000 ELSE {y} END) * 12 + CASE regexp_extract({x}, '^([a-z]{{3}})', 1) {months} ELSE 1 END
      WHEN regexp_matches({x}, '^[0-9]{{1,2}}/[0-9]{{4}}') THEN regexp_extract({x}, '^([0-9]{{1,2}})/([0-9]{{4}})', 2)::INT * 12 + regexp_extract({x}, '^([0-9]{{1,2}})/', 1)::INT
      WHEN regexp_matches({x}, '^(?:19|20)[0-9]{{2}}') THEN left({x}, 4)::INT * 12 + 6 END"""


_DR = Q.quoted(P.DATE_RANGE)
_EDGE = "' |,-–—'"

QUERIES = {f.__name__: f for f in (doc_sections, doc_bullets, entry_islands, experience_entries, project_entries, education_entries, declared_terms, total_experience)}
SQL = {
    "doc_sections": f"WITH {_SQL_LINES} SELECT resume_id, section, count(*) AS n_lines, count(*) FILTER (is_bullet) AS n_bullets, count(*) FILTER (is_blank) AS n_blank FROM l GROUP BY ALL",
    "doc_bullets": f"WITH {_SQL_LINES} SELECT resume_id, pos, {_BTEXT} AS bullet FROM l WHERE is_bullet AND {_WORDS.format(x=_BTEXT)} >= 3",
    "entry_islands": f"WITH {_SQL_LINES}, x AS (WITH {_entries('experience')} SELECT *, 'experience' AS section FROM e), y AS (WITH {_entries('projects')} SELECT *, 'projects' AS section FROM e)"
    " SELECT resume_id, section, entry, count(*) AS n_lines, count(*) FILTER (is_bullet) AS n_bullets, min(pos) AS first_pos FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY ALL",
    "experience_entries": f"""WITH {_SQL_LINES}, {_entries('experience')},
      k AS (SELECT *, first_value(chunk) OVER (PARTITION BY resume_id, entry ORDER BY pos) AS own FROM e),
      g AS (SELECT resume_id, entry, string_agg(line, chr(10) ORDER BY pos) FILTER (chunk = own) AS body, list(trim(line, ' ' || chr(9)) ORDER BY pos) FILTER (chunk = own AND NOT is_bullet) AS heads,
        list(line ORDER BY pos) FILTER (chunk = own) AS lines, count(*) FILTER (is_bullet) AS nb FROM k GROUP BY ALL),
      d AS (SELECT *, trim(regexp_extract(body, {_DR}), ' ') AS date_range, coalesce(array_to_string(heads[1:3], ' | '), '') AS head FROM g),
      h AS (SELECT *, trim(CASE WHEN date_range = '' THEN head ELSE replace(head, date_range, '') END, {_EDGE}) AS hd FROM d),
      p AS (SELECT *, [trim(q, {_EDGE}) FOR q IN regexp_split_to_array(regexp_replace(hd, ', ([A-Z])', ' | \\1', 'g'), ' \\| | [-–—] ') IF trim(q, {_EDGE}) <> ''] AS ps,
        CASE WHEN nb > 0 THEN nb ELSE len([q FOR q IN lines[2:] IF {_WORDS.format(x="trim(q, ' ' || chr(9))")} > 4]) END AS n_bullets FROM h),
      o AS (SELECT resume_id, entry, coalesce(left(ps[1], 120), '') AS title, coalesce(left(ps[2], 120), '') AS organisation, date_range, n_bullets,
        CASE WHEN date_range = '' THEN 0 ELSE coalesce(CASE WHEN mm < 0 THEN 0 WHEN mm > 480 THEN 480 ELSE mm END, 0) END::BIGINT AS months FROM (SELECT *, ({_month(f'regexp_extract(date_range, {_DR}, 2)')}) - ({_month(f'regexp_extract(date_range, {_DR}, 1)')}) AS mm FROM p))
      SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY entry) AS r FROM o WHERE title <> '' OR organisation <> '' OR n_bullets > 0) WHERE r <= 15""",
    "project_entries": f"""WITH {_SQL_LINES}, {_entries('projects')},
      g AS (SELECT resume_id, entry, list(line ORDER BY pos) AS ls, string_agg(line, chr(10) ORDER BY pos) AS body, list(is_bullet ORDER BY pos) AS bs FROM e GROUP BY ALL),
      h AS (SELECT *, trim(regexp_replace(trim(ls[1], ' ' || chr(9)), {Q.quoted(P.BULLET)}, ''), ' ' || chr(9)) AS head, len([b FOR b IN bs[2:] IF b]) AS nb FROM g)
      , k AS (SELECT *, left(trim(regexp_split_to_array(head, ' [|–—-] |:')[1], ' ' || chr(9)), 120) AS name, CASE WHEN nb > 0 THEN [trim(regexp_replace(q, {Q.quoted(P.BULLET)}, ''), ' ' || chr(9)) FOR q IN ls[2:] IF regexp_matches(q, {Q.quoted(P.BULLET)})] ELSE [trim(q, ' ' || chr(9)) FOR q IN ls[2:] IF {_WORDS.format(x="trim(q, ' ' || chr(9))")} > 4] END AS bl FROM h)
      SELECT resume_id, entry, name, left(CASE WHEN len(bl) > 0 THEN array_to_string(bl, ' ') ELSE name END, 600) AS description, trim(regexp_extract(body, {Q.quoted(P.TECH)}, 1), ' ' || chr(9)) AS tech_hint,
        CASE WHEN nb > 0 THEN nb ELSE len([q FOR q IN ls[2:] IF {_WORDS.format(x="trim(q, ' ' || chr(9))")} > 4]) END AS n_bullets FROM k WHERE entry < 15""",
    "education_entries": f"""WITH {_SQL_LINES}, {_entries('education')},
      g AS (SELECT resume_id, chunk, string_agg(line, chr(10) ORDER BY pos) AS t FROM e GROUP BY ALL),
      d AS (SELECT *, trim(regexp_extract(t, {Q.quoted(P.DEGREE)}, 1), ' ') AS degree FROM g),
      k AS (SELECT *, left(string_split(substring(t, instr(t, degree) + length(degree)), chr(10))[1], 90) AS after FROM d WHERE degree <> '' OR regexp_matches(t, '(?i)universit|college|institute|school')),
      o AS (SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY chunk) - 1 AS entry, degree, CASE WHEN degree = '' THEN '' ELSE trim(regexp_extract(after, '(?:in|of)[ \\t]+([A-Za-z&, \\t]{{3,45}})', 1), ' ,.|-') END AS field,
        regexp_extract(t, {Q.quoted(P.SCHOOL)}, 1) AS institution, coalesce(regexp_extract_all(t, '\\b((?:19|20)[0-9]{{2}})\\b', 1)[-1], '') AS year, trim(regexp_extract(t, {Q.quoted(P.GPA)}), ' ') AS score FROM k)
      SELECT * FROM o WHERE entry < 8""",
    "declared_terms": f"""WITH {_SQL_LINES}, s AS (SELECT resume_id, pos, regexp_split_to_array(regexp_replace({_BTEXT}, '^[A-Za-z &/]{{3,28}}:[ \\t]*', ''), '[,;|/•]|[ \\t]{{3,}}') AS ps FROM l WHERE section = 'skills' AND NOT is_blank),
      p AS (SELECT resume_id, pos, unnest(range(0, len(ps))) AS i, trim(unnest(ps), ' .-' || chr(9)) AS term FROM s),
      f AS (SELECT *, row_number() OVER (PARTITION BY resume_id, lower(term) ORDER BY pos, i) AS n FROM p WHERE length(term) BETWEEN 2 AND 40)
      SELECT * FROM (SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY pos, i) - 1 AS ord, term FROM f WHERE n = 1) WHERE ord < 120""",
    "total_experience": "SELECT doc_id, coalesce(sum(duration_months) FILTER (section = 'experience'), 0)::BIGINT AS months, count(*) FILTER (section = 'experience') AS n_experience, count(*) FILTER (section = 'projects') AS n_projects, count(*) FILTER (section = 'education') AS n_education FROM (SELECT DISTINCT doc_id, section, entry, duration_months FROM doc_entry) GROUP BY ALL",
}
