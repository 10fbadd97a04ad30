"""Further facts of résumés and postings: places, warnings, entities, keywords, duties, degrees, axes and assembled requirements."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.functions import text as T
from vellumflow.operators import extract as E
from vellumflow.operators import parse as P
from vellumflow.operators import posting as J
from vellumflow.operators import requirements as R
from vellumflow.operators import scores as S
from vellumflow.plans import matching, parsing, targets, texts
from vellumflow.plans import sqltwin as Q
from vellumflow.plans.scores import POSTINGS
from vellumflow.sources.tables import table

# What a contact line, a label, a part that is no place and a place look like.
CONTACT = r"(?i)@|\||\+[0-9]|linkedin|github|https?://"
LABEL = r"^[A-Za-z][A-Za-z &/]{2,28}:"
NO_PLACE = r"(?i)@|linkedin|github|https?://|[0-9]{4}"
PLACE = r"^ *([A-Z][a-z]+(?:[ -][A-Z][a-z]+)?(?:, *(?:[A-Z][a-z]+|[A-Z]{2}))?) *$"
LINKEDIN = r"(?i)(?:https?://)?(?:[A-Za-z0-9_.]*\.)?linkedin\.[a-z]+/[A-Za-z0-9_/%.-]+"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[A-Za-z0-9_/%.-]+"
URL = r"(?i)https?://[A-Za-z0-9_/%.?=&#~+-]+"
# Fields of a degree, and what stands for it.
FIELDS = (
    ("Computer Science", r"(?i)computer +science|\bcs\b|computer +engineering"), ("Data Science", r"(?i)data +science"), ("Mathematics or Statistics", r"(?i)mathematic|\bmaths?\b|statistic"),
    ("Engineering", r"(?i)engineering"), ("Information Technology", r"(?i)information +technology"), ("Related technical field", r"(?i)related +(?:technical +)?field"),
)
EQUIVALENT = r"(?i)or +equivalent|equivalent +(?:practical +)?experience|or +relevant +(?:work +)?experience|in +lieu +of +a +degree"
# Phrases of any posting.
BOILERPLATE = [
    "equal opportunity", "reasonable accommodation", "background check", "cover letter", "compensation package", "benefit package", "click apply", "job type", "full time",
]
NEEDED = ("skills", "experience", "education")
LISTS = ("summary", "certifications", "achievements", "publications", "leadership")


def locations(spark, sf_dir):
    """PRS-14: the place that a contact line among a text's first six lines names, '' if none does."""
    t = parsing._texts(spark, sf_dir).select("resume_id", F.slice(F.split(T.normalised(F.col("raw_text")), "\n"), 1, 6).alias("ls"))
    lines = F.filter(F.transform("ls", lambda x: F.trim(x, F.lit(" \t"))), lambda x: (x != "") & ~x.rlike(LABEL) & x.rlike(CONTACT))
    parts = F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, r" *\| *"))), lambda x: ~x.rlike(NO_PLACE))
    places = F.filter(F.transform(parts, lambda x: F.regexp_extract(x, PLACE, 1)), lambda x: x != "")
    return t.select("resume_id", F.coalesce(F.get(places, F.lit(0)), F.lit("")).alias("location"))


def contact_details(spark, sf_dir):
    """PRS-12: e-mail address, phone number, profiles and another address out of each text, '' where there are none."""
    t = parsing._texts(spark, sf_dir).select("resume_id", T.normalised(F.col("raw_text")).alias("t"))
    head = F.array_join(F.slice(F.split("t", "\n"), 1, 14), "\n")
    phones = F.filter(F.regexp_extract_all(head, F.lit(P.PHONE), F.lit(0)), lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")).between(9, 14))
    urls = F.filter(F.regexp_extract_all("t", F.lit(URL), F.lit(0)), lambda x: ~F.lower(x).rlike(r"linkedin\.com|github\.com"))
    return t.select(
        "resume_id", F.regexp_extract("t", P.EMAIL, 0).alias("email"), F.coalesce(F.trim(F.get(phones, F.lit(0))), F.lit("")).alias("phone"), T.clean_url(F.regexp_extract("t", LINKEDIN, 0)).alias("linkedin"),
        T.clean_url(F.regexp_extract("t", GITHUB, 0)).alias("github"), T.clean_url(F.coalesce(F.get(urls, F.lit(0)), F.lit(""))).alias("url"),
    )


def candidate_names(spark, sf_dir):
    """PRS-13: the name at the head of each text, or the one that its e-mail address spells."""
    return P.contact(parsing._texts(spark, sf_dir), "resume_id", "raw_text").select("resume_id", "name")


def heading_warnings(spark, sf_dir):
    """PRS-17: which of the needed headings each text lacks."""
    s = parsing._lines(spark, sf_dir).groupBy("resume_id").agg(F.collect_set("section").alias("there"))
    lost = F.filter(F.array(*[F.when(~F.array_contains("there", n), F.lit(f"no {n} heading")) for n in NEEDED]), lambda x: x.isNotNull())
    return s.select("resume_id", F.array_join(lost, "|").alias("warnings"))


def list_sections(spark, sf_dir):
    """PRS-10: items of every list section."""
    lines = parsing._lines(spark, sf_dir)
    parts = [P.list_items(lines, "resume_id", s).select("resume_id", F.lit(s).alias("section"), F.col("ord").cast("bigint").alias("ord"), "item") for s in LISTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def entity_list(spark, sf_dir):
    """TXT-7: the first eighty distinct organisations, dates and degrees of each résumé, in order."""
    r = parsing._texts(spark, sf_dir)

    def of(name: str, pattern: str):
        return F.transform(F.regexp_extract_all("raw_text", F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(name).alias("label"), F.lower(x).alias("entity")))

    found = F.concat(*[of(n, p) for n, p in texts._ENTITIES])
    e = r.select("resume_id", F.posexplode(F.slice(F.array_distinct(found), 1, 80)).alias("ord", "e"))
    return e.select("resume_id", F.col("ord").cast("bigint").alias("ord"), "e.label", "e.entity")


def posting_keywords(spark, sf_dir):
    """JD-7: of each text's ninety highest keywords the phrases that are no skill and not found in every posting, at most eighteen."""
    p = targets._postings(spark, sf_dir)
    k = texts._keywords(p, "doc_id", "text", 90).where(F.contains("term", F.lit(" ")) & (F.col("score") >= 2) & ~F.col("term").rlike("|".join(BOILERPLATE)))
    lines = p.select("doc_id", F.col("text").alias("line"), F.lit("other").alias("section"), F.lit(False).alias("is_blank"))
    skills = E.mentions(lines, "doc_id", table(spark, sf_dir, "ontology")).select("doc_id", F.lower("skill").alias("term")).distinct()
    r = k.join(skills, ["doc_id", "term"], "left_anti").withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("rank")) - 1)
    return r.where("ord < 18").select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.col("term").alias("keyword"))


def _words(x):
    return F.size(F.filter(F.split(x, "[ \t\r\n]+"), lambda w: w != ""))


def posting_duties(spark, sf_dir):
    """JD-8: bullets of four words or more, or else sentences of six; the first twelve of each text."""
    p = targets._postings(spark, sf_dir).select("doc_id", "text", F.filter(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(P.BULLET)), lambda x: F.trim(F.regexp_replace(x, P.BULLET, ""), F.lit(" \t\r"))), lambda x: _words(x) >= 4).alias("bullets"))
    sentences = F.filter(F.transform(F.split(F.regexp_replace("text", r"([.!?])[ \t\r\n]+", "$1\u0001"), "\u0001"), lambda x: F.trim(x, F.lit(" \t\r\n"))), lambda x: _words(x) >= 6)
    d = p.select("doc_id", F.posexplode(F.slice(F.when(F.size("bullets") > 0, F.col("bullets")).otherwise(sentences), 1, 12)).alias("ord", "duty"))
    return d.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "duty")


def _around(pattern: str) -> str:
    """The sentence that holds a match of the pattern."""
    return r"(?i)[^.!?\n]*(?:" + pattern.removeprefix("(?i)") + r")[^.!?\n]*[.!?\n]?"


def posting_degrees(spark, sf_dir):
    """JD-12, TXT-15: the highest degree that each text asks for (in its required block, if that names one), its field, whether an equivalent will do, and the sentence that says so."""
    p = targets._postings(spark, sf_dir)
    b = J.blocks(p, "doc_id", "text").where("section = 'required'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("block"))
    x = p.join(b, "doc_id", "left").withColumn("hay", F.when(J.degree(F.coalesce("block", F.lit(""))) != "none", F.col("block")).otherwise(F.col("text"))).withColumn("level", J.degree(F.col("hay")))
    said = F.lit("")
    for name, pattern in J.DEGREES:
        said = F.when(F.col("level") == name, F.regexp_extract("hay", _around(pattern), 0)).otherwise(said)
    x = x.withColumn("evidence", F.substring(F.trim(said, F.lit(" \t\r\n")), 1, 200)).withColumn("window", F.when(F.col("evidence") != "", F.col("evidence")).otherwise(F.col("hay")))
    field = F.lit("")
    for name, pattern in reversed(FIELDS):
        field = F.when(F.col("window").rlike(pattern), name).otherwise(field)
    return x.select("doc_id", "level", F.when(F.col("level") == "none", "").otherwise(field).alias("field"), F.col("window").rlike(EQUIVALENT).alias("equivalent"), "evidence")


def posting_axes(spark, sf_dir):
    """JD-13: the five commonest categories of the skills that each text asks for."""
    b = J.blocks(targets._postings(spark, sf_dir), "doc_id", "text")
    s = E.mentions(b, "doc_id", table(spark, sf_dir, "ontology")).select("doc_id", "skill", "category").distinct().groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n_skills"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n_skills"), "category")).cast("bigint")).where("rank <= 5")


def posting_requirement(spark, sf_dir):
    """JD-10, 11, 15: each text as a requirement: a listed company and title before a guessed one, level, expected years (stated or the level's), skills."""
    p = targets._postings(spark, sf_dir)
    t, low = F.col("text"), F.lower("text")
    company, role = J.organisation(t), J.role(t)
    for c, *_ in reversed(targets.COMPANIES):
        company = F.when(low.rlike(rf"\b{c}\b"), c).otherwise(company)
    for r, *_ in reversed(targets.ROLES):
        title = r.replace("-", " ")
        role = F.when(low.rlike(rf"\b{title}\b"), title).otherwise(role)
    skills = J.requirements(E.mentions(J.blocks(p, "doc_id", "text"), "doc_id", table(spark, sf_dir, "ontology")), "doc_id")
    n = skills.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_skills"), F.count_if(F.col("tier") == "required").alias("n_required"))
    x = p.select("doc_id", company.alias("company"), role.alias("role"), J.level(t).alias("level"), T.years_claimed(t).alias("stated")).join(n, "doc_id", "left").na.fill(0, ["n_skills", "n_required"])
    usual = F.create_map(*[F.lit(y) for q in S.EXPECTED_YEARS.items() for y in q])
    return x.select("doc_id", "company", "role", "level", F.when(F.col("stated") > 0, F.col("stated")).otherwise(F.coalesce(F.try_element_at(usual, F.col("level")), F.lit(1.0))).alias("expected_years"), "n_skills", "n_required")


def fused_facts(spark, sf_dir):
    """JD-14: keywords of the composed and of the posted requirement of each target, in one list without repeats (case matters), and the greater of both expectations of years."""
    composed = R.compose(*targets.reference(spark)).select("target_id", "skill")
    posted = table(spark, sf_dir, "skill_match").select("target_id", "skill").where("skill <> '' and target_id is not null").distinct()
    known = composed.select("target_id").distinct()
    both = composed.unionByName(posted.join(F.broadcast(known), "target_id", "left_semi")).distinct()  # the targets of the own reference rows
    usual = F.create_map(*[F.lit(y) for q in S.EXPECTED_YEARS.items() for y in q])
    stated = F.create_map(*[F.lit(y) for r, years, *_ in POSTINGS for y in (r, years)])
    g = both.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_keywords"))
    part = lambda n: F.get(F.split("target_id", ":"), F.lit(n))
    return g.select("target_id", "n_keywords", F.greatest(F.coalesce(F.try_element_at(usual, part(2)), F.lit(1.0)), F.coalesce(F.try_element_at(stated, part(1)), F.lit(0.0))).alias("expected_years"))


def skill_lines(spark, sf_dir):
    """EXT-3: up to three lines that show each skill of each résumé, and whether any of its lines is quantified."""
    lines = parsing._lines(spark, sf_dir).where("not is_blank")
    at = E.mentions(lines.withColumn("section", F.col("pos").cast("string")), "resume_id", table(spark, sf_dir, "ontology")).select("resume_id", "skill", F.col("section").cast("int").alias("pos"))
    x = at.join(lines.select("resume_id", "pos", F.trim("line", F.lit(" \t")).alias("line")), ["resume_id", "pos"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda y: F.substring(y["line"], 1, 180))
    return x.groupBy("resume_id", "skill").agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.max(T.has_metric(F.col("line"))), F.lit(False)).alias("quantified"), F.array_join(F.slice(ordered, 1, 3), "\n").alias("evidence"))


def skill_summary(spark, sf_dir):
    """EXT-6: counts of each résumé's skills, of those shown at work, only named and emerging, and the surest eight."""
    e = matching._evidence(spark, sf_dir).join(E.bounded(table(spark, sf_dir, "ontology").select("skill", "emerging")), "skill", "left")
    top = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), (-F.col("mentions")).alias("m"), "skill"))), lambda x: x["skill"]), 1, 8)
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_skills"), F.count_if("applied").alias("n_applied"), F.count_if("declared_only").alias("n_declared"), F.count_if(F.coalesce("emerging", F.lit(False))).alias("n_emerging"), F.array_join(top, "|").alias("top"))


_N = f"t AS (SELECT resume_id, {Q.normalised('raw_text')} AS n FROM {parsing._TEXTS})"
_CLEAN = "regexp_replace(regexp_replace(trim({x}, ' '), '[).,;]+$', ''), '^https?://', '')"
_WC = "len([w FOR w IN regexp_split_to_array({x}, '[ \\t\\r\\n]+') IF w <> ''])"
_KEYS = texts.SQL["keyword_topk"].replace("WHERE rank <= 10", "WHERE rank <= 90")
_STATED = " ".join(f"WHEN '{r}' THEN {y}" for r, y, *_ in POSTINGS)
_USUAL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.EXPECTED_YEARS.items())
_BL = f"{targets._BLOCKS}, bl AS (SELECT * FROM b WHERE NOT is_blank), {targets._mentions('bl')}"


def _first_of(cases: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {Q.quoted(v)}" for c, v in cases) + f" ELSE {otherwise} END"


_LEVEL = """CASE WHEN regexp_matches(low, 'intern|internship|co-op') THEN 'intern' WHEN regexp_matches(low, 'senior|staff|principal|lead engineer') OR years >= 5 THEN 'senior' WHEN regexp_matches(low, 'entry level|new grad|graduate|junior') OR years <= 1 THEN 'entry' ELSE 'mid' END"""

QUERIES = {
    f.__name__: f
    for f in (locations, contact_details, candidate_names, heading_warnings, list_sections, entity_list, posting_keywords, posting_duties, posting_degrees, posting_axes, posting_requirement, fused_facts, skill_lines, skill_summary)
}
SQL = {
    "locations": f"""WITH {_N}, h AS (SELECT resume_id, [trim(x, ' ' || chr(9)) FOR x IN string_split(n, chr(10))[1:6]] AS ls FROM t),
      p AS (SELECT resume_id, flatten([regexp_split_to_array(x, ' *\\| *') FOR x IN ls IF x <> '' AND NOT regexp_matches(x, {Q.quoted(LABEL)}) AND regexp_matches(x, {Q.quoted(CONTACT)})]) AS ps FROM h)
      SELECT resume_id, coalesce([y FOR y IN [regexp_extract(x, {Q.quoted(PLACE)}, 1) FOR x IN ps IF NOT regexp_matches(x, {Q.quoted(NO_PLACE)})] IF y <> ''][1], '') AS location FROM p""",
    "contact_details": f"""WITH {_N}, h AS (SELECT *, array_to_string(string_split(n, chr(10))[1:14], chr(10)) AS head FROM t)
      SELECT resume_id, regexp_extract(n, {Q.quoted(P.EMAIL)}) AS email, coalesce(trim([x FOR x IN regexp_extract_all(head, {Q.quoted(P.PHONE)}) IF length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 14][1], ' '), '') AS phone,
        {_CLEAN.format(x=f'regexp_extract(n, {Q.quoted(LINKEDIN)})')} AS linkedin, {_CLEAN.format(x=f'regexp_extract(n, {Q.quoted(GITHUB)})')} AS github,
        {_CLEAN.format(x="coalesce([x FOR x IN regexp_extract_all(n, " + Q.quoted(URL) + ") IF NOT regexp_matches(lower(x), 'linkedin\\.com|github\\.com')][1], '')")} AS url FROM h""",
    "heading_warnings": f"WITH {parsing._SQL_LINES}, s AS (SELECT resume_id, list(DISTINCT section) AS ss FROM l GROUP BY ALL) SELECT resume_id, array_to_string([x FOR x IN [{', '.join(f'''CASE WHEN NOT list_contains(ss, '{n}') THEN 'no {n} heading' END''' for n in NEEDED)}] IF x IS NOT NULL], '|') AS warnings FROM s",
    "list_sections": f"""WITH {parsing._SQL_LINES}, s AS (SELECT resume_id, section, pos, trim(regexp_replace(line, {Q.quoted(P.BULLET)}, ''), ' .;') AS item FROM l WHERE section IN {Q.listed(LISTS)} AND NOT is_blank)
      SELECT * FROM (SELECT resume_id, section, row_number() OVER (PARTITION BY resume_id, section ORDER BY pos) - 1 AS ord, item FROM s WHERE {parsing._WORDS.format(x='item')} >= 2 AND length(item) <= 220) WHERE ord < 25""",
    "entity_list": "WITH f AS (SELECT resume_id, "
    + "list_concat("
    + ", ".join(f"[{{'label': '{n}', 'entity': lower(x)}} FOR x IN regexp_extract_all(raw_text, {Q.quoted(p)})]" for n, p in texts._ENTITIES)
    + f""") AS es FROM {parsing._TEXTS}), u AS (SELECT resume_id, unnest(range(0, len(es))) AS i, unnest(es) AS e FROM f), d AS (SELECT resume_id, e, min(i) AS i FROM u GROUP BY ALL)
      SELECT * FROM (SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY i) - 1 AS ord, e.label AS label, e.entity AS entity FROM d) WHERE ord < 80""",
    "posting_keywords": f"""WITH kk AS ({_KEYS}), sx AS (WITH {targets._P}, q AS (SELECT doc_id, 'other' AS section, text AS line FROM p), {targets._mentions('q')} SELECT DISTINCT doc_id, lower(skill) AS term FROM mn)
      SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank) - 1 AS ord, term AS keyword FROM kk ANTI JOIN sx USING (doc_id, term) WHERE contains(term, ' ') AND score >= 2 AND NOT regexp_matches(term, {Q.quoted('|'.join(BOILERPLATE))})) WHERE ord < 18""",
    "posting_duties": f"""WITH {targets._P}, d AS (SELECT doc_id, text, [y FOR y IN [trim(regexp_replace(x, {Q.quoted(P.BULLET)}, ''), ' ' || chr(9) || chr(13)) FOR x IN string_split(text, chr(10)) IF regexp_matches(x, {Q.quoted(P.BULLET)})] IF {_WC.format(x='y')} >= 4] AS bs FROM p),
      e AS (SELECT doc_id, CASE WHEN len(bs) > 0 THEN bs ELSE [y FOR y IN [trim(x, ' ' || chr(9) || chr(13) || chr(10)) FOR x IN string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1))] IF {_WC.format(x='y')} >= 6] END[1:12] AS ds FROM d)
      SELECT doc_id, unnest(range(0, len(ds))) AS ord, unnest(ds) AS duty FROM e""",
    "posting_degrees": f"""WITH {targets._BLOCKS}, rb AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS block FROM b WHERE section = 'required' GROUP BY doc_id),
      d0 AS (SELECT p.doc_id, CASE WHEN {' OR '.join(f"regexp_matches(coalesce(block, ''), {Q.quoted(q)})" for _, q in J.DEGREES)} THEN block ELSE text END AS hay FROM p LEFT JOIN rb USING (doc_id)),
      d1 AS (SELECT *, {_first_of([(f'regexp_matches(hay, {Q.quoted(q)})', n) for n, q in J.DEGREES], "'none'")} AS level FROM d0),
      d2 AS (SELECT *, left(trim(CASE level {' '.join(f"WHEN '{n}' THEN regexp_extract(hay, {Q.quoted(_around(q))})" for n, q in J.DEGREES)} ELSE '' END, ' ' || chr(9) || chr(13) || chr(10)), 200) AS evidence FROM d1), d3 AS (SELECT *, CASE WHEN evidence <> '' THEN evidence ELSE hay END AS win FROM d2)
      SELECT doc_id, level, CASE WHEN level = 'none' THEN '' ELSE {_first_of([(f'regexp_matches(win, {Q.quoted(q)})', n) for n, q in FIELDS], "''")} END AS field, regexp_matches(win, {Q.quoted(EQUIVALENT)}) AS equivalent, evidence FROM d3""",
    "posting_axes": f"WITH {_BL}, c AS (SELECT doc_id, category, count(DISTINCT skill) AS n_skills FROM mn GROUP BY ALL) SELECT * FROM (SELECT doc_id, category, n_skills, row_number() OVER (PARTITION BY doc_id ORDER BY n_skills DESC, category) AS rank FROM c) WHERE rank <= 5",
    "posting_requirement": f"""WITH {_BL}, n AS (SELECT doc_id, count(DISTINCT skill) AS n_skills, count(DISTINCT CASE WHEN section = 'required' THEN skill END) AS n_required FROM mn GROUP BY ALL), y AS (SELECT *, lower(text) AS low, {targets._YEARS} AS years FROM p),
      z AS (SELECT doc_id, {_first_of([(f"regexp_matches(low, {Q.quoted(rf'\b{c[0]}\b')})", c[0]) for c in targets.COMPANIES], "trim(regexp_extract(text, '\\bat[ \\t]+([A-Z][A-Za-z0-9&.-]+(?:[ \\t]+[A-Z][A-Za-z0-9&.-]+){0,2})', 1), ' ')")} AS company,
        {_first_of([(f"regexp_matches(low, {Q.quoted(rf'\b{r[0].replace('-', ' ')}\b')})", r[0].replace('-', ' ')) for r in targets.ROLES], "trim(regexp_extract(array_to_string(string_split(text, chr(10))[1:6], chr(10)), '\\b((?:Senior|Staff|Lead|Junior)? *[A-Z][A-Za-z]+ +(?:Engineer|Developer|Scientist|Analyst|Architect))\\b', 1), ' ')")} AS role, {_LEVEL} AS level, years FROM y)
      SELECT doc_id, company, role, level, CASE WHEN years > 0 THEN years ELSE CASE level {_USUAL} ELSE 1.0 END END::DOUBLE AS expected_years, coalesce(n_skills, 0) AS n_skills, coalesce(n_required, 0) AS n_required FROM z LEFT JOIN n USING (doc_id)""",
    "skill_summary": f"""WITH {matching._EV} SELECT doc_id, count(*) AS n_skills, count(*) FILTER (applied) AS n_applied, count(*) FILTER (declared_only) AS n_declared, count(*) FILTER (coalesce(emerging, false)) AS n_emerging, array_to_string((list(skill ORDER BY confidence DESC, mentions DESC, skill))[1:8], '|') AS top
      FROM ev LEFT JOIN (SELECT skill, emerging FROM ontology) USING (skill) GROUP BY ALL""",
    "skill_lines": f"""WITH {matching._EV}, r2 AS (SELECT resume_id, pos, unnest(ws) AS form, true AS cased FROM w UNION ALL
        SELECT resume_id, pos, lower(array_to_string(ws[i:i + n - 1], '')) AS form, false FROM (SELECT resume_id, pos, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, {matching._LENGTHS} k)),
      sa AS (SELECT DISTINCT resume_id, pos, skill FROM r2 JOIN sf USING (form, cased)), x AS (SELECT sa.*, trim(line, ' ' || chr(9)) AS line FROM sa JOIN l USING (resume_id, pos))
      SELECT resume_id, skill, count(*) AS n_lines, bool_or(regexp_matches(line, {Q.quoted(T.METRIC)})) AS quantified, array_to_string((list(left(line, 180) ORDER BY pos))[1:3], chr(10)) AS evidence FROM x GROUP BY ALL""",
    "fused_facts": f"""WITH {targets._COMPOSED}, k AS (SELECT DISTINCT target_id, skill FROM (SELECT target_id, skill FROM co UNION ALL SELECT target_id, skill FROM skill_match WHERE skill <> '' AND target_id IN (SELECT target_id FROM co)))
      SELECT target_id, count(*) AS n_keywords, greatest(CASE split_part(target_id, ':', 3) {_USUAL} ELSE 1.0 END, CASE split_part(target_id, ':', 2) {_STATED} ELSE 0.0 END)::DOUBLE AS expected_years FROM k GROUP BY target_id""",
}
