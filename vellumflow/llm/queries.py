"""Queries of the text operators: pN_ names as in TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.llm import canon, leak, mapping, neardup, pii, spam, tokenizer
from vellumflow.operators import packed
from vellumflow.operators.extract import bounded
from vellumflow.sources.tables import distinct_rows, spread, table


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns))


FIELDS = ("raw_text", "candidate_name", "email", "phone")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k STRUCT<resume_id, field>, value: the columns of resumes that hold personal values."""
    r = spread(table(spark, sf_dir, "resumes").select("resume_id", *FIELDS), 3)
    each = F.array(*[F.struct(F.struct("resume_id", F.lit(c).alias("field")).alias("k"), F.col(c).alias("value")) for c in FIELDS])
    return r.select(F.inline(each)).where("value is not null")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every personal value: its column, kind and place."""
    v = pii.find_values(_fields(spark, sf_dir), "k", "value")
    return v.select("k.field", "k.resume_id", "kind", "char_pos").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw text with typed placeholders."""
    r = spread(table(spark, sf_dir, "resumes").select("resume_id", "raw_text"), 3)
    return pii.redact_texts(r, "resume_id", "raw_text").distinct()


def _near(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(spread(table(spark, sf_dir, "resumes").select("resume_id", "raw_text")), "resume_id", "raw_text", size=3, threshold=0.6)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of résumés of similarity 0.6 or more."""
    return _near(spark, sf_dir).pairs().select(F.col("a").alias("resume_id_a"), F.col("b").alias("resume_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each résumé that is similar to another, and its number of links."""
    return _near(spark, sf_dir).groups().select(F.col("id").alias("resume_id"), "group_id", "n_links")


def _lines(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """field, doc_id, pos, line: the lines of raw_text and the elements of bullets; with `once` those of repeated deliveries once."""
    r = table(spark, sf_dir, "resumes").select("resume_id", "raw_text")
    r = distinct_rows(r, "resume_id") if once else spread(r)
    lines = r.select(F.lit("raw_text").alias("field"), F.col("resume_id").alias("doc_id"), F.posexplode(F.split("raw_text", "\n", -1)).alias("pos", "line"))
    p = table(spark, sf_dir, "parsed_resume").select("doc_id", "bullets")
    p = distinct_rows(p, "doc_id") if once else spread(p)
    bullets = p.select(F.lit("bullets").alias("field"), "doc_id", F.posexplode("bullets").alias("pos", "line"))
    return lines.unionByName(bullets).withColumn("pos", F.col("pos").cast("bigint"))


def _letter_pairs(spark: SparkSession, sf_dir: str):
    """Bigram counts of all raw texts and bullets."""
    texts = spread(table(spark, sf_dir, "resumes").select(F.col("raw_text").alias("t")))
    bullets = spread(table(spark, sf_dir, "parsed_resume").select(F.array_join("bullets", "\n").alias("t")))
    return canon.bigram_counts(texts.unionByName(bullets), "t")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and bullets that look like ordinary text and differ from it in characters: those a step of the consistent form changes."""
    odd = _lines(spark, sf_dir).where(canon.suspicious(F.col("line")))
    done = canon.canonical_texts(odd, ["field", "doc_id", "pos"], "line", _letter_pairs(spark, sf_dir))
    return done.where("found > 0").select("field", "doc_id", "pos").distinct()


def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each field differ by each kind, and how many distinct forms they have."""
    odd = _lines(spark, sf_dir).where(canon.suspicious(F.col("line"))).distinct()
    done = canon.canonical_texts(odd, ["field", "doc_id", "pos"], "line", _letter_pairs(spark, sf_dir)).where("found > 0")
    kinds = F.filter(F.array(*[F.when(F.col("found").bitwiseAND(1 << k) > 0, F.lit(name)) for k, name in enumerate(canon.KINDS)]), lambda x: x.isNotNull())
    return done.select("field", "text", F.explode(kinds).alias("kind")).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("text").alias("n_forms"))


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line and bullet of each distinct text in its consistent form; those that hold nothing unusual are in it already. No line is shuffled."""
    lines = _lines(spark, sf_dir, once=True)
    odd = F.coalesce(canon.suspicious(F.col("line")), F.lit(False))
    done = canon.canonical_texts(lines.where(odd), ["field", "doc_id", "pos"], "line", _letter_pairs(spark, sf_dir)).drop("found")
    return done.unionByName(lines.where(~odd).withColumnRenamed("line", "text"))


def _meant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, doc_id, target_id, ord, value, skill_id, n_values of the entered skills that aren't listed letter for letter."""
    m = table(spark, sf_dir, "skill_match").select(F.lit("skill_match").alias("field"), "doc_id", "target_id", F.col("ord").cast("bigint").alias("ord"), F.col("skill").alias("value"))
    p = table(spark, sf_dir, "parsed_resume").select("doc_id", F.posexplode("skill_section_terms").alias("i", "value"))
    p = p.select(F.lit("skill_section_terms").alias("field"), "doc_id", F.lit("").alias("target_id"), F.col("i").cast("bigint").alias("ord"), "value")
    ontology = table(spark, sf_dir, "ontology")
    entries = mapping.entries_of(ontology)
    listed = bounded(ontology.select(F.col("skill").alias("value")).distinct())
    other = m.unionByName(p).where(F.length(F.trim("value")) > 0).join(listed, "value", "left_anti")
    found = mapping.map_values(spread(other), "value", entries, packed.vocabulary(ontology))
    return found.where((F.col("field") == "skill_match") | (F.col("n_values") < 2))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entered value that isn't a skill letter for letter, with the skill meant or 0."""
    return _meant(spark, sf_dir).select("field", "doc_id", "target_id", "ord", "skill_id").distinct()


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of values that no entry is meant by, with how often they were entered."""
    rows = _meant(spark, sf_dir).where("skill_id = 0").distinct()
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n_entered"))


def p6_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listed skill within the distance of each distinct entered value, and the distance."""
    m = table(spark, sf_dir, "skill_match").select("skill")
    p = table(spark, sf_dir, "parsed_resume").select(F.explode("skill_section_terms").alias("skill"))
    return mapping.near_entries(m.unionByName(p), "skill", mapping.entries_of(table(spark, sf_dir, "ontology")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_texts(documents(spark, sf_dir, "text"), "doc_id", "text")


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by language: documents, tokens, longest."""
    d = documents(spark, sf_dir, "text", "lang")
    n = tokenizer.encode_texts(d.withColumn("k", F.struct("doc_id", "lang")), "k", "text").select(F.coalesce("k.lang", F.lit("")).alias("lang"), F.size("ids").alias("n"))
    return n.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.find_leaks(documents(spark, sf_dir, "text"), table(spark, sf_dir, "test_items"), "doc_id", "text", "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked item how many documents hold it and the longest passage."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("item_words").alias("longest"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-stuffed pages, lists of links and of tags."""
    return spam.find_stuffed(documents(spark, sf_dir, "text", "lang"), "doc_id", "text", "lang")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean shares by language: what the thresholds stand on."""
    m = spam.measure(documents(spark, sf_dir, "text", "lang"), "doc_id", "text", "lang")
    return m.groupBy("lang").agg(F.count(F.lit(1)).alias("n_pages"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in spam.FEATURES])


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p5_found": p5_found, "p5_groups": p5_groups, "p4_found": p4_found, "p4_kinds": p4_kinds, "p4_texts": p4_texts, "p6_found": p6_found, "p6_unmatched": p6_unmatched, "p6_candidates": p6_candidates, "p7_ids": p7_ids, "p7_lengths": p7_lengths, "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_shares": p9_shares}
_INVISIBLE = r"[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}-\x{009F}]"
_SHOWN = f"regexp_replace(line, '{_INVISIBLE}', '', 'g')"
_FOUND = " OR ".join(
    [
        r"regexp_matches(line, '[\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]')",
        rf"regexp_matches({_SHOWN}, '\p{{L}}[\x{{0300}}-\x{{036F}}]')",
        rf"regexp_matches(regexp_replace(line, '([\p{{So}}\x{{FE0F}}])\x{{200D}}', '\1', 'g'), '{_INVISIBLE}')",
        r"regexp_matches(line, '[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')",
        r"regexp_matches(line, '[\x{FB00}-\x{FB06}]')",
        rf"regexp_matches({_SHOWN}, '\p{{Latin}}[\p{{Greek}}\p{{Cyrillic}}]|[\p{{Greek}}\p{{Cyrillic}}]\p{{Latin}}|\p{{Greek}}\p{{Cyrillic}}|\p{{Cyrillic}}\p{{Greek}}')",
    ]
)
SQL: dict[str, str] = {
    "p4_found": f"""WITH l AS (SELECT 'raw_text' AS field, resume_id AS doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT resume_id, string_split(raw_text, chr(10)) AS ls FROM resumes WHERE raw_text IS NOT NULL)
        UNION ALL SELECT 'bullets', doc_id, unnest(range(0, len(bullets))), unnest(bullets) FROM parsed_resume)
      SELECT DISTINCT field, doc_id, pos FROM l WHERE {_FOUND}""",
    "p5_found": r"""WITH t AS (SELECT DISTINCT resume_id, regexp_extract_all(lower(raw_text), '[\p{L}\p{N}]+') AS ws FROM resumes WHERE raw_text IS NOT NULL),
      s AS (SELECT DISTINCT resume_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT resume_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)), n AS (SELECT resume_id, count(*) AS n FROM s GROUP BY ALL),
      p AS (SELECT a.resume_id AS a, b.resume_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.resume_id < b.resume_id GROUP BY ALL)
      SELECT a AS resume_id_a, b AS resume_id_b FROM p JOIN n x ON x.resume_id = a JOIN n y ON y.resume_id = b WHERE 10 * c >= 6 * (x.n + y.n - c)""",
}
