"""Queries of the text functions and of text similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.functions import text as T
from vellumflow.operators import extract, similarity
from vellumflow.plans import sqltwin as Q
from vellumflow.sources.tables import distinct_rows, table

_DOCS = "(SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_rows(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"), "doc_id")


def normalised_text(spark, sf_dir):
    """TXT-1 over résumés: length and digest of each normalised text."""
    r = table(spark, sf_dir, "resumes").select("resume_id", "raw_text").where("raw_text is not null").distinct()
    n = r.select("resume_id", T.normalised(F.col("raw_text")).alias("n"))
    return n.select("resume_id", F.length("n").cast("bigint").alias("n_chars"), F.md5("n").alias("digest"))


def token_stats(spark, sf_dir):
    """TXT-2, 4, 5: tokens and content lemmas of each document."""
    d = _docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("ts"))
    return d.select("doc_id", F.size("ts").cast("bigint").alias("n_tokens"), F.size(F.filter(F.transform("ts", T.lemma), T.is_content)).cast("bigint").alias("n_content"))


def lemma_counts(spark, sf_dir):
    """TXT-4, 5, 12: occurrences and documents of each content lemma."""
    d = _docs(spark, sf_dir).select("doc_id", F.explode(T.content_lemmas(F.col("text"))).alias("lemma"))
    per = d.groupBy("lemma", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("lemma").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


def phrase_counts(spark, sf_dir):
    """TXT-6: every run of two or three content lemmas and how often it stands."""
    d = _docs(spark, sf_dir).select(T.content_lemmas(F.col("text")).alias("l"))
    return d.select(F.explode(F.concat(T.phrases(F.col("l"), 2), T.phrases(F.col("l"), 3))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


def _keywords(df: DataFrame, key: str, column: str, top: int) -> DataFrame:
    lemmas = df.select(key, T.content_lemmas(F.col(column)).alias("l"))

    def marked(terms, kind: int, weight: int):
        return F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("p"), F.lit(kind).alias("kind"), F.lit(weight).alias("w")))

    each = F.concat(marked(F.col("l"), 0, 1), marked(T.phrases(F.col("l"), 2), 1, 2), marked(T.phrases(F.col("l"), 3), 2, 2))
    score = lemmas.select(key, F.inline(each)).where(F.length("term") >= 3).groupBy(key, "kind", "term").agg(F.sum("w").alias("score"), F.min("p").alias("first"))
    w = W.partitionBy(key).orderBy(F.desc("score"), "kind", "first", "term")
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def keyword_topk(spark, sf_dir):
    """TXT-8: the ten highest keywords of each document; a phrase counts double, ties by kind and first place."""
    k = _keywords(_docs(spark, sf_dir), "doc_id", "text", 10)
    return k.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "term", F.col("score").cast("bigint").alias("score"))


def sentence_stats(spark, sf_dir):
    """TXT-3: sentences of each document and the longest one's length."""
    d = _docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("bigint").alias("longest"))


def metric_mentions(spark, sf_dir):
    """TXT-9, 10: quantified results and the largest claim of years in each document."""
    d = _docs(spark, sf_dir).select("doc_id", T.metrics(F.col("text")).alias("m"), T.years_claimed(F.col("text")).alias("years"))
    return d.select("doc_id", F.size("m").cast("bigint").alias("n_metrics"), F.coalesce(F.get("m", F.lit(0)), F.lit("")).alias("first_metric"), "years")


def opener_stats(spark, sf_dir):
    """TXT-11, 13: how the bullets of each résumé begin."""
    p = table(spark, sf_dir, "parsed_resume").select("doc_id", "bullets").distinct().select("doc_id", F.explode("bullets").alias("b"))
    f = p.select("doc_id", T.first_word(F.col("b")).alias("w"), T.has_metric(F.col("b")).alias("m"))
    return f.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_bullets"), F.count_if(F.col("w").isin(T.STRONG_VERBS)).alias("n_strong"),
        F.count_if(F.col("w").isin(T.WEAK_OPENERS)).alias("n_weak"), F.count_if("m").alias("n_measured"),
    )


def skill_snippets(spark, sf_dir):
    """TXT-14: the context of each listed skill's first mention, by name or alias, in a document."""
    found = extract.first_mentions(_docs(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "ontology"))
    return found.select("doc_id", "skill", T.snippet(F.col("text"), F.col("at"), F.col("length")).alias("snippet"))


# What organisations, dates and degrees look like.
_ORG = r"\b[A-Z][A-Za-z&.-]+(?:[ \t]+[A-Z][A-Za-z&.-]+){0,3}[ \t]+(?:Inc|LLC|Ltd|Technologies|Systems|Solutions|Labs|University|Institute|College|Corporation|Corp)\b"
_DATE = r"\b(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?[ \t]+[0-9]{4}|(?:19|20)[0-9]{2}\b)"
_DEGREE = r"(?i)\b(?:B\.? ?Tech|B\.?E\.?|B\.? ?Sc|Bachelor(?:'s)?|M\.? ?Tech|M\.? ?Sc|Master(?:'s)?|MBA|Ph\.?D|Doctorate|Diploma|B\.?C\.?A|M\.?C\.?A)\b"
_ENTITIES = (("ORG", _ORG), ("DATE", _DATE), ("DEGREE", _DEGREE))


def entities(spark, sf_dir):
    """TXT-7: distinct organisations, dates and degrees of each résumé."""
    r = table(spark, sf_dir, "resumes").select("resume_id", "raw_text").where("raw_text is not null").distinct()

    def of(name: str, pattern: str):
        return F.transform(F.regexp_extract_all("raw_text", F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(name).alias("label"), F.lower(x).alias("entity")))

    found = F.concat(*[of(name, p) for name, p in _ENTITIES])
    return r.select("resume_id", F.inline(F.array_distinct(found))).groupBy("resume_id", "label").agg(F.count(F.lit(1)).alias("n_entities"), F.min("entity").alias("least"))


def _near(spark, sf_dir, top: int | None = None):
    items = table(spark, sf_dir, "test_items").select("item_id", "text").distinct()
    return similarity.near_pairs(_docs(spark, sf_dir), items, "doc_id", "item_id", "text", top)


def pair_similarity(spark, sf_dir):
    """AGG-8, 9: cosine and overlap of every document and test item that share a term."""
    f = _near(spark, sf_dir)
    return f.select("doc_id", "item_id", F.round("cosine", 6).alias("cosine"), F.round("jaccard", 6).alias("jaccard"), "n_shared")


def top_items_per_doc(spark, sf_dir):
    """AGG-7 in part, AGG-13, REC-4: the three items nearest to each document by the blended score (without the expanded cosine), with its band."""
    f = _near(spark, sf_dir, 3).withColumn("s", F.round(T.clamp(100 * F.least(F.lit(1.0), (0.85 * F.col("cosine") + 0.15 * F.col("jaccard")) / 0.35)), 4))
    top = f.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("s"), "item_id"))).where("rank <= 3")
    band = F.when(F.col("s") >= 85, "excellent").when(F.col("s") >= 70, "strong").when(F.col("s") >= 55, "moderate").when(F.col("s") >= 40, "developing").otherwise("early")
    return top.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "item_id", F.col("s").alias("score"), band.alias("band"))


def keyword_coverage(spark, sf_dir):
    """AGG-2, 3: which of all the ontology's names each document holds, as a phrase or by half of its lemmas.

    A phrase is any part of the lower-case text, so names of one letter are in nearly all of them; names without content
    lemmas can be held as a phrase only. Phrases are found by one automaton of all names where the text is, lemmas by an equi-join.
    """
    names = table(spark, sf_dir, "ontology").select("skill").distinct()
    n_names = names.count()
    s = similarity.held_shares(_docs(spark, sf_dir), "doc_id", "text", names, "skill")
    x = s.groupBy("doc_id").agg(F.count_if(F.col("share") >= 1).alias("n_present"), F.count_if((F.col("share") >= 0.5) & (F.col("share") < 1)).alias("n_partial"))
    return x.select("doc_id", "n_present", "n_partial", F.round((F.col("n_present") + 0.5 * F.col("n_partial")) / n_names, 6).alias("coverage"))


_TOK = Q.content_tokens(_DOCS, "doc_id", "text")
_METRIC_SQL = Q.quoted(T.METRIC)
_PAIRS = f"""
  WITH d AS ({_TOK}), i AS ({Q.content_tokens("(SELECT DISTINCT item_id, text FROM test_items)", "item_id", "text")}),
  dt AS (SELECT doc_id, lemma, count(*) AS tf FROM d GROUP BY ALL), it AS (SELECT item_id, lemma, count(*) AS tf FROM i GROUP BY ALL),
  dn AS (SELECT doc_id, sum(tf * tf) AS sq, count(*) AS n FROM dt GROUP BY ALL), inn AS (SELECT item_id, sum(tf * tf) AS sq, count(*) AS n FROM it GROUP BY ALL),
  p AS (SELECT doc_id, item_id, sum(dt.tf * it.tf) AS dot, sum(dt.tf * dt.tf) AS sa, sum(it.tf * it.tf) AS sb, count(*) AS n_shared FROM dt JOIN it USING (lemma) GROUP BY ALL),
  f AS (SELECT p.doc_id, p.item_id, n_shared, dot / sqrt((k * dn.sq - (k - 1) * sa) * (k * inn.sq - (k - 1) * sb)) AS cosine, n_shared / (dn.n + inn.n - n_shared) AS jaccard
        FROM p JOIN dn USING (doc_id) JOIN inn USING (item_id), (SELECT power(1 + ln(1.5), 2) AS k) c)
"""

QUERIES = {f.__name__: f for f in (normalised_text, token_stats, lemma_counts, phrase_counts, keyword_topk, sentence_stats, metric_mentions, opener_stats, skill_snippets, entities, pair_similarity, top_items_per_doc, keyword_coverage)}
SQL = {
    "normalised_text": f"SELECT resume_id, length(n) AS n_chars, md5(n) AS digest FROM (SELECT resume_id, {Q.normalised('raw_text')} AS n FROM (SELECT DISTINCT resume_id, raw_text FROM resumes WHERE raw_text IS NOT NULL))",
    "token_stats": f"WITH c AS ({_TOK}), n AS (SELECT doc_id, len({Q.tokens('text')}) AS n_tokens FROM {_DOCS}) SELECT n.doc_id, n_tokens, count(c.pos) AS n_content FROM n LEFT JOIN c USING (doc_id) GROUP BY ALL",
    "lemma_counts": f"WITH c AS ({_TOK}) SELECT lemma, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM c GROUP BY ALL",
    "phrase_counts": f"""WITH c AS ({_TOK}), g AS (SELECT lemma AS a, lead(lemma, 1) OVER w AS b, lead(lemma, 2) OVER w AS c FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
      SELECT phrase, count(*) AS n FROM (SELECT a || ' ' || b AS phrase FROM g WHERE b IS NOT NULL UNION ALL SELECT a || ' ' || b || ' ' || c FROM g WHERE c IS NOT NULL) GROUP BY ALL""",
    "keyword_topk": f"""WITH c AS ({_TOK}), g AS (SELECT doc_id, pos, lemma AS a, lead(lemma, 1) OVER w AS b, lead(lemma, 2) OVER w AS c FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
      t AS (SELECT doc_id, pos, a AS term, 0 AS kind, 1 AS w FROM g UNION ALL SELECT doc_id, pos, a || ' ' || b, 1, 2 FROM g WHERE b IS NOT NULL UNION ALL SELECT doc_id, pos, a || ' ' || b || ' ' || c, 2, 2 FROM g WHERE c IS NOT NULL),
      s AS (SELECT doc_id, kind, term, sum(w) AS score, min(pos) AS first FROM t WHERE length(term) >= 3 GROUP BY ALL)
      SELECT doc_id, rank, term, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, kind, first, term) AS rank FROM s) WHERE rank <= 10""",
    "sentence_stats": f"""SELECT doc_id, len(s) AS n_sentences, coalesce(list_max([length(x) FOR x IN s]), 0)::BIGINT AS longest FROM (
      SELECT doc_id, [x FOR x IN string_split(regexp_replace(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10)) IF length(trim(x, ' ')) > 0] AS s FROM {_DOCS})""",
    "metric_mentions": f"""SELECT doc_id, len(m) AS n_metrics, coalesce(trim(m[1], ' '), '') AS first_metric, coalesce(list_max([y::DOUBLE FOR y IN ys]), 0.0) AS years FROM (
      SELECT doc_id, regexp_extract_all(text, {_METRIC_SQL}) AS m, regexp_extract_all(text, {Q.quoted(T.YEARS)}, 1) AS ys FROM {_DOCS})""",
    "opener_stats": f"""SELECT doc_id, count(*) AS n_bullets, count(*) FILTER (w IN {Q.listed(T.STRONG_VERBS)}) AS n_strong, count(*) FILTER (w IN {Q.listed(T.WEAK_OPENERS)}) AS n_weak, count(*) FILTER (m) AS n_measured FROM (
      SELECT doc_id, lower(regexp_extract(b, '[A-Za-z]+')) AS w, regexp_matches(b, {_METRIC_SQL}) AS m FROM (SELECT doc_id, unnest(bullets) AS b FROM (SELECT DISTINCT doc_id, bullets FROM parsed_resume))) GROUP BY ALL""",
    "entities": "SELECT resume_id, label, count(*) AS n_entities, min(entity) AS least FROM (SELECT DISTINCT resume_id, label, lower(unnest(es)) AS entity FROM ("
    + " UNION ALL ".join(f"SELECT resume_id, '{n}' AS label, regexp_extract_all(raw_text, {Q.quoted(p)}) AS es FROM (SELECT DISTINCT resume_id, raw_text FROM resumes WHERE raw_text IS NOT NULL)" for n, p in _ENTITIES)
    + ")) GROUP BY ALL",
    "pair_similarity": _PAIRS + "SELECT doc_id, item_id, round(cosine, 6) AS cosine, round(jaccard, 6) AS jaccard, n_shared FROM f",
    "top_items_per_doc": _PAIRS
    + """, s AS (SELECT doc_id, item_id, round(greatest(0, least(100, 100 * least(1, (0.85 * cosine + 0.15 * jaccard) / 0.35))), 4) AS score FROM f)
      SELECT doc_id, rank, item_id, score, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'strong' WHEN score >= 55 THEN 'moderate' WHEN score >= 40 THEN 'developing' ELSE 'early' END AS band
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 3""",
    "keyword_coverage": f"""WITH c AS ({_TOK}), d AS (SELECT DISTINCT doc_id, lemma FROM c), k AS ({Q.content_tokens("(SELECT skill, skill AS t FROM ontology)", "skill", "t")}),
      kl AS (SELECT DISTINCT skill, lemma FROM k), kn AS (SELECT o.skill, count(lemma) AS n FROM (SELECT DISTINCT skill FROM ontology) o LEFT JOIN kl USING (skill) GROUP BY ALL),
      h AS (SELECT d.doc_id, kl.skill, count(*) AS hits FROM d JOIN kl USING (lemma) GROUP BY ALL)
      SELECT doc_id, count(*) FILTER (s = 1) AS n_present, count(*) FILTER (s = 0.5) AS n_partial, round(sum(s) / count(*), 6) AS coverage FROM (
        SELECT t.doc_id, CASE WHEN contains(lower(t.text), lower(kn.skill)) THEN 1.0 WHEN n = 0 THEN 0.0 WHEN coalesce(hits, 0) = n THEN 1.0 WHEN coalesce(hits, 0) / n >= 0.5 THEN 0.5 ELSE 0.0 END::DOUBLE AS s
        FROM {_DOCS} t CROSS JOIN kn LEFT JOIN h ON h.doc_id = t.doc_id AND h.skill = kn.skill) GROUP BY doc_id""",
}
