"""Ontology terms in texts, found by an equi-join of squashed word runs with the surface forms.

A regular expression a skill would read every text once a skill. Instead each line gives its runs of up to as many words as
the longest form has, without spaces and hyphens and in lower case, and one join finds all forms at once. Names of one or two letters, and those
with signs, must stand with their own capitals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Confidence of a mention by the section it stands in; sections that count as applied.
SECTION_WEIGHT = {
    "experience": 1.0, "projects": 0.92, "summary": 0.75, "skills": 0.7, "certifications": 0.7, "achievements": 0.65,
    "publications": 0.6, "leadership": 0.55, "education": 0.5, "header": 0.4, "other": 0.5,
}
APPLIED = ("experience", "projects")
MENTION_CAP = 12
TOKEN = r"[A-Za-z0-9+#./]+"
MOST_FORMS = 500_000


def squashed(form: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(form), "[ -]", ""))


def bounded(side: DataFrame, most: int = MOST_FORMS) -> DataFrame:
    """A reference table to be broadcast, if its counted rows are at most `most`; beyond that it's joined as any other."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def surface_forms(ontology: DataFrame) -> DataFrame:
    """skill, category, form, cased: names and aliases; `form` is squashed, or the name itself where capitals matter."""
    short = (F.length("skill") <= 2) | F.col("skill").rlike(r"^[.]|[+#]$")
    names = ontology.select("skill", "category", F.when(short, F.col("skill")).otherwise(squashed(F.col("skill"))).alias("form"), short.alias("cased"))
    aliases = ontology.select("skill", "category", F.explode("aliases").alias("a")).select("skill", "category", squashed(F.col("a")).alias("form"), F.lit(False).alias("cased"))
    return names.unionByName(aliases).distinct()


def longest_form(ontology: DataFrame) -> int:
    """Words of the longest name or alias."""
    forms = ontology.select(F.explode(F.concat(F.array("skill"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("f"))
    return forms.agg(F.max(F.size(F.split(F.trim(F.regexp_replace("f", "-", " ")), " +")))).first()[0] or 1


def words_of(line: Column) -> Column:
    parts = F.regexp_extract_all(F.regexp_replace(line, "-", " "), F.lit(TOKEN), F.lit(0))
    return F.filter(F.transform(parts, lambda w: F.regexp_replace(w, "[./]+$", "")), lambda w: w != "")


def runs(words: str, most: int) -> Column:
    """Structs (form, cased) of all runs of up to `most` words. `words` must be a column, for each run reads it again."""

    def of(n: int, cased: bool) -> Column:
        def one(i):
            s = F.array_join(F.slice(words, i, n), "")
            return F.struct((s if cased else F.lower(s)).alias("form"), F.lit(cased).alias("cased"))

        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), one)).otherwise(F.array().cast("array<struct<form:string,cased:boolean>>"))

    return F.concat(of(1, True), *[of(n, False) for n in range(1, most + 1)])


def mentions(doc_lines: DataFrame, key: str, ontology: DataFrame, broadcast_forms: int = MOST_FORMS) -> DataFrame:
    """key, section, skill, category, n: how often each section of each document mentions each skill."""
    forms = bounded(surface_forms(ontology), broadcast_forms)
    cut = doc_lines.where(~F.col("is_blank")).select(key, "section", words_of(F.col("line")).alias("ws"))
    found = cut.select(key, "section", F.inline(runs("ws", longest_form(ontology)))).join(forms, ["form", "cased"])
    return found.groupBy(key, "section", "skill", "category").agg(F.count(F.lit(1)).alias("n"))


def first_mentions(df: DataFrame, key: str, column: str, ontology: DataFrame) -> DataFrame:
    """key, column, skill, at, length: where each text first mentions each skill (from 1), by the same runs as `mentions`.

    The forms travel with the tasks, so a list of more than MOST_FORMS is refused. The longer of two forms at one place counts.
    """
    rows = surface_forms(ontology).select("form", "cased", "skill").limit(MOST_FORMS + 1).collect()
    if len(rows) > MOST_FORMS:
        raise ValueError(f"more than {MOST_FORMS} surface forms")
    skills: dict[tuple[str, bool], list[str]] = {}
    for r in rows:
        skills.setdefault((r.form, r.cased), []).append(r.skill)
    kind = df.schema[key].dataType.simpleString()
    most = longest_form(ontology)

    def found_in(text: str) -> dict[str, tuple[int, int]]:
        out: dict[str, tuple[int, int]] = {}
        for line in re.finditer(r"[^\n]+", text):
            words = []
            for m in re.finditer(TOKEN, line[0]):
                w = re.sub(r"[./]+$", "", m[0])
                if w:
                    words.append((w, line.start() + m.start()))
            for i, (w, start) in enumerate(words):
                run = ""
                for n, (x, at) in enumerate(words[i : i + most]):
                    run += x
                    length = at + len(x) - start
                    for s in skills.get((run.lower(), False), []) + (skills.get((w, True), []) if n == 0 else []):
                        old = out.get(s)
                        if old is None or (old[0] == start + 1 and old[1] < length):
                            out[s] = (start + 1, length)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("skill", pa.string()), ("at", pa.int32()), ("length", pa.int32())]))
        for b in batches:
            found = [[{"skill": s, "at": a, "length": n} for s, (a, n) in found_in(t).items()] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, kinds)], names=[key, column, "found"])

    given = df.select(key, column).where(F.col(column).isNotNull())
    return given.mapInArrow(run, f"`{key}` {kind}, `{column}` string, found array<struct<skill:string,at:int,length:int>>").select(key, column, F.inline("found"))


def evidence(found: DataFrame, key: str) -> DataFrame:
    """key, skill, category, mentions, n_sections, applied, declared_only, confidence of each skill of each document."""
    weight = F.create_map(*[F.lit(x) for p in SECTION_WEIGHT.items() for x in p])
    s = found.withColumn("w", F.coalesce(F.try_element_at(weight, F.col("section")), F.lit(0.5)))
    g = s.groupBy(key, "skill", "category").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_sections"), F.max("w").alias("base"),
        F.max(F.col("section").isin(*APPLIED)).alias("applied"), F.min(F.col("section") == "skills").alias("declared_only"),
    )
    n = F.least(F.col("total"), F.greatest(F.lit(MENTION_CAP), F.col("n_sections")))
    conf = F.least(F.lit(1.0), F.col("base") + F.least(F.lit(0.15), 0.04 * (n - 1)) + F.when(F.col("n_sections") > 1, 0.08).otherwise(0.0))
    return g.select(key, "skill", "category", n.alias("mentions"), "n_sections", "applied", "declared_only", F.round(conf, 6).alias("confidence"))


def edges(ontology: DataFrame) -> DataFrame:
    """src, dst, ord: the related skills of each skill in order."""
    return ontology.select(F.col("skill").alias("src"), F.posexplode("related").alias("ord", "dst"))


def canonical(df: DataFrame, column: str, ontology: DataFrame, to: str) -> DataFrame:
    """df with `to`: the listed name of a surface form, the first of its names and aliases; the form itself if there's none."""
    names = ontology.select("skill_id", "skill", F.lower("skill").alias("form"), F.lit(0).alias("r"))
    aliases = ontology.select("skill_id", "skill", F.explode("aliases").alias("a")).select("skill_id", "skill", F.lower("a").alias("form"), F.lit(1).alias("r"))
    index = names.unionByName(aliases).groupBy("form").agg(F.min_by("skill", F.struct("r", "skill_id")).alias("__name"))
    return df.join(bounded(index), F.lower(F.trim(F.col(column))) == F.col("form"), "left").withColumn(to, F.coalesce("__name", F.col(column))).drop("form", "__name")
