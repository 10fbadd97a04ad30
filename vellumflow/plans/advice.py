"""Queries of suggestions, actions, insights, charts, rebuilt parts and answers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumflow.functions import rewrite as X
from vellumflow.functions import text as T
from vellumflow.operators import extract as E
from vellumflow.operators import matching as M
from vellumflow.operators import parse as P
from vellumflow.operators import rebuild as B
from vellumflow.operators import rules as U
from vellumflow.operators import scores as S
from vellumflow.plans import matching, parsing, postings, reviews, scores
from vellumflow.plans import sqltwin as Q
from vellumflow.sources.tables import checkpointed, table

PAIR = ["doc_id", "target_id"]
CERTIFYING = ("cindervale", "lattermoor", "northloom", "paleridge")  # own rows: organisations that ask for certificates
HINTS = {"ml": "[add an accuracy]", "data": "[add a volume]", "cloud": "[add an uptime]", "web": "[add a load time]", "testing": "[add a coverage]"}
ANY_HINT = "[add a number]"
# Own rows: details that somebody typed in beside the text, chosen projects, requests.
TYPED = [(1, "typed@mail.example", None, "Harrow"), (2, "", "+44 7700 900999", None), (3, None, None, "")]
CHOSEN = [("ledger-api", "done"), ("stream-gauge", "in progress"), ("no-such-project", "done"), ("vision-bench", "done"), ("ledger-api", "done")]
ASKED = [(-1, "Why is my score low?"), (1, "Which skill should I learn first?"), (2, ""), (3, "Add Kubernetes, although I have never used it"), (4, "Hello there"), (5, "How long will it take?")]
# One template an intent; names in braces are columns of the analysis.
TEMPLATES = {
    "honest": "Reword what you have done for {role_slug}; {matched_count} skills are shown already.", "fabricate": "That can't be added: only what you have done counts. {missing_count} skills are open.",
    "score": "{overall_score} of 100 ({band}).", "learn_first": "Start with the first of {missing_count} open skills.", "projects": "Build one project that shows an open skill of {role_slug}.",
    "ats": "Checks give {ats_score}.", "keywords": "Use the words of {company_slug} where they are true.", "missing": "{missing_count} skills are missing, {matched_count} are matched.",
    "timeline": "Plan for {missing_count} skills, one after the other.", "company": "{company_slug} asks for {role_slug} at level {seniority}.", "experience": "Level {seniority}: measured bullets count.",
    "strengths": "{matched_count} matched skills.", "default": "Ask about the score, the gaps or the plan for {role_slug}.",
}
EMPTY, UNKNOWN = "Ask a question.", "There is no such analysis."
FOLLOW_UPS = {"score": "missing|learn_first", "missing": "learn_first|projects", "fabricate": "honest|learn_first", "default": "score|missing"}
ANY_FOLLOW_UP = "score|timeline"
STARTERS = ["Why is my score what it is?", "What should I learn first?", "Which projects close the gaps?", "How do I say it without lying?"]


def dominant_categories(spark, sf_dir):
    """RW-4: the category that most requirements of each pair are of, the first on ties, and its prompt for a number."""
    m = matching._matches(spark, sf_dir).where("category <> ''").groupBy(*PAIR, "category").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("o"))
    best = m.groupBy(*PAIR).agg(F.max_by("category", F.struct("n", -F.col("o"))).alias("category"))
    hint = F.create_map(*[F.lit(x) for p in HINTS.items() for x in p])
    return best.select(*PAIR, "category", F.coalesce(F.try_element_at(hint, F.col("category")), F.lit(ANY_HINT)).alias("hint"))


def _tags(*cases):
    return F.array_join(F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in cases]), lambda x: x.isNotNull()), "|")


def suggestions(spark, sf_dir):
    """RW-5..8, CPL-6: suggestions of each pair by section: summary, skills, projects and education, with their tags."""
    x = reviews._section_features(spark, sf_dir)
    m = matching._matches(spark, sf_dir).where("status = 'partial' and coalesce(via, '') <> '' and skill is not null").groupBy(*PAIR).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "skill"))), lambda y: y["skill"]), 1, 3).alias("adjacent"))
    x = x.join(m, PAIR, "left").withColumn("adjacent", F.coalesce("adjacent", F.array().cast("array<string>")))
    low = F.lower("summary")
    none = F.size(F.filter(F.slice("first_keywords", 1, 6), lambda k: F.contains(low, F.lower(k)))) == 0
    long, empty = F.col("n_summary_words") > 90, F.col("summary") == ""
    row = lambda section, kind, tags, about: F.struct(F.lit(section).alias("section"), kind.alias("kind"), tags.alias("tags"), about.alias("about"))
    lit, blank = F.lit, F.lit("")
    unaligned = none & (F.size("first_keywords") > 0)
    # the three rewrites of a summary are the same text, so they are one suggestion with all their tags
    merged = row("summary", F.when(long, "restructure").otherwise("rewrite"), _tags((long, "length"), (F.col("n_generic") > 0, "generic-language"), (unaligned, "keyword-alignment")), blank)
    rows = [
        F.array(F.when(empty, row("summary", lit("add"), lit("missing-section|keyword-alignment"), blank)).when(long | (F.col("n_generic") > 0) | unaligned, merged)),
        F.array(F.when(F.col("n_declared") > 0, row("skills", lit("restructure"), lit("skill-placement|high-impact"), blank))),
        F.transform("adjacent", lambda s: row("skills", lit("caution"), lit("honest-gap"), s)),
        F.array(F.when((F.col("skills_block") != "") & ~F.contains("skills_block", lit(":")) & (F.col("n_terms") > 12), row("skills", lit("restructure"), lit("formatting"), blank))),
        F.array(F.when(F.col("n_projects") == 0, row("projects", lit("add"), lit("missing-section|high-impact"), blank))),
        F.array(F.when(F.col("n_education") == 0, row("education", lit("add"), lit("missing-section"), blank)).when(F.col("n_year") < F.col("n_education"), row("education", lit("rewrite"), lit("formatting"), blank))),
        F.array(F.when((F.col("n_education") > 0) & (F.col("certs") == 0) & S.part(F.col("target_id"), 0).isin(*CERTIFYING), row("education", lit("caution"), lit("honest-gap"), blank))),
    ]
    own = x.select(*PAIR, F.inline(F.filter(F.concat(*rows), lambda r: r.isNotNull())))
    raw = F.coalesce("entry_raw", F.lit(""))
    e = scores._entries(spark, sf_dir).where("section = 'projects'").withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("entry"))).where("r <= 5")
    tags = _tags((~T.has_metric(raw), "quantify"), (~raw.rlike(U.LINK), "evidence"), (F.size(F.coalesce("bullets", F.array().cast("array<string>"))) < 2, "depth"), ((F.coalesce("tech_hint", F.lit("")) == "") & ~raw.rlike(U.TOOLS), "keyword-alignment"))
    e = e.select("doc_id", F.lit("projects").alias("section"), F.lit("rewrite").alias("kind"), tags.alias("tags"), F.col("entry").cast("string").alias("about")).where("tags <> ''")
    return own.unionByName(x.select(*PAIR).join(e, "doc_id").select(*PAIR, "section", "kind", "tags", "about"))


def priority_actions(spark, sf_dir):
    """REC-15: what to do first for each pair: failed checks, presentation, learning, measured bullets, keywords, in that order."""
    w = scores.wide(spark, sf_dir)
    ats = reviews.pair_quality_scores(spark, sf_dir, w).where("family = 'all'").select(*PAIR, "failures")
    m = matching._matches(spark, sf_dir).groupBy(*PAIR).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.when((F.col("status") == "missing") & (F.col("priority") == "high") & F.col("skill").isNotNull(), F.struct("ord", "skill")))), lambda y: y["skill"]), 1, 5).alias("gaps"))
    k = scores.keyword_lists(spark, sf_dir).select(*PAIR, F.slice(F.filter(F.split("missing", r"\|"), lambda y: y != ""), 1, 4).alias("words"))
    x = w.select(*PAIR, "measured_share", "job_bullets", "all_bullets").join(ats, PAIR).join(reviews._pair_counts(spark, sf_dir).select(*PAIR, "n_declared"), PAIR).join(m, PAIR).join(k, PAIR, "left")
    row = lambda priority, kind, detail: F.struct(F.lit(priority).alias("priority"), F.lit(kind).alias("kind"), detail.alias("detail"))
    words = F.coalesce("words", F.array().cast("array<string>"))
    rows = F.concat(
        F.transform(F.slice(F.filter(F.split("failures", r"\|"), lambda y: y != ""), 1, 3), lambda y: row("high", "ats", y)),
        F.array(F.when(F.col("n_declared") > 0, row("high", "presentation", F.col("n_declared").cast("string")))),
        F.array(F.when(F.size("gaps") > 0, row("high", "learning", F.array_join("gaps", ", ")))),
        F.array(F.when((F.col("job_bullets") + F.col("all_bullets") > 0) & (F.col("measured_share") < 0.4), row("medium", "content", F.lit("")))),
        F.array(F.when(F.size(words) > 0, row("medium", "keywords", F.array_join(words, ", ")))),
    )
    out = x.select(*PAIR, F.posexplode(F.filter(rows, lambda r: r.isNotNull())).alias("ord", "a"))
    return out.select(*PAIR, F.col("ord").cast("bigint").alias("ord"), "a.priority", "a.kind", "a.detail")


def insights(spark, sf_dir):
    """REC-13: what there is to say on each pair, in order: fit, score, gap or strength, quick win, weak sections, checks, organisation."""
    w = scores.wide(spark, sf_dir)
    fit = scores.fit_verdicts(spark, sf_dir, w).select(*PAIR, "verdict", "headline")
    sections = reviews.section_scores(spark, sf_dir, w).where("section = 'all'").select(*PAIR, F.col("score").alias("sections"), F.col("weakest").alias("weak_section"))
    ats = reviews.pair_quality_scores(spark, sf_dir, w).where("family = 'all'").select(*PAIR, F.col("score").alias("ats"))
    x = w.select(*PAIR, F.round(S.overall(w) + 1e-9, 4).alias("o")).join(fit, PAIR).join(sections, PAIR).join(ats, PAIR).join(reviews._pair_counts(spark, sf_dir).select(*PAIR, "n_blocking", "n_declared"), PAIR)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    said = [
        text("fit: ", F.col("headline")), text("score: ", S.score_band(F.col("o"))), F.when(F.col("n_blocking") > 0, text("gaps: ", F.col("n_blocking"))).otherwise("strength: no blocking gap"),
        F.when(F.col("n_declared") > 0, text("quick win: ", F.col("n_declared"))), F.when(F.col("sections") < 70, text("section: ", F.col("weak_section"))), F.when(F.col("ats") < 70, F.lit("checks: below 70")),
        F.when(S.part(F.col("target_id"), 0).isin(*CERTIFYING), F.lit("organisation: asks for certificates")),
    ]
    return x.select(*PAIR, F.array_join(F.filter(F.array(*said), lambda y: y.isNotNull()), "\n").alias("insights"))


def charts(spark, sf_dir):
    """REC-12: the six charts of each pair as rows: gauge, pie, radar, bars, components and readiness."""
    w = scores.wide(spark, sf_dir)
    m = matching._matches(spark, sf_dir)
    row = lambda df, chart, label, value: df.select(*PAIR, F.lit(chart).alias("chart"), label.alias("label"), F.round(value + 1e-9, 4).alias("value"))
    p = M.projection(m)
    ready = p.select(*PAIR, F.inline(F.array(*[F.struct(F.lit(k).alias("l"), F.col(f"score_{k}").alias("v")) for k in ("now", "shown", "closed")])))
    bars = reviews.missing_bars(spark, sf_dir)
    parts = [
        row(w, "gauge", F.lit("overall"), S.overall(w)), row(m.where("status is not null").groupBy(*PAIR, "status").agg(F.count(F.lit(1)).cast("double").alias("n")), "pie", F.col("status"), F.col("n")),
        row(M.radar(m), "radar", F.col("category"), F.col("score")), row(bars, "missing", F.col("skill"), F.col("bar")),
        row(S.component_rows(w), "components", F.col("component"), F.col("score")), row(ready, "readiness", F.col("l"), F.col("v")),
    ]
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


def overviews(spark, sf_dir):
    """REC-14: what each résumé holds: entries, bullets, measured ones, skills and years."""
    e = S.entry_features(scores._entries(spark, sf_dir), scores._parsed(spark, sf_dir))
    f = matching._evidence(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_skills"))
    x = e.join(f, "doc_id", "full").na.fill(0)
    return x.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_jobs", "n_projects", "n_education", "all_bullets", "all_measured", "certs", "n_skills")], F.round(F.col("months") / 12, 1).alias("years"))


def contact_sheet(spark, sf_dir):
    """BLD-4: contact details of each résumé, what was typed in before what the columns hold before what the text says, and which are missing; e-mail and phone are essential."""
    r = table(spark, sf_dir, "resumes").groupBy("resume_id").agg(*[F.max_by(c, "loaded_at").alias(c) for c in ("email", "phone", "linkedin")])
    typed = spark.createDataFrame(TYPED, "resume_id bigint, t_email string, t_phone string, location string")
    found = postings.contact_details(spark, sf_dir).select("resume_id", *[F.col(c).alias(f"f_{c}") for c in ("email", "phone", "linkedin")])
    x = r.join(F.broadcast(typed), "resume_id", "left").join(found, "resume_id", "left")
    first = lambda *cs: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in cs], F.lit(""))
    x = x.select("resume_id", first("t_email", "email", "f_email").alias("email"), first("t_phone", "phone", "f_phone").alias("phone"), first("linkedin", "f_linkedin").alias("linkedin"), first("location").alias("location"))
    gone = F.filter(F.array(*[F.when(F.col(c) == "", F.lit(c + ("!" if c in ("email", "phone") else ""))) for c in ("email", "phone", "linkedin")]), lambda y: y.isNotNull())
    return x.withColumn("missing", F.array_join(gone, "|"))


def built_summaries(spark, sf_dir):
    """BLD-5, TXT-16: a summary of each pair from matched skills alone; years are told only where the text states one or more."""
    claimed = parsing._texts(spark, sf_dir).select(F.col("resume_id").alias("doc_id"), T.years_claimed(F.col("raw_text")).alias("years"))
    m = matching._matches(spark, sf_dir).groupBy(*PAIR).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.when((F.col("status") == "matched") & (F.col("skill") != ""), F.struct("ord", "skill")))), lambda y: y["skill"]), 1, 4).alias("s"))
    x = m.join(claimed, "doc_id", "left")
    who = F.replace(S.part(F.col("target_id"), 1), F.lit("-"), F.lit(" "))
    years = F.when(F.col("years") >= 1, F.concat(F.lit(" of "), F.floor("years").cast("string"), F.lit(" years"))).otherwise("")
    skills = F.when(F.size("s") > 0, F.concat(F.lit(" with "), T.joined(F.col("s")))).otherwise("")
    return x.select(*PAIR, F.concat(who, years, skills, F.lit(".")).alias("summary"))


def built_projects(spark, sf_dir):
    """BLD-7: every project's lines without those of technologies and of links alone, which are lifted out, and up to ten technologies that its own text names."""
    e = scores._entries(spark, sf_dir).where("section = 'projects'").select("doc_id", F.col("entry").cast("bigint").alias("entry"), "entry_raw", F.coalesce("bullets", F.array().cast("array<string>")).alias("b"))
    link = r"(?i)^(?:[A-Za-z ]+: *)?(?:https?://[^ ]+|(?:github|gitlab)\.com/[^ ]+)$"
    kept = F.filter("b", lambda x: ~x.rlike(P.META) & ~x.rlike(link))
    e = e.select("doc_id", "entry", F.size(kept).cast("bigint").alias("n_kept"), F.array_join(F.filter("b", lambda x: x.rlike(link)), "|").alias("links"), F.substring(F.array_join(kept, " "), 1, 600).alias("description"), "entry_raw")
    lines = e.where("entry_raw is not null").select(F.struct("doc_id", "entry").alias("k"), F.lit("projects").alias("section"), F.col("entry_raw").alias("line"), F.lit(False).alias("is_blank"))
    tech = E.mentions(lines, "k", table(spark, sf_dir, "ontology")).groupBy("k").agg(F.array_join(F.slice(F.array_sort(F.collect_set("skill")), 1, 10), "|").alias("tech")).select("k.doc_id", "k.entry", "tech")
    return e.drop("entry_raw").join(tech, ["doc_id", "entry"], "left").na.fill("", ["tech"])


def chosen_projects(spark, sf_dir):
    """BLD-8, JN-10: the chosen projects in the order of the request, without repeats and unknown ones; those in progress apart, the others with blanks to fill."""
    asked = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(CHOSEN)], "ord int, project_id string, state string")
    first = asked.groupBy("project_id").agg(F.min_by(F.struct("ord", "state"), "ord").alias("x")).select("project_id", "x.ord", "x.state")
    x = first.join(F.broadcast(matching.catalogue(spark)), "project_id")
    lines = F.when(F.col("state") == "done", F.array(F.lit("- <what you built> using <the specific tools you used>"), F.lit("- <what you measured>, [add a result]"))).otherwise(F.array(F.lit("- in progress")))
    out = x.select("project_id", "ord", F.when(F.col("state") == "done", "projects").otherwise("in progress").alias("section"), F.posexplode(lines).alias("n", "line"))
    return out.select("project_id", F.dense_rank().over(W.orderBy("ord")).cast("bigint").alias("place"), "section", F.col("n").cast("bigint").alias("n"), "line")


def education_lines(spark, sf_dir):
    """BLD-9: one line an education entry."""
    e = scores._entries(spark, sf_dir).where("section = 'education'")
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    what = F.concat_ws(" in ", some("degree"), some("field_of_study"))
    line = F.concat_ws(", ", F.when(what != "", what), some("institution"), some("grad_year"), some("score"))
    return e.select("doc_id", F.col("entry").cast("bigint").alias("entry"), line.alias("line"))


def export_guard(spark, sf_dir):
    """BLD-14, CPL-11: why the rewritten bullets of each résumé can't be exported yet: blanks to fill, or nothing to say; '' where they can."""
    b = reviews._bullets(spark, sf_dir).withColumn("clean", X.stripped_line(F.col("bullet")))
    g = b.groupBy("doc_id").agg(F.sum(X.required_blanks(F.col("bullet"))).alias("n_blanks"), F.count_if(F.coalesce(F.trim("clean"), F.lit("")) != "").alias("n_lines"))
    return g.select("doc_id", F.col("n_blanks").cast("bigint").alias("n_blanks"), F.when(F.col("n_lines") == 0, "empty").when(F.col("n_blanks") > 0, "unfilled").otherwise("").alias("problem"))


def escaped_lines(spark, sf_dir):
    """CPL-15: bullets as text of a page."""
    return reviews._bullets(spark, sf_dir).select("doc_id", "pos", X.escaped(F.col("bullet")).alias("html"))


def rebuild_scores(spark, sf_dir):
    """BLD-1, 6, 10: the skills score of each pair by its text and by the text rebuilt from its parts, scored against the same requirement."""
    texts, o = parsing._texts(spark, sf_dir), table(spark, sf_dir, "ontology")
    before = P.lines(texts, "resume_id", "raw_text")
    after = P.lines(checkpointed(B.render(before, "resume_id")), "resume_id", "text")
    m = matching._matches(spark, sf_dir).where("skill <> ''")
    req = E.canonical(m.select(*PAIR, "ord", "skill", "importance"), "skill", o, "name").select(*PAIR, F.col("ord").cast("bigint").alias("ord"), F.col("name").alias("skill"), "importance")

    def score(lines: DataFrame, name: str) -> DataFrame:
        found = E.evidence(E.mentions(lines, "resume_id", o), "resume_id").withColumnRenamed("resume_id", "doc_id")
        got = M.resolve(req.drop("importance"), found, E.edges(o)).join(req.select(*PAIR, "ord", "importance"), [*PAIR, "ord"])
        return got.groupBy(*PAIR).agg(F.round(T.clamp(100 * F.sum(F.col("importance") * F.col("credit")) / F.sum("importance")) + 1e-9, 4).alias(name))

    return score(before, "before").join(score(after, "after"), PAIR)


def _filled(template: str):
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(F.col(m[1]).cast("string"), F.lit("unknown"))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def answers(spark, sf_dir):
    """QA-2, 3: an answer to one of the questions for each analysis, by its intent, with what may be asked next."""
    cols = ["analysis_id", "overall_score", "ats_score", "band", "matched_count", "missing_count", "company_slug", "role_slug", "seniority"]
    a = table(spark, sf_dir, "resume_analyses").groupBy("analysis_id").agg(F.max_by(F.struct(*cols[1:]), "loaded_at").alias("x")).select("analysis_id", "x.*")
    for c in ("overall_score", "ats_score"):
        a = a.withColumn(c, F.round(c).cast("int"))
    questions = F.array(*[F.lit(q) for q in reviews.QUESTIONS])
    a = a.withColumn("question", F.get(questions, F.pmod(F.col("analysis_id"), F.lit(len(reviews.QUESTIONS))).cast("int"))).withColumn("intent", X.intent(F.col("question")))
    answer = F.lit(EMPTY)
    for name, template in TEMPLATES.items():
        answer = F.when((F.col("question") != "") & (F.col("intent") == name), _filled(template)).otherwise(answer)
    table_ = F.create_map(*[F.lit(x) for p in FOLLOW_UPS.items() for x in p])
    return a.select("analysis_id", "intent", answer.alias("answer"), F.coalesce(F.try_element_at(table_, F.col("intent")), F.lit(ANY_FOLLOW_UP)).alias("follow_ups"))


def asked_answers(spark, sf_dir):
    """CPL-10, QA-3: requests on stored analyses by id, with those that name none and those that ask nothing."""
    asked = spark.createDataFrame(ASKED, "analysis_id bigint, question string")
    known = table(spark, sf_dir, "resume_analyses").select("analysis_id").distinct().withColumn("known", F.lit(True))
    x = asked.join(known, "analysis_id", "left")
    return x.select("analysis_id", X.intent(F.col("question")).alias("intent"), F.when(F.col("known").isNull(), UNKNOWN).when(F.col("question") == "", EMPTY).otherwise("").alias("problem"))


def starters(spark, sf_dir):
    """QA-5: questions to begin with."""
    return spark.createDataFrame([(i, q) for i, q in enumerate(STARTERS)], "ord bigint, question string")


def optional_bars(spark, sf_dir):
    """UI-2: low and optional gaps of each pair in one list, the twelve most important, scaled to the longest."""
    m = matching._matches(spark, sf_dir).where("status = 'missing' and skill <> '' and (priority = 'low' or tier = 'optional')")
    r = m.withColumn("rank", F.row_number().over(W.partitionBy(*PAIR).orderBy(F.desc("importance"), "ord")).cast("bigint")).where("rank <= 12")
    return r.select(*PAIR, "rank", "skill", F.round(F.col("importance") / F.max("importance").over(W.partitionBy(*PAIR)) + 1e-9, 6).alias("bar"))


def _sql_filled(template: str) -> str:
    e = re.sub(r"\{(\w+)\}", lambda m: "' || coalesce(" + m[1] + "::VARCHAR, 'unknown') || '", template.replace("'", "''"))
    return f"'{e}'"


def _case(rows: dict[str, str], x: str, otherwise: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {Q.quoted(k)} THEN {Q.quoted(v)}" for k, v in rows.items()) + f" ELSE {Q.quoted(otherwise)} END"


def _listed(c: str, n: int) -> str:
    return f"coalesce((list(skill ORDER BY ord) FILTER ({c}))[1:{n}], [])"


_INTENT = f"CASE WHEN regexp_matches(low, {Q.quoted(X.UNOWNED)}) AND NOT regexp_matches(low, 'without|instead of|rather than') THEN 'fabricate' {reviews._INT} ELSE 'default' END"
_OVER = f"round({scores._OVERALL} + 1e-9, 4)"
_PAIR_TOTALS = reviews.SQL["pair_quality_scores"]
_META, _LINK2 = Q.quoted(P.META), Q.quoted(r"(?i)^(?:[A-Za-z ]+: *)?(?:https?://[^ ]+|(?:github|gitlab)\.com/[^ ]+)$")
_RAW = "coalesce(entry_raw, '')"

QUERIES = {
    f.__name__: f
    for f in (
        dominant_categories, suggestions, priority_actions, insights, charts, overviews, contact_sheet, built_summaries, built_projects, chosen_projects, education_lines, export_guard, escaped_lines, rebuild_scores,
        answers, asked_answers, starters, optional_bars,
    )
}
SQL = {
    "dominant_categories": f"""WITH {matching._M}, c AS (SELECT doc_id, target_id, category, count(*) AS n, min(ord) AS o FROM m WHERE category <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, target_id ORDER BY n DESC, o) AS r FROM c)
      SELECT doc_id, target_id, category, {_case(HINTS, 'category', ANY_HINT)} AS hint FROM r WHERE r = 1""",
    "suggestions": f"""WITH {reviews._SECTIONS}, ad AS (SELECT doc_id, target_id, unnest(xs) AS about FROM (SELECT doc_id, target_id, {_listed("status = 'partial' AND coalesce(via, '') <> '' AND skill IS NOT NULL", 3)} AS xs FROM m GROUP BY ALL)),
      u AS (SELECT *, nw > 90 AS lg, len(fk8) > 0 AND len([k FOR k IN fk8[1:6] IF contains(lower(summary), lower(k))]) = 0 AS un FROM s1),
      pe AS (SELECT doc_id, entry, array_to_string([x FOR x IN [CASE WHEN NOT {scores._MET.format(x=_RAW)} THEN 'quantify' END, CASE WHEN NOT regexp_matches({_RAW}, {Q.quoted(U.LINK)}) THEN 'evidence' END, CASE WHEN len(coalesce(bullets, [])) < 2 THEN 'depth' END,
        CASE WHEN coalesce(tech_hint, '') = '' AND NOT regexp_matches({_RAW}, {Q.quoted(U.TOOLS)}) THEN 'keyword-alignment' END] IF x IS NOT NULL], '|') AS tags, row_number() OVER (PARTITION BY doc_id ORDER BY entry) AS r FROM en WHERE section = 'projects')
      SELECT doc_id, target_id, 'summary' AS section, CASE WHEN summary = '' THEN 'add' WHEN lg THEN 'restructure' ELSE 'rewrite' END AS kind, CASE WHEN summary = '' THEN 'missing-section|keyword-alignment'
        ELSE array_to_string([x FOR x IN [CASE WHEN lg THEN 'length' END, CASE WHEN ng > 0 THEN 'generic-language' END, CASE WHEN un THEN 'keyword-alignment' END] IF x IS NOT NULL], '|') END AS tags, '' AS about FROM u WHERE summary = '' OR lg OR ng > 0 OR un
      UNION ALL SELECT doc_id, target_id, 'skills', 'restructure', 'skill-placement|high-impact', '' FROM u WHERE n_declared > 0 UNION ALL SELECT doc_id, target_id, 'skills', 'caution', 'honest-gap', about FROM ad
      UNION ALL SELECT doc_id, target_id, 'skills', 'restructure', 'formatting', '' FROM u WHERE skills_block <> '' AND NOT contains(skills_block, ':') AND n_terms > 12 UNION ALL SELECT doc_id, target_id, 'projects', 'add', 'missing-section|high-impact', '' FROM u WHERE n_projects = 0
      UNION ALL SELECT doc_id, target_id, 'education', 'add', 'missing-section', '' FROM u WHERE n_education = 0 UNION ALL SELECT doc_id, target_id, 'education', 'rewrite', 'formatting', '' FROM u WHERE n_education > 0 AND n_year < n_education
      UNION ALL SELECT doc_id, target_id, 'education', 'caution', 'honest-gap', '' FROM u WHERE n_education > 0 AND certs = 0 AND split_part(target_id, ':', 1) IN {Q.listed(CERTIFYING)}
      UNION ALL SELECT u.doc_id, target_id, 'projects', 'rewrite', tags, entry::VARCHAR FROM u JOIN pe USING (doc_id) WHERE r <= 5 AND tags <> ''""",
    "priority_actions": f"""WITH aq AS ({_PAIR_TOTALS}), kq AS ({scores.SQL['keyword_lists']}), {scores._WIDE}, {reviews._PC}, gp AS (SELECT doc_id, target_id, {_listed("status = 'missing' AND priority = 'high' AND skill IS NOT NULL", 5)} AS gaps FROM m GROUP BY ALL),
      x AS (SELECT doc_id, target_id, measured_share, job_bullets + all_bullets AS nb, failures, n_declared, gaps, [y FOR y IN string_split(coalesce(missing, ''), '|') IF y <> ''][1:4] AS ws FROM wd JOIN (SELECT * FROM aq WHERE family = 'all') USING (doc_id, target_id) JOIN pc USING (doc_id, target_id) JOIN gp USING (doc_id, target_id) LEFT JOIN kq USING (doc_id, target_id)),
      ra AS (SELECT doc_id, target_id, list_concat([{{'p': 'high', 'k': 'ats', 'd': y}} FOR y IN [z FOR z IN string_split(failures, '|') IF z <> ''][1:3]], [y FOR y IN [CASE WHEN n_declared > 0 THEN {{'p': 'high', 'k': 'presentation', 'd': n_declared::VARCHAR}} END, CASE WHEN len(gaps) > 0 THEN {{'p': 'high', 'k': 'learning', 'd': array_to_string(gaps, ', ')}} END,
        CASE WHEN nb > 0 AND measured_share < 0.4 THEN {{'p': 'medium', 'k': 'content', 'd': ''}} END, CASE WHEN len(ws) > 0 THEN {{'p': 'medium', 'k': 'keywords', 'd': array_to_string(ws, ', ')}} END] IF y IS NOT NULL]) AS rs FROM x)
      SELECT doc_id, target_id, ord, a.p AS priority, a.k AS kind, a.d AS detail FROM (SELECT doc_id, target_id, unnest(range(0, len(rs))) AS ord, unnest(rs) AS a FROM ra)""",
    "insights": f"""WITH fq AS ({scores.SQL['fit_verdicts']}), sq2 AS ({reviews.SQL['section_scores']}), aq AS ({_PAIR_TOTALS}), {scores._WIDE}, {reviews._PC},
      x AS (SELECT wd.doc_id, wd.target_id, {_OVER} AS ovl, headline, sq2.score AS sec, sq2.weakest AS wks, aq.score AS ats, n_blocking, n_declared FROM wd JOIN fq USING (doc_id, target_id) JOIN sq2 ON sq2.doc_id = wd.doc_id AND sq2.target_id = wd.target_id AND sq2.section = 'all'
        JOIN aq ON aq.doc_id = wd.doc_id AND aq.target_id = wd.target_id AND aq.family = 'all' JOIN pc ON pc.doc_id = wd.doc_id AND pc.target_id = wd.target_id)
      SELECT doc_id, target_id, array_to_string([y FOR y IN ['fit: ' || headline, 'score: ' || {scores._BAND.format(x='ovl')}, CASE WHEN n_blocking > 0 THEN 'gaps: ' || n_blocking ELSE 'strength: no blocking gap' END, CASE WHEN n_declared > 0 THEN 'quick win: ' || n_declared END,
        CASE WHEN sec < 70 THEN 'section: ' || wks END, CASE WHEN ats < 70 THEN 'checks: below 70' END, CASE WHEN split_part(target_id, ':', 1) IN {Q.listed(CERTIFYING)} THEN 'organisation: asks for certificates' END] IF y IS NOT NULL], chr(10)) AS insights FROM x""",
    "charts": f"""WITH rq AS ({matching.SQL['radar_by_category']}), bq AS ({reviews.SQL['missing_bars']}), pq2 AS ({matching.SQL['score_projection']}), {scores._WIDE},
      c AS (SELECT doc_id, target_id, 'gauge' AS chart, 'overall' AS label, ({scores._OVERALL})::DOUBLE AS v FROM wd UNION ALL SELECT doc_id, target_id, 'pie', status, count(*)::DOUBLE FROM m WHERE status IS NOT NULL GROUP BY ALL UNION ALL SELECT doc_id, target_id, 'radar', category, score FROM rq
        UNION ALL SELECT doc_id, target_id, 'missing', skill, bar FROM bq UNION ALL SELECT doc_id, target_id, 'components', component, score FROM cr {' '.join(f"UNION ALL SELECT doc_id, target_id, 'readiness', '{k}', score_{k} FROM pq2" for k in ('now', 'shown', 'closed'))})
      SELECT doc_id, target_id, chart, label, round(v + 1e-9, 4) AS value FROM c""",
    "overviews": f"""WITH {scores._WIDE}, ns AS (SELECT doc_id, count(*) AS n_skills FROM ev GROUP BY ALL)
      SELECT doc_id, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('n_jobs', 'n_projects', 'n_education', 'all_bullets', 'all_measured', 'certs', 'n_skills'))}, round(coalesce(months, 0) / 12, 1) AS years FROM eg2 FULL JOIN pr USING (doc_id) FULL JOIN ns USING (doc_id)""",
    "contact_sheet": f"""WITH cq2 AS ({postings.SQL['contact_details']}), r AS (SELECT resume_id, arg_max(email, loaded_at) AS email, arg_max(phone, loaded_at) AS phone, arg_max(linkedin, loaded_at) AS linkedin FROM resumes GROUP BY resume_id), ty AS (SELECT * FROM {Q.values(TYPED, 'resume_id, t_email, t_phone, location')}),
      x AS (SELECT r.resume_id, coalesce(nullif(t_email, ''), nullif(r.email, ''), nullif(cq2.email, ''), '') AS email, coalesce(nullif(t_phone, ''), nullif(r.phone, ''), nullif(cq2.phone, ''), '') AS phone, coalesce(nullif(r.linkedin, ''), nullif(cq2.linkedin, ''), '') AS linkedin, coalesce(location, '') AS location
        FROM r LEFT JOIN ty USING (resume_id) LEFT JOIN cq2 USING (resume_id))
      SELECT *, array_to_string([y FOR y IN [CASE WHEN email = '' THEN 'email!' END, CASE WHEN phone = '' THEN 'phone!' END, CASE WHEN linkedin = '' THEN 'linkedin' END] IF y IS NOT NULL], '|') AS missing FROM x""",
    "built_summaries": f"""WITH {matching._M}, s AS (SELECT doc_id, target_id, {_listed("status = 'matched' AND skill <> ''", 4)} AS s FROM m GROUP BY ALL), y AS (SELECT doc_id, {postings.targets._YEARS} AS years FROM (SELECT DISTINCT resume_id AS doc_id, raw_text AS text FROM resumes WHERE raw_text IS NOT NULL))
      SELECT doc_id, target_id, replace(split_part(target_id, ':', 2), '-', ' ') || CASE WHEN years >= 1 THEN ' of ' || floor(years)::INT || ' years' ELSE '' END || CASE len(s) WHEN 0 THEN '' WHEN 1 THEN ' with ' || s[1] ELSE ' with ' || array_to_string(s[1:len(s) - 1], ', ') || ' and ' || s[len(s)] END || '.' AS summary FROM s LEFT JOIN y USING (doc_id)""",
    "built_projects": f"""WITH {scores._ENTRY}, p AS (SELECT doc_id, entry::BIGINT AS entry, entry_raw, coalesce(bullets, []) AS b FROM en WHERE section = 'projects'),
      k AS (SELECT doc_id, entry, [x FOR x IN b IF NOT regexp_matches(x, {_META}) AND NOT regexp_matches(x, {_LINK2})] AS kept, [x FOR x IN b IF regexp_matches(x, {_LINK2})] AS ls FROM p),
      pt AS (WITH pq AS (SELECT doc_id * 1000 + entry AS doc_id, 'projects' AS section, entry_raw AS line FROM p WHERE entry_raw IS NOT NULL), {postings.targets._mentions('pq')} SELECT doc_id AS k, array_to_string(list_sort(list(DISTINCT skill))[1:10], '|') AS tech FROM mn GROUP BY ALL)
      SELECT doc_id, entry, len(kept) AS n_kept, array_to_string(ls, '|') AS links, left(array_to_string(kept, ' '), 600) AS description, coalesce(tech, '') AS tech FROM k LEFT JOIN pt ON pt.k = doc_id * 1000 + entry""",
    "chosen_projects": f"""WITH a AS (SELECT project_id, min(ord) AS ord, arg_min(state, ord) AS state FROM {Q.values([(i, p, s) for i, (p, s) in enumerate(CHOSEN)], 'ord, project_id, state')} WHERE project_id IN {Q.listed([p[0] for p in matching.PROJECTS])} GROUP BY project_id),
      x AS (SELECT *, row_number() OVER (ORDER BY ord) AS place, CASE WHEN state = 'done' THEN ['- <what you built> using <the specific tools you used>', '- <what you measured>, [add a result]'] ELSE ['- in progress'] END AS ls FROM a)
      SELECT project_id, place, CASE WHEN state = 'done' THEN 'projects' ELSE 'in progress' END AS section, unnest(range(0, len(ls))) AS n, unnest(ls) AS line FROM x""",
    "education_lines": f"""WITH {scores._ENTRY} SELECT doc_id, entry::BIGINT AS entry, concat_ws(', ', nullif(concat_ws(' in ', nullif(degree, ''), nullif(field_of_study, '')), ''), nullif(institution, ''), nullif(grad_year, ''), nullif(score, '')) AS line FROM en WHERE section = 'education'""",
    "export_guard": f"""WITH bs AS ({reviews.SQL['blank_strip']}), {reviews._B}, n AS (SELECT doc_id, sum(len([x FOR x IN regexp_extract_all(bullet, '<[^>]*>') IF lower(x) <> '{X.TOOL_BLANK}']))::BIGINT AS n_blanks FROM b WHERE bullet IS NOT NULL GROUP BY doc_id),
      c AS (SELECT doc_id, count(*) FILTER (trim(clean, ' ') <> '') AS n_lines FROM bs GROUP BY doc_id) SELECT doc_id, n_blanks, CASE WHEN coalesce(n_lines, 0) = 0 THEN 'empty' WHEN n_blanks > 0 THEN 'unfilled' ELSE '' END AS problem FROM n LEFT JOIN c USING (doc_id)""",
    "escaped_lines": f"WITH {reviews._B} SELECT doc_id, pos, replace(replace(replace(replace(bullet, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM b WHERE bullet IS NOT NULL",
    "answers": f"""WITH a AS (SELECT analysis_id, arg_max({{'o': overall_score, 'a': ats_score, 'b': band, 'm': matched_count, 'n': missing_count, 'c': company_slug, 'r': role_slug, 's': seniority}}, loaded_at) AS x FROM resume_analyses GROUP BY analysis_id),
      q AS (SELECT analysis_id, round(x.o)::INT AS overall_score, round(x.a)::INT AS ats_score, x.b AS band, x.m AS matched_count, x.n AS missing_count, x.c AS company_slug, x.r AS role_slug, x.s AS seniority, [{', '.join(map(Q.quoted, reviews.QUESTIONS))}][(analysis_id % {len(reviews.QUESTIONS)})::INT + 1] AS question FROM a),
      i AS (SELECT *, {_INTENT} AS intent FROM (SELECT *, lower(question) AS low FROM q))
      SELECT analysis_id, intent, CASE WHEN question = '' THEN {Q.quoted(EMPTY)} ELSE CASE intent {' '.join(f"WHEN '{n}' THEN {_sql_filled(t)}" for n, t in TEMPLATES.items())} END END AS answer, {_case(FOLLOW_UPS, 'intent', ANY_FOLLOW_UP)} AS follow_ups FROM i""",
    "asked_answers": f"""WITH a AS (SELECT *, lower(question) AS low FROM {Q.values(ASKED, 'analysis_id, question')}) SELECT analysis_id, {_INTENT} AS intent, CASE WHEN analysis_id NOT IN (SELECT analysis_id FROM resume_analyses) THEN {Q.quoted(UNKNOWN)} WHEN question = '' THEN {Q.quoted(EMPTY)} ELSE '' END AS problem FROM a""",
    "starters": f"SELECT ord::BIGINT AS ord, question FROM {Q.values([(i, q) for i, q in enumerate(STARTERS)], 'ord, question')}",
    "optional_bars": f"""WITH {matching._M}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, target_id ORDER BY importance DESC, ord) AS rank FROM m WHERE status = 'missing' AND skill <> '' AND (priority = 'low' OR tier = 'optional'))
      SELECT doc_id, target_id, rank, skill, round(importance / max(importance) OVER (PARTITION BY doc_id, target_id) + 1e-9, 6) AS bar FROM r WHERE rank <= 12""",
}
