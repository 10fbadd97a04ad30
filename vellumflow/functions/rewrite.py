"""Rewriting of bullets and placeholders as chains of Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumflow.functions import text as T

# Fillers and what replaces them, in order.
FILLERS = (
    (r"(?i)^[ \t]*(?:i|we)[ \t]+(?:was|were)[ \t]+responsible for[ \t]+", "Owned "),
    (r"(?i)^[ \t]*responsible for[ \t]+", "Owned "),
    (r"(?i)\bin order to\b", "to"),
    (r"(?i)\bvarious[ \t]+", ""),
    (r"(?i)\bsuccessfully[ \t]+", ""),
    (r"(?i)\bvery[ \t]+", ""),
    (r"(?i)\ba lot of\b", ""),
    (r"(?i)\betc\.?\b", ""),
    (r"(?i)\bstuff\b", "components"),
    (r"(?i)\bthings\b", "components"),
)
ANY_FILLER = "|".join(f"(?:{p})" for p, _ in FILLERS)
# Openers of support that stay as they are, and stronger words for others.
SUPPORT = ("helped", "assisted", "participated", "involved", "contributed", "supported", "aided")
UPGRADES = {"worked": "Built", "responsible": "Owned", "handled": "Managed", "made": "Built", "did": "Executed", "used": "Applied", "learned": "Applied", "created": "Designed and built", "wrote": "Authored"}
# What a bullet is about, the verb for it, and the stem by which its object would repeat it.
CONTEXT = (
    (r"(?i)\b(?:model|train|classif|predict|neural|accuracy)\b", "Trained", "train"),
    (r"(?i)\b(?:deploy|production|endpoint|docker|kubernetes)\b", "Deployed", "deploy"),
    (r"(?i)\b(?:pipeline|etl|ingest|warehouse)\b", "Engineered", "engineer"),
    (r"(?i)\b(?:api|service|backend|endpoint)\b", "Built", "built"),
    (r"(?i)\b(?:dashboard|report|visuali|chart)\b", "Built", "built"),
    (r"(?i)\b(?:optimis|optimiz|improve|reduc|speed|faster|latency)\b", "Optimised", "optimis"),
    (r"(?i)\b(?:test|qa|coverage|bug)\b", "Tested", "test"),
    (r"(?i)\b(?:research|analys|analyz|stud)\b", "Analysed", "analys"),
)
TOOL_BLANK, METRIC_PROMPT = "<the specific tools you used>", "[add a result that you can defend]"
NUMBER = r"[0-9]+(?:[.,][0-9]+)?%?"


def word_count(t: Column) -> Column:
    return F.size(F.filter(F.split(t, "[ \t]+"), lambda w: w != ""))


def weakness(bullet: Column) -> Column:
    first = T.first_word(bullet)
    n = word_count(bullet)
    return (
        F.when(first.isin(T.WEAK_OPENERS), 3.0).when(~first.isin(T.STRONG_VERBS), 1.5).otherwise(0.0)
        + F.when(T.has_metric(bullet), 0.0).otherwise(2.5)
        + F.when(n > 34, 1.0).otherwise(0.0)
        + F.when(n < 8, 1.0).otherwise(0.0)
        + F.when(bullet.rlike(ANY_FILLER), 1.0).otherwise(0.0)
    )


def without_filler(bullet: Column) -> Column:
    t = F.trim(bullet)
    for pattern, new in FILLERS:
        t = F.regexp_replace(t, pattern, new)
    return F.trim(F.regexp_replace(t, "[ \t]{2,}", " "))


def opened(t: Column) -> Column:
    """The text with a weak opener replaced by the verb of what it is about; openers of support stay."""
    first = T.first_word(t)
    rest = F.regexp_replace(t, "^[^ ]+ ?", "")
    head = F.lower(F.array_join(F.slice(F.split(rest, " +"), 1, 3), " "))
    verb = F.coalesce(*[F.when(F.lower(t).rlike(p) & ~F.contains(head, F.lit(stem)), v) for p, v, stem in CONTEXT], *[F.when(first == a, b) for a, b in UPGRADES.items()], F.lit("Delivered"))
    weak = (first.isin(T.WEAK_OPENERS) | first.isin(list(UPGRADES))) & ~first.isin(*SUPPORT)
    replaced = F.regexp_replace(F.concat(verb, F.regexp_replace(t, "^[ \t]*[A-Za-z0-9_]+", "")), "^([A-Za-z0-9_]+) +(?:on|with|for|in) +", "$1 ")
    capital = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))
    return F.when(weak, replaced).when((first != "") & ~first.isin(T.STRONG_VERBS) & ~first.isin(*SUPPORT), capital).otherwise(t)


def completed(t: Column, original: Column) -> Column:
    """Blanks for what a bullet leaves out: its tools, its result; and a full stop. A bullet that has a prompt gets no other."""
    bare = lambda x: F.regexp_replace(x, "[. ]+$", "")
    tools = F.when(~t.rlike(r"(?i)\b(?:using|with|in)\b") & (word_count(t) > 6) & ~F.contains(t, F.lit(TOOL_BLANK)) & ~t.rlike(r"\[add [^\]]*\]"), F.concat(bare(t), F.lit(f" using {TOOL_BLANK}"))).otherwise(t)
    result = F.when(~T.has_metric(original) & ~tools.rlike(r"\[add [^\]]*\]"), F.concat(bare(tools), F.lit(f", {METRIC_PROMPT}"))).otherwise(tools)
    return F.when(result.rlike(r"[.\]>]$"), result).otherwise(F.concat(result, F.lit(".")))


def numbers(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0))


def introduces_number(original: Column, rewritten: Column) -> Column:
    return F.size(F.array_except(numbers(rewritten), numbers(original))) > 0


def required_blanks(t: Column) -> Column:
    return F.size(F.filter(F.regexp_extract_all(t, F.lit("<[^>]*>"), F.lit(0)), lambda b: F.lower(b) != TOOL_BLANK))


def stripped_line(line: Column) -> Column:
    """A line without optional prompts and the tools' blank; null where only a list sign is left."""
    t = F.regexp_replace(line, r"(?i)[ \t]*(?:\b(?:using|with|via|through)\b[ \t]*)?" + TOOL_BLANK, "")
    t = F.regexp_replace(t, r"[ \t]*\[[^\]]*\]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ ,;:]+(\.?)$", "$1"), "[ \t]+$", "")
    return F.when(~(F.trim(t).isin("-", "-.", "") & (F.trim(line) != "")), t)


def escaped(t: Column) -> Column:
    """A text as it must stand in a page."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(sign), F.lit(name))
    return t


def safe_file_name(name: Column, extension: str) -> Column:
    t = F.regexp_replace(F.trim(F.regexp_replace(name, r"[^A-Za-z0-9 _.-]", "")), "[ \t]+", "_")
    t = F.when(t == "", "document").otherwise(F.substring(t, 1, 80))
    return F.when(F.endswith(F.lower(t), F.lit("." + extension)), t).otherwise(F.concat(t, F.lit("." + extension)))


# Kinds of questions in the order they are tried, with the words that show them.
INTENTS = (
    ("honest", [
        "without fake", "without adding fake", "without lying", "without exaggerat", "truthful", "honestly", "genuinely", "ethical", "not lie",
        "honest way",
    ]),
    ("fabricate", [
        "fake", "lie about", "make up", "made up", "invent", "pretend", "exaggerate", "pad my resume", "without having", "embellish",
    ]),
    ("score", [
        "score", "why is my", "compatibility", "match percentage", "rating", "how did you calculate", "breakdown", "how am i scored",
    ]),
    ("learn_first", [
        "learn first", "what should i learn", "which skill", "priority", "start with", "first skill", "where do i start",
    ]),
    ("projects", [
        "project", "build", "portfolio", "what to make",
    ]),
    ("ats", [
        "ats", "applicant tracking", "resume parse", "formatting", "keyword stuffing", "rejected by system",
    ]),
    ("keywords", [
        "keyword", "vocabulary", "phrases", "wording", "terms",
    ]),
    ("missing", [
        "missing", "gap", "what am i lacking", "what do i need", "not have",
    ]),
    ("timeline", [
        "how long", "timeline", "weeks", "months", "when will i be ready", "roadmap",
    ]),
    ("company", [
        "culture", "leadership principle", "interview", "screen", "hiring", "bar raiser", "what does the company", "how does",
    ]),
    ("experience", [
        "experience", "years", "internship", "fresher", "no experience",
    ]),
    ("strengths", [
        "strength", "what am i good at", "strong", "best part",
    ]),
)
# Fixed value: a request to add what the asker says not to have.
UNOWNED = r"\b(?:add|include|put|write|list|say|claim|mention|insert)\b[^?.!]{0,80}\b(?:i +)?(?:don'?t|do not|never|haven'?t|have not|didn'?t) +(?:have|had|used?|do|done|work|worked|know)\b"


def intent(question: Column) -> Column:
    low = F.lower(question)
    out = F.lit("default")
    for name, words in reversed(INTENTS):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return F.when(low.rlike(UNOWNED) & ~low.rlike("without|instead of|rather than"), "fabricate").otherwise(out)
