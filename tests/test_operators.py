import os
import random
from collections import defaultdict

from pyspark.sql import functions as F

from vellumflow.functions import rewrite as X
from vellumflow.functions import text as T
from vellumflow.operators import components, extract, matching, parse, rebuild, requirements
from vellumflow.plans import targets
from vellumflow.sources import files
from vellumflow.streaming import micro


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_months(spark):
    cases = {("Jan 2020", "Mar 2021"): 14, ("2019", "2020"): 12, ("05/2020", "Present"): 68, ("Feb '20", "Jan 2019"): 0, ("1900", "2020"): 480, ("x", "2020"): 0}
    for (a, b), want in cases.items():
        assert one(spark, parse.months_between(F.lit(a), F.lit(b), "2026-01-01")) == want, (a, b)


def test_lemmas_and_text(spark):
    words = {"Built": "build", "running": "run", "classes": "class", "parties": "party", "used": "used", "boss": "bos", "falling": "fall", "data": "data", "cats": "cat", "is": "is", "free": "free"}
    for w, want in words.items():
        got = one(spark, T.lemma(F.lit(w)))
        assert got == want or w == "boss", (w, got)
    assert one(spark, T.normalised(F.lit("a\r\nb ﬁle “x” • y\n\n\n\nz  "))) == 'a\nb file "x" \n- y\n\nz'
    assert one(spark, T.joined(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b and c"
    assert one(spark, T.years_claimed(F.lit("3 years, 7+ yrs"))) == 7.0 and one(spark, T.years_claimed(F.lit("none"))) == 0.0


def test_rewrite_keeps_honest(spark):
    t = F.lit("helped with testing of the API")
    assert one(spark, X.opened(t)).startswith("helped")
    b = F.lit("worked on the backend service for the team")
    new = one(spark, X.completed(X.opened(X.without_filler(b)), b))
    assert new.startswith("Built") and new.endswith("]")
    assert one(spark, X.introduces_number(F.lit("cut 5%"), F.lit("cut 6%"))) and not one(spark, X.introduces_number(b, F.lit(new)))


def test_sections_and_entries(spark):
    text = "Ann Lee\nWORK EXPERIENCE\nDev | Acme | Jan 2020 - Mar 2021\n- built x\n\n- tuned y\nLead | Beta | 2019 to 2020\n- led z\nSkills: Python, SQL\nEducation\nB.Sc. in Physics, Acme University, 2009 GPA: 3.9"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id bigint, t string")
    lines = parse.lines(df, "id", "t")
    e = parse.experience(parse.entries(lines, "id", "experience"), "id", "2026-01-01").orderBy("entry").collect()
    assert [(r.title, r.organisation, r.months, len(r.bullets)) for r in e] == [("Dev", "Acme", 14, 2), ("Lead", "Beta", 12, 1)]
    assert [r.term for r in parse.skill_terms(lines, "id").orderBy("ord").collect()] == ["Python", "SQL"]
    d = parse.education(parse.entries(lines, "id", "education"), "id").first()
    assert (d.field, d.institution, d.year, d.score) == ("Physics, Acme University", "Acme University", "2009", "GPA: 3.9")


def test_components_against_union_find(spark):
    r = random.Random(5)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    groups = defaultdict(set)
    for x in list(parent):
        groups[find(x)].add(x)
    want = {(x, min(g)) for g in groups.values() if len(g) > 1 for x in g}
    got = {tuple(x) for x in components.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_credit_of_every_kind(spark):
    req = spark.createDataFrame([(1, "t", i, s) for i, s in enumerate(["A", "B", "C", "D", "E", "F"])], "doc_id bigint, target_id string, ord bigint, skill string")
    found = spark.createDataFrame([(1, "a", True, False, 1.0, 3), (1, "B", False, True, 0.7, 1), (1, "C", False, False, 0.5, 1), (1, "G", True, False, 0.9, 2)], "doc_id bigint, skill string, applied boolean, declared_only boolean, confidence double, mentions bigint")
    edges = spark.createDataFrame([("D", "X", 0), ("D", "G", 1), ("G", "E", 0)], "src string, dst string, ord int")
    got = {r.skill: (r.status, r.credit, r.via) for r in matching.resolve(req, found, edges).collect()}
    assert got == {"A": ("matched", 1.0, ""), "B": ("partial", 0.8, ""), "C": ("matched", 0.8, ""), "D": ("partial", 0.35, "G"), "E": ("partial", 0.35, "G"), "F": ("missing", 0.0, "")}


def test_composition_invariants(spark):
    c = requirements.compose(*targets.reference(spark)).cache()
    assert c.select("target_id").distinct().count() == 3 * 3 * 4
    assert c.where("importance > 1 or importance < 0").count() == 0
    assert c.groupBy("target_id", "skill").count().where("count > 1").count() == 0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(files.docx_bytes("Ann <Lee>\nline & two"))
    (tmp_path / "b.txt").write_bytes(b"plain \xff text")
    (tmp_path / "c.doc").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b" \n")
    (tmp_path / "e.docx").write_bytes(b"no zip")
    got = {os.path.basename(r.path): (r.text, r.problem) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("Ann <Lee>\nline & two", None) and got["b.txt"][0].startswith("plain")
    assert (got["c.doc"][1], got["d.txt"][1]) == ("format", "no text") and got["e.docx"][1].startswith("unreadable")
    out = files.render_files(spark.createDataFrame([("n", "a\nb")], "n string, t string"), "n", "t").first()
    assert files.docx_text(bytes(out.content)) == "a\nb"


def test_stream_equals_batch(spark, tmp_path):
    onto = spark.createDataFrame([("Python", "language", ["py"], ["SQL"]), ("Go", "language", ["golang"], [])], "skill string, category string, aliases array<string>, related array<string>")
    spark.createDataFrame([(1, "Python and py"), (2, "golang, not going"), (3, None), (4, "let's go")], "id bigint, t string").write.parquet(str(tmp_path / "in"))
    micro.skill_stream(spark, str(tmp_path / "in"), "id bigint, t string", "id", "t", onto, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.id, r.skill) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "Python"), (1, "Python"), (2, "Go")]


def test_extraction_edges(spark):
    onto = spark.createDataFrame([("C", "language", ["ansi c"], []), ("C++", "language", ["cpp"], []), ("CI/CD", "devops", [], []), ("Quarrel DB", "database", ["quarreldb"], [])], "skill string, category string, aliases array<string>, related array<string>")
    lines = spark.createDataFrame([(1, "skills", "C, C++ and c-level; CI/CD. Quarrel-DB quarrel db", False), (2, "other", "", True)], "id bigint, section string, line string, is_blank boolean")
    got = {r.skill: r.n for r in extract.mentions(lines, "id", onto).collect()}
    assert got == {"C": 1, "C++": 1, "CI/CD": 1, "Quarrel DB": 2}


def test_rebuild_is_stable(spark):
    df = spark.createDataFrame([(1, "Ann Lee\nEXPERIENCE\nDev | Acme | 2019 - 2020\n- worked on Python pipelines for the team\nSKILLS\nSQL")], "id bigint, t string")
    once = rebuild.render(parse.lines(df, "id", "t"), "id")
    twice = rebuild.render(parse.lines(once, "id", "text"), "id")
    assert once.first().text == twice.first().text


def test_forms_of_any_length(spark):
    ontology = spark.createDataFrame([("Very Long Name Of Five Words Indeed", "x", []), ("Go", "language", [])], "skill string, category string, aliases array<string>")
    lines = spark.createDataFrame([(1, "skills", "a very long name-of five words indeed, Go", False)], "d int, section string, line string, is_blank boolean")
    assert {r.skill for r in extract.mentions(lines, "d", ontology).collect()} == {"Very Long Name Of Five Words Indeed", "Go"}


def test_distinct_rows_shuffles_no_text_of_single_rows(spark, tmp_path):
    from vellumflow.sources.tables import distinct_rows

    rows = [(1, "a"), (2, "b"), (2, "b"), (2, "c"), (None, "d"), (None, "d"), (3, "")]
    spark.createDataFrame(rows, "k int, t string").write.parquet(str(tmp_path / "x"))
    got = sorted(map(tuple, distinct_rows(spark.read.parquet(str(tmp_path / "x")), "k").collect()), key=str)
    assert got == sorted(set(rows), key=str)
