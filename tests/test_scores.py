"""Scores, sinks, narrow plans and queries without SQL."""

import math
import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from vellumflow.functions import text as T
from vellumflow.operators import matching as M
from vellumflow.operators import parse as P
from vellumflow.operators import posting as J
from vellumflow.operators import similarity as S
from vellumflow.plans import parsing
from vellumflow.sources import files, sinks


def cosine(a, b):
    """Cosine of two texts under weights of a collection of just these two."""
    terms = {t: (a.count(t), b.count(t)) for t in {*a, *b}}
    idf = {t: math.log(3 / (1 + (x > 0) + (y > 0))) + 1 for t, (x, y) in terms.items()}
    dot = sum(x * y * idf[t] ** 2 for t, (x, y) in terms.items())
    return dot / math.sqrt(sum((x * idf[t]) ** 2 for t, (x, _) in terms.items()) * sum((y * idf[t]) ** 2 for t, (_, y) in terms.items()))


def test_near_pairs_against_plain_cosine(spark):
    r = random.Random(4)
    vocab = [f"w{c}x" for c in "abcdefghijklmnopqrst"]
    left = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 12)))) for i in range(40)] + [(90, None), (91, ""), (3, "wax")]
    right = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 9)))) for i in range(15)] + [(50, None), (51, "")]
    a, b = spark.createDataFrame(left, "a bigint, t string"), spark.createDataFrame(right, "b bigint, t string")
    lemmas = {k: v for k, v in [(x.k, x.l) for x in b.select(F.col("b").alias("k"), T.content_lemmas(F.col("t")).alias("l")).where("t is not null").collect()]}
    ours = [(x.a, x.l) for x in a.where("t is not null").select("a", T.content_lemmas(F.col("t")).alias("l")).collect()]
    want = sorted((i, j, round(cosine(x, y), 9), len({*x} & {*y})) for i, x in ours for j, y in lemmas.items() if {*x} & {*y})
    got = sorted((x.a, x.b, round(x.cosine, 9), x.n_shared) for x in S.near_pairs(a, b, "a", "b", "t").collect())
    assert got == want
    top = S.near_pairs(a.where("a <> 3"), b, "a", "b", "t", 2).groupBy("a").count().collect()
    assert max(x["count"] for x in top) == 2
    assert S.near_pairs(a.where("a > 900"), b, "a", "b", "t").count() == 0 and S.near_pairs(a, b.where("b > 900"), "a", "b", "t").count() == 0


def test_given_pairs_are_those_of_all(spark):
    a = S.term_weights(spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta delta")], "a int, t string"), "a", "t", True)
    b = S.term_weights(spark.createDataFrame([(7, "beta gamma"), (8, "zeta")], "b int, t string"), "b", "t", True)
    every = {tuple(x) for x in S.pair_features(a, b, "a", "b").collect()}
    pairs = spark.createDataFrame([(1, 7), (2, 7), (1, 8)], "a int, b int")
    assert {tuple(x) for x in S.given_features(pairs, a, b, "a", "b").collect()} == every and len(every) == 2
    assert {tuple(x) for x in S.given_features(pairs, a, b, "a", "b", broadcast_rows=0).collect()} == every


def test_held_shares(spark):
    df = spark.createDataFrame([(1, "deep learning in C++"), (2, "nothing"), (3, "")], "k int, t string")
    names = spark.createDataFrame([("Deep Learning",), ("Learning Systems",), ("C++",), ("Rust",)], "n string")
    got = {(r.k, r.n): r.share for r in S.held_shares(df, "k", "t", names, "n").collect()}
    assert got[1, "Deep Learning"] == 1 and got[1, "C++"] == 1 and got[1, "Learning Systems"] == 0.5 and (1, "Rust") not in got and {k for k, _ in got} == {1, 2, 3}


def test_no_text_is_shuffled_for_evidence(spark, tmp_path):
    rows = [(i, f"Skills\n- Python and SQL {i}\nExperience\n- Built ETL") for i in range(50)]
    spark.createDataFrame(rows, "resume_id bigint, raw_text string").coalesce(1).write.parquet(str(tmp_path / "r"))
    ontology = spark.createDataFrame([("Python", "language", []), ("ETL", "data", [])], "skill string, category string, aliases array<string>")
    from vellumflow.operators import extract as E

    lines = P.lines(spark.read.parquet(str(tmp_path / "r")), "resume_id", "raw_text")
    plan = E.mentions(lines, "resume_id", ontology)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Window" not in plan
    for m in re.finditer(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan):
        assert not re.search(r"raw_text|line#|ls#|__l#", m[1]), m[1]


def test_segments_of_texts(spark):
    text = "Name here\nSkills: Python, SQL\nmore\n\nWork Experience\n- a thing\nSkills\nlast"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Skills")], "k int, t string")
    got = [(r.k, r.pos, r.line, r.section) for r in P.lines(df, "k", "t").orderBy("k", "pos").collect()]
    assert got == [(1, 0, "Name here", "header"), (1, 1, "Python, SQL", "skills"), (1, 2, "more", "skills"), (1, 3, "", "skills"), (1, 5, "- a thing", "experience"), (1, 7, "last", "skills"), (3, 0, "", "header")]
    long = spark.createDataFrame([(1, "Skills\nx\n" * 20_000)], "k int, t string")
    assert P.lines(long, "k", "t").where("section = 'skills'").count() == 20_000


def test_signal_counts_against_expressions(spark):
    texts = ["Engineer engineer ENGINEER engineers engineer", "data  scientist, machine learning; ml/ai", "front end\nand back end", "human resources hr", "", "site-reliability site reliability"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    groups = {"a": J.TECH_TERMS, "b": J.OTHER_TERMS}
    for r in J.signal_counts(df, "k", "t", groups).collect():
        low = re.sub(r"\s", " ", texts[r.k].lower())
        for g, terms in groups.items():
            assert r[g] == sum(min(J.CAP, len(re.findall(rf"\b{t}\b", low))) for t in terms), (texts[r.k], g)


def test_resolve_prefers_direct_then_ahead_then_back(spark):
    req = spark.createDataFrame([(1, "t", i, s) for i, s in enumerate(["A", "B", "C", "D", "E"])] + [(2, "t", 0, "A")], "doc_id int, target_id string, ord int, skill string")
    found = spark.createDataFrame([(1, "A", True, False, 0.9, 3), (1, "X", True, False, 0.5, 1), (1, "Y", True, False, 0.8, 1), (1, "D", False, True, 0.7, 1)], "doc_id int, skill string, applied boolean, declared_only boolean, confidence double, mentions int")
    edges = spark.createDataFrame([("B", "Q", 0), ("B", "X", 1), ("B", "Y", 2), ("X", "C", 0), ("Y", "C", 0)], "src string, dst string, ord int")
    got = {(r.doc_id, r.skill): (r.status, r.credit, r.via) for r in M.resolve(req, found, edges).collect()}
    assert got == {(1, "A"): ("matched", 1.0, ""), (1, "B"): ("partial", 0.35, "X"), (1, "C"): ("partial", 0.35, "Y"), (1, "D"): ("partial", 0.8, ""), (1, "E"): ("missing", 0.0, ""), (2, "A"): ("missing", 0.0, "")}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    analyses = spark.createDataFrame([(1, 10), (2, None)], "analysis_id int, resume_id int")
    suggestions = spark.createDataFrame([(1, "skills", ["a", "high-impact"], "x" * 5000), (1, "summary", [], None), (2, "skills", ["high-impact"], "y")], "analysis_id int, section string, tags array<string>, suggested string")
    projects = spark.createDataFrame([(1, "p"), (2, "q")], "analysis_id int, project_id string")
    sinks.store_analyses(analyses, suggestions, projects, path)
    got = {(r.analysis_id, r.section, r.priority, len(r.text)) for r in spark.read.parquet(f"{path}/suggestions").collect()}
    assert got == {(1, "skills", "high", 4000), (1, "summary", "medium", 0)} and spark.read.parquet(f"{path}/projects").count() == spark.read.parquet(f"{path}/analyses").count() == 1
    sinks.append_parsed(projects, f"{path}/parsed")
    sinks.append_parsed(projects, f"{path}/parsed")
    assert spark.read.parquet(f"{path}/parsed").count() == 4


def test_merging_reference_data_twice_changes_nothing(spark, tmp_path):
    stored = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "c", 6)], "k int, v string, n int")
    fresh = spark.createDataFrame([(2, "b", 5), (3, "z", 6), (4, "new", None)], "k int, v string, n int")
    once = sinks.merged(stored, fresh, ["k"])
    assert {(r.k, r.v, r.origin) for r in once.collect()} == {(1, "a", "kept"), (2, "b", "same"), (3, "z", "updated"), (4, "new", "inserted")}
    path = str(tmp_path / "ref")
    sinks.write_reference(once.drop("origin"), path)
    again = sinks.merged(spark.read.parquet(path), fresh, ["k"])
    assert {r.origin for r in again.collect()} == {"kept", "same"}
    sinks.write_reference(again.drop("origin"), path)
    assert spark.read.parquet(path).count() == 4


def test_files_to_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Skills\nPython")
    (folder / "b.docx").write_bytes(files.docx_bytes("Ann\nProjects\n- built it"))
    (folder / "c.doc").write_bytes(b"x")
    got = {(r.path.rpartition("/")[2], r.line, r.section) for r in parsing.parsed_files(spark, str(folder)).collect()}
    assert got == {("a.txt", "Python", "skills"), ("b.docx", "Ann", "header"), ("b.docx", "- built it", "projects")}


def test_pdf_files_are_whole(spark):
    text = "Ann (Lee)\n" + "\n".join(f"- line {i} " + "word " * 30 for i in range(80))
    data = files.pdf_bytes(text)
    assert data.startswith(b"%PDF-1.4") and data.rstrip().endswith(b"%%EOF") and data.count(b"/Type/Page/") == math.ceil(data.count(b"Tj") / 60)
    at = int(re.search(rb"startxref\n(\d+)", data)[1])
    assert data[at : at + 4] == b"xref"
    for n, place in enumerate(re.findall(rb"(\d{10}) 00000 n", data), 1):
        assert data[int(place) :].startswith(f"{n} 0 obj".encode())
    assert b"(Ann \\(Lee\\)) Tj" in data
    assert bytes(files.render_files(spark.createDataFrame([("n", "x")], "a string, b string"), "a", "b", "pdf").first().content).startswith(b"%PDF")


def test_queries_without_sql_have_rows(spark, sf_dir):
    q = entry.queries()
    for name in ("candidate_names", "rebuild_scores", "stored_children", "payload_phases", "skill_snippets", "p3_components"):
        df = q[name](spark, sf_dir)
        assert df.count() > 0, name
    r = q["rebuild_scores"](spark, sf_dir).where("after < before - 0.01").count()
    assert r == 0  # rewriting loses no skill
