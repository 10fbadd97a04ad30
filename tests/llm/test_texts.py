import __spark_entry__ as entry
from vellumflow.llm import queries as Q


def test_every_line_has_its_consistent_text(spark, sf_dir):
    lines = {(r.field, r.doc_id, r.pos, r.line) for r in Q._lines(spark, sf_dir).distinct().collect()}
    by_key = {}
    for field, doc, pos, line in lines:
        by_key.setdefault((field, doc, pos), set()).add(line)
    rows = entry.queries()["p4_texts"](spark, sf_dir).collect()
    got = {}
    for r in rows:
        got.setdefault((r.field, r.doc_id, r.pos), set()).add(r.text)
    assert set(got) == set(by_key)
    found = {(r.field, r.doc_id, r.pos) for r in entry.queries()["p4_found"](spark, sf_dir).collect()}
    assert found and all(got[k] != by_key[k] for k in found)


def test_repeated_deliveries_give_their_lines_once(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "a\nｂ"), (1, "a\nｂ"), (2, "c")], "resume_id bigint, raw_text string").write.parquet(f"{folder}/resumes.parquet")
    spark.createDataFrame([(1, ["d", None]), (1, ["d", None]), (3, None)], "doc_id bigint, bullets array<string>").write.parquet(f"{folder}/parsed_resume.parquet")
    got = [tuple(r) for r in Q.p4_texts(spark, folder).select("field", "doc_id", "pos", "text").collect()]
    assert len(got) == len(set(got)) == 5 and ("raw_text", 1, 1, "b") in got


def test_kept_lines(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "plain line\nﬁne\u200b line\n"), (2, None)], "resume_id bigint, raw_text string").write.parquet(f"{folder}/resumes.parquet")
    spark.createDataFrame([(1, ["fine line", None])], "doc_id bigint, bullets array<string>").write.parquet(f"{folder}/parsed_resume.parquet")
    got = {tuple(r) for r in Q.p4_texts(spark, folder).select("field", "doc_id", "pos", "text").collect()}
    assert got == {("raw_text", 1, 0, "plain line"), ("raw_text", 1, 1, "fine line"), ("raw_text", 1, 2, ""), ("bullets", 1, 0, "fine line"), ("bullets", 1, 1, None)}
