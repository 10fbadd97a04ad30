import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumflow.operators import nested as N


def walk(text, arrays):
    """(node, parent) of one record, object by object, by recursion: the plain form that `flatten` is held against."""
    out = []

    def go(v, p, node, parent, element):
        v = N.contained(v)
        if not element and type(v) is dict and p in arrays and p != N.ROOT:
            v = [v]
        if type(v) is list:
            for i, x in enumerate(v):
                here = f"{p}/{N.ITEM}" if element and p else N.ITEM if element else p
                go(x, here, f"{node}/{i}" if node else str(i), parent, True)
        elif type(v) is dict:
            if element:
                out.append((node, parent))
                parent = node
            seen = set()
            for k, x in v.items():
                s = N.snake(k)
                if x is None or s in seen:
                    continue
                x = N.contained(x)
                if type(x) in (dict, list):
                    seen.add(s)
                    go(x, f"{p}/{s}" if p else s, f"{node}/{s}" if node else s, parent, False)

    v = N.read_json(text)
    if v is not None:
        go(v, N.ROOT, "", "", False)
    return out


def both(texts):
    arrays, objects = set(), set()
    for t in texts:
        v = N.read_json(t)
        if v is not None:
            N._paths(v, arrays, objects)
    f = N.Flattener({"arrays": sorted(arrays), "objects": sorted(objects)})
    rows = [(int(i), n, p) for _, row, node, parent, _ in f.batch(pa.array(texts, pa.string())) for i, n, p in zip(row, node.to_pylist(), parent.to_pylist())]
    assert len(rows) == len(set(rows))
    return set(rows), {(i, n, p) for i, t in enumerate(texts) for n, p in walk(t, f.shape.arrays)}


def test_cases():
    texts = [
        '{"aB": [{"x": 1}, null, 3, {"c": [{"d": 1}]}]}', '{"aB": {"c": {"d": 2}}}', '﻿{"a_b": "[{\\"c\\": [{}]}]"}', '"{\\"aB\\": [{}]}"',
        "null", "", None, "nope", '{"a": NaN}', '{"a_b": [', "[]", '[{"q": [[{"z": 1}], [null, {"z": 2}]]}]', '{"a_b": [{"c": null}, {"c": []}], "aB": [{}]}', "3", '"text"',
    ]
    got, want = both(texts)
    assert got == want
    assert (0, "a_b/0", "") in got and (0, "a_b/3/c/0", "a_b/3") in got and not any(n == "a_b/1" for i, n, _ in got if i == 0)
    assert (1, "a_b/0", "") in got and (1, "a_b/0/c/0", "a_b/0") in got  # a lone object is element 0
    assert {i for i, _, _ in got} == {0, 1, 2, 3, 11, 12}
    assert (11, "0/q/1/1", "0") in got


def test_strings_with_leading_white_space():
    for lead in ("\n", "\t", " ", "\r\n  ", "\ufeff\n"):
        part = lead + '[{"c": [{}]}]'
        for texts in ([json.dumps({"a": part})], [json.dumps({"a": [part]})], [json.dumps({"a": part}), '{"a": [{"c": [{}]}]}']):
            got, want = both(texts)
            assert got == want and {"a/0" if texts[0][6] == '"' else "a/0/0"} <= {n for i, n, _ in got if i == 0}


def test_deep_records():
    n = 3000
    texts = ['{"a": [' * n + "{}" + "]}" * n, '{"a": [{"b": 1}]}', "[" * n + '{"x": 1}' + "]" * n, '{"a": ' * 90 + '[{}]' + "}" * 90]
    arrays, objects = set(), set()
    for t in texts:
        N._paths(N.read_json(t), arrays, objects)
    f = N.Flattener({"arrays": sorted(arrays), "objects": sorted(objects)})
    count = {}
    for _, row, _, _, _ in f.batch(pa.array(texts, pa.string())):
        for i in row.tolist():
            count[i] = count.get(i, 0) + 1
    assert count == {0: n, 1: 1, 2: 1, 3: 90}


def test_texts_that_only_look_like_one_record():
    texts = ['{"a": [{}]}', '{"a": [{}]}{"a": [{}]', ', "b": 2}', '{"a": [{}]}}\n{"n": 1, "v": {}', '{"a": [{"x": "raw\nend"}]}', '{"a": [{"x": NaN}]}', '{"a": [{}], "a": [{}, {}]}', '{"a": [{"x": "\\ud800"}]}']
    got, want = both(texts)
    assert got == want and {i for i, _, _ in got} == {0, 6, 7}


def test_most_records_are_not_walked(spark, sf_dir):
    for name, column in (("resumes", "parsed"), ("resume_analyses", "payload")):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        r = N.odd_share(df, column, N.array_paths(df, column)).first()
        assert r.n_records > 0 and r.n_walked < 0.5 * r.n_records, (name, r)


def test_snake_keys():
    assert [N.snake(k) for k in ("skillSectionTerms", "a_b", "HTTPServer", "Two words", "x-y", "aB2C")] == ["skill_section_terms", "a_b", "http_server", "two_words", "x_y", "a_b2_c"]


leaf = st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab{[", max_size=3)
trees = st.recursive(leaf, lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["a", "bC", "b_c", "d"]), c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["a", "bC", "d"]), trees, max_size=3), min_size=1, max_size=4))
def test_against_plain_walk(values):
    texts = [json.dumps(v) for v in values]
    got, want = both(texts)
    assert got == want


def test_in_spark(spark):
    rows = [(1, '{"a": [{"k": "v", "n": 2.5}, {"k": null}]}', "x"), (1, '{"a": [{"k": "v", "n": 2.5}, {"k": null}]}', "x"), (2, None, "y"), (3, "bad", "z")]
    df = spark.createDataFrame(rows, "id bigint, j string, node string")
    flat = N.flatten(df, "id", "j", N.array_paths(df, "j"), with_values=True)
    t = N.child_table(flat, "a", ["k", "n", "missing"]).distinct().orderBy("node").collect()
    assert [tuple(r) for r in t] == [(1, "a/0", "", "v", "2.5", None), (1, "a/1", "", None, None, None)]
    assert N.flatten(df.where("id > 9"), "id", "j", N.array_paths(df.where("id > 9"), "j")).count() == 0
