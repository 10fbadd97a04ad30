from hypothesis import given, settings
from hypothesis import strategies as st

from vellumflow.operators.packed import Tokenizer, split_packed, vocabulary

NAMES = ["CI/CD", "A/B Testing", "Research and Ethics Review", "C++", "Python"]
TOK = Tokenizer(NAMES)


def test_separators():
    cases = {
        "a, b": ["a", "b"], "a;b|c": ["a", "b", "c"], "a • b · c": ["a", "b", "c"], "a\nb\tc": ["a", "b", "c"], "a，b、c": ["a", "b", "c"], "a   b": ["a", "b"],
        "a and b": ["a", "b"], "a, b, and c": ["a", "b", "c"], "a & b + c - d": ["a", "b", "c", "d"], "a/b": ["a", "b"], "front-end": ["front-end"], "one value": ["one value"],
    }
    for text, want in cases.items():
        assert TOK.values(text) == want, text


def test_nothing_separates_inside():
    assert TOK.values('"Search, Ranking & Recall", b') == ["Search, Ranking & Recall", "b"]
    assert TOK.values('"Billing; ""Dunning""" + x') == ['Billing; "Dunning"', "x"]
    assert TOK.values("Quarrel (sharded, v3), (x; (y, z)) w, v") == ["Quarrel (sharded, v3)", "(x; (y, z)) w", "v"]
    assert TOK.values("a/b testing / ci/cd / research AND ethics review") == ["a/b testing", "ci/cd", "research AND ethics review"]


def test_wrappings_and_unbalanced():
    assert TOK.values('["a","b, c"]') == ["a", "b, c"]
    assert TOK.values("Data & Cloud: a|b") == ["a", "b"]
    assert TOK.values('"open, b') == ['"open', "b"]
    assert TOK.values("(open, b") == ["(open", "b"]
    assert TOK.values("open), b") == ["open)", "b"]


def test_quotes_hide_brackets():
    assert TOK.values('(a "x)" b, c), d') == ['(a "x)" b, c)', "d"]
    assert TOK.values('"a (b", c), d') == ["a (b", "c)", "d"]
    assert TOK.values('x (a "y, z) w, v') == ['x (a "y, z) w', "v"]
    assert TOK.values("a (b (c, d), e") == ["a (b (c, d)", "e"]
    assert TOK.values('say ("a, b", c; d) | "e \\" f, g" | (h') == ['say ("a, b", c; d)', 'e " f, g', "(h"]


def test_empty_repeated_and_long():
    assert TOK.values(None) == TOK.values("") == TOK.values(" , ;; ") == []
    assert TOK.values("a,,a, ,a;") == ["a", "a", "a"]
    assert len(TOK.values("x, " * 50_000)) == 50_000
    assert len(TOK.values('"' * 20_001 + ",a")) >= 1
    assert TOK.values("(" * 200_000 + ",a")[-1] == "a"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc", "Zs", "Zl", "Zp"), blacklist_characters='"\\'), min_size=1, max_size=12), min_size=2, max_size=8))
def test_round_trip_of_quoted_values(values):
    assert TOK.values(",".join('"' + v + '"' for v in values)) == values


def test_in_spark(spark):
    rows = [(1, "a, b", "x", 9), (1, "a, b", "x", 9), (2, None, "y", 9), (3, "", "z", 9), (4, "single", "z", 9)]
    df = spark.createDataFrame(rows, "id bigint, v string, term string, pos int")  # names that clash with the result's
    got = sorted(tuple(r) for r in split_packed(df, ["id"], "v", NAMES, 2).collect())
    assert got == [(1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (1, 1, "b")]
    assert split_packed(df.where("id > 99"), ["id"], "v").count() == 0
    onto = spark.createDataFrame([("CI/CD", None), ("Go", ["a and b"]), (None, [])], "skill string, aliases array<string>")
    assert sorted(vocabulary(onto)) == ["CI/CD", "a and b"]
