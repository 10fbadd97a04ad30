import itertools

import numpy as np

from vellumflow.llm import canon
from vellumflow.llm.chars import folded, script

COUNTS = np.zeros((canon.SIZE, canon.SIZE))
for _w in "the quick brown fox writes python and machine learning services for people".split():
    _i = canon.letter_ids("\n" + _w + "\n").astype(int)
    for _a, _b in zip(_i, _i[1:]):
        COUNTS[_a, _b] += 5
TABLE = canon.scores(COUNTS)


def kinds(text):
    t, found = canon.canonical(text, TABLE)
    return t, {k for i, k in enumerate(canon.KINDS) if found >> i & 1}


def test_cases():
    assert kinds("Ｐｙｔｈｏｎ ３") == ("Python 3", {"fullwidth"})
    assert kinds("résumé") == ("résumé", {"apart"})
    assert kinds("ma​chi­ne") == ("machine", {"invisible"})
    assert kinds("two words　here") == ("two words here", {"space"})
    assert kinds("ﬁle") == ("file", {"joined"})
    assert kinds("mасhine") == ("machine", {"mixed"})
    assert kinds("le​аrn ｘ")[1] == {"invisible", "mixed", "fullwidth"}


def test_no_cases():
    for t in ["naïve façade", "“quoted” – dash — ‘x’…", "• ▪ · list", "русский язык", "ελληνικά", "日本語", "👩‍💻 and 🏳️‍🌈 and ✨", "β-tester", "tab\there\r", "plain", "", "c, a; b|d"]:
        assert kinds(t)[1] == set(), t


def test_idempotent_and_equal():
    for t in ["Ｐｙtｈоn​  ﬁ ré", "mасhine lеаrning", "x" * 5000 + "ｙ"]:
        once = canon.canonical(t, TABLE)[0]
        assert canon.canonical(once, TABLE) == (once, 0)
    assert canon.canonical("Ｐython", TABLE)[0] == canon.canonical("Py​thon", TABLE)[0] == "Python"


def test_equal_looking_lines_are_equal_over_code_points():
    # all of the basic plane but ideographs and syllables, and the planes' blocks that have compatibility forms or emoji
    ranges = [(0, 0x3500), (0xA000, 0xAC10), (0xD7A0, 0xD800), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x1EE00, 0x1FB00), (0x2F800, 0x2F900), (0xE0000, 0xE0200)]
    for o in itertools.chain(*[range(*r) for r in ranges]):
        line = f"ab {chr(o)} machine"
        form = canon.canonical(line, TABLE)[0]
        assert canon.canonical(form, TABLE)[0] == form, hex(o)
        for other in (f"a\u200bb {chr(o)} machine", f"ab\u00a0{chr(o)} machine", f"ａb {chr(o)} machine", f"ab {chr(o)} m\u0430chine"):
            assert canon.canonical(other, TABLE)[0] == form, (hex(o), other)


def test_signs_stay_on_both_paths():
    assert canon.canonical("½ cup … ™", TABLE)[0] == canon.canonical("½ c\u200bup … ™", TABLE)[0] == "½ cup … ™"


def test_the_lattice_decides():
    assert canon.best_path("m\u0430chine", TABLE) == ("machine", True)
    assert kinds("\u044ffgw") == ("\u044ffgw", {"mixed"})  # no path of one script


def test_fold_keeps_places():
    text = "Рr⁠оf. Fenvé Ｔｅｌ"
    plain, places = folded(text)
    assert plain == "Prof. Fenve Tel" and text[places[plain.index("T")]] == "Ｔ" and script("я") == "cyrillic" and script("1") == ""


def test_in_spark(spark):
    rows = [(1, "ａ", "k"), (2, None, "k"), (3, "", "k"), (1, "ａ", "k")]
    df = spark.createDataFrame(rows, "id bigint, t string, text string")
    got = sorted((r.id, r.text, r.found) for r in canon.canonical_texts(df, ["id"], "t", canon.bigram_counts(df, "t")).collect() if r.text is not None)
    assert got == [(1, "a", 1), (1, "a", 1), (3, "", 0)]
