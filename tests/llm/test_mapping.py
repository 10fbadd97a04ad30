import random

from vellumflow.llm import mapping as M

ENTRIES = [(1, "Python", ["py", "python3"]), (2, "Machine Learning", ["ml", "statistical learning"]), (3, "C++", ["cpp"]), (4, "Object-Oriented Design", ["ood"]), (5, "Stream Processing", []), (6, ".NET", ["dotnet"]), (7, "Rust", []), (8, "Deep Learning", ["dl"])]
MATCHER = M.Matcher(ENTRIES)


def osa(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_meant():
    cases = {
        "python": 1, " PYTHON ": 1, "Pyt​hon": 1, "Ｐｙthon": 1, "Pythоn": 1, "py": 1, "Pythn": 1, "pyhton": 1, "machine-learning": 2, "MachineLearning": 2, "machin lerning": 2, "learning machine": 2,
        "Mach. Learning": 2, "Advanced Python": 1, "Python (3 yrs)": 1, "Rust v3": 7, "Python 2.0": 1, "C++ (advanced)": 3, "Obje. Design": 4, "Stre. Processing": 5, ".net 2.0": 6, "basic ml skills": 2, "Deep Lerning": 8,
    }
    assert {k: MATCHER.find(k) for k in cases} == cases


def test_not_meant():
    for v in ["Origami", "weekend pottery", "xxx", "???", "-", "good knowledge", "Ruby", "Ru", "pi", "x" * 10_000, "Chess club"]:
        assert MATCHER.find(v) == 0, v


def test_automaton_against_plain_distance():
    r = random.Random(3)
    forms = {s: e for s, e in MATCHER.exact.items()}
    for _ in range(1500):
        s = list(r.choice(list(forms)))
        for _ in range(r.randint(0, 3)):
            k, at = r.randint(0, 3), r.randint(0, max(0, len(s) - 1))
            if k == 0:
                s.insert(at, r.choice("abcdeimnprst+"))
            elif k == 1 and s:
                s.pop(at)
            elif k == 2 and s:
                s[at] = r.choice("abcdeimnprst")
            elif len(s) > 1:
                at = min(at, len(s) - 2)
                s[at], s[at + 1] = s[at + 1], s[at]
        q = "".join(s)
        best = min(((osa(q, f), e) for f, e in forms.items() if osa(q, f) <= min(2, M.allowed(len(f)))), default=None)
        assert MATCHER.nearest(q, 2) == (best if q else None), q
        every: dict = {}
        for f, e in forms.items():
            if osa(q, f) <= min(2, M.allowed(len(f))):
                every[e] = min(osa(q, f), every.get(e, 9))
        assert MATCHER.within(q, 2) == (every if q else {}), q


def test_one_edit():
    r = random.Random(8)
    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 5))) for _ in range(2))
        assert M.one_edit(a, b) == (osa(a, b) <= 1), (a, b)


def test_leftovers_are_remarks():
    m = M.Matcher([*ENTRIES, (9, "Research and Ethics Review Board Work", []), (10, "Go", []), (11, "Learning", [])])
    cases = {
        "rusty Python of old": 1, "everyday machine learning, mostly": 2, "mostly machin lerning": 2, "Go since school": 10, "Work Board Review Ethcs and Research": 9, "ethics and review board work research": 9,
        "machine learning": 2, "learning": 11, "Gopher keeping": 0, "learn": 0,
    }
    assert {k: m.find(k) for k in cases} == cases


def test_near_entries(spark):
    rows = [("deep learning",), ("Rsut",), ("Rust",), ("Rust",), (None,), (" ",), ("origami",)]
    got = {tuple(r) for r in M.near_entries(spark.createDataFrame(rows, "skill_id string"), "skill_id", ENTRIES).collect()}
    assert got == {("deep learning", 8, 0), ("Rsut", 7, 1), ("Rust", 7, 0)}


def test_in_spark(spark):
    rows = [(1, "pythn", 0), (2, None, 0), (3, " ", 0), (4, "Origami", 0), (5, "a, b", 0), (1, "pythn", 0), (6, '"Machine Learning"', 0)]
    df = spark.createDataFrame(rows, "id bigint, v string, n int")
    got = sorted((r.id, r.skill_id, r.n_values) for r in M.map_values(df, "v", ENTRIES, []).collect() if r.skill_id is not None)
    assert got == [(1, 1, 1), (1, 1, 1), (4, 0, 1), (5, 0, 2), (6, 2, 1)]
    assert M.map_values(df.where("id > 99"), "v", ENTRIES, []).count() == 0


def test_very_long_remarks():
    for value in ("Python (" + "used daily " * 400 + ")", " " * 5000 + "Rust", "Py" + "\u200b" * 5000 + "thon", "advanced " * 3000 + "Rust"):
        assert MATCHER.find(value) in (1, 7)
    assert MATCHER.find("unheard of " * 2000) == 0
