import random

from vellumflow.llm import leak, spam

WORDS = "amber brittle coastal dossier eastern fragile grudging harbour improvised junction lenient mandate nominal orchard payslip quota referral steward tariff urgent valve warden yardstick zeal".split()


def item(r, n):
    return [r.choice(WORDS) + r.choice(["", "s", "ed"]) + str(r.randint(0, 60)) for _ in range(n)]


def test_leaks(spark):
    r = random.Random(2)
    rule = "Choose the option that a careful reviewer would mark as correct and explain it in one short sentence below please".split()
    items = [rule + item(r, 60) for _ in range(30)]
    filler = lambda n: [f"plain{r.randint(0, 900)}" for _ in range(n)]
    docs, want = {}, set()
    for d in range(40):
        k, a = r.randrange(30), r.randint(20, 40)
        part = items[k][a : a + 26]
        edited = [w if i % 6 else r.choice(["other", w + " extra", ""]) for i, w in enumerate(part)]
        docs[d] = " ".join(filler(30)) + "\n<b>" + ", ".join(edited).upper() + "</b>!\n" + " ".join(filler(400))
        want.add((d, k))
    docs[50] = " ".join(rule) + " " + " ".join(filler(60))  # the shared instruction alone
    docs[51] = " ".join(filler(20) + items[3][25:37] + filler(20))  # too short a quotation
    docs[52], docs[53], docs[54] = None, "", "  "
    rows = [(d, t, 7) for d, t in docs.items()] + [(0, docs[0], 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, item bigint")
    it = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, None)], "item_id bigint, text string")
    for bound in (1_000_000, 500):  # one block of items and several
        got = leak.find_leaks(df, it, "doc_id", "text", "item_id", "text", block_seeds=bound)
        assert {(x.doc_id, x.item_id) for x in got.collect()} == want
    assert leak.find_leaks(df.where("doc_id > 90"), it, "doc_id", "text", "item_id", "text").count() == 0


def test_leaks_of_repeated_items(spark):
    r = random.Random(5)
    base = item(r, 50)
    # an item that stands thirty times, and thirty variants of another one: no instruction, all of them leak
    other = item(r, 50)
    variants = [[w if x != k else "changed" for x, w in enumerate(other)] for k in range(30)]
    items = [(n, " ".join(base)) for n in range(30)] + [(100 + n, " ".join(v)) for n, v in enumerate(variants)]
    docs = [(1, "before it " + " ".join(base[5:35]) + " after it"), (2, " ".join(other[10:45]))]
    got = leak.find_leaks(spark.createDataFrame(docs, "d bigint, t string"), spark.createDataFrame(items, "i bigint, t string"), "d", "t", "i", "t").collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(1, n) for n in range(30)} | {(2, 100 + n) for n in range(30)}


def exact_leaks(text, ws, least_words=20):
    """Whether any stretch of the text aligns with a stretch of the item: every start, the whole text, no seeds and no windows."""
    known = {w: n for n, w in enumerate(dict.fromkeys(ws))}
    a, b = leak.np.array([known[w] for w in ws]), leak.np.array([known.get(w, -1) for w in leak.words(text)])
    while len(b):
        score, before, text_span, span, matched = leak.align(a, b)
        if score < 5:
            return False
        if span >= least_words and len(matched) >= 0.7 * max(span, text_span) and len(matched) >= 15:
            return True
        b[before : before + text_span] = -1
    return False


def test_leaks_against_alignment_of_everything(spark):
    r = random.Random(11)
    items = [item(r, r.randint(30, 90)) for _ in range(12)]
    docs = []
    for d in range(60):
        k = r.randrange(12)
        n = r.randint(14, 30)
        a = r.randint(0, len(items[k]) - n)
        part = [w for w in items[k][a : a + n] for w in ([w] if r.random() > 0.2 else r.choice([[], ["new"], [w, "added"]]))]
        docs.append((d, " ".join(item(r, 40) + part + item(r, 40) + (part[:12] if d % 3 else []))))
    got = leak.find_leaks(spark.createDataFrame(docs, "d bigint, t string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "i bigint, t string"), "d", "t", "i", "t").collect()
    want = {(d, k) for d, t in docs for k, ws in enumerate(items) if exact_leaks(t, ws)}
    assert len(want) > 20 and {(x.doc_id, x.item_id) for x in got} == want


HONEST = "We are looking for a patient engineer to join the team in the north. You will work with the data and it is fine to ask. The office has a quiet room and we meet every week."


def test_pages(spark):
    rows = [
        (1, HONEST), (2, HONEST + "\nSkills: Go, SQL, Linux\nhttps://a.example/x\nwww.b.test/y"), (3, "best cv | free resume | best cv | salary | " * 20), (4, "\n".join(f"https://a{i}.example/jobs" for i in range(30))),
        (5, " ".join(["#bestcv #salary #remote"] * 15)), (6, HONEST + "\n" + "free resume best cv salary " * 60), (7, "\n".join(f"- [best cv](http://x{i}.test/a)" for i in range(30))), (8, None), (9, ""), (10, " \n "), (11, "!!!"),
        (12, "\n".join(f"SKU-{i} best cv pdf {i}.99" for i in range(30))), (3, "best cv | free resume | best cv | salary | " * 20), (13, "Die Prüfung bewertet Belege stärker als die Gestaltung und das Team ist in der Stadt. " * 3),
        (14, "\n".join('<a href="http://x.test/a">best cv</a>' for _ in range(20))), (15, "<b>We</b> are <b>in</b> the <i>north</i> and it is fine to ask for the data of the week."),
    ]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id bigint, text string, lang string, outside int")
    assert {r.doc_id for r in spam.find_stuffed(df, "doc_id", "text", "lang").collect()} == {3, 4, 5, 6, 7, 12, 14}
    assert {r.doc_id for r in spam.find_stuffed(df, "doc_id", "text").collect()} == {3, 4, 5, 6, 7, 12, 14}
    assert spam.find_stuffed(df.where("doc_id > 90"), "doc_id", "text").count() == 0


POLISH = [
    "Szukamy osoby, która chce pracować w naszym zespole i nie boi się pytać o dane. W biurze jest cicho, a spotkania są raz w tygodniu.", "List jest krótki, bo nie ma w nim nic o pracy, która się nie udała, i o tym, co z niej wynika.",
    "Nie wiem, czy to jest dobre miejsce, ale w zespole są osoby, które się na tym znają i chętnie o tym mówią.", "To jest praca w małym biurze, gdzie nie ma pośpiechu i gdzie każdy wie, co się dzieje w firmie.",
]


def test_languages_without_a_list(spark):
    honest = [(i, " ".join(POLISH[(i + k) % 4] for k in range(1 + i % 3)), "pl") for i in range(12)] + [(20, POLISH[0] + "\nPython, SQL, Linux", "pl"), (21, POLISH[1] + " " + POLISH[3], None)]
    stuffed = [(30, "praca zdalna | wzór cv | praca zdalna | " * 20, "pl"), (31, "\n".join(f"- [wzór cv](http://x{i}.test/a)" for i in range(30)), "pl"), (32, "#praca #cv #zarobki " * 15, None)]
    df = spark.createDataFrame(honest + stuffed, "doc_id bigint, text string, lang string")
    learned = spam.learn_words(df, "text", "lang")
    assert set(learned) == {"pl"} and {"w", "nie", "jest", "się"} <= set(learned["pl"]) and "zdalna" not in learned["pl"]
    assert {r.doc_id for r in spam.find_stuffed(df, "doc_id", "text", "lang").collect()} == {30, 31, 32}
