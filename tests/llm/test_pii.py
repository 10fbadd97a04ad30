import random
import re

import numpy as np
import pytest

from vellumflow.llm import pii, pii_model, pii_train


def test_values():
    text = "Dr. Ann-Marie Lee\r\nAddress: Flat 3, 12 Mill Lane, Tarnby\nTel. +44 7700 900850 · ann.lee+cv@mail.example.org\nSSN: 926-71-8879\n- Kept it at version 4.25.11, see pkg@4.25.0\n- Moved 2,180,000 rows between 2019 - 2021\n"
    got = {(k, text[a:b]) for a, b, k in pii.find_in([text])[0]}
    assert ("email", "ann.lee+cv@mail.example.org") in got and ("phone", "+44 7700 900850") in got and ("id_number", "926-71-8879") in got
    assert any(k == "address" and v.startswith("Flat 3") for k, v in got) and not any("pkg" in v or "2019" in v for _, v in got)


def test_disguised_places():
    text = "Ｔｅｌ. ０２０ 7946 0７８0​ and m​ail: x.y@ma​il.example"
    spans = pii.find_in([text])[0]
    assert {k for _, _, k in spans} == {"phone", "email"}
    assert text[spans[0][0]] == "０" and text[spans[1][0]] == "x"


def test_held_out_accuracy():
    """Texts of the generator with another seed: four of five spans begin where they should."""
    r = random.Random(991)
    samples = [pii_train.invented(r) for _ in range(250)]
    right = total = 0
    for (text, gold), got in zip(samples, pii.find_in([t for t, _ in samples])):
        want = {(a, k) for a, _, k in gold}
        total += len(want)
        right += len(want & {(a, k) for a, _, k in got})
    assert right >= 0.8 * total


# Labelled by hand, in formats that neither the generator nor the labelling rules know: [kind:value].
BY_HAND = [
    "[name:Tomasz Wierzbicki]\n[email:t.wierzbicki@poczta.example] / [phone:+48 601 202 303]\nData engineer in Lodz since 2015",
    "Curriculum vitae of [name:Ingrid Solberg]\nMobile [phone:+47 912 34 567]\nE-mail [email:ingrid_solberg@nordpost.example]",
    "Reference: Prof. [name:Amara Okafor], Head of Physics, reachable under [email:a.okafor@physics.example.org]",
    "- Reported to [name:Lucia Fernandez] and shipped version 12.4.1 to 3,400 users in 2019",
    "Contact me at [email:noah.baker99@inbox.example] or call [phone:(415) 555-0134] after 18:00",
    "Order 4711-0815 was invoiced on 2021-03-04 for 12,500 EUR, ticket INC-20394",
    "[name:Priya Raman]\nAddress: [address:17 Harrow Street], Leeds\n[phone:0113 496 0123]",
    "Social security number: [id_number:531-24-7788]\nNationality: none given",
    "Led migration at Bluefin Systems; stack: Python 3.11, PostgreSQL 14, 10.0.0.1",
    "Applicant: [name:Henrik Larsen] | [email:henrik@larsen.example] | portfolio at henrik.example/work",
    "Supervised by Dr. [name:Mei Tanaka] at Kyoto Institute, thesis on graph mining",
    "Lives at [address:42 Willow Lane], Bristol. Phone: [phone:0117 496 0456]",
    "Wohnhaft [address:Lindenstrasse 12], Bremen, Tel. [phone:0421 555 7788]",
    "SSN: [id_number:219-09-9999], see also employee badge 5521",
    "Emergency contact: [name:Grace Mbeki], [phone:+27 82 555 1234]",
    "Send documents to [address:P.O. Box 2214], Galway",
    "Paired with [name:Oliver Grant] on the billing rewrite, 30 % fewer incidents",
    "National insurance: [id_number:QQ 12 34 56 C]",
    "[email:first.last@sub.domain.example.org], [email:other-mail@domain.example]",
    "Winter 2018 - Spring 2020: Senior Analyst, Meridian Partners",
]


def test_labelled_by_hand():
    right = found = total = 0
    for line in BY_HAND:
        want, text, at = set(), "", 0
        for m in re.finditer(r"\[(\w+):([^\]]+)\]", line):
            text += line[at : m.start()]
            want.add((m[1], len(text)))
            text += m[2]
            at = m.end()
        text += line[at:]
        got = {(k, a) for a, _, k in pii.find_in([text])[0]}
        right, found, total = right + len(want & got), found + len(got), total + len(want)
    assert right >= 0.85 * total and right >= 0.85 * found, (right, found, total)


def test_a_text_gives_the_same_whatever_stands_beside_it():
    r = random.Random(5)
    texts = [pii_train.invented(r)[0] for _ in range(40)] + [pii_train.random_name(r) for _ in range(40)] + ["\n".join(pii_train.invented(r)[0] for _ in range(9)) for _ in range(8)]
    together = pii.find_in(texts)
    assert [pii.find_in([t])[0] for t in texts] == together
    order = list(range(len(texts)))
    r.shuffle(order)
    assert [together[i] for i in order] == pii.find_in([texts[i] for i in order])


def test_long_values_are_whole():
    domain = "very-long-" * 14 + "domain.example.org"
    for text in (f"Mail: ann.lee@{domain} please", f"ann.lee@{domain}"):
        spans = pii.find_in([text])[0]
        assert ("email", f"ann.lee@{domain}") in {(k, text[a:b]) for a, b, k in spans}
        at = text.index("ann")
        assert pii._snapped(text, at, at + 25, "email") == (at, at + 8 + len(domain))


def test_stretches_are_decoded_as_the_whole():
    r = random.Random(12)
    p = pii.weights()
    texts = ["\n".join(pii_train.invented(r)[0] + "- built a plain thing for the whole team of the year" for _ in range(12)) for _ in range(30)]
    ids = [np.concatenate([[pii_model.BOS], pii_model.char_ids(pii.folded(t)[0]), [pii_model.EOS]]).astype(np.uint8) for t in texts]
    scores = pii._scored(p, ids)
    for s, tags in zip(scores, pii._decoded(p, scores)):
        assert (pii_model.viterbi(p, s[:, None, :], np.array([len(s)]))[:, 0] == tags).all()


def test_gradients():
    r = np.random.default_rng(0)
    p = pii_model.init_params(5, 1)
    ids, gold, n = r.integers(1, 60, (7, 3)), np.zeros((7, 3), dtype=np.uint8), np.array([7, 7, 5])
    gold[2, 0], gold[3, 0] = 1, 2
    loss, g = pii_model.loss_and_grads(p, ids.astype(np.uint8), gold, n)
    for name in ("rec_f", "table_b", "out_w", "trans"):
        flat = np.abs(g[name]).argmax()
        at = np.unravel_index(flat, g[name].shape)
        eps = 1e-2
        p[name][at] += eps
        up = pii_model.loss_and_grads(p, ids.astype(np.uint8), gold, n)[0]
        p[name][at] -= 2 * eps
        down = pii_model.loss_and_grads(p, ids.astype(np.uint8), gold, n)[0]
        p[name][at] += eps
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-2 * max(1e-3, abs(g[name][at])) + 1e-4, name


def test_viterbi_against_all_paths():
    import itertools

    r = np.random.default_rng(4)
    p = {"trans": r.normal(size=(pii_model.N_TAGS, pii_model.N_TAGS)).astype(np.float32)}
    em = r.normal(size=(3, 2, pii_model.N_TAGS)).astype(np.float32)
    lengths = np.array([2, 3])
    got = pii_model.viterbi(p, em, lengths)
    for s, n in enumerate(lengths):
        paths = [x for x in itertools.product(range(pii_model.N_TAGS), repeat=int(n)) if pii_model.ALLOWED_FIRST[x[0]] and all(pii_model.ALLOWED[a, b] for a, b in zip(x, x[1:]))]
        score = lambda x: sum(em[t, s, k] for t, k in enumerate(x)) + sum(p["trans"][a, b] for a, b in zip(x, x[1:]))  # noqa: B023, E731
        assert tuple(got[:n, s]) == max(paths, key=score)


def test_long_empty_and_repeated(spark):
    long = "Ann Lee\n" + "- built a thing for the team\n" * 4000 + "mail: a.b@mail.example\n"
    rows = [(1, long, "x"), (2, None, "x"), (3, "", "x"), (4, " ", "x"), (5, "a.b@mail.example", "x"), (5, "a.b@mail.example", "x")]
    df = spark.createDataFrame(rows, "id bigint, t string, kind string")
    got = [(r.id, r.kind, r.char_pos) for r in pii.find_values(df, "id", "t").collect()]
    assert (1, "email", long.index("a.b@")) in got and got.count((5, "email", 0)) == 2 and not {2, 3, 4} & {g[0] for g in got}
    assert {r.id: r.text for r in pii.redact_texts(df.where("id in (3, 5)"), "id", "t").distinct().collect()} == {3: "", 5: "[EMAIL]"}
    assert pii.find_values(df.where("id > 9"), "id", "t").count() == 0


def test_real_sample(sf_dir):
    pd = pytest.importorskip("pandas")
    df = pd.read_parquet(f"{sf_dir}/resumes.parquet").drop_duplicates("resume_id")
    pattern = pii_train.name_pattern(*pii_train.name_lists([x for x in df.candidate_name if isinstance(x, str)]))
    texts = [x for x in df.raw_text if isinstance(x, str) and x.strip()]
    right = total = 0
    for t, got in zip(texts, pii.find_in(texts)):
        f, places = pii.folded(t)
        want = {(int(places[a]), k) for a, _, k in pii_train.labels(f, pattern)}
        total += len(want)
        right += len(want & {(a, k) for a, _, k in got})
    assert right >= 0.9 * total
