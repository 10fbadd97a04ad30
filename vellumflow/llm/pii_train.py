"""Trains the tagger of `pii` and writes its weights: `python -m vellumflow.llm.pii_train SF_DIR`.

Labelled spans: at most MAX_DOCS résumés (a bounded sample) are labelled by context rules and the lists of given and
family names in candidate_name; the names of two fifths of them are then replaced by random ones, so that context and shape are
learned and not a list. Contact columns and short invented lines with other labels and formats complete the sample.
"""

from __future__ import annotations

import random
import re
import sys
import time
from pathlib import Path

import numpy as np

from vellumflow.llm import pii_model as M
from vellumflow.llm.chars import folded

MAX_DOCS = 2400
WINDOW, HIDDEN, BATCH, EPOCHS, RATE = 128, 48, 128, 14, 4e-3
WEIGHTS = Path(__file__).with_name("pii_bilstm_crf.npz")

EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@| @ | ?\[at\] ?| ?\(at\) ?)[A-Za-z0-9-]+(?:(?:\.| \(dot\) )[A-Za-z0-9-]+)*(?:\.| \(dot\) )[A-Za-z]{2,}")
PHONE = re.compile(
    r"(?<![\w./@-])(?:\+1 \d{3} \d{3} \d{4}|\+44 \d{4} \d{6}|\+49 \d\d \d{5} ?\d{3}|\+33\d{9}|0049 \(0\)\d\d \d{8}|0\d{4} \d{3} \d{3}"
    r"|0\d\d \d{4} \d{4}|0\d(?: \d\d){4}|0\d\d/\d{5}-\d{3}|1-\d{3}-\d{3}-\d{4}|\(\d{3}\) \d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|[2-9]\d{9}|555-\d{4})(?![\w/-])"
)
ID = re.compile(
    r"(?<![\w-])(?:QQ ?\d\d ?\d\d ?\d\d ?[A-D]\b|(?<=Tax ID: )\d\d \d{3} \d{3} \d{3}|(?<=National ID )\d{4} \d{4} \d{4}|(?<=Passport )[A-Z]\d{7}"
    r"|(?<=DNI/NIE )[A-Z]\d{7}-[A-Z]|(?<=licence no\. )[A-Z]{4}\d{6}[A-Z]\d[A-Z]|(?<=SSN: )\d{3}-\d\d-\d{4}|(?<=security number is )\d{3}-\d\d-\d{4})"
)
_STREET = "Street|St|Road|Rd|Lane|Ln|Blvd|Boulevard|Court|Ct|Row|Avenue|Ave|Drive|Dr|Close|Square|Sq|Way|Terrace|Hill|Crescent|Place|Gardens|Mews"
ADDRESS = re.compile(
    r"(?<![\w])(?:(?:(?:Flat|Apt\.?|Unit|Suite|Room) ?\d+[a-z]?(?:[,/]| ) ?)?(?:\d{1,4}[a-z]? (?:[A-Z][\w']+ ){1,2}(?:" + _STREET + r")\b\.?(?:, (?:Apt|Flat|Unit) \d+)?"
    r"|\d{1,4}[a-z]?,? (?:rue|allee|avenue|chemin|place|quai|boulevard|impasse) (?:(?:des|du|de la|de) )?[A-Z][\w'-]+)"
    r"|(?:Calle|Avenida|Plaza|Paseo) (?:del |de la |de )?[A-Z]\w+ \d+(?:, \d+\.?[A-Z])?|(?:Am|An der|Im) (?:[A-Z]\w+ )+\d+[a-z]?"
    r"|[A-Z]\w*(?:stieg|stra[sß]s?e|weg|platz|allee|gasse|ring|damm|ufer) \d+[a-z]?\b|P\. ?O\. Box \d+|PO Box \d+|Postfach \d+)"
)
_TITLE = re.compile(r"^(?:Dr|Prof|Mx|Mr|Mrs|Ms|Sir|Candidate|Name|Curriculum Vitae)\b[.:]?(?: -)?\s*", re.I)
_SYLLABLES = "an ben cor da el fa gri ho il ja ka lo mi na or pe qui ra so ta u va wen xi yo zu bra ste mor lin dra thi mon ves ker sal".split()
_NAME_ENDS = "er ova sen ez ini ski mann ton berg ford wick elli ak ay oto ung ara".split()
_ROLES = "Nurse|Data Engineer|Architect|Team Lead|Accountant|QA Engineer|Teacher|Cloud Engineer".split("|")


def _word(r: random.Random, n: int, end: bool = False) -> str:
    return ("".join(r.choice(_SYLLABLES) for _ in range(n)) + (r.choice(_NAME_ENDS) if end else "")).capitalize()


def random_name(r: random.Random) -> str:
    first = _word(r, r.choice([1, 2, 2, 3])) + ("-" + _word(r, 2) if r.random() < 0.06 else "")
    last = _word(r, r.choice([1, 1, 2]), True)
    last = r.choice(["", "", "", "", "", "", "", "O'", "de ", "van ", "al-", "Mc"]) + last + ("-" + _word(r, 1, True) if r.random() < 0.08 else "")
    mid = f" {r.choice('ABCDEFGJKLMNPRST')}." if r.random() < 0.1 else ""
    return f"{first}{mid} {last}"


_PREFIX = r"(?:de |van |von |al-|o['’]|mc)"


def name_lists(names: list[str]) -> tuple[set[str], set[str]]:
    """Parts of given and of family names, lower case, without prefixes."""
    first, last = set(), set()
    for raw in names:
        n = _TITLE.sub("", folded(raw)[0].strip())
        m = re.match(rf"([A-Za-z]+(?:-[A-Za-z]+)?)(?: [A-Z]\.)? (?:{_PREFIX})?([A-Za-z]+(?:-[A-Za-z]+)?)(?:,? .*)?$", n, re.I)
        if m and "," not in n.split(" ")[0] and (not m[1].isupper() or n.isupper()):
            first.update(m[1].lower().split("-"))
            last.update(m[2].lower().split("-"))
    return first - {"resume", "unknown"}, last - {"final"}


def name_pattern(first: set[str], last: set[str]) -> re.Pattern:
    f = "|".join(sorted(map(re.escape, first), key=len, reverse=True))
    l = "|".join(sorted(map(re.escape, last), key=len, reverse=True))  # noqa: E741
    given, family = rf"(?:{f})(?:-(?:{f}))?(?: [A-Z]\.)?", rf"{_PREFIX}?(?:{l})(?:-(?:{l}))?"
    return re.compile(rf"(?<![\w@/.-])(?:{given} {family}|{family},? {given})(?![\w@]|-\w)", re.I)


def labels(text: str, names: re.Pattern | None) -> list[tuple[int, int, str]]:
    """Spans of a folded text by the context rules, without overlaps: earlier kinds win."""
    found: list[tuple[int, int, str]] = []
    for kind, pattern in (("email", EMAIL), ("id_number", ID), ("address", ADDRESS), ("phone", PHONE), ("name", names)):
        for m in pattern.finditer(text) if pattern else ():
            if all(m.end() <= a or m.start() >= b for a, b, _ in found):
                found.append((m.start(), m.end(), kind))
    return sorted(found)


def renamed(text: str, spans: list, r: random.Random) -> tuple[str, list]:
    """The text with its names (and digits of other values) replaced by random ones."""
    out, moved, at = [], [], 0
    n = 0
    for a, b, kind in spans:
        out.append(text[at:a])
        n += a - at
        value = text[a:b]
        if kind == "name" and "," not in value:
            new = random_name(r)
            value = new.upper() if value.isupper() else new
        elif kind in ("phone", "id_number") and r.random() < 0.5:
            value = re.sub(r"\d", lambda m: m[0] if m[0] in "01" else str(r.randint(2, 9)), value)
        moved.append((n, n + len(value), kind))
        out.append(value)
        n += len(value)
        at = b
    out.append(text[at:])
    return "".join(out), moved


def invented(r: random.Random) -> tuple[str, list]:
    """A short text with other labels and formats than the résumés have."""
    d = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))
    name = random_name(r)
    org = _word(r, 2, True) + r.choice([" Bank", " Partners", " Systems", " & Sons", " Energy", " Media", " Labs"])
    mail = f"{_word(r, 2).lower()}{r.choice(['.', '_', '', '-'])}{_word(r, 1, True).lower()}{r.choice(['', d(2)])}{r.choice(['@', '@', ' [at] ', '(at)'])}{_word(r, 2).lower()}.{r.choice(['com', 'example.org', 'net', 'test'])}"
    phone = r.choice([f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"0{d(4)} {d(3)} {d(3)}", f"+{r.randint(1, 99)}{d(10)}", f"0{d(2)}/{d(5)}-{d(3)}", f"{d(3)}-{d(3)}-{d(4)}"])
    idn = r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"QQ{d(6)}C", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"X{d(7)}", f"{d(4)} {d(4)} {d(4)}", f"{_word(r, 2)[:4].upper()}{d(6)}A{d(1)}X"])
    street = r.choice([f"{r.randint(1, 300)} {_word(r, 2)} {r.choice(_STREET.split('|'))}", f"{r.randint(1, 99)}, rue du {_word(r, 2)}", f"Calle de {_word(r, 2)} {r.randint(1, 99)}", f"{_word(r, 2)}weg {r.randint(1, 99)}", f"P.O. Box {d(4)}", f"Am {_word(r, 2)} {r.randint(1, 200)}"])
    town = _word(r, 3)
    forms: list = [
        [("Name: ", None), (name, "name"), ("\nHome address: ", None), (street, "address"), (f", {town}\n", None)],
        [(name, "name"), ("\n", None), (r.choice(["Phone ", "Cell: ", "T ", "Tel. ", ""]), None), (phone, "phone"), (" | ", None), (mail, "email"), ("\n", None)],
        [(f"- Worked with {r.choice(['Ms ', 'Dr. ', '', ''])}", None), (name, "name"), (f" at {org} on reporting\n", None)],
        [(r.choice(["Social security no. ", "Passport no. ", "NIN: ", "Tax number ", "Driving licence ", "National insurance: ", "SSN ", "Steuer-ID "]), None), (idn, "id_number"), ("\n", None)],
        [(f"Invoice {d(4)}-{d(2)}-{d(4)}, order {d(3)}-{d(2)}-{d(3)} for {org}\n", None)],
        [(f"- Moved {d(1)},{d(3)},{d(3)} rows between 20{d(2)} - 20{d(2)} with version {d(1)}.{d(2)}.{d(2)}, see lib@{d(1)}.{d(2)}.0\n", None)],
        [("Referees\n", None), (r.choice(["Prof. ", "Dr. ", "Mrs ", ""]), None), (name, "name"), (f", {r.choice(_ROLES)}, {org}, ", None), (mail, "email"), (r.choice([" / ", ", call "]), None), (phone, "phone"), ("\n", None)],
        [(f"{_word(r, 2)} {r.choice(['Ledger', 'Garden', 'University', 'College', 'Notebook'])}\nB.Sc. in Physics, {org}, 20{d(2)}\n{town} {_word(r, 2)}\n", None)],
        [(f"Lives at ", None), (street, "address"), (f", {town} · ", None), (phone, "phone"), (" · ", None), (mail, "email")],
        [(name, "name"), (" <", None), (mail, "email"), (">", None)],
        [(name, "name"), (r.choice([", ", " - "]), None), r.choice([(phone, "phone"), (mail, "email")])],
        [(mail, "email"), ("; ", None), (mail[::1].replace("@", "2@"), "email")],
        [(phone, "phone"), (" or ", None), (phone, "phone")],
    ]
    text, spans = "", []
    for part, kind in r.choice(forms):
        if kind:
            spans.append((len(text), len(text) + len(part), kind))
        text += part
    return text, spans


def tag_ids(n: int, spans: list) -> np.ndarray:
    t = np.zeros(n, dtype=np.uint8)
    for a, b, kind in spans:
        k = 1 + 2 * M.KINDS.index(kind)
        t[a] = k
        t[a + 1 : b] = k + 1
    return t


def windows(samples: list, r: random.Random) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    xs, ys, ns = [], [], []
    for text, spans in samples:
        ids = np.concatenate([[M.BOS], M.char_ids(text), [M.EOS]]).astype(np.uint8)
        tags = np.concatenate([[0], tag_ids(len(text), spans), [0]]).astype(np.uint8)
        at = 0
        while at < len(ids):
            x, y = ids[at : at + WINDOW], tags[at : at + WINDOW]
            if y.any() or r.random() < 0.4:
                xs.append(np.pad(x, (0, WINDOW - len(x))))
                ys.append(np.pad(y, (0, WINDOW - len(y))))
                ns.append(len(x))
            at += r.randint(WINDOW // 2, WINDOW)
    ys = np.array(ys)
    # a span cut by the window's left edge begins with its inner tag; the sequence model needs an opening tag there
    cut = (ys[:, 0] > 0) & (ys[:, 0] % 2 == 0)
    ys[cut, 0] -= 1
    return np.array(xs), ys, np.array(ns)


def train(sf_dir: str, epochs: int = EPOCHS, more: bool = False) -> None:
    """Trains for `epochs`, whatever time they take, so that training repeats; `more` goes on from the weights there are."""
    import pandas as pd

    r = random.Random(7)
    df = pd.read_parquet(f"{sf_dir}/resumes.parquet").drop_duplicates("resume_id").sort_values("resume_id")
    pattern = name_pattern(*name_lists([x for x in df.candidate_name if isinstance(x, str)]))
    texts = [folded(x)[0] for x in df.raw_text if isinstance(x, str) and x.strip()]
    r.shuffle(texts)
    texts = texts[: MAX_DOCS + 150]
    fields = [folded(x)[0] for c in ("candidate_name", "email", "phone") for x in df[c] if isinstance(x, str) and x.strip()]
    r.shuffle(fields)
    fields = fields[:4000]
    labelled = [(t, labels(t, pattern)) for t in texts]
    held, labelled = labelled[:150], labelled[150:]
    field_samples = [(t, labels(t, pattern)) for t in fields]
    p = M.init_params(HIDDEN, 3)
    if more and WEIGHTS.exists():
        with np.load(WEIGHTS) as f:
            p = {k: f[k].copy() for k in f.files}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    step, began = 0, time.time()
    hx, hy, hn = windows(held, random.Random(1))
    by_length = np.argsort(hn, kind="stable")
    hx, hy, hn = hx[by_length], hy[by_length], hn[by_length]
    for epoch in range(epochs):
        samples = [renamed(t, s, r) if r.random() < 0.4 else (t, s) for t, s in r.sample(labelled, len(labelled) // 2)]
        samples += [renamed(t, s, r) if r.random() < 0.4 else (t, s) for t, s in r.sample(field_samples, 2500)]
        samples += [invented(r) for _ in range(1500)]
        x, y, n = windows(samples, r)
        order = np.random.default_rng(epoch).permutation(len(x))
        total = 0.0
        batches = len(order) // BATCH
        for b in range(batches):
            step += 1
            pick = order[b * BATCH : (b + 1) * BATCH]
            loss, g = M.loss_and_grads(p, np.ascontiguousarray(x[pick].T), np.ascontiguousarray(y[pick].T), n[pick])
            total += loss
            norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
            clip = min(1.0, 1.0 / (norm + 1e-9))
            rate = RATE * min(1, step / 60) * (0.5 * (1 + np.cos(np.pi * min(1, step / (epochs * batches)))) + 0.02)
            for k in p:
                q = g[k] * clip
                m[k] = 0.9 * m[k] + 0.1 * q
                v2[k] = 0.999 * v2[k] + 0.001 * q * q
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        tags = M.viterbi(p, M.emissions(p, np.ascontiguousarray(hx.T)), hn).T
        right = int(((tags == hy) & (hy > 0)).sum())
        print(f"epoch {epoch}: loss {total / batches:.4f}, held-out precision {right / max(1, (tags > 0).sum()):.4f} recall {right / max(1, (hy > 0).sum()):.4f}, {time.time() - began:.0f} s", flush=True)
        np.savez_compressed(WEIGHTS, **{k: q.astype(np.float32) for k, q in p.items()})


if __name__ == "__main__":
    train(sys.argv[1], more=sys.argv[2:] == ["more"])
