"""Personal values inside free text: a character-level BiLSTM with CRF transitions proposes spans, shapes confirm them.

A text is folded (look-alike, full-width and accented letters to plain ones, invisible characters dropped, places kept) and
cut into overlapping windows. All windows of a batch run through the network together; where windows overlap their scores
are averaged, each weighted by the distance to its window's edge, and Viterbi over the averaged scores reconciles them; long
stretches that can't be anything but outside cut the text into parts that are decoded on their own (`lead`).
A proposed span then snaps to the value's shape (an e-mail address, a number of digits, words) or is dropped.

Defined results: null, '' and blank texts hold nothing; texts of any length are read whole; positions count characters of
the stored text; repeated rows give repeated results; `redact` keeps everything outside of the values as it is.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm import pii_model as M
from vellumflow.llm.chars import folded

WEIGHTS = Path(__file__).with_name("pii_bilstm_crf.npz")
WINDOW, OVERLAP, AT_ONCE = 256, 48, 512
PADDED = (64, 96, 128, 160, 192, 224, WINDOW)
CERTAIN = 8
Span = tuple[int, int, str]

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@| @ | ?\[at\] ?| ?\(at\) ?)[A-Za-z0-9-]+(?:(?:\.| ?\((?:dot)\) ?| ?\[dot\] ?)[A-Za-z0-9-]+)*(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z]{2,}", re.I)
_PHONE = re.compile(r"(?<![\w@./-])(?:\+ ?|\()?\d(?:[\d().]| (?! )|[/-](?=\d))*\d(?![\w@]|[./-]\d)")
_NOT_PHONE = re.compile(r"(?:19|20)\d\d ?(?:-|to) ?(?:19|20)\d\d|\d{1,3}(?:,\d{3})+|\d{3,4}-\d{1,2}-\d{2,4}|\d+\.\d+\.\d{1,2}(?:\.\d+)*")
_TITLES = re.compile(r"(?:(?:Dr|Prof|Mx|Mr|Mrs|Ms|Miss|Sir|Herr|Frau|Mme|M|Sr|Sra|Ing|PhD)\.? |(?:Candidate|Name|Applicant|Contact|By|Curriculum Vitae)(?::| -)? )+", re.I)
_WHITE = re.compile(r"\s")
_NAME_WORD = re.compile(r"[A-Za-z][A-Za-z'’.-]*")
_STREET = "Street|St|Road|Rd|Lane|Ln|Blvd|Boulevard|Court|Ct|Row|Avenue|Ave|Drive|Dr|Close|Square|Sq|Way|Terrace|Hill|Crescent|Place|Gardens|Mews"
_ADDRESS = re.compile(
    r"(?<!\w)(?:(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) ?\d+[a-z]?(?:[,/] ?| ))?(?:\d{1,4}[a-z]? (?:[A-Z][\w']+ ){1,3}(?:" + _STREET + r")\b"
    r"|\d{1,4}[a-z]?,? (?:bis |ter )?(?:rue|allee|avenue|chemin|place|quai|boulevard|impasse|route) (?:(?:des|du|de la|de l'|de|d') ?)?\w[\w'-]+)"
    r"|(?:Calle|Avenida|Plaza|Paseo|Camino) (?:del |de la |de los |de )?\w+(?: \w+)?,? \d+|(?:Am|An der|Im|In der|Zum|Zur) (?:[A-Z]\w+ )+\d+[a-z]?"
    r"|[A-Z]\w*(?:stieg|stra[sß]s?e|str\.|weg|platz|allee|gasse|ring|damm|ufer) \d+[a-z]?\b|P\. ?O\. ?Box \d+|PO Box \d+|Postfach \d+|Apartado \d+)"
)
_FROM_STREET = re.compile(r"(?:Address|Home|Lives at|Home address|Adresse|Anschrift|Direccion)\s*:?\s+", re.I)


@lru_cache(maxsize=1)
def weights() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as f:
        return {k: f[k] for k in f.files}


def _scored(p: dict[str, np.ndarray], texts: list[np.ndarray]) -> list[np.ndarray]:
    """Scores (length, tags) of each text from its overlapping windows. texts: character ids with their border marks."""
    step = WINDOW - OVERLAP
    jobs = [(t, a) for t, ids in enumerate(texts) for a in range(0, max(1, len(ids) - OVERLAP), step)]
    jobs.sort(key=lambda j: min(WINDOW, len(texts[j[0]]) - j[1]))
    total = [np.zeros((len(ids), M.N_TAGS), dtype=np.float32) for ids in texts]
    mass = [np.zeros(len(ids), dtype=np.float32) for ids in texts]
    ramp = np.minimum(np.arange(WINDOW) + 1, np.arange(WINDOW)[::-1] + 1).astype(np.float32)
    every = [min(WINDOW, len(texts[t]) - a) for t, a in jobs]
    at = 0
    while at < len(jobs):
        # windows are padded to fixed lengths: what a text gives doesn't depend on the texts beside it
        longest = PADDED[bisect_left(PADDED, every[at])]
        end = min(at + AT_ONCE, bisect_right(every, longest))
        part, sizes = jobs[at:end], every[at:end]
        at = end
        ids = np.zeros((longest, len(part)), dtype=np.uint8)
        for k, (t, a) in enumerate(part):
            ids[: sizes[k], k] = texts[t][a : a + sizes[k]]
        em = M.emissions(p, ids)
        for k, (t, a) in enumerate(part):
            n = sizes[k]
            w = ramp[:n].copy()
            if a == 0:
                w[: WINDOW // 2] = ramp[WINDOW // 2]
            if a + n == len(texts[t]):
                w[max(0, n - WINDOW // 2) :] = ramp[WINDOW // 2]
            total[t][a : a + n] += em[:n, k] * w[:, None]
            mass[t][a : a + n] += w
    return [x / m[:, None] for x, m in zip(total, mass)]


def lead(p: dict[str, np.ndarray]) -> float:
    """By how much the outside score must lead at each character for no transition to make up for it: two enter and leave a tag, each may differ by the spread."""
    known = p["trans"][M.ALLOWED]
    return 4.0 + 4.0 * float(known.max() - known.min())


def _decoded(p: dict[str, np.ndarray], scores: list[np.ndarray]) -> list[np.ndarray]:
    """Tags of each text: stretches of more than CERTAIN characters whose outside score leads by `lead` are outside, each of what lies between is decoded whole."""
    least = lead(p)
    tags = [np.zeros(len(s), dtype=np.uint8) for s in scores]
    parts = []
    for t, s in enumerate(scores):
        live = (s[:, 1:].max(1) + least) > s[:, 0]
        at = np.nonzero(live)[0]
        if not len(at):
            continue
        cut = np.nonzero(np.diff(at) > CERTAIN)[0]
        for a, b in zip(np.concatenate([[at[0]], at[cut + 1]]), np.concatenate([at[cut], [at[-1]]])):
            parts.append((t, max(0, int(a) - CERTAIN // 2), min(len(s), int(b) + 1 + CERTAIN // 2)))
    parts.sort(key=lambda x: x[2] - x[1])
    for at in range(0, len(parts), 1024):
        some = parts[at : at + 1024]
        lengths = np.array([b - a for _, a, b in some])
        em = np.zeros((int(lengths.max()), len(some), M.N_TAGS), dtype=np.float32)
        for k, (t, a, b) in enumerate(some):
            em[: b - a, k] = scores[t][a:b]
        best = M.viterbi(p, em, lengths)
        for k, (t, a, b) in enumerate(some):
            tags[t][a:b] = best[: b - a, k]
    return tags


def _spans(tags: np.ndarray) -> list[Span]:
    out: list[Span] = []
    at = np.nonzero(tags)[0]
    i = 0
    while i < len(at):
        start = int(at[i])
        kind = M.KINDS[(int(tags[start]) - 1) // 2]
        end = start + 1
        i += 1
        while i < len(at) and at[i] == end and tags[end] == 2 * M.KINDS.index(kind) + 2:
            end += 1
            i += 1
        out.append((start, end, kind))
    return out


def _covering(pattern: re.Pattern, text: str, a: int, b: int, around: int) -> re.Match | None:
    """The match that covers a part of the span, sought from and to the white space beyond `around` characters on both sides."""
    lo, hi = max(0, a - around), min(len(text), b + around)
    while lo > 0 and not text[lo - 1].isspace():
        lo -= 1
    m = _WHITE.search(text, hi)
    hi = m.start() if m else len(text)
    for m in pattern.finditer(text, lo, hi):
        if m.start() < b and m.end() > a:
            return m
    return None


def _snapped(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The value that a proposed span means, by its shape; None if the span has not the shape of its kind."""
    if kind == "email":
        m = _covering(_EMAIL, text, a, b, 70)
        return m.span() if m and not m[0].endswith(tuple("0123456789")) else None
    if kind == "phone":
        m = _covering(_PHONE, text, a, b, 24)
        if not m or not 7 <= sum(map(str.isdigit, m[0])) <= 15 or _NOT_PHONE.fullmatch(m[0].strip()):
            return None
        return m.span()
    if kind == "address":
        m = _covering(_ADDRESS, text, a, b, 24)
        if m:
            return m.span()
    while a < b and not (text[a].isalnum() or text[a] in "("):
        a += 1
    while a > 0 and (text[a - 1].isalnum() or (text[a - 1] in "'’-" and a > 1 and text[a - 2].isalnum())) and text[a].isalnum():
        a -= 1
    while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
        b += 1
    while b > a and not text[b - 1].isalnum() and text[b - 1] != ".":
        b -= 1
    value = text[a:b]
    if kind == "id_number":
        return (a, b) if sum(map(str.isdigit, value)) >= 5 and "@" not in value else None
    if kind == "address":
        m = _FROM_STREET.match(text, a, b)
        if m:
            a = m.end()
        return (a, b) if b - a >= 5 and any(map(str.isdigit, text[a:b])) else None
    m = _TITLES.match(text, a, b)
    if m:
        a = m.end()
    value = text[a:b].rstrip(".,")
    words = _NAME_WORD.findall(value)
    if len(words) < 2 or any(map(str.isdigit, value)) or "@" in value or "\n" in value:
        return None
    return (a, a + len(value)) if words[0][0].isupper() or words[-1][0].isupper() else None


def find_in(texts: list[str | None]) -> list[list[Span]]:
    """Spans (start, end, kind) in the stored characters of each text, in order and without overlaps."""
    p = weights()
    kept = [(i, *folded(t)) for i, t in enumerate(texts) if t and not t.isspace()]
    out: list[list[Span]] = [[] for _ in texts]
    if not kept:
        return out
    ids = [np.concatenate([[M.BOS], M.char_ids(f), [M.EOS]]).astype(np.uint8) for _, f, _ in kept]
    for (i, text, places), tags in zip(kept, _decoded(p, _scored(p, ids))):
        taken = 0
        for a, b, kind in _spans(tags[1:-1]):
            s = _snapped(text, a, min(b, len(text)), kind)
            if s and s[1] > s[0] and s[0] >= taken:
                taken = s[1]
                out[i].append((int(places[s[0]]), int(places[s[1] - 1]) + 1, kind))
    return out


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with a typed placeholder for each value."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans:
        out.append(text[at:a])
        out.append(f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]


def find_values(df: DataFrame, key: str, column: str, at_once: int = 1024) -> DataFrame:
    """key, kind, char_pos, char_end: one row for each personal value of a column; one narrow pass."""
    picked = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{column}`").cast("string").alias("t")).where(F.length(F.trim("t")) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, at_once):
                part = b.slice(at, at_once)
                found = find_in(part.column(1).to_pylist())
                rows = [(i, s) for i, spans in enumerate(found) for s in spans]
                cols = [part.column(0).take(pa.array([i for i, _ in rows], pa.int32())), pa.array([s[2] for _, s in rows], pa.string()), pa.array([s[0] for _, s in rows], pa.int64()), pa.array([s[1] for _, s in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["k", "kind", "char_pos", "char_end"])

    out = picked.mapInArrow(run, f"k {picked.schema['k'].dataType.simpleString()}, kind string, char_pos bigint, char_end bigint")
    return out.withColumnRenamed("k", key)


def redact_texts(df: DataFrame, key: str, column: str, at_once: int = 256) -> DataFrame:
    """key, text: each text with typed placeholders for its personal values."""
    picked = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{column}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, at_once):
                part = b.slice(at, at_once)
                texts = part.column(1).to_pylist()
                done = [redact(t, s) for t, s in zip(texts, find_in(texts))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(done, pa.string())], names=["k", "text"])

    return picked.mapInArrow(run, f"k {picked.schema['k'].dataType.simpleString()}, text string").withColumnRenamed("k", key)
