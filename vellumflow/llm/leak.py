"""Evaluation passages inside training text: rare n-gram seeds join the two, Smith-Waterman alignment scores the pairs.

Words are runs of letters and digits, lower case, without markup. Seeds are three successive words of an item; at one edit in
five words any passage of 20 words still holds several. Items with the same words are one. The index of the items' seeds
travels with the tasks, in blocks of at most `block_seeds`: every block is one narrow pass over the documents, which never
leave their partition, so neither texts nor seeds are shuffled, however large the corpus is.

A run of RUN or more successive seeds that stand in many items is an instruction: it seeds nothing, and its words don't count
for a passage. "Many" is `rare_items` or `rare_share` of the distinct items, whichever is more. Scattered frequent seeds are
seeds like any other, and an item that is left with at most half of `least_words` words without its instructions, so that it
could never be found, is a variant of a much repeated item: it keeps all its seeds.

The seeds of a document and an item are counted by diagonal and block (each twice, half a block apart), which bounds every
alignment to a window of about BLOCK words and the memory to counts, however long the texts are. Windows of `least_seeds` or
more are aligned; if the best alignment of a window fails, its words are taken out and the rest is aligned again.

Defined results: null, '' and blank texts hold nothing; repeated rows give one result; a document that holds an item
several times gives one row; ties between alignments don't matter, since any that passes suffices; null keys are keys.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = MISMATCH = 1.5
BLOCK, DIAGONAL, MARGIN, RUN = 256, 64, 40, 6
_HIDDEN = re.compile("[­؜᠎​-‏‪-‮⁠-⁯﻿]")
_MARKUP = re.compile(r"<[^<>]{1,200}>|&[a-zA-Z]{2,8};|&#\d{1,6};")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits, without markup and characters that show nothing."""
    if not text:
        return []
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text.lower())


class Items:
    """Seed index of some test items. items: (key, words); counts: in how many distinct items each seed stands."""

    def __init__(self, items: list[tuple[object, list[str]]], counts: dict[tuple, int], many: float, least_words: int):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.shared = [], []
        self.seeds: dict[tuple, list[tuple[int, int]]] = {}
        for n, (_, ws) in enumerate(items):
            self.ids.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], dtype=np.int64))
            shared = instruction(ws, counts, many)
            covered = frozenset(x + k for x in shared for k in range(3))
            if 2 * (len(ws) - len(covered)) <= least_words:
                shared = covered = frozenset()
            self.shared.append(covered)
            ids = self.ids[-1].tolist()
            for i in range(len(ws) - 2):
                if i not in shared:
                    self.seeds.setdefault((ids[i], ids[i + 1], ids[i + 2]), []).append((n, i))

    def windows(self, text: list[int], least_seeds: int) -> dict[int, list[tuple[int, int, int, int, int]]]:
        """Of each item the windows (seeds, first and last place in the text, first and last place in the item), those with most seeds first."""
        groups: dict[tuple[int, int, int], list[int]] = {}
        get = self.seeds.get
        a, b = -1, -1
        for p, c in enumerate(text):
            if a >= 0 and b >= 0 and c >= 0:
                pos = p - 2
                for n, i in get((a, b, c), ()):
                    d, k = (pos - i) // DIAGONAL, i // BLOCK
                    for key in ((n, d, k), (n, d + 1, k), (n, d, k + 1), (n, d + 1, k + 1)):
                        g = groups.get(key)
                        if g is None:
                            groups[key] = [1, pos, pos, i, i]
                        else:
                            if g[2] != pos:  # places come in order
                                g[0] += 1
                                g[2] = pos
                            if i < g[3]:
                                g[3] = i
                            elif i > g[4]:
                                g[4] = i
            a, b = b, c
        out: dict[int, set] = {}
        for (n, _, _), g in groups.items():
            if g[0] >= least_seeds:
                out.setdefault(n, set()).add(tuple(g))
        return {n: sorted(g, reverse=True) for n, g in out.items()}


def instruction(ws: list[str], counts: dict[tuple, int], many: float) -> frozenset[int]:
    """Places of the seeds of an item that lie in a run of RUN or more seeds of many items."""
    common = [counts[tuple(ws[i : i + 3])] > many for i in range(len(ws) - 2)]
    out: list[int] = []
    at = 0
    while at < len(common):
        end = at
        while end < len(common) and common[end]:
            end += 1
        if end - at >= RUN:
            out.extend(range(at, end))
        at = max(end, at + 1)
    return frozenset(out)


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int, int, np.ndarray]:
    """Best local alignment: score, words of the text before it and that it spans, words of the item that it spans, matched item words."""
    n, m = len(item), len(text)
    h = np.zeros((n + 1, m + 1), dtype=np.float32)
    slope = (np.arange(m + 1) * GAP).astype(np.float32)
    for i in range(1, n + 1):
        row = np.empty(m + 1, dtype=np.float32)
        row[0] = 0
        np.maximum(h[i - 1, :-1] + np.where(text == item[i - 1], np.float32(1), np.float32(-MISMATCH)), 0, out=row[1:])
        np.maximum(row, h[i - 1] - GAP, out=row)
        h[i] = np.maximum.accumulate(row + slope) - slope
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, end_i, end_j, matched = float(h[i, j]), i, j, []
    while i > 0 and j > 0 and h[i, j] > 1e-3:
        s = 1.0 if item[i - 1] == text[j - 1] else -MISMATCH
        if abs(h[i, j] - max(h[i - 1, j - 1] + s, 0)) < 1e-3 and h[i - 1, j - 1] + s > -1e-3:
            if s > 0:
                matched.append(i - 1)
            i, j = i - 1, j - 1
        elif abs(h[i, j] - (h[i - 1, j] - GAP)) < 1e-3:
            i -= 1
        else:
            j -= 1
    return score, int(j), int(end_j - j), int(end_i - i), np.array(matched[::-1], dtype=np.int64)


def passage(text: np.ndarray, item: np.ndarray, shared: frozenset[int], windows: list[tuple], least_words: int, least_share: float) -> tuple[int, int] | None:
    """(words of the item that are spanned, matches) of the first alignment that passes, windows with most seeds first."""
    searched: list[tuple[int, int, int, int]] = []
    least_score = 0.75 * least_words * (1 - MISMATCH * (1 / least_share - 1))
    for _, lo, hi, ilo, ihi in windows:
        if any(s[0] <= lo and hi <= s[1] and s[2] <= ilo and ihi <= s[3] for s in searched):
            continue  # all its alignments have failed already
        start, at = max(0, lo - MARGIN), max(0, ilo - MARGIN)
        part = item[at : ihi + MARGIN + 3]
        around = text[start : hi + MARGIN + 3].copy()
        while True:
            score, before, text_span, span, matched = align(part, around)
            n = len(matched)
            if score < least_score:
                break
            if span >= least_words and n >= least_share * max(span, text_span) and n >= 0.75 * least_words and sum(int(x) + at not in shared for x in matched) * 2 > least_words:
                return span, n
            around[before : before + text_span] = -1
        searched.append((lo - MARGIN, hi + MARGIN, ilo - MARGIN, ihi + MARGIN))
    return None


def blocks_of(items: DataFrame, key: str, column: str, block_seeds: int, most_seeds: int) -> tuple[list[list[tuple[list, list[str]]]], Counter]:
    """The distinct items as blocks of (keys, words), and the number of items that hold each seed.

    Test suites are reference data: more than `most_seeds` words of them are refused, for they pass through the driver.
    """
    rows = items.select(F.col(f"`{key}`").alias("k"), F.col(f"`{column}`").cast("string").alias("t")).where("t is not null").distinct()
    length = rows.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    if length > most_seeds:
        raise ValueError(f"test items of more than {most_seeds} words")
    same: dict[tuple, list] = {}
    for r in rows.collect():
        same.setdefault(tuple(words(r.t)), []).append(r.k)
    counts: Counter = Counter()
    blocks: list[list] = [[]]
    size = 0
    for ws, keys in same.items():
        if len(ws) < 3:
            continue
        counts.update({ws[i : i + 3] for i in range(len(ws) - 2)})
        if size and size + len(ws) > block_seeds:
            blocks.append([])
            size = 0
        blocks[-1].append((keys, list(ws)))
        size += len(ws)
    return blocks, counts


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str,
    least_words: int = 20, least_share: float = 0.7, least_seeds: int = 3, rare_items: int = 20, rare_share: float = 0.05,
    block_seeds: int = 1_000_000, most_seeds: int = 50_000_000,
) -> DataFrame:
    """doc_id, item_id, item_words, matched: pairs where a passage of `least_words` words of the item stands in the document.

    `least_share` of the spanned words must match, and the words outside of instructions must hold more than half of `least_words`.
    """
    docs = documents.select(F.col(f"`{doc_key}`").alias("doc_id"), F.col(f"`{doc_text}`").cast("string").alias("body")).where("body is not null")
    spark = documents.sparkSession
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.select(F.col(f"`{item_key}`").alias("k")).schema["k"].dataType
    blocks, counts = blocks_of(items, item_key, item_text, block_seeds, most_seeds)
    many = max(rare_items, rare_share * sum(map(len, blocks)))
    schema = f"doc_id {kinds[0]}, nth int, item_words int, matched int"
    parts = []
    for block in blocks:
        own = {tuple(ws[i : i + 3]) for _, ws in block for i in range(len(ws) - 2)}
        sent = spark.sparkContext.broadcast((block, {s: counts[s] for s in own if counts[s] > 1}))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            rows, shared = sent.value
            index = Items([(n, ws) for n, (_, ws) in enumerate(rows)], _Counted(shared), many, least_words)
            known = index.vocabulary.get
            for b in batches:
                found = []
                for r, t in enumerate(b.column(1).to_pylist()):
                    text = [known(w, -1) for w in words(t)]
                    near = index.windows(text, least_seeds) if len(text) >= 3 else {}
                    if near:
                        ids = np.array(text, dtype=np.int64)
                        for n, windows in near.items():
                            p = passage(ids, index.ids[n], index.shared[n], windows, least_words, least_share)
                            if p:
                                found.append((r, n, *p))
                cols = [pa.array([f[k] for f in found], pa.int32()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(cols[0]), *cols[1:]], names=["doc_id", "nth", "item_words", "matched"])

        keys = spark.createDataFrame([(n, k) for n, (ks, _) in enumerate(block) for k in ks], _keyed(kinds[1]))
        parts.append(docs.mapInArrow(run, schema).join(F.broadcast(keys), "nth").drop("nth"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.max("matched").alias("matched"))


class _Counted(dict):
    """Counts of seeds; those that aren't listed stand in one item."""

    def __missing__(self, key: tuple) -> int:
        return 1


def _keyed(kind):
    from pyspark.sql.types import IntegerType, StructField, StructType

    return StructType([StructField("nth", IntegerType()), StructField("item_id", kind)])
