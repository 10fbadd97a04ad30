"""Several values packed in one field: a quote-aware finite-state tokenizer that emits one row a value with its position.

Defined results: null and blank fields give no values; empty pieces are dropped and don't count as positions; repeated
values stay; unbalanced quotes and brackets are ordinary characters; one value alone is a field of one value; very long
fields are read once from left to right. `protected` names keep the separators they hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Signs that separate anywhere, and signs and words that separate only between spaces.
SIGNS = ",;|/•·，、；｜／\t\n\r"
SPACED = ("&", "+", "-", "–", "—", "and")
_SPACED = re.compile(r"\s+(?:[&+–—-]|and)\s+|(?<=[,;])\s*and\s+", re.I)
_GAP = re.compile(r" {3,}")
_LABEL = re.compile(r"\s*[^\W\d_][\w]*(?: (?:& )?[\w]+){0,3}:\s*")
_START, _PLAIN, _QUOTED = range(3)


class Tokenizer:
    """Splits packed fields. `protected`: names within which nothing separates (case ignored)."""

    def __init__(self, protected: Iterable[str] = ()):
        names = {p.strip().casefold() for p in protected if p and self._separates(p)}
        self._first = {n[0] for n in names}
        self._names = re.compile("|".join(sorted(map(re.escape, names), key=len, reverse=True)), re.I) if names else None
        self._seen: dict[str, list[str]] = {}

    @staticmethod
    def _separates(name: str) -> bool:
        return any(c in SIGNS for c in name) or bool(_SPACED.search(f" {name} ")) or "  " in name

    def values(self, text: str | None) -> list[str]:
        if not text:
            return []
        known = self._seen.get(text)
        if known is None:
            known = self._split(text)
            if len(self._seen) > 50_000:
                self._seen.clear()
            if len(text) < 1000:
                self._seen[text] = known
        return known

    def _unwrap(self, text: str) -> str:
        for _ in range(2):
            m = _LABEL.match(text)
            if m and not self._name_at(text, m.start() + len(text) - len(text.lstrip())):
                text = text[m.end() :]
            t = text.strip()
            if len(t) > 1 and t[0] == "[" and t[-1] == "]":
                text = t[1:-1]
        return text

    def _name_at(self, text: str, i: int) -> re.Match | None:
        if not self._names or text[i].casefold() not in self._first or (i and (text[i - 1].isalnum())):
            return None
        m = self._names.match(text, i)
        return m if m and not text[m.end() : m.end() + 1].isalnum() else None

    @staticmethod
    def _closing_quote(text: str, i: int) -> int:
        """Index of the quote that closes the one at i, -1 if none does; doubled and escaped quotes don't."""
        j, n = i + 1, len(text)
        while j < n:
            if text[j] == "\\" and j + 1 < n:
                j += 2
            elif text[j] == '"':
                if j + 1 < n and text[j + 1] == '"':
                    j += 2
                else:
                    return j
            else:
                j += 1
        return -1

    def _split(self, text: str) -> list[str]:
        """One automaton: in quotes or not, and the brackets that are open; separators count outside of both.

        A quote or bracket that nothing closes is an ordinary character. Only the end of the text shows it: then the pass
        goes back behind the quote, or behind the first of the brackets still open, all of which are ordinary from then on.
        """
        text = self._unwrap(text)
        plain: set[int] = set()  # brackets that nothing closes
        cuts: list[tuple[int, int]] = []
        opened: list[int] = []  # places of the open brackets
        i, n, state, quote, unclosed, cuts_before = 0, len(text), _START, 0, False, 0
        while True:
            if i >= n:
                if state == _QUOTED:
                    i, state, unclosed = quote + 1, _PLAIN, True  # no later quote can close either
                    continue
                if opened:
                    plain.update(opened)
                    i, state = opened[0] + 1, _PLAIN
                    opened, unclosed = [], False
                    del cuts[cuts_before:]
                    continue
                break
            c = text[i]
            if state == _QUOTED:
                if c == "\\" or (c == '"' and text[i + 1 : i + 2] == '"'):
                    i += 2
                    continue
                state = _PLAIN if c == '"' else _QUOTED
                i += 1
                continue
            if c == '"' and not unclosed:
                quote, state = i, _QUOTED
                i += 1
                continue
            if c == "(" and i not in plain:
                if not opened:
                    cuts_before = len(cuts)
                opened.append(i)
                i, state = i + 1, _PLAIN
                continue
            if opened:
                if c == ")":
                    opened.pop()
                i += 1
                continue
            m = self._name_at(text, i)
            if m and m.end() > i:
                i, state = m.end(), _PLAIN
                continue
            if c in SIGNS:
                cuts.append((i, i + 1))
                i, state = i + 1, _START
                continue
            if c.isspace():
                m = _SPACED.match(text, i)
                if m:
                    cuts.append((i, m.end() - 1))  # the last space may begin the next separator
                    i, state = m.end() - 1, _START
                    continue
                m = _GAP.match(text, i)
                if m:
                    cuts.append(m.span())
                    i, state = m.end(), _START
                    continue
            elif state == _START and c in "aA" and text[i : i + 3].casefold() == "and" and cuts and text[i + 3 : i + 4].isspace():
                cuts.append((i, i + 4))
                i += 4
                continue
            state = _START if state == _START and c.isspace() else _PLAIN
            i += 1
        out, at = [], 0
        for a, b in [*cuts, (n, n)]:
            piece = text[at:a].strip()
            at = b
            if len(piece) > 1 and piece[0] == '"' and self._closing_quote(piece, 0) == len(piece) - 1:
                piece = piece[1:-1].replace('""', '"').replace('\\"', '"').strip()
            elif piece in SPACED:
                continue  # a separator with nothing on its other side
            if piece:
                out.append(piece)
        return out


def split_packed(df: DataFrame, keys: list[str], column: str, protected: Iterable[str] = (), least: int = 1) -> DataFrame:
    """keys, pos, term: one row a value of `column`, for fields of at least `least` values.

    Narrow: no shuffle, one pass over the keys and the field. `protected` travels with the tasks, so it must be a bounded
    list (a vocabulary). Extra columns, whatever their names, aren't read.
    """
    names = list(protected)
    picked = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{column}`").cast("string").alias("value"))
    picked = picked.where(F.length(F.trim("value")) > 0)
    schema = ", ".join(f"k{i} {picked.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys))) + ", pos bigint, term string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(names)
        for b in batches:
            lists = [tok.values(v) for v in b.column(len(keys)).to_pylist()]
            lists = [x if len(x) >= least else [] for x in lists]
            parent = pa.array([i for i, x in enumerate(lists) for _ in x], pa.int32())
            cols = [b.column(i).take(parent) for i in range(len(keys))]
            pos = pa.array([j for x in lists for j in range(len(x))], pa.int64())
            term = pa.array([t for x in lists for t in x], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pos, term], names=[*(f"k{i}" for i in range(len(keys))), "pos", "term"])

    out = picked.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "pos", "term")


def vocabulary(ontology: DataFrame, most: int = 200_000) -> list[str]:
    """Names and aliases of a reference list that hold a separator; refused beyond `most`, for they're sent to every task."""
    forms = ontology.select(F.explode(F.concat(F.array("skill"), F.coalesce("aliases", F.array()))).alias("form"))
    forms = forms.where(F.col("form").rlike(r"[,;|/•·&+\-–—]|\band\b|\s{2,}")).distinct().limit(most + 1)
    names = [r.form for r in forms.collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} protected names")
    return names
