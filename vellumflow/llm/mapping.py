"""Free-entered values to the entries of a reference list: a trie of all names and aliases searched with a Levenshtein automaton.

Names and values are compared without case, accents, look-alike letters, ignorable characters, spaces, hyphens and
underscores. The automaton is bit-parallel: one bit mask of reachable positions for each number of edits (insertion,
deletion, substitution, swap of neighbours), stepped along the trie; a branch ends when all masks are empty. The greatest
distance depends on the length, and the search yields every entry within it; the nearest is the one meant. Further alias
paths: words abbreviated with a point, words in another order (one of them with an edit), and a form inside the value, whose
other words are then a level, a version or a remark, whatever they are.

Defined results: null, '' and blank values are no values; a value no entry is meant by gives entry 0; among entries at the
same distance names come before aliases, then the longer form, then the smaller id; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.chars import folded
from vellumflow.operators.packed import Tokenizer

_BRACKETS = re.compile(r"\s*[(\[][^()\[\]]*[)\]]?\s*")
_JOINERS = re.compile(r"[\s_-]+")
SURE = 6  # letters of a run that may hold an edit beside a remark


def allowed(length: int) -> int:
    """Greatest number of edits for a form of this length."""
    return 0 if length < 4 else 1 if length < 7 else 2


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def plain(text: str) -> str:
    return _JOINERS.sub(" ", folded(text)[0].replace("\x00", " ")).strip().lower()


def squash(text: str) -> str:
    return text.replace(" ", "")


class Matcher:
    """Entries: (id, name, aliases). Immutable once built; its size is that of the reference list."""

    def __init__(self, entries: list[tuple[int, str, list[str]]]):
        self.exact: dict[str, tuple[int, int, int]] = {}  # form -> (0 name / 1 alias, -length, id)
        self.trie: dict = {}
        self.spaced: dict = {}
        self.forms: list[tuple[tuple[str, ...], tuple[int, int, int]]] = []
        self.of_word: dict[str, list[int]] = {}  # word -> places in forms
        self.longest, self.most_words = 0, 1
        for i, name, aliases in sorted(entries, key=lambda e: e[0]):
            for rank, form in [(0, name), *((1, a) for a in aliases or ())]:
                p = plain(form)
                s = squash(p)
                if not s:
                    continue
                entry = (rank, -len(s), i)
                if entry < self.exact.get(s, (9,)):
                    self.exact[s] = entry
                self.longest = max(self.longest, len(s))
                form_words = tuple(p.split(" "))
                self.most_words = max(self.most_words, len(form_words), s.count("-") + 1)
                if len(form_words) > 1:
                    for w in set(form_words):
                        self.of_word.setdefault(w, []).append(len(self.forms))
                    self.forms.append((form_words, entry))
                for form_words in {p, plain(form.replace("-", ""))}:
                    node = self.spaced
                    for c in form_words + " ":
                        node = node.setdefault(c, {})
                    if entry < node.get("", (9,)):
                        node[""] = entry
        for s, entry in self.exact.items():
            node = self.trie
            for c in s:
                node = node.setdefault(c, {})
            node[""] = (entry, len(s))
        self._known: dict[str, int] = {}

    def within(self, s: str, most: int) -> dict[tuple[int, int, int], int]:
        """Every entry with a form within `most` edits of s and within what the form's length allows, with the least distance."""
        n = len(s)
        found: dict[tuple[int, int, int], int] = {}
        if n == 0 or n > self.longest + most:
            return found
        masks: dict[str, int] = {}
        for i, c in enumerate(s):
            masks[c] = masks.get(c, 0) | (2 << i)
        full = (2 << n) - 1
        goal = 1 << n
        # bit i of level j: the first i letters of s match the path so far with j edits
        start = []
        level = 1
        for _ in range(most + 1):
            start.append(level)
            level |= (level << 1) & full
        levels = range(1, most + 1)
        stack = [(self.trie, tuple(start), (0,) * (most + 1), 0)]
        while stack:
            node, now, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    entry, size = child
                    for j in range(min(most, allowed(size)) + 1):
                        if now[j] & goal:
                            found[entry] = min(j, found.get(entry, j))
                            break
                    continue
                m = masks.get(c, 0)
                r = (now[0] << 1) & m
                new = [r]
                alive = r
                for j in levels:
                    r = ((now[j] << 1) & m) | now[j - 1] | (now[j - 1] << 1) | (r << 1)
                    if last and before[j - 1]:
                        # s holds c and then the path's previous letter, the path the other way round
                        r |= (((before[j - 1] << 1) & m) << 1) & last
                    r &= full
                    new.append(r)
                    alive |= r
                if alive:
                    stack.append((child, tuple(new), now, m))
        return found

    def nearest(self, s: str, most: int) -> tuple[int, tuple[int, int, int]] | None:
        """(distance, entry) of the nearest of the entries within `most` edits."""
        found = self.within(s, most)
        return min((d, e) for e, d in found.items()) if found else None

    def reordered(self, words: Sequence[str]) -> tuple[int, tuple[int, int, int]] | None:
        """(distance, entry) of the nearest form that has the value's words in another order, at most one of them with one edit."""
        counts = Counter(words)
        shared = Counter(f for w in counts for f in self.of_word.get(w, ()))
        best = None
        for f, n in shared.items():
            form, entry = self.forms[f]
            if len(form) != len(words) or n < len(counts) - 1:
                continue
            ours, theirs = list((counts - Counter(form)).elements()), list((Counter(form) - counts).elements())
            d = 0 if not ours else 1 if len(ours) == 1 and allowed(sum(map(len, form))) and one_edit(ours[0], theirs[0]) else None
            if d is not None and (best is None or (d, entry) < best):
                best = (d, entry)
        return best

    def abbreviated(self, p: str) -> tuple[int, int, int] | None:
        """The first form each word of which is, in order, the value's word or begins with its abbreviation."""
        words = p.split(" ")
        if not any(len(w) > 2 and w[-1] == "." for w in words):
            return None
        nodes = [self.spaced]
        for w in words:
            short = len(w) > 2 and w[-1] == "."
            after = []
            for node in nodes:
                for c in w[:-1] if short else w:
                    node = node.get(c)
                    if node is None:
                        break
                else:
                    todo = [node]
                    while todo:
                        x = todo.pop()
                        if " " in x:
                            after.append(x[" "])
                        if short:
                            todo.extend(y for c, y in x.items() if c not in (" ", ""))
            nodes = after
        found = [n[""] for n in nodes if "" in n]
        return min(found) if found else None

    def _find(self, value: str) -> int:
        whole = plain(value)
        whole = whole.strip("!?.,;:*'\" ") if not value.strip().startswith(".") else whole.rstrip("!?,;:*'\" ")
        bare = _BRACKETS.sub(" ", whole).strip().rstrip("!?,;:")
        variants = [v for v in dict.fromkeys((whole, bare)) if v]
        for v in variants:
            e = self.exact.get(squash(v)) or self.abbreviated(v)
            if e:
                return e[2]
        found = []
        for v in variants:
            w = [x for x in v.split(" ") if x]
            if len(w) > 1:
                hit = self.reordered(w)
                if hit:
                    found.append((hit[0] + (0.5 if hit[0] else 0.0), hit[1]))
            hit = self.nearest(squash(v), allowed(len(squash(v)) + 1))
            if hit:
                found.append(hit)
        if found:
            return min(found)[1][2]
        return self._inside([w.strip("!?,;:") for w in bare.split(" ")])

    def _inside(self, words: list[str]) -> int:
        """The entry that a run of the words names: what is left over on both sides is a level, a version or a remark.

        The longest run that is a form holds, then the longest abbreviated or reordered one, then the longest of at least
        `SURE` letters that is within the distance of one.
        """
        words = [w for w in words if w]
        runs = list(dict.fromkeys(tuple(words[i : i + n]) for n in range(min(len(words) - 1, self.most_words), 0, -1) for i in range(len(words) - n + 1)))
        runs.sort(key=lambda r: -sum(map(len, r)))
        for r in runs:
            e = self.exact.get("".join(r))
            if e:
                return e[2]
        for r in runs:
            e = self.abbreviated(" ".join(r))
            hit = (0, e) if e else self.reordered(r) if len(r) > 1 else None
            if hit:
                return hit[1][2]
        for r in runs:
            s = "".join(r)
            hit = self.nearest(s, allowed(len(s))) if len(s) >= SURE else None
            if hit:
                return hit[1][2]
        return 0

    def near(self, value: str) -> dict[int, int]:
        """Every entry within the distance that the value's length allows, by its name or an alias, with that distance."""
        s = squash(plain(value))
        out: dict[int, int] = {}
        for (_, _, i), d in self.within(s, allowed(len(s) + 1)).items():
            out[i] = min(d, out.get(i, d))
        return out

    def find(self, value: str) -> int:
        known = self._known.get(value)
        if known is None:
            known = self._find(value)
            if len(value) > 40 * (self.longest + 8):  # searched as any other, but too long to be kept
                return known
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[value] = known
        return known


def entries_of(ontology: DataFrame, most: int = 200_000) -> list[tuple[int, str, list[str]]]:
    """The reference list on the driver; refused beyond `most` entries, for every task builds the trie."""
    rows = ontology.select("skill_id", "skill", "aliases").where("skill is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries")
    return [(r.skill_id, r.skill, list(r.aliases or ())) for r in rows]


def map_values(df: DataFrame, column: str, entries: list[tuple[int, str, list[str]]], protected: list[str], to: str = "skill_id", count: str = "n_values") -> DataFrame:
    """df with `to`: the entry meant by each value, 0 if none is, and `count`: how many values the field packs.

    A field of one value is searched without its quotes, brackets and label, a field of several as it is. Null and blank
    values get null. Narrow; the distinct values of a batch are searched once and kept for the task's next batches.
    """
    picked = df.withColumn("__meant", F.col(f"`{column}`").cast("string"))
    at = len(picked.schema) - 1
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]) + f", `{to}` bigint, `{count}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, tok = Matcher(entries), Tokenizer(protected)
        for b in batches:
            coded = b.column(at).dictionary_encode()
            meant, packed = [], []
            for v in coded.dictionary.to_pylist():
                if not v or not v.strip():
                    meant.append(None)
                    packed.append(0)
                    continue
                terms = tok.values(v)
                meant.append(matcher.find(terms[0] if len(terms) == 1 else v))
                packed.append(len(terms))
            new = [pa.array(meant, pa.int64()).take(coded.indices), pa.array(packed, pa.int32()).take(coded.indices)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), *new], names=[*b.schema.names[:at], to, count])

    return picked.mapInArrow(run, text)


def near_entries(df: DataFrame, column: str, entries: list[tuple[int, str, list[str]]]) -> DataFrame:
    """value, skill_id, distance: every entry within the length-dependent distance of each distinct value of a column."""
    values = df.select(F.col(f"`{column}`").cast("string").alias("value")).where(F.length(F.trim("value")) > 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries)
        for b in batches:
            rows = [(v, i, d) for v in b.column(0).to_pylist() for i, d in matcher.near(v).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32()))], names=["value", "skill_id", "distance"])

    return values.mapInArrow(run, "value string, skill_id bigint, distance int")
