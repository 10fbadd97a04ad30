"""Text that looks the same in one consistent form.

A text first gets its compatibility forms (full-width letters, joined letter signs), loses ignorable characters (emoji keep
their joiners), gets plain spaces and composed accents. A word that mixes scripts then becomes a lattice: each letter stands
for itself and for the letters of other scripts that look like it. Viterbi takes the path of the best bigram scores, where a
change of script inside a word costs more than anything else. The bigram table counts all texts of the column.

Defined results: null stays null, '' and blank texts are texts; a word wholly in one script is left as it is, and so is a
mixed word for which no path in one script exists; the result doesn't depend on row order; very long texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.llm.chars import ARMENIAN_TO_LATIN, CYRILLIC_TO_LATIN, GREEK_TO_LATIN, IGNORABLE, script

KINDS = ("fullwidth", "apart", "invisible", "space", "joined", "mixed")
#: Characters that are no case whatever stands around them: they stay as they are, and a line of these alone is in its consistent form.
PLAIN = r"\t\n\r -~¡-¬®-ıĴ-ǃǍ-ǰǴ-ɏḀ-ỿ‐-‧‰-⁞₠-⃏℀-℥℧-℩ℬ-⌨⌫-⫛⫝-⯿、-〿ぁ-ゖァ-ヿ一-鿿가-힣！-／：-＠［-｀｛-､"
_ODD = re.compile(f"[^{PLAIN}]")
_ODD_RUN = re.compile(f"[^{PLAIN}]+")
_MARKS = r"̀-ͯ᪰-᫿᷀-᷿⃐-⃜"
_APART = re.compile(rf"[^\W\d_][{_MARKS}]")
_FULL = re.compile(r"[０-９Ａ-Ｚａ-ｚ]")
_JOINED = re.compile(r"[ﬀ-ﬆﬓ-ﬗĲĳǄ-ǌǱ-ǳ]")
_SPACE = re.compile(r"[   -     　]")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f]")
_WORD = re.compile(r"[^\W\d_]+")
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψως", "абвгдежзийклмнопрстуфхцчшщъыьэюяіїєѕј")
_SCRIPTS = ("latin", "greek", "cyrillic")
_LETTERS = "".join(_ALPHABETS)
_OFFSET = {c: i + 1 for i, c in enumerate(_LETTERS)}
SIZE = len(_LETTERS) + 1  # 0: the border of a word


def _letter_id(ch: str) -> int:
    low = ch.lower()
    i = _OFFSET.get(low[:1], 0)
    if not i:
        d = unicodedata.normalize("NFKD", low)
        i = _OFFSET.get(d[:1], 0)
    return i


_ids_of_plane: list[np.ndarray] = []


def letter_ids(text: str) -> np.ndarray:
    if not _ids_of_plane:
        table = np.zeros(0x10000, dtype=np.uint8)
        for o in [*range(0x41, 0x530), *range(0x1E00, 0x2000), *range(0xFF21, 0xFF5B)]:
            ch = chr(o)
            if ch.isalpha():
                table[o] = _letter_id(ch)
        _ids_of_plane.append(table)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _ids_of_plane[0][np.where(codes < 0x10000, codes, 0)]


def bigram_counts(df: DataFrame, column: str) -> np.ndarray:
    """Counts of successive letters over all texts of a column: SIZE x SIZE numbers, whatever the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE * SIZE, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids = letter_ids("\n".join(t for t in b.column(0).slice(at, 256).to_pylist() if t)).astype(np.int64)
                if len(ids) > 1:
                    total += np.bincount(ids[:-1] * SIZE + ids[1:], minlength=SIZE * SIZE)
        pick = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(pick, pa.int64()), pa.array(total[pick], pa.int64())], names=["pair", "n"])

    rows = df.select(F.col(f"`{column}`").cast("string").alias("t")).where("t is not null").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE * SIZE)
    for r in rows:
        out[r.pair] = r.n
    return out.reshape(SIZE, SIZE)


def scores(counts: np.ndarray) -> np.ndarray:
    smooth = counts + 0.5
    return np.log(smooth / smooth.sum(1, keepdims=True))


def _alike() -> dict[str, list[str]]:
    groups: dict[str, set[str]] = {}
    for table in (CYRILLIC_TO_LATIN, GREEK_TO_LATIN, ARMENIAN_TO_LATIN):
        for ch, plain in table.items():
            groups.setdefault(plain, {plain}).add(ch)
    out: dict[str, list[str]] = {}
    for g in groups.values():
        for c in g:
            out[c] = sorted(g)
    return out


ALIKE = _alike()
SWITCH, CHANGED = 60.0, 1.0
_ANY = {"", "common", "cjk"}  # what stands beside letters of any script


def best_path(word: str, table: np.ndarray) -> tuple[str, bool]:
    """The path with the best bigram scores through the look-alikes of a word, and whether it is of one script; if it isn't, the word itself."""
    lattice = []
    for ch in word:
        options = [(ch, script(ch), 0.0)]
        options += [(o, script(o), CHANGED) for o in ALIKE.get(ch, ()) if o != ch]
        lattice.append(options)
    best = [(table[0, _letter_id(c)] - cost, -1) for c, _, cost in lattice[0]]
    trace = [best]
    for prev, here in zip(lattice, lattice[1:]):
        new = []
        for c, s, cost in here:
            i = _letter_id(c)
            new.append(max((best[k][0] + table[_letter_id(p), i] - cost - (SWITCH if q != s else 0.0), k) for k, (p, q, _) in enumerate(prev)))
        best = new
        trace.append(best)
    k = max(range(len(best)), key=lambda x: best[x][0])
    out, kinds = [], set()
    for options, row in zip(reversed(lattice), reversed(trace)):
        out.append(options[k][0])
        kinds.add(options[k][1])
        k = row[k][1]
    return ("".join(reversed(out)), True) if len(kinds - _ANY) < 2 else (word, False)


def _emoji(ch: str) -> bool:
    return bool(ch) and (unicodedata.category(ch) in ("So", "Sk") or 0xFE0E <= ord(ch) <= 0xFE0F or 0xE0020 <= ord(ch) <= 0xE007F)


def _shown(text: str) -> tuple[str, bool]:
    """Without characters that show nothing, except those that join emoji; and whether any was dropped."""
    out, dropped = [], False
    for i, ch in enumerate(text):
        o = ord(ch)
        if 0xFE00 <= o <= 0xFE0F or 0xE0020 <= o <= 0xE007F:
            before = text[i - 1] if i else ""
            if not (_emoji(before) or before in "#*0123456789©®‼⁉™ℹ〰〽㊗㊙" and before or unicodedata.category(before or "a")[0] == "S"):
                dropped = True
                continue
        elif o in IGNORABLE:
            if not (o == 0x200D and i and _emoji(text[i - 1]) and i + 1 < len(text) and _emoji(text[i + 1])):
                dropped = True
                continue
        elif _CONTROL.match(ch) or (unicodedata.category(ch) == "Cf" and o > 0x7F):
            dropped = True
            continue
        out.append(ch)
    return "".join(out), dropped


def _apart(m: re.Match) -> str:
    return unicodedata.normalize("NFKC", m[0])


def canonical(text: str, table: np.ndarray) -> tuple[str, int]:
    """The consistent form and the kinds of differences, bit k for KINDS[k], each by what its step changed.

    Compatibility forms are taken of the characters outside of PLAIN only, so that a sign such as a fraction or a trade mark
    is the same in every line, whatever else the line holds.
    """
    if not _ODD.search(text):
        return text, 0
    shown, dropped = _shown(text)
    found = 4 if dropped else 0
    spaced = _SPACE.sub(" ", shown)
    if spaced != shown:
        found |= 8
    if _FULL.search(spaced):
        found |= 1
    if _JOINED.search(spaced):
        found |= 16
    if _APART.search(spaced):
        found |= 2
    composed = unicodedata.normalize("NFC", spaced)
    plain = unicodedata.normalize("NFC", _ODD_RUN.sub(_apart, composed))
    out, at = [], 0
    for m in _WORD.finditer(plain):
        if m[0].isascii() or len({script(c) for c in m[0]} - _ANY) < 2:
            continue  # all letters of one script: no choice to be made
        word, whole = best_path(m[0], table)
        if word != m[0] or not whole:
            found |= 32  # the best path has other letters than the stored word, or no path is of one script
        out += [plain[at : m.start()], word]
        at = m.end()
    return ("".join(out) + plain[at:] if out else plain), found


def suspicious(text: Column) -> Column:
    """Lines that may change, decided in the JVM; all others are in their consistent form already."""
    return text.rlike(f"[^{PLAIN}]")


def canonical_texts(df: DataFrame, keys: list[str], column: str, counts: np.ndarray) -> DataFrame:
    """keys, text, found: the consistent form of each text and the kinds of differences as bits; one narrow pass."""
    picked = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{column}`").cast("string").alias("t"))
    table = scores(counts)
    schema = ", ".join(f"k{i} {picked.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys))) + ", text string, found int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [(None, 0) if t is None else canonical(t, table) for t in b.column(len(keys)).to_pylist()]
            cols = [pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int32())]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keys))], *cols], names=[*(f"k{i}" for i in range(len(keys))), "text", "found"])

    return picked.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "text", "found")
