"""Character facts shared by the text operators: ignorable characters, look-alike letters, scripts.

Everything here is a pure function of code points, so it behaves the same on any row and any size of data.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

# Format and control characters that show nothing (Unicode default-ignorable and bidi controls).
IGNORABLE = frozenset(
    [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F]
    + list(range(0x202A, 0x202F))
    + list(range(0x2060, 0x2065))
    + list(range(0x2066, 0x2070))
    + [0x3164, 0xFEFF, 0xFFA0]
)

# Letters of other scripts that look like a Latin letter.
CYRILLIC_TO_LATIN = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I", "а": "a", "е": "e",
    "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d", "һ": "h", "ԛ": "q",
    "ԝ": "w", "ӏ": "l", "ѵ": "v", "ү": "y", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "г": "r", "п": "n",
    "и": "u", "Ё": "Ë", "ё": "ë", "Ї": "Ï", "ї": "ï",
}
GREEK_TO_LATIN = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "η": "n",
    "τ": "t", "χ": "x", "γ": "y", "ω": "w", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "ε": "e", "ά": "á", "ό": "ó", "ί": "í",
}
ARMENIAN_TO_LATIN = {"օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "Տ": "S", "Օ": "O", "յ": "j", "զ": "q", "ա": "w"}
LIKE_TO_LATIN = {**CYRILLIC_TO_LATIN, **GREEK_TO_LATIN, **ARMENIAN_TO_LATIN}

# Letter blocks by script; CJK scripts that are written together count as one.
_BLOCKS = [
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x1E00, 0x1EFF, "latin"), (0x2C60, 0x2C7F, "latin"),
    (0xA720, 0xA7FF, "latin"), (0xFB00, 0xFB06, "latin"), (0xFF21, 0xFF5A, "latin"), (0x0370, 0x03FF, "greek"),
    (0x1F00, 0x1FFF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x1C80, 0x1C8F, "cyrillic"), (0x2DE0, 0x2DFF, "cyrillic"),
    (0xA640, 0xA69F, "cyrillic"), (0x0531, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"),
    (0x0750, 0x077F, "arabic"), (0x08A0, 0x08FF, "arabic"), (0xFB50, 0xFDFF, "arabic"), (0xFE70, 0xFEFE, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "cjk"),
    (0x3005, 0x3007, "cjk"), (0x3040, 0x30FF, "cjk"), (0x3100, 0x31BF, "cjk"), (0x3400, 0x9FFF, "cjk"),
    (0xAC00, 0xD7AF, "cjk"), (0xF900, 0xFAFF, "cjk"), (0xFF66, 0xFFDC, "cjk"), (0x20000, 0x3FFFF, "cjk"),
    (0x13A0, 0x13FF, "cherokee"),
]


@lru_cache(maxsize=65536)
def script(ch: str) -> str:
    """Script of a letter; '' for anything that is not a letter, 'other' for a letter outside the listed blocks."""
    if unicodedata.category(ch)[0] != "L" or ch in "ªº":
        return ""
    o = ord(ch)
    for lo, hi, name in _BLOCKS:
        if lo <= o <= hi:
            return name
    return "common" if o in (0x00B5, 0x2126, 0x212A, 0x212B) else "other"


def _fold(o: int) -> int:
    """One code point to one plain code point: compatibility form, then look-alike, then the letter without its accent."""
    ch = chr(o)
    c = unicodedata.normalize("NFKC", ch)
    ch = c if len(c) == 1 else ch
    ch = LIKE_TO_LATIN.get(ch, ch)
    d = unicodedata.normalize("NFD", ch)
    if len(d) > 1 and unicodedata.combining(d[1]):
        ch = d[0]
    if unicodedata.category(ch) == "Zs":
        ch = " "
    return ord(ch)


@lru_cache(maxsize=1)
def fold_table() -> tuple[np.ndarray, np.ndarray]:
    """(folded code point, is it deleted) for the basic plane; higher code points fold to themselves."""
    fold = np.arange(0x10000, dtype=np.uint32)
    gone = np.zeros(0x10000, dtype=bool)
    for o in range(0x80, 0x10000):
        if 0xD800 <= o < 0xE000:
            continue
        fold[o] = _fold(o)
    for o in IGNORABLE:
        gone[o] = True
    gone[0x0300:0x0370] = True  # combining accents
    return fold, gone


def folded(text: str) -> tuple[str, np.ndarray]:
    """Plain text without ignorable characters and accents, and the position in `text` of each of its characters."""
    if text.isascii():
        return text, np.arange(len(text))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    fold, gone = fold_table()
    low = codes < 0x10000
    safe = np.where(low, codes, 0)
    keep = ~(low & gone[safe])
    out = np.where(low, fold[safe], codes)[keep]
    return out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), np.nonzero(keep)[0]
