"""Encoding of a corpus with a public byte-level BPE vocabulary, without replaying merges.

Bytes map to Latin-1 characters, so one Aho-Corasick automaton over all tokens finds every token at every place of a
piece. Encoding takes the longest token at each place and backtracks to shorter prefixes while a token doesn't fit its
left neighbour. Two tokens fit when no merge of lower rank crosses their border, which is decided by undoing their merges
against each other and is remembered for each pair; a sequence of fitting tokens is the one that the merges give. Every
position is ruled out at most once, so the time is linear in the text.

Defined results: null and '' give an empty list; special-token strings are ordinary text; any Unicode text, however long,
is encoded whole; extra columns aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class BytePairEncoder:
    """`ranks`: token bytes to id, ids in the order of the merges, single bytes first."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in ranks.items():
            self.bytes[i] = b
        self.length = [len(b) for b in self.bytes]
        self.ranks = ranks
        self.left, self.right, self.merged = self._split_table()
        self.shorter = [self._shorter(b) for b in self.bytes]
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._split = regex.compile(PATTERN)

    def _split_table(self):
        """The two tokens whose merge made each token: the only split whose halves the earlier merges leave whole."""
        n = len(self.bytes)
        left, right = list(range(n)), list(range(n))
        merged: dict[int, int] = {}
        for i in sorted(self.ranks.values()):
            b = self.bytes[i]
            if len(b) < 2:
                continue
            parts = [self.ranks[b[k : k + 1]] for k in range(len(b))]
            while len(parts) > 2:
                best, at = n, -1
                for k in range(len(parts) - 1):
                    m = merged.get(parts[k] * n + parts[k + 1], n)
                    if m < best:
                        best, at = m, k
                if at < 0:
                    raise ValueError(f"token {i} cannot be made by merges")
                parts[at : at + 2] = [best]
            left[i], right[i] = parts
            merged[parts[0] * n + parts[1]] = i
        return left, right, merged

    def _shorter(self, b: bytes) -> int:
        for k in range(len(b) - 1, 0, -1):
            i = self.ranks.get(b[:k])
            if i is not None:
                return i
        return -1

    def fits(self, a: int, b: int) -> bool:
        n = len(self.bytes)
        key = a * n + b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self._decide(a, b)
        return known

    def _decide(self, a: int, b: int) -> bool:
        """Undo the later of the two tokens' merges, step by step; no merge across the border may have come before it."""
        n, merged, left, right = len(self.bytes), self.merged, self.left, self.right
        limit = n
        while True:
            m = merged.get(a * n + b)
            if m is not None and m < limit:
                return False
            if a > b:
                limit = a
                a = right[a]
                if a == limit:
                    limit = b + 1
                    b = left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = left[b]
                if b + 1 == limit:
                    limit = a
                    a = right[a]
                    if a == limit:
                        return True

    def encode_bytes(self, data: bytes) -> list[int]:
        known = self.ranks.get(data)
        n = len(data)
        if known is not None and n == 1:
            return [known]
        longest = [-1] * n
        length, size = self.length, 0
        for end, token in self.automaton.iter(data.decode("latin-1")):
            start = end - length[token] + 1
            if longest[start] < 0 or length[longest[start]] < length[token]:
                longest[start] = token
        possible = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        shorter, fits = self.shorter, self.fits
        token = longest[0]
        while True:
            end = size + length[token]
            if possible[end] and (not out or fits(out[-1], token)):
                out.append(token)
                size = end
                if size == n:
                    return out
                token = longest[size]
                continue
            down = shorter[token]
            if down >= 0:
                token = down
            else:
                possible[size] = 0
                token = out.pop()
                size -= length[token]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces, out = self._pieces, []
        for piece in self._split.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = tuple(self.encode_bytes(piece.encode("utf-8", "surrogatepass")))
                if len(piece) < 64:
                    if len(pieces) > 300_000:
                        pieces.clear()
                    pieces[piece] = ids
            out.extend(ids)
        return out


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> BytePairEncoder:
    with open(path, "rb") as f:
        return BytePairEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode_texts(df: DataFrame, key: str, column: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, ids ARRAY<INT>: one row a row, in one narrow pass. The vocabulary's path must be readable on every executor."""
    picked = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{column}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = pa.array([enc.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["k", "ids"])

    out = picked.mapInArrow(run, f"k {picked.schema['k'].dataType.simpleString()}, ids array<int>")
    return out.select(F.col("k").alias(key), "ids")
