"""Deeply nested semi-structured records to related flat tables, by list offsets and parent indexes of Arrow buffers.

Two passes. `array_paths` finds which key paths hold an array anywhere (the schema of the column: a few paths, whatever
the number of records). `flatten` then has Arrow's reader turn each batch of texts into one array of nested lists and
structures under that schema, without touching a row in Python; every list of objects gives a child table straight from its
offsets, the keys of parents being carried by vectorised take. Texts that the schema can't say (JSON kept as a string, a lone
object where others hold an array, invalid or very deep texts) are found by the reader itself, in halves of the batch, and
walked one by one; `odd_share` reports how many they are. No pass keeps more than a batch, none shuffles.

Defined results: null, blank and invalid JSON give no rows; a JSON text kept as a string, in the whole or in a part, is
read as what it holds, at any depth; a byte order mark is skipped; null and scalar elements give no row and count as
positions; a lone object under a path that holds an array elsewhere is its element 0; keys become snake_case, and of two
keys of one object that become the same the first that isn't null holds; repeated records give repeated rows; the depth of
a record isn't limited.
"""

from __future__ import annotations

import io
import json
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "﻿"
OPENING = f'{{["{BOM} \n\t\r'  # what JSON kept as a string may begin with
ROOT = ""
ITEM = "[]"  # a path step: an array inside an array
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_snakes: dict[str, str] = {}


def snake(key: str) -> str:
    s = _snakes.get(key)
    if s is None:
        s = re.sub(r"[\s-]+", "_", _CAMEL.sub("_", key.strip())).lower()
        if len(_snakes) < 100_000:
            _snakes[key] = s
    return s


def _refuse(word: str) -> None:
    raise ValueError(word)


_decoder = json.JSONDecoder(parse_constant=_refuse)


def _decoded(text: str):
    """The value of a JSON text of any depth: one that the built-in scanner finds too deep is read by the one in Python, which needs no C stack."""
    try:
        return _decoder.decode(text)
    except RecursionError:
        deep = json.JSONDecoder(parse_constant=_refuse)
        deep.parse_string = json.decoder.py_scanstring
        deep.scan_once = json.scanner.py_make_scanner(deep)
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(limit + 4 * (text.count("[") + text.count("{")))
        try:
            return deep.decode(text)
        finally:
            sys.setrecursionlimit(limit)


def read_json(text: str | None):
    """The value a text contains, strings of JSON inside strings included; None for null, blank or invalid texts."""
    if not text:
        return None
    t = text.strip().lstrip(BOM).strip()
    if not t:
        return None
    try:
        value = _decoded(t)
    except ValueError:
        return None
    return contained(value)


def contained(value):
    """A string that holds a JSON object, array or string of such is what it holds; any other value is itself."""
    while isinstance(value, str) and value[:1] and value[0] in OPENING:
        t = value.strip().lstrip(BOM).strip()
        if t[:1] not in ("{", "[", '"') or len(t) < 2:
            break
        try:
            inner = _decoded(t)
        except ValueError:
            break
        if not isinstance(inner, (dict, list, str)):
            break
        value = inner
    return value


def _paths(value, arrays: set[tuple[str, ...]], objects: set[tuple[str, ...]]) -> None:
    """Adds the paths of keys, as they are written, that hold an array, and those that hold an object (outside or inside of arrays)."""
    stack: list = [(value, None)]
    while stack:
        v, p = stack.pop()
        if type(v) is dict:
            objects.add(_path(p))
            for k, x in v.items():
                if type(x) is str and x and x[0] in OPENING:
                    x = contained(x)
                if type(x) is dict or type(x) is list:
                    stack.append((x, (p, k)))
        elif type(v) is list:
            arrays.add(_path(p))
            for x in v:
                if type(x) is str and x and x[0] in OPENING:
                    x = contained(x)
                if type(x) is dict:
                    stack.append((x, p))
                elif type(x) is list:
                    stack.append((x, (p, ITEM)))


def _path(linked: tuple | None) -> tuple[str, ...]:
    out = []
    while linked is not None:
        linked, key = linked
        out.append(key)
    return tuple(reversed(out))


def snake_path(raw: tuple[str, ...]) -> str:
    return "/".join(k if k == ITEM else snake(k) for k in raw)


def array_paths(df: DataFrame, column: str, most: int = 10_000) -> dict[str, list[tuple[str, ...]]]:
    """{'arrays': paths that hold an array, 'objects': paths that hold an object} of a JSON column, from all its records.

    Like the schema inference of any reader this brings a schema to the driver, not data; a column with more than `most`
    paths (identifiers used as keys) is refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays: set[tuple[str, ...]] = set()
        objects: set[tuple[str, ...]] = set()
        for b in batches:
            for t in b.column(0).to_pylist():
                v = read_json(t)
                if v is not None:
                    _paths(v, arrays, objects)
        rows = [(list(p), True) for p in arrays] + [(list(p), False) for p in objects]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.bool_())], names=["path", "is_array"])

    found = df.select(F.col(f"`{column}`").cast("string").alias("j")).where("j is not null").mapInArrow(run, "path array<string>, is_array boolean")
    rows = found.distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} paths")
    return {"arrays": sorted(tuple(r.path) for r in rows if r.is_array), "objects": sorted(tuple(r.path) for r in rows if not r.is_array)}


class Shape:
    """Nested Arrow type of a column whose arrays and objects stand at known paths; fields are named by the keys as written.

    Only what leads to an object that is an array's element has a field, so the reader skips everything else. What lies
    deeper than DEEPEST gets the type of nothing: a record that holds something there doesn't fit, and is walked.
    """

    DEEPEST = 60

    def __init__(self, paths: dict[str, list[tuple[str, ...]]]):
        self.arrays = {snake_path(p) for p in paths["arrays"]}
        objects = {snake_path(p) for p in paths["objects"]}
        known = {*paths["arrays"], *paths["objects"]}
        self.keys: dict[tuple[str, ...], set[str]] = {}
        useful: set[tuple[str, ...]] = set()
        for p in sorted(known, key=len, reverse=True):
            if p in useful or (snake_path(p) in self.arrays and snake_path(p) in objects):
                while p and p not in useful:
                    useful.add(p)
                    p = p[:-1]
        for p in useful:
            self.keys.setdefault(p[:-1], set()).add(p[-1])
        self.snakes: dict[tuple[str, ...], str] = {}

    def type_at(self, p: tuple[str, ...], is_array: bool) -> pa.DataType:
        if len(p) > self.DEEPEST:
            return pa.null()
        inner = ITEM in self.keys.get(p, ())
        if is_array and inner:  # arrays inside of arrays, beside objects perhaps: the walk tells them apart
            return pa.list_(pa.null())
        fields = [pa.field(k, self.type_at((*p, k), snake_path((*p, k)) in self.arrays)) for k in sorted(self.keys.get(p, ()))]
        element = pa.struct([*fields, pa.field(PRESENT, pa.null())])
        return pa.list_(element) if is_array else element


PRESENT = "\x00"  # a field that no record has: an object without wanted keys is an object still


def _walked(value, arrays: set[str], values: bool) -> list[tuple[str, str, str, list | None]]:
    """(path, node, parent, scalars) of each object of one record that is an array's element; no recursion."""
    out: list[tuple[str, str, str, list | None]] = []
    stack: list = [(value, ROOT, "", "", False)]
    while stack:
        v, p, node, parent, element = stack.pop()
        if type(v) is str:
            v = contained(v)
        if not element and type(v) is dict and p in arrays and p != ROOT:
            v = [v]
        if type(v) is list:
            here = f"{p}/{ITEM}" if element and p else ITEM if element else p
            stack.extend((x, here, f"{node}/{i}" if node else str(i), parent, True) for i, x in reversed(list(enumerate(v))))
        elif type(v) is dict:
            scalars: list | None = [] if values else None
            if element:
                out.append((p, node, parent, scalars))
                parent = node
            seen: set[str] = set()
            for k, x in v.items():
                if x is None:
                    continue
                s = snake(k)
                x = contained(x) if type(x) is str else x
                if type(x) in (dict, list):
                    if s not in seen:
                        seen.add(s)
                        stack.append((x, f"{p}/{s}" if p else s, f"{node}/{s}" if node else s, parent, False))
                if scalars is not None and type(x) is not dict and not (type(x) is list and any(type(y) in (dict, list) for y in x)):
                    scalars.append({"key": s, "value": x if type(x) is str else json.dumps(x, ensure_ascii=False)})
    return out


def _emit(arr: pa.Array, raw: tuple[str, ...], row: np.ndarray, node: pa.Array, parent: pa.Array, shape: Shape, out: list) -> None:
    """Walks the type, not the rows. row: record of each element; node: its place; parent: nearest enclosing object's place."""
    if pa.types.is_null(arr.type) or not len(arr):
        return
    if pa.types.is_list(arr.type):
        owner = pc.list_parent_indices(arr).to_numpy()
        if not len(owner):
            return
        lengths = pc.fill_null(pc.list_value_length(arr), 0).to_numpy()
        starts = np.cumsum(lengths) - lengths
        pos = pc.cast(pa.array(np.arange(len(owner)) - starts[owner]), pa.string())
        take = pa.array(owner)
        base = node.take(take)
        here = pc.if_else(pc.equal(base, ""), pos, pc.binary_join_element_wise(base, pos, "/"))
        arr, row, node, parent, is_node = pc.list_flatten(arr), row[owner], here, parent.take(take), True
    else:
        is_node = False
    valid = np.nonzero(arr.is_valid().to_numpy(zero_copy_only=False))[0]
    if not len(valid):
        return
    pick = pa.array(valid)
    arr, row, node, parent = arr.take(pick), row[valid], node.take(pick), parent.take(pick)
    if is_node:
        out.append((snake_path(raw), row, node, parent))
        parent = node
    seen: dict[str, np.ndarray] = {}
    for i, f in enumerate(arr.type):
        if f.name == PRESENT:
            continue
        column = pc.struct_field(arr, [i])
        name = snake(f.name)
        here = column.is_valid().to_numpy(zero_copy_only=False)
        if name in seen and (seen[name] & here).any():
            raise pa.ArrowInvalid("two keys of one object that become the same")
        seen[name] = seen.get(name, False) | here
        _emit(column, (*raw, f.name), row, pc.if_else(pc.equal(node, ""), pa.scalar(name), pc.binary_join_element_wise(node, pa.scalar(name), "/")), parent, shape, out)


def _wrapped(texts: list[str]) -> list[bytes]:
    """Each text wrapped with its number: what isn't one value each doesn't fit."""
    return [f'{{"n":{i},"v":{t}}}\n'.encode() for i, t in enumerate(texts)]


def _arrays_of(lines: list[bytes], numbers: np.ndarray, schema: pa.Schema) -> pa.Array:
    """Wrapped texts as one nested array, by Arrow's reader."""
    joined = b"".join(lines)
    options = pj.ReadOptions(use_threads=False, block_size=max(1 << 16, len(joined) + 1))
    t = pj.read_json(io.BytesIO(joined), read_options=options, parse_options=pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore", newlines_in_values=True))
    if t.num_rows != len(lines) or not np.array_equal(t.column("n").to_numpy(), numbers):
        raise pa.ArrowInvalid("not one value a text")
    v = t.column("v").combine_chunks()
    return v.chunk(0) if isinstance(v, pa.ChunkedArray) else v


_ROW = re.compile(r"in row (\d+)")


#: A string that may hold JSON, and words that JSON doesn't know but readers do.
_ODD = r'"(?:\s|\\[nrt]|\x{feff}|\\u[fF][eE][fF][fF]|\\u00(?:09|0[aA]|0[dD]|20))*(?:[\[{]|\\")|\b(?:NaN|Inf|Infinity)\b'


class Flattener:
    """Child tables of batches of JSON texts under the paths of the column."""

    def __init__(self, paths: dict[str, list[tuple[str, ...]]], values: bool = False):
        self.shape, self.values = Shape(paths), values
        field = pa.field("n", pa.int64())
        self.schemas = {c: pa.schema([field, pa.field("v", self.shape.type_at((), c == "["))]) for c in "{["}
        # most lone objects show by their key: a key that holds arrays, never an object only, before a bracket of the other kind
        lone = {p[-1] for p in paths["arrays"] if p} - {p[-1] for p in paths["objects"] if p and snake_path(p) not in self.shape.arrays}
        names = "|".join(sorted(re.escape(json.dumps(k, ensure_ascii=False)[1:-1]) for k in lone if k != ITEM))
        self.odd_text = _ODD + (rf'|"(?:{names})"\s*:\s*\{{' if names else "")
        self.read = self.odd = 0

    def batch(self, texts: pa.Array) -> list[tuple[str, np.ndarray, pa.Array, pa.Array, pa.Array | None]]:
        """(path, record index, node, parent, scalars) of each child table of a batch of JSON texts."""
        trimmed = pc.utf8_trim_whitespace(pc.utf8_ltrim(pc.utf8_trim_whitespace(pc.cast(texts, pa.string())), BOM))
        first = pc.fill_null(pc.utf8_slice_codeunits(trimmed, 0, 1), "")
        odd = pc.fill_null(pc.match_substring_regex(trimmed, self.odd_text), False)
        out: list = []
        left: list[np.ndarray] = [np.nonzero(pc.and_(pc.not_equal(first, ""), odd).to_numpy(zero_copy_only=False))[0]]
        left.append(np.nonzero(pc.and_(pc.equal(first, '"'), pc.invert(odd)).to_numpy(zero_copy_only=False))[0])
        for c, schema in self.schemas.items():
            rows = np.nonzero(pc.and_(pc.equal(first, c), pc.invert(odd)).to_numpy(zero_copy_only=False))[0]
            if self.values and len(rows):  # the scalars of any type as texts: a row-wise reading
                left.append(rows)
                continue
            for at in range(0, len(rows), 1024):
                self._fit(trimmed, rows[at : at + 1024], schema, out, left)
        walked: list = []
        for i in np.concatenate(left):
            v = read_json(texts[int(i)].as_py())
            if v is not None:
                walked.extend((int(i), *w) for w in _walked(v, self.shape.arrays, self.values))
        self.read += len(texts)
        self.odd += sum(map(len, left))
        if walked:
            kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
            by_path: dict[str, list] = {}
            for w in walked:
                by_path.setdefault(w[1], []).append(w)
            for p, ws in by_path.items():
                scalars = pa.array([w[4] for w in ws], kind) if self.values else None
                out.append((p, np.array([w[0] for w in ws]), pa.array([w[2] for w in ws], pa.string()), pa.array([w[3] for w in ws], pa.string()), scalars))
        return out

    def _fit(self, texts: pa.Array, rows: np.ndarray, schema: pa.Schema, out: list, left: list) -> None:
        """Adds the child tables of some rows; those that don't fit the schema are left.

        The reader stops at the first text that doesn't fit and names it; it goes on behind that, and what fits is read as
        one. If it names none, halving finds it.
        """
        if not len(rows):
            return
        found: list = []
        try:
            lines = _wrapped(texts.take(pa.array(rows)).to_pylist())
            numbers = np.arange(len(rows))
            fits = np.ones(len(rows), dtype=bool)
            arr, at = None, 0
            while at < len(rows):
                try:
                    arr = _arrays_of(lines[at:], numbers[at:], schema)
                    break
                except pa.ArrowInvalid as e:
                    m = _ROW.search(str(e))
                    if m is None:
                        raise
                    at += int(m[1])
                    fits[at] = False
                    at += 1
            kept = numbers[fits]
            if not len(kept):
                left.append(rows)
                return
            if at:
                arr = _arrays_of([lines[i] for i in kept], kept, schema)
            empty = pa.array([""] * len(kept), pa.string())
            _emit(arr, (), rows[kept], empty, empty, self.shape, found)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, UnicodeEncodeError, IndexError):
            if len(rows) == 1:
                left.append(rows)
            else:
                half = (len(rows) + 1) // 2
                self._fit(texts, rows[:half], schema, out, left)
                self._fit(texts, rows[half:], schema, out, left)
            return
        left.append(rows[~fits])
        out.extend((*f, None) for f in found)


def flatten(df: DataFrame, key: str, column: str, paths: dict[str, list[str]], with_values: bool = False) -> DataFrame:
    """record_id, path, node, parent (and, with values, fields MAP): one row for each object that is an array's element.

    `path` names the child table; `node` is the row's own key within its record and `parent` its parent's, '' at the top.
    """
    picked = df.select(F.col(f"`{key}`").alias("record_id"), F.col(f"`{column}`").cast("string").alias("j")).where("j is not null")
    kind = picked.schema["record_id"].dataType.simpleString()
    schema = f"record_id {kind}, path string, node string, parent string" + (", fields array<struct<key:string,value:string>>" if with_values else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flattener = Flattener(paths, with_values)
        for b in batches:
            ids = b.column(0)
            for p, row, node, parent, values in flattener.batch(b.column(1)):
                cols = [ids.take(pa.array(row)), pa.array([p] * len(row), pa.string()), node, parent]
                cols += [values] if with_values else []
                yield pa.RecordBatch.from_arrays(cols, names=[x.split(" ")[0] for x in ("record_id", "path", "node", "parent", "fields")[: len(cols)]])

    return picked.mapInArrow(run, schema)


def odd_share(df: DataFrame, column: str, paths: dict[str, list[tuple[str, ...]]]) -> DataFrame:
    """n_records, n_walked: how many texts of a column had to be walked one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flattener = Flattener(paths)
        for b in batches:
            flattener.batch(b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([flattener.read], pa.int64()), pa.array([flattener.odd], pa.int64())], names=["r", "o"])

    some = df.select(F.col(f"`{column}`").cast("string").alias("j")).where("j is not null").mapInArrow(run, "r bigint, o bigint")
    return some.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("n_records"), F.coalesce(F.sum("o"), F.lit(0)).alias("n_walked"))


def child_table(flat: DataFrame, path: str, fields: Iterable[str]) -> DataFrame:
    """One related flat table out of `flatten(..., with_values=True)`: its keys and the wanted fields as columns (texts)."""

    def field(name: str) -> Column:
        return F.try_element_at(F.filter("fields", lambda x: x["key"] == name), F.lit(1))["value"].alias(f"f_{name}")

    return flat.where(F.col("path") == path).select("record_id", "node", "parent", *[field(f) for f in fields])
