"""The same text functions written as SQL for the oracle, independently of the Column builders."""

from __future__ import annotations

from vellumflow.functions import text as T


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def values(rows: list[tuple], names: str) -> str:
    def cell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(cell(y) for y in x) + "]"
        return quoted(x) if isinstance(x, str) else (f"{x}::DOUBLE" if isinstance(x, float) else str(x))

    return "(VALUES " + ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows) + f") AS v({names})"


def normalised(t: str) -> str:
    e = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    for a, b in {**T.JOINED, **T.TYPOGRAPHIC}.items():
        e = f"replace({e}, {quoted(a)}, {quoted(b)})"
    e = f"regexp_replace({e}, '[{T.BULLET_SIGNS}]', chr(10) || '- ', 'g')"
    e = f"regexp_replace({e}, '[ \\t\\f\\x0B]+', ' ', 'g')"
    return f"trim(regexp_replace({e}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"


def tokens(t: str) -> str:
    return f"regexp_extract_all({t}, {quoted(T.TOKEN)})"


def lemma(x: str) -> str:
    """SQL of the lemma of a token expression that is already lower case."""
    cases = " ".join(f"WHEN {x} = {quoted(a)} THEN {quoted(b)}" for a, b in T.IRREGULAR.items())
    def cut(suffix: str, new: str) -> str:
        return f"(left({x}, length({x}) - {len(suffix)}) || {quoted(new)})"
    def short(s: str) -> str:
        return f"CASE WHEN length({s}) > 3 AND right({s}, 1) = left(right({s}, 2), 1) AND right({s}, 1) NOT IN ('s', 'l') THEN left({s}, length({s}) - 1) ELSE {s} END"
    suffix = " ".join(f"WHEN ends_with({x}, {quoted(s)}) AND length({x}) - {len(s)} >= 3 THEN {short(cut(s, n))}" for s, n in T.SUFFIXES)
    return f"CASE {cases} WHEN length({x}) <= 3 THEN {x} {suffix} ELSE {x} END"


def is_content(x: str) -> str:
    return f"({x} NOT IN {listed(T.STOPWORDS)} AND length({x}) > 1 AND NOT regexp_matches({x}, '^[0-9]+$'))"


def content_tokens(source: str, key: str, text: str) -> str:
    """CTE body: key, pos (from 1, content lemmas only), lemma."""
    return f"""
      SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY p) AS pos, lemma FROM (
        SELECT {key}, p, {lemma('tok')} AS lemma FROM (
          SELECT {key}, unnest(range(1, len(ts) + 1)) AS p, lower(unnest(ts)) AS tok FROM (SELECT {key}, {tokens(text)} AS ts FROM {source}) a) b) c
      WHERE {is_content('lemma')}"""
