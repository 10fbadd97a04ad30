"""Two-text TF-IDF cosine, word-set overlap and keyword coverage over all pairs of two collections.

With only two texts in a fit, the smoothed inverse document frequency of a term is 1 when both hold it and 1 + ln(3/2) when
one does, so the cosine of every pair follows from one equi-join on terms and each text's own sum of squares. Pairs without
a shared term are never formed; their similarity is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.functions import text as T
from vellumflow.operators.extract import bounded

ONE_SIDED = (1 + math.log(1.5)) ** 2


def term_weights(df: DataFrame, key: str, column: str, bigrams: bool = False) -> DataFrame:
    """key, term, tf, sq (sum of the text's tf squares), n_terms (its distinct lemmas): the content lemmas of each text, with `bigrams` also each two in a row."""
    lemmas = df.where(F.col(column).isNotNull()).select(key, T.content_lemmas(F.col(column)).alias("l"))
    terms = lemmas.select(key, F.explode(F.concat("l", T.phrases(F.col("l"), 2)) if bigrams else F.col("l")).alias("term"))
    counts = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    totals = counts.groupBy(key).agg(F.sum(F.col("tf") * F.col("tf")).alias("sq"), F.count_if(~F.contains("term", F.lit(" "))).alias("n_terms"))
    return counts.join(totals, key)


def _features(both: DataFrame, a: str, b: str) -> DataFrame:
    agg = both.groupBy(a, b).agg(
        F.sum(F.col("tf") * F.col("tf_b")).alias("dot"), F.sum(F.col("tf") * F.col("tf")).alias("sa"), F.sum(F.col("tf_b") * F.col("tf_b")).alias("sb"),
        F.count_if(~F.contains("term", F.lit(" "))).alias("n_shared"), F.first("sq").alias("sq"), F.first("sq_b").alias("sq_b"), F.first("n_terms").alias("n_a"), F.first("n_b").alias("n_b"),
    )
    k = F.lit(ONE_SIDED)
    na, nb = k * F.col("sq") - (k - 1) * F.col("sa"), k * F.col("sq_b") - (k - 1) * F.col("sb")
    return agg.select(a, b, (F.col("dot") / F.sqrt(na * nb)).alias("cosine"), (F.col("n_shared") / (F.col("n_a") + F.col("n_b") - F.col("n_shared"))).alias("jaccard"), "n_shared")


def _right(right: DataFrame, b: str, broadcast_rows: int) -> DataFrame:
    r = right.select(b, "term", F.col("tf").alias("tf_b"), F.col("sq").alias("sq_b"), F.col("n_terms").alias("n_b"))
    return F.broadcast(r) if right.limit(broadcast_rows + 1).count() <= broadcast_rows else r


def pair_features(left: DataFrame, right: DataFrame, a: str, b: str, broadcast_rows: int = 2_000_000) -> DataFrame:
    """a, b, cosine, jaccard, n_shared of every pair with a shared term; left and right come from `term_weights`.

    The result is the listing of all such pairs, for a right side that is a reference set. It is broadcast only while its
    counted rows stay below `broadcast_rows`; beyond, both are shuffled by term. For the nearest alone see `nearest`.
    """
    return _features(left.join(_right(right, b, broadcast_rows), "term"), a, b)


def given_features(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The same for given pairs (a, b): each brings the terms of its b to its a; pairs without a shared term are missing."""
    return _features(pairs.select(a, b).join(_right(right, b, broadcast_rows), b).join(left, [a, "term"]), a, b)


def near_pairs(left: DataFrame, right: DataFrame, a: str, b: str, column: str, top: int | None = None, most: int = 1_000_000) -> DataFrame:
    """a, b, cosine, jaccard, n_shared of every text of `left` with every text of `right` that shares a term, or with its `top` nearest.

    `right` is a reference set: its terms travel with the tasks (more than `most` are refused), and each left text is scored
    against all of it where it stands, so no pair is ever shuffled and only the nearest leave the task. Nearest by the
    blended score of both measures, ties by b.
    """
    own = right.where(F.col(column).isNotNull()).select(b, F.explode(T.content_lemmas(F.col(column))).alias("term")).groupBy(b, "term").agg(F.count(F.lit(1)).alias("tf"))
    rows = own.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    ids = sorted({r[0] for r in rows})
    kinds = left.schema[a].dataType.simpleString(), right.schema[b].dataType.simpleString()
    kept = [(r[0], r.term, r.tf) for r in rows]
    docs = left.where(F.col(column).isNotNull()).select(a, T.content_lemmas(F.col(column)).alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(ids)}
        postings: dict[str, tuple[list[int], list[int]]] = {}
        sq, n_terms = np.zeros(len(ids)), np.zeros(len(ids))
        for x, term, tf in kept:
            at = postings.setdefault(term, ([], []))
            at[0].append(place[x])
            at[1].append(tf)
            sq[place[x]] += tf * tf
            n_terms[place[x]] += 1
        index = {t: (np.array(i), np.array(f, dtype=np.float64)) for t, (i, f) in postings.items()}
        k = ONE_SIDED
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for row, lemmas in enumerate(batch.column(1).to_pylist()):
                counts = Counter(lemmas)
                hits = [(tf, *index[t]) for t, tf in counts.items() if t in index]
                if not hits:
                    continue
                at = np.concatenate([h[1] for h in hits])
                fb = np.concatenate([h[2] for h in hits])
                fa = np.concatenate([np.full(len(h[1]), float(h[0])) for h in hits])
                shared = np.bincount(at, minlength=len(ids))
                dot, sa, sb = (np.bincount(at, weights=w, minlength=len(ids)) for w in (fa * fb, fa * fa, fb * fb))
                sq_a = float(sum(c * c for c in counts.values()))
                pick = np.nonzero(shared)[0]
                cosine = dot[pick] / np.sqrt((k * sq_a - (k - 1) * sa[pick]) * (k * sq[pick] - (k - 1) * sb[pick]))
                jaccard = shared[pick] / (len(counts) + n_terms[pick] - shared[pick])
                if top is not None:
                    s = np.floor(np.clip(100 * np.minimum(1.0, (0.85 * cosine + 0.15 * jaccard) / 0.35), 0, 100) * 1e4 + 0.5)
                    best = np.lexsort((pick, -s))[:top]
                    pick, cosine, jaccard = pick[best], cosine[best], jaccard[best]
                out.append((np.full(len(pick), row), pick, cosine, jaccard, shared[pick]))
            cols = [np.concatenate([o[i] for o in out]) if out else np.empty(0) for i in range(5)]
            of = pa.array(ids).take(pa.array(cols[1].astype(np.int64))) if len(ids) else pa.array([], batch.column(0).type)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0].astype(np.int64))), of, pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4].astype(np.int64))], names=[a, b, "cosine", "jaccard", "n_shared"])

    return docs.mapInArrow(run, f"`{a}` {kinds[0]}, `{b}` {kinds[1]}, cosine double, jaccard double, n_shared bigint")


def held_shares(df: DataFrame, key: str, column: str, names: DataFrame, name: str) -> DataFrame:
    """key, name, share: of the names that each text holds, 1 as a phrase (any part of the text) or the share of their lemmas; names with none are missing, but each text has a row (name null)."""
    lemmas = names.select(name, F.array_distinct(T.content_lemmas(F.col(name))).alias("kl")).select(name, F.size("kl").alias("of"), F.explode("kl").alias("lemma"))
    d = phrases_held(df, key, column, names, name).select(key, "held", F.array_distinct(T.content_lemmas(F.col(column))).alias("dl"))
    whole = d.select(key, F.explode_outer("held").alias(name), F.lit(1.0).alias("share"))
    hits = d.select(key, F.explode("dl").alias("lemma")).distinct().join(bounded(lemmas), "lemma").groupBy(key, name).agg((F.count(F.lit(1)) / F.max("of")).alias("share"))
    s = whole.unionByName(hits).groupBy(key, name).agg(F.max("share").alias("share"))
    return s.withColumn("share", F.when(F.col(name).isNotNull(), F.col("share")).otherwise(0.0))


def phrases_held(df: DataFrame, key: str, column: str, names: DataFrame, name: str, most: int = 500_000) -> DataFrame:
    """key, column, held: the names each text holds anywhere, whatever the case, by one automaton of all names; narrow.

    The names travel with the tasks, so a list of more than `most` is refused.
    """
    rows = [r[0] for r in names.select(name).where(F.length(name) > 0).distinct().limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} names")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same: dict[str, list[str]] = {}
        for n in rows:
            same.setdefault(n.lower(), []).append(n)
        automaton = ahocorasick.Automaton()
        for low, ns in same.items():
            automaton.add_word(low, ns)
        if same:
            automaton.make_automaton()
        for b in batches:
            held = [sorted({n for _, ns in automaton.iter(t.lower()) for n in ns}) if t and same else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held, pa.list_(pa.string()))], names=[key, column, "held"])

    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, `{column}` string, held array<string>")
