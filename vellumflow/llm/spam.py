"""Keyword-stuffed pages and lists of links or tags: shares of words, thresholds calibrated for each language.

A page is cut into lines and sentences. A piece of sentences has enough function words of one language; what is left
stands outside of sentences. A page is found when more than half of its words stand outside and those words show what
stuffing shows: the share of the top word or of repeated word pairs, of repeated lines, of links and tags, or the density of
separators, each over the whole page, lies above what honest pages of its language reach, and the share of function words
below (`thresholds`). Four languages have a list of function words; those of any other are learned from the pages that are
labelled with it (`learn_words`).

Defined results: null, '' and blank texts and texts without words are no case; a page without a label has the language whose
function words it holds most, 'other' when there are none, and is then judged by its shares alone; repeated rows give one result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumflow.sources.tables import checkpointed

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "a about after all also an and any are as at be because been before but by can could did do does don each every first for from had has have he her his how i if in into is isn it its just last like ll me more most my no not of on one only or other our out over s said she so some such t than that the their them then there these they this those to too two until up us very was we were what when where which while who whose why will with without would yet you your",
    "fr": "a au aux avec bien c ce ces cette comme d dans de des deux du elle en est et eux fait il ils j je l la le les leur lui mais mieux moins même n ne nos notre nous on ont ou où par pas plus pour puis qu que quel qui s sa sans se ses si son sont sur ta te tes tout toute très tu un une vaut vos votre vous y à été être",
    "de": "aber alle als am an auch auf aus bei bin bis bitte da das dass dem den der des die dies diese diesem dieser doch du durch ein eine einem einen einer eines er es für habe haben hat ich ihr ihre im in ist ja kann kein keine man mehr mein mich mir mit nach nicht noch nur oder ohne ob schon sehr sein sich sie sind so über um und uns unser unsere unter viel vom von vor war was weil wenn wer werden wie wird wir wo zu zum zur zwei",
    "es": "a al algo antes año años como con cada cuando de del desde donde dos el ella ellos en entre era es ese eso esta este esto está fue ha hasta hay la las le les lo los me mejor menos mi mis mucho muy más no nos nuestra nuestro o os otra para pero poco por porque que quien qué se ser si sin sobre son su sus sí también tanto te tiene todo tu tus un una uno unos y ya yo",
}
_LINES = re.compile(r"[\r\n]+")
_SENTENCE = re.compile(r"(?<=[.!?:…])[\"'”’)]*\s+(?=\S)")
_WORD = re.compile(r"[^\W\d_]+")
_ALNUM = re.compile(r"[^\W_]")
_DIGITS = re.compile(r"\d+")
_LINK = re.compile(r"^[(\[<]*(?:[a-z]+://|www\.)\S+|^[(\[<]*[\w-]+(?:\.[\w-]+)*\.[a-z]{2,7}(?:[/?#]\S*)?[)\]>,;.]*$|\]\(\S+\)", re.I)
_ANCHOR = re.compile(r"<a\s[^<>]*?href\s*=\s*[\"']?([^\"'<>\s]+)[^<>]*>", re.I)
_MARKUP = re.compile(r"<[^<>]{1,200}>")
_SEPARATORS = re.compile(r"[|;•·]| [-–/>] |,")
SHARES = ("top", "pairs", "lines", "links", "separators")
UNKNOWN = ("", "und", "other")  # labels that name no language
FEW = 0.25  # share of function words below which a page without a label may be in a language without a fixed list
FEATURES = ("outside", *SHARES, "functions", "within")


def lexicon(learned: dict[str, list[str]] | None = None) -> dict[str, tuple[str, ...]]:
    """word -> the languages whose function words hold it: the fixed lists and those learned from the pages."""
    out: dict[str, tuple[str, ...]] = {}
    for lang, words in [*FUNCTION_WORDS.items(), *(learned or {}).items()]:
        for w in words.split() if isinstance(words, str) else words:
            out[w] = (*out.get(w, ()), lang)
    return out


def learn_words(df: DataFrame, column: str, lang: str | None, most: int = 50_000) -> dict[str, list[str]]:
    """Function words of the languages that have no fixed list, from all pages labelled with them.

    They are the words that a tenth of a language's pages hold and that hardly ever stand alone between separators, as
    keywords do. What reaches the driver is a vocabulary, at most ten words a page's words' worth of each language: the sum
    of all shares of pages bounds it, and more than `most` are refused.
    """
    if lang is None:
        return {}
    pages = df.select(F.col(f"`{lang}`").cast("string").alias("l"), F.lower(F.col(f"`{column}`").cast("string")).alias("t"))
    pages = pages.where(~F.col("l").isin(*FUNCTION_WORDS, *UNKNOWN) & (F.length(F.trim("t")) > 0))
    once = F.array_distinct(F.regexp_extract_all("t", F.lit(r"\p{L}+"), F.lit(0)))
    alone = F.regexp_extract_all("t", F.lit(r"(?:^|[\n,;|•·/#>])\s*(\p{L}+)\s*(?=$|[\n,;|•·/#<])"), F.lit(1))
    each = pages.select("l", F.explode(F.concat(F.array(F.struct(F.lit("").alias("w"), F.lit(0).alias("a"))), F.transform(once, lambda w: F.struct(w.alias("w"), F.lit(0).alias("a"))), F.transform(alone, lambda w: F.struct(w.alias("w"), F.lit(1).alias("a"))))).alias("x"))
    counts = each.groupBy("l", "x.w").agg(F.sum(1 - F.col("x.a")).alias("df"), F.sum("x.a").alias("alone"))
    sizes = counts.where("w = ''").select("l", F.col("df").alias("n"))
    chosen = counts.where("w <> '' and df >= 3 and length(w) <= 12").join(F.broadcast(sizes), "l").where("df >= 0.1 * n and alone <= 0.05 * df").select("l", "w")
    rows = chosen.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} function words")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.l, []).append(r.w)
    return out


def _is_sentence(piece: str, n: int, linked: int, w: list[str], hits: list[tuple[str, tuple[str, ...]]]) -> bool:
    """w: the piece's words; hits: those of them that are function words, with their languages."""
    if linked / n > 0.15 or not w:
        return False
    kinds = count = 0
    if hits:
        all_of: Counter = Counter()
        some_of: Counter = Counter()
        for _, langs in hits:
            all_of.update(langs)
        for _, langs in dict(hits).items():
            some_of.update(langs)
        kinds, count = max(some_of.values()), max(all_of.values())
    ended = piece.rstrip().rstrip("\"'”’)").endswith((".", "!", "?", ":", "…"))
    share = count / len(w)
    if ended and 4 <= n <= 80 and kinds >= 2:
        return True
    if n > 40:  # a run without any stop
        return kinds >= 6 and share >= 0.2 and len(set(w)) > 0.5 * len(w)
    return share >= 0.2 and (kinds >= 3 or (kinds >= 2 and n <= 25 and not _SEPARATORS.search(piece)))


def page_features(text: str, words: dict[str, tuple[str, ...]]) -> tuple[str, list[float], float] | None:
    """Language by function words, the shares of one page and its share of function words; None if it has no words."""
    if "<" in text:
        text = _MARKUP.sub(" ", _ANCHOR.sub(r" http://\1 ", text))
    total = outside = linked_all = separators = lines_out = n_all = functions_all = 0
    loose: list[str] = []
    lines: Counter = Counter()
    langs: Counter = Counter()
    for line in _LINES.split(text):
        had = False
        for piece in _SENTENCE.split(line):
            tokens = [x for x in piece.split() if x.isalnum() or _ALNUM.search(x)]
            n = len(tokens)
            if not n:
                continue
            total += n
            links = [x for x in tokens if (x[0] == "#" and len(x) > 1) or (not x.isalnum() and _LINK.search(x))]
            w = _WORD.findall(piece.lower())
            hits = [(x, words[x]) for x in w if x in words]
            n_all += len(w)
            functions_all += len(hits)
            for _, of in hits:
                langs.update(of)
            if not _is_sentence(piece, n, len(links), w, hits):
                outside += n
                linked_all += len(links)
                separators += len(_SEPARATORS.findall(piece))
                loose.extend(w if not links else [y for x in tokens if x[0] == "#" or not _LINK.search(x) for y in _WORD.findall(x.lower())])
                had = True
        if had:
            lines_out += 1
            lines[_DIGITS.sub("0", line.strip().lower())] += 1
    if not total:
        return None
    lang = max(langs, key=lambda k: (langs[k], k)) if langs else "other"
    n_loose = max(1, len(loose))
    functions = sum(1 for w in loose if w in words)
    pairs = Counter(zip(loose, loose[1:]))
    n_within = n_all - len(loose)
    return lang, [
        outside / total,
        (Counter(loose).most_common(1)[0][1] if loose else 0) / n_loose if outside >= 8 else 0.0,
        sum(v for v in pairs.values() if v > 1) / max(1, len(loose) - 1) if outside >= 8 else 0.0,
        sum(v for v in lines.values() if v > 1) / max(1, lines_out) if lines_out >= 4 else 0.0,
        linked_all / max(1, outside),
        separators / max(1, outside),
        functions / n_loose,
        max(0, functions_all - functions) / n_within if n_within > 0 else 0.0,
    ], functions_all / max(1, n_all)


def measure(df: DataFrame, key: str, column: str, lang: str | None = None) -> DataFrame:
    """doc_id, lang and the shares of each page that has words; one narrow pass."""
    given = F.col(f"`{lang}`").cast("string") if lang else F.lit(None).cast("string")
    picked = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{column}`").cast("string").alias("t"), given.alias("l")).where(F.length(F.trim("t")) > 0)
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, lang string, " + ", ".join(f"{f} double" for f in FEATURES)

    learned = learn_words(df, column, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = lexicon()
        of_label = {k: lexicon({k: v}) for k, v in learned.items()}
        every = lexicon(learned)
        for b in batches:
            at, langs, rows = [], [], []
            for i, (t, l) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):  # noqa: E741
                f = page_features(t, of_label.get(l, fixed))
                if f and learned and l not in of_label and l not in FUNCTION_WORDS and f[2] < FEW:
                    f = page_features(t, every)  # no label, and hardly a function word of the fixed lists
                if f:
                    at.append(i)
                    langs.append(l if l in of_label or l in FUNCTION_WORDS else f[0])
                    rows.append(f[1])
            cols = [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(langs, pa.string()), *cols], names=["doc_id", "lang", *FEATURES])

    return picked.mapInArrow(run, schema)


def thresholds(shares: DataFrame, least_pages: int = 100) -> DataFrame:
    """One row a language: the greatest share of the whole page that a hundredth of its honest pages exceed, for every share.

    Honest are the pages that mostly consist of sentences; of `functions` it is the share within their sentences that all but
    a twentieth of them exceed. A language of fewer than `least_pages` honest pages has the thresholds of all languages.
    """
    honest = shares.where("outside < 0.3")
    quantiles = [F.percentile_approx(F.col(s) * F.col("outside"), F.lit(0.99), F.lit(1000)).alias(f"{s}_least") for s in SHARES]
    quantiles.append(F.greatest(F.lit(0.15), F.percentile_approx("within", F.lit(0.05), F.lit(1000))).alias("functions_most"))
    own = honest.groupBy("lang").agg(F.count(F.lit(1)).alias("n_honest"), *quantiles)
    names = [f"{s}_least" for s in SHARES] + ["functions_most"]
    every = honest.agg(*quantiles).select(*[F.coalesce(n, F.lit(0.15 if n == "functions_most" else 0.0)).alias(f"all_{n}") for n in names])
    langs = shares.select("lang").distinct().join(own, "lang", "left").crossJoin(F.broadcast(every))  # one row
    return langs.select("lang", *[F.when(F.col("n_honest") >= least_pages, F.col(n)).otherwise(F.col(f"all_{n}")).alias(n) for n in names])


def find_stuffed(df: DataFrame, key: str, column: str, lang: str | None = None, share: float = 0.5) -> DataFrame:
    """doc_id of the pages most of whose words stand in repeated keywords, lists of links, or tags."""
    shares = checkpointed(measure(df, key, column, lang))
    marked = shares.join(F.broadcast(thresholds(shares)), "lang")
    signs = F.lit(False)
    for s in SHARES:
        signs = signs | (F.col(s) * F.col("outside") > F.col(f"{s}_least"))
    return marked.where((F.col("outside") > share) & signs & ((F.col("functions") <= F.col("functions_most")) | (F.col("pairs") >= 0.5))).select("doc_id").distinct()
