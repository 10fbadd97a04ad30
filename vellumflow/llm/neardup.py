"""Near-duplicate texts by an LSH forest: many sorted orders of min-hash signatures, neighbours by their common prefix.

Similarity is that of the sets of successive words (Jaccard). Texts with equal sets are one class, found by aggregation, so
copies cost nothing more. In each tree, classes with a common prefix of min-hashes form a region, all pairs of a region are
candidates, and those that meet in `agreements` trees are compared exactly. The depth of the prefixes follows the data: a
few trees are counted at several depths, and the depth is taken at which keys and pairs together are fewest. A deeper prefix gets as many more trees as keep the chance of missing a pair that just reaches the threshold at MISS (`trees`): for 0.6 and two
meetings that are 60 trees at depth 3, 104 at 4 and 177 at 5. So neither regions nor their pairs are cut, and the pairs of
unrelated texts, which grow with the square of the classes at one depth, stay fewer than the keys.

What goes to disk: a key is 9 bytes (32 bits of the region's hash within its bucket, 40 of the class's), sent in packed blocks.
Regions or names that collide in these bits only give more candidates, since a name stands for all its classes and every pair
is compared; two classes of one name would miss each other (a chance of 1e-12 for a pair). Signatures and sets are never stored: texts are read again for the keys and, where they are of a candidate, for the comparison.

`sharing` is the exact search by the rarest members, which needs several times the disk; tests hold the forest against it.

Defined results: null texts and texts of fewer words than a shingle have no pairs; repeated rows count once; one id with
several texts is compared by each of them and never with itself; ties don't occur, since the threshold is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vellumflow.sources.tables import BROADCAST_KEYS, checkpointed

MISS, SEED = 1e-5, 20_011
DEPTHS, PROBES = 4, 4  # how many depths are counted before one is taken, and in how many trees
ENTRIES = 300_000  # keys that are sorted at once
NAME = (1 << 40) - 1
COPIES = 1000  # members of a class that are paired in one task
_WORDS = regex.compile(r"[\p{L}\p{N}]+")
_hashes: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    out = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        h = _hashes.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(_hashes) > 500_000:
                _hashes.clear()
            _hashes[w] = h
        out[i] = h
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of `size` successive words."""
    words = _WORDS.findall(text.lower()) if text else []
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    h = _word_hashes(words)
    with np.errstate(over="ignore"):
        x = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            x = _mixed(x + h[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(x)


def trees(depth: int, threshold: float, agreements: int, miss: float = MISS) -> int:
    """The fewest trees in which a pair of that similarity meets at least `agreements` times but for a chance of `miss`."""
    p, n = threshold**depth, agreements
    while sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(agreements)) > miss:
        n += 1
    return n


def _parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def signature(sh: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The min-hash of 32 bits of a set under each function."""
    best = np.full(len(mul), np.iinfo(np.uint32).max, dtype=np.uint32)
    short = (sh >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(sh), 256):
            np.minimum(best, (short[at : at + 256, None] * mul + add).min(0), out=best)
    return best


def _prefixes(sigs: np.ndarray) -> np.ndarray:
    """texts x trees x depth to the same shape: at each place the hash of its tree and of the min-hashes up to it."""
    out = np.empty(sigs.shape, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = np.broadcast_to(_mixed(np.arange(1, sigs.shape[1] + 1, dtype=np.uint64)), sigs.shape[:2])
        for k in range(sigs.shape[2]):
            x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + sigs[:, :, k])
            out[:, :, k] = x
    return out


def _class(sh: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(sh.tobytes()), "big", signed=True)


def _named(df: DataFrame, size: int, depths: range) -> DataFrame:
    """id, c (the set's name), probe (its prefixes of these depths in PROBES trees) of every text with at least one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _parameters(depths[-1] * PROBES)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows, names, sigs = [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    sh = shingles(t, size)
                    if len(sh):
                        rows.append(i)
                        names.append(_class(sh))
                        sigs.append(signature(sh, mul, add))
                probe = _prefixes(np.array(sigs, dtype=np.uint32).reshape(len(rows), PROBES, depths[-1]))[:, :, depths[0] - 1 :]
                probe = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * (PROBES * len(depths)), pa.int32()), pa.array((probe >> np.uint64(32)).astype(np.uint32).reshape(-1).view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(names, pa.int64()), probe], names=["id", "c", "probe"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, c bigint, probe array<int>")


def _depth(named: DataFrame, depths: range, threshold: float, agreements: int) -> tuple[int, int]:
    """The depth at which keys and pairs of all its trees are fewest, by the counts of PROBES trees; the number of classes."""
    keys = named.groupBy("c").agg(F.first("probe").alias("probe")).select(F.posexplode("probe").alias("at", "key"))
    n = F.col("n").cast("double")
    counts = keys.groupBy("at", "key").agg(F.count(F.lit(1)).alias("n")).groupBy((F.col("at") % len(depths)).alias("d")).agg(F.sum("n").alias("classes"), F.sum(n * (n - 1) / 2).alias("pairs"))
    found = {depths[r["d"]]: (r["classes"] / PROBES, r["pairs"] / PROBES) for r in counts.collect()}
    if not found:
        return depths[0], 0
    # a pair takes about twice the bytes of a key
    return min(depths, key=lambda d: trees(d, threshold, agreements) * (found[d][0] + 2 * found[d][1])), int(found[depths[0]][0])


def _packed(x: np.ndarray, n: int) -> np.ndarray:
    """The lower n bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]


def _unpacked(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b), 8), dtype=np.uint8)
    out[:, : b.shape[1]] = b
    return out.view("<u8")[:, 0]


def _keys(df: DataFrame, size: int, depth: int, n_trees: int, buckets: int) -> DataFrame:
    """bucket, block: of each bucket of regions the keys of some texts, 4 bytes of the region's and 5 of the class's hash each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _parameters(depth * n_trees)
        for b in batches:
            found: dict[int, int] = {}
            parts = []
            for at in range(0, b.num_rows, 512):
                sigs = []
                for t in b.column(1).slice(at, 512).to_pylist():
                    sh = shingles(t, size)
                    if len(sh) and (c := _class(sh)) not in found:
                        found[c] = len(found)
                        sigs.append(signature(sh, mul, add))
                if sigs:
                    parts.append(_prefixes(np.array(sigs).reshape(len(sigs), n_trees, depth))[:, :, -1])
            if not found:
                continue
            key = np.concatenate(parts).reshape(-1)
            name = np.repeat(np.array(list(found), dtype=np.int64).view(np.uint64), n_trees)
            bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            block = np.concatenate([_packed(key[order], 4), _packed(name[order], 5)], axis=1)
            some, starts = np.unique(bucket[order], return_index=True)
            ends = np.append(starts, len(order)) * 9
            for at in range(0, len(some), 512):
                here = slice(at, min(at + 512, len(some)))
                offsets = (ends[here.start : here.stop + 1] - ends[here.start]).astype(np.int32)
                blocks = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(block.reshape(-1)[ends[here.start] : ends[here.stop]])])
                yield pa.RecordBatch.from_arrays([pa.array(some[here]), blocks], names=["bucket", "block"])

    return df.select("id", "t").mapInArrow(run, "bucket int, block binary")


def _regions(keys: DataFrame, region: int) -> DataFrame:
    """x, y: the classes of each region of two or more; those of more than `region` are cut into blocks, every two of which are a row."""

    def of(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        b = np.frombuffer(b"".join(blocks), dtype=np.uint8).reshape(-1, 9)
        key, name = _unpacked(b[:, :4]), _unpacked(b[:, 4:])
        order = np.lexsort((name, key))
        key, name = key[order], name[order].astype(np.int64)
        new = np.ones(len(key), dtype=bool)  # copies of a class stand in its regions once
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name = key[new], name[new]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(starts[1:], len(key))
        several = np.flatnonzero(ends - starts > 1)
        x, y = [], []
        for i in several:
            cut = [name[k : min(k + region, ends[i])] for k in range(starts[i], ends[i], region)]
            for p, u in enumerate(cut):
                for q in range(p, len(cut)):
                    x.append(u)
                    y.append(cut[q] if q > p else name[:0])
                    if len(x) == 4096:
                        yield pa.RecordBatch.from_arrays([_lists(x), _lists(y)], names=["x", "y"])
                        x, y = [], []
        if x:
            yield pa.RecordBatch.from_arrays([_lists(x), _lists(y)], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for b in batches:
            for bucket, block in zip(b.column(0).to_pylist(), b.column(1)):
                if bucket != now and blocks:
                    yield from of(blocks)
                    blocks = []
                now = bucket
                blocks.append(block.as_py())
        if blocks:
            yield from of(blocks)

    return keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "x array<bigint>, y array<bigint>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64), pa.int64()))


def _candidates(texts: DataFrame, size: int, depth: int, n_trees: int, n_classes: int, region: int, agreements: int) -> DataFrame:
    """a < b: names (40 bits) of classes that share a region in at least `agreements` trees."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, n_classes * n_trees // ENTRIES)
    # blocks of one region are paired in different tasks; lists are far smaller than their pairs, so their partitions aren't merged
    lists = _regions(_keys(texts, size, depth, n_trees, buckets), region).repartition(partitions, F.xxhash64("x", "y"))
    each = lists.select(F.posexplode("x").alias("p", "u"), "x", "y")
    other = F.when(F.size("y") > 0, F.col("y")).otherwise(F.slice("x", F.col("p") + 2, F.size("x")))
    pairs = each.select("u", F.explode(other).alias("v")).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= agreements).select("a", "b")


def sharing(sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """a < b: every pair of sets (rep, sh) that can reach the threshold, by prefixes of the rarest members; exact.

    Two sets of that similarity share one of their first n - ceil(threshold * n) + 1 members, whatever one order all sets are
    put in. The order is by how many sets hold a member, so phrases that many texts hold stand behind the prefixes. A pair is
    kept at a member only if what follows it in both, and their sizes, still allow the threshold. Members that many sets have
    in their prefixes are split into blocks, every two of which are joined on their own.
    """
    each = sets.select("rep", F.explode("sh").alias("m"))
    often = each.groupBy("m").agg(F.count(F.lit(1)).alias("df"))
    # members of one set pair nothing, but they count for the place of the others
    order = each.join(often, "m").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "m"))).alias("o"))
    n = F.size("o")
    head = order.select("rep", n.alias("n"), F.posexplode(F.slice("o", F.lit(1), n - F.ceil(threshold * n - 1e-9).cast("int") + 1)).alias("p", "x"))
    head = checkpointed(head.where("x.df > 1").select("rep", "n", "p", F.col("x.m").alias("m")))
    k = F.ceil(F.col("c") / block).cast("int")
    counted = head.join(head.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "m").withColumn("k", k).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    cut = counted.select("m", "rep", "n", "p", "mine", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    cells = cut.groupBy("m", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(
        F.collect_list(F.when(F.col("mine") <= F.col("other"), F.struct("rep", "n", "p"))).alias("x"), F.collect_list(F.when(F.col("mine") >= F.col("other"), F.struct("rep", "n", "p"))).alias("y")
    )
    # a cell of one block has it on both sides: each two of its sets once, none with itself
    both = cells.select("i", "j", F.explode("x").alias("u"), "y").select("i", "j", "u", F.explode("y").alias("v")).where("i < j or u.rep < v.rep")
    shared = F.least(F.col("u.n") - F.col("u.p"), F.col("v.n") - F.col("v.p"))
    need = threshold / (1 + threshold) * (F.col("u.n") + F.col("v.n"))
    fits = (F.least("u.n", "v.n") >= threshold * F.greatest("u.n", "v.n") - 1e-9) & (shared >= need - 1e-9)
    return both.where(fits).select(F.least("u.rep", "v.rep").alias("a"), F.greatest("u.rep", "v.rep").alias("b")).distinct()


def _compared(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """a, b, shared, either of the candidate pairs (a, ra, b, rb: classes and texts that stand for them) that reach the threshold.

    Only texts of candidates are wanted. While their ids are at most BROADCAST_KEYS they are sent to the scan, which drops the others.
    """
    seen = Observation()
    wanted = pairs.select(F.explode(F.array("ra", "rb")).alias("id")).distinct()
    wanted = checkpointed(wanted.observe(seen, F.count(F.lit(1)).alias("n")))
    some = texts.join(F.broadcast(wanted), "id", "left_semi") if seen.get["n"] <= BROADCAST_KEYS else texts
    some = some.select("id", "t").repartition("id")
    both = pairs.join(some.select(F.col("id").alias("ra"), F.col("t").alias("ta")), "ra").join(some.select(F.col("id").alias("rb"), F.col("t").alias("tb")), "rb").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                kept: dict[str, tuple[int, np.ndarray]] = {}
                out = []
                for a, b, *two in zip(*(part.column(i).to_pylist() for i in range(4))):
                    for t in two:
                        if t not in kept:
                            sh = shingles(t, size)
                            kept[t] = _class(sh), sh
                    (ca, x), (cb, y) = kept[two[0]], kept[two[1]]
                    if (ca, cb) != (a, b):  # another text of that id
                        continue
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    either = len(x) + len(y) - shared
                    if shared >= threshold * either - 1e-9:
                        out.append((a, b, shared, either))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["a", "b", "shared", "either"])

    return both.mapInArrow(run, "a bigint, b bigint, shared int, either int").distinct()


class NearDuplicates:
    """Classes of equal texts and the links between them."""

    def __init__(self, df: DataFrame, key: str, column: str, size: int = 5, threshold: float = 0.8, shallow: int = 3, region: int = 64, agreements: int = 2):
        texts = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{column}`").cast("string").alias("t")).where("t is not null and id is not null")
        depths = range(shallow, shallow + DEPTHS)
        named = checkpointed(_named(texts, size, depths))
        ids = named.select("id", "c").distinct()
        classes = ids.groupBy("c").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_members"))
        #: (id, c, rep, n_members): which class each text belongs to, the smallest id of that and its number of ids
        self.members = ids.join(classes, "c").select("id", "c", "rep", "n_members")
        self.depth, n_classes = _depth(named, depths, threshold, agreements)
        self.trees = trees(self.depth, threshold, agreements)
        candidates = _candidates(texts, size, self.depth, self.trees, n_classes, region, agreements)
        name = classes.select((F.col("c").bitwiseAND(F.lit(NAME))).alias("name"), "c", "rep")
        left, right = (name.select(F.col("name").alias(x), F.col("c").alias(f"c{x}"), F.col("rep").alias(f"r{x}")) for x in "ab")
        found = checkpointed(candidates.join(left, "a").join(right, "b").select(F.col("ca").alias("a"), "ra", F.col("cb").alias("b"), "rb"))
        #: (a, b, shared, either): different classes that reach the threshold
        self.links = _compared(found, texts, size, threshold)

    def pairs(self) -> DataFrame:
        """a < b: all pairs of different ids that reach the threshold, copies included."""
        m = self.members.select("id", "c")
        left, right = m.select(F.col("id").alias("x"), F.col("c").alias("a")), m.select(F.col("id").alias("y"), F.col("c").alias("b"))
        across = self.links.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
        # copies of one text: every two blocks of a class are joined on their own
        many = self.members.where("n_members > 1").withColumn("k", F.ceil(F.col("n_members") / COPIES).cast("int")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
        block = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
        within = many.select(F.col("id").alias("x"), "c", "mine", block.alias("other")).join(many.select(F.col("id").alias("y"), "c", F.col("mine").alias("other"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("mine")), ["c", "mine", "other"]).select("x", "y")
        return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def groups(self) -> DataFrame:
        """id, group_id, n_links: the group of each text that has one, and to how many other ids it is linked."""
        from vellumflow.operators.components import connected_components

        links = checkpointed(self.links.select("a", "b"))
        sizes = self.members.select("c", "rep", "n_members").distinct()
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        other = ends.join(sizes.select(F.col("c").alias("b"), "n_members"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("n_members").alias("n_other"))
        comp = connected_components(links).select(F.col("id").alias("c"), "component")
        first = comp.join(sizes.select("c", "rep"), "c").groupBy("component").agg(F.min("rep").alias("least"))
        rows = self.members.join(comp.join(first, "component"), "c", "left").join(other, "c", "left")
        n = F.coalesce("n_other", F.lit(0)) + F.col("n_members") - 1
        return rows.where(n > 0).groupBy("id").agg(F.min(F.coalesce("least", "rep")).alias("group_id"), F.sum(n).alias("n_links"))
