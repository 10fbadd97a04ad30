import random
from pathlib import Path

from vellumflow.llm import neardup as D


def texts(seed=4, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        base = [r.choice(vocab) for _ in range(r.randint(40, 120))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            copy = list(base)
            for _ in range(r.randint(0, 8)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            out.append(" ".join(copy))
    return out + out[:5] + ["one two", "", None, "Same TEXT here now", "same text, HERE (now)"]


def exact(rows, size, threshold):
    sets = {i: set(D.shingles(t, size).tolist()) for i, t in rows}
    ids = [i for i, s in sets.items() if s]
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_pairs_against_brute_force(spark):
    rows = list(enumerate(texts()))
    want = exact(rows, 3, 0.6)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows + rows[:7]], "id bigint, t string, rep int")
    near = D.NearDuplicates(df, "id", "t", size=3, threshold=0.6)
    assert {tuple(x) for x in near.pairs().collect()} == want
    links = {i: 0 for p in want for i in p}
    for a, b in want:
        links[a] += 1
        links[b] += 1
    got = near.groups().collect()
    assert {r.id: r.n_links for r in got} == links
    group = {r.id: r.group_id for r in got}
    assert all(group[a] == group[b] for a, b in want) and all(g <= i for i, g in group.items())


def test_hot_region_is_whole(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):  # many texts that differ in one word each: more than a region holds
        t = list(base)
        t[i % 60] = f"x{i}"
        rows.append((i, " ".join(t)))
    near = D.NearDuplicates(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", size=3, threshold=0.6, region=8)
    got, want = {tuple(x) for x in near.pairs().collect()}, exact(rows, 3, 0.6)
    assert got == want


def test_empty(spark):
    assert D.NearDuplicates(spark.createDataFrame([(1, None), (2, "")], "id bigint, t string"), "id", "t").pairs().count() == 0


def test_large_regions_lose_no_pair(spark):
    r = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):  # variants of one base that are just similar enough to each other, in regions far larger than a block
        t = list(base)
        for k in r.sample(range(60), 3):
            t[k] = f"x{i}_{k}"
        rows.append((i, " ".join(t)))
    near = D.NearDuplicates(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", size=3, threshold=0.6, region=8)
    got, want = {tuple(x) for x in near.pairs().collect()}, exact(rows, 3, 0.6)
    assert len(want) > 500 and got == want


def test_dense_regions_near_the_threshold(spark):
    r = random.Random(3)
    rows = []
    for b in range(3):  # three texts, many variants of each around the threshold, and a passage that all of them share
        base = [f"b{b}_{i}" for i in range(90)]
        for i in range(60):
            t = list(base)
            for k in r.sample(range(90), r.randint(4, 12)):
                t[k] = f"x{i}_{k}"
            rows.append((len(rows), " ".join(t) + " " + " ".join(f"common{j}" for j in range(12))))
    want = exact(rows, 3, 0.6)
    near = {tuple(x) for x in D.NearDuplicates(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", size=3, threshold=0.6, region=4).pairs().collect()}
    assert len(want) > 1000 and near <= want and len(near) >= 0.995 * len(want)
    sets = spark.createDataFrame([(i, D.shingles(t, 3).view("int64").tolist()) for i, t in rows], "rep bigint, sh array<bigint>")
    assert want <= {tuple(x) for x in D.sharing(sets, 0.6, 7).collect()}


def test_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "COPIES", 4)
    rows = [(i, "the same words in every one of these texts") for i in range(23)]
    near = D.NearDuplicates(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", size=3, threshold=0.6)
    assert {tuple(x) for x in near.pairs().collect()} == {(a, b) for a in range(23) for b in range(a + 1, 23)}


def test_disk_of_crowded_regions(spark):
    """Texts that share phrases crowd the regions; what is shuffled and stored stays a few bytes for each key."""
    r = random.Random(11)
    phrases = [" ".join(f"p{i}_{j}" for j in range(6)) for i in range(150)]
    rows = [(i, " ".join(r.choice(phrases) for _ in range(40))) for i in range(500)]
    rows += [(len(rows) + i, rows[i][1] + " and one more line") for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, t string").repartition(4)
    sc = spark.sparkContext._jsc.sc()
    none = spark.sparkContext._jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    written = lambda: sum(x.shuffleWriteBytes() + x.diskBytesSpilled() for x in _list(sc.statusStore().stageList(none, False, False, quantiles, none)))
    stored = lambda: sum(p.stat().st_size for p in Path(sc.getCheckpointDir().get().removeprefix("file:")).rglob("*") if p.is_file()) if sc.getCheckpointDir().isDefined() else 0
    before = written() + stored()
    got = {tuple(x) for x in D.NearDuplicates(df, "id", "t", size=3, threshold=0.6, region=8).pairs().collect()}
    sc.listenerBus().waitUntilEmpty()
    used = written() + stored() - before
    assert got == exact(rows, 3, 0.6) and len(got) >= 40
    assert used < 6000 * len(rows), used / len(rows)


def _list(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_trees_keep_the_chance_of_a_miss():
    assert [D.trees(d, 0.6, 2) for d in (3, 4, 5)] == [60, 104, 177]


def test_deeper_prefixes_lose_no_pair(spark):
    rows = list(enumerate(texts(seed=9, n=80)))
    df = spark.createDataFrame(rows, "id bigint, t string")
    for depth in (3, 5):
        near = D.NearDuplicates(df, "id", "t", size=3, threshold=0.6, shallow=depth)
        assert near.depth >= depth and {tuple(x) for x in near.pairs().collect()} == exact(rows, 3, 0.6)


def test_texts_of_one_id_stay_apart(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    rows = [(5, x), (5, y), (7, x), (9, y), (20, x + " more")]
    near = D.NearDuplicates(spark.createDataFrame(rows, "id bigint, t string"), "id", "t", size=3, threshold=0.6)
    assert {tuple(p) for p in near.pairs().collect()} == {(5, 7), (5, 9), (5, 20), (7, 20)}
