import random

import numpy as np

from lectern.llm import shingles
from lectern.llm.common import components
from lectern.llm.simhash import shingle_hashes


def test_near_copies_beyond_four_bits(spark):
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, at = {}, 0
    for _ in range(12):
        base = words(300)
        for edits in (0, 0, 3, 4, 5, 6, 9, 20):
            own = list(base)
            for i in rng.sample(range(300), edits):
                own[i] = "x"
            texts[at] = " ".join(own)
            at += 1
    texts |= {at: "", at + 1: None, at + 2: "one two"}
    sets = {i: set(shingle_hashes((t or "").encode(), 5).tolist()) for i, t in texts.items()}
    group = {i: i for i in texts}
    for i in texts:
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = sorted((group[i], group[j]))
                group = {k: x if g == y else g for k, g in group.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.one_per_group(df).collect()) == sorted(set(group.values()))
    assert shingles.one_per_group(df.limit(0)).count() == 0


def test_rows_without_doc_id(spark):
    a, b = " ".join("abcdefghij"), " ".join("klmnopqrst")
    df = spark.createDataFrame([(None, a), (None, b), (None, b), (1, a), (1, "else")], "doc_id long, text string")
    assert sorted((r.text, r.doc_id) for r in shingles.one_per_group(df).collect()) == sorted([(a, 1), (b, None), ("else", 1)])


def test_overlaps_and_blocks(spark, monkeypatch):
    """Blocks of any size give the components of all pairs of a bucket."""
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 60, 200)
    sets = []
    for i in range(60):
        own = base.copy()
        own[rng.choice(200, rng.integers(5, 40), replace=False)] = rng.integers(1, 1 << 60, 1)[0] + i
        sets.append(np.unique(own).astype("<u8"))
    got = shingles.overlaps(sets, np.array([3, 7]))
    assert all(got[k, j] == len(np.intersect1d(sets[i], sets[j])) for k, i in enumerate((3, 7)) for j in range(60) if i != j)
    placed = spark.createDataFrame([(1, f"n{i:02d}", len(s), f"n{i:02d}", "n00") for i, s in enumerate(sets)], "key long, node string, size long, c string, main string")
    table = spark.createDataFrame([(f"n{i:02d}", bytearray(s.tobytes())) for i, s in enumerate(sets)], "node string, hashes binary")
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(60):
        for j in range(i):
            if alike(sets[i], sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {(f"n{i:02d}", f"n{find(i):02d}") for i in range(60) if [find(j) for j in range(60)].count(find(i)) > 1}
    for cells in (shingles.CELLS, 1500):
        monkeypatch.setattr(shingles, "CELLS", cells)
        reached = components(shingles.met_in_blocks(placed, table, 0.8))
        assert {(r.node, r.component) for r in reached.collect()} == want
