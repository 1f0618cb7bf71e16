import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import packing, simhash, sketch
from lectern.llm.common import components
from lectern.llm.queries import op2_simhash_near_dups, op5_pack_sequences, op7_document_fingerprints

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def slow_simhash(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def check_simhash(texts, rows):
    prints = {i: slow_simhash(t or "") for i, t in texts.items()}
    ids = sorted(texts)
    linked = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = smallest_reachable(ids, linked)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_op2(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_simhash(texts, op2_simhash_near_dups(spark, sf_dir).collect())


def test_simhash_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = {1: None, 2: "", 3: " \t\n", 4: "one", 5: "ONE", 6: "a b c d", 7: "A  B\x0bC d", 8: base, 9: base.replace("w200", "x"), 10: "é Ä \xa0 b", 11: "z " * 60_000}
    df = spark.createDataFrame([(k, v, "x", 0) for k, v in texts.items()], "doc_id long, text string, fingerprint string, component_id int")
    check_simhash(texts, simhash.near_duplicates(df).collect())
    again = simhash.near_duplicates(df.unionByName(df).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    assert again.count() == 23
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.one_per_group(df.unionByName(df)).count() == len({r.component_id for r in again.where("doc_id IS NOT NULL").collect()})


def test_one_per_group_goes_by_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(None, a), (None, b), (None, b), (1, a), (2, c), (2, "other words"), (3, c), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text or "") for r in simhash.one_per_group(df).collect()), key=str)
    assert got == sorted([(1, a), (None, b), (2, c), (2, "other words"), (None, "")], key=str)


def test_links_find_every_pair(spark):
    rng = np.random.default_rng(1)
    values = set()
    for c in rng.integers(0, 2**63, 20):
        for _ in range(30):
            v = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                v ^= 1 << int(b)
            values.add(v - (1 << 64) if v >> 63 else v)
    values = sorted(values)
    df = spark.createDataFrame(list(enumerate(values)), "id long, fingerprint long")
    got = Counter(tuple(sorted((r.a, r.b))) for r in simhash.links(df).distinct().collect())
    want = {(i, j) for j, a in enumerate(values) for i, b in enumerate(values[:j]) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert got.keys() == want
    with pytest.raises(ValueError):
        simhash.links(df, 5)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(3, 3), (60, 7), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 61)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def check_packing(texts, rows, cap=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), cap)):
            own = ids[at : at + cap]
            want.append((i, n, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // cap) * 1.03 + 1


def test_op5(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_packing(texts, op5_pack_sequences(spark, sf_dir).collect())


def test_packing_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "<|endoftext|> a"), (4, "It's İ ΣAS a\x1cb é ²½ x ﬁ 你好 \U0001f600"), (5, "ab " * 9000), (6, "a\x1d b"), (7, "same"), (7, "same"), (None, "n")]
    df = spark.createDataFrame([(*t, 0, 0) for t in texts], "doc_id long, text string, length int, offset int")
    check_packing(texts, packing.pack(df, TOKENIZER).collect())
    with_ids = packing.pack(df, TOKENIZER).collect()
    assert all(zlib.crc32(np.array(r.ids, "<i4").tobytes()) == r.ids_crc32 for r in with_ids)
    assert packing.pack(df.limit(0), TOKENIZER).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=8))
def test_plan_uses_every_length_and_fullest_is_optimal(counts):
    plan = packing.plan_bins(counts, 40)
    used = Counter()
    for times, take in plan:
        assert sum(k * n for k, n in take.items()) <= 40
        for k, n in take.items():
            used[k] += n * times
    assert used == Counter(counts)
    sums = {0}
    for k, n in counts.items():
        sums |= {s + k * j for s in sums for j in range(n + 1)}
    take = packing.fullest(sorted(counts.items(), reverse=True), 40)
    assert sum(k * n for k, n in take.items()) == max(s for s in sums if s <= 40)
    assert all(n <= counts[k] for k, n in take.items())



def test_op7(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_op7(docs, op7_document_fingerprints(spark, sf_dir).collect())


def shingles(text, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def low_hashes(of):
    """Hashes of shingles below the threshold: each word's XXH64 is the next word's seed."""
    out = set()
    for s in of:
        h = 42
        for w in s:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h)
    return sorted(h for h in out if h < (1 << 64) // sketch.SCALE)


def check_op7(docs, rows):
    ids = sorted(docs, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    prints = {}
    for r in rows:
        text, nxt = docs[r.doc_id], docs[after[r.doc_id]]
        k = len(text) // 3
        edited = text[: len(text) - k] + nxt[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        a, b = shingles(text), shingles(edited)
        if len(a | b) > 800:
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.2
        if a == b:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
        h = [int(r.fingerprint[i : i + 16], 16) for i in range(0, len(r.fingerprint), 16)]
        assert h == low_hashes(a)
        other = low_hashes(shingles(nxt))
        both = set(h) | set(other)
        assert r.near_next == pytest.approx(len(set(h) & set(other)) / len(both) if both else 1)


def test_sketch_edge_cases(spark):
    texts = {1: "", 2: "one", 3: "a b c d e f", 4: "x " * 80_000, 5: "\t\n", 6: " ".join(f"w{i}" for i in range(3000)), 9: "é ñ " * 10}
    kind = "doc_id long, text string, sketch string, head int"
    df = spark.createDataFrame([(k, v or None, "s", 0) for k, v in texts.items()], kind)
    row = lambda d: sketch.edited_pairs(d).withColumn("es", sketch.sketch(F.col("edited"))).select("doc_id", F.length("text").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), sketch.as_text(F.col("sketch")).alias("fingerprint"), sketch.as_text(F.col("es")).alias("edited_fingerprint"), sketch.likeness(F.col("sketch"), F.col("es")).alias("near_edited"), sketch.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
    check_op7(texts, row(df).collect())
    doubled = df.unionByName(df).unionByName(spark.createDataFrame([(None, "n", "", 0)], kind))
    assert sketch.edited_pairs(doubled).count() == 2 * len(texts) + 1
    assert sketch.edited_pairs(df.limit(0)).count() == 0
    # one id with most of the rows: its next document is 5's, and it is the next one of 7 with its smallest text
    crowd = spark.createDataFrame([(6, f"t{i:04d} a b c d e") for i in range(3000)] + [(5, "five " * 30), (7, "seven " * 30)], "doc_id long, text string")
    got = row(crowd).withColumn("edited_is", F.col("edited_sha256")).collect()
    after = {5: "seven " * 30, 6: "five " * 30, 7: "t0000 a b c d e"}
    sha = lambda t, n: hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()
    assert len(got) == 3002 and Counter(r.edited_sha256 for r in got) == Counter([sha(t, after[i]) for i, t in ((r.doc_id, r.text) for r in crowd.collect())])
    both = spark.createDataFrame([(" ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(896, 2000)), " ".join(f"w{i}" for i in range(2000)))], "a string, b string, c string")
    s = {c: sketch.sketch(F.col(c)) for c in both.columns}
    assert both.select(sketch.merge(s["a"], s["b"]) == s["c"]).first()[0]
    assert both.select(sketch.containment(s["a"], s["c"])).first()[0] == 1


def test_sketches_estimate_ordinary_documents(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(docs, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    off = []
    for r in op7_document_fingerprints(spark, sf_dir).collect():
        text, k = docs[r.doc_id], len(docs[r.doc_id]) // 3
        a, b = shingles(text), shingles(text[: len(text) - k] + docs[after[r.doc_id]][:k])
        off.append(abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)))
    print("mean", sum(off) / len(off), "over 0.3", sum(x > 0.3 for x in off), "of", len(off))
    assert sum(off) / len(off) < 0.07
