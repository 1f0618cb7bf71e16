import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import labelled, quality, repeats, toxicity, vectors
from lectern.llm.queries import op3_toxicity, op4_suffix_repeats, op6_embedding_near_dups, op9_quality

SF = "/root/testdata/sf0.01"
held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1


def accuracy(spark, query, column):
    rows = {r.doc_id: r for r in query(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in rows.values())
    labels = [(r.doc_id, r[column]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    return [(rows[i].predicted, y) for i, y in labels if held(i)]


def test_op9_held_out(spark):
    got = accuracy(spark, op9_quality, "quality")
    assert sum(p == y for p, y in got) >= 0.97 * len(got)


def test_op3_held_out(spark):
    got = accuracy(spark, op3_toxicity, "toxic")
    assert sum(p > y for p, y in got) <= 0.02 * len(got)
    # most of what is missed has no word that tells it from other texts
    assert sum(p and y for p, y in got) >= 0.75 * sum(y for _, y in got)


@pytest.fixture(scope="module")
def char_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return toxicity.CharModel({r["gram"]: r["n"] for r in toxicity.char_counts(docs).collect()})


def test_char_counts_cover_all_texts(spark):
    df = spark.createDataFrame([("ab",), ("",), (None,), ("é1",)], "text string")
    got = {r["gram"]: r["n"] for r in toxicity.char_counts(df).collect()}
    n = toxicity.CLASSES
    assert got == {(0 * n + 1) * n + 2: 1, (1 * n + 2) * n + 0: 1, (0 * n + 27) * n + 27: 1, (27 * n + 27) * n + 28: 1, (27 * n + 28) * n: 1}


def slow_decode(token, model, spaced):
    best = (-1e99, "")

    def walk(units, text, score):
        nonlocal best
        if not units:
            a = b = 0
            for c in map(model.of, text):
                score += model.table[a][b][c]
                a, b = b, c
            best = max(best, (score + model.table[a][b][0], text))
            return
        for option, p in units[0]:
            walk(units[1:], text + option, score + p)

    walk(toxicity.lattice(token, spaced), "", 0.0)
    return best


@pytest.mark.parametrize("token,spaced", [("1d10t", False), ("st00pid", False), ("aaab4!", False), ("l0llll", False), ("i.d.i.o.t", True), ("m o r o n", True)])
def test_viterbi_finds_the_best_path(char_model, token, spaced):
    score, _ = slow_decode(token, char_model, spaced)
    a = b = 0
    found = toxicity.decode(token, char_model, spaced)
    assert found == slow_decode(token, char_model, spaced)[1] or score == pytest.approx(score)


def test_restoring(char_model):
    restore = toxicity.Restorer(char_model)
    assert restore("You 1d10t, m o r o n!\n  plain text 2024") == "you idiot, moron!\n  plain text 2024"
    assert restore("") == "" and restore("clean words only.") == "clean words only."
    assert any("moron" in t for t in restore.tokens("a m o r o n b."))


#: A word for each look-alike at its start, middle and end.
@pytest.mark.parametrize("mark", sorted(toxicity.LOOKALIKES))
def test_every_lookalike_is_read(char_model, mark):
    restore = toxicity.Restorer(char_model)
    letter = toxicity.LOOKALIKES[mark][0]
    for word in (f"{letter}nder", f"su{letter}er", f"hous{letter}"):
        token = word.replace(letter, mark, 1)
        assert restore.token(token) == toxicity.decode(token, char_model)
        assert toxicity._TOKEN_CUE.search(token)


def test_cues_cover_short_words_and_doubled_letters(char_model):
    for token in ("idi07", "cun7", "sh17", "sh!7", "ki11", "ki!!", "dumb455", "a55", "a$$", "@$$", "idioot", "a.s.s", "a.s-s"):
        assert toxicity._TOKEN_CUE.search(token), token
    restore = toxicity.Restorer(char_model)
    assert {"".join(x) for x in [toxicity.lattice("idioot", False)[3][1][0]]} == {"o"}
    assert restore("m  o  r  o  n") == "moron" and restore("m.o-r.o n") == "moron"
    assert restore("idi07 idioot") == "idiot idiot"
    lexicon = toxicity.Lexicon({"^idiot$": 3.0, "^letter$": 2.0}, restore)
    assert lexicon.weight("idi07") == 3.0 and lexicon.weight("letter") == 2.0


def test_obfuscated_words_score_like_plain_ones(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    word = max((w for w in model.lexicon.weights if w.endswith("$")), key=model.lexicon.weights.get).strip("^$")
    plain, spaced = f"the {word} of {word} and {word}", f"the {' '.join(word)} of {word} and {word}"
    assert model.score(spaced) == pytest.approx(model.score(plain), abs=0.2)


def test_classifier_edge_cases(spark):
    kind = "doc_id long, text string, score string, label int"
    docs = spark.createDataFrame([(1, None, "", 0), (2, "", "", 0), (3, "a " * 100_000, "", 0), (3, "a", "", 0), (None, "x", "", 0)], kind)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    odd = spark.createDataFrame([(1, None, None), (2, 0, 1), (2, 0, 1), (3, 1, 0), (3, 0, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for labels in (none, odd):
        for module in (toxicity, quality):
            out = module.score(docs, module.fit(docs, labels)).collect()
            assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
            assert module.score(docs.limit(0), module.fit(docs.limit(0), labels)).count() == 0
    assert not [r for r in labelled.learnable(spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, toxic int"), "toxic").collect() if held(r.doc_id)]
    kept = toxicity.keep_clean(docs, toxicity.fit(docs, none))
    assert kept.columns == docs.columns and kept.count() == 5


def test_hinge_loss_is_minimised():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(64, 90, 6)) for _ in range(60)]
    y = np.where([75 in r or 80 in r for r in rows], 1, -1)
    r = np.ones(quality.WIDTH)
    w = quality.hinge_dual(rows, y, r, c=0.5, epochs=300)
    loss = lambda v: v @ v / 2 + 0.5 * sum(max(0, 1 - t * v[x].sum()) for x, t in zip(rows, y, strict=True))
    base = loss(w)
    for _ in range(100):
        step = np.zeros(quality.WIDTH)
        step[64:90] = rng.normal(0, 0.05, 26)
        assert loss(w + step) >= base - 1e-6


def slow_repeats(texts, depth):
    seen = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if seen[t[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_op4(spark, sf_dir):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {d: w for (d, _), w in zip(docs, slow_repeats([t for _, t in docs], 200), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op4_suffix_repeats(spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("depth", [100, 200])
@pytest.mark.parametrize("spread", [None, repeats._spread.__defaults__[0], lambda data: data[0] % 2])
def test_repeats_edge_cases(spark, monkeypatch, depth, spread):
    random.seed(depth)
    letters = lambda n: "".join(random.choice("abcdefgé ") for _ in range(n))
    pool = [letters(random.randint(60, 400)) for _ in range(5)] + ["z" * 300, "xy " * 150]
    texts = ["".join(random.choice([*pool, letters(40)]) for _ in range(random.randint(0, 6))) for _ in range(40)]
    texts += [None, "", "short", texts[0], letters(depth - 1), pool[0] * 40]
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)] + [(0, texts[0], 0, "x"), (None, pool[1], 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int, h string")
    if spread:
        monkeypatch.setattr(repeats, "_resolved", lambda classes, d, width: repeats._spread(classes, d, spread))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in repeats.remove_repeats(df, depth).collect())
    want = slow_repeats([(t or "").encode() for _, t, *_ in rows], depth)
    assert got == sorted((-1 if r[0] is None else r[0], *w) for r, w in zip(rows, want, strict=True))
    assert repeats.remove_repeats(df.limit(0), depth).count() == 0


def test_colliding_digests_are_told_apart(monkeypatch):
    random.seed(1)
    middle = bytes(random.choices(b"ab", k=50))
    before, after = ([bytes(random.choices(b"xy", k=50)) for _ in range(4)] for _ in range(2))
    reaches = [random.randrange(51) for _ in range(60)]
    texts = [random.choice(before)[50 - r :] + middle + random.choice(after)[: random.randrange(51)] for r in reaches]
    numbers = [str(i).encode() for i in range(60)]
    rows = pa.table({"h": pa.array([7] * 60, pa.int64()), "context": numbers, "n": pa.array([1] * 60, pa.int64()), "reach": pa.array(reaches, pa.int32()), "bytes": texts})
    windows = [[(r - i, t[i : i + 100]) for i in range(min(r, len(t) - 100) + 1)] for r, t in zip(reaches, texts, strict=True)]
    seen = Counter(w for own in windows for w in own)
    again = [[back for back, text in own if seen[back, text] > 1] for own in windows]
    want = [(i, max(b), 100 - min(b)) for i, b in enumerate(again) if b]
    assert 0 < len(want) < 60
    for mixed in (repeats._mixed, lambda h: h & np.uint64(1)):
        monkeypatch.setattr(repeats, "_mixed", mixed)
        at, back, ahead, _ = repeats.covered(rows, 100)
        assert list(zip(at.tolist(), back.tolist(), ahead.tolist(), strict=True)) == want


def slow_vectors(rows, least=0.95):
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            scaled = np.array(v, float) / np.abs(v).max()  # else squares over- or underflow
            unit[k] = scaled / np.linalg.norm(scaled)
    linked = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        root[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[find(k)] = min(smallest.get(find(k), i), i)
    n = Counter(k for pair in linked for k in pair)
    return sorted((i, n[k], smallest[find(k)]) for k, (i, _) in enumerate(rows))


def test_long_labelled_texts_are_learned_from(spark):
    """A text of any length is in the sample."""
    docs = spark.createDataFrame([(i, ("awful " if i % 2 else "kind ") * 20_000) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)], "doc_id long, toxic int, quality int")
    for module, column in ((toxicity, "toxic"), (quality, "quality")):
        told = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, labels)).collect()}
        assert all((told[i] > 0.5) == bool(i % 2 if column == "toxic" else 1 - i % 2) for i in range(60))


def test_tables_grow_with_the_vectors():
    """Strangers in a bucket stay few and near pairs are found, however many vectors there are."""
    far, near = vectors.met_at(2**0.5, vectors.WIDTH), vectors.met_at(0.1**0.5, vectors.WIDTH)
    for n in (10, 10**4, 10**6, 10**8, 10**10):
        tables, projections = vectors.plan_tables(n, 0.95)
        assert n * far**projections <= vectors.STRANGERS and 1 - (1 - near**projections) ** tables >= 0.97


@pytest.mark.parametrize("block", [vectors.BLOCK, 7])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + rng.standard_normal(16) * 0.12 * (i % 4)).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[0][1]) for i in range(5)] + [(1010, [x * 3 for x in rows[0][1]]), (1011, [-x for x in rows[0][1]])]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None, *[1.0] * 15]), (2005, [float("inf"), *[1.0] * 15]), (2006, [1.0, 0.0]), (2007, [1.0, 0.01]), (2008, [1e200] * 16), (2009, [1e-300] * 16)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, n_links int, label string")
    got = vectors.near_vectors(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    found, want = [{r[0]: r for r in x} for x in (sorted((r.vec_id, r.n_links, r.component_id) for r in got), slow_vectors(rows))]
    assert found.keys() == want.keys()
    assert all(found[i][1] <= want[i][1] for i in want)
    assert sum(r[1] for r in found.values()) >= 0.97 * sum(r[1] for r in want.values())
    assert all(found[i] == want[i] for i in want if i >= 2000)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_op6(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = {r[0]: r for r in slow_vectors(rows)}
    got = {r.vec_id: (r.vec_id, r.n_links, r.component_id) for r in op6_embedding_near_dups(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(got[i][1] <= want[i][1] for i in want)
    assert sum(r[1] for r in got.values()) >= 0.95 * sum(r[1] for r in want.values())
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_vector_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1500):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9505, 0.96)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.agg(F.sum("n_links")).first()[0] >= 0.93 * 2 * 1500
