"""The pipeline and its stages on hard rows."""

import random

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long, extra string"
rng = random.Random(4)


VOCABULARY = ["".join(rng.choice("abcdeghiknorst") for _ in range(rng.randrange(3, 9))) for _ in range(400)]


def words(n, seed):
    own = random.Random(seed)
    return " ".join(own.choice(VOCABULARY) for _ in range(n))


PASSAGE = words(60, 99)
#: Null, empty and very long texts, copies, near copies, a shared passage, rows without id or source, an id twice.
ROWS = [
    (1, words(120, 1), "en", "a"),
    (2, words(120, 1), "en", "a"),
    (3, words(120, 1).replace(" ", "  ", 3) + " end", "en", "b"),
    (4, None, "en", "a"),
    (5, "", None, "b"),
    (6, words(20_000, 6), "en", "b"),
    (7, words(30, 7) + " " + PASSAGE + " " + words(30, 8), "en", "a"),
    (8, words(50, 9) + " " + PASSAGE + " " + words(20, 10), "en", None),
    (None, words(40, 11), "en", "a"),
    (9, words(40, 12), "en", "a"),
    (9, words(40, 13), "en", "a"),
    (10, "short", "en", "c"),
]
ROWS += [(100 + i, words(50, 100 + i), "en", rng.choice("abc")) for i in range(60)]
ROWS += [(200 + i, words(30, 200 + i) + " idiot moron idiot", "en", "a") for i in range(20)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('sf')}"
    rows = [(i, t, lang, s, len(t) if t else 0, "x") for i, t, lang, s in ROWS]
    spark.createDataFrame(rows, KIND).write.parquet(f"{out}/documents.parquet")
    labels = [(i, 1, int(i >= 200)) for i, *_ in ROWS if i and i >= 100]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{out}/labels.parquet")
    return out


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_toxic_documents_go_and_others_stay(spark, folder):
    docs = read(spark, folder)
    kept = pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == pipeline.COLUMNS
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(str(i) for i, *_ in ROWS if i is None or i < 200)
    assert pipeline.drop_toxic(spark, docs.limit(0), folder).count() == 0


def test_of_near_copies_one_stays(spark, folder):
    docs = read(spark, folder).where("doc_id IS NULL OR doc_id < 100")
    kept = pipeline.drop_near_duplicates(spark, docs.unionByName(docs), folder)
    assert kept.columns == pipeline.COLUMNS
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(i), t or "") for i, t, *_ in ROWS if (i is None or i < 100) and i not in (2, 3, 5))
    assert pipeline.drop_near_duplicates(spark, docs.limit(0), folder).count() == 0


def test_repeats_go(spark, folder):
    docs = read(spark, folder).where("doc_id IN (4, 5, 6, 7, 8)")
    out = pipeline.drop_repeats(spark, docs, folder)
    assert out.columns == pipeline.COLUMNS
    got = {r.doc_id: r for r in out.collect()}
    assert PASSAGE in ROWS[6][1] and PASSAGE not in got[7].text and PASSAGE not in got[8].text
    assert got[7].text.startswith(words(30, 7)) and got[6].text == ROWS[5][1] and got[4].text == got[5].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert pipeline.drop_repeats(spark, docs.limit(0), folder).count() == 0


def test_mix_takes_whole_rows(spark, folder):
    docs = read(spark, folder).where("doc_id IS NULL OR doc_id < 200").withColumn("_size", F.lit("keep"))
    out = pipeline.mix_sources(spark, docs, folder)
    assert out.columns == pipeline.COLUMNS
    known = {(str(i), t, s) for i, t, _, s in ROWS}
    taken = [(str(r.doc_id), r.text, r.source) for r in out.collect()]
    assert set(taken) <= known and max(taken.count(x) for x in set(taken)) <= 3
    assert pipeline.mix_sources(spark, docs.limit(0), folder).count() == 0


def test_copies_are_packed_each(spark, folder):
    docs = read(spark, folder).where("doc_id IN (4, 6, 9)")
    out = pipeline.pack_sequences(spark, docs.unionByName(docs), folder).collect()
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, len(tokens.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in ROWS if i in (4, 6, 9))
    assert sorted((r.doc_id, r.length) for r in out if r.doc_id != 6) == sorted(2 * [x for x in want if x[0] != 6])
    assert sum(r.length for r in out) == 2 * sum(n for _, n in want)
    assert pipeline.pack_sequences(spark, docs.limit(0), folder).count() == 0


def test_whole_run(spark, folder):
    rows = pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert rows and not {2, 3} & ids and not [i for i in ids if i and i >= 200]
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "simhash_near_dups", "suffix_repeats", "mix_sources", "pack_sequences"]


def test_what_cannot_weigh_does_not():
    """A token that is passed over has no reading that weighs anything."""
    chars = toxicity.CharModel({})
    chars.table = np.random.default_rng(1).normal(size=(29, 29, 29)).tolist()
    restore = toxicity.Restorer(chars)
    lexicon = toxicity.Lexicon({"^idiot$": 3.0, "^scum": 2.0, "^los": 1.5, "^ass$": 2.5}, restore)
    own, marks = random.Random(3), "idotscumlase10!$@|+.-i57"
    for _ in range(4000):
        token = "".join(own.choice(marks) for _ in range(own.randrange(1, 9)))
        read = {token, restore.token(token)}
        weight = max((lexicon.weights.get(g, 0.0) for w in read for g in toxicity.grams(w.strip(toxicity._EDGE))), default=0.0)
        assert lexicon.weight(token) == weight, (token, read)


def test_lookalikes_of_other_alphabets_and_unseen_characters(spark):
    docs = spark.createDataFrame([("you idiot and moron are here for the day",)], "text string")
    restore = toxicity.Restorer(toxicity.CharModel({r["gram"]: r["n"] for r in toxicity.char_counts(docs).collect()}))
    assert restore.tokens("idi\u200bot ｉｄｉｏｔ") == {"idiot"}
    assert restore.token("idi\u043et") == "idiot" and restore("m\u043er\u043en") == "moron"
