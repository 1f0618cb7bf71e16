"""The training-data pipeline: toxicity, near-duplicates, repeats, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run()
writes each stage's rows to the folder that the cluster shares and rereads them. All stages read and
return the columns of documents alone, whatever other ones there are; an empty table gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import mixing, packing, repeats, shingles, toxicity
from lectern.llm.common import keep, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.7; learned from the labels of these documents.

    Each row is judged by its own whole text; null and empty texts stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(COLUMNS), model, threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of five-word shingles of 0.8 or more the smallest doc_id.

    Rows are chosen, not ids: rows of one doc_id with different texts stay, whole copies of a row go.
    Texts without words, null ones too, are one group.
    """
    return shingles.one_per_group(docs.select(COLUMNS), words=5, most=4, least=0.8)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated strings of 200 bytes cover.

    A cut inside a character takes the whole character; a text that is all repeats stays as an
    empty one, as does a null text.
    """
    cut = repeats.remove_repeats(docs, depth=200, carry=("lang", "source"), texts=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it, 0 to 3 times; one without words isn't taken or left by size."""
    return mixing.repeat_documents(docs.select(COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens; a document that was taken again has its pieces again."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cap=4096, end_id=1, with_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dups", drop_near_duplicates),
    ("suffix_repeats", drop_repeats),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: No SQL expresses the classifier and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
