"""Labelled rows for the classifiers: the held-out rule and bounded samples to fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of rows that may be learned from; null labels are left out, of several the largest counts."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("label IS NOT NULL AND doc_id IS NOT NULL")
    return own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """(doc_id, label, text) of at most `rows` labelled documents, whole texts.

    The documents are those of the smallest hashed ids, so reruns agree. Broadcast: their ids, at
    most `rows`; only their texts are moved.
    """
    ids = labels.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")
