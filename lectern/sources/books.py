"""Books and their chapters from a documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import go_trim


def read_books(docs: DataFrame) -> DataFrame:
    """One row per chapter: book_id, chapter_no (from 1), title, content; a chapter is a line that isn't blank."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n+"), lambda x: go_trim(x) != "")
    chapters = docs.select(F.col("doc_id").alias("book_id"), F.col("lang").alias("language"), F.posexplode(lines).alias("at", "content"))
    return chapters.select("book_id", "language", (F.col("at") + 1).cast("long").alias("chapter_no"), F.concat(F.lit("Chapter "), (F.col("at") + 1).cast("string")).alias("title"), "content")
