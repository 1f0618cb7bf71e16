"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints at most r bits apart differ by at most
rho_i bits in some segment i whenever the radii satisfy sum(rho_i + 1) > r, so each fingerprint
looks up the Hamming ball of that radius around each of its segments in the segments' table and
verifies complete distances. Only distinct fingerprints take part; how many others are within r
bits of one is bounded by the ball, not by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import components, keep

BITS = 64
#: (lowest bit, bits, radius) of each segment: for 4 differing bits.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, words: int = 4) -> np.ndarray:
    """XXH64 hashes (seed 42) of a text's shingles in order, repeats too.

    A-Z count as a-z; a shingle is `words` words joined by one space; a text of fewer words is one
    shingle, one of none has none.
    """
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(tokens), np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    last = ends[words - 1 :].tolist() or [len(joined)]
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)], np.uint64)


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is on if it is on in over half of them; 0 of none."""
    octets = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    on = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _ONES for i in range(8)])
    return int(np.packbits((2 * on > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def simhash(text: bytes, words: int = 4) -> int:
    """A text's fingerprint."""
    return of_hashes(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4, carry: str | None = None) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row, and its string `carry` if asked for; null text is empty."""
    more = [carry] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([simhash(bytes(t.as_buffer()) if t.is_valid else b"", words) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(out.view(np.int64)), *batch.columns[2:]], ["doc_id", "fingerprint", *more])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *more)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fingerprint long", *(f"{c} string" for c in more)]))


def _segment(fingerprint: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << bits) - 1))


def links(prints: DataFrame, most: int = 4, segments: tuple = SEGMENTS) -> DataFrame:
    """Pairs (a, b) of ids whose fingerprints differ by at most `most` bits, each distinct pair at least once.

    prints: (id, fingerprint), fingerprints distinct. A pair whose segment differs by a mask is
    looked up from the side that has the mask's lowest bit off, so no lookup is made twice.
    """
    if sum(radius + 1 for *_, radius in segments) <= most:
        raise ValueError("these radii would miss links")
    key = lambda i, value: value.bitwiseOR(F.lit(i << 40))
    f = F.col("fingerprint")
    stored = F.array(*(key(i, _segment(f, low, bits)) for i, (low, bits, _) in enumerate(segments)))

    def probes(i: int, low: int, bits: int, radius: int) -> Column:
        masks = [sum(1 << b for b in c) for n in range(radius + 1) for c in combinations(range(bits), n)]
        value = _segment(f, low, bits)
        from_here = F.filter(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: value.bitwiseAND(m).bitwiseAND(-m) == 0)
        return F.transform(from_here, lambda m: F.struct(key(i, value.bitwiseXOR(m)).alias("key"), (m == 0).alias("same")))

    table = prints.select(F.col("id").alias("b"), F.col("fingerprint").alias("fb"), F.explode(stored).alias("key"))
    asked = prints.select(F.col("id").alias("a"), F.col("fingerprint").alias("fa"), F.explode(F.concat(*(probes(i, *s) for i, s in enumerate(segments)))).alias("p")).select("a", "fa", "p.key", "p.same")
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= most
    return asked.join(table, "key").where(near & (~F.col("same") | (F.col("fa") < F.col("fb")))).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4, segments: tuple = SEGMENTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links.

    Documents of equal fingerprints meet in an aggregation, so a group of copies of any size is
    one fingerprint in the search. Every row comes back, repeated ones too; an empty table gives
    none. A null doc_id never is a component unless all of its fingerprint's documents lack one.
    """
    every = keep(fingerprints(docs, words), "simhash")
    classes = keep(every.groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "simhash-classes")
    reached = components(links(classes.where("id IS NOT NULL"), most, segments), "simhash-edges")
    named = classes.join(reached, classes.id == reached.node, "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))
    return every.join(named, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def with_row(docs: DataFrame) -> DataFrame:
    """Adds _row: 128 bits of all columns, null apart from empty; rows that share them are whole copies."""
    parts = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    return docs.withColumn("_row", F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(i), *parts)), 16, "0") for i in (1, 2))))


def first_row() -> Column:
    """The row of a group that stays: the smallest doc_id, null last, then the smallest _row."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))


def staying(own: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows of `own` that the column `first` names, without _row; whole copies once."""
    stay = firsts.select(F.col("first._row").alias("_stay"))
    return own.join(stay, F.col("_row") == F.col("_stay"), "left_semi").dropDuplicates(["_row"]).drop("_row")


def one_per_group(docs: DataFrame, words: int = 4, most: int = 4, segments: tuple = SEGMENTS) -> DataFrame:
    """Of each component of linked fingerprints one row: of the smallest doc_id, null last, then by all columns.

    Rows are told apart by their columns, so rows that share a doc_id or have none go or stay by their own texts.
    """
    own = with_row(docs)
    every = fingerprints(own, words, carry="_row")
    classes = keep(every.groupBy("fingerprint").agg(first_row().alias("first")), "simhash-classes")
    reached = components(links(classes.select(F.col("fingerprint").alias("id"), "fingerprint"), most, segments), "simhash-edges")
    named = classes.join(reached, classes.fingerprint == reached.node, "left").select("first", F.coalesce("component", "fingerprint").alias("component"))
    return staying(own, named.groupBy("component").agg(F.min("first").alias("first")))
