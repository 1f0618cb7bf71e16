"""Near copies by the exact Jaccard similarity of shingle sets.

Candidates share a band of MinHash values, share a SimHash fingerprint, or have fingerprints a few
bits apart; each candidate pair is checked with the whole sets. Texts of one set are one node, so
copies take no part in the search.

In a bucket all nodes are first compared with its head, the node that shares most buckets with most
others. Then those that ended in another component than it are compared with all nodes of the bucket
in other components than theirs. Pairs within a component need no check, so the components are
those of all pairs of the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import components, drop, keep, spanning, whole_groups
from lectern.llm.simhash import SEGMENTS, first_row, links, of_hashes, shingle_hashes, staying, with_row

#: A pair of likeness 0.8 shares one of so many bands of so many values but for 1 in 2,800; of 0.85, 1 in 124,000.
BANDS, ROWS = 20, 5
#: Tasks that the pairs of one node are dealt to.
SALTS = 16
#: Shingles of a block's sets, about; columns of a matrix.
CELLS, COLUMNS = 250_000, 4096

_rng = np.random.default_rng(5)
_FLIP, _TIMES = _rng.integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
_TIMES |= np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of the smallest hashes under BANDS * ROWS mixings; none for no hashes."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        mixed = (hashes[None, at : at + 1024] ^ _FLIP[:, None]) * _TIMES[:, None]
        least = np.minimum(least, mixed.min(1))
    octets = least.astype("<u8").tobytes()
    keys = [xxhash.xxh64_intdigest(octets[i * ROWS * 8 : (i + 1) * ROWS * 8], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _bytes(text: pa.Scalar) -> bytes:
    return bytes(text.as_buffer()) if text.is_valid else b""


def signatures(own: DataFrame, words: int) -> DataFrame:
    """doc_id, _row, node (128 bits of the shingle set), its size, fingerprint and bands of every row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for t in batch.column(2):
                every = shingle_hashes(_bytes(t), words)
                own_set = np.unique(every)
                nodes.append(xxhash.xxh3_128_hexdigest(own_set.astype("<u8").tobytes()))
                sizes.append(len(own_set))
                prints.append(of_hashes(every))
                keys.append(bands(own_set))
            prints = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes, pa.string()), pa.array(sizes, pa.int64()), prints, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "_row", "node", "size", "fingerprint", "bands"])

    rows = own.select(F.col("doc_id").cast("long").alias("doc_id"), "_row", F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, _row string, node string, size long, fingerprint long, bands array<long>")


def sets_of(own: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the sorted distinct shingle hashes of the wanted (node, _row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.unique(shingle_hashes(_bytes(t), words)).astype("<u8").tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["node", "hashes"])

    texts = own.select("_row", F.col("text").alias("text")).join(wanted, "_row").dropDuplicates(["node"])
    return texts.select("node", "text").mapInArrow(run, "node string, hashes binary")


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            found = []
            for a, b, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                other = np.frombuffer(h.as_buffer(), "<u8")
                if not b:
                    mine = other.copy()
                    continue
                if min(len(mine), len(other)) < least * max(len(mine), len(other)) - 1e-9:
                    continue
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if both >= least * (len(mine) + len(other) - both) - 1e-9:
                    found.append((a, b))
            yield pa.record_batch([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["a", "b"])

    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = dealt.select("a", "salt").distinct().join(sets, F.col("a") == F.col("node")).select("a", "salt", F.lit("").alias("b"), "hashes")
    right = dealt.join(sets, F.col("b") == F.col("node")).select("a", "salt", "b", "hashes")
    return left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", "b").mapInArrow(run, "a string, b string")


def overlaps(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """How many hashes each of the chosen sets has in common with each set; those that one set alone has don't matter."""
    every = np.concatenate(sets)
    value, at, n = np.unique(every, return_inverse=True, return_counts=True)
    column = np.full(len(value), -1)
    shared = np.flatnonzero(n > 1)
    column[shared] = np.arange(len(shared))
    who, where = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), column[at]
    out = np.zeros((len(rows), len(sets)), np.float32)
    for low in range(0, len(shared), COLUMNS):
        here = (where >= low) & (where < low + COLUMNS)
        cells = np.zeros((len(sets), min(COLUMNS, len(shared) - low)), np.float32)
        cells[who[here], where[here] - low] = 1
        out += cells[rows] @ cells.T
    return out


def met_in_blocks(placed: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links that connect what the pairs of odd nodes with nodes of other components connect, bucket by bucket.

    placed: key, node, size, c (component), main (the head's). A bucket's nodes are dealt to blocks
    of some CELLS hashes; every two blocks are one group of work, so memory is bounded however large
    a bucket is, and a group returns a spanning forest of its links.
    """
    worth = placed.groupBy("key").agg(F.sum("size").alias("cells"), F.max(F.col("c") != F.col("main")).alias("any")).where("any")
    one = placed.join(worth, "key").withColumn("blocks", F.ceil(F.col("cells") / CELLS)).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    sides = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    spread = one.select("key", "node", "c", (F.col("c") != F.col("main")).alias("odd"), F.explode(sides).alias("side"))
    groups = spread.select(F.xxhash64("key", "side.i", "side.j").alias("work"), "node", "c", "odd").join(sets, "node").repartition("work").sortWithinPartitions("work")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "work"):
            work = rows.column("work").to_numpy()
            cuts = np.flatnonzero(np.append(True, work[1:] != work[:-1]))
            for low, high in zip(cuts, np.append(cuts[1:], len(work)), strict=True):
                own = rows.slice(low, high - low).combine_chunks()
                odd = np.flatnonzero(own.column("odd").to_numpy(zero_copy_only=False))
                if high - low < 2 or not len(odd):
                    continue
                hashes = [np.frombuffer(h.as_buffer(), "<u8") for h in own.column("hashes").combine_chunks()]
                size = np.array([len(h) for h in hashes])
                part = np.unique(own.column("c").to_pylist(), return_inverse=True)[1]
                both = overlaps(hashes, odd)
                near = (both >= least * (size[odd][:, None] + size[None] - both) - 1e-4) & (part[odd][:, None] != part[None])
                x, y = np.nonzero(near)
                if len(x):
                    names = own.column("node").to_pylist()
                    links = spanning(odd[x], y)
                    yield pa.record_batch([pa.array([names[p[i]] for p in links], pa.string()) for i in (0, 1)], ["a", "b"])

    return groups.select("work", "node", "c", "odd", "hashes").mapInArrow(run, "a string, b string")


def node_components(own: DataFrame, nodes: DataFrame, words: int, most: int, least: float, segments: tuple) -> DataFrame:
    """(node, component) of the nodes that have a near copy. nodes: node, first, size, fingerprint, bands."""
    keys = F.concat("bands", F.array(F.xxhash64(F.lit("fingerprint"), "fingerprint")))
    entries = nodes.where("size > 0").select("node", "size", F.explode(keys).alias("key"))
    crowded = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # a node has one row a band, so its window is small
    shared = F.sum("n").over(W.partitionBy("node"))
    members = keep(entries.join(crowded, "key").select("key", "node", "size", shared.alias("shared")), "near-members")
    heads = members.groupBy("key").agg(F.max(F.struct("shared", "node", "size")).alias("head")).select("key", F.col("head.node").alias("head"), F.col("head.size").alias("head_size"))
    prints = nodes.where("size > 0").groupBy("fingerprint").agg(F.min("node").alias("id"))
    close = keep(links(prints, most, segments).distinct(), "near-prints")
    wanted = members.select("node").unionByName(close.select(F.col("a").alias("node"))).unionByName(close.select(F.col("b").alias("node"))).distinct()
    sets = keep(sets_of(own, nodes.select("node", F.col("first._row").alias("_row")).join(wanted, "node", "left_semi"), words), "near-sets")

    like_sized = lambda x, y: F.least(x, y) >= F.lit(least - 1e-9) * F.greatest(x, y)
    to_head = members.join(heads, "key").where((F.col("node") != F.col("head")) & like_sized("size", "head_size")).select(F.col("head").alias("a"), F.col("node").alias("b"))
    found = keep(alike(to_head.unionByName(close.select("a", "b")).distinct(), sets, least), "near-edges")
    reached = components(found, "near-heads")
    placed = members.join(reached, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("c")).join(heads.select("key", "head"), "key")
    of_head = placed.where("node = head").select("key", F.col("c").alias("main"))
    placed = keep(placed.join(of_head, "key").select("key", "node", "size", "c", "main"), "near-placed")
    more = keep(met_in_blocks(placed, sets, least), "near-more")
    every = components(found.unionByName(more), "near-components")
    for done in (members, close, sets, placed):
        drop(done)
    return every


def one_per_group(docs: DataFrame, words: int = 5, most: int = 4, least: float = 0.8, segments: tuple = SEGMENTS) -> DataFrame:
    """Of each group of rows linked by near copies one: of the smallest doc_id, null last, then by all columns.

    Texts without words, null ones too, are one group. Texts of the same shingles have one fingerprint,
    the smallest of theirs, as repeats within a text count in it. Texts are read whole, however long;
    an empty table gives none.
    """
    own = with_row(docs)
    signed = signatures(own, words).groupBy("node").agg(first_row().alias("first"), F.first("size").alias("size"), F.min("fingerprint").alias("fingerprint"), F.first("bands").alias("bands"))
    nodes = keep(signed, "near-nodes")
    reached = node_components(own, nodes, words, most, least, segments)
    named = nodes.join(reached, "node", "left").select("first", F.coalesce("component", "node").alias("component"))
    return staying(own, named.groupBy("component").agg(F.min("first").alias("first")))
