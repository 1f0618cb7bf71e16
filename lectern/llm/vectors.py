"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors of cosine c are sqrt(2 - 2c) apart. A table's bucket is the tuple of
floor((a . v + b) / width) for Gaussian a and uniform b; near vectors share it in one of the
tables with a probability that the number of tables brings close to 1. Inside a bucket, blocks
of vectors meet as matrix products in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import components, keep, spanning, whole_groups

#: Width of the projections' steps, and projections of a table at least. Of pairs with a cosine of exactly `least` FOUND
#: are found, of closer ones more. STRANGERS: vectors at right angles that share a bucket, on average at most.
WIDTH, PROJECTIONS, FOUND, STRANGERS = 2.0, 12, 0.97, 64
#: Vectors of a block; a bucket of more is several blocks, whose pairs are work of their own.
BLOCK = 512


@lru_cache(8)
def _projections(dim: int, tables: int, projections: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    odd = rng.integers(0, 2**63, (tables, projections), dtype=np.int64) * 2 + 1
    return rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections), odd


def buckets(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """(n, tables) bucket numbers of unit vectors: a mix of each table's steps, the dimension and the table."""
    a, b, odd = _projections(unit.shape[1], tables, projections, width, seed)
    steps = np.floor((unit @ a + b) / width).astype(np.int64).reshape(len(unit), tables, projections)
    with np.errstate(over="ignore"):
        mixed = (steps * odd).sum(2) + np.arange(tables, dtype=np.int64) * np.int64(0x2545F4914F6CDD1D) + unit.shape[1]
        mixed ^= mixed >> np.int64(29)
        return mixed * np.int64(0x106689D45497FDB5)


def met_at(distance: float, width: float) -> float:
    """How often two vectors so far apart share a step of a projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(vectors: int, least: float, width: float = WIDTH) -> tuple[int, int]:
    """(tables, projections a table) for so many vectors.

    Projections grow with the logarithm of their number, so that a bucket's strangers don't grow
    with it, and tables with the projections, so that recall stays.
    """
    near, far = met_at(math.sqrt(max(2 - 2 * least, 1e-12)), width), met_at(math.sqrt(2), width)
    projections = max(PROJECTIONS, math.ceil(math.log(max(vectors / STRANGERS, 1)) / -math.log(far)))
    return max(1, math.ceil(math.log(1 - FOUND) / math.log1p(-(near**projections)))), projections


def _hashed(classes: DataFrame, tables: int, projections: int, width: float, seed: int) -> DataFrame:
    """Adds table buckets to (id, n, embedding) rows; vectors that link with nothing are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == dim)
                flat = values.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                v = flat.reshape(-1, dim)
                top = np.abs(v).max(1)
                fine = np.isfinite(top) & (top > 0)
                at, v = at[fine], v[fine] / top[fine, None]
                if len(at):
                    unit = v / np.sqrt((v * v).sum(1))[:, None]
                    rows = buckets(unit, tables, projections, width, seed)
                    yield pa.record_batch([pa.array(ids[at]), pa.array(n[at]), pa.array(list(unit), pa.list_(pa.float64())), pa.array(list(rows), pa.list_(pa.int64()))], ["id", "n", "unit", "buckets"])

    return classes.select("id", "n", "embedding").mapInArrow(run, "id long, n long, unit array<double>, buckets array<long>")


def _meet(rows: pa.Table, least: float) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Of whole groups (sorted by key): links to count (id, others) and edges that keep what they connect."""
    key, own, other = (rows.column(c).to_numpy() for c in ("key", "block", "side"))
    ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    counts, edges = [], []
    unit, bucket = rows.column("unit").combine_chunks(), rows.column("buckets").combine_chunks()
    table = rows.column("table").to_numpy()
    for lo, hi in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
        if hi - lo < 2:
            continue
        v = unit.slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1)
        s = bucket.slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1)
        left = np.arange(lo, hi) if own[lo] == other[lo] == -1 else None
        if left is not None:
            x = y = np.arange(hi - lo)
        else:
            first = own[lo:hi] == own[lo:hi].min()
            x, y = np.flatnonzero(first), np.flatnonzero(~first)
        if not len(x) or not len(y):
            continue
        near = v[x] @ v[y].T >= least
        if left is not None:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        if len(i):
            # a pair counts in the first table where it meets
            t = table[lo]
            new = ~(s[x[i], :t] == s[y[j], :t]).any(1)
            i, j = x[i[new]] + lo, y[j[new]] + lo
            if len(i):
                counts.append(np.stack([np.concatenate([ids[i], ids[j]]), np.concatenate([n[j], n[i]])]))
                edges += spanning(ids[i], ids[j])
    return counts, edges


def near_vectors(df: DataFrame, least: float = 0.95, width: float = WIDTH, seed: int = 6) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id, kept for every row of vec_id, embedding.

    Links are pairs of a cosine of at least `least` in double precision that share a bucket; none
    below it. Equal vectors are one class, so copies are counted, not paired; a bucket of many
    classes is split into blocks whose pairs are separate groups, and a group returns counts and
    a spanning forest, not its pairs. Null, empty, zero, or non-finite vectors (also those with a
    null component) link with nothing and are components of their own; vectors of different
    lengths never link. Rows that repeat a vec_id are vectors of their own with one component. An
    empty table gives no rows; only vec_id and embedding are read, whatever else there is.
    """
    every = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.col("embedding").isNull() | (F.size("embedding") == 0) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall("embedding", lambda x: x == 0)
    fine = every.where(~bad)
    classes = keep(fine.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-classes")
    tables, projections = plan_tables(classes.count(), least, width)
    hashed = keep(_hashed(classes.where("id IS NOT NULL"), tables, projections, width, seed), "vector-buckets")
    met = hashed.select("id", "n", "unit", "buckets", F.posexplode("buckets").alias("table", "bucket"))
    crowd = met.groupBy("table", "bucket").agg(F.count("*").alias("crowd")).where("crowd > 1")
    blocks = F.ceil(F.col("crowd") / BLOCK)
    one = met.join(crowd, ["table", "bucket"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    # alone (side -1: pairs within the block) and with each other block
    sides = F.concat(F.array(F.lit(-1).cast("long")), F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: b != F.col("block")))
    spread = one.withColumn("side", F.explode(sides))
    low, high = F.least("block", "side"), F.greatest("block", "side")
    spread = spread.withColumn("key", F.xxhash64("table", "bucket", low, high)).withColumn("block", F.when(F.col("side") == -1, -1).otherwise(F.col("block")))
    width_now = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.select("key", "block", "side", "table", "id", "n", "unit", "buckets").repartition(width_now, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "key"):
            counts, edges = _meet(rows, least)
            if counts:
                both = np.concatenate(counts, axis=1)
                who, at = np.unique(both[0], return_inverse=True)
                links = np.bincount(at, weights=both[1]).astype(np.int64)
                yield pa.record_batch([pa.array(who), pa.array(links), pa.nulls(len(who), pa.int64())], ["a", "links", "b"])
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(b, pa.int64())], ["a", "links", "b"])

    found = keep(dealt.mapInArrow(run, "a long, links long, b long"), "vector-links")
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    reached = components(found.where("b IS NOT NULL").select("a", "b"), "vector-edges")
    told = classes.join(links, classes.id == links.a, "left").join(reached, classes.id == reached.node, "left")
    told = told.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    rest = every.where(bad).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fine.join(told, "embedding").select("vec_id", "n_links", "component_id").unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
