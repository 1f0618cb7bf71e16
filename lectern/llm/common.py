"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_own_folder: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, on one machine alone, a temporary folder stands in; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="lectern-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/lectern-{name}-{uuid.uuid4().hex}"


def _release(spark: SparkSession) -> None:
    """Spark removes the shuffle files of a step that is done when its plan is garbage in Python and, after that, in the JVM."""
    gc.collect()
    spark._jvm.System.gc()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and rereads it: cuts lineage, survives lost executors.

    Shuffle files of earlier steps are released first, so that they and this step's don't add up.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    _release(spark)
    df.write.parquet(path)
    _release(spark)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def drop(kept: DataFrame) -> None:
    """Removes the files behind a table that keep() wrote."""
    spark = kept.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(kept._kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def unit(*parts: Column | str) -> Column:
    """A repeatable number in [0, 1) drawn from a hash of the given columns."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroups batches that are sorted by the column `key` so that no key spans two tables.

    A group is only held together while it is read, so callers must have split hot keys before.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[0].column(key)[0].as_py() != keys[0]:
            yield pa.concat_tables(held)
            held = []
        rows = pa.Table.from_batches([batch])
        if len(cuts):
            yield pa.concat_tables([*held, rows.slice(0, int(cuts[-1]))])
            held = [rows.slice(int(cuts[-1]))]
        else:
            held.append(rows)
    if held:
        yield pa.concat_tables(held)


def meet(rows: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """rows joined with other, which has one row a key and in n how many rows have it at most; its n isn't carried.

    Keys of over one in 100,000 of all n, so at most 100,000 keys, are broadcast and their rows stay
    where they are; the rest is shuffled.
    """
    bound = max(1000, (other.agg(F.sum("n")).first()[0] or 0) // 100_000)
    often, few = other.where(F.col("n") > bound).drop("n"), other.where(F.col("n") <= bound).drop("n")
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(few, key)
    return rows.join(F.broadcast(often), key).unionByName(rest)


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join two parts of what the pairs before have joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


#: Edges that a task joins at a time.
EDGES = 500_000


def forest(edges: DataFrame, name: str) -> DataFrame:
    """Kept (a, b): edges as stars, from each node to the smallest one that it reaches in its task.

    Tasks take some EDGES kept edges each and start anew after as many nodes, so memory is bounded;
    what edges connect, stars connect.
    """
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        def stars(like: pa.RecordBatch) -> pa.RecordBatch:
            found = [(x, r) for x in list(root) if (r := find(x)) != x]
            root.clear()
            return pa.record_batch([pa.array([f[i] for f in found], like.column(i).type) for i in (0, 1)], ["a", "b"])

        batch = None
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            if len(root) > EDGES:
                yield stars(batch)
        if root:
            yield stars(batch)

    sized = edges.select("a", "b").coalesce(-(-edges.count() // EDGES) or 1)
    return keep(sized.mapInArrow(run, f"a {kind}, b {kind}"), name)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches.

    Edges become stars within tasks; then large-star and small-star steps and these alternate until
    each node has one smaller neighbour, its root, or none. Each round is three aggregations, written
    to the shared folder; two numbers a round come to the driver. A node's neighbours meet in one task only
    if they are few: those of a hub (over 256 and one in 100,000 of all ends, so at most 100,000
    hubs, which are broadcast) are relabelled where they are. Nodes without edges don't appear.
    Null ends and loops are ignored.
    """
    first = keep(edges.where("a <> b").select("a", "b"), name)
    now = forest(first, name)
    drop(first)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = keep(both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"), F.count("*").alias("n")), name)
        unsettled, ends = near.agg(F.count_if(F.expr("m < a AND most <> m")), F.sum("n")).first()
        if not unsettled:
            drop(now)
            return near.select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
        hubs = F.broadcast(near.where(F.col("n") > max(256, ends // 100_000)).select(F.col("a").alias("hub"), F.least("a", "m").alias("to")))
        dealt = both.join(hubs, F.col("a") == F.col("hub"), "left")
        of_hubs = dealt.where("hub IS NOT NULL AND b > a").select(F.col("b").alias("a"), F.col("to").alias("b"))
        few = dealt.where("hub IS NULL").groupBy("a").agg(F.collect_set("b").alias("b")).select("a", F.least("a", F.array_min("b")).alias("m"), F.explode("b").alias("b"))
        large = of_hubs.unionByName(few.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # from forest() a node has at most one smaller neighbour a task
        small = large.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("b"))
        linked = small.select(F.explode(F.concat(F.array(F.struct("a", F.col("b")[0].alias("b"))), F.transform(F.slice("b", 2, 1 << 30), lambda x: F.struct(x.alias("a"), F.col("b")[0].alias("b"))))).alias("e"))
        after = keep(linked.select("e.a", "e.b"), name)
        drop(now)
        drop(near)
        now = forest(after, name)
        drop(after)
