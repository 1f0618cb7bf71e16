"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets copies = target / source size on average. The whole part is certain, the
fractional parts are rounded in pairs: one of two documents takes as much of the other's
probability as it can, at random and without bias, until one of them is 0 or 1. Pairs are
formed inside small blocks of documents of like size, and what remains of each block meets in
the next level of a tree, so the words taken stay near the target and no task holds a source.
Everything is DataFrame expressions; the random numbers are hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import WORD, drop, keep, unit

#: Documents of a block and blocks of the next one, on average.
FAN_IN = 32
#: Copies of a row that a task writes out at a time.
CHUNK = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Adds weight and target to (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn. Targets share the sum of all
    sizes by weight; one over `most` times its source's size stops there and the excess goes
    to the others by weight. Capped sources are those of the smallest size / weight, so running
    sums over that order give the level at which nothing is left over.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sources.withColumn("weight", F.get(turn, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rising = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    total = F.sum(F.col("source_size")).over(W.partitionBy())
    capped_before = F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))
    level = (total - capped_before) / weight_left
    # the level rises while sources are capped and falls after the first that isn't
    levels = ranked.withColumn("level", level).withColumn("level", F.max("level").over(W.partitionBy()))
    return levels.withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight"))).select("source", "source_size", "weight", "target")


def _pivot(items: Column, seed: int) -> Column:
    """Folds an array of struct(unit, p) into struct(unit, p, outs): what remains and what is decided."""
    kind = "array<struct<unit:struct<id:bigint,size:bigint>,v:int>>"
    out = lambda unit_, v: F.struct(unit_.alias("unit"), F.lit(v).alias("v"))
    state = lambda unit_, p, outs: F.struct(unit_.alias("unit"), p.alias("p"), outs.alias("outs"))

    def step(a: Column, b: Column) -> Column:
        both = a["p"] + b["p"]
        draw = unit(F.lit(seed), a["unit"], b["unit"])
        merged = F.when(draw < b["p"] / F.greatest(both, F.lit(1e-300)), state(b["unit"], both, F.array_append(a["outs"], out(a["unit"], 0)))).otherwise(state(a["unit"], both, F.array_append(a["outs"], out(b["unit"], 0))))
        split = F.when(draw < (1 - b["p"]) / (2 - both), state(b["unit"], both - 1, F.array_append(a["outs"], out(a["unit"], 1)))).otherwise(state(a["unit"], both - 1, F.array_append(a["outs"], out(b["unit"], 1))))
        return F.when(a["unit"].isNull(), state(b["unit"], b["p"], a["outs"])).when(both < 1, merged).otherwise(split)

    start = state(F.lit(None).cast("struct<id:bigint,size:bigint>"), F.lit(0.0), F.array().cast(kind))
    return F.aggregate(items, start, step)


def plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, n, source_size, target, total): how often the mix takes the n rows of an id, source and size together.

    n rows ask for n * rate copies; the whole part is certain, and only the fraction, less than one
    document, is rounded in pairs. So rows that repeat are as near their share as any others.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    units = keep(sized.groupBy("id", "source", "size").agg(F.count("*").alias("n")), "mix-units")
    sources = source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rated = units.alias("u").join(sources.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source"))).select("u.*", "source_size", "target", (rate * F.col("n")).alias("share"))
    whole = F.when(F.abs(F.col("share") - F.round("share")) < 1e-9, F.round("share")).otherwise(F.floor("share")).cast("long")
    rated = keep(rated.withColumn("whole", whole).withColumn("p", F.greatest(F.col("share") - F.col("whole"), F.lit(0.0))), "mix-rated")
    drop(units)

    open_units = rated.where("p >= 1e-9").withColumn("band", F.floor(4 * F.log2(F.col("size") + 1)).cast("int"))
    bands = open_units.groupBy("source", "band").agg(F.ceil(F.count("*") / FAN_IN).alias("blocks"))
    item = F.struct(F.struct("id", "size").alias("unit"), "p")
    level = (
        open_units.alias("o")
        .join(bands.alias("b"), F.col("o.source").eqNullSafe(F.col("b.source")) & (F.col("o.band") == F.col("b.band")))
        .select("o.source", "o.band", F.pmod(F.xxhash64(F.lit(seed), "o.id", "o.size"), "blocks").alias("block"), item.alias("item"))
    )
    done = []
    while True:
        folded = level.groupBy("source", "band", "block").agg(_pivot(F.array_sort(F.collect_list("item")), seed).alias("state"))
        done.append(keep(folded, "mix-level"))
        if not done[-1].where("block > 0").limit(1).count():
            break
        level = done[-1].select("source", "band", F.floor(F.col("block") / FAN_IN).alias("block"), F.struct("state.unit", "state.p").alias("item"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("band", F.struct("state.unit", "state.p").alias("item")))), lambda x: x["item"])
    last = done[-1].groupBy("source").agg(_pivot(ordered, seed).alias("state"))
    decided = [t.select("source", F.explode("state.outs").alias("o")).select("source", "o.unit.id", "o.unit.size", "o.v") for t in (*done, last)]
    decided.append(last.select("source", "state.unit.id", "state.unit.size", (unit(F.lit(seed + 1), "state.unit") < F.col("state.p")).cast("int").alias("v")))
    extra = decided[0]
    for more in decided[1:]:
        extra = extra.unionByName(more)
    same = F.col("r.source").eqNullSafe(F.col("e.source")) & F.col("r.id").eqNullSafe(F.col("e.id")) & (F.col("r.size") == F.col("e.size"))
    total = F.col("whole") + F.coalesce("v", F.lit(0))
    return rated.alias("r").join(extra.alias("e"), same, "left").select("r.id", "r.source", "r.size", "n", F.col("source_size").cast("long").alias("source_size"), "target", total.alias("total"))


def _each(n: Column, place: str, df: DataFrame) -> DataFrame:
    """A row for each number from 0 to n - 1 in the column `place`, CHUNK numbers a row before they are dealt out and written out."""
    chunks = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / CHUNK))))
    many = chunks.where("_chunk > 0").repartition("_chunk")
    inside = F.sequence(F.col("_chunk") * CHUNK, F.least((F.col("_chunk") + 1) * CHUNK, n) - 1)
    return chunks.where("_chunk = 0").unionByName(many).withColumn(place, F.explode(inside)).drop("_chunk")


def _copies(place: Column) -> Column:
    """Copies of the row at a place among n rows that are taken `total` times: as even as can be, the first ones once more."""
    return (F.floor(F.col("total") / F.col("n")) + (place < F.col("total") % F.col("n")).cast("long")).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    size counts words (null text: 0); copies is 0 to `most`. Rows that repeat a document's id,
    source and size are rows of their own, whose copies differ by one at most. An empty table gives
    no rows; a source without words gets target 0 and no copies. A null id is a document like
    any other. Only these columns are read, whatever else the table has.
    """
    planned = plan(docs, weights, most, seed, id_col, text_col, source_col)
    each = _each(F.col("n"), "place", planned)
    return each.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", _copies(F.col("place")).alias("copies"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as plan() takes it, with all its columns, whatever their names.

    Rows that share id, source and size are numbered where they lie, each task's after those of the
    tasks before, and take their copies by number. A null text counts as empty, a text is one value
    however long, and an empty table gives none.
    """
    planned = plan(docs, **options).select("id", "source", "size", "n", "total")
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("own"), F.col("source").alias("of"), word_count(F.col("text")).alias("words"))
    taken = sized.join(planned, F.col("own").eqNullSafe(F.col("id")) & F.col("of").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))).where("total > 0")
    alone = taken.where("n = 1").select("row", F.col("total").cast("int").alias("copies"))
    several = keep(taken.where("n > 1").select("row", "id", "source", "size", "n", "total", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "mix-several")
    key = ["id", "source", "size"]
    parts = several.groupBy(*key, "part").agg(F.count("*").alias("own"))
    before = F.coalesce(F.sum("own").over(W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(*(F.col(c).alias(f"_{c}") for c in (*key, "part")), before.alias("before"))
    inside = several.withColumn("inside", F.row_number().over(W.partitionBy(*key, "part").orderBy("at")) - 1)
    placed = inside.join(starts, F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("part") == F.col("_part")))
    numbered = placed.select("row", _copies(F.col("before") + F.col("inside")).alias("copies"))
    return alone.unionByName(numbered).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
