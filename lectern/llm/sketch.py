"""Document fingerprints as threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of all hashes, so the sketches of two
texts of very unequal length are samples at the same rate: their overlap estimates containment,
and the sketch of a union is the union of sketches. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, keep

#: Words of a shingle, and one in how many hashes is kept.
WORDS, SCALE = 5, 2


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """XXH64 over the words of each shingle; a text of fewer words is one shingle, one of none has none."""
    parts = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")

    def hashes(w: Column) -> Column:
        long_enough = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words))))
        return F.when(F.size(w) >= words, long_enough).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    # the one-element array names the list of words, which would else be split again for each use
    return F.flatten(F.transform(F.array(parts), hashes))


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """Sorted distinct hashes below 1 / scale of their range; null text is empty.

    An empty sketch says that no hash was low enough: a text without words has it always, one of n
    shingles once in (scale / (scale - 1)) ** n. Hashes count as unsigned: the kept ones are those
    whose top bits are 0.
    """
    low = F.filter(shingle_hashes(F.coalesce(text, F.lit("")), words), lambda h: (h >= 0) & (h <= ((1 << 64) - 1) // scale))
    return F.array_sort(F.array_distinct(low))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; two empty sketches count as alike (1), an empty and another as unlike (0)."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(s: Column) -> Column:
    """A sketch as hex digits: 16 a hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


#: Rows of a part of the order of ids, ranges between quantiles, and the most parts there are.
PART_ROWS, RANGES, MOST_PARTS = 1000, 256, 1 << 20


def _parts(ids: DataFrame) -> tuple[Column, list[int]]:
    """A part number for the column doc_id that rises with it, and the ids that hold several ranges of rows.

    Ids fall into ranges between approximate quantiles and, within one, into slots of equal width,
    so that a part has some PART_ROWS rows if the ids in a range lie evenly.
    """
    n, low, high = ids.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    wanted = min(MOST_PARTS, -(-n // PART_ROWS) or 1)
    ranges = min(RANGES, wanted)
    bounds = ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.001) if n and ranges > 1 else []
    ends = [float(low or 0), *sorted(set(bounds)), float(high or 0)]
    slots, at = -(-wanted // ranges), F.col("doc_id").cast("double")
    steps = F.array(*map(F.lit, ends))
    number = F.size(F.filter(F.array(*map(F.lit, ends[1:-1])).cast("array<double>"), lambda b: b <= at))
    start, width = F.get(steps, number), F.get(steps, number + 1) - F.get(steps, number)
    slot = F.least(F.lit(slots - 1), F.floor(F.when(width > 0, (at - start) / width * slots).otherwise(0.0)))
    return (number * slots + slot).cast("long"), [int(b) for b in set(bounds) if bounds.count(b) > 1]


def _next_payload(rows: DataFrame) -> DataFrame:
    """Adds n (text and sketch of the next document) to rows of doc_id, text, part, which is a window's work.

    The rows of a part and those of the next smaller id meet; only where one part ends and the next
    begins is a row in two parts (broadcast: the ids of these, at most MOST_PARTS).
    """
    tops = rows.groupBy("part").agg(F.max("doc_id").alias("top"))
    order = W.orderBy("part")
    above = tops.select("top", F.lead("part").over(order).alias("above"), F.min("part").over(W.partitionBy()).alias("lowest"))
    guests = F.broadcast(above.select("top", F.coalesce("above", "lowest").alias("above")))
    place = lambda part, guest: F.struct(part.alias("part"), F.lit(guest).alias("guest"))
    placed = rows.join(guests, F.col("doc_id") == F.col("top"), "left").select("doc_id", "text", "lent", F.explode(F.array_compact(F.array(place(F.col("part"), False), F.when(F.col("above").isNotNull(), place(F.col("above"), True))))).alias("p"))
    sketched = placed.select("doc_id", "text", "lent", "p.*").repartition("part").withColumn("sketch", sketch(F.col("text")))
    # guests first: they have the largest of the smaller ids, for the smallest ids the largest of all
    w = W.partitionBy("part").orderBy(F.col("guest").desc(), "doc_id", "text")
    named = F.struct("doc_id", "guest")
    opens = sketched.withColumn("opens", F.lag(named).over(w).isNull() | (F.lag(named).over(w) != named))
    before = F.last(F.when(F.col("opens"), F.struct("text", "sketch")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    own = F.last(F.when(F.col("opens"), F.col("before")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return opens.withColumn("before", before).withColumn("n", own).where("NOT guest").select("doc_id", "text", "lent", "sketch", "n")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch of each row, its edited text, and the next document's sketch.

    The edited text has its last floor(n / 3) code points replaced by the first as many (or all)
    of the next document's by descending doc_id. Of rows that repeat a doc_id, the next document
    is the one of the smallest text; each repeated row comes back. Rows without doc_id have no
    next document and no place in the order: theirs is empty. Other columns, whatever their names,
    aren't read; an empty table gives no rows.

    Each text is shuffled once, with its neighbours in the order of ids. An id that holds a good
    share of all rows lends one row to the order and joins what that finds.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    there = named.where("doc_id IS NOT NULL")
    part, crowded = _parts(there.select("doc_id"))
    found = ["doc_id", "text", "sketch", "n"]
    if crowded:
        hot = F.col("doc_id").isin(crowded)
        one = there.where(hot).groupBy("doc_id").agg(F.min("text").alias("text"))
        ordered = _next_payload(there.where(~hot).withColumn("lent", F.lit(False)).unionByName(one.withColumn("lent", F.lit(True))).withColumn("part", part))
        told = keep(ordered.where("lent").select(F.col("doc_id").alias("id"), "n"), "sketch-lent")
        own = there.where(hot).join(told, F.col("doc_id") == F.col("id")).withColumn("sketch", sketch(F.col("text")))
        paired = ordered.where("NOT lent").select(found).unionByName(own.select(found))
    else:
        paired = _next_payload(there.withColumn("lent", F.lit(False)).withColumn("part", part)).select(found)
    lone = named.where("doc_id IS NULL").select("*", sketch(F.col("text")).alias("sketch"), F.struct(F.lit("").alias("text"), F.array().cast("array<bigint>").alias("sketch")).alias("n"))
    kept_part = F.expr("left(text, length(text) - int(floor(length(text) / 3)))")
    new_part = F.expr("left(n.text, int(floor(length(text) / 3)))")
    return paired.unionByName(lone).select("doc_id", "text", "sketch", F.concat(kept_part, new_part).alias("edited"), F.col("n.sketch").alias("next_sketch"))
