"""Ranked lexical search over a length-stratified index.

Documents are grouped by their number of terms, so by the normaliser m that follows from it; the
postings of a stratum are lists of documents by term and tf. All documents of such a list get the
same impact from a term, so it is computed once. The sum of a stratum's largest impacts bounds what
any of its documents can score: strata are visited by falling bounds, and one whose bound is under
an item's k-th best score isn't visited for that item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import keep, whole_groups

#: A term is a maximal run of anything but ASCII that is neither a digit nor a letter.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms that a task holds before it writes a segment, documents of a part of a stratum, (item, term) rows of a block of
#: items, and terms or strata that are broadcast at most.
SEGMENT, PART, BLOCK, BROADCAST = 1_000_000, 2048, 1 << 17, 1 << 20
#: Stands for a null id inside tasks: nulls come first.
NONE = -(1 << 63)
INDEX = "term string, postings array<struct<n:bigint,tf:int,doc:bigint,place:bigint>>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Kept (term, postings): a segment's documents that hold a term, by their number of terms n, then by tf.

    A null term lists a segment's documents themselves. Each row of docs is a document, in one
    segment, named by a place of its own, so repeated rows and ids, null ones too, stay apart.
    Documents without terms, null texts too, aren't listed. A text is read whole, as one value; only
    the two columns are read, whatever else the table has. An empty table gives no rows.
    """
    lower = str.maketrans(UPPER, LOWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, first = re.compile(TERM), TaskContext.get().partitionId() << 36
        held: list[str] = []
        lengths: list[int] = []
        ids: list[int | None] = []

        def segment() -> pa.RecordBatch:
            coded = pa.array(held, pa.string()).dictionary_encode()
            names, n = coded.dictionary, np.array(lengths, np.int64)
            pairs, tf = np.unique(np.repeat(np.arange(len(n)), n) * len(names) + coded.indices.to_numpy(), return_counts=True)
            doc, term = np.divmod(pairs, len(names))
            order = np.lexsort((tf, n[doc], term))
            doc, term, tf = doc[order], term[order], tf[order]
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            # the documents themselves are listed behind the terms
            every = np.argsort(n, kind="stable")
            doc, tf = np.r_[doc, every], np.r_[tf, np.zeros(len(n), np.int64)]
            columns = [pa.array(n[doc]), pa.array(tf.astype(np.int32)), pa.array(ids, pa.int64()).take(pa.array(doc)), pa.array(first + doc)]
            listed = pa.StructArray.from_arrays(columns, ["n", "tf", "doc", "place"])
            offsets = pa.array(np.r_[starts, len(term), len(doc)].astype(np.int32))
            own = pa.concat_arrays([names.take(pa.array(term[starts])), pa.nulls(1, pa.string())])
            return pa.record_batch([own, pa.ListArray.from_arrays(offsets, listed)], ["term", "postings"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                said = text.as_py()
                found = terms.findall(said.lower() if said.isascii() else said.translate(lower)) if said else []
                if not found:
                    continue
                held += found
                lengths.append(len(found))
                ids.append(doc)
                if len(held) >= SEGMENT:
                    yield segment()
                    first += len(ids)
                    held, lengths, ids = [], [], []
        if held:
            yield segment()

    return keep(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX), "lexical-index")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), once each; rows that share an id are one item, and one without terms isn't there."""
    words = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))
    return items.select(F.col(id_col).alias("item_id"), F.explode(words).alias("term")).distinct()


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("long"), b.cast("long"))


def normaliser(n: Column, b: int, docs: int, terms: int) -> Column:
    return (F.lit(100 - b) + _div(n * (b * docs), F.lit(terms))).cast("long")


def impact(tf: Column, m: Column) -> Column:
    return _div(tf * 1_000_000_000, tf * 1000 + m * 8)


class _Top:
    """The k best (score, id) of each item so far, highest score first, then the smallest id."""

    def __init__(self, k: int, floors: np.ndarray):
        self.k, self.floors, self.best = k, floors.copy(), {}

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        near = np.flatnonzero((scores >= self.floors[item]) & (scores > 0))
        if not len(near):
            return
        if len(near) > self.k:
            least = np.partition(scores[near], len(near) - self.k)[len(near) - self.k]
            near = near[scores[near] >= least]
        own, names = scores[near], ids[near]
        if item in self.best:
            own, names = np.concatenate([self.best[item][0], own]), np.concatenate([self.best[item][1], names])
        order = np.lexsort((names, -own))[: self.k]
        self.best[item] = own[order], names[order]
        if len(order) == self.k:
            self.floors[item] = max(self.floors[item], own[order[-1]])


def _each(tables: Iterator[pa.Table], key: str) -> Iterator[pa.Table]:
    """The groups of tables that hold whole ones, one by one."""
    for t in tables:
        keys = t.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield t.slice(a, z - a)


def visit(postings: DataFrame, block: list[tuple], floors: dict, k: int, only: dict | None = None) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each item of a block among its strata.

    postings: (g, m, term, tf, doc, place), a part of a stratum by g, in the order of the visit.
    block: (item, term, weight); floors: a score that an item's best documents reach at least; only:
    the strata that are visited at all, by item.
    """
    numbers = {item: i for i, item in enumerate(sorted({b[0] for b in block}, key=lambda x: (x is not None, x)))}
    items = list(numbers)
    by_term: dict[str, list[tuple[int, int]]] = {}
    for item, term, weight in block:
        by_term.setdefault(term, []).append((numbers[item], weight))
    asks = {t: (np.array([x[0] for x in v]), np.array([x[1] for x in v], np.int64)) for t, v in by_term.items()}
    floor = np.array([floors.get(x, 0) for x in items], np.int64)
    strata: dict[int, np.ndarray] | None = None
    if only is not None:
        strata = {}
        for item, ms in only.items():
            for m in ms:
                strata.setdefault(m, np.zeros(len(items), bool))[numbers[item]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Top(k, floor)
        for part in _each(whole_groups(batches, "g"), "g"):
            m = part.column("m")[0].as_py()
            if strata is not None and m not in strata:
                continue
            coded = part.column("term").combine_chunks().dictionary_encode()
            names, term = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            # rows go by term, so its number changes where the term does
            cuts = np.r_[0, np.flatnonzero(term[1:] != term[:-1]) + 1, len(term)].tolist()
            levels, level = np.unique(part.column("tf").to_numpy(), return_inverse=True)
            impacts = (levels.astype(np.int64) * 1_000_000_000 // (levels.astype(np.int64) * 1000 + 8 * m))[level]
            spans = [(*asks[names[term[a]]], a, z) for a, z in zip(cuts, cuts[1:], strict=False) if names[term[a]] in asks]
            bound = np.zeros(len(items), np.int64)
            for who, weight, a, z in spans:
                bound[who] += weight * impacts[a:z].max()
            wanted = (bound >= top.floors) & (bound > 0)
            if strata is not None:
                wanted &= strata[m]
            if not wanted.any():
                continue
            rows = np.flatnonzero(wanted)
            line = np.full(len(items), -1)
            line[rows] = np.arange(len(rows))
            _, first, local = np.unique(part.column("place").to_numpy(), return_index=True, return_inverse=True)
            scores = np.zeros((len(rows), len(first)), np.int64)
            for who, weight, a, z in spans:
                own = line[who]
                if (own >= 0).all():
                    scores[own[:, None], local[None, a:z]] += weight[:, None] * impacts[None, a:z]
                elif (own >= 0).any():
                    scores[own[own >= 0][:, None], local[None, a:z]] += weight[own >= 0][:, None] * impacts[None, a:z]
            ids = part.column("doc").fill_null(NONE).to_numpy()[first]
            best = scores.max(axis=1)
            for i in np.flatnonzero((best >= top.floors[rows]) & (best > 0)).tolist():
                top.add(int(rows[i]), scores[i], ids)
        for item, (scores, docs) in top.best.items():
            own = pa.array([None if d == NONE else d for d in docs.tolist()], pa.int64())
            yield pa.record_batch([pa.array([item] * len(scores), pa.int32()), own, pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    hits = postings.mapInArrow(run, "item int, doc_id long, score long")
    names = F.array(*(F.lit(x) for x in items)) if items else F.array()
    return hits.select(F.get(names, "item").alias("item_id"), "doc_id", "score")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = 10, b: int = 90, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of an item with the highest scores above 0, equal ones by doc_id.

    Items are searched in blocks of some BLOCK (item, term) rows, each against all postings of its
    terms: these are dealt out by stratum, strata of more than some PART documents in parts. A first
    visit to each item's strata of the highest bounds, until they hold k documents, gives a floor;
    the second visits, by falling bound, strata whose bound reaches it. Nulls: a null doc_id comes
    first, a null item text has no terms. Empty tables and items without known terms give no rows.
    """
    there = index.where("term IS NULL").select(F.explode("postings.n").alias("n"))
    docs, terms = there.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    kind = items.schema[id_col].dataType.simpleString()
    if not docs:
        return items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    m = normaliser(F.col("n"), b, docs, terms)
    strata = there.groupBy(m.alias("m")).agg(F.ceil(F.count("*") / PART).alias("parts"))
    asked = keep(item_terms(items, id_col, text_col), "lexical-items")
    names = asked.select("term").distinct()
    if names.count() <= BROADCAST:
        names = F.broadcast(names)
    listed = index.where("term IS NOT NULL").join(names, "term", "left_semi").select("term", F.inline("postings"))
    found = keep(listed.select("term", m.alias("m"), "tf", "doc", "place"), "lexical-found")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = keep(asked.join(df, "term").select("item_id", "term", weight.alias("w")).where("w > 0"), "lexical-weights")

    peaks = found.groupBy("m", "term").agg(F.max("tf").cast("long").alias("tf"), F.count("*").alias("docs"))
    bounds = keep(weights.join(peaks, "term").groupBy("item_id", "m").agg(F.sum(F.col("w") * impact(F.col("tf"), F.col("m"))).alias("bound"), F.max("docs").alias("docs")), "lexical-bounds")
    order = bounds.groupBy("m").agg(F.max("bound").alias("bound"))
    sizes = keep(strata.join(order, "m"), "lexical-strata")
    if sizes.count() <= BROADCAST:
        sizes = F.broadcast(sizes)
    dealt = found.join(sizes, "m").withColumn("g", F.col("m") * (1 << 20) + F.pmod(F.xxhash64("place"), F.col("parts")))
    postings = dealt.repartition("g").sortWithinPartitions(F.desc("bound"), "g", "term").select("g", "m", "term", "tf", "doc", "place")
    blocks = -(-weights.count() // BLOCK)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))
    before = F.coalesce(F.sum("docs").over(W.partitionBy("item_id").orderBy(F.desc("bound"), "m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begin = bounds.withColumn("before", before).where(F.col("before") < k).withColumn("part", block)

    hits = None
    for part in range(blocks):
        # bounded: a block's items and terms, and at most k strata of each item
        asks = [tuple(r) for r in weights.where(block == part).select("item_id", "term", "w").toLocalIterator()]
        only: dict[object, list[int]] = {}
        for item, stratum in begin.where(F.col("part") == part).select("item_id", "m").toLocalIterator():
            only.setdefault(item, []).append(stratum)
        if not asks:
            continue
        first = postings.where(F.col("m").isin(sorted({s for v in only.values() for s in v})))
        reached = _best(visit(first, asks, {}, k, only), k).where(F.col("rank") == k)
        floors = {r.item_id: r.score for r in reached.select("item_id", "score").toLocalIterator()}
        best = keep(visit(postings, asks, floors, k), "lexical-hits")
        hits = best if hits is None else hits.unionByName(best)
    if hits is None:
        return items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return _best(hits, k).select(F.col("item_id").cast(kind).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")

