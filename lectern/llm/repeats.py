"""Removing repeated byte strings by depth-limited radix sort.

Every byte that a string of `depth` bytes covers is removed if that string also starts anywhere
else. Sorting all suffixes would move many times the corpus, so suffixes are first narrowed to
where equal strings can be: in each string of `depth` bytes the substring of DIGIT bytes with
the smallest hash is its anchor. Equal strings have the same anchor at the same place, so only
positions around anchors that occur twice can repeat.

Around such an anchor the strings that contain it are ordered by most-significant-digit passes
of DIGIT bytes, to `depth` and no further; what is alone in its group drops out of the next
pass, and what shares one after the last is a repeated window. The covered bytes around an anchor
are one interval, from the first repeated window's start to the last one's end, because all of
its windows contain the anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop, keep, meet, whole_groups

#: Bytes of a digit: anchors are one, and each sort pass goes one deeper.
DIGIT = 50
#: Contexts that a task holds to count equal ones before it writes them.
HELD = 8_000

_rng = np.random.default_rng(4)
_SYMBOL = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64, remembered."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size, have = max(n, 1 << 16), np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, fold: np.ufunc, neutral: int) -> np.ndarray:
    """fold over each `width` neighbours: prefixes and suffixes of blocks of that width meet in every window."""
    blocks = np.append(values, np.full(-len(values) % width, neutral, np.uint64)).reshape(-1, width)
    before, after = fold.accumulate(blocks, 1).ravel(), fold.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return fold(after[:n], before[width - 1 : width - 1 + n])


def anchors(text: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all strings of `depth` bytes of a text."""
    x, width = _SYMBOL[np.frombuffer(text, np.uint8)], depth - DIGIT + 1
    n = len(x)
    if n < depth:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x * _power(n), out=sums[1:])
    # dividing by base ** place makes the sum independent of the place
    h = _mixed((sums[DIGIT:] - sums[:-DIGIT]) * _power(n - DIGIT + 1, pow(_BASE, -1, 1 << 64)))
    least = _sliding(h, width, np.minimum, (1 << 64) - 1)
    edge = np.zeros(width - 1, np.uint64)
    # a place is an anchor if it is the minimum of one of the windows that hold it
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0) == h)
    return at, h[at]


def _identified(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """doc_id and text's hash name a row; repeated rows share a name, and their places are counted apart."""
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))


_NAME = ["id", "th"]


def _anchor_rows(named: DataFrame, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found, rows = [anchors(bytes(t.as_buffer()), depth) for t in batch.column(2)], np.arange(batch.num_rows)
            n = np.array([len(p) for p, _ in found])
            at = np.repeat(rows, n)
            if len(at):
                place, h = np.concatenate([p for p, _ in found]), np.concatenate([h for _, h in found])
                yield pa.record_batch([pa.array(ids[at]), pa.array(th[at]), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64))], ["id", "th", "place", "h"])

    return named.select("id", "th", "text").mapInArrow(run, "id long, th long, place int, h long")


OCCURRENCE = "id long, th long, place int, h long, context binary, n long, reach int, bytes binary"


def _contexts(flagged: DataFrame, depth: int) -> DataFrame:
    """Rows of two kinds: each place with its context's digest, and each task's contexts with how often they occur.

    A context is what stands up to depth - DIGIT bytes before and depth bytes after a place; reach
    is how much stands before it. flagged: id, th, text, places.
    """
    back = depth - DIGIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            none, rows = pa.nulls(len(held)), list(held.values())
            cols = [none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array(list(held), pa.binary()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())]
            held.clear()
            return pa.record_batch(cols, ["id", "th", "place", "h", "context", "n", "reach", "bytes"])

        for batch in batches:
            digests: list[bytes] = []
            for text, places in zip(batch.column(2), batch.column(3), strict=True):
                data, found = bytes(text.as_buffer()), places.values
                for p, h in zip(found.field("place").to_pylist(), found.field("h").to_pylist(), strict=True):
                    start = max(0, p - back)
                    around = data[start : p + depth]
                    digest = xxhash.xxh3_128_digest(around, p - start)
                    digests.append(digest)
                    if (seen := held.get(digest)) is None:
                        held[digest] = [h, p - start, around, 1]
                    else:
                        seen[3] += 1
                if len(held) >= HELD:
                    yield flush()
            each, places = batch.column(3).value_lengths().to_numpy(), batch.column(3).flatten()
            n, at = len(digests), np.repeat(np.arange(batch.num_rows), each)
            who = [batch.column(c).take(pa.array(at)) for c in (0, 1)]
            yield pa.record_batch([*who, places.field("place"), places.field("h"), pa.array(digests, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["id", "th", "place", "h", "context", "n", "reach", "bytes"])
        if held:
            yield flush()

    return flagged.select("id", "th", "text", "places").mapInArrow(run, OCCURRENCE)


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of one context from several tasks the first row's number, and the sum of their counts."""
    index: dict[bytes, int] = {}
    at = np.array([index.setdefault(c, len(index)) for c in rows.column("context").to_pylist()])
    first = np.unique(at, return_index=True)[1]
    return first, np.bincount(at, weights=rows.column("n").to_numpy()).astype(np.int64)


def _passes(group: np.ndarray, digits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that share their group and all digits with another, and that other row.

    Most significant digit first; what is alone drops out.
    """
    rows = number = np.arange(len(group))
    for digit in digits:
        key = _mixed(group[rows] * np.uint64(0x2545F4914F6CDD1D) + digit[rows])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        first = np.flatnonzero(np.append(True, ~same))
        size = np.diff(np.append(first, len(rows)))
        number = np.repeat(np.arange(len(first), dtype=np.uint64), size)
        stay = np.repeat(size > 1, size)
        rows, number = rows[order][stay], number[stay]
        group = group.copy()
        group[rows] = number
        if not len(rows):
            return rows, rows
    follows = np.append(number[1:] == number[:-1], False)
    return rows, np.where(follows, np.roll(rows, -1), np.roll(rows, 1))


def _equal(cells: np.ndarray, one: np.ndarray, other: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """Whether two contexts have the same bytes in the window at `start`."""
    same = np.ones(len(one), bool)
    for c in range(depth):
        same &= cells[start + c, one] == cells[start + c, other]
    return same


def _by_bytes(cells: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int, back: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last repeated window of each context (past the end and -1: none), windows compared as they are."""
    low, high = np.full(len(group), len(cells)), np.full(len(group), -1)
    for start in range(back + 1):
        seen: dict[tuple, int] = {}
        for i in np.flatnonzero((left <= start) & (right >= start + depth)).tolist():
            other = seen.setdefault((group[i], cells[start : start + depth, i].tobytes()), i)
            if other != i:
                both = [i, other]
                low[both], high[both] = np.minimum(low[both], start), start
    return low, high


def covered(rows: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the contexts of whole anchor groups: which have repeated windows, how far these reach back and on, and how often each occurs.

    Windows are sorted by digests of their digits inside one anchor's group; the first and the last
    one of a context, which alone decide, are then compared byte by byte with a window that they equal.
    """
    first, n = _merged(rows)
    back, wide = depth - DIGIT, 2 * depth - DIGIT
    group = rows.column("h").to_numpy()[first].view(np.uint64)
    reach = rows.column("reach").to_numpy()[first].astype(np.int64)
    texts = rows.column("bytes").take(pa.array(first)).to_pylist()
    size = np.array([len(t) for t in texts])
    # context bytes as columns, each anchor at column `back`
    cells = np.frombuffer(b"".join(t.rjust(len(t) + back - r, b"\0").ljust(wide, b"\0") for t, r in zip(texts, reach.tolist(), strict=True)), np.uint8).reshape(-1, wide).T.copy()
    left, right = back - reach, back - reach + size
    low, high = np.full(len(first), wide), np.full(len(first), -1)
    # a context that occurs twice has all its windows repeated, but still is a partner for others
    twice = n > 1
    fits = right - left >= depth
    low[twice & fits], high[twice & fits] = left[twice & fits], right[twice & fits] - depth
    alone = np.unique(group[~twice])
    rest = np.flatnonzero(np.isin(group, alone) & fits)
    if len(rest):
        cells, of = cells[:, rest], group[rest]
        power = _power(wide)
        column = lambda c: _SYMBOL[cells[c]] * power[c]
        sums = [sum((column(c) for c in range(d, d + DIGIT)), np.zeros(len(rest), np.uint64)) for d in range(0, depth, DIGIT)]
        found = {end: [np.full(len(rest), at), np.full(len(rest), -1)] for end, at in (("low", wide), ("high", -1))}
        for start in range(back + 1):
            ok = np.flatnonzero((left[rest] <= start) & (right[rest] >= start + depth))
            if len(ok) > 1:
                hit, mate = (ok[x] for x in _passes(of[ok], [s[ok] for s in sums]))
                new = found["low"][0][hit] == wide
                found["low"][0][hit[new]], found["low"][1][hit[new]] = start, mate[new]
                found["high"][0][hit], found["high"][1][hit] = start, mate
            if start < back:
                for i, s in enumerate(sums):
                    at = start + i * DIGIT
                    s += column(at + DIGIT) - column(at)
        hit = np.flatnonzero(found["high"][0] >= 0)
        true = np.ones(len(hit), bool)
        for at, mate in found.values():
            true &= _equal(cells, hit, mate[hit], at[hit], depth)
        lows, highs = found["low"][0], found["high"][0]
        again = np.flatnonzero(np.isin(of, of[hit[~true]]))
        if len(again):
            lows[again], highs[again] = _by_bytes(cells[:, again], of[again], left[rest[again]], right[rest[again]], depth, back)
        low[rest], high[rest] = np.minimum(low[rest], lows), np.maximum(high[rest], highs)
    hit = np.flatnonzero(high >= 0)
    return first[hit], back - low[hit], high[hit] + depth - back, n[hit]


#: Bits of a context's name beside a window's beginning.
NAME = 54
REACHES = "context binary, back int, ahead int, n long"


def _resolved(classes: DataFrame, depth: int, width: int) -> DataFrame:
    """(context, back, ahead, n) of contexts with repeated windows; whole anchor groups meet in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def settle() -> pa.RecordBatch:
            rows = pa.concat_tables(held).combine_chunks()
            at, back, ahead, n = covered(rows, depth)
            held.clear()
            return pa.record_batch([rows.column("context").take(pa.array(at)).combine_chunks(), pa.array(back.astype(np.int32)), pa.array(ahead.astype(np.int32)), pa.array(n)], ["context", "back", "ahead", "n"])

        for rows in whole_groups(batches, "h"):
            held.append(rows)
            if sum(x.num_rows for x in held) >= HELD:
                yield settle()
        if held:
            yield settle()

    dealt = classes.select("h", "context", "n", "reach", "bytes").repartition(width, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, REACHES)


def _spread(classes: DataFrame, depth: int, digest: Callable[[bytes], int] | None = xxhash.xxh64_intdigest) -> DataFrame:
    """As _resolved for anchors of very many contexts: each pass of the sort is an aggregation over all tasks.

    Digits are sorted by their digests; the first and the last window of each context, which alone
    decide, are then compared byte by byte with one that they equal, and anchors where that fails are
    sorted again with the digits themselves (digest None).
    """
    back, digits = depth - DIGIT, [f"d{i}" for i in range(depth // DIGIT)]
    kind = pa.int64() if digest else pa.binary()
    # names of contexts in the low bits of numbers, so that windows are aggregated as numbers; two of one name compare as different
    own = F.xxhash64("context").bitwiseAND(F.lit((1 << NAME) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text, first = row["bytes"], back - row["reach"]
                n = min(len(text) - depth, row["reach"]) + 1
                if n <= 0:
                    continue
                every = [text[s : s + DIGIT] for s in range(n + depth - DIGIT)]
                read = pa.array(np.array([digest(x) for x in every], np.uint64).view(np.int64)) if digest else pa.array(every, kind)
                same = [pa.array([row[c]] * n, t) for c, t in (("context", pa.binary()), ("n", pa.int64()), ("h", pa.int64()))]
                yield pa.record_batch([*same, pa.array(np.arange(first, first + n, dtype=np.int32)), *(read.slice(i * DIGIT, n) for i in range(len(digits)))], ["context", "n", "h", "start", *digits])

    one = classes.groupBy("context").agg(F.sum("n").alias("n"), F.max("reach").alias("reach"), F.max("bytes").alias("bytes"), F.first("h").alias("h"))
    one = keep(one.withColumn("own", own), "crowd")
    rows = one.mapInArrow(run, ", ".join(["context binary", "n long", "h long", "start int", *(f"{d} {'long' if digest else 'binary'}" for d in digits)]))
    key, kept = ["h", "start"], [one]
    for digit in digits:
        key = [*key, digit]
        mates = [F.min(own).alias("one"), F.max(own).alias("other")] if digit == digits[-1] else []
        kept.append(keep(rows.groupBy(key).agg(F.sum("n").alias("n"), *mates).where("n > 1"), "digit"))
        kept.append(keep(meet(rows, kept[-1], key), "windows"))
        rows = kept[-1]
    mate = F.when(F.col("one") == own, F.col("other")).otherwise(F.col("one"))
    window = F.shiftleft(F.col("start").cast("long"), NAME) + mate
    ends = keep(rows.groupBy("context").agg(F.min(window).alias("low"), F.max(window).alias("high"), F.first("n").alias("n"), F.first("h").alias("h")), "ends")
    kept.append(ends)
    false = _differing(ends, one, depth, back) if digest else None
    again = false is not None and false.limit(1).count()
    true = ends.join(false, "h", "left_anti") if again else ends
    reaches = true.select("context", (back - F.shiftright("low", NAME)).cast("int").alias("back"), (F.shiftright("high", NAME) + depth - back).cast("int").alias("ahead"), "n")
    if again:
        reaches = reaches.unionByName(_spread(classes.join(false, "h", "left_semi"), depth, None))
    reaches = keep(reaches, "spread")
    for done in kept:
        drop(done)
    return reaches


def _differing(ends: DataFrame, one: DataFrame, depth: int, back: int) -> DataFrame:
    """(h): anchors with a context whose first or last window isn't, byte by byte, the one of the context that it was found equal to."""
    cut = lambda of: F.expr(f"substring({of}.bytes, start - {back} + {of}.reach + 1, {depth})")
    placed = ends.select("h", "context", F.explode(F.array("low", "high")).alias("w"))
    windows = placed.select("h", "context", F.shiftright("w", NAME).cast("int").alias("start"), F.col("w").bitwiseAND(F.lit((1 << NAME) - 1)).alias("mate"))
    mine = one.select("context", "own", F.struct("bytes", "reach").alias("mine"))
    own = windows.join(mine, "context").where("mate <> own").select("h", "start", "mate", cut("mine").alias("window"))
    mates = windows.groupBy("mate").agg(F.count("*").alias("n")).join(one.select(F.col("own").alias("mate"), F.struct("bytes", "reach").alias("theirs")), "mate")
    return meet(own, mates, ["mate"]).where(F.col("window") != cut("theirs")).select("h").distinct()


def repeated_intervals(named: DataFrame, depth: int) -> DataFrame:
    """(id, th, cuts): intervals that repeated strings of `depth` bytes cover, as array<struct<start, end>>."""
    spark = named.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = keep(_anchor_rows(named, depth), "anchors")
    twice = keep(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors-twice")
    places = keep(meet(every, twice, ["h"]).groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("place", "h"))).alias("places")), "places")
    drop(every)
    drop(twice)
    found = keep(_contexts(named.join(places, _NAME), depth), "contexts")
    drop(places)
    classes = found.where("bytes IS NOT NULL")
    crowds = classes.groupBy("h").agg(F.count("*").alias("rows"))
    # anchors with over twice a task's share of contexts: at most half as many as there are partitions
    share = crowds.agg(F.sum("rows")).first()[0] or 0
    crowded = [r["h"] for r in crowds.where(F.col("rows") > max(256, 2 * share // width)).select("h").collect()]
    hot = F.col("h").isin(crowded) if crowded else F.lit(False)
    reaches = _resolved(classes.where(~hot), depth, width)
    if crowded:
        reaches = reaches.unionByName(_spread(classes.where(hot), depth))
    reaches = keep(reaches, "reaches")
    spans = meet(found.where("bytes IS NULL").drop("n"), reaches, ["context"]).select("id", "th", (F.col("place") - F.col("back")).alias("start"), (F.col("place") + F.col("ahead")).alias("end"))
    cuts = keep(spans.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts")), "cuts")
    drop(found)
    drop(reaches)
    return cuts


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that sorted intervals cover; touching ones are one."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return list(zip(starts[new].tolist(), reach[np.append(new[1:] - 1, len(ends) - 1)].tolist(), strict=True))


def remove_repeats(docs: DataFrame, depth: int = 200, carry: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, kept (bytes), spans (the removed runs), text, and the columns `carry` of every row.

    Texts are their UTF-8 bytes (null: empty); strings never cross documents, overlapping ones
    count, and all are judged on the input. Rows that repeat an id and text are documents of their
    own, so they repeat each other. Texts under `depth` bytes keep everything. text, null unless
    asked for, is what is kept without characters that a cut has broken. A text's anchors and cuts
    are lists on its row; nothing else is grouped without a bound. An anchor with very many
    contexts is sorted by the same passes, as aggregations over all tasks instead of in one. Either way
    the windows that decide are compared byte by byte.
    """
    if depth % DIGIT or depth <= DIGIT:
        raise ValueError(f"depth is a multiple of {DIGIT} above it")
    named = _identified(docs, carry)
    cuts = repeated_intervals(named.select("id", "th", "text").where(F.octet_length("text") >= depth), depth)
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            sizes, kept, spans = [], [], []
            for text, cut in zip(batch.column(1), batch.column(2), strict=True):
                data = bytes(text.as_buffer())
                runs = merged(*(cut.values.field(k).to_numpy() for k in ("start", "end"))) if cut.is_valid else []
                at, parts = 0, []
                for a, b in runs:
                    parts.append(data[at:a])
                    at = b
                sizes.append(len(data))
                kept.append(b"".join([*parts, data[at:]]))
                spans.append([{"start": a, "end": b} for a, b in runs])
            read = [k.decode(errors="ignore") for k in kept] if texts else [None] * len(kept)
            cols = [pa.array(c, k) for c, (_, k) in zip((sizes, kept, spans, read), kinds[1:], strict=True)]
            yield pa.record_batch([batch.column(0), *cols, batch.column(3)], [*(n for n, _ in kinds), "carried"])

    schema = f"doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>, text string, carried {named.schema['carried'].dataType.simpleString()}"
    cut = named.join(cuts, _NAME, "left").select("doc_id", "text", "cuts", "carried").mapInArrow(run, schema)
    return cut.select("doc_id", "n_bytes", "kept", "spans", "text", *(F.col("carried")[c].alias(c) for c in carry))
