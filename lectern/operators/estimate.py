"""Word counts, durations, costs, sizes and the layout of parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectern.functions.folders import kept
from lectern.functions.text import go_trim, word_count

#: Provider, model, US dollars per million characters, free characters a month.
PRICES = (
    ("espeak", "default", 0.0, 0),
    ("festival", "default", 0.0, 0),
    ("google", "Chirp3-HD", 30.0, 1000000),
    ("google", "Standard", 4.0, 4000000),
    ("google", "Wavenet", 4.0, 4000000),
    ("google", "Neural2", 16.0, 1000000),
    ("google", "Studio", 160.0, 1000000),
    ("google", "Polyglot", 16.0, 1000000),
    ("google", "News", 16.0, 1000000),
    ("google", "Chirp", 16.0, 1000000),
    ("google", "Casual", 16.0, 1000000),
    ("azure", "Standard", 4.0, 500000),
    ("azure", "Neural", 16.0, 500000),
    ("openai", "tts-1", 15.0, 0),
    ("openai", "tts-1-hd", 30.0, 0),
)
WORDS_PER_MINUTE = 150


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "provider string, model string, price double, free_chars long")


def chapter_stats(chapters: DataFrame) -> DataFrame:
    """Adds words and chars (UTF-8 bytes) of each chapter's content."""
    return chapters.withColumns({"words": word_count(F.col("content")), "chars": F.octet_length(F.coalesce("content", F.lit(""))).cast("long")})


def duration_label(minutes: Column) -> Column:
    hours, rest = F.floor(minutes / 60), minutes % 60
    short, whole = F.concat(minutes.cast("string"), F.lit("m")), F.concat(hours.cast("string"), F.lit("h"))
    return F.when(minutes < 60, short).when(rest == 0, whole).otherwise(F.concat(whole, F.lit(" "), rest.cast("string"), F.lit("m")))


def book_estimate(stats: DataFrame) -> DataFrame:
    """Per book: chapters, words, chars, minutes (at least 1 if there is a word) and their label."""
    books = stats.groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum("words").alias("words"), F.sum("chars").alias("chars"))
    minutes = F.floor(F.col("words") / WORDS_PER_MINUTE)
    books = books.withColumn("minutes", F.when((minutes == 0) & (F.col("words") > 0), F.lit(1).cast("long")).otherwise(minutes))
    return books.withColumn("duration", duration_label(F.col("minutes")))


def cost_matrix(books: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of every book under every price, keyed provider_model, or provider alone for the default model."""
    key = F.when(F.col("model") == "default", F.col("provider")).otherwise(F.concat_ws("_", "provider", "model"))
    return books.crossJoin(prices).select("book_id", key.alias("key"), (F.col("chars") / F.lit(1e6) * F.col("price")).alias("cost"))


def cheapest_models(books: DataFrame, prices: DataFrame, provider: str) -> DataFrame:
    """A provider's paid models by cost, then name, with their rank per book."""
    paid = prices.where((F.col("provider") == provider) & (F.col("model") != "default") & (F.col("price") > 0))
    costs = books.crossJoin(paid).withColumn("cost", F.col("chars") / F.lit(1e6) * F.col("price"))
    rank = F.row_number().over(W.partitionBy("book_id").orderBy("cost", "model"))
    return costs.select("book_id", "model", "cost", rank.cast("long").alias("rank"))


def voice_model(provider: Column, voice: Column) -> Column:
    """The model that a voice's id names."""
    parts = F.filter(F.split(voice, "-"), lambda x: x != "")
    third = F.when((F.size(parts) >= 4) & (F.get(parts, 2) == "Chirp3") & (F.get(parts, 3) == "HD"), "Chirp3-HD").otherwise(F.get(parts, 2))
    openai = F.when(F.contains(voice, F.lit(":")), F.substring_index(voice, ":", 1)).when(voice.isin("tts-1", "tts-1-hd"), voice).otherwise("tts-1")
    return (
        F.when(provider.isin("espeak", "festival"), "default")
        .when(provider == "openai", openai)
        .when(provider == "azure", F.when(F.contains(voice, F.lit("Neural")), "Neural").otherwise("Standard"))
        .otherwise(third)
    )


def price_for_voice(voices: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds model and price to provider, voice: the model's, else tts-1's or Standard's, else 0."""
    named = voices.withColumn("model", voice_model(F.col("provider"), F.col("voice")))
    fallback = prices.where((F.col("model") == "tts-1") | ((F.col("model") == "Standard") & (F.col("provider") != "openai"))).select("provider", F.col("price").alias("other"))
    joined = named.join(prices.select("provider", "model", "price"), ["provider", "model"], "left").join(fallback, "provider", "left")
    return joined.select(*voices.columns, "model", F.coalesce("price", "other", F.lit(0.0)).alias("price"))


def voice_match(requests: DataFrame, voices: DataFrame, prefix_providers: tuple[str, ...] = ("opentts",)) -> DataFrame:
    """Voices of a request (provider, language, model; empty: any), by name; some providers match a language's beginning.

    A voice is looked up under each request that it answers: its own or no provider, language and
    model, and the beginnings of its language where they count, so the join is on equal keys.
    """
    language, empty = F.coalesce("language", F.lit("")), F.lit("")
    begins = F.when(F.col("provider").isin(*prefix_providers), F.transform(F.sequence(F.lit(0), F.length(language)), lambda n: F.left(language, n)))
    keys = {"_provider": F.array(empty, F.coalesce("provider", empty)), "_language": F.coalesce(begins, F.array(empty, language)), "_model": F.array(empty, F.coalesce("model", empty))}
    answers = voices
    for name, every in keys.items():
        answers = answers.withColumn(name, F.explode(F.array_distinct(every)))
    answers = answers.select("voice_id", "name", *keys)
    asked = requests.select("request_id", *(F.col(k[1:]).alias(k) for k in keys))
    matched = asked.join(answers, list(keys))
    rank = F.row_number().over(W.partitionBy("request_id").orderBy("name", "voice_id"))
    return matched.select("request_id", "voice_id", "name", rank.cast("long").alias("rank"))


def voice_counts(voices: DataFrame) -> DataFrame:
    return voices.groupBy("provider").agg(F.count("*").alias("voices"), F.countDistinct("language").alias("languages"))


def distinct_values(voices: DataFrame, column: str, provider: str = "") -> DataFrame:
    """The languages or models on offer, of one provider or all."""
    return (voices.where(F.col("provider") == provider) if provider else voices).where(F.col(column) != "").select(column).distinct()


def join_names(df: DataFrame, key: str, items: str, separator: str, names: DataFrame | None = None, most: int = 5) -> DataFrame:
    """(key, joined): an array's items trimmed, the first of those alike but for case, `most` at most, in order.

    names: (code, name), to translate codes by, with a column lang if df has one too; the first
    casing stands for those without a name.
    """
    by = ["code"]
    if names is not None and "lang" in names.columns and "lang" in df.columns:
        by.append("lang")
    more = by[1:]
    one = df.select(key, *more, F.posexplode(items).alias("at", "item")).withColumn("item", go_trim(F.col("item"))).where("item <> ''")
    first = one.groupBy(key, *more, F.lower("item").alias("code")).agg(F.min(F.struct("at", "item")).alias("f"))
    rank = F.row_number().over(W.partitionBy(key).orderBy("f.at"))
    top = first.withColumn("rank", rank).where(F.col("rank") <= most)
    name = F.col("f.item")
    if names is not None:
        top, name = top.join(names, by, "left"), F.coalesce("name", "f.item")
    listed = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", name.alias("name")))).alias("l"))
    joined = listed.select(key, F.array_join(F.transform("l", lambda x: x["name"]), separator).alias("joined"))
    return df.select(key).join(joined, key, "left").select(key, F.coalesce("joined", F.lit("")).alias("joined"))


def resolve_genre(job: Column, book: Column, default: str = "Audiobook") -> Column:
    """The job's genre, else the book's, else a default; blank counts as none."""
    return F.coalesce(F.nullif(job, F.lit("")), F.nullif(book, F.lit("")), F.lit(default))


#: Chapter numbers of a part of a book, within which running sums are taken.
SPAN = 4096


def number_chapters(rows: DataFrame, book: str, first: str, second: str, rest: list[str], span: int = SPAN) -> DataFrame:
    """Adds chapter_no: each row's place among its book's, from 1, by `first`, the whole number `second` and `rest`.

    Places are counted within parts of a book, which keep the order, and after the rows of the parts before.
    """
    own = rows.withColumn("_part", F.floor(F.col(second) / span))
    at = [book, first, "_part"]
    before = W.partitionBy(book).orderBy(first, "_part").rowsBetween(W.unboundedPreceding, -1)
    counts = own.groupBy(*at).agg(F.count("*").alias("n")).select(*(F.col(c).alias(f"_{c}") for c in at), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = own.withColumn("_inside", F.row_number().over(W.partitionBy(*at).orderBy(second, *rest)))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in at]
    placed = inside.join(counts, same[0] & same[1] & same[2])
    return placed.select(*rows.columns, (F.col("_before") + F.col("_inside")).cast("long").alias("chapter_no"))


def chapter_timeline(chapters: DataFrame, gap_ms: int, span: int = SPAN) -> DataFrame:
    """Adds start_ms and end_ms: all before, with a gap after each, and the chapter's own duration.

    Sums run within parts of `span` chapter numbers and start from the sum of the parts before.
    """
    own = chapters.withColumn("_part", F.floor(F.col("chapter_no") / span))
    took, none = F.col("duration_ms") + gap_ms, F.lit(0).cast("long")
    so_far = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    sums = own.groupBy("book_id", "_part").agg(F.sum(took).alias("_took"))
    before = F.coalesce(F.sum("_took").over(so_far(W.partitionBy("book_id").orderBy("_part"))), none)
    parts = sums.select(F.col("book_id").alias("_book"), F.col("_part").alias("_of"), before.alias("_before"))
    inside = own.withColumn("_inside", F.coalesce(F.sum(took).over(so_far(W.partitionBy("book_id", "_part").orderBy("chapter_no"))), none))
    placed = inside.join(parts, F.col("book_id").eqNullSafe(F.col("_book")) & F.col("_part").eqNullSafe(F.col("_of")))
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Chapter "), F.col("chapter_no").cast("string")))
    timed = placed.withColumn("start_ms", F.col("_before") + F.col("_inside")).drop("_book", "_of", "_part", "_before", "_inside")
    return timed.withColumns({"end_ms": F.col("start_ms") + F.col("duration_ms"), "title": title})


def estimate_size(seconds: Column, kbps: int) -> Column:
    """Bytes of so many seconds, with 5 % for the container."""
    return F.floor(seconds * F.lit(kbps * 1000 / 8) * F.lit(1.05)).cast("long")


def next_starts(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Of each chapter the first one after it that a part begun there has no room for; their number if there is none."""
    ends = np.cumsum(sizes)
    after = np.searchsorted(ends, ends - sizes + limit, side="right")
    return np.maximum(after, np.arange(1, len(sizes) + 1))


def last_starts(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each chapter the last part's beginning in a span if a part begins there, and how many parts begin in between."""
    n = len(after)
    last, count = np.arange(n), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            last[i], count[i] = last[after[i]], count[after[i]] + 1
    return last, count


def numbered_parts(after: np.ndarray, first: int) -> np.ndarray:
    """Part numbers of a span's chapters, from 0 before its first beginning `first` (its length if there is none)."""
    starts = np.zeros(len(after), np.int64)
    while first < len(after):
        starts[first] = 1
        first = int(after[first])
    return np.cumsum(starts)


def pack_parts(chapters: DataFrame, max_mb: int, kbps: int = 128, span: int = SPAN) -> DataFrame:
    """Adds size and part_no: chapters in order, a new part when one would not fit in a part that has some.

    Rows go by chapter_no, then size, dealt out by ranges of that order, and each task cuts what it has
    of a book into spans of `span` rows. A book in one span is done there. In other books the last
    beginning of each chain in a span leads to a beginning in a later one, found by running sums over
    the spans; pointer jumping over these leads, twice as far each round, tells where the chain from the
    book's first chapter enters each span. So no task reads a book, however many chapters it has.
    What the driver reads is a sum for each span of such books: spans grow with the table, so that
    there are at most some 2**20. max_mb of 0 or less makes one part; null sizes count as 0.
    """
    kbps = kbps if kbps > 0 else 128
    sized = chapters.withColumn("size", estimate_size(F.col("seconds"), kbps))
    if max_mb <= 0:
        return sized.withColumn("part_no", F.lit(1).cast("long"))
    spark, limit = chapters.sparkSession, max_mb * 1024 * 1024
    span = max(span, sized.count() >> 20)
    at = [sized.columns.index(c) for c in ("book_id", "size")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds each row's span, its place there and its part if the span begins its book."""
        number = TaskContext.get().partitionId() << 36

        def spans(rows: pa.Table, whole: bool) -> Iterator[tuple[pa.Table, int]]:
            """The spans of rows, and of what isn't `whole` the rows that may still go on."""
            nonlocal number
            books = rows.column(at[0])
            same = pc.equal(books.slice(1), books.slice(0, len(books) - 1))
            both = pc.and_(books.slice(1).is_null(), books.slice(0, len(books) - 1).is_null())
            alike = pc.or_(pc.fill_null(same, False), both).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(~alike) + 1).tolist(), len(books)]
            sizes, done = pc.fill_null(rows.column(at[1]), 0).to_pylist(), 0
            numbers, places, parts = [], [], []
            for a, z in zip(cuts, cuts[1:], strict=False):
                while z - a > span or (z - a and (whole or z < len(books))):
                    n, part, filled = min(span, z - a), 1, 0
                    for i, size in enumerate(sizes[a : a + n]):
                        if i and filled + size > limit:
                            part, filled = part + 1, 0
                        filled += size
                        parts.append(part)
                    numbers += [number] * n
                    places += range(n)
                    number, a = number + 1, a + n
                    done = a
            if done:
                out = rows.slice(0, done)
                for name, values in (("_span", numbers), ("_at", places), ("part_no", parts)):
                    out = out.append_column(name, pa.array(values, pa.int64()))
                yield out, done

        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            if not len(rows):
                continue
            done = 0
            for out, done in spans(rows, False):
                yield from out.to_batches()
            rest = rows.slice(done)
        if rest is not None and len(rest):
            for out, _ in spans(rest, True):
                yield from out.to_batches()

    order = [F.asc_nulls_first(c) for c in ("book_id", "chapter_no", "size")]
    dealt = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    longs = [StructField(c, LongType()) for c in ("_span", "_at", "part_no")]
    rows = kept(dealt.mapInArrow(cut, StructType([*sized.schema.fields, *longs])), "part-rows")

    books = rows.groupBy("book_id").agg(F.min("_span").alias("first"), F.max("_span").alias("last")).where("first < last")
    if not books.limit(1).count():
        return rows.drop("_span", "_at")
    mine = F.col("r.book_id").eqNullSafe(F.col("b.book_id"))
    long = kept(
        rows.alias("r").join(books.alias("b"), mine).groupBy("r._span").agg(F.first("first").alias("book"), F.array_sort(F.collect_list(F.struct("_at", F.coalesce("size", F.lit(0)).alias("size")))).alias("s"))
        .select("_span", "book", F.transform("s", lambda x: x["size"]).alias("sizes")),
        "part-spans",
    )
    # at most some 2**20 spans
    totals = long.select("book", "_span", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")).orderBy("book", "_span").toPandas()
    begin = totals.groupby("book")["total"].cumsum() - totals["total"]
    ends: dict[int, tuple[np.ndarray, np.ndarray]] = {b: (g["_span"].to_numpy(), (g["total"] + begin[g.index]).to_numpy()) for b, g in totals.groupby("book")}
    begins = dict(zip(totals["_span"].tolist(), begin.tolist(), strict=True))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each last beginning in a span the later span where its part ends, and the room that is left there."""
        for batch in batches:
            for number, book, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes = np.array(sizes, np.int64)
                exits = np.flatnonzero(next_starts(sizes, limit) == len(sizes))
                spans, sums = ends[book]
                value = begins[number] + np.cumsum(sizes)[exits] - sizes[exits] + limit
                later = np.maximum(np.searchsorted(sums, value, side="right"), int(np.searchsorted(spans, number)) + 1)
                there = later < len(spans)
                to = spans[later[there]]
                room = value[there] - np.array([begins[x] for x in to.tolist()], np.int64)
                yield pa.record_batch([pa.array(np.full(len(to), number)), pa.array(exits[there]), pa.array(to), pa.array(room)], ["span", "exit", "to", "room"])

    found = long.mapInArrow(leads, "span long, exit long, to long, room long")

    def enter(there: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Where parts begin in a span that leads reach, and the last beginning that follows there."""
        if there.empty or asked.empty:
            return pd.DataFrame(columns=["span", "exit", "to", "entry", "out"])
        sizes = np.array(there["sizes"].iloc[0], np.int64)
        entry = np.searchsorted(np.cumsum(sizes), asked["room"].to_numpy(), side="right")
        last, _ = last_starts(next_starts(sizes, limit))
        return pd.DataFrame({"span": asked["span"], "exit": asked["exit"], "to": asked["to"], "entry": entry, "out": last[entry]})

    shape = "span long, exit long, to long, entry long, out long"
    jumps = kept(long.groupBy("_span").cogroup(found.groupBy("to")).applyInPandas(enter, shape), "part-jumps")

    def first_exit(lists: pd.Series) -> pd.Series:
        return pd.Series([int(last_starts(next_starts(np.array(x, np.int64), limit))[0][0]) for x in lists], dtype="int64")

    begun = long.where("_span = book").select(F.col("_span").alias("span"), F.pandas_udf(first_exit, "long")("sizes").alias("exit"))
    reached, step = kept(begun, "part-reached"), jumps.select("span", "exit", "to", "out")
    while True:
        new = reached.join(step, ["span", "exit"]).select(F.col("to").alias("span"), F.col("out").alias("exit"))
        more = kept(new, "part-reached")
        if not more.limit(1).count():
            break
        reached = kept(reached.unionByName(more), "part-reached")
        far = step.alias("a").join(step.alias("b"), (F.col("a.to") == F.col("b.span")) & (F.col("a.out") == F.col("b.exit")))
        step = kept(far.select("a.span", "a.exit", "b.to", "b.out"), "part-jumps")

    entries = reached.join(jumps, ["span", "exit"]).select(F.col("to").alias("_in"), "entry")

    @F.pandas_udf("array<long>")
    def parts(lists: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([numbered_parts(next_starts(np.array(x, np.int64), limit), len(x) if pd.isna(e) else int(e)) for x, e in zip(lists, entry, strict=True)], dtype=object)

    own = F.when(F.col("_span") == F.col("book"), F.lit(0).cast("long")).otherwise(F.col("entry"))
    inside = kept(long.join(entries, F.col("_span") == F.col("_in"), "left").select("_span", "book", parts("sizes", own).alias("parts")), "part-inside")
    before = F.coalesce(F.sum(F.get("parts", F.size("parts") - 1)).over(W.partitionBy("book").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbers = inside.select(F.col("_span").alias("_of"), "parts", before.alias("_before"))
    told = F.coalesce(F.get("parts", F.col("_at").cast("int")) + F.col("_before"), "part_no")
    return rows.join(numbers, F.col("_span") == F.col("_of"), "left").select(*sized.columns, told.alias("part_no"))


def part_titles(parts: DataFrame) -> DataFrame:
    """Adds label and file: numbered only where a book has more than one part."""
    many = F.count("*").over(W.partitionBy("book_id")) > 1
    numbered = F.format_string("%s, Part %03d", "title", "part_no")
    label = F.when(many, numbered).otherwise(F.col("title"))
    return parts.withColumn("label", label).withColumn("file", F.concat("label", F.lit(".m4b")))


PROGRESS = "array<struct<worker:int,progress:double,active:boolean>>"


def build_progress(jobs: DataFrame) -> DataFrame:
    """Per job the workers that are active and their progress over the number of parts; no workers: 0."""
    each = jobs.select("id", "parts", F.explode_outer(F.from_json("worker_progress", PROGRESS)).alias("w"))
    active = F.when(F.col("w.active"), F.col("w.progress"))
    out = each.groupBy("id", "parts").agg(F.count(active).alias("active"), F.coalesce(F.sum(active), F.lit(0.0)).alias("done"))
    return out.select("id", "active", F.when(F.col("parts") > 0, F.col("done") / F.col("parts")).otherwise(0.0).alias("progress"))
