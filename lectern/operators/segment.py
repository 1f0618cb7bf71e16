"""Paragraphs, sentences, separators, parts and size-bounded chunks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import BLANKS, changed, go_trim, let
from lectern.operators.cleaning import is_speakable

MARKER = "{{PART_BREAK}}"
#: What a line is made of that separates parts.
SEPARATORS = (
    r"^\s*\*\s*\*\s*\*\s*$",
    r"^\s*\*{3,}[.\s]*$",
    r"^\s*-\s*-\s*-\s*$",
    r"^\s*-{3,}[.\s]*$",
    r"^\s*•\s*•\s*•\s*$",
    r"^\s*~\s*~\s*~\s*$",
    r"^\s*#\s*#\s*#\s*$",
    r"^\s*\.\s*\.\s*\.\s*$",
    r"^\s*○\s*○\s*○\s*$",
    r"^\s*●\s*●\s*●\s*$",
    r"^\s*◆\s*◆\s*◆\s*$",
    r"^\s*◇\s*◇\s*◇\s*$",
    r"^\s*□\s*□\s*□\s*$",
    r"^\s*■\s*■\s*■\s*$",
    r"^\s*☆\s*☆\s*☆\s*$",
    r"^\s*★\s*★\s*★\s*$",
    r"^\s*×\s*×\s*×\s*$",
    r"^\s*\+\s*\+\s*\+\s*$",
    r"^\s*=\s*=\s*=\s*$",
    r"^\s*_{3,}\s*$",
)
#: What ends a sentence.
ENDS = "[.!?։؟‽]"


def paragraph_list(text: Column) -> Column:
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    return F.filter(F.transform(lines, go_trim), lambda x: x != "")


def _rows(df: DataFrame, items: Column, name: str) -> DataFrame:
    return df.select("doc_id", F.posexplode(items).alias("pos", name)).select("doc_id", F.col("pos").cast("long").alias("pos"), name)


def paragraphs(df: DataFrame) -> DataFrame:
    return _rows(df, paragraph_list(F.col("text")), "paragraph")


def loose_paragraphs(df: DataFrame) -> DataFrame:
    """Between blank lines, with white space inside as one blank."""
    parts = F.split("text", r"\n[\t\n\f\r ]*\n+")
    joined = F.transform(parts, lambda p: F.regexp_replace(go_trim(p), r"[\t\n\f\r ]+", " "))
    return _rows(df, F.filter(joined, lambda x: x != ""), "paragraph")


def sentence_list(text: Column) -> Column:
    """Ends at a mark before white space; initials (A. B.) move together and end nothing."""

    def initials(whole: Column) -> Column:
        return F.regexp_like(whole, F.lit(r"\.(?<=\p{Lu}\.) *\p{Lu}\.")) | F.contains(whole, F.lit(""))

    def held(whole: Column) -> Column:
        close = F.regexp_replace(whole, r"(?<=\p{Lu}\.) *(?=\p{Lu}\.)", "")
        return F.regexp_replace(F.regexp_replace(close, r"(?<=\p{Lu})\.(?=\p{Lu}\.)", ""), r"(?<=\p{Lu})\.", "")

    parts = F.split(changed(text, initials, held), f"(?=[\\t\\n\\f\\r ])(?<={ENDS})[\\t\\n\\f\\r ]+")
    return F.filter(F.transform(parts, lambda x: go_trim(F.replace(x, F.lit(""), F.lit(".")))), lambda x: x != "")


def sentences(df: DataFrame) -> DataFrame:
    return _rows(df, sentence_list(F.col("text")), "sentence")


def sentences_lossless(df: DataFrame) -> DataFrame:
    """Pieces that concatenate to the text: each ends with a mark and one white-space character, or the text."""
    return _rows(df, F.regexp_extract_all("text", F.lit("(?s)(.*?[.!?…](?:[ \\n\\r\\t]|\\z)|.+\\z)"), F.lit(1)), "sentence")


def is_separator(line: Column, patterns: tuple[str, ...] = SEPARATORS) -> Column:
    # where all begin at the line's start, that is looked at once
    bound = all(p.startswith("^") and "|" not in p for p in patterns)
    one = "|".join(f"(?:{p[1:] if bound else p})" for p in patterns).replace(r"\s", r"\t\n\f\r ").replace(r"[.\t", "[.\\t").replace("$", r"\z")
    own = re.sub(r"(?<!\[\.)\\t\\n\\f\\r (?=[*+?])", r"[\\t\\n\\f\\r ]", one)
    return F.regexp_like(line, F.lit(f"\\A(?:{own})" if bound else own))


def mark_separators(df: DataFrame, patterns: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """Separator lines become the marker, one for several in a row."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(is_separator(x, patterns), F.lit(MARKER)).otherwise(x))

    def joined(all_: Column) -> Column:
        first = F.filter(all_, lambda x, i: (x != MARKER) | (i == 0) | (F.get(all_, i - 1) != MARKER))
        return F.array_join(first, "\n")

    return df.withColumn("text", let(lines, joined))


def split_parts(df: DataFrame) -> DataFrame:
    """The trimmed texts between markers that aren't blank."""
    parts = F.transform(F.split("text", re.escape(MARKER).replace("{", "\\{").replace("\\\\", "\\")), go_trim)
    return _rows(df, F.filter(parts, lambda x: x != ""), "part")


def count_parts(df: DataFrame) -> DataFrame:
    n = F.floor((F.length("text") - F.length(F.replace("text", F.lit(MARKER), F.lit("")))) / len(MARKER))
    return df.select("doc_id", n.alias("separators"), (n > 0).alias("has_separators"))


_SENTENCE_END = re.compile(rb"[.!?](?=[ \t\n\r\x0b\x0c])")
_WORD_END = re.compile(rb"[ \t\n\r\x0b\x0c]")
_TAG_MARK = re.compile(rb"[<>]")
#: What pieces are trimmed of.
_TRIM = BLANKS


class Breaks:
    """The places where a text may be cut, listed in one pass: after sentences, after words, and where tags open and close."""

    def __init__(self, data: bytes, words: bool = True):
        self.data = data
        self.kinds = [[m.end() for m in _SENTENCE_END.finditer(data)]]
        if words:
            self.kinds.append([m.end() for m in _WORD_END.finditer(data)])
        self.marks = [m.start() for m in _TAG_MARK.finditer(data)]

    def tag_around(self, at: int, begin: int) -> int:
        """Where the tag opens that a place is inside of, or -1; what lies before `begin` doesn't count."""
        i = bisect_left(self.marks, at) - 1
        opened = self.marks[i] if i >= 0 else -1
        return opened if opened >= begin and self.data[opened] == 60 else -1

    def last(self, places: list[int], begin: int, least: int, most: int) -> int:
        """The last place over `least`, at `most` at most, that is in no tag, or -1; a tag is left by its beginning."""
        while True:
            i = bisect_right(places, most) - 1
            if i < 0 or places[i] <= least:
                return -1
            most = self.tag_around(places[i], begin)
            if most < 0:
                return places[i]

    def hard(self, begin: int, most: int) -> int:
        """The last place after `begin`, at `most` at most, in no tag and no character; if there is none, in no character."""
        at = self._whole(most)
        while at > begin:
            opened = self.tag_around(at, begin)
            if opened < 0:
                return at
            at = self._whole(opened)
        at = self._whole(most)
        if at > begin:
            return at
        at = begin + 1  # a character that is longer than a piece stays whole
        while at < len(self.data) and self.data[at] & 0xC0 == 0x80:
            at += 1
        return at

    def _whole(self, at: int) -> int:
        while at < len(self.data) and self.data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def cut(self, begin: int, most: int) -> int:
        """Where the piece that begins at `begin` ends: after a sentence, else a word, in its second half, else as far as it goes."""
        end = begin + most
        if len(self.data) <= end:
            return len(self.data)
        for places in self.kinds:
            at = self.last(places, begin, begin + most // 2, end)
            if at >= 0:
                return at
        return self.hard(begin, end)


def split_by_size(text: str, most: int, words: bool = True) -> list[str]:
    """Pieces of at most `most` UTF-8 bytes, where no tag or character is longer than that.

    The text is scanned once and read from cut to cut, so the work is linear in its length.
    """
    text = text.strip(_TRIM)
    data = text.encode()
    if len(data) <= most:
        return [text] if text else []
    breaks, out, begin = Breaks(data, words), [], 0
    while begin < len(data):
        end = breaks.cut(begin, max(most, 1))
        out.append(data[begin:end].decode().strip(_TRIM))
        begin = end
    return [x for x in out if x]


#: Texts that are Python objects at a time.
SLICE = 64


def _by_slices(use: Callable[[list[str], int], list[str]], lists: pa.Array, sizes: pa.Array) -> pa.Array:
    """use(list, size) of each row that isn't null; only a slice of a batch is in Python objects at a time."""
    done = [pa.array([], pa.list_(pa.string()))]
    for at in range(0, len(lists), SLICE):
        rows = zip(lists.slice(at, SLICE).to_pylist(), sizes.slice(at, SLICE).to_pylist(), strict=True)
        done.append(pa.array([None if x is None else use(x, n) for x, n in rows], pa.list_(pa.string())))
    return pa.concat_arrays(done)


def chunk_lists(df: DataFrame, mode: str = "sentence", most: int | Column = 900, keep_words: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns `carry`, most, chunks): by sentence, paragraph or size, none over `most` bytes; one row a text.

    most is one size or a column. Only texts that have a piece that is too long, which are few, go to Python.
    """
    if mode == "paragraph":
        parts = F.split("text", r"\n[\t\n\f\r ]*\n+")
        pieces = F.transform(parts, lambda p: F.regexp_replace(go_trim(p), r"[\t\n\f\r ]+", " "))
    elif mode == "size":
        pieces = F.array(go_trim(F.coalesce("text", F.lit(""))))
    else:
        pieces = F.transform(F.split("text", r"(?=[\t\n\f\r ])(?<=[.!?])[\t\n\f\r ]+"), go_trim)

    @F.arrow_udf("array<string>")
    def cut(lists: pa.Array, sizes: pa.Array) -> pa.Array:
        return _by_slices(lambda x, n: [y for p in x for y in split_by_size(p, n, keep_words)], lists, sizes)

    limit = F.lit(most) if isinstance(most, int) else most
    listed = df.select("doc_id", *carry, limit.cast("long").alias("most"), F.filter(pieces, lambda x: x != "").alias("_p"))
    long = F.exists("_p", lambda x: F.octet_length(x) > F.col("most"))
    fitted = listed.withColumn("_c", cut(F.when(long, F.col("_p")), F.col("most")))
    return fitted.select("doc_id", *carry, "most", F.coalesce("_c", "_p").alias("chunks"))


def numbered(listed: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, chunk_no, chunk, and the columns `carry`) out of lists of chunks."""
    return listed.select("doc_id", *carry, F.posexplode("chunks").alias("_n", "chunk")).select("doc_id", F.col("_n").cast("long").alias("chunk_no"), "chunk", *carry)


def chunk(df: DataFrame, mode: str = "sentence", most: int | Column = 900, keep_words: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, chunk_no, chunk, and the columns `carry`): the chunks of chunk_lists(), one a row."""
    return numbered(chunk_lists(df, mode, most, keep_words, carry), carry)


def merged_small(chunks: list[str], least: int, most: int) -> list[str]:
    """Chunks in order: one under `least` bytes takes the next, if both fit in `most`."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for c in chunks:
        n = len(c.encode())
        if size and (size + 1 + n > most or size >= least):
            out.append(" ".join(held))
            held, size = [], 0
        if size:
            held.append(c)
            size += 1 + n
        else:
            held, size = [c], n
    out.append(" ".join(held))
    return [x for x in out if x]


def merge_lists(listed: DataFrame, least: int = 100) -> DataFrame:
    """chunk_lists() with chunks merged in order, each list on its own row: nothing is shuffled."""
    at, most = listed.columns.index("chunks"), listed.columns.index("most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                yield some.set_column(at, "chunks", _by_slices(lambda x, n: merged_small(x, least, n), some.column(at), some.column(most)))

    return listed.mapInArrow(run, listed.schema)


def merge_small(chunks: DataFrame, least: int = 100, most: int | Column = 900, carry: tuple[str, ...] = ()) -> DataFrame:
    """Numbered chunks of each text merged in order; `most` may be a column, one value a text, as may the columns `carry`.

    The order decides, so a text's chunks meet on one row; where they still are on one, merge_lists() moves nothing.
    """
    limit = F.lit(most) if isinstance(most, int) else most
    together = chunks.withColumn("most", limit.cast("long")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("c"), F.first("most").alias("most"), *(F.first(c).alias(c) for c in carry))
    listed = together.select("doc_id", *carry, "most", F.transform("c", lambda x: x["chunk"]).alias("chunks"))
    return numbered(merge_lists(listed, least), carry)


def drop_silent_chunks(chunks: DataFrame, lang: Column) -> DataFrame:
    """Chunks that can be heard; the others leave a gap in the numbers."""
    return chunks.where((go_trim(F.col("chunk")) != "") & is_speakable(F.col("chunk"), lang))


def silent_chapters(chapters: DataFrame) -> DataFrame:
    """Chapters without speakable text stay, as placeholders of a second."""
    return chapters.withColumn("duration_ms", F.when(~is_speakable(F.col("content"), F.col("language")), F.lit(1000)))
