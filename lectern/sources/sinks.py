"""Chapter texts and metadata documents."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lectern.functions.text import replace_all
from lectern.operators.cleaning import file_name


def chapter_file(chapter_no: Column, title: Column) -> Column:
    return F.concat(F.lpad(chapter_no.cast("string"), 4, "0"), F.lit("_"), file_name(title), F.lit(".txt"))


def write_chapter_text(chapters: DataFrame, path: str) -> None:
    """Text files by book, chapters as lines in order; the file column names what one chapter's file would be."""
    named = chapters.withColumn("file", chapter_file(F.col("chapter_no"), F.col("title")))
    named.repartition("book_id").sortWithinPartitions("book_id", "chapter_no").select("book_id", "file", F.replace("content", F.lit("\n"), F.lit(" ")).alias("value")).write.partitionBy("book_id").json(path)


class _ChapterWriter(DataSourceWriter):
    """Tasks write below a folder of their attempt; the commit moves those that count to their part, one rename a task."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.work = f"{self.path}/_attempts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        fs, base = FileSystem.from_uri(self.work)
        own, n, made = f"{base}/{uuid.uuid4().hex}", 0, set()
        for row in rows:
            folder = f"{own}/{row.book}"
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            with fs.open_output_stream(f"{folder}/{row.file}") as out:
                out.write(row.content.encode())
            n += 1
        return _Written(own if n else "")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        name = self.work.rsplit("-", 1)[1]
        for i, message in enumerate(messages):
            if message is not None and message.folder:
                fs.move(message.folder, f"{base}/part-{i:05d}-{name}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, base = FileSystem.from_uri(self.work)
        if fs.get_file_info(base).type != FileType.NotFound:
            fs.delete_dir(base)


@dataclass
class _Written(WriterCommitMessage):
    folder: str


class ChapterFiles(DataSource):
    """Rows (book, file, content) as text files part-…/<book>/<file> below `path`, a URI of a file system that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "chapter_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _ChapterWriter(self.options["path"])


#: Bytes of text, and files, after which a task begins its next archive.
ARCHIVE_BYTES, ARCHIVE_FILES = 64 << 20, 60_000


class _ArchiveWriter(_ChapterWriter):
    """As _ChapterWriter, a task's files in archives 00000.zip, ... of its part."""

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        fs, base = FileSystem.from_uri(self.work)
        own, n, size, files = f"{base}/{uuid.uuid4().hex}", 0, 0, 0
        out = archive = None
        for row in rows:
            if archive is None:
                fs.create_dir(own, recursive=True)
                out = fs.open_output_stream(f"{own}/{n:05d}.zip")
                archive, n, size, files = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), n + 1, 0, 0
            data = row.content.encode()
            archive.writestr(f"{row.book}/{row.file}", data)
            size, files = size + len(data), files + 1
            if size >= ARCHIVE_BYTES or files >= ARCHIVE_FILES:
                archive.close()
                out.close()
                archive = None
        if archive is not None:
            archive.close()
            out.close()
        return _Written(own if n else "")


class ChapterArchives(ChapterFiles):
    """Rows (book, file, content) as text files <book>/<file> in archives part-…/<number>.zip below `path`."""

    @classmethod
    def name(cls) -> str:
        return "chapter_archives"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _ArchiveWriter(self.options["path"])


def _named_files(chapters: DataFrame) -> DataFrame:
    again = F.row_number().over(W.partitionBy("book_id", "chapter_no", "title").orderBy("content"))
    named = F.concat(F.when(again > 1, F.concat(again.cast("string"), F.lit("_"))).otherwise(""), chapter_file(F.col("chapter_no"), F.col("title")))
    return chapters.select(F.coalesce(F.col("book_id").cast("string"), F.lit("none")).alias("book"), named.alias("file"), F.coalesce("content", F.lit("")).alias("content"))


def write_chapter_files(chapters: DataFrame, path: str) -> None:
    """One text file a chapter (book_id, chapter_no, title, content), named by its number and title.

    Files appear when the job commits; what a failed or repeated attempt has written goes. Null contents are empty
    files, chapters of equal names in a book are told apart by what follows their number. A file takes a block of
    its file system at least, so many short chapters belong into write_chapter_archives().
    """
    chapters.sparkSession.dataSource.register(ChapterFiles)
    _named_files(chapters).write.format("chapter_files").mode("append").save(path)


def write_chapter_archives(chapters: DataFrame, path: str) -> None:
    """The files of write_chapter_files() in zip archives of bounded size, which appear on commit likewise."""
    chapters.sparkSession.dataSource.register(ChapterArchives)
    _named_files(chapters).write.format("chapter_archives").mode("append").save(path)


def read_chapter_files(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, file, content) of the files below a path; Spark reads no empty ones, so chapters without content aren't there."""
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.decode("content", "UTF-8").alias("value"), F.split("path", "/").alias("p"))
    book = F.element_at("p", -2)
    return whole.select(F.when(book != "none", book).cast("long").alias("book_id"), F.element_at("p", -1).alias("file"), F.col("value").alias("content"))


def read_chapter_archives(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, file, content) of the files in the archives below a path, empty ones too; tasks read file by file."""
    folder = path.rstrip("/")
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # the part's folder and the archive's name: the rest of the path is spelled in another way than `path` may be
    names = archives.select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("name"))
    kinds = [("book_id", pa.int64()), ("file", pa.string()), ("content", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, at = FileSystem.from_uri(f"{folder}/{name}")
                with fs.open_input_file(at) as source, zipfile.ZipFile(source) as archive:
                    rows, size = [], 0
                    for entry in archive.infolist():
                        book, file = entry.filename.split("/", 1)
                        rows.append((None if book == "none" else int(book), file, archive.read(entry).decode()))
                        size += entry.file_size
                        if size >= 1 << 20 or len(rows) >= 5000:
                            yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])
                            rows, size = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    return names.mapInArrow(run, "book_id long, file string, content string")


def escape_metadata(text: Column) -> Column:
    return replace_all(text, (("\\", "\\\\"), ("=", "\\="), (";", "\\;"), ("#", "\\#"), ("\n", " ")))


#: A book's tags in order, and the columns that they come from.
TAGS = (("title", "title"), ("artist", "author"), ("album_artist", "author"), ("album", "album"), ("grouping", "series"), ("genre", "genre"), ("date", "year"), ("description", "description"), ("comment", "description"))


def book_tags(books: DataFrame) -> Column:
    """The tag lines of a book: empty ones are left out, the album is the title and the genre Audiobook unless given.

    A series has its number behind it. Columns of TAGS, and series_number, that books don't have count as empty.
    """
    own = lambda c: F.coalesce(F.col(c), F.lit("")) if c in books.columns else F.lit("")
    values = {c: own(c) for _, c in TAGS}
    values["album"] = F.when(values["album"] == "", values["title"]).otherwise(values["album"])
    values["genre"] = F.when(values["genre"] == "", "Audiobook").otherwise(values["genre"])
    values["series"] = F.when((values["series"] != "") & (own("series_number") != ""), F.concat(values["series"], F.lit(" #"), own("series_number"))).otherwise(values["series"])
    lines = [F.when(values[c] != "", F.concat(F.lit(f"{tag}="), values[c] if tag == "date" else escape_metadata(values[c]), F.lit("\n"))).otherwise("") for tag, c in TAGS]
    return F.concat(*lines)


def chapter_metadata(timeline: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """(book_id, document): the book's tags and a block per chapter in order.

    books: book_id and the columns of TAGS that are known; without it a book has its number as title alone.
    """
    block = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), escape_metadata(F.col("title")), F.lit("\n"))
    listed = timeline.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_no", block.alias("block")))).alias("b"))
    blocks = F.concat(F.lit("\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n"))
    if books is None:
        return listed.select("book_id", F.concat(F.lit(";FFMETADATA1\ntitle=Book "), F.col("book_id").cast("string"), F.lit("\n"), blocks).alias("document"))
    tagged = books.select(F.col("book_id").alias("_book"), book_tags(books).alias("_tags"))
    joined = listed.join(tagged, F.col("book_id") == F.col("_book"), "left")
    return joined.select("book_id", F.concat(F.lit(";FFMETADATA1\n"), F.coalesce("_tags", F.lit("genre=Audiobook\n")), blocks).alias("document"))
