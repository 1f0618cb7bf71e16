"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. A bundle ends in a skippable
frame with the seek table (compressed and plain size of each frame), and an index gives for
each record the frame and the place inside it, so that one record is one small ranged read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import keep, scratch

#: Fixed values of the seekable format: a skippable frame's first magic number, the footer's magic number.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: A frame is closed after so many plain bytes, a bundle after so many compressed ones.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20

INDEX_SCHEMA = "record_id long, bundle string, frame int, place long, length long"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds kind (response or revisit) and refers_to to page_id, url, html.

    Of records with equal payloads of at least `least_bytes` bytes the one with the smallest
    page_id is the response. Payloads meet by digest; the digests' minimum is aggregated before
    the shuffle and joined back, so a payload that fills a third of the table is an ordinary
    skewed join. Rows that repeat the smallest page_id are all responses; null html is an empty
    payload; a null page_id never becomes the target of a revisit unless nothing else is there.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), payload.alias("payload")).withColumn("_sha", F.sha1("payload"))
    first = named.where(F.octet_length("payload") >= least_bytes).groupBy("_sha").agg(F.min("page_id").alias("_first"))
    joined = named.join(first, "_sha", "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("_first")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, payload: bytes) -> bytes:
    name = lambda n: f"<urn:x-page:{'' if n is None else n}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {' '.join((url or '').split())}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    body = b"" if kind == "revisit" else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _parse(data: memoryview, at: int) -> tuple[dict, int]:
    """The record at a place of a plain frame and the place after it."""
    whole = bytes(data[at : at + 65536])
    while (end := whole.find(b"\r\n\r\n")) < 0:
        if at + len(whole) >= len(data):
            raise ValueError("a record's head has no end")
        whole = bytes(data[at : at + 2 * len(whole)])
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in whole[:end].decode().split("\r\n")[1:])
    start, size = at + end + 4, int(head["Content-Length"])
    number = lambda s: int(n) if (n := s.removeprefix("<urn:x-page:").removesuffix(">")) else None
    body, digest = bytes(data[start : start + size]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    if len(body) != size or head["WARC-Type"] == "response" and sha1_base32(body) != digest:
        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    back = number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
    row = {"page_id": number(head["WARC-Record-ID"]), "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": back, "target_uri": head["WARC-Target-URI"], "payload": body if head["WARC-Type"] == "response" else None}
    return row, start + size + 4


class _Bundle:
    """Writes frames to one file, which gets its name only when it is whole."""

    def __init__(self, folder: str):
        self.store, root = pafs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.name = f"part-{uuid.uuid4().hex}.warc.zst"
        self.place, self.part = f"{root}/{self.name}", f"{root}/.{self.name}.part"
        self.out, self.frames, self.index, self.plain, self.written = self.store.open_output_stream(self.part), [], [], bytearray(), 0
        self.press = zstandard.ZstdCompressor(level=3, write_content_size=True)

    def add(self, record_id: int | None, data: bytes) -> None:
        self.index.append((record_id, len(self.frames), len(self.plain), len(data)))
        self.plain += data
        if len(self.plain) >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.plain:
            packed = self.press.compress(bytes(self.plain))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.plain)))
            self.written += len(packed)
            self.plain = bytearray()

    def close(self) -> pa.RecordBatch:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(footer)) + footer)
        self.out.close()
        self.store.move(self.part, self.place)
        ids, frames, places, lengths = zip(*self.index, strict=True)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array([self.name] * len(ids)), pa.array(frames, pa.int32()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64())], ["record_id", "bundle", "frame", "place", "length"])


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Writes plan_records() rows to bundles below a folder that all executors share; returns the index.

    The index is kept as a table, so bundles are written once; it alone says which files count.
    A task that is run again writes files of other names, and those of the lost attempt are in
    no index. Memory: one frame and one batch a task, whatever the number of records. An empty
    table writes no file and gives an empty index.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for row in batch.to_pylist():
                bundle = bundle or _Bundle(folder)
                bundle.add(row["page_id"], _record(row["page_id"], row["url"], row["kind"], row["refers_to"], row["payload"]))
                if bundle.written >= BUNDLE_BYTES:
                    yield bundle.close()
                    bundle = None
        if bundle:
            yield bundle.close()

    return keep(records.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def seek_table(handle, size: int) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of a bundle's frames, from its last bytes."""
    handle.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", handle.read(9))
    if magic != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    handle.seek(size - 9 - 8 * count)
    sizes, out, at = struct.unpack(f"<{2 * count}I", handle.read(8 * count)), [], 0
    for packed, plain in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((at, packed, plain))
        at += packed
    return out


def _frame(handle, entry: tuple[int, int, int]) -> memoryview:
    handle.seek(entry[0])
    return memoryview(zstandard.ZstdDecompressor().decompress(handle.read(entry[1]), max_output_size=entry[2]))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def read_bundles(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Reads all records of the bundles that an index names, a frame at a time."""
    spark: SparkSession = index.sparkSession
    frames = index.groupBy("bundle", "frame").agg(F.count("*").alias("n"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in sorted(batch.to_pylist(), key=lambda x: (x["bundle"], x["frame"])):
                place = f"{root}/{row['bundle']}"
                with store.open_input_file(place) as handle:
                    data = _frame(handle, seek_table(handle, handle.size())[row["frame"]])
                at, rows = 0, []
                while at < len(data):
                    record, at = _parse(data, at)
                    rows.append(record if payloads else record | {"payload": None})
                if len(rows) != row["n"]:
                    raise ValueError(f"frame {row['frame']} of {place} holds {len(rows)} records, its index {row['n']}")
                yield _batch(rows)

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return frames.repartition(width, "bundle", "frame").mapInArrow(read, RECORD_SCHEMA)


def read_records(index: DataFrame, folder: str, wanted: Column) -> DataFrame:
    """Only the records that `wanted` picks from the index: a ranged read of their frames."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['bundle']}") as handle:
                    yield _batch([_parse(_frame(handle, seek_table(handle, handle.size())[row["frame"]]), row["place"])[0]])

    return index.where(wanted).mapInArrow(read, RECORD_SCHEMA)


def archive_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes all pages to bundles in the shared folder and reads them back."""
    folder = scratch(pages.sparkSession, "warc")
    index = write_bundles(plan_records(pages, least_bytes), folder)
    return read_bundles(index, folder, payloads=False)
