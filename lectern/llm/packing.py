"""Best-fit packing of tokenised documents by minimum bin slack.

Documents become token ids and, where longer than a sequence, pieces. What fits together
depends on lengths alone, so the plan is made on the histogram of lengths (at most `cap` rows,
whatever the corpus): the longest length left opens a sequence, a bitset subset-sum programme
over the lengths still available finds the fullest combination with it, and the combination is
repeated as often as its lengths last. Pieces then find their place by their rank among the
pieces of their length.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import keep

#: White-space runs never belong to a token, so the words between them can be encoded one by one
#: and remembered; these strings make an exception (controls that only str.split() takes for
#: white space, and what may spell a special token).
UNSAFE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Marks that never join the letters or digits before them in a token; the apostrophe does.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that a worker remembers.
REMEMBERED = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def _byte_letters() -> dict[int, int]:
    """How byte-level models spell bytes: visible Latin-1 characters as themselves, the rest from U+0100 on in order."""
    hidden = (b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))
    return {b: 256 + i for i, b in enumerate(hidden)}


_SPELL = _byte_letters()
#: Letters up to here are one character in every normal form that composes.
_LAST = "\u024f"


class _Encoder:
    """Encodes texts word by word and remembers words.

    A word of letters, and marks after it, is one model token sequence for its small letters and
    one for its marks, if the tokenizer is of that kind; a few words tell whether it is. Any other
    word is encoded in full.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.by_letters = Tokenizer.from_file(path), {}, True
        told = ["The", "STRASSE", "stra\u00dfe,", "\u00c9t\u00e9!!", "ci\u00f3n.", "a", "x)*", "\u00f1\u00fc\u00e7", "don't", "9lives;"]
        try:
            self.by_letters = all(self._word(w) == self._full(w) for w in told)
        except Exception:  # a model without tokenize()
            self.by_letters = False
        self.known.clear()

    def _full(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        low = core.lower()
        if not (self.by_letters and low.isalpha() and max(low) <= _LAST):
            return self._full(word)
        if (ids := self.known.get(low)) is None:
            spelt = low if low.isascii() else low.encode().decode("latin-1").translate(_SPELL)
            ids = self.known[low] = array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()
        if len(core) < len(word):
            marks = word[len(core) :]
            if (after := self.known.get(marks)) is None:
                after = self.known[marks] = self._full(marks)
            ids += after
        return ids

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as unsigned 32-bit numbers."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for text in texts:
            if any(u in text for u in UNSAFE):
                yield self._full(text)
                continue
            words = text.split()
            for word in set(words).difference(known):
                known[word] = self._word(word)
            yield b"".join(map(known.__getitem__, words))


_encoders: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """One per worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, cap: int = 4096, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of at most `cap` token ids of every document (null text: empty), each ending in end_id.

    Only documents longer than `cap` are cut; all their pieces but the last are full. A repeated
    row gives its pieces again. ids is null unless asked for.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    for n, start in enumerate(range(0, len(ids), 4 * cap)):
                        own = ids[start : start + 4 * cap]
                        rows.append((doc, n, start // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<i4") if with_ids else None))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(cut, PIECES)


def fullest(available: list[tuple[int, int]], room: int) -> dict[int, int]:
    """How often to take each length so that their sum is the largest of at most `room`.

    available: (length, count), longest first. Bit i of the set is on if some choice sums to i;
    a length's count goes in by doubling steps, and the sets before each length lead back.
    """
    sums, mask, trail = 1, (1 << (room + 1)) - 1, []
    for length, count in available:
        most = min(count, room // length)
        if not most:
            continue
        trail.append((length, most, sums))
        step = 1
        while most > 0:
            now = min(step, most)
            sums |= (sums << (now * length)) & mask
            most -= now
            step *= 2
        if sums >> room & 1:
            break
    left, taken = sums.bit_length() - 1, {}
    for length, most, before in reversed(trail):
        n = next(n for n in range(most + 1) if left >= n * length and before >> (left - n * length) & 1)
        if n:
            taken[length] = n
            left -= n * length
    return taken


def plan_bins(counts: dict[int, int], cap: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how often}) until every length is used up; the longest left is always in.

    A combination is repeated until one of its lengths no longer suffices, so there are at most a
    few combinations per length, however many pieces there are.
    """
    left, out = {k: v for k, v in counts.items() if v}, []
    order = sorted(left, reverse=True)
    while left:
        order = [k for k in order if k in left]
        first = order[0]
        rest = [(k, left[k] - (k == first)) for k in order if k <= cap - first]
        take = fullest(rest, cap - first)
        take[first] = take.get(first, 0) + 1
        times = min(left[k] // n for k, n in take.items())
        out.append((times, take))
        for k, n in take.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def slots(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, how many a sequence, first sequence, first offset)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, take in plan:
        offset = 0
        for length in sorted(take, reverse=True):
            n, at = take[length], used.get(length, 0)
            out.append((length, at, at + n * times, n, sequence, offset))
            used[length] = at + n * times
            offset += n * length
        sequence += times
    return out


#: Parts of each length at least, and pieces of one length that a window ranks at a time, at most on average.
PARTS, RANKED = 64, 100_000


def salted(pieces: DataFrame) -> DataFrame:
    """Pieces with a number that spreads them, repeated rows too; it must be kept, as it isn't the same in another run."""
    return pieces.withColumn("_salt", F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()))


def place(kept: DataFrame, cap: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to kept salted() pieces (their length column is 1 to cap).

    Ranks within a length are ranks within one of its hashed parts plus the sizes of the parts
    before, so a length that a third of all pieces share is no group of one task. Broadcast: the
    slots, a few per length, so at most a few times `cap` rows. An empty table stays empty.
    """
    spark, pieces = kept.sparkSession, [c for c in kept.columns if c != "_salt"]
    counts = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = max(PARTS, -(-max(counts.values(), default=0) // RANKED))
    parted = kept.withColumn("_part", F.pmod("_salt", F.lit(parts)))
    sizes = parted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_part")) - F.col("_n")).drop("_n")
    kind = "length long, _first long, _end long, _each long, _sequence long, _offset long"
    places = F.broadcast(spark.createDataFrame(slots(plan_bins(counts, cap)), kind))
    inner = F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "piece", "_salt")) - 1
    ranked = parted.withColumn("_rank", inner).join(before, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(places, "length").where("_rank >= _first AND _rank < _end")
    turn = F.col("_rank") - F.col("_first")
    sequence = F.col("_sequence") + F.floor(turn / F.col("_each"))
    offset = F.col("_offset") + (turn % F.col("_each")) * F.col("length")
    return placed.withColumns({"sequence_id": sequence, "offset": offset}).select(*pieces, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, cap: int = 4096, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Null text is empty: its one id is end_id. Of a text of any length all pieces come; repeated rows
    are placed each; an empty table gives none. Only doc_id and text are read, whatever else there is.
    """
    return place(keep(salted(token_pieces(docs, tokenizer_path, cap, end_id, with_ids)), "pieces"), cap)
