"""Repair of conversations by iterative-deepening A*.

A conversation's rows are edited in order, each kept, given another role or deleted, and rows may be
inserted, until role initials read (s?(ua)+)?. The search goes depth first through the edits in ASCII
order of their initials, under a bound on cost plus an admissible estimate of what is still to pay;
states that failed with as much left to spend aren't tried again, and the bound rises to the least
sum that went over it. So the first accepting path is the cheapest, and of those the ASCII-least.

Long conversations are cut into segments, each searched for every pair of grammar states at its
ends; a fold over these results chooses among them, so no task searches a whole long conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import keep

#: Grammar states: nothing yet, after s, after u, after a. What may follow, and where insertions and new roles lead.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
TURN = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
#: Rows of a segment.
SEGMENT = 24

ROW = "struct<turn:bigint,role:string,text:string,fault:string>"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by crc32 of `conv_id:turn` modulo 20, null values read as one space.

    0 drops a row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes it the user's. conv_id
    and turn stay as they are. Repeated rows are damaged alike; other columns are left out.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    own = rows.where(kind != 0).select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("n"))
    return own.withColumn("n", F.explode(F.array_repeat("turn", F.col("n")))).drop("n")


def estimates(rows: list[tuple[str, str]], legal: tuple[str, ...] = LEGAL) -> list[int]:
    """Of each suffix of (role initial, fault), twice a cost that any repair of it has at least.

    What each row costs at its cheapest, and for each pair of rows to be kept that may not follow each
    other half of the cheapest edit of one of them beyond that, as an edit mends two pairs at most.
    """
    out, after = [0] * (len(rows) + 1), None
    for i in range(len(rows) - 1, -1, -1):
        initial, fault = rows[i]
        if fault in ("blank", "duplicate"):
            out[i] = out[i + 1] + 2 * DELETE
            continue
        out[i] = out[i + 1] + (2 * TRUNCATED if fault else 0)
        if after is not None and initial + after[0] not in legal:
            out[i] += min(DELETE - TRUNCATED, INSERT) if fault or after[1] else min(DELETE, REROLE, INSERT)
        after = rows[i]
    return out


def search(rows: list[tuple[str, str]], begin: int, end: int) -> tuple[int, str]:
    """The least cost of editing rows (role initial, fault) from one grammar state to another, and the ASCII-least such edits.

    end may be USER or ASSISTANT, which insertions reach from anywhere, or START from START, if all rows go.
    """
    left = estimates(rows)
    n, bound = len(rows), left[0]

    def moves(i: int, state: int) -> list[tuple[str, int, int, int]]:
        """(initial, next row, next state, twice the cost), the last to try first."""
        out = []
        if i < n:
            initial, fault = rows[i]
            if fault not in ("blank", "duplicate"):
                late = TRUNCATED if fault else 0
                out.append(("R", i + 1, TURN[state], 2 * (REROLE + late)))
                if initial in FOLLOWS[state]:
                    out.append(("K", i + 1, FOLLOWS[state][initial], 2 * late))
        out.append(("I", i, TURN[state], 2 * INSERT))
        if i < n:
            out.append(("D", i + 1, state, 2 * DELETE))
        return out

    while True:
        failed: dict[tuple[int, int], int] = {}
        beyond, path = None, []
        stack = [(0, begin, 0, moves(0, begin))]
        if n == 0 and begin == end:
            return 0, ""
        while stack:
            i, state, spent, open_moves = stack[-1]
            if not open_moves:
                failed[i, state] = max(failed.get((i, state), -1), bound - spent)
                stack.pop()
                if path:
                    path.pop()
                continue
            letter, j, new, cost = open_moves.pop()
            total = spent + cost
            if total + left[j] > bound:
                beyond = total + left[j] if beyond is None else min(beyond, total + left[j])
                continue
            if failed.get((j, new), -1) >= bound - total:
                continue
            path.append(letter)
            if j == n and new == end:
                return total // 2, "".join(path)
            stack.append((j, new, total, moves(j, new)))
        bound = beyond


def ways(rows: list[tuple[str, str]]) -> list[tuple[int, int, int, str]]:
    """(begin, end, cost, edits) of a segment, for all grammar states at its ends that a repair may pass.

    Ends before any turn is kept leave one way each, written down without a search: all rows go, or all
    but a system turn, the cheapest and of those the last.
    """
    n = len(rows)
    gone = (DELETE * n, "D" * n)
    out = [(START, START, *gone), (SYSTEM, SYSTEM, *gone)]
    kept = [(DELETE * (n - 1) + (TRUNCATED if fault else 0), -i) for i, (initial, fault) in enumerate(rows) if initial == "s" and fault in ("", "truncated")]
    if kept:
        cost, i = min(kept)
        out.append((START, SYSTEM, cost, "D" * -i + "K" + "D" * (n - 1 + i)))
    return out + [(b, e, *search(rows, b, e)) for b in range(4) for e in (USER, ASSISTANT)]


def apply(rows: list[tuple[str, str]], edits: str, begin: int) -> list[str]:
    """The repaired `role:text` lines of (role, text) rows."""
    out, i, state = [], 0, begin
    for letter in edits:
        if letter == "K":
            out.append(f"{rows[i][0]}:{rows[i][1]}")
            state = FOLLOWS[state][rows[i][0][:1]]
        elif letter != "D":
            state = TURN[state]
            out.append(f"{NAMES[state]}:{rows[i][1] if letter == 'R' else ''}")
        i += letter != "I"
    return out


_SUMMARY = "conv_id {}, seg long, turns long, first_turn long, last_turn long, least long, most long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long, ways array<struct<begin:int,end:int,cost:bigint,edits:string>>"


def _segments(damaged: DataFrame) -> DataFrame:
    """(conv_id, seg, rows): runs of a conversation's rows, in order by seg, each with its first fault.

    Rows are dealt out by ranges of their order, so a conversation of any length lies in many tasks.
    """
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    marked = damaged.withColumn("digest", digest)
    first = marked.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(F.struct(F.col("turn"))).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    later = F.coalesce(F.col("turn") > F.col("_first.turn"), F.col("turn").isNotNull() & F.col("_first.turn").isNull())
    rows = marked.join(first, same).select("conv_id", "turn", "role", "text", later.alias("later"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = damaged.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, held, now, before = TaskContext.get().partitionId() << 32, [], None, None
        schema = None

        def done() -> pa.RecordBatch:
            values = [[now], [seg], [held]]
            return pa.record_batch([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            row = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("seg", pa.int64()), ("rows", pa.list_(row))])
            for conv, turn, role, text, later in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (conv != now or len(held) >= SEGMENT):
                    yield done()
                    seg, held = seg + 1, []
                # rows alike in all lie next to each other, in one task
                again = later or before == (conv, turn, role, text)
                held.append({"turn": turn, "role": role, "text": text, "fault": fault(text, again)})
                now, before = conv, (conv, turn, role, text)
        if held:
            yield done()

    return keep(sorted_.mapInArrow(run, f"conv_id {kind}, seg long, rows array<{ROW}>"), "repair-segments")


_LAST = re.compile(r"[^\x20\x09-\x0D]")


def fault(text: str, again: bool) -> str:
    """A row's first fault, or none."""
    said = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
    if not said:
        return "blank"
    return "duplicate" if again else "" if said[-1] in ".!?" else "truncated"


def repair(damaged: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conv_id of `conversations` its faults, the cost and edits of its cheapest repair, and the repaired text's digest.

    damaged: (conv_id, turn, role, text) without nulls but in conv_id and turn; rows go by turn, nulls
    first, then role and text. Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. A conversation without rows has zeros, no edits and the digest of an empty string;
    a null conv_id is one conversation. Texts are whole, one value each; a conversation's edits and
    its repaired text are one value too. An empty table gives no rows; other columns are left out.
    """
    segments = _segments(damaged)
    kind = damaged.schema["conv_id"].dataType.simpleString()
    summary = _SUMMARY.format(kind)
    way = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    special = {"first_role": pa.string(), "last_role": pa.string(), "ways": pa.list_(way)}
    kinds = pa.schema([(n, special.get(n, pa.int64())) for n in (x.split(" ")[0] for x in summary.split("array<")[0].split(", "))])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column("rows").to_pylist():
                turns = [r["turn"] for r in rows]
                known = [t for t in turns if t is not None]
                roles, faults = [r["role"][:1] for r in rows], [r["fault"] for r in rows]
                illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
                counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
                found = [dict(zip(("begin", "end", "cost", "edits"), w, strict=True)) for w in ways(list(zip(roles, faults, strict=True)))]
                out.append((len(set(known)), turns[0], turns[-1], min(known, default=None), max(known, default=None), roles[0], roles[-1], *counts, illegal, found))
            columns = [pa.array(c, kinds.field(n).type) for n, c in zip(kinds.names[2:], zip(*out, strict=True), strict=True)] if out else []
            if columns:
                yield pa.record_batch([batch.column("conv_id"), batch.column("seg"), *columns], schema=pa.schema([pa.field("conv_id", batch.schema.field("conv_id").type), *[kinds.field(n) for n in kinds.names[1:]]]))

    chosen = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<seg:bigint,begin:int,edits:string>>"

    @F.pandas_udf(chosen)
    def fold(lists: pd.Series) -> pd.DataFrame:
        out = []
        for parts in lists:
            turns, illegal, before = 0, 0, None
            best: dict[int, tuple] = {START: (0, "", ())}
            for p in parts:
                turns += p["turns"]
                if before is not None:
                    turns -= p["first_turn"] is not None and before["last_turn"] == p["first_turn"]
                    illegal += before["last_role"] + p["first_role"] not in LEGAL
                before, reached = p, {}
                for w in p["ways"]:
                    if w["begin"] in best:
                        cost, edits, steps = best[w["begin"]]
                        way = (cost + w["cost"], edits + w["edits"], (*steps, (w["begin"], w["edits"])))
                        if w["end"] not in reached or way[:2] < reached[w["end"]][:2]:
                            reached[w["end"]] = way
                best = reached
            cost, audit, steps = min((best[s] for s in (START, ASSISTANT) if s in best), key=lambda x: x[:2])
            least = [p["least"] for p in parts if p["least"] is not None]
            gaps = max(p["most"] for p in parts if p["most"] is not None) - min(least) + 1 - turns if least else 0
            sums = [sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")]
            out.append((gaps, *sums, illegal + sum(p["illegal"] for p in parts), cost, audit, [{"seg": p["seg"], "begin": b, "edits": e} for p, (b, e) in zip(parts, steps, strict=True)]))
        return pd.DataFrame(out, columns=[x.split(" ")[0] for x in chosen.split(", ")])

    summaries = segments.mapInArrow(summarise, summary)
    columns = [c for c in summaries.columns if c != "conv_id"]
    folded = keep(summaries.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("l")).select("conv_id", fold("l").alias("f")).select("conv_id", "f.*"), "repair-folded")

    @F.pandas_udf("array<string>")
    def repaired(rows: pd.Series, begins: pd.Series, edits: pd.Series) -> pd.Series:
        return pd.Series([apply([(r["role"], r["text"]) for r in x], e, b) for x, b, e in zip(rows, begins, edits, strict=True)], dtype=object)

    steps = folded.select(F.explode("parts").alias("p")).select("p.*")
    lines = segments.join(steps, "seg").select("conv_id", "seg", repaired("rows", "begin", "edits").alias("lines"))
    said = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "lines"))).alias("l"))
    text = said.select(F.col("conv_id").alias("_said"), F.sha2(F.array_join(F.flatten(F.transform("l", lambda x: x["lines"])), "\n"), 256).alias("repaired_sha256"))
    whole = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    joined = whole.join(folded, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").join(text, F.col("_conv").eqNullSafe(F.col("_said")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("_conv").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
