"""Job events as streams.

Every operator is a streaming DataFrame in, a streaming DataFrame out; run_available() drives one
over all that is there and returns what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions.folders import shared_folder
from lectern.operators.jobs import ranked_rows, upsert


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, with ts as a timestamp that watermarks accept."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path[:-1] + "[t]").withColumn("ts", F.col("ts").cast("timestamp"))


#: Events for which a batch of arrivals() has one more file, so that many tasks write it.
FILE_EVENTS = 4_000_000


def arrivals(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """The events as they might arrive: in `batches` micro-batches of one file each, or as many as each needs, some events one or two batches after their turn."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder, (last, count) = shared_folder(spark, "arrivals"), events.agg(F.max("event_id"), F.count("*")).first()
    turn = F.floor(F.col("event_id") * batches / F.lit((last or 0) + 1)) + F.when(F.col("event_id") % 7 == 3, 1).when(F.col("event_id") % 11 == 5, 2).otherwise(0)
    files = 1 + count // FILE_EVENTS
    for n in range(batches):
        rows = events.where(F.least(turn, F.lit(batches - 1)) == n)
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_available(stream: DataFrame, mode: str, write, folder: str) -> None:
    """Runs a stream over what is there, batch by batch through `write`, with state in RocksDB: it may be larger than memory."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, ROCKSDB)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    query.awaitTermination()


def _local_times(rows: DataFrame) -> DataFrame:
    times = [f.name for f in rows.schema if f.dataType.typeName() == "timestamp"]
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times}) if times else rows


def run_available(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what is there and returns its rows. Append keeps all batches, each in a folder of its number; complete the last one."""
    spark, out = stream.sparkSession, shared_folder(stream.sparkSession, name)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        last.append(number)

    start_available(stream, mode, write, out)
    if not last:
        return _local_times(spark.createDataFrame([], stream.schema))
    chosen = last[-1:] if mode == "complete" else sorted(set(last))
    return _local_times(spark.read.schema(stream.schema).parquet(*(f"{out}/rows/batch={n}" for n in chosen)))


class Upserts:
    """A table of rows by key that a stream's batches change; writing a batch again changes nothing.

    Each batch's changes are a folder of their own, replaced as a whole, so only they are written. What a
    key's row is, the last batch with it says. Each `every` batches the changes since the last base
    are merged into a new one, so reading looks at that and a few batches.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, keys: list[str], every: int = 8):
        self.spark, self.folder, self.schema, self.keys, self.every = spark, folder, schema, keys, every
        self.batches: list[int] = []
        self.base = -1

    def write(self, batch: DataFrame, number: int) -> None:
        if number <= self.base:
            return  # merged before
        batch.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={number}")
        self.batches = sorted({*self.batches, number})
        if number % self.every == self.every - 1:
            self.read().write.mode("overwrite").parquet(f"{self.folder}/base/upto={number}")
            self.batches, self.base = [], number

    def read(self) -> DataFrame:
        read = lambda path: self.spark.read.schema(self.schema).parquet(path)
        now = read(f"{self.folder}/base/upto={self.base}") if self.base >= 0 else self.spark.createDataFrame([], self.schema)
        if not self.batches:
            return now
        rows = [read(f"{self.folder}/changes/batch={n}").withColumn("_batch", F.lit(n)) for n in self.batches]
        changes = reduce(DataFrame.unionByName, rows)
        value = F.struct("_batch", *(c for c in now.columns if c not in self.keys))
        last = changes.groupBy(*self.keys).agg(F.max(value).alias("_v")).select(*(F.col(c) if c in self.keys else F.col(f"_v.{c}") for c in now.columns))
        return upsert(now, last, self.keys, keep_first="")


def run_upserts(stream: DataFrame, keys: list[str], name: str, every: int = 8) -> DataFrame:
    """Runs a stream in update mode over what is there into a table by key, and returns the table."""
    spark, out = stream.sparkSession, shared_folder(stream.sparkSession, name)
    table = Upserts(spark, f"{out}/table", stream.schema, keys, every)
    start_available(stream, "update", table.write, out)
    return _local_times(table.read())


def run_intake(stream: DataFrame, order: list[str], name: str) -> DataFrame:
    """Runs a stream over what is there and returns its rows with batch and place: oldest first in each batch, by `order`.

    A batch is a folder of its own, replaced as a whole if it comes again; places are given by ranges of the order.
    """
    spark, out = stream.sparkSession, shared_folder(stream.sparkSession, name)
    written: set[int] = set()

    def write(batch: DataFrame, number: int) -> None:
        ranked_rows(batch, [F.asc_nulls_first(c) for c in order], "place").withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/rows/batch_no={number}")
        written.add(number)

    start_available(stream, "append", write, out)
    if not written:
        return _local_times(spark.createDataFrame([], stream.schema)).withColumns({"place": F.lit(0).cast("long"), "batch": F.lit(0).cast("long")})
    return _local_times(spark.read.parquet(*(f"{out}/rows/batch_no={n}" for n in sorted(written))))


def latest_state(events: DataFrame) -> DataFrame:
    """Each job's last event by (ts, event_id)."""
    last = F.max(F.struct("ts", "event_id", "status"))
    return events.groupBy("job_id").agg(last.alias("l")).select("job_id", "l.ts", "l.event_id", "l.status")


def pending_intake(events: DataFrame) -> DataFrame:
    """Pending events; run_intake() puts each batch in order, oldest first."""
    return events.where("status = 'pending'").select("job_id", "event_id", "ts")


def unexpired(events: DataFrame, ttl: str = "5 minutes") -> DataFrame:
    """Each event once; its repeats within the time to live are dropped, late events expire."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["event_id"])


def counters(events: DataFrame) -> DataFrame:
    """Events an hour and status."""
    counted = events.groupBy(F.window("ts", "1 hour").alias("w"), "status").agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("hour"), "status", "events")


def gauges(events: DataFrame) -> DataFrame:
    """The last value of each name and set of labels; labels go by sorted entries."""
    labels = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))
    last = F.max(F.struct("ts", "event_id", "value"))["value"]
    return events.groupBy("name", labels.alias("labels")).agg(last.alias("value"))


#: What a job's event carries while it waits for its turn, and a time that never comes.
_EVENT = np.dtype([("us", "i8"), ("event_id", "i8"), ("value", "f8")])
_LATER = 1 << 62


class InOrder:
    """Takes each job's events by (ts, event_id), whatever batch they came in, once the watermark has passed them.

    A job's state is one value: its waiting events, 24 bytes each, and the few numbers of `now`. States go to
    Python and back beside the rows, many jobs at a time. An event that comes when the watermark has
    passed it is late and expires. What is held of a job is what its last `delay` brought. Subclasses
    say what an event does (take) and what the watermark does when no event comes (pass_time).
    """

    #: The schema of `now`, and its value before the first event.
    now_schema, begin = "n long", (0,)
    columns = ["job_id", "event_id"]

    def take(self, job: object, now: tuple, ts: int, event: int, value: float) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def pass_time(self, job: object, now: tuple, watermark: int) -> tuple[tuple, list[tuple], int]:
        """The new `now`, rows, and the time (ms) to look again."""
        return now, [], _LATER

    def run(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held, *now = state.get if state.exists else (b"", *self.begin)
        came = [np.frombuffer(bytes(held), _EVENT)]
        if not state.hasTimedOut:
            for batch in rows:
                new = np.empty(len(batch), _EVENT)
                for name in _EVENT.names:
                    new[name] = batch[name].to_numpy()
                came.append(new[new["us"] // 1000 > watermark])
        # of an event that comes twice the last one counts
        waiting = np.concatenate(came)[::-1]
        waiting = waiting[np.unique(waiting[["us", "event_id"]], return_index=True)[1]]
        ends = int(np.searchsorted(waiting["us"] // 1000, watermark, "right"))
        now, out = tuple(now), []
        for us, event, value in waiting[:ends].tolist():
            now, made = self.take(key[0], now, us, event, value)
            out += made
        now, made, again = self.pass_time(key[0], now, watermark)
        waiting = waiting[ends:]
        state.update((waiting.tobytes(), *now))
        # a state times out when the watermark is over its time
        waits = min(again, int(waiting["us"][0]) // 1000 if len(waiting) else _LATER)
        if waits < _LATER:
            state.setTimeoutTimestamp(max(waits - 1, watermark, 1))
        if out or made:
            yield pd.DataFrame(out + made, columns=self.columns)


class _Throttle(InOrder):
    now_schema, begin, columns = "last double", (float("-inf"),), ["job_id", "event_id", "value"]

    def __init__(self, step: float):
        self.step = step

    def take(self, job, now, ts, event, value):
        return ((value,), [(job, event, value)]) if value >= now[0] + self.step else (now, [])


class _Save(InOrder):
    """value: the job's number of chapters."""

    columns = ["job_id", "event_id", "progress"]

    def __init__(self, every: int, step: int):
        self.every, self.step = every, step

    def take(self, job, now, ts, event, value):
        n, total, step = now[0] + 1, int(value), self.step
        # in whole numbers, so that a tenth is a tenth
        save = n % self.every == 0 or step * n >= total and step * n // total > max(0, step * n - total) // total
        return (n,), [(job, event, n / total)] if save else []


class _Previews(InOrder):
    """now: when the open preview opened, its last event, and how many it has; none: no events."""

    now_schema, begin, columns = "opened long, ended long, events long", (0, 0, 0), ["job_id", "opened", "ended", "events"]

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def take(self, job, now, ts, event, value):
        ms, (opened, ended, n) = ts // 1000, now
        if n and ms - ended > self.ttl:
            return (ms, ms, 1), [(job, opened, ended, n)]
        return (opened if n else ms, ms, n + 1), []

    def pass_time(self, job, now, watermark):
        if now[2] and now[1] + self.ttl <= watermark:
            return self.begin, [(job, *now)], _LATER
        return now, [], now[1] + self.ttl if now[2] else _LATER


def _in_order(events: DataFrame, value: str, processor: InOrder, schema: str, delay: str) -> DataFrame:
    timed = events.withWatermark("ts", delay).select("job_id", "event_id", F.unix_micros("ts").alias("us"), F.col(value).cast("double").alias("value"), "ts")
    return timed.groupBy("job_id").applyInPandasWithState(processor.run, schema, f"held binary, {processor.now_schema}", "append", GroupStateTimeout.EventTimeTimeout)


def throttled(progress: DataFrame, step: float = 0.1, delay: str = "5 minutes") -> DataFrame:
    """Progress (job_id, event_id, value) in order of (ts, event_id): a job's first, and each at least `step` over the last one let through."""
    return _in_order(progress, "value", _Throttle(step), "job_id long, event_id long, value double", delay)


def saved_progress(done: DataFrame, every: int = 5, step: int = 10, delay: str = "5 minutes") -> DataFrame:
    """Finished chapters (job_id, event_id, ts, total) of a job at which its progress is saved: each `every`th, and where it passes a tenth."""
    return _in_order(done, "total", _Save(every, step), "job_id long, event_id long, progress double", delay)


def ttl_previews(events: DataFrame, ttl_ms: int = 300_000, delay: str = "5 minutes") -> DataFrame:
    """(job_id, opened, ended, events): previews that close when no event came for their time to live, by event time.

    The last preview of a job closes when the watermark is its time to live past it; until then it is open.
    """
    return _in_order(events, "event_id", _Previews(ttl_ms), "job_id long, opened long, ended long, events long", delay)
