"""Queue, history, dictionary and provider tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.folders import kept

TERMINAL = ("completed", "failed", "cancelled")


def list_jobs(jobs: DataFrame, status: str = "", most: int = 50) -> DataFrame:
    """The newest jobs, of one status or all; ties go by id."""
    return (jobs.where(F.col("status") == status) if status else jobs).orderBy(F.desc("created_at"), F.desc("id")).limit(most)


def next_pending(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'pending'").orderBy("created_at", "id").limit(1)


def retention(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """What stays when jobs that ended before the cutoff go."""
    return jobs.where(~(F.col("status").isin(*TERMINAL) & (F.col("created_at") < cutoff)))


def retention_counts(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """(kept, gone): how many jobs retention() keeps and how many go."""
    stays = ~(F.col("status").isin(*TERMINAL) & (F.col("created_at") < cutoff))
    return jobs.agg(F.count(F.when(stays, 1)).alias("kept"), F.count(F.when(~F.coalesce(stays, F.lit(False)), 1)).alias("gone"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], keep_first: str = "created_at") -> DataFrame:
    """Changed rows replace those of equal keys, new ones join; `keep_first` stays as it was."""
    b, c = base.alias("b"), changes.alias("c")
    same = reduce(lambda x, y: x & y, (F.col(f"b.{k}") == F.col(f"c.{k}") for k in keys))
    there = F.col(f"c.{keys[0]}").isNotNull()
    value = lambda n: F.coalesce(f"b.{n}", f"c.{n}") if n == keep_first else F.when(there, F.col(f"c.{n}")).otherwise(F.col(f"b.{n}"))
    return b.join(c, same, "full_outer").select(*(value(n).alias(n) for n in base.columns))


def overlay(defaults: DataFrame, custom: DataFrame, keys: list[str]) -> DataFrame:
    """Custom rows and those defaults that none shadows."""
    return defaults.join(custom.select(*keys), keys, "left_anti").unionByName(custom)


def list_dictionary(rows: DataFrame, lang: str = "") -> DataFrame:
    return (rows.where(F.col("lang") == lang) if lang else rows).orderBy("lang", "noun")


def dictionary_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang").agg(F.count("*").alias("entries"))


def ranked_rows(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds each row's place in an order, from 1: dealt out by ranges of it, each task's rows after those of the tasks before.

    A task's share is bounded by the ranges, whatever the keys begin with; only rows alike in all of the
    order stay together. What meets in one place is a count for each range.
    """
    part, at = "_range", "_place"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # written, so that numbers and counts are of the same ranges
    own = kept(dealt.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    counts = own.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(part).alias("_of"), before.alias("_before"))
    placed = own.join(F.broadcast(starts), F.col(part) == F.col("_of"))
    return placed.select(*rows.columns, (F.col(at) + F.col("_before") + 1).cast("long").alias(name))


def ranked(rows: DataFrame, first: str, name: str, descending: bool = False) -> DataFrame:
    """Enabled rows by `first`, then by name, then by what else tells them apart, with their rank."""
    rest = [c for c in rows.columns if c not in (first, name)]
    order = [F.desc_nulls_last(first) if descending else F.asc_nulls_first(first), *(F.asc_nulls_first(c) for c in (name, *rest))]
    return ranked_rows(rows.where("enabled"), order)


def single_default(rows: DataFrame, chosen: int) -> DataFrame:
    return rows.withColumn("is_default", F.col("id") == chosen)


def seed_if_empty(base: DataFrame, defaults: DataFrame) -> DataFrame:
    """The base, or the defaults where it has no row."""
    any_row = base.limit(1).select(F.lit(1).alias("_one"))
    seeds = defaults.withColumn("_one", F.lit(1)).join(F.broadcast(any_row), "_one", "left_anti").drop("_one")
    return base.unionByName(seeds)


def merge_settings(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, kind, value): stored values over defaults, where they fit the default's kind."""
    both = defaults.join(stored.withColumnRenamed("value", "own"), "key", "left")
    fits = (
        F.when(F.col("kind") == "int", F.col("own").try_cast("bigint").isNotNull())
        .when(F.col("kind") == "double", F.col("own").try_cast("double").isNotNull())
        .when(F.col("kind") == "bool", F.col("own").isin("true", "false"))
        .otherwise(F.col("own").isNotNull())
    )
    return both.select("key", "kind", F.when(fits, F.col("own")).otherwise(F.col("value")).alias("value"))


def job_history(events: DataFrame) -> DataFrame:
    """Per job the first converting, the last terminal and the latest status by (ts, event_id)."""
    ended = F.col("status").isin(*TERMINAL)
    latest = F.max(F.struct("ts", "event_id", "status"))["status"]
    return events.groupBy("job_id").agg(F.min(F.when(F.col("status") == "converting", F.col("ts"))).alias("started_at"), F.max(F.when(ended, F.col("ts"))).alias("completed_at"), latest.alias("status"), F.count("*").alias("changes"))
