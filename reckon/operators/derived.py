"""Derived tables kept up to date: only what hangs on changed keys is worked out again and replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.sources.work import Work, remove


def bucket(key: str, buckets: int) -> Column:
    """The partition of a key's rows."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def key_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): keys that are ``added``, ``removed``, or whose rows are ``changed`` as a multiset: compared by counts and
    sums of row hashes, so no key's rows are gathered."""
    names = sorted(old.columns)
    row = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in names]
    side = lambda df, was, now: df.select(key, F.lit(was).alias("was"), F.lit(now).alias("now"), *[((now - was) * F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)])
    sums = side(old, 1, 0).union(side(new, 0, 1)).groupBy(key).agg(*[F.sum(c).alias(c) for c in ("was", "now", "h1", "h2")])
    change = F.when(F.col("was") == 0, "added").when(F.col("now") == 0, "removed").otherwise("changed")
    return sums.filter("was <> now or h1 <> 0 or h2 <> 0").select(key, change.alias("change"))


def dirty_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ between two states."""
    return key_changes(old, new, key).select(key)


def build(derive: Callable[[DataFrame | None], DataFrame], path: str, key: str, buckets: int) -> None:
    """The whole table, in partitions by key. ``derive(keys)`` gives the rows of some keys, of all where it gets None."""
    derive(None).withColumn("bucket", bucket(key, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def rebuild(derive: Callable[[DataFrame | None], DataFrame], dirty: DataFrame, path: str, key: str, buckets: int, work: Work) -> list[int]:
    """Replace the partitions that hold a dirty key; returns their numbers, at most ``buckets``. The other keys of these
    partitions keep their rows as they are stored; a key that gives no rows any more is gone, with its partition if nothing is
    left in it. What is written is stored first, so a run that is lost half-way can be repeated."""
    spark = dirty.sparkSession
    dirty = work.store(dirty.distinct().withColumn("bucket", bucket(key, buckets)))
    touched = sorted(r.bucket for r in dirty.select("bucket").distinct().collect())
    if not touched:
        return []
    stored = spark.read.parquet(path)
    kept = stored.filter(F.col("bucket").isin(*touched)).join(dirty.select(F.col(key).alias("__k")), F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    fresh = derive(dirty.select(key)).withColumn("bucket", bucket(key, buckets))
    rows = work.store(kept.select(*fresh.columns).union(fresh))
    filled = {r.bucket for r in rows.select("bucket").distinct().collect()}
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for b in touched:
        if b not in filled:
            remove(spark, f"{path}/bucket={b}")
    return touched


def members(files: DataFrame, before: DataFrame | None, judge: Column) -> DataFrame:
    """``files`` (file_id, path, source, ...) with ``member``: what was decided before where a file's path and source are the
    same, else ``judge``. ``before``: file_id, path, source, member."""
    if before is None:
        return files.withColumn("member", F.coalesce(judge, F.lit(False)))
    old = before.select(F.col("file_id").alias("__id"), F.col("path").alias("__path"), F.col("source").alias("__source"), F.col("member").alias("__member"))
    same = F.col("__path").eqNullSafe(F.col("path")) & F.col("__source").eqNullSafe(F.col("source")) & F.col("__id").isNotNull()
    joined = files.join(old, F.col("file_id") == F.col("__id"), "left")
    return joined.withColumn("member", F.when(same, F.col("__member")).otherwise(F.coalesce(judge, F.lit(False)))).drop("__id", "__path", "__source", "__member")
