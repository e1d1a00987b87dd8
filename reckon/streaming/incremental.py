"""Incremental processing of file snapshots as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def upsert(current: DataFrame | None, batch: DataFrame, key: str, stamp: list[str], reliable: bool = True) -> DataFrame:
    """The state after one scan: the first scan is a baseline that counts as acknowledged; later, new and changed rows are
    pending, an ignored row stays ignored, and rows that the scan didn't see are missing if the scan was reliable."""
    own = batch.groupBy(key).agg(F.max(F.struct(*stamp)).alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in stamp], F.lit(True).alias("present"))
    if current is None:
        return own.withColumn("review", F.lit("acknowledged"))
    old = current.select(F.col(key).alias("k"), *[F.col(c).alias(f"old_{c}") for c in stamp], F.col("present").alias("was"), F.col("review").alias("old_review"))
    x = old.join(own, F.col("k") == F.col(key), "full")
    seen = F.col(key).isNotNull()
    same = F.col("was")
    for c in stamp:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(c))
    review = F.when(F.col("old_review") == "ignored", "ignored").when(F.col("k").isNull() | (seen & ~same), "pending").otherwise(F.col("old_review"))
    present = F.when(seen, True).when(F.lit(reliable), False).otherwise(F.col("was"))
    return x.select(F.coalesce("k", key).alias(key), *[F.coalesce(c, f"old_{c}").alias(c) for c in stamp], present.alias("present"), review.alias("review"))


def run_upserts(stream: DataFrame, path: str, key: str, stamp: list[str], checkpoint: str, done: Callable[[int, DataFrame], None] | None = None, reliable: bool = False) -> StreamingQuery:
    """Keep a state table up to date from a stream of scans: each micro-batch is one scan, written as a new version
    ``path/v=<batch>`` that builds on the last one before it. A batch that is tried again overwrites its own version.
    ``reliable``: each batch is a whole scan, so what it lacks is missing."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = None
        for v in range(number - 1, -1, -1):
            try:
                last = spark.read.parquet(f"{path}/v={v}")
                break
            except Exception as e:  # only a version that isn't there is passed over
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        new = upsert(last, batch, key, stamp, reliable)
        new.write.mode("overwrite").parquet(f"{path}/v={number}")
        if done:
            done(number, new)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by key and window; what comes later than ``late`` is left out and old state goes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
