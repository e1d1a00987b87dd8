"""Mixing sources to target weights by weighted fair queueing.

Targets: sources (by code point, null last) weigh 3, 1, 2, repeating, and share ``share`` times the words of the corpus. A
target stops at ``epochs`` times its source's words; what is over goes to the others by weight. Sorted by (stop / weight)
this is one water level, found in one pass over the sources.

Queueing: each source's documents are shuffled by a hash and offered once for each epoch. A copy's virtual finish time is
the source's words up to and with it, over the source's target. All copies together, in order of that time, are cut where
the words reach the budget. Running sums go by buckets of the order (sums of buckets, then sums within one), so a source
with a third of all rows, or the global order, never lies in one task.

Result: a manifest with one row for each document: size, source_size, target, epochs and taken (epochs x size). Defined
results: null and wordless texts have size 0 and take 0; rows with equal ids are ordered by size and text hash; empty
tables work; reruns agree. Columns are picked by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reckon.llm import common as C

#: The contract's weights, in turn.
WEIGHTS = (3, 1, 2)
SHARE, EPOCHS = 1.5, 2
#: Buckets of a running sum: enough that one holds about this many rows.
BUCKET_ROWS = 50_000


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` by ``keys``, in the order of (bucket, order). Only bucket sums are in one place."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("__sum")
    own = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.join(before, [*keys, bucket]).withColumn(name, F.col("__before") + F.sum(value).over(own)).drop("__before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Of (source, size): source_rank, source_size and target of each source. One row a source from the start."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by.withColumn("source_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("stop", F.col("source_size") * float(epochs)).withColumn("ratio", F.col("stop") / F.col("w"))
    upto = W.orderBy("ratio", "source_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.partitionBy()
    # the first source, in order of its ratio, whose ratio is not under the level that the sources from it on would have
    ranked = ranked.withColumn("level", (F.sum("source_size").over(everything) * share - F.sum("stop").over(upto) + F.col("stop")) / (F.sum("w").over(everything) - F.sum("w").over(upto) + F.col("w")))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_rank", "level"))).over(everything)
    ranked = ranked.withColumn("water", first["level"])
    return ranked.select("source", "source_rank", "source_size", F.coalesce(F.least(F.col("stop"), F.col("water") * F.col("w")), F.col("stop")).alias("target"))


def mix(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, keep: tuple[str, ...] = (), seed: int = 7, scratch: C.Scratch | None = None) -> DataFrame:
    """The manifest: id, size, source, source_size, target, epochs and taken, and the columns named in ``keep``. It reads
    tables of ``scratch``, which whoever gives one drops when the manifest is done with."""
    scratch = scratch or C.Scratch(df.sparkSession)
    text = F.col(f"`{text_column}`")
    keep = tuple(c for c in keep if c.lower() not in ("doc_id", "size", "source", "source_size", "target", "epochs", "taken"))
    light = scratch.write(
        df.select(
            F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{source_column}`").alias("source"), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.col(f"`{id_column}`"), F.lit(seed)).alias("place"), F.xxhash64(text).alias("tie"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep],
        )
    )
    n, words = light.agg(F.count("*"), F.sum("size")).first()
    buckets = max(1024, -(-n // BUCKET_ROWS))
    targets = source_targets(light, weights, share, epochs)
    # a bucket is a range of the hash, so buckets follow its order
    placed = light.withColumn("bucket", (F.shiftright("place", 24) * F.lit(buckets) / F.lit(float(1 << 40))).cast("double"))
    placed = placed.withColumn("bucket", F.floor("bucket").cast("long")).join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    queued = scratch.write(running_total(placed, ["source_rank"], "bucket", [F.col("place"), F.col("doc_id"), F.col("size"), F.col("tie")], "size", "upto").drop("bucket"))
    finish = lambda epoch: (F.col("upto") + F.col("source_size") * epoch) / F.col("target")

    copies = queued.filter("size > 0 and target > 0").select("source_rank", "size", F.explode(F.array(*[finish(e) for e in range(epochs)])).alias("time"))
    copies = copies.withColumn("slot", F.floor(F.col("time") * buckets).cast("long"))
    budget = (words or 0) * share
    slots = copies.groupBy("slot").agg(F.sum("size").alias("in_slot")).withColumn("through", F.sum("in_slot").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, W.currentRow)))
    over = slots.filter(F.col("through") > F.lit(budget)).agg(F.min_by("slot", "slot"), F.min_by(F.col("through") - F.col("in_slot"), F.col("slot"))).first()
    if over[0] is None:  # everything fits
        taken = [F.lit(1)] * epochs
    else:
        in_order = W.partitionBy("slot").orderBy("time", "source_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
        last = copies.filter(F.col("slot") == over[0]).withColumn("through", F.lit(over[1]) + F.sum("size").over(in_order))
        last = last.filter(F.col("through") <= F.lit(budget)).agg(F.max(F.struct("time", "source_rank"))).first()[0]
        slot = lambda e: F.floor(finish(e) * buckets).cast("long")
        inside = (lambda e: (finish(e) < last["time"]) | ((finish(e) == last["time"]) & (F.col("source_rank") <= last["source_rank"]))) if last else (lambda e: F.lit(False))
        taken = [((slot(e) < over[0]) | ((slot(e) == over[0]) & inside(e))).cast("int") for e in range(epochs)]
    count = F.when(F.col("target") > 0, sum(taken, F.lit(0))).otherwise(0).cast("long")
    return queued.withColumn("epochs", count).select("doc_id", "size", "source", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"), *[F.col(f"keep_{c}").alias(c) for c in keep])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document of ``documents``."""
    scratch = C.Scratch(spark)
    out = mix(C.table(spark, sf_dir, "documents"), scratch=scratch)
    return scratch.finished(out.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs"))
