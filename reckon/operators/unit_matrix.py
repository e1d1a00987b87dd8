"""A stored matrix of units and coefficients, merged with a dimension of target units and with what was observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.sources import sinks
from reckon.sources.work import Work

#: A code with several units and no target, one that has a unit and none in the dimension, one with open coefficients.
COLLISION, NO_TARGET, OPEN = "collision", "no target", "needs a coefficient"


def reconcile(codes: DataFrame, pairs: DataFrame, targets: DataFrame, observed: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """The new codes (code, target, status) and pairs (code, unit, coefficient, open).

    ``codes`` and ``pairs``: the stored matrix in the same form. ``targets``: code, target of the dimension. ``observed``:
    code, unit. Units are normalised beforehand. Codes of the matrix and observed codes are in the result; a target alone adds
    none.

    The dimension's target goes before the stored one. A code with a target has a pair of its target with coefficient 1; a
    unit that is seen for the first time is open; where the target is another one than before (or the code was a collision)
    all other pairs are open again; everything else keeps its coefficient. A code without a target keeps its pairs: one
    observed unit gets coefficient 1, of several those that are new do, and the code is a collision. Run on its own result
    with the same observations, it gives the same matrix."""
    seen = work.store(observed.dropna().distinct())
    counts = seen.groupBy("code").agg(F.count("*").alias("units"))
    old = codes.withColumnsRenamed({"target": "before", "status": "was"}).withColumn("known", F.lit(True))
    head = old.join(counts, "code", "full").join(targets.select("code", F.col("target").alias("dimension")), "code", "left")
    target = F.coalesce(F.nullif("dimension", F.lit("")), F.nullif("before", F.lit("")))
    changed = ~F.nullif("before", F.lit("")).eqNullSafe(target) | (F.col("dimension").isNull() & (F.col("was") == COLLISION))
    head = work.store(head.select("code", target.alias("target"), F.coalesce(changed, F.lit(True)).alias("changed"), F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("was", F.lit("")).alias("was")))
    rows = pairs.select("code", "unit", "coefficient", F.col("open").alias("was_open"), F.lit(1).alias("stored"), F.lit(0).alias("active"))
    none = [F.lit(None).cast(pairs.schema["coefficient"].dataType), F.lit(None).cast("boolean"), F.lit(0)]
    rows = rows.union(seen.select("code", "unit", *none, F.lit(1))).union(head.filter("target is not null").select("code", F.col("target").alias("unit"), *none, F.lit(0)))
    each = rows.groupBy("code", "unit").agg(F.max("coefficient").alias("coefficient"), F.max("was_open").alias("was_open"), F.max("stored").alias("stored"), F.max("active").alias("active"))
    x = each.join(head, "code")
    bound, is_target = F.col("target").isNotNull(), F.col("unit") == F.col("target")
    one = is_target | (~bound & (F.col("active") == 1) & ((F.col("units") == 1) | (F.col("stored") == 0)))
    keeps = (F.col("stored") == 1) & ~(bound & F.col("changed"))
    coefficient = F.when(F.coalesce(one, F.lit(False)), F.lit(1).cast(pairs.schema["coefficient"].dataType)).when(keeps, F.col("coefficient"))
    again = x.withColumn("new", coefficient)
    is_open = F.when(F.coalesce(one, F.lit(False)), False).when(bound & F.col("changed"), True).when((F.col("stored") == 0) | (bound & (F.col("active") == 1) & F.col("coefficient").isNull()), True).otherwise(F.coalesce("was_open", F.lit(False)))
    new_pairs = work.store(again.select("code", "unit", F.col("new").alias("coefficient"), is_open.alias("open")))
    opened = new_pairs.filter("open").select("code").distinct().withColumn("any", F.lit(True))
    status = F.when(bound, F.when(F.col("any"), OPEN).otherwise("")).when(F.col("units") > 1, COLLISION).when(F.col("units") == 1, NO_TARGET).otherwise(F.col("was"))
    return work.store(head.join(opened, "code", "left").select("code", "target", status.alias("status"))), new_pairs


def fingerprint(df: DataFrame) -> tuple:
    """Of the rows as a multiset, by sums: nothing is gathered."""
    names = sorted(df.columns)
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).cast("decimal(38,0)"))
    return tuple(df.agg(F.count("*"), h(1), h(2)).first())


def write_if_changed(df: DataFrame, path: str, version: int, before: int | None) -> int:
    """Store a snapshot under ``version`` unless it equals that of ``before``; returns the newest version's number. A repeated
    try replaces its own version."""
    if before is not None and fingerprint(sinks.read_version(df.sparkSession, path, before)) == fingerprint(df):
        return before
    sinks.write_version(df, path, version)
    return version
