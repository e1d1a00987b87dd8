"""Comparison of tables as multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.sources.work import Work


def counted_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows with ``n_left`` and ``n_right``, where these differ. One aggregation of both sides together: rows are
    counted before the exchange, so rows that repeat without end cost one row a task."""
    both = left.select(*columns, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(*columns, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(*columns).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).filter("n_left <> n_right")


def multiset_diff(left: DataFrame, right: DataFrame, code: str, fields: list[str]) -> DataFrame:
    """What is left after equal rows cancel out: each distinct row with ``n_removed``, ``n_added`` and ``kind``.

    A code that has one row left on either side is ``changed``. Of the others, rows that agree in all but the code, one on
    either side, are ``renamed``. Everything else is ``removed`` or ``added``. A null code can only be renamed."""
    rest = counted_difference(left, right, [code, *fields])
    work = Work(left.sparkSession)
    rest = work.store(rest.select(code, *fields, F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0)).alias("n_removed"), F.greatest(F.col("n_right") - F.col("n_left"), F.lit(0)).alias("n_added")))  # three readers
    once = lambda df: df.agg(F.sum("n_removed").alias("r"), F.sum("n_added").alias("a")).filter("r = 1 and a = 1").drop("r", "a")
    changed = once(rest.filter(F.col(code).isNotNull()).groupBy(code)).withColumn("changed", F.lit(True))
    marked = rest.join(changed, code, "left")
    same = [f"`{f}`" for f in fields]
    renamed = once(marked.filter("changed is null").groupBy(*fields)).withColumn("renamed", F.lit(True)).toDF(*[f"__{f}" for f in fields], "renamed")
    on = F.col("changed").isNull()
    for f, own in zip(fields, same, strict=True):
        on = on & F.col(own).eqNullSafe(F.col(f"__{f}"))
    kind = F.when(F.col("changed"), "changed").when(F.col("renamed"), "renamed").when(F.col("n_added") == 0, "removed").otherwise("added")
    return work.finished(marked.join(renamed, on, "left").select(code, *fields, "n_removed", "n_added", kind.alias("kind")))
