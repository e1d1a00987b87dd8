"""Unit gate: one target unit for each code, exact coefficients, and nothing applied while anything is fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far from an integer counts as that integer: 1e-9.
NEAR = "0.000000001"


def plan(requests: DataFrame, dimension: DataFrame, matrix: DataFrame) -> DataFrame:
    """Requests (request_id, code, source_unit, quantity) with target_unit, coefficient, converted and status.

    The target is the dimension's unit, else the unit that the matrix maps to itself. Without a target one observed unit is
    kept and several are fatal; so are conflicting dimension units, conflicting coefficients of one code and unit, and a unit
    that the matrix doesn't convert. A request gives one row, however often the matrix repeats a line. Numbers are exact
    decimals; results within 1e-9 of an integer become that integer."""
    dim = dimension.groupBy("code").agg(F.min("unit").alias("dim_unit"), F.countDistinct("unit").alias("dim_units"))
    ratio = F.split(F.regexp_replace(F.regexp_replace("coefficient", r"\s+", ""), ",", "."), "/")
    part = lambda i: F.get(ratio, F.lit(i)).try_cast("decimal(18,9)")
    number = F.when(F.size(ratio) == 2, F.try_divide(part(0), part(1)).cast("decimal(20,15)")).otherwise(part(0)).cast("decimal(20,15)")
    steps = matrix.select("code", "source_unit", number.alias("c")).groupBy("code", "source_unit").agg(F.min("c").alias("c"), F.countDistinct("c").alias("coefficients"))
    own = steps.filter("c = 1").groupBy("code").agg(F.min("source_unit").alias("matrix_unit"))
    seen = requests.groupBy("code").agg(F.countDistinct("source_unit").alias("seen_units"))
    x = requests.join(dim, "code", "left").join(own, "code", "left").join(seen, "code", "left").join(steps, ["code", "source_unit"], "left")
    x = x.withColumn("target_unit", F.coalesce("dim_unit", "matrix_unit"))
    status = (
        F.when(F.col("dim_units") > 1, "fatal: conflicting targets")
        .when(F.col("target_unit").isNull() & (F.col("seen_units") > 1), "fatal: several units and no target")
        .when(F.col("target_unit").isNull(), "kept")
        .when(F.col("target_unit") == F.col("source_unit"), "identity")
        .when(F.col("coefficients") > 1, "fatal: conflicting coefficients")
        .when(F.col("c").isNull(), "fatal: no coefficient")
        .otherwise("converted")
    )
    x = x.withColumn("status", status).withColumn("coefficient", F.when(F.col("status") == "converted", F.col("c")).when(F.col("status").isin("identity", "kept"), F.lit(1).cast("decimal(20,15)")))
    value = F.col("quantity").try_cast("decimal(17,6)") * F.col("coefficient")
    return x.withColumn("converted", F.when(F.abs(value - F.round(value)) <= F.lit(NEAR).cast("decimal(10,9)"), F.round(value)).otherwise(value)).select("request_id", "code", "source_unit", "quantity", "target_unit", "coefficient", "converted", "status")


def apply(planned: DataFrame) -> DataFrame:
    """The plan's rows, or one error that names how many are fatal."""
    n = planned.filter(F.col("status").startswith("fatal")).count()
    if n:
        raise ValueError(f"{n} requests can't be converted; nothing was applied")
    return planned
