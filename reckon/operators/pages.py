"""Pages: coordinates clustered by gaps, characters in boxes, formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width and height of the formats in millimetres, and how many A4 sheets each is.
FORMATS = {"A4": (210, 297, 1), "A3": (297, 420, 2), "A2": (420, 594, 4), "A1": (594, 841, 8), "A0": (841, 1189, 16)}


def gap_clusters(df: DataFrame, keys: list[str], coordinate: str, tolerance: float) -> DataFrame:
    """Adds ``cluster``: coordinates in order, a new cluster begins where the gap to the one before is over the tolerance."""
    w = W.partitionBy(*keys).orderBy(coordinate)
    new = F.coalesce((F.col(coordinate) - F.lag(coordinate).over(w) > tolerance).cast("long"), F.lit(0))
    return df.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w.rangeBetween(W.unboundedPreceding, W.currentRow))).drop("__new")


def in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Points (x, y) with the boxes (x0, y0, x1, y1; lower edges belong to them) that hold them. Boxes are spread over the
    cells of a grid, points lie in one, so that they meet by equality. Spark takes the spread boxes for no larger than the
    boxes before, so neither side may be broadcast."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    b = boxes.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    p = points.withColumns({"cx": at("x"), "cy": at("y")})
    return p.join(b.hint("merge"), [*keys, "cx", "cy"]).filter("x >= x0 and x < x1 and y >= y0 and y < y1").drop("cx", "cy")


def page_format(width: Column, height: Column, tolerance: float = 3) -> Column:
    """The format with these sides in either direction, or null."""
    short, long_ = F.least(width, height), F.greatest(width, height)
    return reduce(lambda out, x: out.when((F.abs(short - x[1][0]) <= tolerance) & (F.abs(long_ - x[1][1]) <= tolerance), F.lit(x[0])), FORMATS.items(), F.when(F.lit(False), F.lit("")))


def sheet_count(tokens: Column) -> Column:
    """A4 sheets of a list like ``A4x3, A3``; a token without a known format counts nothing."""
    a4 = lambda x: reduce(lambda out, f: out.when(F.upper(F.regexp_extract(x, r"(?i)^(A[0-9])", 1)) == f[0], F.lit(f[1][2])), FORMATS.items(), F.when(F.lit(False), F.lit(0))).otherwise(0)
    times = lambda x: F.coalesce(F.regexp_extract(x, r"(?i)^A[0-9]\s*[xх*]\s*([0-9]+)$", 1).try_cast("int"), F.lit(1))
    return F.aggregate(F.transform(F.split(F.coalesce(tokens, F.lit("")), ","), lambda x: a4(F.trim(x)) * times(F.trim(x))), F.lit(0), lambda a, b: a + b)
