"""Header rows of sheets, found by what they say, and data rows bound to fields by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reckon.functions.keys import let
from reckon.sources.work import Work

#: Rows of a sheet in which its header is looked for.
TOP = 30


def cleaned(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"[\s ]+", " "))


def combined(upper: Column, lower: Column) -> Column:
    """Captions of a header in two rows: ``a / b``, where an empty upper cell stands for the last one that was filled."""
    pairs = F.zip_with(F.transform(upper, lambda x: cleaned(x)), F.transform(lower, lambda x: cleaned(x)), lambda a, b: F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b")))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        last = F.when(x["a"] != "", x["a"]).otherwise(state["last"])
        own = F.when(x["b"] == "", x["a"]).when(last == "", x["b"]).otherwise(F.concat(last, F.lit(" / "), x["b"]))
        return F.struct(last.alias("last"), F.concat(state["out"], F.array(own)).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def bound(captions: Column, patterns: dict[str, str], rightmost: tuple[str, ...] = ()) -> Column:
    """A struct with the place of each field's caption, the leftmost that its pattern finds (the rightmost for some), or null."""

    def places(texts: Column) -> Column:
        at = lambda p: F.filter(F.transform(texts, lambda x, i: F.when(x.rlike(p), i)), lambda i: i.isNotNull())
        found = {f: at(p) for f, p in patterns.items()}
        return F.struct(*[(F.array_max(at) if f in rightmost else F.array_min(at)).alias(f) for f, at in found.items()])

    return let(F.transform(captions, lambda x: F.lower(cleaned(x))), places)


def find_headers(cells: DataFrame, patterns: dict[str, str], required: tuple[str, ...], subheads: str, rightmost: tuple[str, ...] = ()) -> DataFrame:
    """(sheet, data_from, places): of each sheet's first rows the one that names most fields, the first of equals; it must name
    those that are ``required``. A row whose next one has a caption like ``subheads`` is read together with that.

    ``cells``: sheet, row (from 0), cells (array of texts). Only the first ``TOP`` rows of a sheet are looked at here."""
    top = cells.filter(F.col("row") < TOP).withColumn("next", F.lead("cells").over(W.partitionBy("sheet").orderBy("row")))
    two = F.coalesce(F.exists("next", lambda x: F.lower(cleaned(x)).rlike(subheads)), F.lit(False)) & ~F.exists("cells", lambda x: F.lower(cleaned(x)).rlike(subheads))
    top = top.withColumn("two", two).withColumn("places", bound(F.when(F.col("two"), combined(F.col("cells"), F.col("next"))).otherwise(F.col("cells")), patterns, rightmost))
    score = sum((F.col(f"places.{f}").isNotNull().cast("int") for f in patterns), F.lit(0))
    whole = sum((F.col(f"places.{f}").isNull().cast("int") for f in required), F.lit(0)) == 0
    best = top.filter(whole).groupBy("sheet").agg(F.max(F.struct(score.alias("score"), (-F.col("row")).alias("back"), "two", "places")).alias("b"))
    return best.select("sheet", (F.lit(1) - F.col("b.back") + F.col("b.two").cast("int")).alias("data_from"), F.col("b.places").alias("places"))


def read_sheets(cells: DataFrame, patterns: dict[str, str], required: tuple[str, ...], subheads: str, work: Work, rightmost: tuple[str, ...] = ()) -> DataFrame:
    """(sheet, row, fields): the rows behind each sheet's header, each field from the column that its header names; null where
    it names none, or where the cell is blank. Rows without any field, and sheets without a header, give nothing."""
    cells = work.store(cells)
    heads = work.store(find_headers(cells, patterns, required, subheads, rightmost))
    rows = cells.join(heads, "sheet").filter(F.col("row") >= F.col("data_from"))
    fields = [F.nullif(cleaned(F.get("cells", F.col(f"places.{f}"))), F.lit("")).alias(f) for f in patterns]
    return rows.select("sheet", "row", *[F.when(F.col(f"places.{f}").isNotNull(), c).alias(f) for f, c in zip(patterns, fields, strict=True)]).dropna(how="all", subset=list(patterns))
