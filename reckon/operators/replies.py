"""Kits of replies that name none: by the transmittal that they answer, else by the folder that they lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.functions import grammar as G
from reckon.functions import replies as R

#: A folder of one kit.
FOLDER = r"^(\d{4})-([A-Za-z0-9]+)$"
NOT_SENT, NOTHING = "no kit of the transmittal", "no transmittal"


def latest_kits(sends: DataFrame, order: list[str]) -> DataFrame:
    """The kit of each transmittal, in any case of letters; the last send by ``order`` wins. One aggregation."""
    token = F.lower(F.trim("transmittal"))
    return sends.filter(token != "").groupBy(token.alias("__token")).agg(F.max_by(F.struct("title", "mark"), F.struct(*order, "title", "mark")).alias("__kit"))


def resolved(replies: DataFrame, sends: DataFrame, order: list[str], folder: str | None = None) -> DataFrame:
    """``replies`` (id, and the fields of :func:`reckon.functions.replies.reply`) with the kits that ``sends`` (transmittal,
    title, mark and ``order``) and the column ``folder`` give; a reply with an error has no stage.

    Only replies of an unknown kit meet the sends; the others carry keys of their own, so that they don't meet in one task.
    A kit of the folder must have a kit's mark. Replies come out once each, repeated rows too."""
    open_ = F.col("error") == R.UNKNOWN
    token = F.when(open_ & F.col("transmittal").isNotNull(), F.lower(F.trim("transmittal")))
    keyed = replies.withColumn("__token", F.coalesce(token, F.concat(F.lit("\x00"), F.xxhash64("id").cast("string"))))
    met = keyed.join(latest_kits(sends, order), "__token", "left")
    hint = F.col(folder) if folder else F.lit(None).cast("string")
    part = lambda g: F.when(hint.rlike(FOLDER), F.regexp_extract(hint, FOLDER, g))
    found, hinted = F.col("__kit").isNotNull(), part(1).isNotNull()
    error = F.when(~open_, F.col("error")).when(found, "").when(hinted, F.when(G.is_mark(part(2)), "").otherwise(R.NO_KIT)).when(F.col("transmittal").isNotNull(), NOT_SENT).otherwise(NOTHING)
    kit = lambda n, g: F.when(~open_, F.col(n)).when(found, F.col(f"__kit.{n}")).when(hinted & G.is_mark(part(2)), part(g)).alias(n)
    by = F.when(~open_, F.lit("text")).when(found, "transmittal").when(error == "", "folder")
    out = met.withColumns({"__error": error, "__title": kit("title", 1), "__mark": kit("mark", 2), "__by": by})
    return out.select("id", "transmittal", "incoming", F.when(F.col("__error") == "", F.col("stage")).alias("stage"), F.col("__title").alias("title"), F.col("__mark").alias("mark"), "revision", "documents", F.col("__by").alias("kit_by"), F.col("__error").alias("error"))
