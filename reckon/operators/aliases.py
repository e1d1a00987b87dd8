"""Labels of contracts that are written in several ways: aliases, an index of them, and what is looked up by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.functions.keys import let
from reckon.sources.work import Work

#: The letters that a contract's number begins with.
PREFIX = "ДС"


def label_key(label: Column, prefix: str = PREFIX) -> Column:
    """Upper case, no blanks, ``_`` for ``/``, the prefix before a bare number; null if nothing is left."""
    text = F.replace(F.replace(F.upper(F.trim(label)), F.lit(" "), F.lit("")), F.lit("/"), F.lit("_"))
    return F.when(text == "", None).when(text.rlike("^[0-9]"), F.concat(F.lit(prefix), text)).otherwise(text)


def variants(label: Column, prefix: str = PREFIX) -> Column:
    """The aliases of a label, first the label's own key: without zeros before its number, without letters behind it, without
    a tail that begins with ``_`` and no digit, and these together. A numbered part (``_24``) stays."""
    zeros = lambda x: F.regexp_replace(x, f"(?iu)^({prefix})0+([0-9].*)$", "$1$2")
    letters = lambda x: F.regexp_replace(x, f"(?iu)^({prefix}[0-9]+(?:_[0-9]+)?)[A-ZА-ЯЁ]+$", "$1")
    tail = lambda x: F.regexp_replace(x, f"(?iu)^({prefix}[0-9]+)(?:_[^0-9].*|_+)$", "$1")
    all_ = lambda key, bare: F.array_distinct(F.array(key, bare, letters(key), letters(bare), tail(key), tail(bare)))
    return let(label_key(label, prefix), lambda key: F.when(key.isNull(), F.array().cast("array<string>")).otherwise(let(zeros(key), lambda bare: all_(key, bare))))


def alias_index(entries: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """(alias, entry_id, ambiguous): each alias with the first entry (by ``entry_id``) that has it, and whether entries with
    another ``value`` have it too. ``entries``: entry_id, label, value."""
    each = entries.select("entry_id", "value", F.explode(variants(F.col("label"), prefix)).alias("alias"))
    return each.groupBy("alias").agg(F.min("entry_id").alias("entry_id"), (F.min(F.coalesce("value", F.lit(""))) < F.max(F.coalesce("value", F.lit("")))).alias("ambiguous"))


def look_up(asked: DataFrame, labels: list[str], index: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """(ask_id, alias, entry_id, ambiguous): the first alias of the first label that the index knows. Each alias meets the
    index by equality; no pair of labels is compared. ``asked``: ask_id and the columns named in ``labels``."""
    all_ = F.concat(*[variants(F.col(c), prefix) for c in labels])
    each = asked.select("ask_id", F.posexplode(all_).alias("turn", "alias")).join(index, "alias")
    best = each.groupBy("ask_id").agg(F.min(F.struct("turn", "alias", "entry_id", "ambiguous")).alias("b"))
    return best.select("ask_id", "b.alias", "b.entry_id", "b.ambiguous")


def mixed_parts(label: Column, prefix: str = PREFIX) -> Column:
    """The parts of a label of several contracts, as in ``15/61``; null for any other."""
    parts = F.transform(F.split(F.regexp_replace(F.trim(label), f"(?iu)^{prefix}", ""), "/"), lambda x: F.trim(x))
    return F.when(label.contains("/") & (F.size(parts) > 1) & ~F.exists(parts, lambda x: x == ""), parts)


def with_managers(rows: DataFrame, entries: DataFrame, work: Work, prefix: str = PREFIX) -> DataFrame:
    """(ask_id, label, manager, note) for rows with ask_id, name and actual.

    A label of several contracts has a manager if all of its parts have one and the same, else the note ``mixed``. Any other
    row is looked up by its name, then by its actual contract: ``not listed`` if neither is known, ``no manager`` if the entry
    has none, ``ambiguous`` if entries with another manager have that alias. Rows without a name and actual contract have
    neither."""
    index = work.store(alias_index(entries.withColumnRenamed("manager", "value"), prefix))
    named = entries.select("entry_id", F.nullif(F.trim("manager"), F.lit("")).alias("manager"))
    rows = rows.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in ("name", "actual")}).withColumn("parts", mixed_parts(F.col("name"), prefix))
    single = rows.filter("parts is null")
    found = look_up(single, ["name", "actual"], index, prefix).join(named, "entry_id")
    note = F.when(F.col("name").isNull() & F.col("actual").isNull(), "").when(F.col("entry_id").isNull(), "not listed").when(F.col("manager").isNull(), "no manager").when(F.col("ambiguous"), "ambiguous").otherwise("")
    one = single.join(found, "ask_id", "left").select("ask_id", F.coalesce("name", "actual").alias("label"), "manager", note.alias("note"))
    parts = rows.filter("parts is not null").select("ask_id", F.concat(F.lit(prefix), F.array_join("parts", "/")).alias("label"), F.explode("parts").alias("part"))
    each = work.store(parts.withColumn("whole", F.col("ask_id")).withColumn("ask_id", F.struct("whole", "part")))
    of = each.join(look_up(each.select("ask_id", "part").distinct(), ["part"], index, prefix).join(named, "entry_id"), "ask_id", "left")
    same = of.groupBy("whole", "label").agg(F.min("manager").alias("least"), F.max("manager").alias("most"), F.count("manager").alias("n"), F.count("*").alias("all"))
    agreed = (F.col("n") == F.col("all")) & (F.col("least") == F.col("most"))
    several = same.select(F.col("whole").alias("ask_id"), "label", F.when(agreed, F.col("least")).alias("manager"), F.when(agreed, "").otherwise("mixed").alias("note"))
    return one.union(several)
