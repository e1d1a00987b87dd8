"""Placement of a cluster's records on its members, key by key, from bags of quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.sources.work import Work


def slash_label(members: Column, prefix: str = "") -> Column:
    """Members as one label: numbers by value, then other names."""
    named = F.transform(F.array_distinct(members), lambda m: F.struct((~m.rlike("^[0-9]+$")).alias("other"), F.when(m.rlike("^[0-9]+$"), m.cast("decimal(38,0)")).alias("n"), m.alias("m")))
    return F.concat(F.lit(prefix), F.array_join(F.array_sort(named)["m"], "/"))


def bags(records: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """(cluster, keys): quantity of the records, total of the members, how many members have the key and the first of them.

    One aggregation of both sides by member (partly worked out before the exchange), one of these sums by key; no member
    meets another."""
    left = records.select("cluster", *keys, F.lit(None).cast("string").alias("member"), F.col("quantity").alias("wanted"), F.lit(None).cast(positions.schema["quantity"].dataType).alias("had"))
    right = positions.select("cluster", *keys, "member", F.lit(None).cast(records.schema["quantity"].dataType).alias("wanted"), F.col("quantity").alias("had"))
    by_member = left.union(right).dropna(subset=keys).groupBy("cluster", *keys, "member").agg(F.sum("wanted").alias("wanted"), F.sum("had").alias("had"))
    has = F.coalesce(F.col("had"), F.lit(0)) != 0
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_member.groupBy("cluster", *keys).agg(zero("wanted").alias("wanted"), zero("had").alias("had"), F.count(F.when(has, 1)).alias("owners"), F.min(F.when(has, F.col("member"))).alias("owner"))


def separate(records: DataFrame, positions: DataFrame, keys: list[str], work: Work) -> tuple[DataFrame, DataFrame]:
    """Each key on the one member that has all of it: rows (cluster, side, row_id, label) and a report of each cluster.

    A cluster whose every key has exactly one owner with an equal quantity is a ``match``: records go to the owner of their
    key, and positions stay with their member where no record has their key. Otherwise all its positions stay as they are and
    ``failed`` names the least key that is at fault, and how: ``no owner``, ``several owners`` or ``quantity``.

    ``records``: record_id, cluster, keys, quantity; ``positions``: position_id, cluster, member, keys, quantity. Rows with a
    null key are in no bag: such positions stay only in a cluster that doesn't match, such records nowhere."""
    bag = work.store(bags(records, positions, keys))
    fault = F.when(F.col("owners") == 0, "no owner").when(F.col("owners") > 1, "several owners").when(F.col("had") != F.col("wanted"), "quantity")
    judged = bag.withColumn("fault", F.when(F.col("wanted") != 0, fault))
    clusters = records.select("cluster").union(positions.select("cluster")).distinct()
    failed = judged.filter("fault is not null").groupBy("cluster").agg(F.min(F.struct(*keys, "fault")).alias("failed"))
    report = work.store(clusters.join(failed, "cluster", "left").select("cluster", F.when(F.col("failed").isNull(), "match").otherwise("mismatch").alias("status"), *[F.col(f"failed.{k}").alias(f"failed_{k}") for k in keys], F.col("failed.fault").alias("fault")))
    state = report.select("cluster", "status")
    taken = records.join(bag.filter("wanted <> 0"), ["cluster", *keys]).join(state.filter("status = 'match'"), "cluster").select("cluster", F.lit("record").alias("side"), F.col("record_id").alias("row_id"), F.col("owner").alias("label"))
    # a member keeps a key that no record has, unless its own rows of it cancel out
    own = positions.dropna(subset=keys).groupBy("cluster", "member", *keys).agg(F.sum("quantity").alias("of_member")).filter("of_member <> 0").drop("of_member")
    alone = own.join(bag.filter("wanted = 0").select("cluster", *keys), ["cluster", *keys])
    kept = positions.join(state, "cluster")
    left = kept.filter("status = 'mismatch'").select("cluster", "position_id", "member").union(kept.filter("status = 'match'").join(alone, ["cluster", "member", *keys]).select("cluster", "position_id", "member"))
    rows = taken.union(left.select("cluster", F.lit("position"), "position_id", "member"))
    return rows, report


def mixed(records: DataFrame, positions: DataFrame, keys: list[str], work: Work, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """All of a cluster under one label: rows (cluster, side, row_id, label) and a report of each key that differs.

    A key whose quantities are equal goes to its records; one that the members have otherwise goes to their positions, with
    ``differs`` where records have another quantity; one that only records have is left out as ``only records``."""
    bag = bags(records, positions, keys).withColumn("place", F.when((F.col("wanted") != 0) & (F.col("wanted") == F.col("had")), "record").when(F.col("had") != 0, "position").when(F.col("wanted") != 0, "none"))
    bag = work.store(bag)
    labels = work.store(positions.groupBy("cluster").agg(slash_label(F.collect_set("member"), prefix).alias("label")))
    of = lambda df, id_, side: df.join(bag.filter(F.col("place") == side).select("cluster", *keys), ["cluster", *keys]).select("cluster", F.lit(side).alias("side"), F.col(id_).alias("row_id"))
    rows = of(records, "record_id", "record").union(of(positions, "position_id", "position")).join(labels, "cluster", "left").select("cluster", "side", "row_id", "label")
    report = bag.filter("wanted <> had").select("cluster", *keys, "had", "wanted", F.when(F.col("place") == "none", "only records").otherwise("differs").alias("note"))
    return rows, report
