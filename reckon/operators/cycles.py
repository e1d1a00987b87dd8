"""Send cycles: each send with the events and the package that belong to it.

Sends and events of a kit never meet as pairs. An event speaks through its keys (transmittal numbers, revision, day), and all
that a send asks of a key is its best event: so events are brought down to one row a key, and a send looks up its own number,
its revision and the days around its dates. Where a date bounds the answer, sends and events go into one order of days, and a
running maximum carries the last event to each send.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reckon.sources.work import Work

#: Stages of acceptance from the strongest to the weakest, and the stages of codes.
ACCEPTANCE = ("tdo_passed", "incoming_passed", "tdo_sent", "incoming_sent", "sr_upload")
CODES = ("code_a", "code_b", "code_c")
DAYS = 2


def _keys(df: DataFrame, number: Column, days: Column, *columns: str) -> DataFrame:
    """A row for each key (kind, value) that a row has."""
    key = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("value")))
    all_ = F.concat(key("number", F.array_distinct(number)), key("revision", F.array("revision")), key("day", F.array_distinct(days)))
    return df.select(*columns, F.explode(F.filter(all_, lambda k: k["value"] != "")).alias("k")).select("*", "k.*").drop("k")


def best_of_keys(events: DataFrame) -> DataFrame:
    """(kit, kind, value): best acceptance and last code of the key's events; for days also the last code of another revision
    than that of the last one."""
    stage = F.array_position(F.array(*map(F.lit, ACCEPTANCE)), F.col("stage"))
    e = events.withColumns({
        "best": F.when(stage > 0, F.struct(stage.alias("stage"), (-F.col("seq")).alias("back"), "event_id", "day")),
        "code": F.when(F.col("stage").isin(*CODES), F.struct("seq", "event_id", F.coalesce("revision", F.lit("")).alias("revision"))),
    })
    none = F.array().cast("array<string>")
    keyed = _keys(e, F.coalesce("numbers", none), F.array("day"), "kit", "best", "code").union(e.filter("revision is null").select("kit", "best", "code", F.lit("kit"), F.lit("")))
    by = keyed.groupBy("kit", "kind", "value", F.coalesce("code.revision", F.lit("")).alias("of")).agg(F.min("best").alias("best"), F.max("code").alias("code"))
    key = ["kit", "kind", "value"]
    turn = F.row_number().over(W.partitionBy(*key).orderBy(F.desc_nulls_last("code")))
    second = by.filter("kind = 'day' and code is not null").withColumn("turn", turn).filter("turn <= 2")
    first_two = second.groupBy(*key).agg(F.max(F.when(F.col("turn") == 2, F.col("code"))).alias("other"))
    return by.groupBy(*key).agg(F.min("best").alias("best"), F.max("code").alias("code")).join(first_two, key, "left")


def last_codes(sends: DataFrame, events: DataFrame) -> DataFrame:
    """(send_id, code): the last code of the send's revision that isn't dated before ``since`` (null: any). One order of days
    for both sides, from the latest back; undated codes come first."""
    codes = events.filter(F.col("stage").isin(*CODES) & F.col("revision").isNotNull())
    far, begin = F.lit("9999-12-31").cast("date"), F.lit("0001-01-01").cast("date")
    left = codes.select("kit", "revision", F.coalesce("day", far).alias("at"), F.lit(0).alias("side"), F.struct("seq", "event_id").alias("code"), F.lit(None).cast(sends.schema["send_id"].dataType).alias("send_id"))
    right = sends.filter("revision is not null").select("kit", "revision", F.coalesce("since", begin).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(left.schema["code"].dataType).alias("code"), "send_id")
    carried = F.max("code").over(W.partitionBy("kit", "revision").orderBy(F.desc("at"), "side").rowsBetween(W.unboundedPreceding, W.currentRow))
    return left.union(right).withColumn("code", carried).filter("side = 1 and code is not null").select("send_id", "code")


def packages_of(packages: DataFrame) -> DataFrame:
    """(kit, revision, package_id): the issued package with the highest sequence, else the first grey one."""
    issued = (F.col("source") == "rd") & ~F.col("grey")
    best = packages.filter("revision is not null").groupBy("kit", "revision").agg(F.max(F.when(issued, F.struct(F.coalesce("sequence", F.lit(-1)).alias("n"), F.col("package_id").alias("id")))).alias("issued"), F.min(F.when(F.col("grey"), F.col("package_id"))).alias("stub"))
    return best.select("kit", "revision", F.coalesce("issued.id", "stub").alias("package_id")).filter("package_id is not null")


def match_cycles(sends: DataFrame, events: DataFrame, packages: DataFrame) -> DataFrame:
    """(send_id, kit, revision, reason, package_id, accepted_by, code_event) of every send.

    ``sends``: send_id, kit, number, revision, sent, received, legalized. ``events``: event_id, kit, seq (their order), stage,
    numbers, revision, day. ``packages``: package_id, kit, source, grey, revision, sequence. Numbers and revisions are
    normalised beforehand; empty ones are null.

    ``reason``: the strongest that any event has, of ``number``, ``revision`` and ``date`` (within two days of either date of
    the send); a package alone counts as ``revision``; ``legalized`` sends keep that. ``accepted_by``: of the matched events
    the one with the strongest acceptance, the latest of equals; without any an event of the kit that names no revision.
    ``code_event``: the last matched code, by number, else by date, else by revision if it isn't dated before the acceptance
    (or, without a date of that, before the send's own) where the send has a number."""
    work = Work(sends.sparkSession)
    sends, best = work.store(sends), work.store(best_of_keys(events))
    none = F.array().cast("array<date>")
    near = lambda c: F.when(F.col(c).isNull(), none).otherwise(F.sequence(F.date_sub(c, DAYS), F.date_add(c, DAYS)))
    asked = _keys(sends, F.array("number"), F.concat(near("sent"), near("received")), "send_id", "kit", F.col("revision").alias("own"))
    asked = asked.union(sends.select("send_id", "kit", "revision", F.lit("kit"), F.lit("")))
    met = asked.join(best, ["kit", "kind", "value"])
    at = lambda kind: F.col("kind") == kind
    by_date = F.when(F.col("code.revision") != F.coalesce("own", F.lit("")), F.col("code")).when(F.coalesce("own", F.lit("")) == "", F.col("code")).otherwise(F.col("other"))
    found = met.groupBy("send_id").agg(
        *[F.coalesce(F.max(at(k)), F.lit(False)).alias(k) for k in ("number", "revision", "day")], F.min(F.when(~at("kit"), F.col("best"))).alias("best"), F.min(F.when(at("kit"), F.col("best"))).alias("nameless"),
        F.max(F.when(at("number"), F.col("code"))).alias("by_number"), F.max(F.when(at("day"), by_date)).alias("by_date"),
    ).withColumnsRenamed({"number": "by_n", "revision": "by_r", "day": "by_d"})
    x = sends.join(found, "send_id", "left").withColumn("accepted", F.coalesce("best", "nameless"))
    x = work.store(x.withColumn("since", F.when(F.col("number").isNotNull(), F.coalesce("accepted.day", "received", "sent"))))
    x = x.join(last_codes(x, events).withColumnRenamed("code", "by_revision"), "send_id", "left").join(packages_of(packages), ["kit", "revision"], "left")
    reason = F.when(F.col("legalized"), "legalized").when(F.col("by_n"), "number").when(F.col("by_r"), "revision").when(F.col("by_d"), "date").when(F.col("package_id").isNotNull(), "revision").otherwise("")
    return work.finished(x.select("send_id", "kit", "revision", reason.alias("reason"), "package_id", F.col("accepted.event_id").alias("accepted_by"), F.coalesce("by_number.event_id", "by_date.event_id", "by_revision.event_id").alias("code_event")))


def last_code_of(kits: DataFrame, events: DataFrame) -> DataFrame:
    """(kit, stage, day, event_id): the last code of each kit's official revision; for a kit without one, of the events that
    name none. ``kits``: kit, official."""
    codes = events.filter(F.col("stage").isin(*CODES)).select("kit", F.coalesce("revision", F.lit("")).alias("official"), F.struct("seq", "stage", "day", "event_id").alias("code"))
    last = codes.groupBy("kit", "official").agg(F.max("code").alias("code"))
    return kits.select("kit", F.coalesce("official", F.lit("")).alias("official")).join(last, ["kit", "official"]).select("kit", "code.stage", "code.day", "code.event_id")


def code_origins(codes: DataFrame, sends: DataFrame, packages: DataFrame, rank: Callable[[Column], Column]) -> DataFrame:
    """(kit, origin): whether a kit's code came from the ``customer`` or from the reviewer (``pi``), or is ``unknown``.

    ``codes``: kit, stage, day, revision, one row a kit; ``sends``: kit, send_id, sent, revision; ``packages``: kit, source,
    grey, revision, modified. ``rank`` makes revisions comparable. Code A is the customer's. Else what was sent after the code
    decides (by dates where both are known, else what follows the kit's last official send, ``last``, a struct of sent and
    send_id): a higher revision says customer; the first of these sends with the code's own revision says pi; a higher issued
    package that is newer than the code, or undated, says customer. Each kit has one code, so nothing multiplies."""
    work_rank = lambda c: rank(F.coalesce(c, F.lit("")))
    code = codes.select("kit", F.col("stage").alias("c_stage"), F.col("day").alias("c_day"), F.col("revision").alias("c_revision"), work_rank(F.col("revision")).alias("c_rank"), "last")
    begin = F.lit("0001-01-01").cast("date")
    at = F.struct(F.coalesce("sent", begin).alias("sent"), F.col("send_id").alias("send_id"))
    after = F.when(F.col("c_day").isNotNull() & F.col("sent").isNotNull(), F.col("sent") > F.col("c_day")).when(F.col("last").isNotNull(), at > F.col("last")).otherwise(False)
    later = sends.join(code, "kit").filter(after).groupBy("kit").agg(F.max(work_rank(F.col("revision")) > F.col("c_rank")).alias("higher"), F.min(F.struct(at.alias("at"), F.col("revision").alias("revision")))["revision"].alias("first"))
    newer = F.col("c_day").isNull() | F.col("modified").isNull() | (F.col("modified") > F.col("c_day").cast("timestamp"))
    issued = packages.filter((F.col("source") == "rd") & ~F.col("grey")).join(code, "kit").filter((work_rank(F.col("revision")) > F.col("c_rank")) & newer).select("kit").distinct().withColumn("package", F.lit(True))
    x = code.join(later, "kit", "left").join(issued, "kit", "left")
    same = F.col("first") == F.col("c_revision")
    return x.select("kit", F.when(F.col("c_stage") == CODES[0], "customer").when(F.col("higher"), "customer").when(same, "pi").when(F.col("package"), "customer").otherwise("unknown").alias("origin"))


def pick_packages(kits: DataFrame, packages: DataFrame) -> DataFrame:
    """(kit, wanted, package_id): the issued package of a revision. ``kits``: kit, wanted, official; ``packages``: package_id,
    kit, source, grey, revision, material_revision, sequence, skipped.

    Without a wanted revision the newest one (highest sequence, then id); of the official revision the newest whose material
    has it, else whose name has it, else the newest of all; of any other revision only one whose name has it. Grey, skipped
    and foreign packages never count. One aggregation, no package meets another."""
    eligible = packages.filter((F.col("source") == "rd") & ~F.col("grey") & ~F.col("skipped")).select("kit", "package_id", "revision", "material_revision", F.coalesce("sequence", F.lit(-1)).alias("n"))
    x = kits.join(eligible, "kit")
    named, material = F.coalesce(F.col("revision") == F.col("wanted"), F.lit(False)), F.coalesce(F.col("material_revision") == F.col("wanted"), F.lit(False))
    tier = F.when(F.col("wanted").isNull(), 0).when(F.col("wanted").eqNullSafe(F.col("official")), F.when(material, 2).when(named, 1).otherwise(0)).when(named, 0)
    best = x.withColumn("tier", tier).filter("tier is not null").groupBy("kit", "wanted").agg(F.max(F.struct("tier", "n", "package_id"))["package_id"].alias("package_id"))
    return best
