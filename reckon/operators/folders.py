"""Folders and the documents in them: nested folders, means over a folder without a document's own files, bundles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.sources.work import Work


def path_key(path: Column) -> Column:
    """Lower case, one kind of slash, none doubled, ended by one: a folder's key begins the keys of all folders in it."""
    return F.regexp_replace(F.concat(F.lower(F.trim(path)), F.lit("/")), r"[/\\]+", "/")


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted keys those that none before them in this task begins."""
    last, task = None, TaskContext.get().partitionId()
    for batch in batches:
        keys, ids, n = batch["key"].to_pylist(), batch["folder_id"].to_pylist(), []
        for k, key in enumerate(keys):
            if last is None or not key.startswith(last):
                last = key
                n.append(k)
        yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in n], pa.string()), pa.array([ids[k] for k in n], batch.schema.field("folder_id").type), pa.array([task] * len(n), pa.int32())], names=["key", "folder_id", "task"])


def outermost(folders: DataFrame, work: Work) -> DataFrame:
    """(folder_id, key) of the folders that lie in no other one; of equal keys the least id stays. ``folders``: folder_id, path.

    Keys are sorted over all tasks, and all folders in one follow it directly. So a task needs no more than the last key it
    kept, and between tasks the last key that one kept is carried to the next: one row a task is looked at on the driver."""
    keys = folders.filter("path is not null").select(path_key(F.col("path")).alias("key"), "folder_id").filter("key <> '/'").groupBy("key").agg(F.min("folder_id").alias("folder_id"))
    kind = folders.schema["folder_id"].dataType.simpleString()
    local = work.store(keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_swept, f"key string, folder_id {kind}, task int"))
    ends = sorted(local.groupBy("task").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect(), key=lambda r: r["first"].encode())
    carried, carry = {}, None
    for r in ends:
        if carry is not None and r["first"].startswith(carry):
            carried[r["task"]] = carry
        if carry is None or not r["last"].startswith(carry):
            carry = r["last"]
    if not carried:
        return local.select("folder_id", "key")
    over = folders.sparkSession.createDataFrame(list(carried.items()), "task int, over string")
    return local.join(F.broadcast(over), "task", "left").filter(F.col("over").isNull() | ~F.col("key").startswith(F.col("over"))).select("folder_id", "key")  # a row a task


def means_without_own(files: DataFrame, work: Work) -> DataFrame:
    """(file_id, mean, used, skipped): for each file the mean time of its folder's files but those of its own stem, how many
    have one, and how many were left out. Null where no other file of the folder has a time.

    ``files``: file_id, folder, stem, time (a whole number; 0 or null is none). Sums by stem and sums by folder, one from the
    other; no file meets the files of its folder."""
    dated = F.when(F.col("time") > 0, F.col("time")).cast("decimal(28,0)")
    stems = work.store(files.groupBy("folder", "stem").agg(F.sum(dated).alias("s"), F.count(dated).alias("n"), F.count("*").alias("all")))
    whole = work.store(stems.groupBy("folder").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn")))
    rest = work.store(stems.join(whole, "folder").select("folder", "stem", (F.col("fs") - F.coalesce("s", F.lit(0))).alias("s"), (F.col("fn") - F.col("n")).alias("used"), F.col("all").alias("skipped")))
    mean = F.when(F.col("used") > 0, F.floor((F.col("s") / F.col("used")).cast("decimal(38,6)")).cast("long"))
    return files.select("file_id", "folder", "stem").join(rest, ["folder", "stem"]).select("file_id", mean.alias("mean"), "used", "skipped")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def bundles(files: DataFrame, keys: list[str], work: Work) -> DataFrame:
    """(file_id, keys, role, primary_id): what each file is to its document.

    ``files``: file_id, keys, kind (``pdf`` or another), folder, time, current. A document's primary is its newest pdf, of the
    current ones if it has any; of equally new ones the least id. Other pdfs are ``extra``. A file of another kind is
    ``paired`` if it lies in the primary's folder or in a folder DWG in that or beside it, else ``unpaired``."""
    pdf = F.col("kind") == "pdf"
    rank = F.struct(F.col("current"), F.coalesce("time", F.lit(0)).cast("long").alias("time"), (-F.col("file_id")).alias("back"), F.col("folder"), F.col("file_id"))
    primaries = work.store(files.filter(pdf).groupBy(*keys).agg(F.max(rank).alias("p")).select(*keys, F.col("p.file_id").alias("primary_id"), F.col("p.folder").alias("home")))
    on = [files[k].eqNullSafe(primaries[k]) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    x = files.join(primaries.select(*[primaries[k] for k in keys], "primary_id", "home"), condition, "left").select("file_id", *[files[k] for k in keys], "kind", F.lower("folder").alias("folder"), "primary_id", F.lower("home").alias("home"))
    near = (F.col("folder") == F.col("home")) | (F.col("folder").endswith("/dwg") & ((parent(F.col("folder")) == F.col("home")) | (parent(F.col("folder")) == parent(F.col("home")))))
    role = F.when(pdf & (F.col("file_id") == F.col("primary_id")), "primary").when(pdf, "extra").when(F.coalesce(near, F.lit(False)), "paired").otherwise("unpaired")
    return x.select("file_id", *keys, role.alias("role"), F.when(role.isin("primary", "paired"), F.col("primary_id")).alias("primary_id"))


def bundle_counts(members: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each bundle: its primary (null for the files without one) and its files."""
    return members.filter("role <> 'extra'").groupBy(*keys, "primary_id").agg(F.count(F.when(F.col("role") != "primary", 1)).alias("editables"), F.max("file_id").alias("last_id"))

