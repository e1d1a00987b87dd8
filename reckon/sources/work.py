"""Tables written on the way: a cut of the lineage that survives lost executors, and goes when it is done with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")
    if not base and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or "file:///tmp/checkpoints").rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local master may do without that setting. It goes when the
    application ends, if nothing has removed it by then."""
    path = f"{_base(spark)}/{uuid.uuid4().hex}"
    place, files = _place(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that are over; it does so when the driver collects its garbage."""
    spark._jvm.System.gc()


class Work:
    """Stored tables of one job. Those of a step that is over can go by :meth:`forget`, all of them by :meth:`drop`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, work_folder(spark), 0

    def store(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, before: int) -> None:
        """Removes the tables stored before the one with this number."""
        for k in range(max(1, getattr(self, "kept", 1)), before):
            remove(self.spark, f"{self.base}/{k}")
        self.kept = max(before, getattr(self, "kept", 1))

    def drop(self) -> None:
        remove(self.spark, self.base)

    def finished(self, df: DataFrame) -> DataFrame:
        """A result that reads these tables, stored by itself; they go."""
        path = work_folder(self.spark)
        df.write.mode("overwrite").parquet(path)
        self.drop()
        return self.spark.read.schema(df.schema).parquet(path)
