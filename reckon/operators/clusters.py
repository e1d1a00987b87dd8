"""Clusters of ids that share something."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.sources.work import Work


def components(edges: DataFrame, work: Work) -> DataFrame:
    """(id, root) of every id that can reach a smaller one, root being the least. ``edges``: (a, b), null-free.

    In each round every id hangs itself below its least smaller neighbour, chains are shortened to their ends by doubling,
    and edges are drawn between the ends; what is left has at most half of the ids. All joins are between stored tables, so
    that an id with very many edges is split over tasks."""
    low = lambda x, y: edges_of(x, y).filter("a < b").distinct()
    edges = work.store(low(edges, ("a", "b")))
    roots = None
    while True:
        up = work.store(edges.groupBy("b").agg(F.min("a").alias("m")))
        while True:
            further = up.select(F.col("b").alias("m"), F.col("m").alias("further"))
            jumped = work.store(up.join(further, "m", "left").select("b", F.coalesce("further", "m").alias("m"), F.col("further").isNotNull().alias("moved")))
            up = jumped.select("b", "m")
            if jumped.filter("moved").isEmpty():
                break
        found = up.toDF("id", "root")
        if roots is not None:
            found = found.union(roots.join(up.toDF("root", "m"), "root", "left").select("id", F.coalesce("m", "root")))
        roots = work.store(found)
        ends = edges.join(up.toDF("a", "ma"), "a", "left").join(up.toDF("b", "mb"), "b", "left").select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
        edges = work.store(low(ends, ("x", "y")))
        if edges.isEmpty():
            return roots


def edges_of(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
    return df.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))


def connected(pairs: DataFrame, left: str, right: str, work: Work | None = None) -> DataFrame:
    """(id, cluster): ids linked through shared values get the least id among them. Each value makes a star around its least
    id, never all pairs; a value that very many ids have is split over tasks, for both sides of its join are stored. Null ids
    are left out, and a null value links nothing."""
    own = work or Work(pairs.sparkSession)
    links = own.store(pairs.select(F.col(left).alias("id"), F.col(right).alias("value")).filter("id is not null").distinct())
    stars = own.store(links.filter("value is not null").groupBy("value").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("value", "least"))
    roots = components(links.join(stars, "value").select(F.col("least").alias("a"), F.col("id").alias("b")), own)
    out = links.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))
    return out if work else own.finished(out)
