"""Audit of how five filters act together, by aggregated edges of the lattice of filter subsets.

A document is a set of the filters that it fails. Whatever the order, a filter's step depends only on the set of filters
that ran before it, so the 600 steps of the 120 orders are 80 different edges (subset already applied, next filter). One
pass over the texts works out each document's failures as a mask of bits; documents are added up by part and mask before
anything else happens; the sums go to the edges, and the edges are joined to the steps of all orders. An edge lies in
``|subset|! * (4 - |subset|)!`` orders, which weighs it in a filter's Shapley total.

Filter E asks whether a smaller document has the same text. The least id of each text is an aggregate (partly worked out
before the exchange, so a text with very many copies is no matter); rows that own their text are found by a join on text
digest and id, which spreads the copies of a text over all tasks. Texts are compared by SHA-256 and length. Only narrow
rows are exchanged or stored: part, id, mask, digest and labels. The last tables have a row for each part and mask.

Defined results: a null text is empty, and so it is a copy of other empty texts; a null part is the empty string; a null id
comes after all others, and rows without one are no copies of each other; rows that share id and text don't make each other
fail E; several labels of an id count as the largest; ids without labels, and null labels, lose nothing; labels of unknown
ids are left out. Empty tables give no rows. Columns are picked by name, extra ones never matter.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from reckon.llm import common as C
from reckon.llm.quality import let, words_of

FILTERS = "ABCDE"
#: Limits of filters A, B and C: words, and per cent of distinct words and of capital letters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = "[#$%&*|]"
COPY = 1 << FILTERS.index("E")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def edges() -> list[tuple[int, int, int]]:
    """(subset that ran, bit of the next filter, orders that have this edge)."""
    n = len(FILTERS)
    return [(s, 1 << f, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in range(1 << n) for f in range(n) if not s >> f & 1]


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step from 1, subset before it, bit of its filter) of all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), k + 1, before, bit))
            before |= bit
    return out


def own_failures(text: Column) -> Column:
    """Bits of the filters that look at the text alone (A to D); ``text`` is not null."""

    def of(t: Column) -> Column:
        return let(words_of(t), lambda w: let(F.size(w), lambda n: sum_of([
            n < LEAST_WORDS, 100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * n, 100 * F.regexp_count(t, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(t), t.rlike(SYMBOLS),
        ])))

    return let(text, of)


def sum_of(failed: list[Column]) -> Column:
    out = F.lit(0)
    for k, x in enumerate(failed):
        out = out + F.when(x, 1 << k).otherwise(0)
    return out


def classes(docs: DataFrame, labels: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(part, mask, quality, toxic, n): documents by part, failed filters and labels."""
    flag = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1).otherwise(0)), F.lit(0))
    named = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l")).agg(flag("quality").alias("quality"), flag("toxic").alias("toxic"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(C.LAST_ID)).alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), own_failures(text).cast("int").alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = scratch.write(rows.join(named, rows["id"] == F.col("l"), "left").select("id", "part", "mask", "digest", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id"))
    by = ["part", "mask", "quality", "toxic"]
    owners = rows.join(firsts, ["digest", "id"], "left_semi").groupBy(*by).agg(F.count("*").alias("n"))
    everyone = rows.groupBy(*by).agg(F.count("*").alias("n"))
    copies = everyone.union(owners.withColumn("n", -F.col("n"))).withColumn("mask", F.col("mask") + COPY)
    return owners.union(copies).groupBy(*by).agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. ``docs`` has doc_id, text and source, ``labels`` has doc_id, quality and toxic."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    sums = C.written(classes(C.fresh(docs, "doc_id", "text", "source"), C.fresh(labels, "doc_id", "quality", "toxic"), scratch))
    scratch.drop()
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("before"), F.lit(f).alias("bit"), F.lit(w).alias("orders")) for s, f, w in edges()]))
    rows = sums.select("*", each.alias("e")).select("*", "e.*")
    mask, before, bit, n = (F.col(c) for c in ("mask", "before", "bit", "n"))
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    counted = {
        "kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == bit,
        "good_lost": fails & ~gone & (F.col("quality") == 1), "toxic_lost": fails & ~gone & (F.col("toxic") == 1),
    }
    lattice = rows.groupBy("part", "before", "bit", "orders").agg(*[F.sum(F.when(counted[c], n).otherwise(0)).cast("long").alias(c) for c in COUNTS])
    lattice = lattice.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(W.partitionBy("part", "bit")))  # 16 edges
    schema = T.StructType([T.StructField("filter_order", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("step", "before", "bit")]])
    paths = F.broadcast(spark.createDataFrame(steps(), schema))  # 600 rows
    return lattice.join(paths, ["before", "bit"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every document of ``documents``, with what ``labels`` knows of it."""
    return audit(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


#: The same by subqueries over all orders, straight from the definition.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 f AS (SELECT doc_id, part, t, min(doc_id) OVER (PARTITION BY t) AS first, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
   100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d FROM d),
 m AS (SELECT part, [x for x in [CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN coalesce(doc_id > first, doc_id IS NULL AND first IS NOT NULL) THEN 'E' END] if x IS NOT NULL] AS fails,
   coalesce(good, false) AS good, coalesce(bad, false) AS bad FROM f LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id) USING (doc_id)),
 g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM m GROUP BY ALL),
 l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
 o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
 s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS x, string_split(substr(filter_order, 1, step - 1), '') AS before FROM o, range(1, 6) AS t(step)),
 e AS (SELECT part, filter_order, step, x, n, good, bad, fails, list_contains(fails, x) AS hit, list_has_any(fails, before) AS gone FROM g, s),
 r AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
   coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = [x]), 0)::BIGINT AS unique_fails,
   coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r
"""
