"""What the global phases of a delivery leave over: given to other rows in blocks, and to rows made for what is left then.

The supplier is dropped from the key, so units that no demand of their supplier took meet rows of the same title and code.
Blocks go one after the other, and within a block three phases: units of a row's own tags, units without a tag, then any that
no other row of the block still needs by its tag. That hangs on every row before, so a key is folded in order.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from reckon.operators.fold import folded

#: Quantities under this are nothing.
LEAST = 1e-9
OWN, UNTAGGED, BLIND = range(3)
PHASES = ("own tag", "untagged", "blind")


class _Leftovers:
    """State of one key: units by tag in order, and what the rows of the current block still need."""

    def __init__(self):
        self.units: dict[str | None, deque[list]] = defaultdict(deque)  # [place, id, quantity]
        self.n, self.block = 0, None

    def __call__(self, row: dict) -> list[tuple]:
        if row["side"] == 0:
            self.units[row["tag"]].append([self.n, row["unit_id"], row["quantity"]])
            self.n += 1
            return []
        if row["block"] != self.block:
            self.block, self.needs, self.wanted, self.heads = row["block"], {}, Counter(), None
        if row["phase"] == OWN:
            self.needs[row["row_id"]] = row["quantity"]
            if row["quantity"] > LEAST:
                self.wanted.update(set(row["tags"]))
            return self.take_own(row)
        if row["phase"] == UNTAGGED:
            return [x for x in iter(lambda: self.take(row, None), None)]
        return self.take_any(row)

    def take(self, row: dict, tag: str | None, mismatch: bool = False) -> tuple | None:
        """What the row takes of the first unit of a tag; None if there is none or it needs none."""
        need, units = self.needs[row["row_id"]], self.units.get(tag)
        if need <= LEAST or not units:
            return None
        unit = units[0]
        taken = min(unit[2], need)
        unit[2] -= taken
        self.needs[row["row_id"]] = need - taken
        if unit[2] <= LEAST:
            units.popleft()
        if need - taken <= LEAST:  # its tags are no longer kept for it
            for t in set(row["tags"]):
                self.wanted[t] -= 1
                if not self.wanted[t] and self.heads is not None and self.units.get(t):
                    heapq.heappush(self.heads, (self.units[t][0][0], t))
        return (row["row_id"], unit[1], taken, row["block"], PHASES[row["phase"]], mismatch)

    def take_own(self, row: dict) -> list[tuple]:
        return [x for t in row["tags"] if (x := self.take(row, t))]  # one unit of each tag

    def take_any(self, row: dict) -> list[tuple]:
        if self.heads is None:  # first units of the tags that nobody waits for, and of those without a tag
            self.heads = [(u[0][0], t) for t, u in self.units.items() if u and (t is None or not self.wanted[t])]
            heapq.heapify(self.heads)
        out, own = [], set(row["tags"])
        while self.needs[row["row_id"]] > LEAST:
            while self.heads and not self.open(*self.heads[0]):
                heapq.heappop(self.heads)
            mine = [(self.units[t][0][0], t) for t in own if self.units.get(t) and self.wanted[t] <= 1]
            if not self.heads and not mine:
                break
            place, tag = min(mine + self.heads[:1], key=lambda x: x[0])
            out.append(self.take(row, tag, bool(own) and tag is not None and tag not in own))
            if self.units.get(tag) and (tag is None or not self.wanted[tag]) and self.units[tag][0][0] != place:
                heapq.heappush(self.heads, (self.units[tag][0][0], tag))
        return out

    def open(self, place: int, tag: str | None) -> bool:
        """Whether a noted first unit still is one, and nobody waits for its tag."""
        units = self.units.get(tag)
        return bool(units) and units[0][0] == place and (tag is None or not self.wanted[tag])

    def end(self) -> list[tuple]:
        left = sorted(u for units in self.units.values() for u in units)
        return [(None, unit_id, quantity, None, "left", False) for _, unit_id, quantity in left]


def leftovers(units: DataFrame, rows: DataFrame, keys: list[str], unit_order: list[str], row_order: list[str]) -> DataFrame:
    """(row_id, unit_id, allocated, block, phase, mismatch), and what nobody takes with a null ``row_id`` and phase ``left``.

    ``units``: unit_id, ``keys``, tag, quantity, laid out by ``unit_order``. ``rows``: row_id, block (1 goes first), ``keys``,
    tags, quantity, in ``row_order``; within a block rows with tags go first. Every unit's quantity comes out again. A row takes
    one unit for each of its tags, in their order; ``mismatch``: a row that has tags took a unit of another one. Null keys meet
    nothing, but their units are left over all the same."""
    names, order = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(unit_order) + len(row_order))]
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    kinds = {"unit_id": units.schema["unit_id"].dataType, "row_id": rows.schema["row_id"].dataType, "tag": StringType(), "tags": ArrayType(StringType()), "block": IntegerType(), "phase": IntegerType(), "bare": BooleanType()}

    def side(df: DataFrame, number: int, **given) -> DataFrame:
        own = [given.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()]
        ranks = [F.col(c) if own else F.lit(None) for own, c in [*((number == 0, c) for c in unit_order), *((number == 1, c) for c in row_order)]]
        return df.select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], F.lit(number).alias("side"), *own, *[r.alias(n) for r, n in zip(ranks, order, strict=True)], F.col("quantity").cast("double").alias("quantity"))

    stock = side(units.filter(F.col("quantity") > LEAST), 0, unit_id=F.col("unit_id"), tag=F.when(F.col("tag") != "", F.col("tag")))
    asking = rows.filter(F.col("quantity") > LEAST).dropna(subset=keys).withColumn("phase", F.explode(F.array(*map(F.lit, (OWN, UNTAGGED, BLIND)))))
    asking = side(asking, 1, row_id=F.col("row_id"), tags=F.array_distinct(F.array_compact(tags)), block=F.col("block"), phase=F.col("phase"), bare=F.size(tags) == 0)
    schema = StructType([StructField("row_id", kinds["row_id"]), StructField("unit_id", kinds["unit_id"]), StructField("allocated", DoubleType()), StructField("block", IntegerType()), StructField("phase", StringType()), StructField("mismatch", BooleanType())])
    return folded(stock.union(asking), names, ["side", "block", "phase", "bare", *order], _Leftovers, schema)


def created(left: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Rows made for what nobody takes: one for each key and tag, with its quantity and its units."""
    rest = left.filter("phase = 'left'").select("unit_id", "allocated").join(units.select("unit_id", *keys, "tag"), "unit_id")
    return rest.groupBy(*keys, "tag").agg(F.sum("allocated").alias("quantity"), F.count("*").alias("units"))
