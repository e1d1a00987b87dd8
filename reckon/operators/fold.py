"""Ordered folds over the rows of a key, for what hangs on every row before it.

Rows are dealt by key and sorted by Spark (with spill); a task then walks over them as they come, batch by batch. A key is
never gathered into one row or one table: what a task holds is the fold's own state of one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of output that a task hands on at once.
HANDED = 10_000


def folded(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[], Callable[[dict], list[tuple]]], schema: StructType) -> DataFrame:
    """``step()`` makes a new state for each key, a function from a row to output rows; it sees the key's rows in order. If it
    has a method ``end``, that gives the key's last output rows."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for batch in batches:
            columns = [batch[k].to_pylist() for k in keys]
            for key, row in zip(zip(*columns), batch.to_pylist(), strict=True):
                if state is None or key != at:
                    out += _ended(state)
                    at, state = key, step()
                out += state(row)
                if len(out) >= HANDED:
                    yield _batch(out, target)
                    out = []
        out += _ended(state)
        if out:
            yield _batch(out, target)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _ended(state) -> list[tuple]:
    return state.end() if hasattr(state, "end") else []


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target, strict=True)], schema=target)


class Shelf:
    """Sizes in a fixed order; finds the first one that is still there and not over a limit, in time that grows with the
    logarithm of their number."""

    def __init__(self, sizes: list[float]):
        self.width = 1
        while self.width < len(sizes):
            self.width *= 2
        gone = [float("inf")]
        self.least = gone * self.width + sizes + gone * (self.width - len(sizes))  # a tree of minima over the sizes
        for k in range(self.width - 1, 0, -1):
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])

    def first(self, limit: float, start: int = 0) -> int:
        """Its place, from ``start`` on; -1 if there is none."""
        least, k = self.least, self.width + start
        if start >= self.width:
            return -1
        while not least[k] <= limit or least[k] == float("inf"):  # up and to the right until a part holds one
            while k & 1:
                k >>= 1
            if k == 0:
                return -1
            k += 1
        while k < self.width:
            k *= 2
            if not least[k] <= limit or least[k] == float("inf"):
                k += 1
        return k - self.width

    def take(self, place: int) -> None:
        k = self.width + place
        self.least[k] = float("inf")
        while k > 1:
            k >>= 1
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])
