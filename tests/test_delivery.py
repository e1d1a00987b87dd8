"""Leftovers of a delivery against a plain queue of units."""

import random
from collections import defaultdict

from reckon.operators import delivery as D
from reckon.plans import delivery as plans
from reckon.sources.work import Work

UNITS, ROWS = "unit_id long, key string, tag string, quantity double", "row_id long, block int, key string, tags array<string>, quantity double"


def plain(units, rows):
    """units: (id, key, tag, quantity) in order; rows: (id, block, key, tags, quantity) in order."""
    queues, out = defaultdict(list), []
    for i, k, t, q in units:
        queues[k].append([i, t or None, q])
    for block in sorted({r[1] for r in rows}):
        own = sorted((r for r in rows if r[1] == block), key=lambda r: not r[3])
        need = {r[0]: r[4] for r in own}

        def take(r, place, phase, mismatch=False):
            unit = queues[r[2]][place]
            n = min(unit[2], need[r[0]])
            unit[2] -= n
            need[r[0]] -= n
            out.append((r[0], unit[0], n, block, phase, mismatch))
            if unit[2] <= 0:
                del queues[r[2]][place]

        for phase in D.PHASES:
            for r in own:
                if r[2] is None:
                    continue
                tags = list(dict.fromkeys(r[3] or []))
                if phase == "own tag":
                    for t in tags:
                        place = next((k for k, u in enumerate(queues[r[2]]) if u[1] == t), None)
                        if place is not None and need[r[0]] > 0:
                            take(r, place, phase)
                while phase != "own tag" and need[r[0]] > 0:
                    waited = {t for o in own if o is not r and o[2] == r[2] and need[o[0]] > 0 for t in o[3] or []}
                    place = next((k for k, u in enumerate(queues[r[2]]) if u[1] is None or phase == "blind" and u[1] not in waited), None)
                    if place is None:
                        break
                    t = queues[r[2]][place][1]
                    take(r, place, phase, bool(tags) and t is not None and t not in tags)
    return out + [(None, i, q, None, "left", False) for q_ in queues.values() for i, _, q in q_]


def test_random(spark):
    r = random.Random(8)
    units, rows = [], []
    for k in range(60):
        n_tags = r.choice([1, 3, 8])
        tag = lambda: r.choice([None, "", *[f"T{j}" for j in range(n_tags)] * 2])  # noqa: B023, E731
        units += [(100 * k + j, f"k{k}", tag(), float(r.randint(1, 6))) for j in range(r.randint(0, 25))]
        rows += [(100 * k + j, r.randint(1, 2), f"k{k}", r.choice([None, [], [f"T{r.randrange(n_tags)}"], ["T1", "T0"], ["T0", "T2", "T0"]]), float(r.choice([0, 1, 2, 5, 9]))) for j in range(r.randint(0, 20))]
    units.append((9999, None, "T1", 3.0))
    rows.append((9999, 1, None, ["T1"], 3.0))
    got = D.leftovers(spark.createDataFrame(units, UNITS), spark.createDataFrame(rows, ROWS), ["key"], ["unit_id"], ["row_id"])
    found = [tuple(x) for x in got.collect()]
    assert sorted(found, key=str) == sorted(plain(units, rows), key=str)
    given = defaultdict(float)
    for x in found:
        given[x[1]] += x[2]
    assert given == {u[0]: u[3] for u in units}  # every unit comes out again
    assert {x[4] for x in found} == {"own tag", "untagged", "blind", "left"} and {x[5] for x in found} == {True, False}


def test_hot_key_and_empty(spark):
    n = 20_000
    units = [(k, "k", f"T{k % 5000}" if k % 3 else None, 2.0) for k in range(n)]
    rows = [(k, 1 + k % 2, "k", [f"T{k % 4000}"] if k % 2 else [], 3.0) for k in range(n)]
    got = D.leftovers(spark.createDataFrame(units, UNITS), spark.createDataFrame(rows, ROWS), ["key"], ["unit_id"], ["row_id"])
    assert got.agg({"allocated": "sum"}).first()[0] == 2.0 * n
    none = D.leftovers(spark.createDataFrame([], UNITS), spark.createDataFrame(rows[:5], ROWS), ["key"], ["unit_id"], ["row_id"])
    assert none.collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    demand, rows, units = plans.sides(spark, d)
    pairs, rest = plans.rest_of(demand, units, Work(spark))
    left = sorted(((r.actual, r.unit_id, f"{r.title}|{r.code}", r.tag, r.quantity) for r in rest.collect()))
    asked = sorted((r.row_id, r.block, f"{r.title}|{r.code}", r.tags, float(r.quantity)) for r in rows.collect())
    got = [tuple(r) for r in plans.delivery_leftovers(spark, d).collect()]
    assert sorted(got, key=str) == sorted(plain([x[1:] for x in left], asked), key=str)
    total = units.agg({"quantity": "sum"}).first()[0]
    assert pairs.agg({"allocated": "sum"}).first()[0] + sum(r[2] for r in got) == total
    assert plans.delivery_created(spark, d).agg({"quantity": "sum"}).first()[0] == sum(r[2] for r in got if r[0] is None)
