"""Vendor match: one-to-one matching in passes where a row has several keys, cabinets must get along, and sizes guard.

Ranks can't pair such rows, for a row may refuse the supply that has its rank. So each pass is a first fit: demand in order,
each taking the first free supply by its own preference. Rows that could compete are those linked by keys, so the fold runs
over connected components of keys; a component is walked once, its demand as it comes, over trees of the supply.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from reckon.operators.clusters import components
from reckon.operators.fold import HANDED, Shelf, _batch, folded
from reckon.operators.match import HUGE
from reckon.sources.work import Work, release

#: How cabinets count: not at all; own ones first; own ones and none, in order; own ones first, then none; own ones only.
PLAIN, PREFER, EITHER, OPEN, SAME = range(5)
CHOICE = "array<struct<keys:array<string>,rule:int,guarded:boolean>>"


def choice(keys: Column, rule: int, guarded: bool = False) -> Column:
    """A level of preference: the keys that it looks at together."""
    return F.struct(keys.alias("keys"), F.lit(rule).alias("rule"), F.lit(guarded).alias("guarded"))


def each(codes: Column, key: Callable[[Column], Column], rule: int, *guards: bool) -> Column:
    """One level for each code in order, first with the size guard and then without where both are asked for."""
    return F.flatten(F.transform(codes, lambda c: F.array(*[choice(F.array(key(c)), rule, g) for g in guards or (False,)])))


class _Stock:
    """Supply in order: finds the first that is free by a level of preference. A row can lie under several keys."""

    def __init__(self, keys: list[tuple], cabinets: list, sizes: list | None = None, units: list[int] | None = None, majors: list | None = None):
        self.left, self.majors, self.shelves, self.where = units or [1] * len(keys), majors, {}, {}
        self.sizes, self.places, self.free = sizes, defaultdict(list), len(keys)
        for k, own in enumerate(keys):
            for c in {None, *(cabinets[k] or [""])}:  # None: all cabinets, empty: no cabinet
                for key in own:
                    self.places[key, c].append(k)

    def _head(self, key, cabinet: str | None, limit: float) -> int:
        at = key, cabinet
        shelf = self.shelves.get(at)
        if shelf is None:
            found = self.places.get(at)
            if found is None:
                return -1
            found = [k for k in found if self.left[k] > 0]
            shelf = self.shelves[at] = Shelf([-HUGE if self.sizes is None or self.sizes[k] is None else self.sizes[k] for k in found]) if found else None, found
            for n, k in enumerate(found):
                self.where.setdefault(k, []).append((shelf[0], n))
        place = shelf[0].first(limit) if shelf[0] else -1
        return shelf[1][place] if place >= 0 else -1

    def find(self, keys, rule: int, own: list, limit: float = HUGE) -> int:
        """The place of a free row, -1 if there is none."""
        best = None
        for n, key in enumerate(keys):
            if (key, None) not in self.places:
                continue
            if rule == PLAIN or not own and rule != SAME:
                heads = [(0, self._head(key, None, limit))]
            else:
                heads = [(0, self._head(key, x, limit)) for x in own]
                if rule in (EITHER, OPEN):
                    heads.append((int(rule == OPEN), self._head(key, "", limit)))
                elif rule == PREFER:
                    heads.append((1, self._head(key, None, limit)))
            for miss, k in heads:
                if k >= 0:
                    rank = self.majors[k] if self.majors else None
                    found = (miss, k if rank is None else rank, n, k)
                    best = found if best is None or found < best else best
        return -1 if best is None else best[3]

    def take(self, k: int) -> None:
        self.left[k] -= 1
        if self.left[k] <= 0:
            self.free -= 1
            for shelf, n in self.where.get(k, ()):
                shelf.take(n)


def _fit() -> Callable[[dict], list[tuple]]:
    """The fold of :func:`first_fit`: the supply of a component comes first, then its demand."""
    supply: list[dict] = []
    stock: list[_Stock] = []

    def step(row: dict) -> list[tuple]:
        if row["side"] == 0:
            supply.append(row)
            return []
        if not stock:
            stock.append(_Stock([(s["key"],) for s in supply], *([s[n] for s in supply] for n in ("cabinets", "size", "units", "major"))))
        for level, c in enumerate(row["choices"]):
            k = stock[0].find(c["keys"], c["rule"], row["cabinets"] or [], row["size"] if c["guarded"] and row["size"] else HUGE)
            if k >= 0:
                stock[0].take(k)
                return [(row["demand_id"], supply[k]["supply_id"], level)]
        return []

    return step


def first_fit(demand: DataFrame, supply: DataFrame, demand_order: list[str], supply_order: list[str], work: Work) -> DataFrame:
    """(demand_id, supply_id, level): demand rows in order take the first supply that is free.

    Demand: ``demand_id``, ``choices`` (CHOICE: levels in order of preference), ``cabinets``, ``size``. Supply: ``supply_id``,
    ``key``, ``cabinets``, ``size``, ``units`` (how often it can be taken) and ``major`` (a rank that goes before the place of
    the key within a level; null: the supply's own order). A size guards if both sizes are known and the demand's isn't 0."""
    order = [f"o{i}" for i in range(len(supply_order) + len(demand_order))]
    ids = {"demand_id": demand.schema["demand_id"].dataType, "supply_id": supply.schema["supply_id"].dataType}

    def side(df: DataFrame, number: int, **given: Column) -> DataFrame:
        ranks = [F.col(c) if own else F.lit(None) for own, c in [*((number == 0, c) for c in supply_order), *((number == 1, c) for c in demand_order)]]
        columns = {"key": F.lit(None).cast("string"), "choices": F.lit(None).cast(CHOICE), "units": F.lit(None).cast("long"), "major": F.lit(None).cast("long"), **{n: F.lit(None).cast(k) for n, k in ids.items()}, **given}
        return df.select(F.lit(number).alias("side"), *[r.alias(n) for r, n in zip(ranks, order, strict=True)], F.col("cabinets").alias("cabinets"), F.col("size").cast("double").alias("size"), *[c.alias(n) for n, c in columns.items()])

    d = side(demand, 1, demand_id=F.col("demand_id"), choices=F.col("choices").cast(CHOICE))
    s = side(supply.filter("key is not null"), 0, supply_id=F.col("supply_id"), key=F.col("key"), units=F.col("units").cast("long"), major=F.col("major").cast("long"))
    keys = F.array_compact(F.array_distinct(F.flatten("choices.keys")))
    d = d.withColumn("all", keys).filter(F.size("all") > 0)
    links = d.filter(F.size("all") > 1).select(F.get("all", F.lit(0)).alias("first"), F.explode("all").alias("other")).filter("first <> other").select(F.least("first", "other").alias("a"), F.greatest("first", "other").alias("b")).distinct()
    d, s = d.withColumn("group", F.get("all", F.lit(0))).drop("all"), s.withColumn("group", F.col("key"))
    if not links.isEmpty():
        roots = components(links, work).toDF("group", "root")
        d, s = (x.join(roots, "group", "left").withColumn("group", F.coalesce("root", "group")).drop("root") for x in (d, s))
    rows = s.unionByName(d)
    schema = StructType([*[StructField(n, k) for n, k in ids.items()], StructField("level", IntegerType())])
    return folded(rows, ["group"], ["side", *order], _fit, schema)


def replacement_lists(replacements: DataFrame) -> DataFrame:
    """(code, news, olds): what a code is replaced by and what it replaces, each in the order of ``place``. A list has as many
    entries as its code has replacements."""
    listed = lambda by, other, name: replacements.groupBy(F.col(by).alias("code")).agg(F.sort_array(F.collect_list(F.struct("place", other)))[other].alias(name))
    both = listed("code", "new_code", "news").join(listed("new_code", "code", "olds"), "code", "full")
    return both.select("code", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("news", "olds")])


#: The tables of the match in the order in which a walk wants their rows.
VENDOR, SPARE, DEMAND, LOOSE = range(4)


def _all(code: str | None, news: list, olds: list) -> list[str]:
    """A code and all that it is linked with, each once."""
    return [] if code is None else list(dict.fromkeys((code, *news, *olds)))


class _Demand:
    __slots__ = ("id", "tags", "code", "supply_tag", "supply_code", "cabinets", "size", "news", "olds", "s_news", "s_olds")

    def __init__(self, *given):
        self.id, self.tags, self.code, self.supply_tag, self.supply_code, self.cabinets, self.size, self.news, self.olds, self.s_news, self.s_olds = given


def _tagged(d: _Demand, codes: list) -> list[tuple]:
    return [(((t, c),), OPEN, False) for t in d.tags for c in codes] if d.code is not None else []


def _either(codes: list) -> list[tuple]:
    return [((c,), OPEN, guarded) for c in codes for guarded in (True, False)]


#: The passes in which demand takes vendors, before and after those reserved by code: levels (keys, rule, guarded) of a row.
BEFORE = {
    "own supply": lambda d: [([(d.supply_tag, c) for c in (d.supply_code, *d.s_news)], PREFER, False)] if d.supply_tag is not None and d.supply_code is not None else [],
    "supply code in its cabinet": lambda d: [((c,), SAME, True) for c in _all(d.supply_code, d.s_news, d.s_olds)] if d.cabinets else [],
    "supply code": lambda d: [((c,), OPEN, True) for c in _all(d.supply_code, d.s_news, d.s_olds)],
}
AFTER = {
    "tag and code": lambda d: _tagged(d, [d.code]),
    "tag and replacement": lambda d: _tagged(d, d.news),
    "tag and replaced code": lambda d: _tagged(d, d.olds),
    "code": lambda d: _either([c for c in (d.code, d.supply_code) if c is not None]),
    "replacement": lambda d: _either([*(d.news if d.code is not None else ()), *(d.s_news if d.supply_code is not None else ())]),
}
#: Passes whose demand takes loose supply besides, in this order.
FILLED = ("supply code in its cabinet", "supply code", "tag and code", "tag and replacement", "tag and replaced code")


def _walk(vendors: list[tuple], spare: list[tuple], demand: list[_Demand], loose: list[tuple]) -> list[tuple]:
    """All passes over the rows of a group, each table in the order of its ids. ``vendors``: (id, tag, code, cabinets, size,
    news, olds); ``spare``: (id, tag, code, cabinets, major); ``loose``: (id, code, cabinets, units)."""
    out: list[tuple] = []
    codes = {v[2] for v in vendors}
    demand = [d for d in demand if any(c in codes for c in (d.code, d.supply_code, *d.news, *d.olds, *d.s_news, *d.s_olds))]
    if not demand and not spare:
        return out
    stock = _Stock([(v[2],) if v[1] is None else (v[2], (v[1], v[2])) for v in vendors], [v[3] for v in vendors], [v[4] for v in vendors])
    kept, taken = set(), {}

    def keep(name: str, k: int, s: tuple) -> None:
        stock.take(k)
        kept.add(s[0])
        out.append((None, vendors[k][0], name, None, s[0]))

    def take(passes: dict) -> None:
        for name, levels in passes.items():
            if not stock.free:
                return
            for j, d in enumerate(demand):
                if j not in taken:
                    for keys, rule, guarded in levels(d):
                        k = stock.find(keys, rule, d.cabinets, d.size if guarded and d.size else HUGE)
                        if k >= 0:
                            stock.take(k)
                            taken[j] = name, k
                            break

    if spare:
        own = _Stock([((s[1], s[2]),) for s in spare], [s[3] for s in spare])
        for k, (_, tag, code, _, _, _, olds) in enumerate(vendors):
            at = next((x for x in (own.find(((tag, c),), PLAIN, []) for c in (code, *olds)) if x >= 0), -1) if tag is not None else -1
            if at >= 0:
                own.take(at)
                keep("reserved by tag", k, spare[at])
    take(BEFORE)
    rest = sorted((s for s in spare if s[0] not in kept), key=lambda s: (s[4], s[0])) if spare else []
    if rest and stock.free:
        own = _Stock([(s[2],) for s in rest], [s[3] for s in rest], majors=[s[4] for s in rest])
        for k, (_, _, code, cabinets, _, news, olds) in enumerate(vendors):
            at = own.find(_all(code, news, olds), EITHER, cabinets) if own.free and stock.left[k] else -1
            if at >= 0:
                own.take(at)
                keep("reserved by code", k, rest[at])
    take(AFTER)
    if not taken:
        return out
    lone = sorted((FILLED.index(name), j, k) for j, (name, k) in taken.items() if loose and name in FILLED and demand[j].supply_code is None)
    filled = {}
    if lone:
        units = _Stock([(x[1],) for x in loose], [x[2] for x in loose], units=[x[3] for x in loose])
        for _, j, k in lone:
            d, v = demand[j], vendors[k]
            cabinets = list(dict.fromkeys((*d.cabinets, *v[3])))
            wanted = dict.fromkeys((*_all(d.code, d.news, d.olds), *_all(v[2], v[5], v[6])))
            at = next((x for x in (units.find((c,), SAME if cabinets else PLAIN, cabinets) for c in wanted) if x >= 0), -1)
            if at >= 0:
                units.take(at)
                filled[j] = loose[at][0]
    out.extend((demand[j].id, vendors[k][0], name, filled.get(j), None) for j, (name, k) in taken.items())
    return out


def _values(column: pa.Array) -> list:
    """Values of an Arrow column; lists are cut from one list of their values, a null one is empty."""
    plain = lambda x: x.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_string(column.type):
        return plain(column)
    if column.null_count == len(column):
        return [[] if pa.types.is_list(column.type) else None] * len(column)
    known = plain(column.is_valid()) if column.null_count else [True] * len(column)
    if pa.types.is_list(column.type):
        values, at = _values(column.values), plain(column.offsets)
        return [values[a:b] if x else [] for a, b, x in zip(at, at[1:], known, strict=False)]
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return [v if x else None for v, x in zip(plain(column.fill_null(0)), known, strict=True)]
    return column.to_pylist()


def _walked(ids: list[str], schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walks over groups of sorted rows as they come, batch by batch; a task holds the rows of one group. ``ids``: the column
    of each table's id."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides, out, listed = None, ([], [], [], []), [], lru_cache(10_000)(lambda x: json.loads(x) if x else ([], []))
        for batch in batches:
            sides_ = _values(batch["side"])
            own = {n: _values(batch[n]) for n in set(ids)}
            id_of = own[ids[0]] if len(own) == 1 else [own[ids[s]][i] for i, s in enumerate(sides_)]
            names = ("tag", "tags", "code", "supply_code", "cabinets", "size", "lists", "s_lists", "units", "major")
            columns = [_values(batch["group"]), sides_, id_of, *(_values(batch[n]) for n in names)]
            for group, side, id_, tag, tags, code, supply_code, cabinets, size, lists, s_lists, units, major in zip(*columns, strict=True):
                if group != at:
                    if at is not None:
                        out += _walk(*sides)
                    at, sides = group, ([], [], [], [])
                    if len(out) >= HANDED:
                        yield _batch(out, target)
                        out = []
                if side == VENDOR:
                    sides[VENDOR].append((id_, tag, code, cabinets, size, *listed(lists)))
                elif side == SPARE:
                    sides[SPARE].append((id_, tag, code, cabinets, major))
                elif side == LOOSE:
                    sides[LOOSE].append((id_, code, cabinets, units))
                else:
                    same = code is not None and supply_code == code
                    sides[DEMAND].append(_Demand(id_, tags, code, tag, supply_code, cabinets, size, *listed(lists), *listed(lists if same else s_lists)))
        if at is not None:
            out += _walk(*sides)
        if out:
            yield _batch(out, target)

    return run


def vendor_match(demand: DataFrame, vendors: DataFrame, spare: DataFrame, loose: DataFrame, replacements: DataFrame) -> DataFrame:
    """(demand_id, vendor_id, pass, loose_id, spare_id): demand with its vendor row and the loose supply it takes besides, and
    vendor rows that are reserved for spare supply. What isn't in it is not found, or free.

    ``demand``: demand_id, title, tags, code, supply_tag and supply_code (of the supply that it has already, or null),
    cabinets, size. ``vendors``: vendor_id, title, tag, code, cabinets, size. ``spare``: supply that no demand has, as
    spare_id, title, tag, code, cabinets. ``loose``: supply without a tag, as loose_id, title, code, cabinets, units.
    ``replacements``: code, new_code, place. Ids give the order of rows. Codes and titles are normalised beforehand; empty
    strings are null.

    The passes, each on what is still free: vendors are *reserved* for spare supply of the same tag and code (or a code that
    the vendor's replaces); demand takes vendors by the tag and code of its own supply or what replaces that code; by the
    supply's code within its cabinet; by that code with no clash of cabinets; vendors are reserved for spare supply by code
    whatever the tag; demand takes by its tags and code, by tags and replacements, by tags and replaced codes, by codes
    alone, and by replacements of these. Demand that found a vendor (but not by its own supply's tag or in the last two
    passes) and has no supply then takes one unit of loose supply, by its own code or the vendor's and all that replace them
    or are replaced by them.

    A row only ever meets rows of its title whose codes are linked with its own by replacements, or by demand that has one
    code and its supply another. All passes of such a group are one walk, so rows cross the network once; groups without a
    vendor, or without demand and spare supply, go before it."""
    work = Work(demand.sparkSession)
    key = lambda *parts: F.concat_ws("\0", *parts)
    replacements = work.store(replacements)
    swaps = replacements.filter("code <> new_code").select(F.least("code", "new_code").alias("a"), F.greatest("code", "new_code").alias("b")).distinct()
    families = components(swaps, work).toDF("code", "family")
    # both lists of a code as one text, which is shorter in a row than two arrays
    lists = work.store(replacement_lists(replacements).join(families, "code", "left").select("code", F.to_json(F.array("news", "olds")).alias("lists"), "family"))

    def with_lists(df: DataFrame, column: str, prefix: str) -> DataFrame:
        """``lists`` and ``family`` of a code: all codes that replacements link with it are one family."""
        named = lists.select(F.col("code").alias("__c"), *[F.col(n).alias(prefix + n) for n in ("lists", "family")])
        return df.join(named, F.col(column) == F.col("__c"), "left").drop("__c").withColumn(prefix + "family", F.coalesce(prefix + "family", column))

    other = F.when(F.col("code").isNull() | (F.col("code") != F.col("supply_code")), F.col("supply_code"))
    demand = demand.filter("title is not null and (code is not null or supply_code is not null)").withColumn("other", other)
    linked = with_lists(with_lists(demand.filter("code is not null and other is not null").select("title", "code", "other").distinct(), "code", ""), "other", "s_")
    links = linked.filter("family <> s_family").select(*[f(key("title", "family"), key("title", "s_family")).alias(n) for n, f in (("a", F.least), ("b", F.greatest))]).distinct()
    demand = with_lists(with_lists(demand, "code", ""), "other", "s_").withColumn("family", F.coalesce("family", "s_family"))
    vendors = with_lists(vendors.filter("title is not null and code is not null"), "code", "")
    spare = spare.filter("title is not null and tag is not null and code is not null")
    spare = with_lists(spare.join(spare.groupBy("title", "tag").agg(F.min("spare_id").alias("major")), ["title", "tag"]), "code", "")
    loose = with_lists(loose.filter("title is not null and code is not null and units >= 1"), "code", "")

    ids = {n: df.schema[n].dataType for n, df in (("vendor_id", vendors), ("spare_id", spare), ("demand_id", demand), ("loose_id", loose))}
    at = {k: f"id{i}" for i, k in enumerate(dict.fromkeys(ids.values()))}  # ids of one type share a column
    kinds = {n: k for k, n in at.items()} | {n: "string" for n in ("tag", "code", "supply_code", "lists", "s_lists")} | {n: "array<string>" for n in ("tags", "cabinets")} | {"size": "double", "units": "long", "major": ids["spare_id"]}
    wanted = {VENDOR: (vendors, "tag code cabinets size lists"), SPARE: (spare, "tag code cabinets major"), DEMAND: (demand.withColumn("tag", F.col("supply_tag")), "tag tags code supply_code cabinets size lists s_lists"), LOOSE: (loose, "code cabinets units")}

    def side(number: int) -> DataFrame:
        df, columns = wanted[number]
        name = list(ids)[number]
        df, own = df.withColumn(at[ids[name]], F.col(name)), {at[ids[name]], *columns.split()}
        return df.select(key("title", "family").alias("group"), F.lit(number).alias("side"), *[(F.col(n) if n in own else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])

    rows = reduce(DataFrame.union, map(side, (VENDOR, SPARE, DEMAND, LOOSE)))
    links = work.store(links)
    if not links.isEmpty():
        roots = components(links, work).toDF("group", "root")
        rows = rows.join(roots, "group", "left").withColumn("group", F.coalesce("root", "group")).drop("root")
    release(work.spark)
    # the walk's order is the window's, so rows are sorted once
    order = ["hash", "group", "side", *at.values()]
    whole = W.partitionBy("hash", "group").orderBy("side", *at.values()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    has = lambda *numbers: F.max(F.col("side").isin(*numbers)).over(whole)
    rows = rows.repartition("group").withColumn("hash", F.xxhash64("group")).withColumns({"sold": has(VENDOR), "asked": has(SPARE, DEMAND)}).filter("sold and asked")
    schema = StructType([StructField(n, StringType() if n == "pass" else ids[n]) for n in ("demand_id", "vendor_id", "pass", "loose_id", "spare_id")])
    return work.finished(rows.drop("sold", "asked").sortWithinPartitions(*order).drop("hash").mapInArrow(_walked([at[k] for k in ids.values()], schema), schema))


def added_rows(pairs: DataFrame, demand: DataFrame, vendors: DataFrame, spare: DataFrame, append: bool = False) -> DataFrame:
    """(title, after, turn, kind, spare_id, vendor_id): the rows that spare supply and vendors without demand add, each behind
    the last demand row of its title (``after``), supply before vendors, in the order of their ids (``turn`` from 1).

    ``pairs``: the result of :func:`vendor_match`. Spare supply keeps the vendor that is reserved for it. Titles without demand
    add nothing, unless ``append``: then their rows come at the end, with a null ``after``. Rows without a title add nothing."""
    kept = pairs.filter("spare_id is not null").select("spare_id", "vendor_id")
    supply = spare.join(kept, "spare_id", "left").select("title", F.when(F.col("vendor_id").isNull(), "supply").otherwise("supply and vendor").alias("kind"), "spare_id", "vendor_id", F.lit(0).alias("block"), F.col("spare_id").alias("id"))
    lone = vendors.join(pairs.select("vendor_id"), "vendor_id", "left_anti").select("title", F.lit("vendor"), F.lit(None).cast(spare.schema["spare_id"].dataType), "vendor_id", F.lit(1), F.col("vendor_id"))
    anchors = demand.groupBy("title").agg(F.max("demand_id").alias("after"))
    rows = supply.union(lone).filter("title is not null").join(anchors, "title", "left" if append else "inner")
    turn = F.row_number().over(W.partitionBy("title").orderBy("block", "id"))
    return rows.select("title", "after", turn.alias("turn"), "kind", "spare_id", "vendor_id")
