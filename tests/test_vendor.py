"""The vendor match against a plain greedy walk, on random tables and on the query's own input."""

import random
import time

from reckon.operators import vendor as V
from reckon.plans import vendor as plans
from reckon.sources.work import Work

SCHEMAS = {
    "demand": "demand_id long, title string, tags array<string>, code string, supply_tag string, supply_code string, cabinets array<string>, size double",
    "vendors": "vendor_id long, title string, tag string, code string, cabinets array<string>, size double",
    "spare": "spare_id long, title string, tag string, code string, cabinets array<string>",
    "loose": "loose_id long, title string, code string, cabinets array<string>, units long",
    "replacements": "code string, new_code string, place int",
}


def plain(demand, vendors, spare, loose, replacements):
    """One row after the other, each over all candidates."""
    news, olds = {}, {}
    for r in sorted(replacements, key=lambda r: (r["place"], r["new_code"])):
        news.setdefault(r["code"], []).append(r["new_code"])
    for r in sorted(replacements, key=lambda r: (r["place"], r["code"])):
        olds.setdefault(r["new_code"], []).append(r["code"])
    all_codes = lambda c: list(dict.fromkeys([c, *news.get(c, []), *olds.get(c, [])])) if c else []
    demand, vendors, spare, loose = (sorted(x, key=lambda r: r[k]) for x, k in ((demand, "demand_id"), (vendors, "vendor_id"), (spare, "spare_id"), (loose, "loose_id")))
    same = lambda d, v: bool(set(d["cabinets"] or []) & set(v["cabinets"] or []))
    clash = lambda d, v: bool(d["cabinets"]) and bool(v["cabinets"]) and not same(d, v)
    small = lambda d, v: not d["size"] or v["size"] is None or v["size"] <= d["size"]
    used, reserved, found, out = set(), {}, {}, []
    left = {r["loose_id"]: r["units"] for r in loose}

    def spare_fits(v, tag, code):
        return [s for s in spare if s["spare_id"] not in reserved and s["tag"] and s["code"] and (s["title"], s["code"]) == (v["title"], code) and (tag is None or s["tag"] == tag)]

    def keep(v, s, name):
        used.add(v["vendor_id"])
        reserved[s["spare_id"]] = v["vendor_id"]
        out.append((None, v["vendor_id"], name, None, s["spare_id"]))

    def fits(d, tag, codes, prefer=True):
        own = [v for v in vendors if v["vendor_id"] not in used and v["title"] == d["title"] and v["code"] in codes and (tag is None or v["tag"] == tag)]
        return sorted(own, key=lambda v: not same(d, v)) if d["cabinets"] and prefer else own

    def give(d, v, name, extra):
        used.add(v["vendor_id"])
        got = None
        if extra and not d["supply_code"]:
            cabinets = {*(d["cabinets"] or []), *(v["cabinets"] or [])}
            for c in list(dict.fromkeys([*all_codes(d["code"]), *all_codes(v["code"])])):
                for s in loose:
                    if got is None and s["title"] == d["title"] and s["code"] == c and left[s["loose_id"]] >= 1 and (not cabinets or cabinets & set(s["cabinets"] or [])):
                        got = s["loose_id"]
            if got is not None:
                left[got] -= 1
        found[d["demand_id"]] = True
        out.append((d["demand_id"], v["vendor_id"], name, got, None))

    def demand_pass(name, candidates, extra):
        for d in demand:
            if d["demand_id"] not in found and d["title"]:
                v = next(candidates(d), None)
                if v:
                    give(d, v, name, extra)

    for v in vendors:
        if v["tag"] and v["code"] and v["title"]:
            s = next((s for c in [v["code"], *olds.get(v["code"], [])] for s in spare_fits(v, v["tag"], c)), None)
            if s:
                keep(v, s, "reserved by tag")
    demand_pass("own supply", lambda d: iter(fits(d, d["supply_tag"], {d["supply_code"], *news.get(d["supply_code"], [])}) if d["supply_tag"] and d["supply_code"] else []), False)
    demand_pass("supply code in its cabinet", lambda d: (v for c in all_codes(d["supply_code"]) for v in fits(d, None, {c}) if same(d, v) and small(d, v)), True)
    demand_pass("supply code", lambda d: (v for c in all_codes(d["supply_code"]) for v in fits(d, None, {c}) if not clash(d, v) and small(d, v)), True)
    tags = {}
    for s in spare:
        if s["tag"] and s["code"]:
            tags.setdefault(s["title"], {}).setdefault(s["tag"])
    for v in vendors:
        if v["code"] and v["title"] and v["vendor_id"] not in used:
            s = next((s for t in tags.get(v["title"], {}) for c in all_codes(v["code"]) for s in spare_fits(v, t, c) if not clash(s, v)), None)
            if s:
                keep(v, s, "reserved by code")
    for name, codes in (("tag and code", lambda d: [d["code"]]), ("tag and replacement", lambda d: news.get(d["code"], [])), ("tag and replaced code", lambda d: olds.get(d["code"], []))):
        demand_pass(name, lambda d, codes=codes: (v for t in d["tags"] or [] if d["code"] for c in codes(d) for v in fits(d, t, {c}) if not clash(d, v)), True)
    guarded = lambda d, codes: (v for c in codes for g in (True, False) for v in fits(d, None, {c}) if not clash(d, v) and (not g or small(d, v)))
    demand_pass("code", lambda d: guarded(d, [c for c in (d["code"], d["supply_code"]) if c]), False)
    demand_pass("replacement", lambda d: guarded(d, [n for c in (d["code"], d["supply_code"]) if c for n in news.get(c, [])]), False)
    return out


def random_tables(seed, n=120, titles=3, codes=4):
    r = random.Random(seed)
    title = lambda: r.choice([None] + [f"t{k}" for k in range(titles)] * 4)
    code = lambda: r.choice([None] + [f"c{k}" for k in range(codes)] * 3)
    tag = lambda: r.choice([None, "T0", "T1", "T2"])
    cabinets = lambda k: r.choice([[], [], None, ["A"], ["B"], ["A", "B"][:k]])
    size = lambda: r.choice([None, 0.0, 1.0, 2.0, 3.0])
    return {
        "demand": [dict(demand_id=k, title=title(), tags=r.choice([None, [], ["T0"], ["T1", "T2"], ["T2", "T0"]]), code=code(), supply_tag=tag(), supply_code=r.choice([None, code()]), cabinets=cabinets(2), size=size()) for k in range(n)],
        "vendors": [dict(vendor_id=k, title=title(), tag=tag(), code=code(), cabinets=cabinets(1), size=size()) for k in range(n)],
        "spare": [dict(spare_id=k, title=title(), tag=tag(), code=code(), cabinets=cabinets(1)) for k in range(n // 4)],
        "loose": [dict(loose_id=k, title=title(), code=code(), cabinets=cabinets(1), units=r.randint(0, 2)) for k in range(n // 3)],
        "replacements": [dict(code=a, new_code=b, place=p) for a, b, p in (("c0", "c1", 0), ("c0", "c2", 1), ("c1", "c3", 0), ("c2", "c0", 0))],
    }


def frames(spark, tables):
    return {k: spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMAS[k].split(", ")) for r in rows], SCHEMAS[k]) for k, rows in tables.items()}


def test_random_tables(spark):
    """Four random corpora at once, told apart by their titles and ids."""
    tables = {k: [] for k in SCHEMAS}
    for seed in range(4):
        for k, rows in random_tables(seed, titles=1 + seed).items():
            if k != "replacements":
                tables[k] += [r | {"title": r["title"] and f"{seed}{r['title']}", (i := next(iter(r))): 1000 * seed + r[i]} for r in rows]
            else:
                tables[k] = rows
    got = [tuple(r) for r in V.vendor_match(**frames(spark, tables)).collect()]
    assert sorted(got, key=str) == sorted(plain(**tables), key=str)
    assert len({r[2] for r in got} | {"loose" for r in got if r[3] is not None}) == 11


def plain_added(pairs, demand, vendors, spare, append):
    reserved, used = {p[4]: p[1] for p in pairs if p[4] is not None}, {p[1] for p in pairs}
    out = []
    for title in sorted({r["title"] for r in (*vendors, *spare) if r["title"]}):
        own = [d["demand_id"] for d in demand if d["title"] == title]
        if own or append:
            new = [("supply and vendor" if s["spare_id"] in reserved else "supply", s["spare_id"], reserved.get(s["spare_id"])) for s in sorted(spare, key=lambda r: r["spare_id"]) if s["title"] == title]
            new += [("vendor", None, v["vendor_id"]) for v in sorted(vendors, key=lambda r: r["vendor_id"]) if v["title"] == title and v["vendor_id"] not in used]
            out += [(title, max(own, default=None), k + 1, *r) for k, r in enumerate(new)]
    return out


def test_added_rows(spark):
    tables = random_tables(5)
    tables["vendors"].append(dict(vendor_id=900, title="alone", tag=None, code="c0", cabinets=[], size=None))
    pairs = plain(**tables)
    own = frames(spark, tables)
    stored = spark.createDataFrame(pairs, "demand_id long, vendor_id long, pass string, loose_id long, spare_id long")
    for append in (False, True):
        got = V.added_rows(stored, own["demand"], own["vendors"], own["spare"], append)
        want = plain_added(pairs, tables["demand"], tables["vendors"], tables["spare"], append)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len({r[3] for r in want}) == 3


def test_empty(spark):
    none = {k: [] for k in SCHEMAS}
    assert V.vendor_match(**frames(spark, none)).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    tables = {k: [r.asDict() for r in df.collect()] for k, df in plans.sides(spark, d).items()}
    got = [tuple(r) for r in plans.vendor_match(spark, d).collect()]
    assert sorted(got, key=str) == sorted(plain(**tables), key=str) and len({r[2] for r in got}) >= 8


def test_one_key_with_very_many_rows(spark):
    """40,000 rows of one key, the tail of which finds nothing: near to linear."""
    n = 20_000
    choices = V.F.array(V.choice(V.F.array(V.F.lit("k")), V.OPEN, True))
    demand = spark.range(n).select(V.F.col("id").alias("demand_id"), V.F.when(V.F.col("id") % 3 == 0, V.F.array(V.F.lit("A"))).otherwise(V.F.array().cast("array<string>")).alias("cabinets"), (V.F.lit(n) - V.F.col("id")).cast("double").alias("size"), choices.alias("choices"))
    supply = spark.range(n).select(V.F.col("id").alias("supply_id"), V.F.lit("k").alias("key"), V.F.array(V.F.when(V.F.col("id") % 2 == 0, "A").otherwise("B")).alias("cabinets"), V.F.col("id").cast("double").alias("size"), V.F.lit(1).alias("units"), V.F.lit(None).cast("long").alias("major"))
    began = time.time()
    assert V.first_fit(demand, supply, ["demand_id"], ["supply_id"], Work(spark)).count() > n // 4
    assert time.time() - began < 60
