"""MinHash near-dedup with HyperMinHash registers.

Each of ``BANDS * ROWS`` buckets has its own hash function and keeps the least value over a document's shingles, stored as
the number of leading zeros (6 bits) and the next 10 bits. Bands of ``ROWS`` registers gather candidates; the share of equal
registers, less the share that would be equal by chance for sets of these sizes, estimates the Jaccard similarity; what
could reach the threshold is confirmed on the full sets of shingles. With 24 bands of 4 rows a pair at 0.85 is missed with
a chance of 2e-8.

Only links that matter are looked at, so a group of near copies never becomes all its pairs:

1. documents with equal sets fall into classes (one aggregation); from here on only class representatives take part;
2. in each band bucket every member is held against the bucket's least member, and confirmed links give components;
3. buckets that still hold several components look across them, on registers, and name families of components that could
   be linked. Members of a bucket's largest component are not compared with each other: the others (the minor members) are
   cut into blocks, and only the blocks of the largest component that meet one of these are copied. A family then
   compares full sets exactly, in the same way. This closes the gaps that step 2 can leave, so no link is lost; what is
   emitted are links between components, a forest in each task.

A bucket or family of m members outside its largest component costs m * (all members) / ``BLOCK`` rows of exchange: linear
as long as m is under a block, quadratic only for many texts that are alike and yet not linked.

Components come from hooking every node to its least neighbour, jumping to the root and contracting the edges, over tables
in the shared folder. The minimum is combined before the exchange, and joins on a hub are splittable, as both sides are
stored tables. Nothing but counters reaches the driver. Tables written on the way are removed at the end.

Defined results: null and wordless texts have an empty set, link with nothing and are kept; a null id links with nothing
and is kept, with a null component; rows with equal ids are one node; very long texts are hashed whole, one at a time; ties
go to the smallest id; an empty table gives no rows. Columns are picked by name, extra ones are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm import common as C

U64 = np.uint64
SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Members of one block, and the shingles that a block may have in all (a longer document makes a block of its own).
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: One odd multiplier and one offset for each bucket, from a rule.
MULTIPLIERS = C.mix(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
OFFSETS = C.mix(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles (of the whole sequence where it is shorter), and their row offsets."""
    apart, off = C.parted(LOWER[data], offsets)
    starts, ends = C.words_of(apart, C.SPACES)
    words = C.word_hashes(apart, starts, ends)
    rows = np.searchsorted(starts, off)
    count = np.diff(rows)
    every = C.mix(C.rolled(words, k)) if len(words) >= k else np.zeros(0, U64)
    whole = count >= k
    size = np.where(whole, count - k + 1, (count > 0).astype(np.int64))
    out_off = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(out_off[-1], U64)
    full = np.repeat(whole, size)
    out[full] = every[C.ranges(rows[:-1][whole], size[whole])]
    short = np.flatnonzero((count > 0) & ~whole)
    h = count[short].astype(U64)
    for j in range(k - 1):  # one word of all short rows at a time
        more = count[short] > j
        h[more] = C.mix(h[more] * C.BASE + words[rows[short[more]] + j])
    out[out_off[short]] = h
    return out, out_off


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes sorted, without repeats."""
    rows = [np.unique(hashes[offsets[r] : offsets[r + 1]]) for r in range(len(offsets) - 1)]
    size = np.array([len(x) for x in rows], np.int64)
    return (np.concatenate(rows) if rows else hashes[:0]), np.concatenate(([0], np.cumsum(size)))


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros and the ``MANTISSA`` bits behind the first one."""
    high = (least >> U64(11)).astype(np.float64)  # exact in 53 bits
    zeros = np.minimum(53 - np.frexp(high)[1], 53)
    zeros[least >> U64(11) == 0] = 53
    rest = least << np.minimum(zeros + 1, 63).astype(U64)
    return ((zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (rest >> U64(64 - MANTISSA)).astype(np.uint16)).astype(np.uint16)


def registers(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A line of registers for each row with shingles, zero for the others."""
    out = np.zeros((len(offsets) - 1, REGISTERS), np.uint16)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if not len(some):
        return out
    lead = offsets[:-1][some]
    for k in range(REGISTERS):
        v = (hashes ^ OFFSETS[k]) * MULTIPLIERS[k]
        v ^= v >> U64(29)
        v *= U64(0x94D049BB133111EB)
        out[some, k] = compress(np.minimum.reduceat(v, lead))
    return out


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that the registers of two disjoint sets with ``a`` and ``b`` elements agree."""
    i = np.arange(54.0)
    at = lambda n: np.exp(np.multiply.outer(n, np.log1p(-np.exp2(-i - 1)))) - np.where(i > 0, np.exp(np.multiply.outer(n, np.log1p(-np.exp2(-np.maximum(i, 1e-9))))), 0.0)
    return (at(np.asarray(a, float)) * at(np.asarray(b, float))).sum(-1) / (1 << MANTISSA)


def estimate(equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for those equal by chance."""
    by_chance = chance(a, b)
    return np.clip((equal - by_chance) / (1 - by_chance), 0, 1)


def least_estimate(percent: int) -> float:
    """Estimates below this, six standard deviations under the threshold, are no candidates."""
    p = percent / 100
    return p - 6 * (p * (1 - p) / REGISTERS) ** 0.5


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


SIGNATURES = "doc_id long, n_shingles long, f1 long, f2 long, registers binary, text_hash long"


def signatures(df: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.buffer_of(batch["t"])
            for i, j in C.slices(offsets, 1 << 19):
                hashes, off = distinct(*shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle))
                total = np.concatenate((np.zeros((1, 2), U64), np.cumsum(np.stack((C.mix(hashes + U64(1)), C.mix(hashes ^ U64(0xA5A5A5A5A5A5A5A5))), 1), axis=0, dtype=U64)))
                print_ = total[off[1:]] - total[off[:-1]]
                raw = [x.tobytes() for x in registers(hashes, off)]
                yield pa.RecordBatch.from_arrays([batch["d"][i:j], pa.array(np.diff(off)), _signed(print_[:, 0].copy()), _signed(print_[:, 1].copy()), pa.array(raw, pa.binary()), batch["h"][i:j]], names=["doc_id", "n_shingles", "f1", "f2", "registers", "text_hash"])

    return df.select(F.col(f"`{id_column}`").cast("long").alias("d"), F.col(f"`{text_column}`").cast("string").alias("t"), F.xxhash64(F.col(f"`{text_column}`")).alias("h")).mapInArrow(run, SIGNATURES)


def bands(lines: str = "registers") -> Column:
    """A key for each band: the band's number and its registers, hashed."""
    width = 2 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col(lines), b * width + 1, F.lit(width))))


def _line(x) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(len(x), REGISTERS)


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, na, nb, ra, rb) the pairs whose sizes and registers can reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch[c].to_numpy() for c in ("na", "nb"))
            if not len(na):
                continue
            keep = np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb)
            keep &= estimate((_line(batch["ra"]) == _line(batch["rb"])).mean(axis=1), na, nb) >= least_estimate(percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def _full_sets(df: DataFrame, wanted: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(d, s): the full sets of the documents whose ids are the rows of ``wanted``. Of a document that the table repeats a
    task sends one set."""
    docs = df.select(F.col(f"`{id_column}`").cast("long").alias("d"), F.col(f"`{text_column}`").cast("string").alias("t")).filter("d is not null")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, bytes]] = set()
        for batch in batches:
            data, offsets = C.buffer_of(batch["t"])
            ids = batch["d"].to_pylist()
            for i, j in C.slices(offsets):
                hashes, off = distinct(*shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle))
                rows = []
                for r in range(j - i):
                    one = hashes[off[r] : off[r + 1]].tobytes()
                    key = (ids[i + r], hashlib.blake2b(one, digest_size=12).digest())
                    if key not in seen:
                        seen.add(key)
                        rows.append((ids[i + r], one))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], names=["d", "s"])

    return docs.join(wanted.toDF("d"), "d", "left_semi").mapInArrow(sets, "d long, s binary")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (d, s) reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                x, y = (np.frombuffer(z.as_py(), U64) for z in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # the side that can be hot is met first; its rows then spread over the other side
    joined = pairs.join(full.select(F.col("d").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("d").alias("b"), F.col("s").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def _mixed(placed: DataFrame) -> DataFrame:
    """Of (group, rep, root, n) the groups with several roots: group, major (the root of most members), and the members and
    shingles of both parts. Roots are counted before the members of a group meet."""
    by_root = placed.groupBy("group", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    most = F.max(F.struct("c", "root", "n"))
    by = by_root.groupBy("group").agg(most.alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.count("*").alias("roots")).filter("roots > 1")
    return by.select("group", F.col("top.root").alias("major"), F.col("top.c").alias("major_c"), F.col("top.n").alias("major_n"), (F.col("c") - F.col("top.c")).alias("minor_c"), (F.col("n") - F.col("top.n")).alias("minor_n"))


def _forest(members: DataFrame, likeness) -> DataFrame:
    """Links (a, b) between the roots within groups. Columns of ``members``: those of :func:`_mixed`, rep, root, n, content.

    Minor members and those of the largest component are cut into blocks; each two minor blocks, and each minor with each
    other block, meet in one task, which emits a link only if it joins what it has not joined yet.
    ``likeness(x, others, n, content) -> flags`` says which of the others member x is like."""
    spark = members.sparkSession
    cuts = lambda c, n: F.greatest(F.ceil(c / BLOCK), F.ceil(n / BLOCK_SHINGLES), F.lit(1)).cast("int")
    minor, alone = F.col("root") != F.col("major"), cuts(F.col("minor_c") + F.col("major_c"), F.col("minor_n") + F.col("major_n")) == 1
    cut = members.withColumns({"minors": cuts(F.col("minor_c"), F.col("minor_n")), "majors": F.when(alone, 0).otherwise(cuts(F.col("major_c"), F.col("major_n")))})
    of_major = F.when(alone, 0).otherwise(F.col("minors") + F.pmod(F.xxhash64("rep"), F.greatest("majors", F.lit(1))))  # a small group is one block
    cut = cut.withColumn("block", F.when(minor, F.pmod(F.xxhash64("rep"), F.col("minors"))).otherwise(of_major).cast("int"))
    last = F.when(minor, F.col("minors") + F.col("majors")).otherwise(F.col("minors")) - 1
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), last))).withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    # work goes by pairs, not by bytes: a stated number of tasks, which adaptive execution doesn't merge
    cut = cut.select("group", "p", "q", "block", "rep", "root", "n", "content").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "group", "p", "q")

    def linked(whole: pa.Table, edge: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        """Links between the roots of the cells that begin at ``edge``."""
        root, block, p, q = (whole[c].to_numpy() for c in ("root", "block", "p", "q"))
        mixed = np.minimum.reduceat(root, edge) != np.maximum.reduceat(root, edge) if len(edge) else edge

        def cells():
            for k, e in zip(edge[mixed].tolist(), ends[mixed].tolist(), strict=True):
                i = k + np.flatnonzero(block[k:e] == p[k])
                yield i, (i if p[k] == q[k] else k + np.flatnonzero(block[k:e] == q[k]))

        label: dict[int, int] = {}

        def find(r: int) -> int:
            while (up := label.get(r, r)) != r:
                label[r] = r = label.get(up, up)
            return r

        a, b = [], []
        for x, y in likeness(whole, root, cells()) if mixed.any() else ():
            for r, t in np.unique(np.stack((np.minimum(root[x], root[y]), np.maximum(root[x], root[y])), 1), axis=0).tolist():
                u, v = find(r), find(t)
                if u != v:
                    label[max(u, v)] = min(u, v)
                    a.append(r), b.append(t)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come one after another; only a cell that a batch cuts is carried over."""
        rest = None
        for batch in _then_none(batches):
            if batch is not None:
                part = pa.Table.from_batches([batch])
                rest = pa.concat_tables([rest, part]) if rest is not None else part
            if rest is None or not rest.num_rows:
                continue
            keys = np.stack([rest[c].to_numpy() for c in ("group", "p", "q")])
            edge = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0))))
            ends = np.append(edge[1:], rest.num_rows)
            if batch is not None:
                edge, ends = edge[:-1], ends[:-1]
            if len(edge):
                done = int(ends[-1])
                yield linked(rest.slice(0, done).combine_chunks(), edge, ends)
                rest = rest.slice(done)

    return cut.sortWithinPartitions("group", "p", "q").mapInArrow(run, "a long, b long")


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _by_registers(percent: int, at_once: int = 1 << 16):
    """Pairs of members of different roots whose sizes and registers can reach the threshold, about ``at_once`` at once."""
    floor = least_estimate(percent)

    def likeness(whole: pa.Table, root, cells):
        n, lines = whole["n"].to_numpy(), _line(whole["content"])
        waiting: list[tuple] = []

        def judged():
            x, y = (np.concatenate(z) for z in zip(*waiting, strict=True))
            equal = (lines[x] == lines[y]).mean(axis=1)
            x, y, equal = x[equal >= floor], y[equal >= floor], equal[equal >= floor]
            keep = estimate(equal, n[x], n[y]) >= floor
            return x[keep], y[keep]

        size = 0
        for i, j in cells:
            rows = max(1, at_once // max(1, len(j)))
            for k in range(0, len(i), rows):
                x, y = np.repeat(i[k : k + rows], len(j)), np.tile(j, len(i[k : k + rows]))
                keep = (root[x] != root[y]) & (np.minimum(n[x], n[y]) * 100 >= percent * np.maximum(n[x], n[y]))
                if i is j:
                    keep &= x < y
                waiting.append((x[keep], y[keep]))
                size += len(waiting[-1][0])
                if size >= at_once:
                    yield judged()
                    size = waiting.clear() or 0
        if size:
            yield judged()

    return likeness


def _by_sets(percent: int):
    """Pairs of members of different roots whose full sets reach the threshold, by an index of the shingles they share."""

    def likeness(whole: pa.Table, root, cells):
        content = whole["content"].combine_chunks()
        for i, j in cells:
            members = i if i is j else np.concatenate((i, j))
            sets = [np.frombuffer(content[k].as_py(), U64) for k in members.tolist()]
            size = np.array([len(x) for x in sets], np.int64)
            owner = np.repeat(np.arange(len(sets)), size)
            _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            keep = times[number] > 1  # what one set alone has is in no intersection
            owner, number = owner[keep], (np.cumsum(times > 1) - 1)[number[keep]]
            off = np.searchsorted(owner, np.arange(len(sets) + 1))
            order = np.argsort(number, kind="stable")
            holders = owner[order]
            start = np.searchsorted(number[order], np.arange(int((times > 1).sum()) + 1))
            for x in range(len(i)):
                y = np.flatnonzero(root[members] != root[members[x]])
                mine = number[off[x] : off[x + 1]]
                both = np.bincount(holders[C.ranges(start[mine], start[mine + 1] - start[mine])], minlength=len(sets))[y]
                y = y[100 * both >= percent * (size[x] + size[y] - both)]
                yield np.full(len(y), members[x]), members[y]

    return likeness


def _least_reachable(edges: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(id, root) of every id that can reach a smaller one, as a stored table. ``edges``: (a, b) with a < b.

    Each node hooks to its least neighbour, jumps until that is a root, and edges are contracted to the roots; what is left
    joins different roots. A round leaves the local minima, at most half of the nodes that still have edges."""
    edges = scratch.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b"))
    labels = None
    while True:
        n = edges.count()
        up = scratch.write(edges.groupBy("b").agg(F.min("a").alias("m")), n)
        while True:
            further = up.select(F.col("b").alias("m"), F.col("m").alias("further"))
            jump = scratch.write(up.select("b", "m").join(further, "m", "left").select("b", F.coalesce("further", "m").alias("m"), F.col("further").isNotNull().alias("moved")), n)
            up = jump.select("b", "m")
            if jump.filter("moved").isEmpty():
                break
        roots = up.select(F.col("b").alias("id"), F.col("m").alias("root"))
        if labels is not None:
            again = labels.join(roots.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
            roots = again.unionByName(roots)
        labels = scratch.write(roots, None if labels is None else 2 * n)
        left = edges.join(up.toDF("a", "ma"), "a", "left").join(up, "b").select(F.coalesce("ma", "a").alias("x"), F.col("m").alias("y"))
        edges = scratch.write(left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), n)
        if edges.isEmpty():
            return labels


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Least reachable id of every id that has an edge: columns ``id`` and ``root``."""
    scratch = C.Scratch(edges.sparkSession)
    edges = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b")
    labels = C.written(_least_reachable(edges, scratch))
    scratch.drop()
    return labels.union(labels.select("root", "root").distinct())


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, held: C.Scratch | None = None) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_shingles, component_id, kept, and text_hash (xxhash64 of the text), which
    tells rows apart that share an id. It reads tables of ``held``, which whoever gives one drops when the rows are done with."""
    scratch, held = C.Scratch(df.sparkSession), held or C.Scratch(df.sparkSession)
    docs = held.write(signatures(df, id_column, text_column, shingle))
    known = docs.filter("n_shingles > 0 and doc_id is not null")
    classes = scratch.write(known.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), docs.count(), C.WIDE)
    info, n_classes = classes.select("rep", "n", "registers"), classes.count()

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = scratch.write(wanted.distinct(), wanted.count())
        rows = wanted.count()
        return scratch.write(C.sized(_full_sets(df, wanted, id_column, text_column, shingle), rows, C.WHOLE))

    # stars: the least member of each bucket that has several
    members = classes.select("rep", F.explode(bands()).alias("band"))
    stars = scratch.write(members.groupBy("band").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("band", "a"), n_classes * BANDS)
    buckets = scratch.write(members.join(stars, "band").select("band", "rep", "a"), n_classes * BANDS)
    n = buckets.count()
    by_member = buckets.filter("rep <> a").groupBy("rep").agg(F.collect_set("a").alias("stars"))  # one for each band at most
    pairs = by_member.join(info, "rep").select(F.explode("stars").alias("a"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    pairs = C.sized(pairs.join(info.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra")), "a"), n, C.WIDE)
    pairs = scratch.write(_likely(pairs.select("a", "b", "na", "nb", "ra", "rb"), percent))
    links = scratch.write(C.sized(_confirmed(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")))), percent), pairs.count(), C.WHOLE))
    roots = _least_reachable(links, scratch)
    own_root = lambda x: x.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))

    # buckets with several components: look across them, first on registers, then on full sets
    placed = scratch.write(own_root(buckets.select(F.col("band").alias("group"), "rep")).withColumn("n", F.lit(0).cast("long")), n)
    inside = scratch.write(placed.drop("n").join(scratch.write(_mixed(placed), n), "group"), n)
    likely = scratch.write(_forest(inside.join(info.withColumnRenamed("registers", "content"), "rep"), _by_registers(percent)).distinct(), n)
    final = roots
    if not likely.isEmpty():
        families = _least_reachable(likely, scratch)
        families = families.union(families.select("root", "root").distinct()).toDF("root", "group")
        relatives = inside.select("rep", "root").distinct().join(families, "root").join(info.select("rep", "n"), "rep")
        relatives = scratch.write(relatives.select("group", "rep", "root", "n"), inside.count())
        n = relatives.count()
        sides = scratch.write(_mixed(relatives), n)
        full = sets_of(relatives.select("rep")).toDF("rep", "content")
        found = scratch.write(_forest(relatives.join(sides, "group").join(full, "rep"), _by_sets(percent)).distinct(), n)
        if not found.isEmpty():
            merged = _least_reachable(found, scratch).toDF("root", "top")
            joined = roots.join(merged, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
            final = joined.union(merged)

    named = classes.select("f1", "f2", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left")
    named = held.write(named.select("f1", "f2", F.coalesce("root", "rep").alias("own")), n_classes)
    scratch.drop()
    out = docs.select("doc_id", "n_shingles", "f1", "f2", "text_hash").join(named, ["f1", "f2"], "left")
    by_id = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("own")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    return out.select("doc_id", "n_shingles", by_id.alias("component_id"), "text_hash").select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document of ``documents``."""
    held = C.Scratch(spark)
    return held.finished(near_duplicates(C.table(spark, sf_dir, "documents"), held=held).drop("text_hash"))
