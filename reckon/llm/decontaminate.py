"""Benchmark decontamination with training suffix arrays.

The training side is cut into shards of whole documents; each gets a suffix array of its words, to the depth of a window.
Only suffixes that begin with words the benchmark knows are in it, as no other can hold a match. Every suffix of the
benchmark that can start a window is looked up by binary search in every shard; the range it bounds holds all verbatim
occurrences, with documents and places. Runs of occurrences along one item join to the longest verbatim matches.

A document lies in one shard, so nothing is shuffled. The benchmark reaches the executors in blocks of at most
``block_bytes`` of text, one pass for each block, whatever its size.

Defined results: null texts have no words; items without words match nothing; repeated item ids count once, a null id is
called ``null``; repeated documents each get their row; a very long text is a shard of its own, searched whole; of equally
long matches the first in the text and the least item wins; empty tables work. Columns are picked by name; the result's
names replace columns of these names, and :func:`decontaminate` keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.llm import common as C

U64 = np.uint64
WINDOW = 10
BLOCK_BYTES = 16 << 20
#: All but 0-9, a-z and what lies beyond ASCII, once A-Z are lower-cased.
GAPS = ~C.flags(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and word offsets of the rows."""
    apart, off = C.parted(LOWER[data], offsets, by=0)
    starts, ends = C.words_of(apart, GAPS)
    return C.word_hashes(apart, starts, ends), np.searchsorted(starts, off)


class Keys:
    """Windows of word numbers as few unsigned integers, in the order of the words; number 0 ends a window."""

    def __init__(self, vocabulary: int, window: int):
        self.bits = int(vocabulary).bit_length()
        self.each = 64 // self.bits
        self.window = window

    def of(self, numbers: np.ndarray, at: np.ndarray, reach: np.ndarray, fill: int = 0) -> list[np.ndarray]:
        """Columns for the windows at ``at``; words from ``reach`` on are ``fill``."""
        out = []
        for k in range(0, self.window, self.each):
            column = np.zeros(len(at), U64)
            for j in range(k, min(k + self.each, self.window)):
                inside = j < reach
                word = np.full(len(at), fill, U64)
                word[inside] = numbers[at[inside] + j]
                column = (column << U64(self.bits)) | word
            out.append(column)
        return out


def search(columns: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """First place of sorted ``columns`` whose key is not below (``after``: above) each wanted key, by binary search."""
    low = np.zeros(len(wanted[0]), np.int64)
    high = np.full(len(wanted[0]), len(columns[0]), np.int64)
    while (low < high).any():
        mid = (low + high) // 2
        probe = np.minimum(mid, len(columns[0]) - 1)
        less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for have, want in zip(columns, wanted, strict=True):
            have = have[probe]
            less |= same & (have < want)
            same &= have == want
        if after:
            less |= same
        live = low < high
        low = np.where(live & less, mid + 1, low)
        high = np.where(live & ~less, mid, high)
    return low


class Benchmark:
    """One block of items: vocabulary, distinct windows, and the items and places of each."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        self.window = window
        self.items = sorted({r[0] for r in rows})
        name = {x: i for i, x in enumerate(self.items)}
        data = pa.array([r[1] or "" for r in rows], pa.large_string())
        hashes, off = tokens(*C.buffer_of(data))
        self.vocabulary = np.unique(hashes)
        self.keys = Keys(max(1, len(self.vocabulary)), window)
        numbers = (np.searchsorted(self.vocabulary, hashes) + 1).astype(U64)
        sizes = np.diff(off)
        count = np.where(sizes >= window, sizes - window + 1, (sizes > 0).astype(np.int64))
        at = C.ranges(off[:-1], count)
        reach = np.minimum(np.repeat(sizes, count), window)
        low = self.keys.of(numbers, at, reach)
        item = np.repeat(np.array([name[r[0]] for r in rows], np.int64), count)
        order = np.lexsort((item, *low[::-1]))
        edge = np.ones(len(order), bool)
        edge[1:] = np.any([c[order][1:] != c[order][:-1] for c in low], axis=0)
        first = np.flatnonzero(edge)
        self.low = [c[order][first] for c in low]
        self.high = [c[order][first] for c in self.keys.of(numbers, at, reach, (1 << self.keys.bits) - 1)]
        self.reach = reach[order][first]
        self.places, self.place_items = at[order], item[order]  # by distinct window
        self.place_off = np.append(first, len(order))
        self.least = int(reach.min()) if len(reach) else window + 1


def find(hashes: np.ndarray, offsets: np.ndarray, b: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences in one shard: word place and distinct window."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(hashes) or not len(b.vocabulary):
        return none
    near = np.minimum(np.searchsorted(b.vocabulary, hashes), len(b.vocabulary) - 1)
    known = b.vocabulary[near] == hashes
    numbers = np.where(known, near + 1, 0).astype(U64)
    here = np.arange(len(hashes))
    unknown = np.append(np.flatnonzero(~known), len(hashes))
    limit = np.minimum(unknown[np.searchsorted(unknown, here)], np.repeat(offsets[1:], np.diff(offsets)))
    reach = np.minimum(limit - here, b.window)
    at = np.flatnonzero(reach >= b.least)
    if not len(at):
        return none
    columns = b.keys.of(numbers, at, reach[at])
    order = np.lexsort(columns[::-1])  # the suffix array
    columns = [c[order] for c in columns]
    low, high = search(columns, b.low, False), search(columns, b.high, True)
    count = np.maximum(high - low, 0)
    return at[order][C.ranges(low, count)], np.repeat(np.arange(len(low)), count)


def longest(place: np.ndarray, window: np.ndarray, rows: np.ndarray, b: Benchmark, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the words of its longest verbatim match, the item, and the match's first word (within the shard).
    Of equals, the first in the row and the smallest item.

    Whole short items, and windows without a hit on either side, are matches by themselves: one candidate each, however many
    items have them. Only what joins to a longer match is put beside all its places in the items."""
    size, item, begin = np.zeros(n_rows, np.int64), np.full(n_rows, -1, np.int64), np.full(n_rows, -1, np.int64)
    full = np.flatnonzero(b.reach[window] == b.window) if len(window) else window
    joined = np.zeros(len(place), bool)
    next_ = (np.diff(place[full]) == 1) & (np.diff(rows[full]) == 0)
    joined[full[1:][next_]] = joined[full[:-1][next_]] = True
    alone = ~joined
    found = [(rows[alone], b.reach[window[alone]], place[alone], b.place_items[b.place_off[window[alone]]])]  # the least item stands first
    place, window, rows = place[joined], window[joined], rows[joined]
    many = np.diff(b.place_off)[window]
    cuts = np.searchsorted(rows, np.arange(n_rows + 1))
    work = np.concatenate(([0], np.cumsum(many)))
    i = 0
    while i < n_rows:  # whole rows, about a million pairs of places at once
        j = max(i + 1, int(np.searchsorted(work[cuts], work[cuts[i]] + (1 << 20), side="right")) - 1)
        own = slice(cuts[i], cuts[j])
        if own.stop > own.start:
            n = many[own]
            at = C.ranges(b.place_off[window[own]], n)
            there, here = b.places[at], np.repeat(place[own], n)
            row, what = np.repeat(rows[own], n), b.place_items[at]
            order = np.lexsort((here, here - there, what, row))
            there, here, row, what = (x[order] for x in (there, here, row, what))
            edge = np.ones(len(here), bool)
            edge[1:] = (row[1:] != row[:-1]) | (what[1:] != what[:-1]) | (here[1:] - here[:-1] != 1) | (there[1:] - there[:-1] != 1)
            lead = np.flatnonzero(edge)
            final = np.append(lead[1:], len(here)) - 1
            total = here[final] - here[lead] + b.window
            best = np.lexsort((what[lead], here[lead], -total, row[lead]))
            head = best[np.unique(row[lead][best], return_index=True)[1]]
            found.append((row[lead][head], total[head], here[lead][head], what[lead][head]))
        i = j
    row, total, here, what = (np.concatenate(x) for x in zip(*found, strict=True))
    best = np.lexsort((what, here, -total, row))
    head = best[np.unique(row[best], return_index=True)[1]]
    size[row[head]], item[row[head]], begin[row[head]] = total[head], what[head], here[head]
    return size, item, begin


ADDED = [
    T.StructField("__words", T.LongType()),
    T.StructField("__n_hit", T.LongType()),
    T.StructField("__hits", T.BinaryType()),
    T.StructField("__items", T.ArrayType(T.StringType())),
    T.StructField("__longest", T.StructType([T.StructField("n_words", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("item_id", T.StringType())])),
]


def _pass(text_column: str, first: bool, broadcast, added: list[str]):
    """One block of the benchmark over batches of documents. ``added``: the names of the columns of ADDED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Benchmark = broadcast.value
        for batch in batches:
            data, offsets = C.buffer_of(batch[text_column])
            n_words, hits, items, best = [], [], [], []
            before = None if first else [batch[c].to_pylist() for c in added]
            for i, j in C.slices(offsets):
                hashes, off = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                place, window = find(hashes, off, b)
                rows = np.searchsorted(off, place, side="right") - 1
                order = np.lexsort((window, place))
                place, window, rows = place[order], window[order], rows[order]
                change = np.zeros(len(hashes) + 1, np.int32)
                np.add.at(change, place, 1)
                np.add.at(change, place + b.reach[window], -1)
                hit = np.cumsum(change[:-1]) > 0
                size, item, begin = longest(place, window, rows, b, j - i)
                seen = np.unique(rows * len(b.reach) + window) if len(rows) else rows
                seen_row, seen_window = (seen // len(b.reach), seen % len(b.reach)) if len(seen) else (seen, seen)
                cut = np.searchsorted(seen_row, np.arange(j - i + 1))
                for r in range(j - i):
                    n_words.append(int(off[r + 1] - off[r]))
                    if cut[r + 1] == cut[r]:
                        hits.append(b""), items.append([]), best.append(None)
                        continue
                    w = seen_window[cut[r] : cut[r + 1]]
                    own = np.unique(b.place_items[C.ranges(b.place_off[w], b.place_off[w + 1] - b.place_off[w])])
                    hits.append(np.packbits(hit[off[r] : off[r + 1]]).tobytes())
                    items.append([b.items[x] for x in own])
                    best.append({"n_words": int(size[r]), "first_word": int(begin[r] - off[r]), "item_id": b.items[item[r]]})
            if before:
                for r, (h, known, top) in enumerate(zip(*before[2:], strict=True)):
                    if h:
                        hits[r] = bytes(x | y for x, y in zip(h, hits[r])) if hits[r] else h
                        items[r] = sorted({*known, *items[r]})
                        best[r] = max([x for x in (top, best[r]) if x], key=lambda x: (x["n_words"], -x["first_word"]))
            n_hit = [int.from_bytes(h).bit_count() for h in hits]
            base = [c for c in batch.schema.names if c not in added]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.struct([("n_words", pa.int64()), ("first_word", pa.int64()), ("item_id", pa.string())]))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in base], *[pa.array(v, k) for v, k in zip((n_words, n_hit, hits, items, best), kinds, strict=True)]], names=[*base, *added])

    return run


def _found(df: DataFrame, benchmark: DataFrame, text_column: str, item_column: str, item_text_column: str, window: int, block_bytes: int, scratch: C.Scratch | None = None) -> tuple[DataFrame, list[str]]:
    """The rows of ``df`` with the columns of ADDED, and the names that these have."""
    spark = df.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{item_column}`").cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(f"`{item_text_column}`"), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    added = C.unused(df.columns, *[f.name for f in ADDED])
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, f.dataType) for n, f in zip(added, ADDED, strict=True)]])
    out, stored = df, None
    scratch = scratch or (C.Scratch(spark) if blocks > 1 else None)
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()  # about block_bytes
        shared = spark.sparkContext.broadcast(Benchmark([(r.i, r.t) for r in rows], window))
        out = out.mapInArrow(_pass(text_column, k == 0, shared, added), schema)
        if k + 1 < blocks:
            out, before = scratch.write(out), stored
            if before is not None:
                scratch.remove(before)
            stored = out
    return out, added


def find_contamination(df: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, scratch: C.Scratch | None = None) -> DataFrame:
    """The rows of ``df`` with n_words, n_hit, items (ids, sorted as strings) and longest (struct: n_words, first_word, item_id)."""
    out, (words, n_hit, _, items, best) = _found(df, benchmark, text_column, item_column, item_text_column, window, block_bytes, scratch)
    named = {"n_words": words, "n_hit": n_hit, "items": items, "longest": best}
    return out.select(*[F.col(f"`{c}`") for c in C.others(df, *named)], *[F.col(c).alias(n) for n, c in named.items()])


def decontaminate(df: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, scratch: C.Scratch | None = None) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    out, (_, n_hit, *_) = _found(df, benchmark, text_column, item_column, item_text_column, window, block_bytes, scratch)
    return out.filter(F.col(n_hit) == 0).select(*[F.col(f"`{c}`") for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document of ``documents`` against every item of ``benchmark``."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, C.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
