"""Repeats across documents, found through winnowed anchors. Basis of the suffix-array and the seed-and-extend operator.

A *window* is ``length`` consecutive symbols (bytes or words) of one document. Each window has one *anchor*: its seed of
``seed`` symbols with the least hash (the first of equals). Equal windows have equal anchors at equal places, so windows
only need comparing where their anchor repeats. Neighbouring windows with the same anchor form a *run*; a run's *span* is
the text that its windows cover. Documents live in buckets by id. The steps, each one exchange of packed blobs:

1. each bucket names its distinct anchors to the anchors' shards;
2. a shard tells the buckets which of their anchors another document has as well (nearly all others end here);
3. a bucket sends its *distinct* spans with such an anchor, with the least document of each, to the shards;
4. a shard decides for each window which document has it first, by the operator's own method, and sends that back;
5. the bucket compares each of its documents with those owners and marks the symbols to remove.

A passage that a third of all documents share crosses the network once for each bucket, not once for each document, and
no pair of documents is ever formed. The text itself is exchanged once: the plan uses that exchange three times.

There is a message for each bucket and shard that have something for each other, so at large sizes a message holds few
anchors or spans. Messages cost a few bytes besides their content for that reason, and there are ``SPREAD`` times fewer
shards than buckets; a shard works on its spans in chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.llm import common as C

U64 = np.uint64
#: Bits of an anchor that are exchanged. Two anchors that agree in them by chance only cost a comparison.
ANCHOR_BITS = 48
#: Buckets of text for each shard: about a million anchors at the operators' bucket sizes.
SPREAD = 8
#: Windows that a shard compares at once. One anchor's windows stay together up to so many times as many; beyond that they
#: are compared by the anchor's place in them.
WINDOWS_AT_ONCE, HOT_CHUNKS = 1 << 17, 4
#: (spans: bytes, span offsets, windows in each, anchor places, anchors, least documents, window length, seed) -> owner of each window
Decide = Callable[..., np.ndarray]


class Symbols:
    """Bytes, or words parted by white space."""

    def __init__(self, words: bool, length: int, seed: int):
        if not 0 < seed <= length:
            raise ValueError("seed must be from 1 to the window length")
        self.words, self.length, self.seed = words, length, seed

    def read(self, data: np.ndarray, offsets: np.ndarray):
        """Values of the symbols, symbol offsets of the rows, and the symbols' byte spans (None: one byte each)."""
        if not self.words:
            return C.BYTE_VALUES[data], offsets, None
        apart, off = C.parted(data, offsets)
        starts, ends = C.words_of(apart, C.SPACES)
        hashes = C.word_hashes(apart, starts, ends)
        rows = np.searchsorted(starts, off)
        back = np.searchsorted(off, starts, side="right") - 1  # the bytes put in before a word
        return hashes, rows, (starts - back, ends - back)


def runs_of(values: np.ndarray, offsets: np.ndarray, s: Symbols):
    """Runs of windows with one anchor: first window, number of windows, place of the anchor, anchor."""
    n = len(values) - s.length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, U64)
    anchors = C.mix(C.rolled(values, s.seed))
    bits = U64(int(len(anchors)).bit_length())
    least = C.sliding_min((anchors >> bits << bits) | np.arange(len(anchors), dtype=U64), s.length - s.seed + 1)
    at = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)[:n]
    whole = np.zeros(n + 1, np.int32)  # a window lies in one row
    first, last = offsets[:-1], offsets[1:] - s.length + 1
    some = last > first
    np.add.at(whole, first[some], 1)
    np.add.at(whole, last[some], -1)
    whole = np.cumsum(whole[:n]).astype(bool)
    edge = np.ones(n, bool)
    edge[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])
    edge[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.append(starts, n))
    keep = whole[starts]
    starts, sizes = starts[keep], sizes[keep]
    # least hashes are small numbers; hashed again they spread evenly over the shards
    return starts, sizes, at[starts], C.mix(anchors[at[starts]]) >> U64(64 - ANCHOR_BITS)


def _ids(part: pa.Table) -> np.ndarray:
    return np.asarray(part["__id"].fill_null(C.LAST_ID).to_numpy(zero_copy_only=False), np.int64)


def settled(part: pa.Table) -> pa.Table:
    """The bucket's rows in an order that doesn't hang on how the exchange delivered them."""
    ids = _ids(part)
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (ids[order][1:] == ids[order][:-1]).any():
        texts = part["__text"].to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or "")))
    return part.take(pa.array(order))


def _bucket_runs(part: pa.Table, s: Symbols):
    """For each slice of rows: first row, data, row offsets, symbol offsets, symbol spans, runs and the row of each run."""
    data, offsets = C.buffer_of(part["__text"])
    for i, j in C.slices(offsets):
        own = data[offsets[i] : offsets[j]]
        off = offsets[i : j + 1] - offsets[i]
        values, rows, spans = s.read(own, off)
        starts, sizes, at, anchors = runs_of(values, rows, s)
        of = np.searchsorted(rows, starts, side="right") - 1
        yield i, own, off, rows, spans, starts, sizes, at, anchors, of


def _by_shard(anchors: np.ndarray, shards: int):
    """Order by shard, and the bounds of each shard that has some."""
    shard = ((anchors >> U64(ANCHOR_BITS - 32)) * U64(shards) >> U64(32)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    found, first = np.unique(shard[order], return_index=True)
    return order, found, np.append(first, len(order))


def _firsts(keys: np.ndarray) -> np.ndarray:
    edge = np.ones(len(keys), bool)
    edge[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(edge)


MESSAGE = "__shard int, __bucket int, __blob binary"


def _message(to: list[int], origin: list[int], blobs: list[bytes]) -> pa.Table:
    return pa.table({"__shard": pa.array(to, pa.int32()), "__bucket": pa.array(origin, pa.int32()), "__blob": pa.array(blobs, pa.binary())})


def name_anchors(part: pa.Table, s: Symbols, shards: int) -> pa.Table:
    """Step 1. An anchor carries a flag: two documents of this bucket have it."""
    bucket, ids = part["__bucket"][0].as_py(), _ids(part)
    anchors, owners = [], []
    for i, *_, found, of in _bucket_runs(part, s):
        order = np.lexsort((ids[i + of], found))
        found, own = found[order], ids[i + of][order]
        first = _firsts(found)
        if len(first):
            anchors.append(found[first])
            owners.append(np.stack((own[first], own[np.append(first[1:], len(own)) - 1])))
    if not anchors:
        return _message([], [], [])
    found, own = np.concatenate(anchors), np.concatenate(owners, axis=1)
    order = np.argsort(found, kind="stable")
    found, own = found[order], own[:, order]
    first = _firsts(found)
    several = np.minimum.reduceat(own[0], first) != np.maximum.reduceat(own[1], first)
    found = found[first]
    order, to, bounds = _by_shard(found, shards)
    blobs = []
    for k in range(len(to)):
        rows = order[bounds[k] : bounds[k + 1]]  # in the order of the anchors
        blobs.append(C.pack(_planes(np.diff(found[rows], prepend=U64(0))), np.packbits(several[rows])))
    return _message(to.tolist(), [bucket] * len(to), blobs)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: leading zeros then take no room."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(U64).ravel()


def find_shared(part: pa.Table) -> pa.Table:
    """Step 2. What each bucket named, cut down to what two documents have."""
    origin, found, several = part["__bucket"].to_pylist(), [], []
    for blob in part["__blob"].to_pylist():
        planes, bits = C.unpack(blob)
        one = np.cumsum(_unplanes(planes), dtype=U64)
        found.append(one)
        several.append(np.unpackbits(bits, count=len(one)).astype(bool))
    sizes = [len(x) for x in found]
    everything = np.concatenate(found)
    order = np.argsort(everything, kind="stable")
    first = _firsts(everything[order])
    shared = np.diff(np.append(first, len(order))) > 1
    shared |= np.logical_or.reduceat(np.concatenate(several)[order], first)
    keep = np.zeros(len(order), bool)
    keep[order] = np.repeat(shared, np.diff(np.append(first, len(order))))
    to, blobs, at = [], [], 0
    for b, one, n in zip(origin, found, sizes, strict=True):
        one, at = one[keep[at : at + n]], at + n
        if len(one):
            to.append(b)
            blobs.append(C.pack(_planes(np.diff(one, prepend=U64(0)))))
    return _message([0] * len(to), to, blobs)


def send_spans(part: pa.Table, shared: pa.Table, s: Symbols, shards: int) -> pa.Table:
    """Step 3. Distinct spans with a shared anchor, least document of each, and the runs that have them."""
    if not part.num_rows or not shared.num_rows:
        return _message([], [], [])
    part = settled(part)
    bucket, ids = part["__bucket"][0].as_py(), _ids(part)
    known = np.sort(np.concatenate([np.cumsum(_unplanes(C.unpack(b)[0]), dtype=U64) for b in shared["__blob"].to_pylist()]))
    texts, keys, anchors, sizes, places, rows, firsts = [], [], [], [], [], [], []
    for i, data, _, _, spans, starts, n, at, anchor, of in _bucket_runs(part, s):
        k = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
        keep = np.flatnonzero(known[k] == anchor)
        starts, n, at, anchor, of = starts[keep], n[keep], at[keep], anchor[keep], of[keep]
        if not len(keep):
            continue
        a, b = starts, starts + n + s.length - 1
        if spans is not None:
            a, b = spans[0][a], spans[1][b - 1]
        texts.append((data, a, b))
        keys.append(C.word_hashes(data, a, b) ^ C.mix(anchor + n.astype(U64)))
        anchors.append(anchor), sizes.append(n), places.append(at - starts), rows.append(i + of)
        firsts.append(starts)
    if not keys:
        return _message([], [], [])
    base = np.concatenate([np.full(len(k), i) for i, k in enumerate(keys)])
    key, anchor, n, place, row, first = map(np.concatenate, (keys, anchors, sizes, places, rows, firsts))
    begin, end = np.concatenate([t[1] for t in texts]), np.concatenate([t[2] for t in texts])
    row_first = _row_starts(part, s)[row]
    own = ids[row]
    order = np.lexsort((own, key))  # equal spans together, the least document first
    lead = _firsts(key[order])
    count = np.diff(np.append(lead, len(order)))
    entry = order[lead]
    by, to, bounds = _by_shard(anchor[entry], shards)
    blobs = []
    for x in range(len(to)):
        e = by[bounds[x] : bounds[x + 1]]
        pick = entry[e]
        pieces = b"".join(texts[base[p]][0][begin[p] : end[p]].tobytes() for p in pick.tolist())
        runs = order[C.ranges(lead[e], count[e])]
        blobs.append(C.pack(pieces, (end - begin)[pick].astype(np.uint32), n[pick].astype(np.uint16), place[pick].astype(np.uint16), anchor[pick], own[pick], count[e].astype(np.uint32), row[runs].astype(np.uint32), _from(first, row_first)[runs]))
    return _message(to.tolist(), [bucket] * len(to), blobs)


def _row_starts(part: pa.Table, s: Symbols) -> np.ndarray:
    """Symbol at which each row starts within its slice."""
    data, offsets = C.buffer_of(part["__text"])
    out = np.zeros(part.num_rows, np.int64)
    for i, j in C.slices(offsets):
        if s.words:
            out[i:j] = s.read(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1][:-1]
        else:
            out[i:j] = offsets[i:j] - offsets[i]
    return out


def _from(first: np.ndarray, row_first: np.ndarray) -> np.ndarray:
    return (first - row_first).astype(np.uint32)


def single_windows(text: np.ndarray, offsets: np.ndarray, n: np.ndarray, place: np.ndarray, s: Symbols):
    """The windows of spans of one anchor, cut out, by the anchor's place in them: equal windows have it at one place. Yields
    spans, their window, the windows' text and its offsets, and the anchor's places."""
    _, first, spans = s.read(text, offsets)
    for at in range(s.length - s.seed + 1):
        window = place - at
        rows = np.flatnonzero((window >= 0) & (window < n))
        if not len(rows):
            continue
        begin = first[:-1][rows] + window[rows]
        end = begin + s.length
        if spans is not None:
            begin, end = spans[0][begin], spans[1][end - 1]
        yield rows, window[rows], text[C.ranges(begin, end - begin)], np.concatenate(([0], np.cumsum(end - begin))), np.full(len(rows), at, np.int64)


def decide_owners(part: pa.Table, s: Symbols, decide: Decide) -> pa.Table:
    """Step 4. For each distinct span of a shard, the least document that has each of its windows."""
    blobs = [C.unpack(b) for b in part["__blob"].to_pylist()]
    text = np.frombuffer(b"".join(b[0] for b in blobs), np.uint8)
    lengths, n, place, anchor, own = (np.concatenate([b[k] for b in blobs]) for k in range(1, 6))
    offsets = np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))
    n, place = n.astype(np.int64), place.astype(np.int64)
    key = C.mix(anchor + n.astype(U64))
    done = 0
    for b in blobs:  # one bucket's spans at a time: the running sums of a whole shard would be large
        one_off = np.concatenate(([0], np.cumsum(b[1].astype(np.int64))))
        for i, j in C.slices(one_off):
            own_text = np.frombuffer(b[0], np.uint8)[one_off[i] : one_off[j]]
            key[done + i : done + j] ^= C.word_hashes(own_text, one_off[i:j] - one_off[i], one_off[i + 1 : j + 1] - one_off[i])
        done += len(b[1])
    order = np.lexsort((own, key))  # a span that many buckets sent is looked at once
    lead = _firsts(key[order])
    same = np.empty(len(order), np.int64)
    same[order] = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(order))))
    one = order[lead]
    owners = np.empty(int(n[one].sum()), np.int64)
    whole = np.concatenate(([0], np.cumsum(n[one])))
    by = np.argsort(anchor[one], kind="stable")  # equal windows have equal anchors: groups of anchors stand alone
    group = np.append(_firsts(anchor[one][by]), len(by))
    work = np.concatenate(([0], np.cumsum(n[one][by])))[group]
    i = 0
    while i < len(group) - 1:
        j = max(i + 1, int(np.searchsorted(work, work[i] + WINDOWS_AT_ONCE, side="right")) - 1)
        part_of = by[group[i] : group[j]]
        pick = one[part_of]
        off = np.concatenate(([0], np.cumsum(lengths[pick].astype(np.int64))))
        pieces = text[C.ranges(offsets[pick], lengths[pick])]
        if work[j] - work[i] <= HOT_CHUNKS * WINDOWS_AT_ONCE:
            owners[C.ranges(whole[part_of], n[pick])] = decide(pieces, off, n[pick], place[pick], anchor[pick], own[pick], s)
        else:
            for rows, window, own_text, own_off, at in single_windows(pieces, off, n[pick], place[pick], s):
                owners[whole[part_of[rows]] + window] = decide(own_text, own_off, np.ones(len(rows), np.int64), at, anchor[pick][rows], own[pick][rows], s)
        i = j
    at = whole
    # a span whose windows nobody else has and that one document has alone says nothing
    foreign = np.add.reduceat((owners != np.repeat(own[one], n[one])).astype(np.int64), at[:-1]) > 0 if len(one) else np.zeros(0, bool)
    to, out, done = [], [], 0
    for bucket, b in zip(part["__bucket"].to_pylist(), blobs, strict=True):
        k = len(b[1])
        mine = same[done : done + k]
        done += k
        runs = b[6].astype(np.int64)
        say = foreign[mine] | (runs > 1) | (own[one][mine] != b[5])
        if not say.any():
            continue
        whole = C.ranges((np.cumsum(runs) - runs)[say], runs[say])
        to.append(bucket)
        out.append(C.pack(b[2][say], owners[C.ranges(at[mine[say]], n[one][mine[say]])], runs[say].astype(np.uint32), b[7][whole], b[8][whole]))
    return _message([0] * len(to), to, out)


def removed_symbols(part: pa.Table, owners: pa.Table, s: Symbols, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step 5. Spans of symbols to remove: start and end (within all symbols of the bucket, row after row)."""
    ids = _ids(part)
    row_at = np.concatenate(([0], np.cumsum(counts)))
    change = np.zeros(row_at[-1] + 1, np.int32)
    for blob in owners["__blob"].to_pylist() if owners.num_rows else []:
        n, owner, runs, row, first = C.unpack(blob)
        n, runs = n.astype(np.int64), runs.astype(np.int64)
        each = np.repeat(np.arange(len(n)), runs)  # the span of each run
        windows = n[each]
        who = owner[C.ranges((np.cumsum(n) - n)[each], windows)]
        mine = np.repeat(ids[row], windows)
        begin = C.ranges(row_at[row] + first.astype(np.int64), windows)[who < mine]
        change[begin] += 1  # a window lies in one run, so no place comes twice
        change[begin + s.length] -= 1
    gone = np.zeros(row_at[-1] + 2, np.int8)
    gone[1:-1] = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(gone))
    return edge[0::2], edge[1::2]


def remove_repeats(df: DataFrame, s: Symbols, decide: Decide, finish: Callable, schema: str, id_column: str, text_column: str, carry: list[str], bucket_bytes: int) -> DataFrame:
    """The five steps. ``finish(part, removed starts, removed ends, symbol counts) -> table`` makes the result's rows."""
    shards = C.bucket_count(df, text_column, bucket_bytes)
    docs = df.select(
        F.pmod(F.xxhash64(F.col(f"`{id_column}`"), F.octet_length(F.col(f"`{text_column}`"))), F.lit(shards)).cast("int").alias("__bucket"),
        F.col(f"`{id_column}`").cast("long").alias("__id"),
        F.col(f"`{text_column}`").cast("string").alias("__text"),
        *[F.col(f"`{c}`").alias(f"__carry_{c}") for c in carry],
    )
    meeting = max(1, min(shards, max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // SPREAD)))
    named = docs.groupBy("__bucket").applyInArrow(lambda t: name_anchors(t, s, meeting), MESSAGE)
    shared = named.groupBy("__shard").applyInArrow(find_shared, MESSAGE)
    spans = docs.groupBy("__bucket").cogroup(shared.groupBy("__bucket")).applyInArrow(lambda a, b: send_spans(a, b, s, meeting), MESSAGE)
    owners = spans.groupBy("__shard").applyInArrow(lambda t: decide_owners(t, s, decide), MESSAGE)

    def last(part: pa.Table, found: pa.Table) -> pa.Table:
        part = settled(part)
        if s.words:
            data, offsets = C.buffer_of(part["__text"])
            counts = [np.diff(s.read(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1]) for i, j in C.slices(offsets)]
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        else:
            counts = np.diff(C.buffer_of(part["__text"])[1])
        return finish(part, *removed_symbols(part, found, s, counts), counts)

    return docs.groupBy("__bucket").cogroup(owners.groupBy("__bucket")).applyInArrow(last, schema)


def per_row(starts: np.ndarray, ends: np.ndarray, counts: np.ndarray):
    """Removed spans cut at row ends: row, start and end within the row."""
    at = np.concatenate(([0], np.cumsum(counts)))
    row = np.searchsorted(at, starts, side="right") - 1
    last = np.searchsorted(at, ends - 1, side="right") - 1
    many = last - row + 1
    rows = C.ranges(row, many)
    begin = np.maximum(np.repeat(starts, many), at[rows]) - at[rows]
    end = np.minimum(np.repeat(ends, many), at[rows + 1]) - at[rows]
    keep = end > begin
    return rows[keep], begin[keep], end[keep]
