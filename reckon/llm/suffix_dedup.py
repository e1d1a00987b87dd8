"""Suffix-array dedup: bytes that repeat an earlier document go, the first document keeps them.

Windows of ``length`` bytes whose anchor two documents share meet in a shard (see :mod:`reckon.llm.repeats`). There their
suffix array is built to the depth of a window, with the longest common prefixes of neighbours. Seen in suffix order, the
previous and the next place with a smaller document bound the longest previous factor (LPF) of a suffix: the longest match
that starts in an earlier document. Where it reaches ``length`` the bytes are a later copy.

Defined results: a null text is empty; a null id comes after all others and rows with equal ids don't remove each other;
repeated rows give repeated rows; texts shorter than a window, and empty tables, lose nothing; very long texts are read
whole, in a bucket of their own. Columns are picked by name; one in ``keep`` with the name of a result is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.llm import common as C
from reckon.llm import repeats as R

U64 = np.uint64
LENGTH, SEED = 50, 20
BUCKET_BYTES = 3 << 19


def suffix_columns(text: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """The first ``length`` (8 at least) bytes of each suffix as big-endian words; the last one overlaps its neighbour."""
    wide = text.astype(U64)
    for n in (1, 2, 4):
        wide = (wide[:-n] << U64(8 * n)) | wide[n:]
    return [wide[at + min(8 * k, length - 8)] for k in range(-(-length // 8))]


def suffix_array(columns: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes, and the common prefix of each with the one before it, to ``length`` at most."""
    order = np.lexsort(columns[::-1])
    prefix = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for k, column in enumerate(columns):
        begin = min(8 * k, length - 8)
        differ = column[order[open_]] ^ column[order[open_ - 1]]
        apart = differ != 0
        zeros = 7 - (np.frexp(np.maximum(differ[apart] >> U64(8), U64(0)).astype(np.float64))[1] + 7) // 8
        prefix[open_[apart]] = begin + zeros
        open_ = open_[~apart]
    prefix[open_] = length
    return order, prefix


def longest_previous_factor(document: np.ndarray, prefix: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in suffix order: length of the longest match that starts in a smaller document, and where that is.

    The nearest smaller document on either side is found by jumping over everything that isn't smaller; the least common
    prefix on the way comes along. The better side wins, the left one if they are equal."""
    n = len(document)
    best, where = np.zeros(n, np.int64), np.arange(n)
    for step in (-1, 1):
        jump = np.arange(n) + step
        least = prefix.copy() if step < 0 else np.append(prefix[1:], 0)
        active = np.flatnonzero((jump >= 0) & (jump < n))
        while len(active):
            to = jump[active]
            active = active[(document[to] >= document[active]) & (least[active] > 0)]
            to = jump[active]
            least[active] = np.minimum(least[active], least[to])
            jump[active] = jump[to]
            inside = (jump[active] >= 0) & (jump[active] < n)
            least[active[~inside]] = 0
            active = active[inside]
        jump = np.clip(jump, 0, n - 1)
        least[document[jump] >= document] = 0
        better = least > best
        best[better], where[better] = least[better], jump[better]
    return best, where


def decide(text, offsets, windows, place, anchor, own, s: R.Symbols) -> np.ndarray:
    at = C.ranges(offsets[:-1], windows)
    document = np.repeat(own, windows)
    if not len(at):
        return document
    order, prefix = suffix_array(suffix_columns(text, at, s.length), s.length)
    factor, where = longest_previous_factor(document[order], prefix, s.length)
    first = np.where(factor >= s.length, where, np.arange(len(where)))
    while True:  # an earlier copy may itself be a copy
        further = first[first]
        if (further == first).all():
            break
        first = further
    owner = np.empty_like(document)
    owner[order] = document[order][first]
    return owner


def removed_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    gone = np.zeros(n + 1, np.int8)
    gone[starts] += 1
    gone[ends] -= 1
    return np.cumsum(gone[:-1], dtype=np.int8).astype(bool)


def suffix_array_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, keep: tuple[str, ...] = (), whole_characters: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also starts in a document with a smaller id.

    Returns the id, n_bytes, n_removed, n_spans, ``kept`` (binary: what is left) and the columns named in ``keep``. With
    ``whole_characters`` a character that loses a byte goes whole, so that ``kept`` is valid UTF-8."""
    if length < 8:
        raise ValueError("length must be 8 at least")
    keep = tuple(c for c in keep if c.lower() not in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept"))
    fields = [T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType()), *[df.schema[c] for c in keep]]

    def finish(part: pa.Table, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Table:
        data, offsets = C.buffer_of(part["__text"])
        rows, begin, end = R.per_row(starts, ends, counts)
        gone = removed_mask(len(data), starts, ends)
        if whole_characters and gone.any():
            character = np.cumsum((data & 0xC0) != 0x80)
            lost = np.zeros(character[-1] + 1, bool)
            lost[character[gone]] = True
            gone = lost[character]
        kept = data[~gone]
        left = np.concatenate(([0], np.cumsum(~gone)))[offsets]
        out = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kept))])
        columns = [part["__id"], pa.array(counts), pa.array(np.bincount(rows, end - begin, len(counts)).astype(np.int64)), pa.array(np.bincount(rows, minlength=len(counts))), out.cast(pa.binary()), *[part[f"__carry_{c}"] for c in keep]]
        return pa.table(columns, names=[f.name for f in fields])

    symbols = R.Symbols(False, length, min(SEED, length))
    return R.remove_repeats(df, symbols, decide, finish, T.StructType(fields), id_column, text_column, list(keep), bucket_bytes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document of ``documents``."""
    out = suffix_array_dedup(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
