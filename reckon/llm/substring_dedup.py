"""Substring dedup by seed and extend: words that repeat an earlier document go.

Documents meet on winnowed seeds of words (see :mod:`reckon.llm.repeats`). In a shard all occurrences of a seed are
extended at once, one word at a time to the left and to the right; occurrences stay in one class as long as the words
agree. The class to the left and the class to the right of a window's seed name the window, so equal windows meet by one
sort and no pair of documents is formed. Neighbouring windows of an earlier document join to maximal repeats.

Defined results: a null text has no words; a null id comes after all others and rows with equal ids don't remove each
other; repeated rows give repeated rows; texts shorter than a window, and empty tables, lose nothing; very long texts are
read whole, in a bucket of their own. Columns are picked by name; one in ``keep`` with the name of a result is left out.
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
LENGTH, SEED = 13, 4
BUCKET_BYTES = 3 << 20


def decide(text, offsets, windows, place, anchor, own, s: R.Symbols) -> np.ndarray:
    document = np.repeat(own, windows)
    if not len(document):
        return document
    values, first, _ = s.read(text, offsets)
    seed = first[:-1] + place
    beyond = s.length - s.seed
    at = np.concatenate(([0], np.cumsum(windows)))
    window_place = np.repeat(place, windows) - (np.arange(at[-1]) - np.repeat(at[:-1], windows))  # words before the seed
    each = np.repeat(np.arange(len(windows)), windows)
    start = C.mix(C.rolled(values, s.seed))[seed]
    name = np.zeros(at[-1], U64)
    for side, turn in ((-1, 0x1D), (1, 0x2F)):
        reach = start.copy()
        size = window_place if side < 0 else beyond - window_place
        for k in range(beyond + 1):
            here = size == k
            name[here] += C.mix(reach[each[here]] + U64(turn + 64 * k))
            to = seed - k - 1 if side < 0 else seed + s.seed + k
            inside = (to >= first[:-1]) & (to < first[1:])
            reach[inside] = C.mix(reach[inside] + values[to[inside]])
    order = np.lexsort((document, name))
    lead = R._firsts(name[order])
    owner = np.empty_like(document)
    owner[order] = np.repeat(document[order][lead], np.diff(np.append(lead, len(order))))
    return owner


def substring_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, keep: tuple[str, ...] = (), bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Remove each word that a window of ``length`` words covers which also starts in a document with a smaller id.

    Returns the id, n_words, n_removed, ``repeats`` (maximal removed runs: first word and length), ``kept`` (the other
    words, one space between) and the columns named in ``keep``."""
    keep = tuple(c for c in keep if c.lower() not in ("doc_id", "n_words", "n_removed", "repeats", "kept"))
    span = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("repeats", T.ArrayType(span)), T.StructField("kept", T.StringType()), *[df.schema[c] for c in keep]]

    def finish(part: pa.Table, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Table:
        rows, begin, end = R.per_row(starts, ends, counts)
        gone = np.zeros(int(counts.sum()) + 1, np.int8)
        gone[starts] += 1
        gone[ends] -= 1
        stay = np.cumsum(gone[:-1], dtype=np.int8) == 0
        data, offsets = C.buffer_of(part["__text"])
        texts, sizes, done = [], [], 0
        for i, j in C.slices(offsets):
            apart, off = C.parted(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            first, last = C.words_of(apart, C.SPACES)
            row = np.searchsorted(first, off)
            mine = stay[done : done + len(first)]
            done += len(first)
            first, last = first[mine], last[mine]
            kept = np.concatenate(([0], np.cumsum(mine)))[row]  # kept words before each row
            long_ = last - first + 1
            out = np.append(apart, np.uint8(32))[C.ranges(first, long_)]
            stop = np.cumsum(long_)
            out[stop - 1] = 32
            word_end = np.concatenate(([0], stop))
            last_space = np.zeros(len(out), bool)
            has = np.diff(kept) > 0
            last_space[word_end[kept[1:][has]] - 1] = True
            texts.append(out[~last_space])
            sizes.append(np.diff(word_end[kept]) - has)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        left = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        text = np.ascontiguousarray(np.concatenate(texts)) if texts else np.zeros(0, np.uint8)
        out = pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(left), pa.py_buffer(text)])
        n = np.bincount(rows, minlength=len(counts))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin.astype(np.int64)), pa.array((end - begin).astype(np.int64))], ["first_word", "n_words"]))
        columns = [part["__id"], pa.array(counts.astype(np.int64)), pa.array(np.bincount(rows, end - begin, len(counts)).astype(np.int64)), lists, out.cast(pa.string()), *[part[f"__carry_{c}"] for c in keep]]
        return pa.table(columns, names=[f.name for f in fields])

    symbols = R.Symbols(True, length, min(SEED, length))
    return R.remove_repeats(df, symbols, decide, finish, T.StructType(fields), id_column, text_column, list(keep), bucket_bytes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document of ``documents``."""
    out = substring_dedup(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
