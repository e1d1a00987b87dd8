"""Shared pieces: session facts, Arrow text buffers, vectorised words and hashes, packed blobs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: The largest long stands for a null identifier: it comes after every other one.
LAST_ID = np.iinfo(np.int64).max
#: Text of so many bytes is worked on at once, so that the arrays of a step stay in cache.
SLICE_BYTES = 1 << 20


def shared_base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset only a local master gets one below /tmp; on a cluster a
    machine's own folder would lose data, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base and "://" not in base:  # a path lies on the cluster's default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = re.sub("^file:/(?!/)", "file:///", path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())
    if base:
        return base.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        return "file:///tmp/checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one. It goes when the application ends, if nothing has removed it by then."""
    path = f"{shared_base(spark)}/{uuid.uuid4().hex}"
    until_end(spark, path)
    return path


#: Rows that one task writes of a table of a few numbers, of one with a kilobyte in each row, and of one with whole texts.
NARROW, WIDE, WHOLE = 250_000, 25_000, 2_000


def sized(df: DataFrame, rows: int | None, each: int = NARROW) -> DataFrame:
    """``df`` in tasks of about ``each`` rows, if that is fewer than it has: tasks follow the rows, not the setting of the
    shuffle. ``rows`` is their number as far as it is known beforehand; all rows are kept whatever it says."""
    return df if rows is None else df.coalesce(max(1, -(-rows // each)))


def _folder(spark: SparkSession, path: str):
    """A path of the JVM, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    for p in paths:
        path, files = _folder(spark, p)
        files.delete(path, True)


def until_end(spark: SparkSession, path: str) -> None:
    """The folder goes when the application ends, if nothing has removed it by then."""
    path, files = _folder(spark, path)
    files.mkdirs(path)
    files.deleteOnExit(path)


def _write(df: DataFrame, path: str, rows: int | None, each: int) -> DataFrame:
    sized(df, rows, each).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, rows: int | None = None, each: int = NARROW) -> DataFrame:
    """Write a table to the shared folder and read it again: a compact, columnar cut of the lineage. What a result reads
    stays until the application ends; what only leads to a result belongs into a :class:`Scratch`."""
    return _write(df, shared_folder(df.sparkSession), rows, each)


class Scratch:
    """Tables written on the way, one folder each; :meth:`drop` removes them once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, shared_folder(spark), 0
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, rows: int | None = None, each: int = NARROW) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        out = _write(df, path, rows, each)
        self.paths[id(out)] = path
        return out

    def remove(self, table: DataFrame) -> None:
        """One of the tables, by the DataFrame that :meth:`write` returned."""
        remove(self.spark, self.paths.pop(id(table)))

    def drop(self) -> None:
        remove(self.spark, self.base)

    def finished(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """A result that reads these tables, stored by itself; they go."""
        out = written(df, rows)
        self.drop()
        return out


def text_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes of the text columns: one narrow aggregate, so that it holds behind any join or filter."""
    lengths = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in columns]
    return int(df.agg(F.sum(sum(lengths, F.lit(8).cast("long")))).first()[0] or 0)


def bucket_count(df: DataFrame, text_column: str, bucket_bytes: int) -> int:
    """Buckets of about ``bucket_bytes`` of text, but enough of them to keep every shuffle partition busy."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * partitions, -(-text_bytes(df, text_column) // bucket_bytes))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores in front until no column of ``taken`` has it, whatever its case."""
    low = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *added: str) -> list[str]:
    """The columns of ``df`` that no column in ``added`` replaces."""
    low = {c.lower() for c in added}
    return [c for c in df.columns if c.lower() not in low]


def fresh(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the named columns; one that is missing is null. Extra columns never clash with inner names."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted])


# ---- blobs -----------------------------------------------------------------------------------------------------------


DTYPES = ["|u1", "<u2", "<u4", "<u8", "<i8"]
#: Shorter messages are not compressed.
PLAIN_BYTES = 256


def pack(*parts: bytes | np.ndarray) -> bytes:
    """Byte strings and arrays as one message. A part costs two bytes or so besides its content, so that messages with one
    element in them are no dearer than a row."""
    head, body = bytearray([len(parts)]), []
    for x in parts:
        raw, code = (x, 255) if isinstance(x, bytes) else (x.tobytes(), DTYPES.index(x.dtype.str))
        n = len(raw)
        head.append(code)
        while n >= 128:
            head.append(n & 127 | 128)
            n >>= 7
        head.append(n)
        body.append(raw)
    data = bytes(head) + b"".join(body)
    return b"\0" + data if len(data) < PLAIN_BYTES else b"\1" + zstandard.ZstdCompressor(level=1).compress(data)


def unpack(blob: bytes) -> list[bytes | np.ndarray]:
    data = blob[1:] if blob[0] == 0 else zstandard.ZstdDecompressor().decompress(blob[1:])
    at, heads, out = 1, [], []
    for _ in range(data[0]):
        code, n, shift, at = data[at], 0, 0, at + 1
        while True:
            n |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                break
        heads.append((code, n))
    for code, n in heads:
        raw = data[at : at + n]
        out.append(raw if code == 255 else np.frombuffer(raw, DTYPES[code]))
        at += n
    return out


# ---- texts as one byte buffer ----------------------------------------------------------------------------------------


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, end to end, and the offsets of its rows; null counts as empty. No copy is made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about ``size`` bytes each; a longer row makes a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# ---- hashing ---------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits: every input bit changes every output bit with probability near one half."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def _values(seed: int) -> np.ndarray:
    """A value for each byte, from a rule."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BYTE_VALUES = _values(1)
BASE = U64(0x9FB21C651E98DF25)


def power(base: U64, n: int) -> U64:
    return U64(pow(int(base), n, 1 << 64))


def rolled(x: np.ndarray, k: int, base: U64 = BASE) -> np.ndarray:
    """Hash of each run of ``k`` values of ``x`` by doubling; entry i covers x[i:i+k]."""
    out, done, have, step = None, 0, x, 1
    while True:
        if k & step:
            if out is None:
                out, done = have, step
            else:
                n = len(have) - done
                out = have[: max(0, n)] * power(base, done) + out[step : step + max(0, n)] if n > 0 else have[:0]
                done += step
        if done == k:
            return out[: max(0, len(x) - k + 1)]
        n = len(have) - step
        have = have[: max(0, n)] * power(base, step) + have[step:] if n > 0 else have[:0]
        step *= 2


def words_of(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, the maximal runs of bytes that are no separator. ``separator``: a flag for each byte
    value. Rows must be parted by a separator (see :func:`parted`)."""
    gap = separator[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate(([0], edge))
    if len(data) and not gap[-1]:
        edge = np.concatenate((edge, [len(data)]))
    return edge[0::2], edge[1::2]


def parted(data: np.ndarray, offsets: np.ndarray, by: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Rows copied with one separator byte after each; offsets then point into the copy."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, by, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] + np.arange(n)] = False
    out[keep] = data
    return out, offsets + np.arange(n + 1)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(size, BASE, U64), np.full(size, inverse, U64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)]
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans, from differences of one running sum."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(len(data) + 1)
    values = BYTE_VALUES if not seed else _values(seed + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * up[: len(data)], dtype=U64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each ``w`` neighbours."""
    have, span = x, 1
    while span * 2 <= w:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    if span < w:
        have = np.minimum(have[: len(x) - w + 1], have[w - span : w - span + len(x) - w + 1])
    return have


def flags(byte_values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(byte_values)] = True
    return out


#: The contract's white space: space and \t to \r.
SPACES = flags(b" \t\n\x0b\x0c\r")


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the spans, one after another."""
    if not len(starts) or not lengths.sum():
        return np.zeros(0, np.int64)
    lengths = lengths.astype(np.int64)
    out = np.ones(int(lengths.sum()), np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep].astype(np.int64), lengths[keep]
    at = np.cumsum(lengths) - lengths
    out[at] = starts
    out[at[1:]] -= starts[:-1] + lengths[:-1] - 1
    return np.cumsum(out)
