"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of about ``FRAME_BYTES``; a bundle ends with the seek table of the seekable
format (a skippable frame with the compressed and plain size of each frame), so plain Zstandard readers read it as well. The
index maps each record to its bundle, frame and offset within the frame: one record is read by unpacking one frame.

Equal payloads: the digests are aggregated (not the pages), so a payload that a third of all pages have is no matter; the
page with the smallest id is ``response``, the others ``revisit`` it. A writer task streams its records and holds one
frame at a time. Bundles go to the shared folder under names that carry a unique attempt and are found through the index of
the task that finished, so a lost or repeated task leaves no wrong record. The file system is whatever the folder's URI names.

Defined results: null html is an empty payload; empty payloads (below ``least`` bytes) can be kept apart; of rows with equal
payload and equal smallest id all are ``response``; a null id comes last; empty tables make no bundle. A record longer than
a frame makes a frame of its own; the seek table's fields have 32 bits, so a frame, and with it a record, is under 4 GiB.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.llm import common as C

FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
#: Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
LEVEL = 3
INDEX = "page_id long, bundle string, frame long, frame_start long, frame_bytes long, record_offset long, record_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, name: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the digest and length of its payload, not the payload."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{name}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers and body of the record at the start of ``data``, and the bytes it takes."""
    cut = data.index(b"\r\n\r\n")
    lines = data[:cut].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    size = int(head["Content-Length"])
    return head | {"version": lines[0]}, data[cut + 4 : cut + 4 + size], cut + 8 + size


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(stream, size: int) -> list[tuple[int, int, int]]:
    """Frames of a bundle from its end: start, compressed and plain size."""
    stream.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != FOOTER or flags:
        raise ValueError("no seek table")
    stream.seek(size - 9 - 8 * n)
    sizes = list(struct.iter_unpack("<II", stream.read(8 * n)))
    starts, at = [], 0
    for packed, plain in sizes:
        starts.append((at, packed, plain))
        at += packed
    return starts


class Bundle:
    """Writes one bundle; ``index`` gets (page_id, frame, offset in the frame, bytes)."""

    def __init__(self, place: fs.FileSystem, path: str):
        self.stream, self.path, self.packed = place.open_output_stream(path, compression=None), path, 0
        self.frames: list[tuple[int, int]] = []
        self.pending: list[bytes] = []
        self.size = 0
        self.waiting: list[tuple] = []
        self.index: list[tuple] = []
        self.pack = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, page_id: int | None, data: bytes) -> None:
        self.waiting.append((page_id, len(self.frames), self.size, len(data)))
        self.pending.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            packed = self.pack.compress(b"".join(self.pending))
            self.stream.write(packed)
            self.index += [(p, f, o, self.packed, len(packed), n) for p, f, o, n in self.waiting]
            self.frames.append((len(packed), self.size))
            self.packed += len(packed)
            self.pending, self.waiting, self.size = [], [], 0

    def close(self) -> None:
        self.flush()
        self.stream.write(seek_table(self.frames))
        self.stream.close()


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI. A bare path would be another folder on each machine, so it must name its scheme."""
    if "://" not in folder and not folder.startswith("file:"):
        raise ValueError(f"{folder} has no scheme: name the shared file system, as in hdfs:// or file://")
    return fs.FileSystem.from_uri(folder)


def write_bundles(df: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least: int = 0, bundle_bytes: int = BUNDLE_BYTES, scratch: C.Scratch | None = None) -> DataFrame:
    """Write the archives and return the index (one row a record). Running it writes; read the returned table only once,
    or store it first."""
    pages = df.select(F.col(f"`{id_column}`").cast("long").alias("page_id"), F.col(f"`{url_column}`").alias("url"), F.coalesce(F.col(f"`{html_column}`").cast("string"), F.lit("")).alias("html"))
    keyed = pages.withColumn("sha", F.sha1("html")).withColumn("own", F.octet_length("html") < least)
    # stored, so that both sides of the join are plain scans: a payload that very many pages have is split over tasks
    first = (scratch or C.Scratch(df.sparkSession)).write(keyed.filter("not own").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    marked = keyed.join(first, "sha", "left").select("page_id", "url", "html", F.when(~F.col("own") & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, path = opened(folder)
        place.create_dir(path, recursive=True)
        bundle = None

        def finished(b: Bundle) -> pa.RecordBatch:
            b.close()
            name = b.path.rsplit("/", 1)[1]
            rows = [(p, name, f, s, n, o, m) for p, f, o, s, n, m in b.index]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
            cols = list(zip(*rows)) if rows else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = html.as_py().encode()
                if bundle is None:
                    bundle = Bundle(place, f"{path}/bundle-{uuid.uuid4().hex}.warc.zst")
                bundle.add(page_id.as_py(), record(page_id.as_py(), url.as_py(), payload, digest(payload), refers_to.as_py()))
                if bundle.packed >= bundle_bytes:
                    yield finished(bundle)
                    bundle = None
        if bundle is not None:
            yield finished(bundle)

    return marked.mapInArrow(run, INDEX)


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_bundles(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of an index, read frame by frame from the archives. Responses are checked against their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, path = opened(folder)
        unpack = zstandard.ZstdDecompressor()
        name, stream, start, frame = None, None, None, b""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["bundle"] != name:
                    if stream:
                        stream.close()
                    name, stream, start = r["bundle"], place.open_input_file(f"{path}/{r['bundle']}"), None
                if r["frame_start"] != start:
                    stream.seek(r["frame_start"])
                    start, frame = r["frame_start"], unpack.decompress(stream.read(r["frame_bytes"]))
                head, body, _ = parse(frame[r["record_offset"] : r["record_offset"] + r["record_bytes"]])
                kind, named = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and digest(body) != named:
                    raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't have its digest")
                number = lambda x: int(x) if (x := x[len("<urn:page:") : -1]) else None
                out.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), named, kind, number(head["WARC-Refers-To"]) if kind == "revisit" else None, body if payloads else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            cols = list(zip(*out)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in RECORD.split(", ")])
        if stream:
            stream.close()

    return index.mapInArrow(run, RECORD)


def lookup(index: DataFrame, folder: str, page_ids: list[int]) -> DataFrame:
    """Single records by id: each needs one frame."""
    return read_bundles(index.filter(F.col("page_id").isin(*page_ids)), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every row of ``pages``, written to archives and read back from them."""
    scratch = C.Scratch(spark)
    folder = f"{scratch.base}/bundles"
    index = scratch.write(write_bundles(C.table(spark, sf_dir, "pages"), folder, scratch=scratch))
    return scratch.finished(read_bundles(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
