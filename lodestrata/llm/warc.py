"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about FRAME_BYTES, each compressed by itself,
and frames into bundles of about BUNDLE_BYTES.  A bundle ends with a seek
table in a skippable frame (compressed and plain size of every frame, number of
frames, magic number), so a reader finds a frame from the end of the file, and
one record costs one frame.  The index maps record identifiers to (bundle,
frame, offset inside the frame, length).

A bundle is written to a temporary name and renamed, under a name that its task
determines, so that a repeated task replaces what a lost one wrote.  A task
holds one open bundle and one Arrow batch in memory.

Of records with equal payloads that of the smallest page_id is the response and
the others are revisits that refer to it, without a payload; payloads of less
than `min_revisit_bytes` are always stored.  Null html is an empty payload.
Repeated rows (same page_id, same html) are records of their own: the first is
stored, the others revisit it.  One page_id with different html gives records of different
identifiers.  A null page_id is kept as null; it is the
response only where no other row has the payload.  Line ends in a url are
percent-coded, a null url is left out.  An empty table gives no bundles and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_batches, materialise, scratch_dir

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")
_HEAD = struct.Struct("<II")

RECORDS = "page_id long, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset long, length long"
INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"


def storage(uri: str):
    """pyarrow file system and path of a folder that Spark names."""
    from pyarrow import fs

    if uri.startswith("s3a://"):
        uri = "s3" + uri[3:]
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


class Bundle:
    """A bundle in memory that takes records."""

    def __init__(self):
        import zstandard

        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.done, self.size, self.table, self.open = [], 0, [], bytearray()

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        at = len(self.table), len(self.open)
        self.open += record
        if len(self.open) >= FRAME_BYTES:
            self.flush()
        return at

    def flush(self) -> None:
        if self.open:
            frame = self.zip.compress(bytes(self.open))
            self.done.append(frame)
            self.table.append((len(frame), len(self.open)))
            self.size += len(frame)
            self.open = bytearray()

    def close(self) -> bytes:
        self.flush()
        entries = b"".join(_HEAD.pack(*x) for x in self.table) + _FOOTER.pack(len(self.table), 0, SEEK_MAGIC)
        return b"".join(self.done) + _HEAD.pack(SKIPPABLE_MAGIC, len(entries)) + entries


def seek_table(tail: bytes) -> list[tuple[int, int]]:
    """Sizes of all frames from the last bytes of a bundle."""
    n, flags, magic = _FOOTER.unpack(tail[-_FOOTER.size :])
    if magic != SEEK_MAGIC or flags:
        raise ValueError("no seek table")
    start = len(tail) - _FOOTER.size - n * _HEAD.size
    return [_HEAD.unpack_from(tail, start + i * _HEAD.size) for i in range(n)]


def frames_of(bundle: memoryview) -> list[tuple[int, int]]:
    """Sizes of all frames of a bundle in memory."""
    n, _, _ = _FOOTER.unpack(bundle[-_FOOTER.size :])
    return seek_table(bytes(bundle[-(_FOOTER.size + n * _HEAD.size) :]))


def warc_record(record_id: str, url: str | None, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(frame: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of a frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        stop = end + 4 + size + 4
        yield at, stop - at, head, frame[end + 4 : end + 4 + size]
        at = stop


def _page_of(record_id: str) -> int | None:
    part = record_id.strip("<>").split(":")[2]
    return None if part == "null" else int(part)


def _urn(page_id: int | None, digest: str, time: int = 1) -> str:
    """Identifier of a record: its page, its payload, and its number among repeated rows of both."""
    return f"urn:x-page:{'null' if page_id is None else page_id}:{digest}" + (f":{time}" if time > 1 else "")


def plan_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html, sha1, first_id, time: what each record refers to, if it isn't the first."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    thin = materialise(rows.select("page_id", "sha1", F.octet_length("html").cast("long").alias("n")), "warc-digests")
    firsts = thin.groupBy("sha1", "n").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    firsts = firsts.where(F.col("n") >= min_revisit_bytes)
    refs = thin.join(firsts, ["sha1", "n"]).where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select("page_id", "sha1", "first_id").distinct()
    repeated = not thin.groupBy("page_id", "sha1").count().where("count > 1").isEmpty()
    if repeated:
        order = W.partitionBy("page_id", "sha1").orderBy("url")
        rows = rows.withColumn("time", F.row_number().over(order))
    else:
        rows = rows.withColumn("time", F.lit(1))
    r = refs.select(F.col("page_id").alias("_p"), F.col("sha1").alias("_s"), "first_id")
    return rows.join(r, rows["page_id"].eqNullSafe(r["_p"]) & (rows["sha1"] == r["_s"]), "left").select("page_id", "url", "html", "sha1", "first_id", "time", (F.octet_length("html") >= min_revisit_bytes).alias("may_revisit"))


def write_bundles(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages to bundles in folder; the index, itself stored beside them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = storage(folder)
        task, number, bundle = TaskContext.get().partitionId(), 0, Bundle()
        rows: list[tuple] = []

        def close() -> pa.RecordBatch:
            name = f"bundle-{task:06d}-{number:05d}.warc.zst"
            draft = f"{path}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                out.write(bundle.close())
            fs.move(draft, f"{path}/{name}")
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array([name] * len(rows)), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                ["record_id", "page_id", "bundle", "frame", "offset", "length"],
            )

        fs.create_dir(path, recursive=True)
        for batch in batches:
            for page_id, url, html, sha1, first_id, time, may in zip(*(c if i == 2 else c.to_pylist() for i, c in enumerate(batch.columns)), strict=True):
                payload = html.as_buffer().to_pybytes()
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                record_id = _urn(page_id, digest, time)
                refers = _urn(first_id, digest) if first_id is not None else _urn(page_id, digest) if time > 1 and may else None
                record = warc_record(record_id, url, digest, payload, refers)
                frame, offset = bundle.add(record)
                rows.append((record_id, page_id, frame, offset, len(record)))
                if bundle.size >= BUNDLE_BYTES:
                    yield close()
                    number, bundle, rows = number + 1, Bundle(), []
        if rows:
            yield close()

    return materialise(plan_records(in_batches(pages), min_revisit_bytes).mapInArrow(work, INDEX), "warc-index")


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of all bundles of a folder, payload digests checked; see RECORDS."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                view, rows, at = memoryview(content.as_buffer()), [], 0
                for frame, (size, plain) in enumerate(frames_of(view)):
                    data = unzip.decompress(view[at : at + size], max_output_size=plain)
                    at += size
                    for offset, length, head, block in parse_records(data):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(http.rsplit(b": ", 1)[1])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = head["WARC-Type"]
                        if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
                        record_id = head["WARC-Record-ID"].strip("<>")
                        rows.append((_page_of(record_id), record_id, n, digest, kind, _page_of(head["WARC-Refers-To"]) if kind == "revisit" else None, name, frame, offset, length))
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                names = [x.split()[0] for x in RECORDS.split(", ")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(work, RECORDS)


def read_record(folder: str, bundle: str, frame: int, offset: int, length: int) -> bytes:
    """One record by its index entry: reads the seek table and a single frame."""
    import zstandard

    fs, path = storage(folder)
    with fs.open_input_file(f"{path}/{bundle}") as f:
        size = f.size()
        n, _, magic = _FOOTER.unpack(f.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        tail = f.read_at(_FOOTER.size + n * _HEAD.size, size - _FOOTER.size - n * _HEAD.size)
        table = seek_table(tail)
        start = sum(x[0] for x in table[:frame])
        return zstandard.ZstdDecompressor().decompress(f.read_at(table[frame][0], start), max_output_size=table[frame][1])[offset : offset + length]


def archive(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> tuple[str, DataFrame, DataFrame]:
    """Write the pages, read them back: folder, index and records."""
    spark = pages.sparkSession
    folder = folder or scratch_dir(spark, "warc")
    index = write_bundles(pages, folder, min_revisit_bytes)
    if index.isEmpty():
        return folder, index, spark.createDataFrame([], RECORDS)
    return folder, index, read_bundles(spark, folder)
