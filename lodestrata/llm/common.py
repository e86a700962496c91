"""Shared pieces of the training-data operators: tables, scratch, numpy kernels."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import struct
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sub-block of a batch that one numpy pass works on, in bytes of text.
BLOCK_BYTES = 2 << 20

#: Bytes of an Arrow batch at most, about (else it is bounded by 10,000 rows alone, of any length).
ARROW_BYTES = 6 << 20

#: Odd multiplier of the polynomial text hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def in_batches(df: DataFrame) -> DataFrame:
    """df, whose Arrow batches (and all later ones of its session) are bounded in bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share.

    Only where a session of this machine alone has no such setting (local tests) a
    temporary folder is set for it; on a cluster that is an error, for executors
    wouldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodestrata-{tag}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, tag)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a materialised frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    hadoop = df.sparkSession._jsc.hadoopConfiguration()
    seen = set()
    for name in df.inputFiles():
        folder = name.rsplit("/", 1)[0]
        if "lodestrata-" in folder and folder not in seen:
            seen.add(folder)
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def trim() -> None:
    """Give freed memory of this worker back to the machine: arrays of some MB else stay in its heap."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have (Spark's names don't tell case apart)."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the column as text, modulo mod; null gives -1."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % F.lit(mod), F.lit(-1))


def text_bytes(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings one behind the other, and the n+1 offsets; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary()).fill_null(b"")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def sub_blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole strings of about limit bytes; a longer string stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            t = np.full(max(n, 1 << 16), base, np.uint64)
            t[0] = 1
            _tables[key] = np.multiply.accumulate(t)
    return _tables["p"], _tables["i"]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n+1 prefix sums from which span_hash() takes any span's hash in O(1)."""
    p, _ = _powers(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, the same wherever the bytes stand; other bytes may have the same."""
    _, inv = _powers(len(prefix))
    h = (prefix[ends] - prefix[starts]) * inv[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(h)


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at_once: int = 1 << 19) -> np.ndarray:
    """Stretches of data, one behind the other; index arrays for a part of them at a time."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    i = 0
    while i < len(sizes):
        low = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, low + at_once, side="right")))
        at = ends[i:j] - sizes[i:j] - low
        out[low : ends[j - 1]] = data[np.arange(int(ends[j - 1]) - low) + np.repeat(starts[i:j] - at, sizes[i:j])]
        i = j
    return out


def head_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each span as a number, with zeros behind shorter spans."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))[starts].view(np.uint64).reshape(-1)
    short = sizes < 8
    out[short] &= (np.uint64(1) << (np.uint64(8) * sizes[short].astype(np.uint64))) - np.uint64(1)
    return out


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, at_once: int = 4 << 20) -> np.ndarray:
    """Whether the bytes from a on equal those from b on, for spans of these sizes."""
    out = head_bytes(data, a, sizes) == head_bytes(data, b, sizes)
    long = np.flatnonzero(out & (sizes > 8))
    ends, i = np.cumsum(sizes[long]), 0
    while i < len(long):  # some MB of both sides at a time
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + at_once, side="right")))
        part = long[i:j]
        n = sizes[part]
        differ = gather(data, a[part], n) != gather(data, b[part], n)
        out[part] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
        i = j
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of one span of each different content, and for every span which of those it equals.

    Hashes bring equal spans together, their bytes decide.
    """
    _, first, inverse = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
    sizes, rep = ends - starts, first[inverse]
    wrong = np.flatnonzero(rep != np.arange(len(rep)))
    wrong = wrong[(sizes[wrong] != sizes[rep[wrong]]) | ~same_spans(data, starts[wrong], starts[rep[wrong]], np.minimum(sizes[wrong], sizes[rep[wrong]]))]
    if len(wrong):  # hashes that collide
        numbers: dict[bytes, int] = {}
        more = []
        for k in wrong.tolist():
            span = data[starts[k] : ends[k]].tobytes()
            if span not in numbers:
                numbers[span] = len(first) + len(more)
                more.append(k)
            inverse[k] = numbers[span]
        first = np.append(first, more)
    return first, inverse


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and check (64 bits each) of each span, which together stand for its bytes.

    Spans of less than 16 bytes are the two numbers themselves, longer ones take 120 bits of a cryptographic digest.
    """
    sizes = ends - starts
    key, check = head_bytes(data, starts, sizes), np.zeros(len(sizes), np.uint64)
    more = np.flatnonzero((sizes > 8) & (sizes < 16))
    check[more] = head_bytes(data, starts[more] + 8, sizes[more] - 8)
    for k in np.flatnonzero(sizes >= 16).tolist():
        key[k], check[k] = _DIGEST.unpack(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=15).digest() + b"\0")
    check |= np.minimum(sizes, 16).astype(np.uint64) << np.uint64(56)
    return mix64(key), check


_DIGEST = struct.Struct("<QQ")

#: Lower-casing of A-Z only, as a table over bytes.
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and string numbers of the maximal runs without x20, x09-x0D; none crosses strings."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = off[1:-1]
    inner = inner[inner < len(data)]
    first[inner] |= word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = inner[inner > 0]
    last[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1
