"""Documents packed into blocks, and tables of block-wise distinct keys.

Vocabularies grow with the corpus, so they are never broadcast.  Instead a block
of some thousand documents asks for each of its distinct keys once: sorted keys
go to their range of the key space as packed deltas, and the answers come back
to the block in the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ARROW_BYTES, in_batches, sub_blocks, text_bytes, trim

#: Bytes of text of a block, about: an Arrow batch.
PACK_BYTES = ARROW_BYTES

SCHEMA = "blk long, doc_ids array<long>, flags array<boolean>, sizes array<int>, body binary"


def pack_ints(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_ints(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_ints(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(raw), dtype=np.uint64)


def lists(values: pa.Array, bounds: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def pack(docs: DataFrame, flag: Column) -> DataFrame:
    """Blocks of docs(doc_id, text), with a flag for each document; blk numbers are unique."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        number = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            # Equal parts, not one of PACK_BYTES and a rest.
            for i, j in sub_blocks(off, -(-len(data) // max(1, round(len(data) / PACK_BYTES)))):
                part = batch.slice(i, j - i)
                sizes = pa.array(np.diff(off[i : j + 1]).astype(np.int32))
                body = pa.array([squeeze.compress(data[off[i] : off[j]].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(lists(x, [0, j - i]) for x in (part.column(0), part.column(2), sizes)), body], ["blk", "doc_ids", "flags", "sizes", "body"])
                number += 1

    return in_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(flag, F.lit(False))).mapInArrow(work, SCHEMA)


def unpack(sizes: pa.Scalar, body: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a block's texts."""
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body.as_py()), np.uint8)
    return data, np.concatenate([[0], np.cumsum(sizes.values.to_numpy(), dtype=np.int64)])


def key_ranges(keys: np.ndarray, ranges: int) -> tuple[list[int], list[int]]:
    """Which of so many equal ranges of the key space the sorted keys are in, and where each of these begins among them.

    It takes no more than the keys do, whatever the number of ranges (2**32 at most).
    """
    part = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return part[first].tolist(), [*first.tolist(), len(keys)]


def plain_bytes(blocks: DataFrame) -> int:
    """Bytes of all texts."""
    return blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0


def distinct_keys(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of key and check in order, and which of them each is."""
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])) if len(k) else np.zeros(0, bool)
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return k[new], c[new], inverse


def totals_by_key(blocks: DataFrame, columns: list[str], keys_of: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]], ranges: int) -> DataFrame:
    """Sums over all blocks of what keys_of(row) gives: sorted distinct keys with their checks, and counts.

    blk, part, totals: for each block and range of keys the sums, in the order of
    the block's keys; n (sum of all counts) and v (keys of a count above 0) of a
    range stand in a row whose blk is null.  A block sends at most a row for each of its keys.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blk, *rest in zip(batch.column("blk"), *(batch.column(c) for c in columns), strict=True):
                key, check, count = keys_of(dict(zip(columns, rest, strict=True)))
                some, cut = key_ranges(key, ranges)
                own = [pa.array([f(x[i:j]) for i, j in zip(cut, cut[1:], strict=False)], pa.binary()) for f, x in ((pack_sorted, key), (pack_ints, check), (pack_ints, count))]
                del key, check, count
                trim()
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([blk.as_py()] * len(some), pa.int64()), *own], ["part", "blk", "keys", "checks", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x.as_py()) for x in table.column("keys")]
        at = np.cumsum([0, *map(len, keys)])
        key = np.concatenate(keys)
        del keys
        distinct, _, inverse = distinct_keys(key, np.concatenate([unpack_ints(x.as_py()) for x in table.column("checks")]))
        counts = np.concatenate([unpack_ints(x.as_py()) for x in table.column("counts")])
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
        packed = [pack_ints(total[inverse[a:b]]) for a, b in zip(at, at[1:], strict=False)]
        n, sums = len(packed), (int(total.sum()), int((total > 0).sum()))
        del key, counts, distinct, inverse, total
        trim()
        return pa.table(
            {
                "blk": pa.array([*table.column("blk").to_pylist(), None], pa.int64()),
                "part": pa.array([table.column("part")[0].as_py()] * (n + 1), pa.int64()),
                "totals": pa.array([*packed, None], pa.binary()),
                "n": pa.array([0] * n + [sums[0]], pa.int64()),
                "v": pa.array([0] * n + [sums[1]], pa.int64()),
            }
        )

    asked = blocks.select("blk", *columns).mapInArrow(ask, "part long, blk long, keys binary, checks binary, counts binary")
    return asked.groupBy("part").applyInArrow(answer, "blk long, part long, totals binary, n long, v long")


def answers(totals: DataFrame) -> DataFrame:
    """blk, answers: all totals of a block, in the order of its keys."""
    return totals.where("blk is not null").groupBy("blk").agg(F.array_sort(F.collect_list(F.struct("part", "totals"))).alias("answers"))
