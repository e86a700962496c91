"""Removal of byte strings that also start earlier, by blockwise suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a
document of a smaller doc_id, or before in the same one (null doc_ids come last;
rows of one doc_id in the order of their blocks).  All strings are judged on the input.

Suffixes are sorted in blocks, each to LENGTH bytes:

1. Every window of LENGTH bytes has an anchor, the one of its ANCHOR-byte substrings with the
   least hash (leftmost of equal ones).  Equal windows have equal anchors at the same
   place, so an anchor is a suffix bucket that holds all copies of its windows.
   Blocks of documents ask, by key range, which anchors occur again; the other
   windows have no copy and are not sorted.
2. For anchors that do, the stretch of text that holds the anchor's windows goes to the task
   that owns the key range.  Of stretches of the same bytes in a block only the first goes.
3. The owner sorts one chunk of buckets at a time.  Cover samples, every STEP-th
   byte counted from the anchor, are ranked by doubling to 8, 16, 32 and 64 bytes; a window is
   then two ranks and the STEP bytes that its samples leave out, so long ties cost no
   more than short ones.  Of equal windows all but the first are marked.
4. Marks go back to the blocks of documents, which cut the bytes out.

A window that equals another is aligned with it at the anchor, so one residue class of sample
positions covers all pairs that can tie.  Anchors of more than HOT occurrences are split by
the windows themselves, each its own bucket.  Memory is bounded by a block of
documents, or by a chunk of buckets.

Null texts are empty; texts under LENGTH bytes lose nothing.  Repeated rows count
as documents of their own, the later ones lose what they repeat.  An empty
table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import answers, pack, pack_ints, pack_sorted, plain_bytes, totals_by_key, unpack, unpack_ints, unpack_sorted
from .common import gather, materialise, mix64, prefix_hash, same_spans, span_hash, sub_blocks, trim

#: Bytes of a string that counts as repeated.
LENGTH = 100
#: Bytes of an anchor, distance of cover samples.
ANCHOR, STEP = 32, 4
#: Occurrences from which an anchor is split by its windows.
HOT = 16_000
#: Bytes of text whose anchors, and whose stretches, one task owns, about; bytes of a chunk.
RANGE_BYTES, PART_BYTES, CHUNK_BYTES = 16 << 20, 4 << 20, 1 << 20
#: Bytes of text whose anchors are looked for at once, and anchors of a block that are kept.
SUB_BYTES, KEEP = 1 << 20, 1 << 20

_POS = np.uint64((1 << 28) - 1)


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """key, place of the anchor, first window, number of windows."""
    none = np.zeros(0, np.int64)
    size = np.diff(off)
    prefix = prefix_hash(data)
    has = np.flatnonzero(size >= length)
    if not len(has):
        return none.astype(np.uint64), none, none, none
    at = np.arange(len(data) - ANCHOR + 1)
    h = span_hash(prefix, at, at + ANCHOR)
    m = (h & ~_POS) | at.astype(np.uint64)
    span, have = length - ANCHOR + 1, 1
    while 2 * have <= span:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    if have < span:
        m = np.minimum(m[: len(m) - (span - have)], m[span - have :])
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, off[has], 1)
    np.add.at(edge, off[has + 1] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(edge)[: len(m)] > 0)
    place = (m[window] & _POS).astype(np.int64)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)))
    place, n = place[first], np.diff(np.append(first, len(window)))
    # Least hashes crowd at one end: scrambled keys spread over the ranges.
    return mix64(h[place]), place, window[first], n


def pieces(off: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of bytes of a block and the offsets of the strings in them.

    Whole strings as a rule; a string of more than SUB_BYTES is cut into overlapping pieces, each window of it in one of them.
    """
    for i, j in sub_blocks(off, SUB_BYTES):
        lo, hi = int(off[i]), int(off[j])
        if j > i + 1 or hi - lo <= SUB_BYTES + length:
            yield lo, hi, off[i : j + 1] - lo
        else:
            for at in range(lo, hi - length + 1, SUB_BYTES):
                end = min(hi, at + SUB_BYTES + length - 1)
                yield at, end, np.array([0, end - at])


class Anchored:
    """(first byte, last byte, key, place, first window, number of windows) of each piece of a block; places count from the first byte.

    A text of one byte over and over has an anchor at every place; beyond KEEP anchors they are found again each time.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int = LENGTH):
        self._own, self._kept, have = (data, off, length), [], 0
        for x in self._find():
            self._kept.append(x)
            have += len(x[2])
            if have > KEEP:
                self._kept = None
                break

    def _find(self) -> Iterator[tuple]:
        data, off, length = self._own
        for lo, hi, at in pieces(off, length):
            yield (lo, hi, *anchors(data[lo:hi], at, length))

    def __iter__(self) -> Iterator[tuple]:
        return iter(self._kept) if self._kept is not None else self._find()

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchor keys and how often each occurs; anchors of one key share a bucket, whatever their bytes."""
        own = [np.unique(x[2], return_counts=True) for x in self]
        key, which = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in own)]), return_inverse=True)
        return key, np.bincount(which, np.concatenate([np.zeros(0), *(n for _, n in own)]), len(key)).astype(np.int64)


def ordinal(ids: np.ndarray) -> np.ndarray:
    """Signed doc_ids as unsigned numbers of the same order."""
    return ids.view(np.uint64) ^ np.uint64(1 << 63)


class Stretches:
    """Stretches of text around anchors, in columns."""

    COLUMNS = ("key", "doc", "blk", "idx", "start", "n", "rel")

    def __init__(self, columns: dict[str, np.ndarray], text: np.ndarray):
        self.c, self.text = columns, text

    def length(self, length: int) -> np.ndarray:
        return self.c["n"] - 1 + length

    def pack(self) -> dict[str, bytes]:
        import zstandard

        out = {k: pack_ints(self.c[k]) for k in self.COLUMNS[1:] if k != "blk"}
        return out | {"key": pack_sorted(self.c["key"]), "body": zstandard.ZstdCompressor(level=3).compress(self.text.tobytes())}


#: Columns of a stretch: hashes of anchor and text, document, number in the block, start in it, windows, place of the anchor, place in the block.
_KEY, _WHOLE, _DOC, _IDX, _START, _N, _REL, _AT = range(8)


def _first_ones(data: np.ndarray, t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches that don't repeat another one, by key, and (idx, start, n) of the rest; the first in order of documents stays."""
    t = t[np.lexsort((t[:, _START], t[:, _IDX], t[:, _DOC], t[:, _N], t[:, _REL], t[:, _WHOLE], t[:, _KEY]))]
    again = np.append(False, (t[1:, [_KEY, _WHOLE, _N, _REL]] == t[:-1, [_KEY, _WHOLE, _N, _REL]]).all(1))[: len(t)]
    same = np.flatnonzero(again)
    again[same] = same_spans(data, t[same, _AT].astype(np.int64), t[same - 1, _AT].astype(np.int64), t[same, _N].astype(np.int64) - 1 + length)
    return t[~again], _joined(t[again][:, [_IDX, _START, _N]])


def _joined(marks: np.ndarray) -> np.ndarray:
    """Runs of windows that follow each other in one."""
    marks = marks[np.lexsort((marks[:, 1], marks[:, 0]))]
    new = np.append(True, (marks[1:, 0] != marks[:-1, 0]) | (marks[1:, 1] != marks[:-1, 1] + marks[:-1, 2]))[: len(marks)]
    first = np.flatnonzero(new)
    return np.column_stack([marks[first, 0], marks[first, 1], np.add.reduceat(marks[:, 2], first) if len(first) else marks[:, 2]])


def block_stretches(data: np.ndarray, off: np.ndarray, ids: np.ndarray, found: Anchored, keys: np.ndarray, totals: np.ndarray, length: int = LENGTH, hot: int = HOT) -> tuple[Stretches, np.ndarray]:
    """Stretches of anchors that occur again, and (idx, start, n) of those that repeat one of this block.

    Repeats go piece by piece, so a text that is one byte over and over leaves a few rows of each.
    """
    parts, gone = [np.zeros((0, 8), np.uint64)], [np.zeros((0, 3), np.uint64)]
    for lo, hi, key, place, start, n in found:
        if not len(key):
            continue
        prefix = prefix_hash(data[lo:hi])
        total = totals[np.searchsorted(keys, key)]
        use = np.flatnonzero(total > 1)
        split = use[total[use] > hot]
        use = use[total[use] <= hot]
        key, place, start, n = ([x[use], x[split]] for x in (key, place, start, n))
        if len(split):  # each window by itself, under its own hash
            offset = np.arange(int(n[1].sum())) - np.repeat(np.cumsum(n[1]) - n[1], n[1])
            start[1], place[1] = np.repeat(start[1], n[1]) + offset, np.repeat(place[1], n[1])
            n[1] = np.ones(len(start[1]), np.int64)
            key[1] = span_hash(prefix, start[1], start[1] + length)
        key, place, start, n = (np.concatenate(x) for x in (key, place, start, n))
        whole = span_hash(prefix, start, start + n - 1 + length)
        del prefix, total
        at = start + lo
        idx = np.searchsorted(off, at, side="right") - 1
        rows = np.empty((len(key), 8), np.uint64)
        for column, values in ((_KEY, key), (_WHOLE, whole), (_DOC, ordinal(ids[idx])), (_IDX, idx), (_START, at - off[idx]), (_N, n), (_REL, place - start), (_AT, at)):
            rows[:, column] = values
        del key, place, start, n, whole, at, idx
        rows, marks = _first_ones(data, rows, length)
        parts.append(rows)
        gone.append(marks)
    t, marks = _first_ones(data, np.concatenate(parts), length)
    marks = _joined(np.concatenate([*gone, marks]))
    columns = {"key": t[:, _KEY], "doc": t[:, _DOC], "idx": t[:, _IDX], "start": t[:, _START], "n": t[:, _N], "rel": t[:, _REL]}
    size = t[:, _N].astype(np.int64) - 1 + length
    return Stretches(columns, gather(data, t[:, _AT].astype(np.int64), size)), marks


def _rank_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)[1].astype(np.uint64)


def later_windows(text: np.ndarray, begin: np.ndarray, key: np.ndarray, n: np.ndarray, rel: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of a chunk's windows (stretch after stretch), those that equal an earlier one; stretches are in order inside a key."""
    if length != 96 + STEP:
        raise ValueError("ranks of samples are set out for strings of 100 bytes")
    size = n - 1 + length
    # Cover samples: every STEP-th byte, counted from the anchor.
    lead = rel % STEP
    samples = (size - lead) // STEP
    base = np.cumsum(samples) - samples
    place = np.repeat(begin + lead, samples) + STEP * (np.arange(int(samples.sum())) - np.repeat(base, samples))
    word = np.zeros(len(place), np.uint64)
    for k in range(STEP):
        word = word << np.uint64(8) | text[place + k]

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        """Values some samples on; what runs over a stretch's end is never asked for."""
        return np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])

    r8 = np.unique(word << np.uint64(32) | ahead(word, 1), return_inverse=True)[1].astype(np.uint64)
    r16 = _rank_pairs(r8, ahead(r8, 2))
    r32 = _rank_pairs(r16, ahead(r16, 4))
    r64 = _rank_pairs(r32, ahead(r32, 8))
    # Windows: bytes before the first sample, ranks of 64 and 32 bytes, bytes behind.
    of = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    r = rel[of] - offset
    head = r % STEP
    a = begin[of] + offset
    rest = np.zeros(len(of), np.uint64)
    for k in range(STEP):
        rest = rest << np.uint64(8) | text[a + np.where(k < head, k, length - STEP + k)]
    sample = base[of] + (offset + head - lead[of]) // STEP
    bucket = np.unique(key, return_inverse=True)[1].astype(np.uint64)[of] << np.uint64(7) | r.astype(np.uint64)
    first = r64[sample] << np.uint64(32) | r32[sample + 64 // STEP]
    second = rest << np.uint64(32) | bucket
    order = np.lexsort((second, first))
    same = np.append(False, (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1]))
    out = np.zeros(len(of), bool)
    out[order] = same
    return out


def owner_marks(s: Stretches, length: int = LENGTH) -> np.ndarray:
    """(blk, idx, start, n) of the runs of windows in a key range that start earlier somewhere."""
    c, size = s.c, s.length(length).astype(np.int64)
    begin = np.cumsum(size) - size
    order = np.lexsort((c["start"], c["idx"], c["blk"], c["doc"], c["key"]))
    out = []
    sizes = np.cumsum(size[order])
    i = 0
    while i < len(order):  # a chunk of whole buckets
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + CHUNK_BYTES, side="right")))
        while j < len(order) and c["key"][order[j]] == c["key"][order[j - 1]]:
            j += 1
        own = order[i:j]
        n, rel = c["n"][own].astype(np.int64), c["rel"][own].astype(np.int64)
        text = gather(s.text, begin[own], size[own])
        at = np.cumsum(size[own]) - size[own]
        later = later_windows(text, at, c["key"][own], n, rel, length)
        of = np.repeat(np.arange(len(own)), n)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        hit = np.flatnonzero(later)
        first = np.append(True, (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])) if len(hit) else np.zeros(0, bool)
        runs = np.flatnonzero(first)
        who = own[of[hit[runs]]]
        out.append(np.column_stack([c["blk"][who], c["idx"][who], c["start"][who] + offset[hit[runs]].astype(np.uint64), np.diff(np.append(runs, len(hit))).astype(np.uint64)]))
        i = j
    return np.concatenate(out) if out else np.zeros((0, 4), np.uint64)


def cut(data: np.ndarray, off: np.ndarray, marks: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What stays of a block: bytes, offsets; removed bytes and maximal removed runs of each text."""
    edge = np.zeros(len(data) + 1, np.int32)
    start = off[:-1][marks[:, 0]] + marks[:, 1]
    np.add.at(edge, start, 1)
    np.add.at(edge, start + marks[:, 2] - 1 + length, -1)
    gone = np.cumsum(edge)[: len(data)] > 0
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    border = off[1:-1][off[1:-1] < len(data)]
    first[border] = gone[border]
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
    removed = count(gone)
    return data[~gone], off - np.concatenate([[0], np.cumsum(removed)]), removed, count(first)


_MARKS = "blk long, marks binary"
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _pack_marks(m: np.ndarray) -> bytes:
    return pack_ints(np.ascontiguousarray(m).reshape(-1))


def suffix_dedup(docs: DataFrame, with_text: bool = False, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) for every row of docs(doc_id, text)."""
    blocks = materialise(pack(docs, F.lit(False)).drop("flags"), "suffix-blocks")
    plain = plain_bytes(blocks)

    def keys(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, count = Anchored(*unpack(row["sizes"], row["body"]), length).keys()
        return key, np.zeros(len(key), np.uint64), count

    totals = materialise(totals_by_key(blocks, ["sizes", "body"], keys, max(1, -(-plain // RANGE_BYTES))), "suffix-anchors")
    parts = max(1, -(-plain // PART_BYTES))
    edges = np.array([(k << 64) // parts for k in range(parts)], np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blk, ids, sizes, body, own in zip(*(batch.column(c) for c in ("blk", "doc_ids", "sizes", "body", "answers")), strict=True):
                data, off = unpack(sizes, body)
                found = Anchored(data, off, length)
                asked = found.keys()[0]
                total = np.concatenate([unpack_ints(x["totals"]) for x in own.as_py()]).astype(np.int64)
                number = ids.values.fill_null((1 << 63) - 1).to_numpy()
                s, marks = block_stretches(data, off, number, found, asked, total, length, hot)
                at = np.append(np.searchsorted(s.c["key"], edges), len(s.c["key"]))
                size = s.length(length).astype(np.int64)
                begin = np.concatenate([[0], np.cumsum(size)])
                rows = []
                for k in np.flatnonzero(np.diff(at)).tolist():
                    i, j = int(at[k]), int(at[k + 1])
                    rows.append({"part": k, "blk": blk.as_py()} | Stretches({x: v[i:j] for x, v in s.c.items()}, s.text[begin[i] : begin[j]]).pack())
                if len(marks):  # through the same exchange, as they are
                    rows.append({"part": -1 - blk.as_py(), "blk": blk.as_py(), "body": _pack_marks(marks)})
                del found, asked, total, s
                trim()
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int64()), ("blk", pa.int64()), *((x, pa.binary()) for x in ("key", "doc", "idx", "start", "n", "rel", "body"))]))

    def own(table: pa.Table) -> pa.Table:
        import zstandard

        if table.column("part")[0].as_py() < 0:
            return pa.table({"blk": table.column("blk"), "marks": table.column("body")})
        columns: dict[str, list] = {k: [] for k in Stretches.COLUMNS}
        texts = []
        for row in table.to_pylist():
            columns["key"].append(unpack_sorted(row["key"]))
            for k in ("doc", "idx", "start", "n", "rel"):
                columns[k].append(unpack_ints(row[k]))
            columns["blk"].append(np.full(len(columns["key"][-1]), row["blk"], np.uint64))
            texts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8))
        marks = owner_marks(Stretches({k: np.concatenate(v) for k, v in columns.items()}, np.concatenate(texts)), length)
        del columns, texts
        trim()
        marks = marks[np.argsort(marks[:, 0], kind="stable")]
        blk, first = np.unique(marks[:, 0], return_index=True)
        bounds = np.append(first, len(marks))
        return pa.table({"blk": pa.array(blk.astype(np.int64)), "marks": pa.array([_pack_marks(marks[i:j, 1:]) for i, j in zip(bounds, bounds[1:], strict=False)], pa.binary())})

    sent = blocks.join(answers(totals), "blk").select("blk", "doc_ids", "sizes", "body", "answers").mapInArrow(send, "part long, blk long, key binary, doc binary, idx binary, start binary, n binary, rel binary, body binary")
    marks = sent.groupBy("part").applyInArrow(own, _MARKS).groupBy("blk").agg(F.collect_list("marks").alias("marks"))
    marks = materialise(marks, "suffix-marks")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, body, own in zip(*(batch.column(c) for c in ("doc_ids", "sizes", "body", "marks")), strict=True):
                data, off = unpack(sizes, body)
                m = np.concatenate([np.zeros(0, np.uint64), *(unpack_ints(x) for x in own.as_py() or [])]).astype(np.int64).reshape(-1, 3)
                left, at, removed, spans = cut(data, off, m, length)
                raw = left.tobytes()
                texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                kept = pa.array(texts if with_text else [None] * len(texts), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(np.diff(off)), pa.array(removed), pa.array(spans), kept, pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    out = blocks.join(marks, "blk", "left").select("doc_ids", "sizes", "body", "marks").mapInArrow(finish, _OUT)
    return out if with_text else out.drop("kept")
