"""All runs (maximal repetitions) of the words of each text, and texts without what they repeat.

A run is a stretch of words with a smallest period q, at least two periods long, that no
neighbouring word extends.  Per block of texts: a suffix array and its LCP array give
the longest previous factor of every word, these the LZ factors of each text.  A run that
touches the start of a factor is found there by Main's extensions to both sides; one
strictly inside a factor is a copy of an earlier run, and is taken from the bucket of
runs by start behind the factor's source.  The ranks of prefix doubling stay as tables, so that
common extensions of any two places are exact and need no hash.

Runs never cross texts, so a text's result doesn't depend on its block: blocks only
bound memory (a longer text stands alone, in some 100 bytes a word).  Null and empty
texts have no words and no runs; rows that repeat, or have no doc_id, are rows like all
others; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_spans, gather, in_batches, sub_blocks, text_bytes, trim, word_spans

#: A run has at least so many words, if not told otherwise.
MIN_WORDS = 12

#: Words of more bytes are told apart one by one, others by blocks of so many bytes.
LONG_WORD, WORD_BLOCK = 1 << 16, 4 << 20

#: Pairs of places that are extended at once.
PAIRS = 1 << 20

#: From so many words on only every second table of ranks is kept.
THIN = 1 << 21

#: Rounds of pointer jumping before the rest is walked one by one.
JUMPS = 16

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for the same bytes."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.int32)
    if len(data) <= WORD_BLOCK and sizes.max() <= LONG_WORD:
        return distinct_spans(data, starts, ends)[1].astype(np.int32)
    out, known = np.empty(len(sizes), np.int32), {}
    long = np.flatnonzero(sizes > LONG_WORD)
    for k in long.tolist():
        out[k] = known.setdefault(data[starts[k] : ends[k]].tobytes(), len(known))
    short, i = np.flatnonzero(sizes <= LONG_WORD), 0
    while i < len(short):
        low = int(starts[short[i]])
        j = max(i + 1, int(np.searchsorted(ends[short], low + WORD_BLOCK, side="right")))
        part = short[i:j]
        a, b = starts[part] - low, ends[part] - low
        first, which = distinct_spans(data[low : ends[part[-1]]], a, b)
        names = np.array([known.setdefault(data[low + x : low + y].tobytes(), len(known)) for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True)], np.int32)
        out[part] = names[which]
        i = j
    return out


class Extensions:
    """Suffix order of the words of several texts, and common extensions of two places of one text."""

    def __init__(self, word: np.ndarray, text: np.ndarray):
        n = self.n = len(word)
        key = text.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        head = np.append(True, key[1:] != key[:-1])[:n]
        del key
        self.tables: list[tuple[int, np.ndarray, int]] = []  # length, ranks, times that it may be taken
        rank = np.full(n + 1, -1, np.int32)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
        length = 1
        while True:
            # Equal ranks: the same so many words, within one text (two places cross its end at different words).
            slots = np.flatnonzero(~(head & np.append(head[1:], True))).astype(np.int32)
            if not len(slots):
                break
            if n < THIN or length.bit_length() & 1 or length == 2:
                self.tables.append((length, rank, 1))
            held = order[slots]
            after = rank[np.minimum(held + length, n)].astype(np.int64) + 1
            by = np.argsort(rank[held].astype(np.int64) * (n + 1) + after, kind="stable")
            held, after = held[by], after[by]
            old = rank[held]
            new = np.append(True, (old[1:] != old[:-1]) | (after[1:] != after[:-1]))
            order[slots], head[slots] = held, new
            rank = rank.copy()
            rank[held] = np.maximum.accumulate(np.where(new, slots, 0))
            length *= 2
        lengths = [*(x[0] for x in self.tables), length]
        self.tables = [(a, r, b // a - 1) for (a, r, _), b in zip(self.tables, lengths[1:], strict=True)]
        self.order = order

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and from j on; i is not j."""
        got = np.zeros(len(i), np.int32)
        for length, rank, times in reversed(self.tables):
            for _ in range(times):
                got[rank[i + got] == rank[j + got]] += length
        return got

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words before i and before j, i < j."""
        got = np.zeros(len(i), np.int32)
        for length, rank, times in reversed(self.tables):
            for _ in range(times):
                a = i - got - length
                got[(a >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(j - got - length, 0)])] += length
        return got


def _smaller_before(place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank the place of the nearest rank before it with a smaller place, and the least LCP between (0: none)."""
    to, low = np.arange(-1, len(place) - 1, dtype=np.int32), lcp.copy()
    open_ = np.flatnonzero((low > 0) & (place[to] > place)).astype(np.int32)
    for _ in range(JUMPS):
        if not len(open_):
            break
        via = to[open_]
        low[open_], to[open_] = np.minimum(low[open_], low[via]), to[via]
        open_ = open_[(low[open_] > 0) & (place[to[open_]] > place[open_])]
    if len(open_):  # long chains: in order, so that each element is passed once
        p, t, m = memoryview(place), memoryview(to), memoryview(low)
        for r in open_.tolist():
            at, least, own = r - 1, int(lcp[r]), p[r]
            while least > 0 and p[at] > own:
                least, at = min(least, m[at]), t[at]
            t[r], m[r] = at, least
    return place[to], low


def longest_previous(ext: Extensions) -> tuple[np.ndarray, np.ndarray]:
    """LPF: the longest stretch from each place on that also begins earlier in its text, and where."""
    order, n = ext.order, ext.n
    lcp = np.zeros(n, np.int32)
    if n > 1:
        lcp[1:] = ext.forward(order[:-1], order[1:])
    length, source = np.zeros(n, np.int32), np.zeros(n, np.int32)
    left, low = _smaller_before(order, lcp)
    length[order], source[order] = low, left
    back = np.append(np.int32(0), lcp[:0:-1])[:n]
    right, low = _smaller_before(np.ascontiguousarray(order[::-1]), back)
    right, low = right[::-1], low[::-1]
    more = low > length[order]
    length[order[more]], source[order[more]] = low[more], right[more]
    return length, source


def _factors(length: np.ndarray) -> np.ndarray:
    """Starts of the greedy factors; no factor crosses texts."""
    step, out, i = memoryview(np.maximum(length, 1)), [], 0
    while i < len(length):
        out.append(i)
        i += step[i]
    return np.array(out, np.int64)


def _touching(ext: Extensions, at: np.ndarray, own: np.ndarray, before: np.ndarray, room: np.ndarray, least: int) -> np.ndarray:
    """Runs (start, end, period) that touch the places at: those of factors of own words behind a factor of so many.

    A run whose last factor start is at has a period of own words at most, to be
    seen from at on, or of own + before words at most, to be seen before at (room: words of its text there).
    """
    counts = np.stack([own, np.minimum(own + before, room)], 1).reshape(-1)
    cum = np.cumsum(counts)
    # Of a run of 5 words and more, two words at least match on one side.
    two, found = next((r for a, r, _ in ext.tables if a == 2), None), []
    if two is None and least >= 5:
        return np.zeros((0, 3), np.int32)
    for low in range(0, int(cum[-1]) if len(cum) else 0, PAIRS):
        k = np.arange(low, min(low + PAIRS, int(cum[-1])))
        f = np.searchsorted(cum, k, side="right")
        p = (k - cum[f] + counts[f] + 1).astype(np.int32)
        x = (at[f >> 1] - p * (f & 1)).astype(np.int32)
        y = x + p
        if least >= 5:
            a, b = np.maximum(x - 2, 0), np.maximum(y - 2, 0)
            some = np.flatnonzero((two[x] == two[y]) | (two[a] == two[b]) & (x >= 2))
            x, y, p = x[some], y[some], p[some]
        right, left = ext.forward(x, y), ext.backward(x, y)
        ok = right + left >= np.maximum(p, least - p)
        runs = np.stack([x[ok] - left[ok], y[ok] + right[ok], p[ok]], 1)
        found.append(_smallest(runs))
    return _smallest(np.concatenate(found)) if found else np.zeros((0, 3), np.int32)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of each stretch the smallest period: larger ones are its multiples."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if not len(runs):
        return runs
    return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1))]


def _copied(runs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sources: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs, those that touch factor starts first given: factors in order take the runs strictly inside their sources."""
    bucket: dict[int, list[tuple[int, int]]] = {}
    for s, e, p in runs.tolist():
        bucket.setdefault(s, []).append((e, p))
    keys = sorted(bucket)
    for b, size, source in zip(starts.tolist(), lengths.tolist(), sources.tolist(), strict=True):
        k, shift, end = bisect_right(keys, source), b - source, source + size
        while k < len(keys) and keys[k] < end:
            s = keys[k]
            for e, p in bucket[s]:
                if e < end:
                    if s + shift not in bucket:
                        insort(keys, s + shift)
                        bucket[s + shift] = []
                    bucket[s + shift].append((e + shift, p))
            k += 1
    return [(s, e, p) for s in keys for e, p in sorted(bucket[s], key=lambda x: x[1])]


def all_runs(word: np.ndarray, bounds: np.ndarray, least: int = MIN_WORDS) -> np.ndarray:
    """start, end, period of every run of at least so many words, by start and period; texts are word[bounds[t] : bounds[t + 1]]."""
    n = len(word)
    if n < least:
        return np.zeros((0, 3), np.int64)
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    ext = Extensions(word, text)
    length, source = longest_previous(ext)
    starts = _factors(length)
    # The ends of texts count as starts of empty factors.
    ends = np.unique(bounds[1:][np.diff(bounds) > 0])
    at = np.concatenate([starts, ends])
    own = np.concatenate([np.maximum(length[starts], 1), np.zeros(len(ends), np.int32)]).astype(np.int64)
    kind = np.concatenate([np.ones(len(starts), np.int8), np.zeros(len(ends), np.int8)])
    order = np.lexsort((kind, at))  # the end of one text before the start of the next
    at, own, kind = at[order], own[order], kind[order]
    home = text[np.where(kind == 1, np.minimum(at, n - 1), at - 1)]
    room = at - bounds[home]
    before = np.append(0, own[:-1])
    before[room == 0] = 0
    runs = _touching(ext, at, own, before, room, least)
    long = starts[length[starts] >= least + 2]
    return np.array(_copied(runs, long, length[long], source[long]), np.int64).reshape(-1, 3)


def _block(data: np.ndarray, off: np.ndarray, ids: pa.Array, least: int, rewrite: Callable | None) -> pa.RecordBatch:
    """One row for each text of the block."""
    starts, ends, text = word_spans(data, off)
    sizes = (ends - starts).astype(np.int32)
    n = len(off) - 1
    bounds = np.searchsorted(text, np.arange(n + 1))
    number = word_numbers(data, starts, ends)
    if rewrite is not None:
        which = np.concatenate([np.zeros(0, np.int64), *(bounds[t] + rewrite(ids[t].as_py(), int(bounds[t + 1] - bounds[t])) for t in range(n))])
        starts, sizes, number = starts[which], sizes[which], number[which]
        del which
    del text, ends
    runs = all_runs(number, bounds, least)
    # Words behind the first period of a run go.
    change = np.zeros(len(number) + 1, np.int32)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    del change, number
    ends = np.cumsum(sizes[keep].astype(np.int64) + 1)
    padded = np.append(data, np.uint8(32))
    body = gather(padded, starts[keep], sizes[keep].astype(np.int64) + 1)
    body[ends - 1] = 32
    cut = np.append(0, ends)[np.searchsorted(keep, bounds)]  # where each text begins; its last space goes
    texts = pa.array([body[a : max(a, b - 1)].tobytes().decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.string())
    home = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    at = np.searchsorted(home, np.arange(n + 1))
    inner = pa.StructArray.from_arrays([pa.array(runs[:, 0] - bounds[home]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(_RUN))
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), inner), texts], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = MIN_WORDS, rewrite: Callable[[int | None, int], np.ndarray] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period) and collapsed text.

    Words are `[^\\x20\\x09-\\x0D]+`.  collapsed holds, joined by single spaces, the words but
    those that a run covers behind its first period.  rewrite(doc_id, n), if given, tells
    for each place of a text of n words which of them stands there.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j in sub_blocks(off):
                yield _block(data[off[i] : off[j]], off[i : j + 1] - off[i], batch.column(0).slice(i, j - i), least, rewrite)
            trim()

    return in_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(work, SCHEMA)
