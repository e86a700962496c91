"""Language-model scores by a probabilistic suffix tree.

Texts are token sequences (words with A-Z lower-cased, then one end) spelled out
in bytes: words, a space between two, a line feed at the end.  Contexts are the
last 0 to DEPTH bytes, from end marks before the text on.  A context is a candidate from MIN_COUNT
occurrences on, whatever the size of the corpus.  It is retained if its next-symbol distribution diverges
from its parent's (count times divergence of MIN_GAIN nats or more), or one of its
extensions is; candidates of up to TOP bytes, of which there are at most 65,792, always are.
Distributions are smoothed by the parent's with weight WEIGHT.
Scoring takes, at each symbol, the longest suffix that is a retained state.

The tree grows with the corpus, so it is never in one place.  Windows are keyed by their contexts, the nearest
byte first, so a range of keys holds whole subtrees below TOP bytes.  Blocks of documents send their distinct
windows with training counts to the ranges; a range builds its part of the tree from all of them and answers
each block with log10 probabilities (32-bit floats).  Counts up to TOP bytes are broadcast, at most 256**3 by the alphabet.

Counts cover all training texts.  Word counts, for the base score, are never
gathered in one place: blocks of documents ask for their distinct words by key range.
A word of less than 16 bytes is its own key, a longer one takes 120 bits of a cryptographic digest.

Null and empty texts are one end token.  Repeated rows are scored each.  Without
training texts every next byte has the same probability.  A null doc_id is
kept as null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import answers, distinct_keys, pack, pack_ints, pack_sorted, plain_bytes, totals_by_key, unpack, unpack_ints, unpack_sorted
from .common import LOWER_AZ, distinct_spans, materialise, span_keys, sub_blocks, trim, word_spans

#: Bytes of the longest context, with the next symbol less than 8.
DEPTH = 6
#: Least count of a context.
MIN_COUNT = 4
#: Bytes of the contexts whose counts every range of keys has; ranges hold whole contexts of one byte more.
TOP = 2
#: Least count times divergence (nats) from the parent.
MIN_GAIN = 4.0
#: Weight of the parent's distribution, in symbols.
WEIGHT = 6.0
#: Bytes of distinct words that one task sums up, about.
RANGE_BYTES = 32 << 20
#: Bytes of text whose distinct windows one task sums up, about; and windows of one numpy pass of it.
WINDOW_BYTES, PASS_WINDOWS = 16 << 20, 1_000_000

#: Distinct windows that a task adds up before it passes them on.
MERGED_WINDOWS = 2_000_000

#: Key of the end token; no word has its check, 0.
END = np.uint64(0x9C8B7A6958473625)
_SPACE, _LF = 0x20, 0x0A


@dataclass
class Tree:
    """Retained contexts by length: keys, weight of the parent, and next symbols with log10 probabilities."""

    root: np.ndarray
    contexts: list[tuple[np.ndarray, np.ndarray]]
    symbols: list[tuple[np.ndarray, np.ndarray]]
    depth: int

    def score(self, windows: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each window after those before it."""
        out = self.root[(windows & np.uint64(255)).astype(np.int64)].copy()
        backed = np.zeros(len(windows))
        left = np.arange(len(windows))
        for d in range(self.depth, 0, -1):
            keys, weights = self.contexts[d]
            if not len(keys) or not len(left):
                continue
            w = windows[left] & np.uint64((1 << 8 * (d + 1)) - 1)
            i = np.minimum(np.searchsorted(keys, w >> np.uint64(8)), len(keys) - 1)
            state = keys[i] == w >> np.uint64(8)
            pairs, logs = self.symbols[d]
            k = np.minimum(np.searchsorted(pairs, w), len(pairs) - 1)
            seen = state & (pairs[k] == w)
            out[left[seen]] = logs[k[seen]]
            unseen = state & ~seen
            backed[left[unseen]] += weights[i[unseen]]
            left = left[~seen]
        return out + backed


def spelled(data: np.ndarray, off: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Bytes of all texts with `depth` end marks before each; where each text's symbols begin and end; its words."""
    n = len(off) - 1
    data = LOWER_AZ[data]
    starts, ends, doc = word_spans(data, off)
    sizes = ends - starts
    words = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    letters = np.bincount(doc, weights=sizes, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
    length = letters + np.maximum(words, 1)
    first = np.concatenate([[0], np.cumsum(length + depth)])[:n] + depth
    out = np.full(int((length + depth).sum()), _LF, np.uint8)
    if len(doc):
        before = np.concatenate([[0], np.cumsum(sizes)])
        word_no = np.arange(len(doc)) - (np.cumsum(words) - words)[doc]
        at = first[doc] + before[:-1] - (np.cumsum(letters) - letters)[doc] + word_no
        source = np.arange(before[-1]) + np.repeat(starts - before[:-1], sizes)
        out[np.arange(before[-1]) + np.repeat(at - before[:-1], sizes)] = data[source]
        inner = word_no < words[doc] - 1
        out[(at + sizes)[inner]] = _SPACE
    return out, np.column_stack([first, first + length]), (data, starts, ends, doc)


def windows(text: np.ndarray, bounds: np.ndarray, depth: int, nearest: bool = False) -> np.ndarray:
    """For every symbol of the bounds, it (in the last byte) and the `depth` bytes before it, in order or the nearest first."""
    if not len(text):
        return np.zeros(0, np.uint64)
    w = np.zeros(len(text) - depth, np.uint64)
    for k in [*(reversed(range(depth)) if nearest else range(depth)), depth]:
        w = w << np.uint64(8) | text[k : len(text) - depth + k]
    use = np.zeros(len(text) + 1, np.int8)
    np.add.at(use, bounds[:, 0], 1)
    np.add.at(use, bounds[:, 1], -1)
    return w[np.cumsum(use)[depth:-1] > 0]


def block_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct tokens of a block (keys, checks), ends included; and which of them and of which document each token is (in no order)."""
    n = len(off) - 1
    keys, which, docs, seen = [(np.array([END]), np.zeros(1, np.uint64))], [np.zeros(n, np.int64)], [np.arange(n)], 1
    for i, j in sub_blocks(off):
        part = LOWER_AZ[data[off[i] : off[j]]]
        starts, ends, doc = word_spans(part, off[i : j + 1] - off[i])
        if len(starts):
            first, own = distinct_spans(part, starts, ends)
            keys.append(span_keys(part, starts[first], ends[first]))
            which.append(own + seen)
            docs.append(doc + i)
            seen += len(first)
    key, check, place = distinct_keys(*(np.concatenate(x) for x in zip(*keys, strict=True)))
    return key, check, place[np.concatenate(which)], np.concatenate(docs)


def count_words(blocks: DataFrame, ranges: int) -> DataFrame:
    """blk, part, totals: training counts of each block's distinct words, in order of their keys; and n, v of each range in a row without blk."""

    def words(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, off = unpack(row["sizes"], row["body"])
        key, check, inverse, doc = block_tokens(data, off)
        train = ~np.array(row["flags"].as_py(), bool)
        return key, check, np.bincount(inverse, weights=train[doc], minlength=len(key)).astype(np.int64)

    return materialise(totals_by_key(blocks, ["flags", "sizes", "body"], words, ranges), "word-totals")


def count_windows(blocks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """w, n: how often each window of depth+1 bytes occurs in training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["w", "n"])

        for batch in batches:
            for flags, sizes, body in zip(*(batch.column(c) for c in ("flags", "sizes", "body")), strict=True):
                data, off = unpack(sizes, body)
                train = ~np.array(flags.as_py(), bool)
                for i, j in sub_blocks(off):
                    text, bounds, _ = spelled(data[off[i] : off[j]], off[i : j + 1] - off[i], depth)
                    k, c = np.unique(windows(text, bounds[train[i:j]], depth), return_counts=True)
                    both, inverse = np.unique(np.concatenate([key, k]), return_inverse=True)
                    key, n = both, np.bincount(inverse, weights=np.concatenate([n, c]), minlength=len(both)).astype(np.int64)
                    if len(key) > MERGED_WINDOWS:
                        yield out()
                        key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield out()

    return materialise(blocks.select("flags", "sizes", "body").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "windows")


def build_tree(counts: DataFrame, depth: int = DEPTH, min_share: float = 0.0, min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN, weight: float = WEIGHT, always: int = 0) -> Tree:
    """The tree of windows counts(w, n) in one place, for corpora whose contexts fit there; candidates of up to `always` bytes are retained."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(min_count, min_share * total)
    level = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    pairs = counts.select("w", "n", level.alias("d"))
    pairs = pairs.withColumn("w", F.expr("w & (shiftleft(1L, 8 * (d + 1)) - 1)")).groupBy("d", "w").agg(F.sum("n").alias("n"))
    sums = pairs.groupBy("d", F.shiftright("w", 8).alias("c")).agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    kept = pairs.withColumn("c", F.shiftright("w", 8)).join(sums.select("d", "c"), ["d", "c"], "left_semi").select(F.col("d").cast("byte"), "w", "n")
    got = kept.toArrow()
    d, w, n = (got.column(k).to_numpy() for k in ("d", "w", "n"))
    w = w.view(np.uint64) if len(w) else np.zeros(0, np.uint64)
    root = np.full(256, 0.5)
    root[(w[d == 0] & np.uint64(255)).astype(np.int64)] += n[d == 0]
    root = root / root.sum()
    none = (np.zeros(0, np.uint64), np.zeros(0))
    table: list[tuple] = [(np.arange(256, dtype=np.uint64), root)]
    gains: list[tuple] = [none]
    totals: list = [None]
    for k in range(1, depth + 1):
        own = d == k
        order = np.argsort(w[own])
        key, count = w[own][order], n[own][order]
        if not len(key):
            table.append(none), gains.append(none), totals.append(np.zeros(0))
            continue
        upper_keys, upper = table[k - 1]
        parent = upper[np.searchsorted(upper_keys, key & np.uint64((1 << 8 * k) - 1))]
        context = key >> np.uint64(8)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        sum_ = np.repeat(np.add.reduceat(count, first), np.diff(np.append(first, len(key))))
        p = (count + weight * parent) / (sum_ + weight)
        gain = np.add.reduceat(p * np.log(p / parent), first) * sum_[first]
        table.append((key, p)), gains.append((context[first], gain)), totals.append(sum_[first])
    keep: list = [np.zeros(0, bool)] * (depth + 1)
    for k in range(depth, 0, -1):
        keys, gain = gains[k]
        keep[k] = (gain >= min_gain) | (k <= always)
        if k < depth and len(gains[k + 1][0]):
            longer = gains[k + 1][0][keep[k + 1]] & np.uint64((1 << 8 * k) - 1)
            keep[k] |= np.isin(keys, longer)
    contexts, symbols = [none], [none]
    for k in range(1, depth + 1):
        keys = gains[k][0][keep[k]]
        contexts.append((keys, np.log10(weight / (totals[k][keep[k]] + weight)) if len(keys) else np.zeros(0)))
        pair, p = table[k]
        use = np.isin(pair >> np.uint64(8), keys)
        symbols.append((pair[use], np.log10(p[use])))
    return Tree(np.log10(root), contexts, symbols, depth)


def score_texts(tree: Tree, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    out = np.zeros(len(off) - 1)
    for i, j in sub_blocks(off):
        text, bounds, _ = spelled(data[off[i] : off[j]], off[i : j + 1] - off[i], tree.depth)
        distinct, inverse = np.unique(windows(text, bounds, tree.depth), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(bounds[:, 1] - bounds[:, 0])[:-1]])
        out[i:j] = np.add.reduceat(tree.score(distinct)[inverse], first)
    return out


@dataclass
class Top:
    """Counts and probabilities of contexts of up to TOP bytes, nearest byte first."""

    one: np.ndarray  # probability by context and symbol
    two: np.ndarray  # count by context
    pairs: np.ndarray  # context and symbol, sorted
    counts: np.ndarray
    least: int
    weight: float

    def probability(self, keys: np.ndarray, depth: int) -> np.ndarray:
        """Probability of the last byte of each window after the TOP bytes nearest to it."""
        symbol = keys & np.uint64(255)
        context = keys >> np.uint64(8 * (depth - 1))
        pair = context << np.uint64(8) | symbol
        p = self.one[(context >> np.uint64(8)).astype(np.int64), symbol.astype(np.int64)]
        if not len(self.pairs):
            return p
        i = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        n = self.two[context.astype(np.int64)]
        return np.where(n >= self.least, (np.where(self.pairs[i] == pair, self.counts[i], 0) + self.weight * p) / (n + self.weight), p)


def count_top(blocks: DataFrame) -> DataFrame:
    """w, n, m: training count of each window of TOP+1 bytes, nearest byte first, and about how many longer windows hold it as context."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.uint64), np.zeros((0, 2))
        for batch in batches:
            for flags, sizes, body in zip(*(batch.column(c) for c in ("flags", "sizes", "body")), strict=True):
                data, off = unpack(sizes, body)
                train = ~np.array(flags.as_py(), bool)
                for i, j in sub_blocks(off):
                    text, bounds, _ = spelled(data[off[i] : off[j]], off[i : j + 1] - off[i], TOP)
                    every, m = np.unique(windows(text, bounds, TOP, True), return_counts=True)
                    own, c = np.unique(windows(text, bounds[train[i:j]], TOP, True), return_counts=True)
                    add = np.zeros((len(every), 2))
                    add[np.searchsorted(every, own), 0], add[:, 1] = c, np.ceil(m**0.75)
                    both, inverse = np.unique(np.concatenate([key, every]), return_inverse=True)
                    old = np.concatenate([n, add])
                    key, n = both, np.column_stack([np.bincount(inverse, weights=old[:, k], minlength=len(both)) for k in (0, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(n[:, k].astype(np.int64)) for k in (0, 1))], ["w", "n", "m"])

    return blocks.select("flags", "sizes", "body").mapInArrow(count, "w long, n long, m long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def top_and_edges(counts: DataFrame, parts: int, depth: int, min_count: int, weight: float) -> tuple[Top, np.ndarray]:
    """The upper tree of counts(w, n, m), and the first keys of so many ranges at most."""
    got = counts.orderBy("w").toArrow()
    k, n, m = (got.column(c).to_numpy().astype(np.int64) for c in ("w", "n", "m"))
    one = np.bincount(k >> 16 << 8 | k & 255, weights=n, minlength=1 << 16).reshape(256, 256)
    root = one.sum(0) + 0.5
    root = root / root.sum()
    total = one.sum(1, keepdims=True)
    one = np.where(total >= min_count, (one + weight * root) / (total + weight), root)
    top = Top(one, np.bincount(k >> 8, weights=n, minlength=1 << 16), k.astype(np.uint64), n, min_count, weight)
    cell = (k & 255) << 16 | k >> 16 << 8 | k >> 8 & 255  # the window as a context, nearest byte first
    order = np.argsort(cell)
    until = np.cumsum(m[order])
    first = cell[order][np.searchsorted(until, until[-1] * np.arange(1, parts) // parts)] if len(k) else cell
    return top, np.unique(np.append(0, first)).astype(np.uint64) << np.uint64(8 * (depth - TOP))


def state_scores(keys: np.ndarray, n: np.ndarray, top: Top, depth: int, min_gain: float) -> np.ndarray:
    """log10 probability of each of the sorted distinct windows, which have all extensions of their contexts of TOP+1 bytes among them."""
    symbol = keys & np.uint64(255)
    upper = out = top.probability(keys, depth)
    levels = []
    for d in range(TOP + 1, depth + 1):
        context = keys >> np.uint64(8 * (depth - d + 1))
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        sizes = np.diff(np.append(first, len(keys)))
        sums = np.add.reduceat(n, first)
        total = np.repeat(sums, sizes)
        once, count = np.ones(len(keys), bool), n
        if d < depth:
            _, index, inverse = np.unique(context << np.uint64(8) | symbol, return_index=True, return_inverse=True)
            once[:] = False
            once[index] = True
            count = np.bincount(inverse, weights=n)[inverse]
        p = np.where(total >= top.least, (count + top.weight * upper) / (total + top.weight), upper)
        gain = np.add.reduceat(np.where(once & (count > 0), p * np.log(p / upper), 0.0), first) * sums
        levels.append((p, first, sizes, (gain >= min_gain) & (sums >= top.least)))
        upper = p
    for (_, first, _, keep), (_, _, sizes, longer) in zip(levels[-2::-1], levels[:0:-1], strict=True):
        keep |= np.logical_or.reduceat(np.repeat(longer, sizes), first)
    for p, _, sizes, keep in levels:
        out = np.where(np.repeat(keep, sizes), p, out)
    return np.log10(out)


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """np.unique(), which hashes, by a sort: many times faster for 64-bit numbers."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def block_windows(data: np.ndarray, off: np.ndarray, depth: int) -> Iterator[tuple]:
    """Windows (nearest byte first) of each sub-block, where its texts' symbols begin and end among them, its first and last text."""
    for i, j in sub_blocks(off):
        text, bounds, _ = spelled(data[off[i] : off[j]], off[i : j + 1] - off[i], depth)
        yield windows(text, bounds, depth, True), bounds, i, j, text


def window_scores(blocks: DataFrame, parts: int, depth: int = DEPTH, min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN, weight: float = WEIGHT) -> DataFrame:
    """blk, part, totals: 32-bit log10 probabilities of each block's distinct windows, in order of their keys."""
    top, edges = top_and_edges(count_top(blocks), parts, depth, min_count, weight)
    shared = blocks.sparkSession.sparkContext.broadcast(top)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blk, flags, sizes, body in zip(*(batch.column(c) for c in ("blk", "flags", "sizes", "body")), strict=True):
                data, off = unpack(sizes, body)
                train = ~np.array(flags.as_py(), bool)
                key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                for every, bounds, i, j, text in block_windows(data, off, depth):
                    own, c = np.unique(windows(text, bounds[train[i:j]], depth, True), return_counts=True)
                    other = sorted_distinct(windows(text, bounds[~train[i:j]], depth, True))
                    both, inverse = np.unique(np.concatenate([key, own, other]), return_inverse=True)
                    key, n = both, np.bincount(inverse, weights=np.concatenate([n, c, np.zeros(len(other))]), minlength=len(both)).astype(np.int64)
                    del every, own, other, inverse
                cut = np.append(np.searchsorted(key, edges), len(key))
                some = np.flatnonzero(np.diff(cut)).tolist()
                keys = pa.array([pack_sorted(key[cut[k] : cut[k + 1]]) for k in some], pa.binary())
                counts = pa.array([pack_ints(n[cut[k] : cut[k + 1]]) for k in some], pa.binary())
                del key, n
                trim()
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([blk.as_py()] * len(some), pa.int64()), keys, counts], ["part", "blk", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        key, n, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            both, inverse = np.unique(np.concatenate([key, *(k for k, _ in waiting)]), return_inverse=True)
            return both, np.bincount(inverse, weights=np.concatenate([n, *(c for _, c in waiting)]), minlength=len(both)).astype(np.int64)

        for keys, counts in zip(table.column("keys"), table.column("counts"), strict=True):
            waiting.append((unpack_sorted(keys.as_py()), unpack_ints(counts.as_py()).astype(np.int64)))
            if sum(len(k) for k, _ in waiting) > max(PASS_WINDOWS, len(key)):
                key, n = merged()
                waiting = []
        key, n = merged()
        waiting = []
        cell = key >> np.uint64(8 * (depth - TOP))
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        starts = np.append(starts[np.append(True, np.diff(starts // PASS_WINDOWS) > 0)], len(key))
        score = np.concatenate([state_scores(key[a:b], n[a:b], shared.value, depth, min_gain).astype(np.float32) for a, b in zip(starts, starts[1:], strict=False)])
        del n, cell
        packed = [pack_ints(score[np.searchsorted(key, unpack_sorted(x.as_py()))].view(np.uint32)) for x in table.column("keys")]
        del key, score
        trim()
        return pa.table({"blk": table.column("blk"), "part": table.column("part"), "totals": pa.array(packed, pa.binary())})

    asked = blocks.select("blk", "flags", "sizes", "body").mapInArrow(ask, "part long, blk long, keys binary, counts binary")
    return asked.groupBy("part").applyInArrow(answer, "blk long, part long, totals binary")


def block_scores(scores: np.ndarray, data: np.ndarray, off: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """log10 probability of each text of a block, by those of its distinct windows."""
    parts = []
    for every, bounds, i, j, _ in block_windows(data, off, depth):
        distinct, inverse = np.unique(every, return_inverse=True)
        parts.append((distinct, inverse.astype(np.int32), np.concatenate([[0], np.cumsum(bounds[:, 1] - bounds[:, 0])[:-1]]), i, j))
    keys = sorted_distinct(np.concatenate([p[0] for p in parts]))
    out = np.zeros(len(off) - 1)
    for distinct, inverse, first, i, j in parts:
        out[i:j] = np.add.reduceat(scores[np.searchsorted(keys, distinct)].astype(np.float64)[inverse], first)
    return out


def language_model_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs(doc_id, text)."""
    blocks = materialise(pack(docs, held_out), "lm-blocks")
    size = plain_bytes(blocks)
    totals = count_words(blocks, max(1, -(-size // RANGE_BYTES)))
    n, v = (x or 0 for x in totals.where("blk is null").agg(F.sum("n"), F.sum("v")).first())
    scores = window_scores(blocks, max(1, -(-size // WINDOW_BYTES)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, flags, sizes, body, own, log in zip(*(batch.column(c) for c in ("doc_ids", "flags", "sizes", "body", "answers", "scores")), strict=True):
                data, off = unpack(sizes, body)
                _, _, inverse, doc = block_tokens(data, off)
                c = np.concatenate([unpack_ints(x["totals"]) for x in own.as_py()]).astype(np.int64)[inverse]
                m = len(off) - 1
                base = np.bincount(doc, weights=np.log10((c + 0.5) / (n + 0.5 * (v + 1))), minlength=m)
                each = np.concatenate([unpack_ints(x["totals"]) for x in log.as_py()]).astype(np.uint32).view(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, flags.values, pa.array(np.bincount(doc, minlength=m)), pa.array(np.bincount(doc, weights=c > 0, minlength=m).astype(np.int64)), pa.array(np.full(m, n, np.int64)), pa.array(base), pa.array(block_scores(each, data, off))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    joined = blocks.join(answers(totals), "blk").join(answers(scores).withColumnRenamed("answers", "scores"), "blk").select("doc_ids", "flags", "sizes", "body", "answers", "scores")
    return joined.mapInArrow(work, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
