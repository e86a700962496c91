"""Similarity self-join of texts on word n-grams, by chosen paths.

Words are runs without white space, A-Z lower-cased; a text's set holds its
runs of `words` words (a shorter text has one shingle, of all its words).
Texts with one set make one node; similarity is the sets' Jaccard index.

1. A set is embedded into TOKENS sampled tokens (MinHash values).
2. Chosen paths: each of `runs` runs puts a set into the bucket of one sampled
   token; two sets of similarity t share it with probability t.  Buckets of more than LEAF
   sets split again, on the tokens of the next level, in as many runs.  A bucket
   of which one more token leaves DENSE of it together holds near copies, which
   splitting doesn't part: it stays as it is.  `runs` follows from the target recall:
   a pair at the threshold is lost on a level with (1-t)**runs.
3. Leaves are compared by brute force on the sampled tokens, and give links
   that span what may be similar (LOOSE tokens in common, five deviations below
   the threshold).  A leaf of more than BLOCK sets is dealt out in pairs of
   blocks, so no task holds more than two blocks.
4. Within the groups that these links connect, sets are compared exactly, large
   groups again in pairs of blocks; each pair is looked at once.  Tasks return
   numbers of links and spanning links, never all pairs.

Words and shingles are compared by 64-bit keys (a scramble of the bytes of words of less than 16 bytes, a
cryptographic digest of longer ones), sets by 128 bits and their size.

Null and empty texts have no shingle, no links, and each distinct doc_id is a class of its
own.  Sets are told apart by themselves, not by doc_id, so texts without a doc_id or under one
doc_id keep their links; a class is named after its smallest doc_id, and has the name null only if
none of its texts has one.  Repeated rows are each returned.  An empty table gives an empty
result, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, distinct_spans, fresh, in_batches, materialise, mix64, span_keys, sub_blocks, text_bytes, word_spans
from .components import components

#: Words of a shingle and least similarity.
WORDS, THRESHOLD = 5, 0.8
#: Sampled tokens of a set.
TOKENS = 64
#: Tokens in common (of TOKENS) from which a pair is compared exactly.
LOOSE = 36
#: Least probability that a pair at the threshold survives a level.
RECALL = 0.9999
#: Share of a bucket that one token keeps together if it holds near copies.
DENSE = 0.4
#: Sets of a leaf, levels of a path, sets and shingles of a block.
LEAF, LEVELS, BLOCK, BLOCK_SHINGLES = 256, 3, 2048, 2_000_000

_MULTIPLIERS = mix64(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACES = mix64(np.arange(101, 164, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all strings, and the n+1 offsets."""
    n = len(off) - 1
    data = LOWER_AZ[data]
    starts, ends, doc = word_spans(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    first, which = distinct_spans(data, starts, ends)
    key, check = span_keys(data, starts[first], ends[first])
    w = mix64(key ^ mix64(check))[which]
    h, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(w) >= words:
        h = np.zeros(len(w) - words + 1, np.uint64)
        for k in range(words):
            h += w[k : len(w) - words + 1 + k] * _PLACES[k]
        own = doc[: len(h)]
        full = own == doc[words - 1 :]
        h, own = mix64(h[full]), own[full]
    number = np.bincount(doc, minlength=n)
    short = np.flatnonzero((number > 0) & (number < words))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = number[short] > k
            extra[has] += w[first[has] + k] * _PLACES[k]
        h, own = np.concatenate([h, mix64(extra ^ number[short].astype(np.uint64))]), np.concatenate([own, short])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.searchsorted(own, np.arange(n + 1))


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _digested(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells rows of one doc_id apart."""
    text = F.col("text").cast("string")
    return in_batches(docs).select(F.col("doc_id").cast("long"), text.alias("text"), _digest(text).alias("digest"))


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, digest (of the text), s1, s2 (hash of the set), n (shingles), tokens (sampled, 4 bytes each)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            s1, s2, size, out = [], [], [], []
            for i, j in sub_blocks(off):
                h, at = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], words)
                n = np.diff(at)
                full = np.flatnonzero(n)
                tokens = np.zeros((j - i, TOKENS), np.uint32)
                sums = np.zeros((2, j - i), np.uint64)
                if len(full):
                    for k, m in enumerate(_MULTIPLIERS):
                        tokens[full, k] = np.minimum.reduceat((h * m >> np.uint64(32)).astype(np.uint32), at[full])
                    for k in (0, 1):
                        sums[k, full] = np.add.reduceat(mix64(h ^ _PLACES[40 + k]), at[full])
                s1.append(sums[0]), s2.append(sums[1]), size.append(n), out.append(tokens)
            join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            raw = np.concatenate(out).tobytes() if out else b""
            tokens = pa.Array.from_buffers(pa.binary(4 * TOKENS), len(batch), [None, pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(join(s1, np.uint64).view(np.int64)), pa.array(join(s2, np.uint64).view(np.int64)), pa.array(join(size, np.int64)), tokens], ["doc_id", "digest", "s1", "s2", "n", "tokens"])

    return _digested(docs).mapInArrow(work, "doc_id long, digest long, s1 long, s2 long, n long, tokens binary")


def _token_key(parent, level: int, run: int):
    """Bucket of a set under the sampled token of this level and run."""
    return F.xxhash64(parent, F.lit(level), F.lit(run), F.substring("tokens", 4 * run + 1, 4))


def chosen_paths(nodes: DataFrame, runs: int, leaf: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """leaf, node, size: the leaves of all paths that hold two nodes at least; nodes has (node, tokens)."""
    rows = nodes.select("node", F.lit(0).cast("long").alias("parent"), "tokens")
    leaves = None
    for level in range(levels):
        first = level * runs
        keys = F.array(*(_token_key(F.col("parent"), level, first + r) for r in range(runs)))
        # Written once, for it is counted and joined.
        children = materialise(rows.select("node", F.explode(keys).alias("key")), f"children-{level}")
        sizes = children.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        children = materialise(children.join(sizes, "key"), f"paths-{level}")
        last = level + 1 == levels or (level + 2) * runs > TOKENS - levels
        small = children if last else children.where(F.col("size") <= leaf)
        small = small.select("key", "node", "size")
        leaves = small if leaves is None else leaves.unionAll(small)
        if last:
            break
        parents = children.where(F.col("size") > leaf).select("key", "node", "size")
        if parents.isEmpty():
            break
        rows = parents.join(nodes, "node").select("node", F.col("key").alias("parent"), F.col("size").alias("psize"), "tokens")
        # One token is enough to see which buckets hold near copies; only the others split.
        probe = rows.withColumn("key", _token_key(F.col("parent"), level + 1, TOKENS - 1 - level)).groupBy("parent", "psize", "key").count()
        whole = materialise(probe.where(F.col("count") >= DENSE * F.col("psize")).select(F.col("parent").alias("key")).distinct(), f"dense-{level}")
        leaves = leaves.unionAll(parents.join(whole, "key", "left_semi").select("key", "node", "size"))
        rows = rows.join(whole, rows["parent"] == whole["key"], "left_anti")
    return leaves.select(F.col("key").alias("leaf"), "node", "size")


def block_pairs(rows: DataFrame, key: str, blocks, of) -> DataFrame:
    """Deals the rows of a large group out to pairs of its blocks (bi <= bj)."""
    block = F.pmod(F.xxhash64(F.col(of), F.lit(91)), blocks)
    each = rows.withColumn("_blocks", blocks).withColumn("block", block).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    return each.withColumns({"bi": F.least("block", "_other"), "bj": F.greatest("block", "_other")}).drop("_blocks", "_other")


def by_group(keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows sorted by keys: work() gets whole groups, many at a time.

    Only the group at the end of a batch waits for the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            k = np.column_stack([table.column(c).to_numpy() for c in keys])
            change = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            if waiting:
                last = waiting[-1].slice(len(waiting[-1]) - 1).select(keys).to_pylist()[0]
                if any(k[0][i] != last[c] for i, c in enumerate(keys)):
                    change = np.concatenate([[0], change])
            if not len(change):
                waiting.append(table)
                continue
            cut = int(change[-1])
            whole = pa.concat_tables([*waiting, table.slice(0, cut)]).combine_chunks()
            waiting = [table.slice(cut)]
            if len(whole) and (out := work(whole)) is not None:
                yield out
        if waiting and (out := work(pa.concat_tables(waiting).combine_chunks())) is not None:
            yield out

    return run


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    k = np.column_stack([table.column(c).to_numpy() for c in keys])
    return np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]])


def span_alike(tokens: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links that connect all sets with `least` tokens in common, and no more than that takes."""
    left = np.arange(1, len(tokens))
    found, queue = [], [0]
    while queue:
        x = queue.pop()
        near = (tokens[left] == tokens[x]).sum(1) >= least
        queue += left[near].tolist()
        found += [(x, y) for y in left[near].tolist()]
        left = left[~near]
        if not queue and len(left):
            queue, left = [int(left[0])], left[1:]
    return found


def _leaf_links(table: pa.Table) -> pa.RecordBatch | None:
    node = table.column("node").to_numpy()
    data, off = text_bytes(table.column("tokens"))
    tokens = data.view(np.uint32).reshape(-1, TOKENS)
    bounds = group_bounds(table, ["leaf", "bi", "bj"])
    size = np.diff(bounds)
    a, b = [], []
    two = bounds[:-1][size == 2]
    near = (tokens[two] == tokens[two + 1]).sum(1) >= LOOSE
    a.append(node[two[near]]), b.append(node[two[near] + 1])
    for g in np.flatnonzero(size > 2).tolist():
        i, j = int(bounds[g]), int(bounds[g + 1])
        links = np.array(span_alike(tokens[i:j], LOOSE), np.int64).reshape(-1, 2)
        a.append(node[i + links[:, 0]]), b.append(node[i + links[:, 1]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def alike_links(nodes: DataFrame, runs: int) -> DataFrame:
    """a, b: links that connect nodes which may be similar."""
    leaves = chosen_paths(nodes, runs)
    blocks = F.ceil(F.col("size") / F.lit(float(BLOCK))).cast("long")
    dealt = block_pairs(leaves, "leaf", blocks, "node").select("leaf", "bi", "bj", "node").join(nodes, "node")
    sorted_ = dealt.select("leaf", "bi", "bj", "node", "tokens").repartition("leaf", "bi", "bj").sortWithinPartitions("leaf", "bi", "bj")
    return sorted_.mapInArrow(by_group(["leaf", "bi", "bj"], _leaf_links), "a long, b long").distinct()


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j behind i with similarity >= threshold), each pair once; where left is mixed only pairs across it."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n = n[order]
    values, columns = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(len(values), np.int32)
    across = left.any() and not left.all()
    side = left[order]
    for i in range(len(order) - 1):
        stop = int(np.searchsorted(n, n[i] / threshold + 1e-9, side="right"))
        if stop <= i + 1:
            continue
        mark[columns[at[i] : at[i + 1]]] = 1
        common = np.add.reduceat(mark[columns[at[i + 1] : at[stop]]], at[i + 1 : stop] - at[i + 1])
        mark[columns[at[i] : at[i + 1]]] = 0
        ok = common >= threshold / (1 + threshold) * (n[i] + n[i + 1 : stop]) - 1e-9
        if across:
            ok &= side[i + 1 : stop] != side[i]
        yield int(order[i]), order[i + 1 : stop][ok]


def _exact_links(threshold: float) -> Callable[[pa.Table], pa.RecordBatch | None]:
    def work(table: pa.Table) -> pa.RecordBatch | None:
        bounds = group_bounds(table, ["component", "bi", "bj"])
        node, block, bi, bj = (table.column(c).to_numpy() for c in ("node", "block", "bi", "bj"))
        data, off = text_bytes(table.column("shingles"))
        a, b, count = [], [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            _, first = np.unique(node[lo:hi], return_index=True)  # repeated rows
            rows = lo + first
            sets = [data[off[r] : off[r + 1]].view(np.uint64) for r in rows.tolist()]
            left = block[rows] == bi[lo] if bi[lo] != bj[lo] else np.zeros(len(rows), bool)
            if bi[lo] != bj[lo] and left.all() or len(rows) < 2:
                continue
            links, root = np.zeros(len(rows), np.int64), list(range(len(rows)))

            def find(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for i, js in similar_pairs(sets, left, threshold):
                links[i] += len(js)
                links[js] += 1
                for j in js.tolist():
                    if (x := find(i)) != (y := find(j)):
                        root[x] = y
                        a.append(node[rows[i]]), b.append(node[rows[j]]), count.append(0)
            some = np.flatnonzero(links)
            a += node[rows[some]].tolist()
            b += [None] * len(some)
            count += links[some].tolist()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(count, pa.int64())], ["a", "b", "links"])

    return work


def _classes(docs: DataFrame, words: int, threshold: float, recall: float) -> DataFrame:
    """doc_id, digest (of the text), class_id, class_digest, rep_id, n_links for every row; class_id and class_digest name the document that stands for the class."""
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold)))
    if runs > TOKENS:
        raise ValueError(f"a recall of {recall} at {threshold} takes more than {TOKENS} runs")
    rows = materialise(signatures(docs, words), "ngram-signatures")
    # Equal sets have equal tokens.  The smallest doc_id stands for a set, a null one only if there is no other.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("rep")
    nodes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(first, F.first("tokens").alias("tokens"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "ngram-nodes")  # the numbers stay
    groups = components(alike_links(nodes.select("node", "tokens"), runs))

    members = groups.join(nodes.select("node", "s1", "n", "rep.doc_id", "rep.digest"), "node")
    weight = members.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(float(BLOCK_SHINGLES))).cast("long").alias("blocks"))
    members = members.join(weight, "component")
    texts = _digested(docs)
    texts = texts.join(members, texts["doc_id"].eqNullSafe(members["doc_id"]) & (texts["digest"] == members["digest"]))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            out, right = [], []
            s1 = batch.column(4).to_numpy()
            for i, j in sub_blocks(off):
                h, at = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], words)
                for k in range(j - i):
                    own = h[at[k] : at[k + 1]]
                    out.append(own.tobytes())
                    right.append(mix64(own ^ _PLACES[40]).sum(dtype=np.uint64).astype(np.int64) == s1[i + k])  # not another text of the same digest
            keep = pa.array(np.array(right, bool))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), batch.column(3), pa.array(out, pa.binary())], ["component", "node", "blocks", "shingles"]).filter(keep)

    texts = texts.select("node", "text", "component", "blocks", "s1").mapInArrow(sets, "component long, node long, blocks long, shingles binary")
    dealt = block_pairs(texts, "component", F.col("blocks"), "node").select("component", "bi", "bj", "block", "node", "shingles")
    dealt = dealt.repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
    found = materialise(dealt.mapInArrow(by_group(["component", "bi", "bj"], _exact_links(threshold)), "a long, b long, links long"), "ngram-links")

    classes = components(found.where("b is not null").select("a", "b"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    linked = materialise(nodes.select("node", "rep").join(classes, "node").join(links, "node", "left"), "ngram-classes")
    names = linked.groupBy("component").agg(F.min("rep").alias("name"))
    named = nodes.select("s1", "s2", "n", "node", "rep").join(linked.join(names, "component").select("node", "name", "n_links"), "node", "left")
    out = rows.select("doc_id", "digest", "s1", "s2", "n").join(named, ["s1", "s2", "n"], "left")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    out = out.withColumn("rep", F.coalesce("rep", own)).withColumn("name", F.coalesce("name", "rep"))
    return out.select("doc_id", "digest", F.col("name.doc_id").alias("class_id"), F.col("name.digest").alias("class_digest"), F.col("rep.doc_id").alias("rep_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def ngram_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, rep_id, n_links for every row of docs(doc_id, text).

    Classes are what links connect, named after their smallest doc_id; rep_id is
    the smallest doc_id of an equal set; n_links counts the other sets of similarity
    >= threshold.
    """
    return _classes(docs, words, threshold, recall).select("doc_id", "class_id", "rep_id", "n_links")


def ngram_join_rows(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs without all but one of each class, the smallest doc_id; repeated rows of that one all stay."""
    away = _classes(docs, words, threshold, recall).where("not (doc_id <=> class_id and digest = class_digest)").select("doc_id", "digest").distinct()
    doc, digest = fresh("_doc", docs), fresh("_digest", docs)
    away = materialise(away.toDF(doc, digest), "ngram-away")
    return docs.join(away, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (_digest(F.col("text").cast("string")) == F.col(digest)), "left_anti")
