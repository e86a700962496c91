"""Hard negatives by norm-bucketed search: exact inner products, whole buckets pruned by their length.

Vectors are sorted by norm, longest first, and packed into buckets of some thousand.
No score is above the product of two lengths (Cauchy-Schwarz), so a bucket is skipped
when that product lies below the lower limit of a window or below the worst of the k
scores which the window holds already.  Buckets are searched in rounds of growing size;
between rounds Spark merges what they found and raises the limits.  Anchors meet
buckets in blocks: a pair of blocks is one matrix product.

Rows with a null label, a null vector, a null or non-finite component, or one of 2**20
and more (their scores wouldn't fit) take no part.  Shorter vectors count as if zeros
followed.  A row without an id is no anchor; as a candidate it comes after all ids among
equal scores.  Repeated rows are rows of their own: each is found, and a repeated anchor
gives its rows again.  Further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, in_batches, materialise

#: Components become floor(SCALE * x).
SCALE = 256

#: Components from here on take no part.
LARGEST = float(1 << 20)

#: Numbers of a block's matrix, about, and rows of a block at most.
BLOCK_VALUES, BLOCK_ROWS = 1 << 18, 4096

#: Ranges of norms at most; the driver knows the largest norm of each.
MAX_RANGES = 4096

#: Each round searches so many times the ranges of the one before.
GROWTH = 4

#: Scores of one step of a matrix product.
STEP_SCORES = 1 << 20

#: Below every score, above every score.
LEAST, MOST = -(1 << 60), 1 << 60

_ROWS = "id long, label long, anchor boolean, norm double, row long, q array<int>"
_BLOCK = "range int, block long, top double, dim int, ids binary, known binary, labels binary, anchors binary, norms binary, rows binary, q binary"
_HIT = "block long, pos int, w int, score long, id long"


def _rows(df: DataFrame, id_col: str, vector_col: str, label: Column, anchors: Column) -> DataFrame:
    """The rows that take part, with integer components and norm."""
    x = F.col(vector_col)
    fits = label.isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < LARGEST))
    q = F.when(fits, F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("int")))
    picked = df.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), (F.coalesce(anchors, F.lit(False)) & F.col(id_col).isNotNull()).alias("anchor"), q.alias("q"), F.lit(None).cast("long").alias("row"),
    ).where("q is not null")
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return picked.withColumn("norm", norm).where(F.col("norm") < float(1 << 28)).select("id", "label", "anchor", "norm", "row", "q")


def _block(range_: int, number: int, dim: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row: a block with its matrix, in as few bytes a number as hold it."""
    t = pa.Table.from_batches(parts).combine_chunks()
    n, block = t.num_rows, (range_ << 20) + number
    lists = t.column("q").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    q = np.zeros((n, dim), np.int32)
    q[np.arange(dim) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    if n and abs(q).max(initial=0) < 1 << 15:
        q = q.astype(np.int16)
    ids, norms = t.column("id").combine_chunks(), t.column("norm").to_numpy()
    rows = t.column("row").to_numpy() if not t.column("row").null_count else (np.int64(block) << 13) + np.arange(n)
    whole = [ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), t.column("label").to_numpy(), t.column("anchor").to_numpy(), norms, rows.astype(np.int64), q]
    values = [range_, block, float(norms.max()), dim, *(np.ascontiguousarray(x).tobytes() for x in whole)]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, [pa.int32(), pa.int64(), pa.float64(), pa.int32(), *[pa.binary()] * 7], strict=True)], _names(_BLOCK))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _packed(rows: DataFrame, n: int, dim: int, tag: str) -> DataFrame:
    """Blocks of rows by falling norm; block numbers and ranges rise as norms fall."""
    size = max(64, min(BLOCK_ROWS, BLOCK_VALUES // max(1, dim)))
    ranges = max(1, min(MAX_RANGES, -(-n // size)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_, number, held, have = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - have)
                held.append(part)
                have, at = have + part.num_rows, at + part.num_rows
                if have == size:
                    yield _block(range_, number, dim, held)
                    number, held, have = number + 1, [], 0
        if have:
            yield _block(range_, number, dim, held)

    by = [F.desc("norm"), F.asc("id"), F.asc("tie")]  # the last deals out one vector in many rows
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    return materialise(in_batches(dealt).drop("tie").mapInArrow(pack, _BLOCK), tag)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors among the rows of blocks, as rows again."""
    for batch in batches:
        for raw in batch.to_pylist():
            b = _unpack(raw)
            at = np.flatnonzero(b["anchors"])
            q = b["q"][at].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * raw["dim"], pa.int32()), pa.array(q.reshape(-1)))
            columns = [pa.array(b["ids"][at]), pa.array(b["labels"][at]), pa.array(np.ones(len(at), bool)), pa.array(b["norms"][at]), pa.array(b["rows"][at]), lists]
            yield pa.RecordBatch.from_arrays(columns, _names(_ROWS))


def _unpack(raw: dict, prefix: str = "") -> dict[str, np.ndarray]:
    out = {k: np.frombuffer(raw[prefix + k], t) for k, t in (("ids", np.int64), ("known", bool), ("labels", np.int64), ("anchors", bool), ("norms", np.float64), ("rows", np.int64))}
    n, dim = len(out["ids"]), raw["dim"]
    out["q"] = np.frombuffer(raw[prefix + "q"], np.int16 if len(raw[prefix + "q"]) == 2 * n * dim else np.int32).reshape(n, dim)
    return out


def best_of_pair(a: dict, b: dict, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """For anchors a and windows low..high (anchors x windows): the k best rows of bucket b in each.

    pos, w, score, row of b; same: rows of the anchor's label without itself, else rows of
    other labels.  low is raised to the k-th score where k are found.
    """
    reach = float(b["norms"].max(initial=0)) * (1 + 1e-9)
    exact = a["norms"].max(initial=0) * reach < 2.0**52
    at = np.flatnonzero((a["norms"][:, None] * reach + 1 >= low).any(1))  # else no window of the anchor can gain
    kind = np.float64 if exact else np.int64
    right = b["q"].astype(kind).T
    step = max(1, STEP_SCORES // max(1, right.shape[1]))
    found: list[tuple[np.ndarray, ...]] = []
    for i in range(0, len(at), step):
        rows = at[i : i + step]
        s = (a["q"][rows].astype(kind) @ right).astype(np.int64)
        fits = a["labels"][rows][:, None] == b["labels"]
        if same:
            fits &= a["rows"][rows][:, None] != b["rows"]
        else:
            fits = ~fits
        fits &= (s >= low[rows].min(1)[:, None]) & (s <= high[rows].max(1)[:, None])
        if same and low.shape[1] == 1 and s.shape[1] > k:  # one open window: nothing below the k-th score
            cut = np.partition(np.where(fits, s, LEAST), s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            fits &= s >= cut[:, None]
        r, c = np.nonzero(fits)
        v = s[r, c]
        order = np.lexsort((b["ids"][c], ~b["known"][c], -v, r))
        r, c, v = r[order], c[order], v[order]
        for w in range(low.shape[1]):
            inside = np.flatnonzero((v >= low[rows[r], w]) & (v <= high[rows[r], w]))
            first = np.searchsorted(r[inside], r[inside])
            rank = np.arange(len(inside)) - first
            inside, rank = inside[rank < k], rank[rank < k]
            found.append((rows[r[inside]], np.full(len(inside), w), v[inside], c[inside]))
            full = rank == k - 1
            low[rows[r[inside[full]]], w] = np.maximum(low[rows[r[inside[full]]], w], v[inside[full]])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _meet(k: int, same: bool):
    """Task over pairs of an anchor block with its windows and a bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        risen: dict[int, np.ndarray] = {}  # the limits of the anchor blocks met last
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.slice(i, 1).to_pylist()[0]
                a, b = _unpack(raw, "a_"), _unpack(raw)
                wide = 1 + max(x["w"] for x in raw["windows"])
                low, high = np.full((len(a["ids"]), wide), MOST), np.full((len(a["ids"]), wide), LEAST)
                for x in raw["windows"]:
                    low[x["pos"], x["w"]], high[x["pos"], x["w"]] = x["low"], x["high"]
                low = np.maximum(low, risen.get(raw["a_block"], LEAST))
                pos, w, score, row = best_of_pair(a, b, low, high, k, same)
                if len(risen) > 64:
                    risen.clear()
                risen[raw["a_block"]] = low
                ids = pa.array(b["ids"][row], mask=~b["known"][row])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), raw["a_block"])), pa.array(pos.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(score), ids], _names(_HIT))

    return work


def search(buckets: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """The first k rows (by falling score, then id) of each window: block, pos, w, score, id, rank.

    windows: block, pos, w, norm, low, high, for anchors by block and place in it.
    same: rows of the anchor's own label but for itself, else rows of other labels.
    """
    tops = {r["range"]: r["top"] for r in buckets.groupBy("range").agg(F.max("top").alias("top")).orderBy("range").collect()}
    order, best = list(tops), None
    key, by = ["block", "pos", "w"], [F.desc("score"), F.asc_nulls_last("id")]
    done, size = 0, 1
    while done < len(order):
        ranges, done, size = order[done : done + size], done + size, size * GROWTH
        live = windows
        if best is not None:
            kth = best.where(F.col("rank") == k).select(*key, F.col("score").alias("kth"))
            live = windows.join(kth, key, "left").withColumn("low", F.greatest("low", F.coalesce("kth", F.lit(LEAST))))
        # A bucket counts for a window if the product of lengths reaches its limit; 1 and 1e-9 make up for rounding.
        open_ = live.where(F.col("norm") * tops[ranges[0]] * (1 + 1e-9) + 1 >= F.col("low"))
        need = F.min(F.when(F.col("low") <= 1, 0.0).otherwise((F.col("low") - 1) / F.col("norm") * (1 - 1e-9)))
        held = open_.groupBy("block").agg(need.alias("need"), F.collect_list(F.struct("pos", "w", "low", "high")).alias("windows"))
        reach = F.array(*(F.struct(F.lit(r).alias("range"), F.lit(tops[r]).alias("top")) for r in ranges))
        asked = (
            anchors.select(F.col("block").alias("a_block"), *(F.col(c).alias("a_" + c) for c in ("ids", "known", "labels", "anchors", "norms", "rows", "q")))
            .join(held.withColumnRenamed("block", "a_block"), "a_block")
            .withColumn("to", F.explode(F.filter(reach, lambda x: x["top"] >= F.col("need"))))
            .withColumn("range", F.col("to")["range"])
            .drop("to")
        )
        pairs = asked.join(buckets.where(F.col("range").between(ranges[0], ranges[-1])), "range").where(F.col("top") >= F.col("need"))
        hits = in_batches(pairs).mapInArrow(_meet(k, same), _HIT)
        both = hits if best is None else best.drop("rank").unionByName(hits)
        best, old = materialise(both.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where(F.col("rank") <= k), "negatives-best"), best
        if old is not None:
            drop_scratch(old)
    return best


def mine(
    df: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Positives of an anchor are its first rows of the same label, by score and id; the
    negatives of each are the first rows of other labels whose score is between the two
    shares of the positive's.  An anchor without positives, or whose windows are
    empty, gives no rows; an empty table gives none at all.
    """
    label = F.col("label") if label is None else label
    rows = _rows(df, id_col, vector_col, label, anchors)
    n, dim = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return df.sparkSession.createDataFrame([], columns)
    buckets = _packed(rows, n, dim, "negatives-buckets")
    anchored = in_batches(buckets).mapInArrow(_anchor_rows, _ROWS)
    blocks = _packed(anchored, rows.where("anchor").count(), dim, "negatives-anchors")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.to_pylist():
                b = _unpack(raw)
                m = len(b["ids"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, raw["block"])), pa.array(np.arange(m, dtype=np.int32)), pa.array(b["ids"]), pa.array(b["norms"])], ["block", "pos", "anchor_id", "norm"])

    every = in_batches(blocks).mapInArrow(places, "block long, pos int, anchor_id long, norm double")
    whole = every.select("block", "pos", F.lit(0).alias("w"), "norm", F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    found = search(buckets, blocks, whole, positives, True).select("block", "pos", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # low_percent * positive <= 100 * negative <= high_percent * positive, in whole numbers.
    low = F.expr(f"-((-positive_score * {low_percent} - pmod(-positive_score * {low_percent}, 100)) div 100)")
    high = F.expr(f"(positive_score * {high_percent} - pmod(positive_score * {high_percent}, 100)) div 100")
    windows = materialise(every.join(found, ["block", "pos"]).select("block", "pos", "w", "norm", low.alias("low"), high.alias("high"), "anchor_id", "positive_id", "positive_score"), "negatives-windows")
    last = search(buckets, blocks, windows.select("block", "pos", "w", "norm", "low", "high").where(F.col("low") <= F.col("high")), negatives, False)
    for read in (buckets, blocks):  # windows and last are tables of their own
        drop_scratch(read)
    return last.join(windows, ["block", "pos", "w"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
