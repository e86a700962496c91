"""Compression classifier for text quality.

Two zstandard dictionaries are built, from good and from bad labelled text.  A
text that is like the good texts is the smaller one under the good dictionary:
the difference of the two compressed sizes over their sum is the signal.  Texts
are compressed in pieces of PIECE_BYTES, all of them, so that the dictionary
counts at the end of a long text as much as at its start.  A logistic curve,
fitted on labelled texts that the dictionaries don't hold, turns the signal
into a probability; beside it stands the compression ratio, which the same two
sizes give.

Fitting reads at most `per_class` labelled texts of each class, drawn by a hash
of doc_id; half go to the dictionaries, half to the curve.  A dictionary has room for DICTIONARY_BYTES
(zstandard finds nothing much farther away), so its texts give it equal shares, each from its middle; the curve's texts are
read whole, where they are, and give two numbers each.  A doc_id with more
labels counts as bad if one of them is.  Null and empty texts get the score
that the curve gives to the mean of all signals.  Without labels of both classes every text gets
the share of good labels (1 without any).  Repeated rows are each scored by
themselves, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, materialise, text_bytes

#: Labelled texts of each class that fitting reads at most.
PER_CLASS = 2_000
#: Bytes of a dictionary at most.
DICTIONARY_BYTES = 110_000
#: Bytes of text that are compressed at once.
PIECE_BYTES = 4_096
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray  # of a constant and each feature
    mean: np.ndarray
    scale: np.ndarray


class Sizes:
    """Compressed sizes of texts under two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        self.by = []
        for raw in (good, bad):
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: bytes) -> tuple[float, float]:
        """(bad - good) / (bad + good), and the mean size over the length."""
        view = memoryview(text)
        good = bad = 0
        for i in range(0, len(text), PIECE_BYTES):
            piece = view[i : i + PIECE_BYTES]
            good += len(self.by[0].compress(piece)) - 6
            bad += len(self.by[1].compress(piece)) - 6
        return (bad - good) / max(1, bad + good), (bad + good) / max(1, 2 * len(text))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a constant and each column, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _dictionary(rows: DataFrame, n: int) -> bytes:
    """Equal shares of n texts in all, a stretch of each, one behind the other in the order of a hash."""
    share = max(64, DICTIONARY_BYTES // n)
    from_ = F.greatest(F.floor((F.char_length("text") - share) / 2).cast("int"), F.lit(0)) + 1
    parts = rows.select(F.substring(F.col("text"), from_, F.lit(share)).alias("part"), F.xxhash64(F.col("doc_id"), F.lit(7)).alias("at"), "doc_id").orderBy("at", "doc_id").collect()
    return b"\n".join(r["part"].encode() for r in parts)[-DICTIONARY_BYTES:]


def fit(docs: DataFrame, labels: DataFrame, where: Column, per_class: int = PER_CLASS) -> Model:
    """Learn labels.quality from docs where `where` (over doc_id) holds."""
    marks = labels.where(where & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = {r[0]: r[1] for r in marks.groupBy("quality").count().collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    drawn = None
    for k in (0, 1):
        own = marks.where(F.col("quality") == k).orderBy(order, "doc_id").limit(per_class)
        drawn = own if drawn is None else drawn.unionAll(own)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # 2 x per_class rows at most, so the broadcast has a bound; a repeated doc_id counts once.
    rows = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.max("text").alias("text")).where("text != ''")
    rows = materialise(rows.withColumn("curve", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(6)), F.lit(2)) == 1), "quality-sample")
    parts = {(r["quality"], r["curve"]): r["n"] for r in rows.groupBy("quality", "curve").agg(F.count(F.lit(1)).alias("n")).collect()}
    neutral = n.get(1, 0) / max(1, sum(n.values())) if n else 1.0
    flat = Model(b"", b"", np.array([np.log((neutral + 1e-6) / (1 - neutral + 1e-6)), 0.0, 0.0]), np.zeros(2), np.ones(2))
    if min(parts.get((k, c), 0) for k in (0, 1) for c in (False, True)) < 2:
        return flat
    good, bad = (_dictionary(rows.where((F.col("quality") == k) & ~F.col("curve")), parts[k, False]) for k in (1, 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            x = np.array([sizes.features(t.as_py().encode()) for t in batch.column(2)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(x[:, 0]), pa.array(x[:, 1])], ["doc_id", "quality", "a", "b"])

    # At most per_class rows of each class, two numbers in each.
    curve = rows.where("curve").select(F.col("doc_id").cast("long"), "quality", "text").mapInArrow(measure, "doc_id long, quality int, a double, b double").orderBy("quality", "doc_id").toArrow()
    x = np.column_stack([curve.column("a").to_numpy(), curve.column("b").to_numpy()])
    y = curve.column("quality").to_numpy().astype(float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = fit_logistic((x - mean) / scale, y)
    # The classes were drawn apart: move the constant to their true shares.
    w[0] += np.log(n[1] / n[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, w, mean, scale)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of docs(text, ...) and the score under that name, in place of one that was there."""
    docs = in_batches(docs).drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        sizes = Sizes(m.good, m.bad)
        for batch in batches:
            data, off = text_bytes(batch.column(at))
            raw = data.tobytes()
            x = np.tile(m.mean, (len(off) - 1, 1))
            if m.good:
                for i in np.flatnonzero(np.diff(off)).tolist():
                    x[i] = sizes.features(raw[off[i] : off[i + 1]])
            p = 1 / (1 + np.exp(-np.clip(m.weights[0] + (x - m.mean) / m.scale @ m.weights[1:], -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{name} double"])
    return docs.mapInArrow(work, schema)
