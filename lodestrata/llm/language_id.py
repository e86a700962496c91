"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of the labelled texts, by executor and by
language, adds them up in Spark and keeps one log-probability matrix of
(languages x buckets) of MATRIX_CELLS cells at most: with very many languages there
are less buckets, down to one for each, and no language is left out; it is broadcast.  Scoring hashes each text sparsely in numpy and adds up matrix
columns; memory is bounded by a batch.

Training reads at most about `per_language` texts of each language, drawn by
a hash of doc_id; 0 means all of them.  A text that is null or has no letter
gets `und` with score 0.  Ties go to the language that sorts first.  Empty
training gives `und` everywhere.  Repeated rows are each scored by themselves;
columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, mix64, sub_blocks, text_bytes

#: Texts of each language that training reads, about.
PER_LANGUAGE = 20_000
#: Log2 of the number of n-gram buckets.
BUCKET_BITS = 16
#: Lengths of the n-grams, in characters.
LENGTHS = (1, 2, 3)
#: Cells of the matrix, which is broadcast and must have a bound: 256 languages have all buckets.
MATRIX_CELLS = 1 << 24

_FOLD = np.arange(0x250, dtype=np.uint32)
for _c in range(0x250):
    if len(chr(_c).lower()) == 1:
        _FOLD[_c] = ord(chr(_c).lower())


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # buckets x languages
    prior: np.ndarray
    bits: int
    lengths: tuple[int, ...]


def characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, folded to lower case where that is one for one, and offsets in characters."""
    lead = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[off]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x250, _FOLD[np.minimum(points, 0x24F)], points), at


def ngram_buckets(points: np.ndarray, at: np.ndarray, bits: int, lengths: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, buckets of the n-grams inside each string and the first n-gram of each string."""
    size = np.diff(at)
    for n in lengths:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        bucket = (mix64(h) >> np.uint64(64 - bits)).astype(np.int64)
        inside = np.ones(len(bucket), bool)
        for k in range(1, n):  # n-grams that would run into the next string
            end = at[1:] - k
            end = end[(end >= 0) & (end < len(inside))]
            inside[end] = False
        number = np.maximum(size - n + 1, 0)
        yield bucket[inside], np.concatenate([[0], np.cumsum(number)])


def train(docs: DataFrame, where: Column, per_language: int = PER_LANGUAGE, bits: int = BUCKET_BITS, lengths: tuple[int, ...] = LENGTHS) -> Model:
    """Learn from docs(doc_id, text, lang) where `where` holds and text and lang aren't null."""
    rows = in_batches(docs).where(where & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MATRIX_CELLS + 1).collect()}
    if len(sizes) > MATRIX_CELLS:
        raise ValueError("lang holds something else than languages")
    while bits and len(sizes) << bits > MATRIX_CELLS:
        bits -= 1
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), bits, lengths)
    if per_language:
        draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30))
        shares = docs.sparkSession.createDataFrame([(k, int(min(1.0, per_language / n) * (1 << 30))) for k, n in sizes.items()], "lang string, share long")
        rows = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share"))  # a row for each language
    place = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << bits), np.int64)
        for batch in batches:
            own = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            data, off = text_bytes(batch.column(0))
            for i, j in sub_blocks(off):
                points, at = characters(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for bucket, first in ngram_buckets(points, at, bits, lengths):
                    key = np.repeat(own[i:j] << bits, np.diff(first)) | bucket
                    total += np.bincount(key, minlength=total.size).reshape(total.shape)
        who, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(who << bits | bucket), pa.array(total[who, bucket])], ["k", "n"])

    # At most languages x buckets rows, whatever the input.
    got = rows.select("text", "lang").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    total = np.ones(len(languages) << bits)
    total[got.column("k").to_numpy()] += got.column("n").to_numpy()
    total = total.reshape(len(languages), 1 << bits)
    n = np.array([sizes[k] for k in languages], float)
    return Model(languages, np.log(total / total.sum(1, keepdims=True)).T.astype(np.float32).copy(), np.log(n / n.sum()), bits, lengths)


def score_strings(model: Model, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the likeliest language of each string and its posterior probability."""
    total = np.tile(model.prior, (len(off) - 1, 1))
    for i, j in sub_blocks(off):
        points, at = characters(data[off[i] : off[j]], off[i : j + 1] - off[i])
        for bucket, first in ngram_buckets(points, at, model.bits, model.lengths):
            full = np.flatnonzero(np.diff(first))
            if len(full):
                for k in range(len(model.languages)):
                    column = np.ascontiguousarray(model.log_probability[:, k])
                    total[i + full, k] += np.add.reduceat(column[bucket], first[full], dtype=np.float64)
    best = total.argmax(1)
    top = total.max(1, keepdims=True)
    return best, 1 / np.exp(total - top).sum(1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs(doc_id, text)."""
    shared = in_batches(docs).sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            letters = np.array(batch.column(2).fill_null(False).to_pylist(), bool)
            names, scores = np.full(len(letters), "und", object), np.zeros(len(letters))
            if m.languages and len(letters):
                best, p = score_strings(m, *text_bytes(batch.column(1)))
                names[letters] = np.array(m.languages, object)[best[letters]]
                scores[letters] = p[letters]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), text.rlike(r"\p{L}").alias("letters")).mapInArrow(work, "doc_id long, lang_pred string, score double")
