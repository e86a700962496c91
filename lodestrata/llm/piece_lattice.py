"""SentencePiece encoding and decoding over a lattice of words.

A text gets a space before it (unless it is empty) and is cut into words: a run of
spaces with what follows it up to the next space or line feed, a line feed, or spaces
at the end.  The distinct words of a block of texts are exploded into all substrings
of bounded length, these are equi-joined to the piece table, the edges are grouped by word
and folded, and each text takes the ids of its words.

The fold depends on the model.  Unigram: the best path (Viterbi) by Spark's higher-order
aggregate, most score, at a tie the longest last piece; a character without a piece costs
UNKNOWN.  All steps are DataFrame operations.  BPE (scores are ranks): a path of best
ranks isn't what the library gives, so the fold merges the pair of the best rank again
and again, the leftmost of equal ones, with the borders of a word as bits of one
number.  Here the same steps (explode, equi-join, group, fold) run over the columns of a block
in numpy, without a shuffle, WORDS_AT_ONCE distinct words at a time.  A word of more than
MASK_BYTES bytes is folded by itself, its edges in a heap.  A character without a piece stands
for its bytes.  Words and pieces that a hash brings together are compared byte by byte.

Null and empty texts have no ids and decode to an empty text.  The space mark of the
model (U+2581) decodes to a space, so texts that hold it aren't given back.  Repeated rows are each
encoded; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct_spans, gather, head_bytes, in_batches, prefix_hash, same_spans, span_hash, sub_blocks, text_bytes, trim

#: Characters of a word at most, and spaces before it in the same word, for the best path.
WORD_CHARS, WORD_SPACES = 240, 16
#: Bytes of text of a block, about: on the way of joins, and in numpy.
BLOCK_BYTES, COLUMN_BYTES = 8 << 20, 1 << 20
#: Distinct words whose edges are in memory at once.
WORDS_AT_ONCE = 20_000
#: Bytes of the longest word whose borders one number holds.
MASK_BYTES = 60
#: Score of a character that no piece covers.
UNKNOWN = -1e7

_WORDS = rf"\n| {{0,{WORD_SPACES}}}[^ \n]{{1,{WORD_CHARS}}}| {{1,{WORD_SPACES}}}"
_MARK = "▁"


@dataclass
class Pieces:
    """Piece table of a model: text, id and score of each piece, ids of the 256 bytes."""

    text: list[str]
    ids: list[int]
    scores: list[float]
    bytes: np.ndarray
    plain: list[bytes]  # by id, what each stands for
    merges: bool  # whether scores are ranks of merges

    @staticmethod
    def load(model_path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        real = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        raw = np.full(256, m.unk_id(), np.int32)
        plain = [b""] * n
        for i in range(n):
            if m.is_byte(i):
                b = int(names[i][3:5], 16)
                raw[b], plain[i] = i, bytes([b])
        for i in real:
            plain[i] = names[i].replace(_MARK, " ").encode()
        scores = [m.get_score(i) for i in real]
        return Pieces([names[i] for i in real], real, scores, raw, plain, all(x.is_integer() for x in scores))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = pa.table({"piece": pa.array([t.replace(_MARK, " ") for t in self.text]), "id": pa.array(self.ids, pa.int32()), "score": pa.array(self.scores, pa.float64())})
        return spark.createDataFrame(rows).groupBy("piece").agg(F.max_by("id", "score").alias("id"), F.max("score").alias("score"))


def words_of(text: Column) -> Column:
    spaced = F.when(text != "", F.concat(F.lit(" "), F.replace(text, F.lit(_MARK), F.lit(" ")))).otherwise("")
    return F.regexp_extract_all(spaced, F.lit(_WORDS), F.lit(0))


def spans(words: DataFrame, pieces: DataFrame, keys: list[str], longest: int, shortest: int = 1) -> DataFrame:
    """keys, word, s, e, score, id of each substring that is a piece."""
    n = F.char_length("word")
    starts = words.select(*keys, "word", F.explode(F.sequence(F.lit(0), n - shortest)).alias("s"))
    each = starts.select(*keys, "word", "s", F.explode(F.sequence(F.col("s") + shortest, F.least(n, F.col("s") + longest))).alias("e"))
    return each.withColumn("piece", F.substring(F.col("word"), F.col("s") + 1, F.col("e") - F.col("s"))).join(F.broadcast(pieces), "piece")


class Lattice:
    """Words of a block against the piece table, in columns."""

    def __init__(self, model_path: str):
        p = self.pieces = Pieces.load(model_path)
        names = [x.replace(_MARK, " ") for x in p.text]
        raw = [x.encode() for x in names]
        size = np.array([len(x) for x in raw])
        self.off = np.concatenate([[0], np.cumsum(size)])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        short = head_bytes(self.raw, self.off[:-1], size)
        long = span_hash(prefix_hash(self.raw), self.off[:-1], self.off[1:])
        self.rank, self.ids = -np.array(p.scores, np.int64), np.array(p.ids, np.int64)
        self.by_name = {x: (-int(y), i) for x, y, i in zip(names, p.scores, p.ids, strict=True)}
        #: The piece table by length in bytes: sorted keys (the bytes themselves up to 8 of them) and numbers of the pieces.
        self.by_size = {}
        for n in np.unique(size).tolist():
            key = short if n <= 8 else long
            own = np.flatnonzero(size == n)
            own = own[np.argsort(key[own])]
            if (key[own][1:] == key[own][:-1]).any():
                raise ValueError("two pieces of one key")
            self.by_size[n] = key[own], own

    def join(self, text: np.ndarray, heads: np.ndarray, prefix: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of spans of one size: which are pieces, and numbers of those."""
        keys, pieces = self.by_size[size]
        own = heads[starts] & np.uint64((1 << 8 * size) - 1) if size <= 8 else span_hash(prefix, starts, starts + size)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == own)
        found = pieces[at[hit]]
        if size > 8:  # a hash: the bytes decide
            right = same_spans(np.concatenate([text, self.raw]), starts[hit], len(text) + self.off[found], np.full(len(hit), size))
            hit, found = hit[right], found[right]
        return hit, found

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one behind the other, and the n+1 offsets."""
        ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(starts), WORDS_AT_ONCE):
            got, size = self._encode_some(data, starts[i : i + WORDS_AT_ONCE], ends[i : i + WORDS_AT_ONCE])
            ids.append(got), sizes.append(size)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _encode_some(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = ends - starts
        short = n <= MASK_BYTES
        ids, sizes = self._encode_short(data, starts[short], n[short])
        if short.all():
            return ids, sizes
        parts = iter(np.split(ids, np.cumsum(sizes)[:-1]))
        words = [next(parts) if ok else self.encode_long(data[a:b].tobytes().decode()) for ok, a, b in zip(short.tolist(), starts.tolist(), ends.tolist(), strict=True)]
        return np.concatenate(words), np.array([len(x) for x in words], np.int64)

    def _encode_short(self, data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        off = np.concatenate([[0], np.cumsum(n)])
        text = gather(data, starts, n)
        prefix = prefix_hash(text)
        heads = head_bytes(text, np.arange(len(text)), np.full(len(text), 8))
        lead = np.flatnonzero((text & 0xC0) != 0x80)
        word = np.repeat(np.arange(len(n), dtype=np.int32), n)[lead]
        place = lead - off[word]
        mask = np.zeros(len(n), np.uint64)
        np.bitwise_or.at(mask, word, np.uint64(1) << place.astype(np.uint64))
        mask |= np.uint64(1) << n.astype(np.uint64)
        # Explode and join: substrings of each size that occurs in the table.
        found = []
        left = n[word] - place
        for size in self.by_size:
            if size > 1:
                use = np.flatnonzero(left >= size)
                if len(use):
                    hit, piece = self.join(text, heads, prefix, lead[use], size)
                    hit = use[hit]
                    found.append((word[hit], self.rank[piece] << 16 | place[hit] << 8 | (place[hit] + size)))
        if found:
            owner, code = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((code, owner))  # group by word, in order of rank
            merge_borders(mask, owner[order], code[order])
        # Segments between borders that are left.
        bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w, at = np.nonzero(bits)
        same = np.flatnonzero(w[1:] == w[:-1])
        w, begin, size = w[same], at[same] + off[w[same]], at[same + 1] - at[same]
        ids = np.full(len(w), -1, np.int64)
        for k in np.unique(size).tolist():
            own = np.flatnonzero(size == k)
            if k in self.by_size:
                hit, piece = self.join(text, heads, prefix, begin[own], k)
                ids[own[hit]] = self.ids[piece]
        count = np.where(ids >= 0, 1, size)
        out = np.repeat(ids, count)
        byte = np.repeat(begin, count) + np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
        out = np.where(out < 0, self.pieces.bytes[text[np.minimum(byte, len(text) - 1)]] if len(text) else out, out)
        return out, np.bincount(w, weights=count, minlength=len(n)).astype(np.int64)

    def encode_long(self, word: str) -> np.ndarray:
        """Ids of one word: the same fold over edges in a heap, for the pieces between borders."""
        size, before = [1] * len(word), list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, int]] = []

        def edge(i: int) -> None:
            """The edge of the segment at i and the one behind it."""
            j = i + size[i]
            if j < len(word) and (piece := self.by_name.get(word[i : j + size[j]])):
                heapq.heappush(heap, (piece[0], i, j + size[j]))

        for i in range(len(word)):
            edge(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = i + size[i]
            if size[i] == 0 or j >= end or j + size[j] != end:
                continue  # one of the two has merged since
            size[i], size[j] = end - i, 0
            if end < len(word):
                before[end] = i
            edge(i)
            if i:
                edge(before[i])
        out, i = [], 0
        while i < len(word):
            piece = self.by_name.get(word[i : i + size[i]])
            out += [piece[1]] if piece else self.pieces.bytes[list(word[i].encode())].tolist()
            i += size[i]
        return np.array(out, np.int64)

    def encode_texts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and the n+1 offsets."""
        full = np.flatnonzero(np.diff(off))
        begin = off[:-1][full] + np.arange(len(full))
        spaced = np.full(len(data) + len(full), 0x20, np.uint8)
        body = np.ones(len(spaced), bool)
        body[begin] = False
        spaced[body] = data
        edge = np.zeros(len(spaced), bool)
        lf = spaced == 0x0A
        edge[1:] = (spaced[1:] == 0x20) & (spaced[:-1] != 0x20) | lf[1:] | lf[:-1]
        edge[begin] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(spaced)) if len(starts) else starts
        del body, edge, lf
        first, which = distinct_spans(spaced, starts, ends)
        ids, at = self.encode_words(spaced, starts[first], ends[first])
        got, size = concat_ranges(ids, at, which)
        count = np.zeros(len(off) - 1, np.int64)
        if len(full):
            count[full] = np.add.reduceat(size, np.searchsorted(starts, begin))
        return got, np.concatenate([[0], np.cumsum(count)])


def merge_borders(mask: np.ndarray, word: np.ndarray, codes: np.ndarray) -> None:
    """Merge edges (rank, start, end in one number; by word, in order) in place; masks have a bit for each border."""
    s = (codes >> 8 & 255).astype(np.uint64)
    size = (codes & 255).astype(np.uint64) - s
    one = np.uint64(1)
    while len(word):
        own = mask[word] >> s & ((one << (size + one)) - one)
        possible = (own & one) & (own >> size) == one  # both ends still are borders
        word, s, size, own = word[possible], s[possible], size[possible], own[possible]
        ready = np.flatnonzero(np.bitwise_count(own) == 3)  # and there is one between them
        first = ready[np.append(True, word[ready][1:] != word[ready][:-1])] if len(ready) else ready
        mask[word[first]] ^= (own[first] ^ one ^ (one << size[first])) << s[first]
        on = np.zeros(len(mask), bool)
        on[word[first]] = True
        word, s, size = (x[on[word]] for x in (word, s, size))


def best_path() -> Column:
    """Ids of the best path through `edges` of `word`; -e stands for the character that ends at e."""
    n = F.char_length("word")

    def step(best: Column, e: Column) -> Column:
        over = F.filter("edges", lambda x: x["e"] == e)
        ways = F.transform(over, lambda x: F.struct((F.element_at(best, x["s"] + 1)["score"] + x["score"]).alias("score"), (-x["s"]).alias("from"), x["id"].alias("id")))
        bare = F.struct((F.element_at(best, e)["score"] + F.lit(UNKNOWN)).alias("score"), (F.lit(1) - e).alias("from"), (-e).alias("id"))
        return F.concat(best, F.array(F.array_max(F.concat(ways, F.array(bare)))))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("from"), F.lit(0).alias("id")))

    def back(best: Column) -> Column:
        def hop(state: Column, _: Column) -> Column:
            here = F.element_at(best, state["at"] + 1)
            return F.when(state["at"] == 0, state).otherwise(F.struct((-here["from"]).alias("at"), F.concat(F.array(here["id"]), state["ids"]).alias("ids")))

        return F.aggregate(F.sequence(F.lit(1), n), F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids")), hop, lambda s: s["ids"])

    return F.aggregate(F.sequence(F.lit(1), n), start, step, back)


def concat_ranges(values: np.ndarray, off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[off[k]:off[k+1]] for each k of which, one behind the other; and how many each gives."""
    size = np.diff(off)[which]
    begin = np.cumsum(size) - size
    return values[np.arange(int(size.sum())) + np.repeat(off[which] - begin, size)], size


def decode_ids(pieces: Pieces, ids: np.ndarray, sizes: Iterable[int]) -> Iterator[bytes]:
    """Texts of sequences of ids that stand one behind the other."""
    raw = np.frombuffer(b"".join(pieces.plain), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in pieces.plain])])
    length = np.diff(off)[ids]
    ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(list(sizes))]).astype(np.int64)]
    blob = gather(raw, off[ids], length).tobytes()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield blob[min(a + 1, b) : b]


_RESULT = "doc_id long, n_pieces long, ids array<int>, round_trip boolean"
_workers: dict[str, Lattice] = {}


def lattice_of(model_path: str) -> Lattice:
    """This worker's piece table."""
    if model_path not in _workers:
        _workers[model_path] = Lattice(model_path)
    return _workers[model_path]


def _result(ids: list | pa.Array, bodies: Iterable[bytes], got: np.ndarray, ends: np.ndarray, p: Pieces) -> pa.RecordBatch:
    column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(got.astype(np.int32)))
    right = pa.array([a == b for a, b in zip(decode_ids(p, got, np.diff(ends)), bodies, strict=True)], pa.bool_())
    return pa.RecordBatch.from_arrays([ids if isinstance(ids, pa.Array) else pa.array(ids, pa.int64()), pa.array(np.diff(ends)), column, right], ["doc_id", "n_pieces", "ids", "round_trip"])


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip (decoding gives the text back) for every row of docs(doc_id, text)."""
    pieces = Pieces.load(model_path)
    if not pieces.merges:
        return encode_best_path(docs, pieces)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model_path)
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j in sub_blocks(off, COLUMN_BYTES):
                own, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                raw = own.tobytes()
                if _MARK.encode() in raw:  # counts as a space
                    texts = [raw[a:b].replace(_MARK.encode(), b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    got, ends = lattice.encode_texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
                else:
                    got, ends = lattice.encode_texts(own, at)
                yield _result(batch.column(0).slice(i, j - i), (raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), got, ends, lattice.pieces)
                trim()

    return in_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, _RESULT)


def encode_best_path(docs: DataFrame, pieces: Pieces, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """encode() for a unigram model, by joins.

    Texts are dealt to blocks by a hash of doc_id and text; they cross one exchange, and
    everything behind it stays in its partition.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)
    longest = max(map(len, pieces.text))
    # One column, so that both readers of the exchange ask for the same.
    line = F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit("\t"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    lines = docs.select(line.alias("line"))
    plain = lines.agg(F.sum(F.octet_length("line"))).first()[0] or 0
    blocks = max(1, -(-plain // block_bytes))
    dealt = lines.withColumn("blk", F.pmod(F.xxhash64("line"), F.lit(blocks))).repartition(blocks, "blk")
    text = F.substr(F.col("line"), F.locate("\t", "line") + 1, F.char_length("line"))
    words = dealt.select("blk", F.explode(F.array_distinct(words_of(text))).alias("word")).distinct()
    edges = spans(words, pieces.table(spark), ["blk"], longest).groupBy("blk", "word").agg(F.collect_list(F.struct("e", "s", "score", "id")).alias("edges"))
    coded = edges.select(F.col("blk").alias("owner"), "word", best_path().alias("code"))
    cut = re.compile(_WORDS)

    def assemble(texts: pa.Table, coded: pa.Table) -> pa.Table:
        p: Pieces = shared.value
        code = dict(zip(coded.column("word").to_pylist(), coded.column("code").to_pylist(), strict=True))
        ids, bodies, got, ends = [], [], [], [0]
        for row in texts.column("line").to_pylist():
            head, _, body = row.partition("\t")
            ids.append(int(head) if head else None)
            bodies.append(body.encode())
            body = body.replace(_MARK, " ")
            for word in cut.findall(" " + body) if body else []:
                for k in code.get(word) or range(-1, -len(word) - 1, -1):  # no edges: nothing but bare characters
                    got += [k] if k >= 0 else p.bytes[list(word[-k - 1].encode())].tolist()
            ends.append(len(got))
        return pa.Table.from_batches([_result(ids, bodies, np.array(got, np.int64), np.array(ends), p)])

    return dealt.groupBy("blk").cogroup(coded.groupBy("owner")).applyInArrow(assemble, _RESULT)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of every row of encoded(doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model_path))

    def work(batches):
        for batch in batches:
            column = batch.column(1)
            ids, sizes = column.flatten().to_numpy(), column.value_lengths().fill_null(0).to_numpy()
            texts = [x.decode("utf-8", "replace") for x in decode_ids(shared.value, ids, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(work, "doc_id long, text string")
