"""Token counts by a compiled finite-state transducer.

The tokenizer is a SentencePiece BPE model.  Its merge rules are compiled into a
deterministic transducer over characters; the library itself isn't asked.  It rests on two
facts about merging by rank: without its last token the encoding of a string is the
encoding of a shorter one, and tokens are an encoding if and only if merging any two neighbours
u + v by themselves gives u, v again.  So the last token of a prefix is the one piece at its end
that may stand behind the last token of what precedes it.

A state is what later tokens depend on: for each end of the text read so far that begins
a piece, the last token before it and how many tokens have come since then.  A transition
emits the change in the number of tokens, which a merge may lower; the sum along a path is the
count.  Transitions are determinised when a text first takes them, and forgotten all at
once when there are more than MAX_TRANSITIONS, which costs time but changes no count.

Pieces never hold a space behind another character, nor a line feed, so the
state behind such a border is the start state and equal segments of a batch are run once.

Texts of more than CHUNK_BYTES are dealt out in chunks, as rows of other tasks.  A chunk is
a map between states: the characters up to its first border, for which the state in
which it is entered counts, then a number of tokens and the state it is left in, whatever
came before.  Such maps compose associatively; a pairwise scan joins those of a text.

Null and empty texts have no tokens.  Repeated rows are counted each by
itself, an empty table gives an empty result, and columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_spans, in_batches, sub_blocks, text_bytes

#: Transitions that a worker keeps at most.
MAX_TRANSITIONS = 400_000
#: Bytes of the longest text that is counted in one piece, and characters of a chunk of a longer one.
CHUNK_BYTES = 1 << 20

#: Characters of a segment whose state is kept.
JUMP = 6
#: Bytes of text whose equal segments are run once.
BATCH_BYTES = 4 << 20

_SP, _LF = 0x20, 0x0A
_MARK = "▁"
_workers: dict[str, Transducer] = {}


@dataclass
class ChunkMap:
    """What a chunk does to a state: run `head`, then (if there is a border) emit `count` and be in `exit`."""

    head: str
    last: str  # its last character
    count: int = 0
    exit: tuple | None = None  # None: no border in it


class Transducer:
    """Deterministic transducer over characters, compiled from the merge rules of a model."""

    def __init__(self, model_path: str, max_transitions: int = MAX_TRANSITIONS):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = m.get_piece_size()
        real = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.rank = {m.id_to_piece(i).replace(_MARK, " "): -m.get_score(i) for i in real}
        if not all(x.is_integer() for x in self.rank.values()) or sum(m.is_byte(i) for i in range(n)) != 256 or any(m.is_unused(i) for i in real):
            raise ValueError("only BPE models with bytes for unknown characters can be compiled")
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.rank):
            raise ValueError("pieces that cross segment borders: this tokenizer can't be compiled")
        if m.normalize("ﬁ  a") != "▁ﬁ▁▁a":
            raise ValueError("a normalising tokenizer can't be compiled")
        self.begins = {p[:k]: p[:k] for p in self.rank for k in range(1, len(p))}
        self.max_transitions = max_transitions
        self.parts: dict[str, tuple[str, str]] = {}  # by piece, as many as there are pieces
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.jumps: dict[str, tuple[int, int]] = {}
        self.transitions = 0
        self.start = self.state(("", None, 0))

    def state(self, key: tuple) -> int:
        """Number of a state; its key has (end of the text, token before it, tokens since then), longest first, in one row."""
        q = self.numbers.get(key)
        if q is None:
            q = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        return q

    def halves(self, piece: str) -> tuple[str, str]:
        """The two tokens whose merge makes a piece: the neighbours of least rank merge, leftmost first, until two are left."""
        got = self.parts.get(piece)
        if got is None:
            parts = list(piece)
            while len(parts) > 2:
                i = min((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            got = self.parts[piece] = (parts[0], parts[1])
        return got

    def stand(self, u: str, v: str) -> bool:
        """Whether u, v may be neighbours: no merge across their border comes before those that make them.

        Their last merges are undone, the latest first; the parts that then meet at the border must not
        merge sooner than they go into what was undone (of equal ranks the leftmost is the sooner).
        """
        rank = self.rank
        until_u = until_v = math.inf
        while True:
            across = rank.get(u + v)
            if across is not None and across < until_u and across <= until_v:
                return False
            made_u, made_v = rank[u] if len(u) > 1 else -1.0, rank[v] if len(v) > 1 else -1.0
            if made_u > made_v:
                until_u, u = made_u, self.halves(u)[1]
            elif made_v >= 0:
                until_v, v = made_v, self.halves(v)[0]
            else:
                return True

    def compile(self, q: int, x: str) -> tuple[int, int]:
        """Transition of state q by x: the next state and the change in the number of tokens."""
        key = self.keys[q]
        if self.transitions >= self.max_transitions:
            self.reset()
            q = self.state(key)
        token, change, open_ = None, 0, []
        for end, before, since in zip(key[::3], key[1::3], key[2::3], strict=True):
            end += x
            if token is None and (end in self.rank or len(end) == 1) and (before is None or self.stand(before, end)):
                token, change = end, (1 if end in self.rank else len(end.encode())) - since
            begin = self.begins.get(end)
            if begin is not None:
                open_.append((begin, before, since))
        new = [y for end, before, since in open_ for y in (end, before, since + change)]
        out = self.next[q][x] = self.state((*new, "", token, 0)), change
        self.transitions += 1
        return out

    def run(self, q: int, text: str) -> tuple[int, int]:
        """State behind the text, which has no border inside, and the tokens it emits."""
        n, steps = 0, self.next
        for x in text:
            step = steps[q].get(x)
            if step is None:
                step = self.compile(q, x)
                steps = self.next
            q, change = step
            n += change
        return q, n

    def tokens(self, segment: str) -> int:
        """Tokens of a segment; many begin alike, so the way of the first JUMP characters is kept."""
        head = segment[:JUMP]
        at = self.jumps.get(head)
        if at is None:
            at = self.run(self.start, head)
            if len(self.jumps) >= self.max_transitions:
                self.jumps = {}
            self.jumps[head] = at
        return at[1] + self.run(at[0], segment[JUMP:])[1]

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each segment; equal ones are run once."""
        if not len(starts):
            return np.zeros(0, np.int64)
        first, inverse = distinct_spans(data, starts, ends)
        raw = data.tobytes()
        return np.array([self.tokens(raw[a:b].decode()) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.int64)[inverse]

    # Chunks as maps between states.

    def chunk_map(self, chunk: str) -> ChunkMap:
        data = np.frombuffer(chunk.encode(), np.uint8)
        cuts = np.flatnonzero(borders(data)[1:]) + 1
        if not len(cuts):
            return ChunkMap(chunk, chunk[-1])
        raw = data.tobytes()
        inside = int(self.count(data, cuts[:-1], cuts[1:]).sum())
        q, n = self.run(self.start, raw[cuts[-1] :].decode())
        return ChunkMap(raw[: cuts[0]].decode(), chunk[-1], inside + n, self.keys[q])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a chunk and the one behind it."""
        between = _border(a.last, b.head[0])
        if a.exit is None and not between:
            return ChunkMap(a.head + b.head, b.last, b.count, b.exit)
        q, n = self.run(self.start if between else self.state(a.exit), b.head)
        if b.exit is None:
            return ChunkMap(a.head, b.last, a.count + n, self.keys[q])
        return ChunkMap(a.head, b.last, a.count + n + b.count, b.exit)

    def scan(self, maps: list[ChunkMap]) -> int:
        """Tokens of a text by pairwise composition of its chunks' maps."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return sum(self.tokens(m.head) + m.count for m in maps)


def compiled(model_path: str) -> Transducer:
    """This worker's transducer, which goes on from task to task."""
    if model_path not in _workers:
        _workers[model_path] = Transducer(model_path)
    return _workers[model_path]


def borders(data: np.ndarray) -> np.ndarray:
    """Where a segment begins: at a space behind another byte, and on either side of a line feed."""
    out = np.zeros(len(data), bool)
    if len(data):
        out[0] = True
        lf = data == _LF
        out[1:] = (data[1:] == _SP) & (data[:-1] != _SP) | lf[1:] | lf[:-1]
    return out


def _border(a: str, b: str) -> bool:
    return b == " " != a or "\n" in (a, b)


def count_batch(tr: Transducer, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Tokens of each string of a batch."""
    out = np.zeros(len(off) - 1, np.int64)
    for i, j in sub_blocks(off, BATCH_BYTES):
        part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
        if _MARK.encode() in part.tobytes():  # the space mark itself counts as a space
            texts = [part[a:b].tobytes().replace(_MARK.encode(), b" ") for a, b in zip(at, at[1:], strict=False)]
            part, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            continue
        # The tokenizer's own space before each text that isn't empty.
        begin = at[:-1][full] + np.arange(len(full))
        spaced = np.full(len(part) + len(full), _SP, np.uint8)
        body = np.ones(len(spaced), bool)
        body[begin] = False
        spaced[body] = part
        edge = borders(spaced)
        edge[begin] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(spaced))
        tokens = tr.count(spaced, starts, ends)
        out[i + full] = np.add.reduceat(tokens, np.searchsorted(starts, begin))
    return out


_COUNTS = "doc_id long, n_bytes long, n_tokens long"


def count_long(docs: DataFrame, model_path: str, chunk_chars: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens of texts that aren't empty, by a scan over chunks that are rows of their own."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in enumerate(batch.column(2)):
                text = value.as_py()
                n_bytes, text = len(text.encode()), " " + text.replace(_MARK, " ")
                for pos, at in enumerate(range(0, len(text), chunk_chars)):
                    own = [pa.array([n_bytes], pa.int64()), pa.array([pos], pa.int32()), pa.array([text[at : at + chunk_chars]])]
                    yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:2]), *own], ["doc_id", "row", "n_bytes", "pos", "chunk"])

    chunks = rows.mapInArrow(cut, "doc_id long, row long, n_bytes long, pos int, chunk string")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tr = compiled(model_path)
        for batch in batches:
            found = [tr.chunk_map(x.as_py()) for x in batch.column(4)]
            own = [pa.array(x, t) for x, t in (([m.head for m in found], pa.string()), ([m.last for m in found], pa.string()), ([m.count for m in found], pa.int64()), ([m.exit and json.dumps(m.exit) for m in found], pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *own], ["doc_id", "row", "n_bytes", "pos", "head", "last", "count", "exit"])

    def scan(table: pa.Table) -> pa.Table:
        own = [ChunkMap(r["head"], r["last"], r["count"], r["exit"] and tuple(json.loads(r["exit"]))) for r in sorted(table.to_pylist(), key=lambda r: r["pos"])]
        return table.select(["doc_id", "n_bytes"]).slice(0, 1).append_column("n_tokens", pa.array([compiled(model_path).scan(own)], pa.int64()))

    mapped = chunks.repartition("row", "pos").mapInArrow(maps, "doc_id long, row long, n_bytes long, pos int, head string, last string, count long, exit string")
    return mapped.groupBy("row").applyInArrow(scan, _COUNTS)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tr = compiled(model_path)
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(count_batch(tr, data, off))], ["doc_id", "n_bytes", "n_tokens"])

    rows = in_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.octet_length("text") > max(1, chunk_bytes)
    out = rows.where(~long).mapInArrow(work, _COUNTS).unionAll(count_long(rows.where(long), model_path, max(1, chunk_bytes)))
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
