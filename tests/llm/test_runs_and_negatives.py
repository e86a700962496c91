"""Periodic runs and hard negatives against brute force."""

import hashlib
import random

import numpy as np
import pytest

from lodestrata.llm import hard_negatives, periodic_runs, queries

SF = "/root/testdata/sf0.001"


def naive_runs(w, least):
    """start, end, smallest period by comparing every shift; w is an array."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], w[:-p] == w[p:], [False]]).astype(np.int8)
        edge = np.diff(same)
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if j - i >= p and j + p - i >= least:
                out.setdefault((i, j + p), p)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda x: (x[0], x[2]))


def words_of(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text or "")


def collapsed(words, runs):
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_all_runs_of_random_words():
    r = random.Random(5)
    for round_ in range(300):
        docs = []
        for _ in range(r.randint(1, 5)):
            k = r.choice([1, 2, 2, 3, 5])
            d = [r.randrange(k) for _ in range(r.choice([0, 1, 2, 12, 13, 40, 150]))]
            if r.random() < 0.5:
                d = d[: len(d) // 2] + [r.randrange(k) for _ in range(r.randint(1, 9))] * r.randint(2, 9) + d[len(d) // 2 :]
            docs.append(d * r.choice([1, 1, 2]) + (docs[-1] if docs and r.random() < 0.3 else []))
        bounds = np.cumsum([0, *map(len, docs)])
        for least in (2, 12):
            got = periodic_runs.all_runs(np.array([x for d in docs for x in d], np.int32), bounds, least).tolist()
            want = [[s + b, e + b, q] for d, b in zip(docs, bounds.tolist(), strict=False) for s, e, q in naive_runs(np.array(d), least)]
            assert got == want


def test_thin_tables_and_small_chunks(monkeypatch):
    for name, value in (("PAIRS", 31), ("THIN", 1), ("JUMPS", 0), ("WORD_BLOCK", 64), ("LONG_WORD", 4)):
        monkeypatch.setattr(periodic_runs, name, value)
    test_all_runs_of_random_words()
    r = random.Random(2)
    for _ in range(50):
        words = [r.choice(["a", "bb", "longer", "much-longer-one", "ünïcode"]) for _ in range(r.randint(0, 60))]
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, _ = periodic_runs.word_spans(data, np.array([0, len(data)]))
        got = periodic_runs.word_numbers(data, starts, ends).tolist()
        assert [[got[i] == got[j] for j in range(len(words))] for i in range(len(words))] == [[x == y for y in words] for x in words]


def test_runs_of_odd_texts(spark):
    unit = "uno due tre quattro "
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, unit * 5), (4, unit * 5), (None, "x " * 20), (5, "a  b\tc\n" * 4 + "d"), (6, "é ü 日本 😀 " * 6), (7, "w" * 100_000 + " "), (8, ("w" * 70_000 + " ") * 13)]
    df = spark.createDataFrame([(a, b, "l", 1, "c") for a, b in rows], "doc_id long, text string, runs string, start int, collapsed string")
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(df).collect())
    want = []
    for i, t in rows:
        w = words_of(t)
        names = {x: k for k, x in enumerate(dict.fromkeys(w))}
        runs = naive_runs(np.array([names[x] for x in w], int), 12)
        want.append((str(i), len(w), [(s, e - s, q) for s, e, q in runs], collapsed(w, runs)))
    assert got == sorted(want)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_long_texts_of_one_word_and_one_line():
    n = 1_000_000
    assert periodic_runs.all_runs(np.zeros(n, np.int32), np.array([0, n])).tolist() == [[0, n, 1]]
    line = np.arange(n, dtype=np.int32) % 9
    assert periodic_runs.all_runs(line, np.array([0, n])).tolist() == [[0, n, 9]]


def test_op12_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r.asDict() for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for i, t in docs.items():
        w = words_of(t)
        w = [w[k] for k in queries.planted(i, len(w))]
        names = {x: k for k, x in enumerate(dict.fromkeys(w))}
        runs = naive_runs(np.array([names[x] for x in w], int), 12)
        some += len(runs)
        best = max(((e - s, -s, -q) for s, e, q in runs), default=None)
        want = {"doc_id": i, "n_runs": len(runs), "start": best and -best[1], "length": best and best[0], "period": best and -best[2], "exponent_milli": best and 1000 * best[0] // -best[2]}
        want["runs_sha256"] = hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()).hexdigest()
        want["collapsed_sha256"] = hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        assert got[i] == want, i
    assert some > 20


def naive_negatives(rows, positives=5, negatives=5):
    """rows: id, label, vector, anchor or not; the contract's rules by loops."""
    import math

    rows = [(i, lab, [math.floor(256 * float(x)) for x in v], a) for i, lab, v, a in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    last = lambda i: (i is None, i or 0)
    for k, (i, lab, v, anchor) in enumerate(rows):
        if not anchor or i is None:
            continue
        scored = [(sum(x * y for x, y in zip(v, u, strict=False)), j, other) for m, (j, other, u, _) in enumerate(rows) if m != k]
        best = lambda some, n: sorted(some, key=lambda x: (-x[0], last(x[1])))[:n]
        for p, j, _ in best([x for x in scored if x[2] == lab], positives):
            found = best([x for x in scored if x[2] != lab and 80 * p <= 100 * x[0] <= 100 * p], negatives)
            out += [(i, j, rank + 1, x[1], p, x[0]) for rank, x in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_of_odd_vectors(spark, monkeypatch, seed):
    from pyspark.sql import functions as F

    r = random.Random(seed)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 64)
    rows = []
    for k in range(400):
        size = r.choice([0.05, 0.5, 1, 3])
        v = [r.gauss(0, size) + (0.4 if x < 3 else 0) for x in range(8)]
        rows.append((k, r.randrange(3), v))
    hot = rows[5][2]
    rows += [(500 + k, 1 + k % 2, hot) for k in range(150)] + [(500, 1, hot), (500, 2, hot)]  # one vector, and rows that repeat
    rows += [(700, None, hot), (None, 1, hot), (701, 1, None), (702, 1, [None] * 8), (703, 2, [float("nan")] * 8), (704, 2, [float("inf")] * 8), (800, 1, []), (900, 2, [0.0] * 8), (901, 1, hot[:3]), (1000, 7, hot), (902, 1, [300_000.0, *hot[1:]])]
    df = spark.createDataFrame([(*x, "a", 1) for x in rows], "vec_id long, label int, embedding array<double>, pos string, q int")
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()
    want = naive_negatives([(i, lab, v, i is not None and i % 100 == 0) for i, lab, v in rows])
    assert sorted(map(tuple, got), key=str) == want and len(want) > 20
    assert hard_negatives.mine(df.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.mine(df.where("label = 7"), F.lit(True)).count() == 0


def test_pruned_buckets_change_nothing(spark):
    """Buckets whose length bound lies below every limit are skipped, so their rows are never compared."""
    r = np.random.default_rng(3)
    a = {"norms": np.array([2.0]), "q": np.array([[2, 0]]), "labels": np.array([1]), "rows": np.array([0])}
    q = r.integers(-3, 4, (50, 2))
    b = {"norms": np.sqrt((q**2).sum(1)), "q": q, "labels": np.full(50, 2), "rows": np.arange(1, 51), "ids": np.arange(50), "known": np.ones(50, bool)}
    reach = int(2 * b["norms"].max())
    assert len(hard_negatives.best_of_pair(a, b, np.array([[reach + 2]]), np.array([[1 << 40]]), 5, False)[0]) == 0
    pos, w, score, row = hard_negatives.best_of_pair(a, b, np.array([[1]]), np.array([[4]]), 5, False)
    s = q @ np.array([2, 0])
    assert sorted(score.tolist()) == sorted(sorted((x for x in s.tolist() if 1 <= x <= 4), reverse=True)[:5])
