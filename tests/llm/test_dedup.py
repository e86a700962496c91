import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import exact_dedup, ngram_join, suffix_dedup
from lodestrata.llm.components import components

from .conftest import odd_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("bits,capacity", [(64, 50_000), (3, 4)])
def test_exact_dedup_odd_cases(spark, bits, capacity):
    docs = odd_docs(spark)
    groups = defaultdict(list)
    for i, t in rows_of(docs):
        groups[t.translate(LOWER)].append(i)
    out = exact_dedup.exact_dedup(docs, hash_bits=bits, capacity=capacity).collect()
    assert len(out) == docs.count()
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in out:
        ids = by[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}
    rows = exact_dedup.exact_dedup_rows(docs, hash_bits=bits, capacity=capacity)
    assert rows.columns == docs.columns
    assert Counter(t.translate(LOWER) for _, t in rows_of(rows)) == Counter(groups.keys())


def test_exact_dedup_rows_of_one_doc_id(spark):
    docs = spark.createDataFrame([(5, "Abc", 1), (5, "aBC", 2), (5, "other", 3), (5, "other", 4), (4, "abc", 5), (None, "x", 6), (None, "X", 7), (None, "abc", 8)], "doc_id long, text string, _number int")
    for how in ({}, {"hash_bits": 1, "capacity": 1}):
        rows = exact_dedup.exact_dedup_rows(docs, **how)
        assert rows.columns == docs.columns
        assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in rows.collect()) == [(0, "x"), (5, "abc"), (5, "other")]
        assert exact_dedup.exact_dedup(docs, **how).where("kept").count() == 3


def test_lookups_go_through_the_directory(spark):
    docs = spark.createDataFrame([(i, f"text {i % 700}") for i in range(2000)], "doc_id long, text string")
    index = exact_dedup.Index(docs, capacity=20, depth=8)
    cells = index.cells.collect()
    assert max(r["entries"] for r in cells) <= 20 and {r["local_depth"] for r in cells} - {0}
    assert index.chains.count() == 700
    index.cells = index.cells.withColumn("bucket", F.col("bucket") + 1000)  # a directory that names other buckets finds nothing
    rows = index.addressed(docs.withColumn("body", F.col("text")), "body").withColumns({"text_sha256": F.sha2("body", 256), "n_bytes": F.octet_length("body").cast("long")})
    assert index.lookup(rows).count() == 0


def test_directory_splits_overfull_buckets(spark):
    entries = spark.range(4096).selectExpr("shiftleft(id, 52) AS h")
    d = exact_dedup.directory(entries, capacity=100, depth=8).collect()
    assert {r["local_depth"] for r in d} == {6} and all(r["entries"] <= 100 for r in d)
    hot = spark.range(1000).selectExpr("cast(1 as long) AS h")
    assert {r["local_depth"] for r in exact_dedup.directory(hot, capacity=100, depth=8).collect()} == {8}


def test_empty_tables(spark):
    docs = odd_docs(spark).where("false")
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert exact_dedup.exact_dedup_rows(docs).count() == 0
    assert ngram_join.ngram_join(docs).count() == 0
    assert suffix_dedup.suffix_dedup(docs).count() == 0


def brute_join(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", t.translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    nodes = {}
    for i in sorted(sets):
        nodes.setdefault(sets[i], i)
    nodes.pop(frozenset(), None)
    near = defaultdict(set)
    items = list(nodes.items())
    for a, (s, i) in enumerate(items):
        for t, j in items[a + 1 :]:
            if len(s & t) >= 0.8 * len(s | t) - 1e-9:
                near[i].add(j), near[j].add(i)
    cls = {}
    for i in sorted(nodes.values()):
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in cls:
                cls[x] = i
                stack += near[x]
    return {i: (cls[nodes[s]], len(near[nodes[s]])) if s else (i, 0) for i, s in sets.items()}


def test_ngram_join_against_brute_force(spark):
    docs = odd_docs(spark).where("doc_id is not null")
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs).collect()}
    assert out == brute_join(rows_of(docs))
    left = [i for i, _ in rows_of(ngram_join.ngram_join_rows(docs))]
    assert sorted(set(left)) == sorted({c for c, _ in out.values()})


def test_ngram_join_by_sets_not_by_ids(spark):
    """Texts without a doc_id, and two texts under one, keep their links."""
    base = [f"w{k}" for k in range(60)]

    def near(k):
        w = list(base)
        w[k] = "changed"
        return " ".join(w)

    first, middle, last = near(0), " ".join(base), near(59)
    other = "quite another text under the same number as one of these"
    for ids in ((1, 2, 9), (1, None, 9), (None, None, None)):
        for extra in ([], [(9, other)], [(9, other), (9, other), (None, "more")]):
            rows = list(zip(ids, (first, middle, last), strict=True)) + extra
            out = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
            assert sorted(r["n_links"] for r in out) == [0] * len(extra) + [2, 2, 2]
            assert sum(r["class_id"] == min((i for i in ids if i is not None), default=None) and r["n_links"] == 2 for r in out) == 3
            left = ngram_join.ngram_join_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
            assert sum(r["text"] in (first, middle, last) for r in left) == 1 and len(left) == 1 + len(extra)


def test_ngram_join_null_id_and_large_group(spark, monkeypatch):
    assert ngram_join.ngram_join(odd_docs(spark)).where("doc_id is null").count() == 1
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 2000)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(120):  # near copies of one text, in more than one block
        w = list(base)
        w[i % 95 + 2] = f"c{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs).collect()}
    assert out == brute_join(rows)


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}


def brute_cut(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = t.encode()
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if b[a : a + length] in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(b[a : a + length])
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_long_texts_and_words_of_one_hash(spark, monkeypatch):
    """Texts longer than a piece, and stretches that a polynomial hash can't tell apart."""
    monkeypatch.setattr(suffix_dedup, "SUB_BYTES", 1000)
    bits = [bin(k).count("1") & 1 for k in range(4096)]
    one, two = ("".join(x[b] for b in bits) for x in ("et", "te"))
    r = random.Random(4)
    noise = "".join(r.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, noise), (2, noise[3000:7000] + "x" * 2500), (3, one), (4, two), (5, "start " + one + two), (6, two + noise[1:800])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(x) for x in suffix_dedup.suffix_dedup(docs).collect()) == sorted(brute_cut(rows))


@pytest.mark.parametrize("hot", [50_000, 2])
def test_suffix_dedup_against_brute_force(spark, hot):
    docs = odd_docs(spark)
    line = "all rights are reserved by somebody who is not named here, and nothing of this may be copied at all, not ever. "
    extra = spark.createDataFrame([(400 + i, f"{i} " + line * (1 + i % 3) + "a" * (i * 40)) for i in range(8)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionAll(extra).coalesce(1)
    got = [tuple(r) for r in suffix_dedup.suffix_dedup(docs, hot=hot).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute_cut(rows_of(docs)), key=key)
    texts = suffix_dedup.suffix_dedup(docs, with_text=True).select("kept", "kept_sha256").collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in texts)


@pytest.mark.parametrize("unit", ["x", "the same line over and over;\n"])
def test_suffix_dedup_of_one_byte_or_line_over_and_over(unit):
    """A few rows go to the owners, and 6 MB of one byte take some hundred MB, not GB."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np
from lodestrata.llm import suffix_dedup as S
unit = sys.argv[1].encode()
data = np.frombuffer(unit * ((6 << 20) // len(unit)), np.uint8)
off, before = np.array([0, len(data)]), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = S.Anchored(data, off)
keys, totals = found.keys()
s, marks = S.block_stretches(data, off, np.array([5]), found, keys, totals)
assert len(s.c["key"]) == len(unit) and len(marks) == 1, (len(s.c["key"]), len(marks))
left, at, removed, spans = S.cut(data, off, marks.astype(np.int64))
assert removed[0] == len(data) - len(unit), (removed, len(data))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code, unit], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 600
