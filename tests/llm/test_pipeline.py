"""The pipeline against a brute-force version, stage by stage, on its own small tables."""

import random
from collections import defaultdict

import corpus_pipeline
from lodestrata.llm import quality
from lodestrata.llm.common import crc_mod

from .test_dedup import LOWER, brute_join


def tables(spark, folder):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 6)))
    words = [word() for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [text(20) for _ in range(5)]
    docs = []
    for i in range(200):
        docs.append((i, text(60) if i % 5 else text(60).upper().replace(" ", "!! ")))
    docs += [(1000 + i, docs[i + 1][1].capitalize()) for i in range(0, 40, 5)]
    for i in range(2, 60, 5):
        w = docs[i][1].split()
        w[20] = "other"
        docs.append((2000 + i, " ".join(w)))
    docs += [(3000 + i, text(20) + " " + x + " " + text(20)) for i, x in enumerate(items)]
    docs += [(4000, None), (4001, ""), (7, docs[7][1])]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_pipeline(spark, tmp_path):
    sf = str(tmp_path)
    rows, items = tables(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), ~crc_mod("doc_id", 4).eqNullSafe(2))
    kept = [(r["doc_id"], r["text"] or "") for r in quality.score(docs, model).where("score >= 0.7").collect()]
    assert sum(t.isupper() for _, t in kept) <= 2 and len(kept) > 150
    groups = defaultdict(list)
    for i, t in kept:
        groups[t.translate(LOWER)].append((i, t))
    exact = [max(g) for g in groups.values()]
    classes = brute_join(exact)
    near = [(i, t) for i, t in exact if classes[i][0] == i]
    clean = {i: t for i, t in near if not any(x in t for x in items)}
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(clean)
    assert all(r["round_trip"] for r in out)
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
    assert not {3000 + k for k in range(5)} & set(clean)


def test_empty_table(spark, tmp_path):
    sf = str(tmp_path)
    tables(spark, sf + "/full")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/full/{t}.parquet").where("false").write.parquet(f"{sf}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{sf}/none").count() == 0
