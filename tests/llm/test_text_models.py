import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import language_id, piece_lattice, quality, queries, suffix_tree, token_counts
from lodestrata.llm.common import crc_mod

from .conftest import odd_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = queries.tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(n=400):
    r = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "▁", "the", " the", "\t", "\r", "㈱", "😀", "<s>", "x", ".", ",", " " * 20, "y" * 70, "0" * 33]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", " ", "\n", " " * 100, "z" * 1000]


def test_token_counts_match_the_library(spark, library):
    rows = list(enumerate([*odd_texts(), None]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, MODEL, limit=5).collect()}
    for i, t in rows:
        n = len(library.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["over_limit"], got[i]["n_bytes"]) == (n, n > 5, len((t or "").encode()))
    assert token_counts.token_counts(docs.where("false"), MODEL).count() == 0
    assert token_counts.token_counts(odd_docs(spark), MODEL).count() == odd_docs(spark).count()


def thue_morse(n, a, b):
    """A word and its complement, which a polynomial hash modulo a power of two can't tell apart."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


COLLIDING = [w for n in (1024, 4096) for w in thue_morse(n, "e", "t")]


def test_chunk_maps_compose(library):
    for limit in (50, 100_000):  # the table is forgotten again and again, or never
        tr = token_counts.Transducer(MODEL, limit)
        for t in odd_texts(150):
            if t:
                text = " " + t.replace("▁", " ")
                assert tr.scan([tr.chunk_map(text[k : k + 7]) for k in range(0, len(text), 7)]) == len(library.encode(t)), repr(t)
                assert len(tr.keys) <= limit + 2


def test_long_texts_are_scanned_in_chunks(spark, library):
    r = random.Random(8)
    texts = [x * 7 for x in odd_texts(60)] + ["".join(r.choice("abc de\n") for _ in range(3000)), "q" * 2000, *COLLIDING]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = token_counts.token_counts(docs, MODEL, chunk_bytes=64)
    assert sorted((x["doc_id"], x["n_bytes"], x["n_tokens"]) for x in got.collect()) == sorted((i // 2, len(t.encode()), len(library.encode(t))) for i, t in enumerate(texts))


def test_words_of_one_hash(spark, library):
    docs = spark.createDataFrame([(0, " ".join(COLLIDING)), *enumerate(COLLIDING, 1)], "doc_id long, text string")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert [r["n_tokens"] for r in token_counts.token_counts(docs, MODEL).orderBy("doc_id").collect()] == [len(library.encode(t)) for t in texts]
    assert [r["ids"] for r in piece_lattice.encode(docs, MODEL).orderBy("doc_id").collect()] == [library.encode(t) for t in texts]
    scored = suffix_tree.language_model_scores(docs, F.lit(False)).orderBy("doc_id").collect()
    c, n, v = Counter(w for t in texts for w in t.split()), 13, 5
    assert [r["n_known"] for r in scored] == [5, 2, 2, 2, 2]
    for t, row in zip(texts, scored, strict=True):
        assert row["base_score"] == pytest.approx(sum(math.log10((k + 0.5) / (n + 0.5 * (v + 1))) for k in [*(c[w] for w in t.split()), 5]))
    assert token_counts.token_counts(spark.createDataFrame([(1, " ".join(COLLIDING[:2]) * 3)], "doc_id long, text string"), MODEL).first()["n_tokens"] == len(library.encode(" ".join(COLLIDING[:2]) * 3))


def test_encoding_matches_the_library_and_round_trips(spark, library):
    rows = list(enumerate([*odd_texts(), None]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = piece_lattice.encode(docs, MODEL)
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in rows:
        assert got[i]["ids"] == library.encode(t or ""), repr(t)
        assert got[i]["round_trip"] == ("▁" not in (t or "")) and got[i]["n_pieces"] == len(got[i]["ids"])
    back = {r["doc_id"]: r["text"] for r in piece_lattice.decode(out, MODEL).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)
    assert piece_lattice.encode(docs.where("false"), MODEL).count() == 0
    assert piece_lattice.encode(odd_docs(spark), MODEL).where("round_trip").count() == odd_docs(spark).count()


def test_best_path_against_brute_force(spark):
    table = {" a": -1.5, " ab": -2.25, "b": -1.0, "c": -1.75, "bc": -2.5, "abc": -3.0, " ": -0.5, "a": -2.0, "\n": -1.0, "cc": -2.0}
    plain = [x.encode() for x in table]
    pieces = piece_lattice.Pieces([x.replace(" ", "▁") for x in table], list(range(len(table))), list(table.values()), np.arange(100, 356, dtype=np.int32), plain + [b""] * (100 - len(plain)) + [bytes([b]) for b in range(256)], False)

    def best(word):
        ways = {0: (0.0, ())}
        for e in range(1, len(word) + 1):
            options = [(ways[s][0] + table[word[s:e]], -s, ways[s][1] + (list(table).index(word[s:e]),)) for s in range(e) if word[s:e] in table]
            options.append((ways[e - 1][0] + piece_lattice.UNKNOWN, 1 - e, ways[e - 1][1] + tuple(100 + b for b in word[e - 1].encode())))
            top = max(options, key=lambda o: o[:2])
            ways[e] = (top[0], top[2])
        return list(ways[len(word)][1])

    r = random.Random(5)
    texts = ["".join(r.choice("abc \né") for _ in range(r.randint(0, 12))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in piece_lattice.encode_best_path(docs, pieces, block_bytes=200).collect():
        t = texts[row["doc_id"]] or ""
        words = re.findall(piece_lattice._WORDS, " " + t) if t else []
        assert row["ids"] == [x for w in words for x in best(w)], repr(t)
        assert row["round_trip"]


def test_language_model(spark):
    docs = odd_docs(spark)
    held = crc_mod("doc_id", 5).eqNullSafe(1)
    out = suffix_tree.language_model_scores(docs, held).collect()
    rows = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in docs.collect()]
    tokens = [(i, re.findall(r"[^\x20\x09-\x0d]+", t) + [None]) for i, t in rows]
    away = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ts in tokens if not away(i) for w in ts)
    n, v = sum(c.values()), len(c)
    want = sorted(((i is None, i or 0), away(i), len(ts), sum(c[w] > 0 for w in ts), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), 6)) for i, ts in tokens)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert got == want
    assert all(r["score"] < 0 for r in out)
    assert suffix_tree.language_model_scores(docs.where("false"), held).count() == 0


def test_language_model_beats_the_base_on_held_out_texts(spark):
    # It takes some megabytes of training text: on 2.4 MB (sf0.01) word counts are still ahead.
    out = queries.op4_suffix_tree(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def slow_tree(texts, depth, least, gain, weight):
    """The same tree by dictionaries: probability of a byte after a history."""
    counts: dict[bytes, Counter] = {}
    for t in texts:
        b = b"\n" * depth + t
        for k in range(depth, len(b)):
            for d in range(depth + 1):
                counts.setdefault(b[k - d : k], Counter())[b[k]] += 1
    counts = {c: x for c, x in counts.items() if not c or sum(x.values()) >= least}
    root = {a: (counts.get(b"", Counter())[a] + 0.5) for a in range(256)}
    total = sum(root.values())
    full = {b"": {a: x / total for a, x in root.items()}}
    keep = set()
    for c in sorted((c for c in counts if c), key=len):
        n = sum(counts[c].values())
        full[c] = {a: (k + weight * full[c[1:]][a]) / (n + weight) for a, k in counts[c].items()}
        if n * sum(p * math.log(p / full[c[1:]][a]) for a, p in full[c].items()) >= gain:
            keep |= {c[i:] for i in range(len(c))}

    def log(history, a):
        c = next((history[-d:] for d in range(depth, 0, -1) if history[-d:] in keep), b"")
        out = 0.0
        while c:
            if a in full[c]:
                return out + math.log10(full[c][a])
            out += math.log10(weight / (sum(counts[c].values()) + weight))
            c = c[1:]
        return out + math.log10(full[b""][a])

    return log


def test_tree_against_dictionaries(spark):
    from lodestrata.llm.blocks import pack
    from lodestrata.llm.common import text_bytes

    import pyarrow as pa

    docs = odd_docs(spark).where("doc_id < 300")
    texts = [b" ".join(r["text"].translate(LOWER).encode().split()) + b"\n" for r in docs.collect()]
    blocks = pack(docs, F.lit(False))
    tree = suffix_tree.build_tree(suffix_tree.count_windows(blocks, 3), 3, 1e-6, 4, 2.0, 3.0)
    log = slow_tree(texts, 3, 4, 2.0, 3.0)
    probe = ["abc def", "", "changed a b", texts[0].decode()]
    got = suffix_tree.score_texts(tree, *text_bytes(pa.array(probe)))
    for t, g in zip(probe, got, strict=True):
        b = b"\n\n\n" + b" ".join(t.encode().split()) + b"\n"
        assert g == pytest.approx(sum(log(b[:k], b[k]) for k in range(3, len(b))), abs=1e-9)


@pytest.mark.parametrize("gain", [-1e9, 2.0])
def test_tree_by_key_ranges_is_the_tree_in_one_place(spark, monkeypatch, gain):
    from lodestrata.llm.blocks import answers, pack, unpack, unpack_ints

    import pyarrow as pa

    monkeypatch.setattr(suffix_tree, "PASS_WINDOWS", 50)
    docs = odd_docs(spark).where("doc_id < 300").repartition(3)
    blocks = pack(docs, F.col("doc_id") % 4 == 1).cache()
    tree = suffix_tree.build_tree(suffix_tree.count_windows(blocks, 4), 4, 0.0, 4, gain, 3.0, suffix_tree.TOP)
    seen = 0
    for r in blocks.join(answers(suffix_tree.window_scores(blocks, 5, 4, 4, gain, 3.0)), "blk").collect():
        data, off = unpack(pa.array([r["sizes"]], pa.list_(pa.int32()))[0], pa.scalar(bytes(r["body"])))
        scores = np.concatenate([unpack_ints(bytes(x["totals"])) for x in r["answers"]]).astype(np.uint32).view(np.float32)
        assert suffix_tree.block_scores(scores, data, off, 4) == pytest.approx(suffix_tree.score_texts(tree, data, off), rel=1e-5)
        seen += len(off) - 1
    assert seen == docs.count()


def test_rare_contexts_count_in_a_large_corpus(spark):
    """A passage seen 12 times is as well known among 16 MB of other text as a share of 1e-6 (16 times) would forget it."""
    r = random.Random(3)
    letters = "bcdfghjklmnpqrstvw"
    noise = ["".join(r.choice(letters + " ") for _ in range(1 << 14)) for _ in range(64)]
    rows = [(i, " ".join(noise[(i * k) % 64] for k in (1, 3, 5, 7))) for i in range(0, 1300, 5)]
    rows += [(i, "zyxzyx aeiou uoiea") for i in range(2000, 2013)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in suffix_tree.language_model_scores(docs, F.col("doc_id") == 2000).where("doc_id = 2000").collect()}
    assert got[2000] > -11


def corpus(spark, n=300):
    r = random.Random(7)
    words = {"en": ["the", "and", "thing", "ought"], "de": ["und", "über", "nicht", "schön"], "fr": ["le", "été", "où", "ça"]}
    rows = []
    for i in range(n):
        lang = list(words)[i % 3]
        good = i % 4 != 0
        t = " ".join(r.choice(words[lang]) for _ in range(40))
        rows.append((i, t if good else t.upper().replace(" ", "!! "), lang, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_language_id(spark):
    docs = corpus(spark)
    held = crc_mod("doc_id", 4).eqNullSafe(2)
    model = language_id.train(docs, ~held)
    out = language_id.predict(docs, model).join(docs, "doc_id").where(held)
    assert out.where("lang_pred != lang").count() == 0
    odd = {r["doc_id"]: r for r in language_id.predict(odd_docs(spark), model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (300, 301, 302, 308))
    assert odd[306]["lang_pred"] in model.languages and 0 <= odd[306]["score"] <= 1
    empty = language_id.train(docs.where("false"), ~held)
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(docs.where("false"), model).count() == 0


def slow_language(model, text):
    """Posterior of one text, n-gram by n-gram."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    chars = [c.lower() if ord(c) < 0x250 and len(c.lower()) == 1 else c for c in text]
    total = model.prior.astype(float).copy()
    m = (1 << 64) - 1
    for n in model.lengths:
        for k in range(len(chars) - n + 1):
            h = n * 0x9E3779B97F4A7C15 & m
            for c in chars[k : k + n]:
                h = (h ^ ord(c)) * 0x9FB21C651E98DF25 & m
                h ^= h >> 29
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                h = (h ^ h >> shift) * factor & m
            total += model.log_probability[h >> 64 - model.bits]
    best = int(total.argmax())
    return model.languages[best], 1 / np.exp(total - total[best]).sum()


def test_language_id_against_brute_force(spark):
    docs = corpus(spark, 60)
    model = language_id.train(docs, F.lit(True))
    # Training: every n-gram of every text counted by hand, for the most frequent letter.
    texts = [t for t in odd_texts(60) if "▁" not in t] + ["the thing ought", "über schön", "où été ça", None, "12 ."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language_id.predict(frame, model).collect():
        lang, p = slow_language(model, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(p, rel=1e-4), repr(texts[r["doc_id"]])


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MATRIX_CELLS", 1 << 12)
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 26) * 9} {chr(97 + i // 26 % 26) * 9}", f"l{i}") for i in range(600)], "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    assert len(model.languages) == 600 and model.log_probability.size <= 1 << 12


def test_quality_against_brute_force(spark):
    import zstandard

    docs = corpus(spark)
    model = quality.fit(docs, docs.select("doc_id", "quality"), F.lit(True))
    assert 0 < len(model.good) <= quality.DICTIONARY_BYTES and 0 < len(model.bad) <= quality.DICTIONARY_BYTES
    by = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for x in (model.good, model.bad)]
    texts = ["the and thing ought " * 700, "THE!! AND!! ", "", None, "où été"]
    for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        good, bad = (sum(len(c.compress(raw[k : k + 4096])) - 6 for k in range(0, len(raw), 4096)) for c in by)
        x = [(bad - good) / (bad + good), (bad + good) / (2 * len(raw))] if raw else model.mean
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale, strict=True))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_quality(spark):
    docs = corpus(spark)
    labels = docs.select("doc_id", "quality").unionAll(spark.createDataFrame([(None, 1), (1, None), (99999, 0)], "doc_id long, quality int"))
    held = crc_mod("doc_id", 4).eqNullSafe(2)
    model = quality.fit(docs, labels, ~held)
    out = quality.score(docs.drop("lang"), model).where(held)
    assert out.where("(score >= 0.7) != (quality = 1)").count() <= 0.05 * out.count()
    odd = quality.score(odd_docs(spark), model)
    assert odd.count() == odd_docs(spark).count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    flat = quality.fit(docs, labels.where("quality = 1"), ~held)
    assert quality.score(docs, flat).where("score < 0.99").count() == 0
    assert quality.score(docs.where("false"), model).count() == 0
