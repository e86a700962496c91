"""License scans against a comparison of every block with every template."""

import random
import re

import pytest

from lodestrata.llm import license_scan

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text, templates=license_scan.TEMPLATES, percent=90):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    shares = {}
    for label, t in templates:
        tokens, span = set(t.split()), 1
        while span < len(t.split()):
            span *= 2
        for k in range(0, len(w), span):
            got = len(tokens & set(w[k : k + 2 * span]))
            if 100 * got >= percent * len(tokens):
                shares[label] = max(shares.get(label, 0), got / len(tokens))
    base = sorted({x for _, x in places})
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *shares})), 1.0 if places else max(shares.values(), default=0.0)


def scanned(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "k", 1, "b") for i, t in rows], "doc_id long, text string, key string, words int, blocks string")
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in license_scan.scan(df, **more).collect()), key=str)


def cases():
    r = random.Random(4)
    filler = ["the", "mit", "license", "of", "und", "Apache", "General", "public", "software", "Änderung", "it", "4", "0", "under", "free", "licensed", "any"]
    rows = [(1, None), (2, ""), (3, " -- "), (4, "MIT License"), (4, "MIT License"), (None, "mit license, Mit\nLICENSE mit-license"), (None, None), (5, "submit license mit licenses"), (6, "GNU General Public\nLicense and Apache license"), (7, "Ünder THE mit ücense"), (8, "İ mit license")]
    for k, (_, t) in enumerate(license_scan.TEMPLATES):
        w = t.split()
        rows.append((100 + k, "x " * k + " * ".join(w).title()))
        for _ in range(3):  # some words lost, others moved or put in between
            v = [x for x in w if r.random() < 0.95]
            for _ in range(r.randint(0, 8)):
                v.insert(r.randrange(len(v) + 1), r.choice(filler))
            rows.append((200 + k, " ".join([r.choice(filler) for _ in range(r.randint(0, 40))] + v)))
    rows += [(300 + k, " ".join(r.choice(filler) for _ in range(r.randint(1, 120)))) for k in range(60)]
    return rows


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_scan_is_that_of_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(license_scan, "PIECE_CHARS", piece)
    rows = cases()
    want = sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert scanned(spark, rows) == want
    assert sum(1 for x in want if x[6] != x[5]) >= 10


def test_other_templates_and_thresholds(spark):
    templates = [("a", "one two three four five six seven eight nine ten"), ("b", "two four six"), ("c", "one one one two")]
    r = random.Random(1)
    rows = [(k, " ".join(r.choice("one two three four five six seven eight nine ten other words here".split()) for _ in range(r.randint(0, 30)))) for k in range(80)]
    for percent in (50, 70, 100):
        assert scanned(spark, rows, templates=templates, percent=percent) == sorted(((i, *brute(t, templates, percent)) for i, t in rows), key=str)


def test_empty_table_and_blocks(spark):
    df = spark.createDataFrame([(1, "a b Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    assert license_scan.scan(df.limit(0)).count() == 0
    (row,) = license_scan.scan(df).collect()
    assert [tuple(b) for b in row["blocks"]] == [("cc", 12, 0, 16, 1.0)]
    with pytest.raises(ValueError):
        license_scan.scan(df, phrases=[("a b a", "x")])


def test_a_long_text(spark):
    """Texts beyond a piece: places and blocks behind the first million characters count too."""
    text = "word " * 500_000 + "Released under the MIT License. " + "y" * 2_000_000 + " licensed under cc by 4 0"
    (row,) = scanned(spark, [(1, text)])
    assert row == (1, 500_012, 1, 500_003, 500_003, "mit", "cc,mit", 1.0)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    from lodestrata.llm.common import materialise

    plan = license_scan.scan(materialise(df, "t"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
