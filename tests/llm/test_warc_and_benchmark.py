import base64
import hashlib
import re

from lodestrata.llm import decontaminate, queries, warc

from .conftest import odd_docs


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 300)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 700)
    rows = [(i, f"http://x/{i}", f"<p>{i % 7} é</p>" * (i % 5)) for i in range(60)] + [(100, None, None), (101, "a\r\nb", ""), (None, "u", "<p>3 é</p>"), (5, "http://x/5", "<p>5 é</p>" * 0), (5, "http://x/5", "other"), (None, "v", "none"), (None, "v", "none2"), (102, "u", "only once"), (102, "u", "only once"), (103, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, html string, n int, sha1 string")
    folder, index, records = warc.archive(pages, str(tmp_path / "w"))
    got = records.collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    first |= {h: None for i, _, h in rows if i is None and h not in first}
    assert len(got) == len(rows) and index.count() == len(rows)
    assert len({r["record_id"] for r in got}) == len(rows)
    for r in got:
        own = [h or "" for i, _, h in rows if i == r["page_id"] and base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r["payload_digest"]]
        assert own and r["payload_bytes"] == len(own[0].encode())
        if r["record_type"] == "response":
            assert r["page_id"] == first[own[0]] and r["refers_to"] is None
        else:
            assert r["refers_to"] == first[own[0]]
    assert sum(r["record_type"] == "response" for r in got) == len(first)
    for r in index.collect()[:20]:
        record = warc.read_record(folder, r["bundle"], r["frame"], r["offset"], r["length"])
        assert f"WARC-Record-ID: <{r['record_id']}>".encode() in record
    ids = {r["record_id"] for r in got}
    for r in got:
        if r["record_type"] == "revisit":
            head = warc.read_record(folder, r["bundle"], r["frame"], r["offset"], r["length"]).decode().split("\r\n\r\n")[0]
            assert re.search("WARC-Refers-To: <(.*)>", head)[1] in ids - {r["record_id"]}
    assert warc.archive(pages.where("false"))[2].count() == 0
    small = warc.archive(pages, str(tmp_path / "v"), min_revisit_bytes=10)[2]
    assert small.where("payload_bytes < 10 and record_type = 'revisit'").count() == 0


def test_bundles_are_standard_frames(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame([(i, "u", "x" * 1000) for i in range(5)], "page_id long, url string, html string")
    folder, index, _ = warc.archive(pages, str(tmp_path / "w"))
    name = index.first()["bundle"]
    data = (tmp_path / "w" / name).read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == index.where(index["bundle"] == name).count()


ITEM = "Tom has 12 red apples and gives 5 of them to Anna before walking 3 km home in the rain with his dog"


def test_templates_and_slots(spark):
    changed = re.sub("Tom", "Ben", re.sub("Anna", "Lisa", ITEM)).replace("12", "90").replace(" 5 ", " 7 ")
    clash = "one says " + ITEM.replace("5 of", "6 of")
    twice = "Tom saw 12 birds, then Tom saw 12 birds again, and Tom went home with 12 birds in a bag"
    broken = "and Ben saw 3 birds, then Kim saw 4 birds again, and Ben went home with 5 birds in a bag"
    bench = spark.createDataFrame([(1, ITEM), (2, "when " + twice), (3, "a short one item"), (4, None), (5, "")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "before it " + ITEM + " after"), (2, "well " + changed), (3, clash), (4, "when " + broken), (5, "nothing at all of it stands here, but many other words"), (6, "here A Short\n one  item ends"), (7, None), (None, ITEM), (8, "Tom has 12 red apples and eats them all by himself on the train"), (1, "again")],
        "doc_id long, text string",
    )
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert {(1, 1), (2, 1), (3, 1), (None, 1), (6, 3)} <= got
    assert not {4, 5, 7, 8} & {d for d, _ in got}
    left = decontaminate.decontaminate_rows(docs, bench)
    assert left.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in left.select("doc_id", "text").collect() if r["doc_id"] not in (4, 5, 7, 8)) == [(1, "again")]
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.contaminated(odd_docs(spark), bench).count() == 0


def found(spark, items, docs):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), bench).collect()}


def test_names_at_any_place_and_in_lower_case(spark):
    items = ["Tom has 12 apples. Anna has 5 apples. Ben takes 3 of them. How many are left?", "On Monday morning Tom gave Anna twelve pens and then Anna met Ben near Paris"]
    docs = ["Max has 90 apples. Lisa has 7 apples. Kim takes 4 of them. How many are left?", items[1].lower(), "Max has 90 apples. Lisa has 7 pears and nobody takes any of them but Kim."]
    assert found(spark, items, docs) == {(0, 0), (1, 1)}


def test_verbatim_windows_of_any_words(spark):
    item = "when " + "Tom saw 5 birds, then a long walk through the green wood and over the old stone bridge led to 5 houses"
    table = "Sort the list 3 9 1 4 7 2 8 6 5 0 11 13 12 19 20"
    inserted = "a ship left port at dawn with cold wind from east and nobody knew where it might land before winter came over them"
    docs = ["so " + table, item.replace("5 houses", "6 houses"), inserted.replace("nobody", "really nobody"), "1 2 3 4 5 6 7 8 9 10 11 12 13 14"]
    assert {(0, 0), (1, 1), (2, 2)} <= found(spark, [table, item, inserted], docs)
    assert not {3} & {d for d, _ in found(spark, [table, item, inserted], docs)}


def test_short_items_and_numbers(spark):
    items = ["What is love?", "12 34 56 78 and 90 11 12 13", "Paris", "one two three four five"]
    docs = ["He asked: what is  love? Nobody knew.", "so 12 34 56 78 and 90 11 12 13 it was", "in paris it rained", "what is it?", "so 22 34 56 78 and 90 11 12 14 it was", "one two three, four five", "and one two three four five six"]
    got = found(spark, items, docs)
    assert {(0, 0), (1, 1), (2, 2), (6, 3)} <= got
    assert not {3, 5} & {d for d, _ in got}


def test_items_of_few_literals(spark):
    items = [
        "In May 2020 Tom paid 5 usd to Anna Smith, 7 usd to Ben Jones, 9 usd to Eva Brown and 11 usd to Max Stone",
        "12 kg + 5 kg = 17 kg for Tom",
        "Sort the list 3 9 1 4 7 2 8 6 5 0 11 13",
    ]
    docs = [
        "so In June 1999 Kim paid 15 usd to Lisa White, 17 usd to Jan Black, 19 usd to Ida Green and 21 usd to Leo Grey they say",
        "here 22 kg + 15 kg = 37 kg for Anna it was",
        "then the list 5 1 2 3 9 8 7 6 4 0 12 10 was long",
        "on 5 May 2020 Tom and 3 others paid 5 usd , 6 usd , 7 usd for 8 kg and 9 kg of it",
        "1 kg 2 kg 3 kg 4 kg 5 kg 6 kg = 7 kg",
        "Sort the list 13 19 11 14 17 12 18 16 15 10 21 23",
    ]
    assert found(spark, items, docs) == {(0, 0), (1, 1), (5, 2)}


def brute_hits(docs, items, k=8):
    """Plain windows of whole texts, one by one."""
    out = set()
    words = lambda t: t.lower().split()
    for i, x in enumerate(items):
        own = words(x)
        n = min(k, len(own))
        grams = [tuple(own[p : p + n]) for p in range(len(own) - n + 1)]
        for d, t in enumerate(docs):
            w = words(t)
            have = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)}
            hit = sum(g in have for g in set(grams)) if grams else 0
            if hit and (hit >= 6 or hit >= 0.5 * len(grams)):
                out.add((d, i))
    return out


def test_plain_windows_against_brute_force(spark):
    import random

    r = random.Random(6)
    text = lambda n: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 2) for _ in range(n))
    items = [text(n) for n in (1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 30) for _ in range(2)]
    docs = [text(40) for _ in range(40)]
    for x in items:
        w = x.split()
        docs.append(text(5) + " " + x + " " + text(5))
        docs.append(" ".join(w[: len(w) // 2 + 4]) + " " + text(9))
        docs.append(text(3) + " " + " ".join(["zz" if k == len(w) // 2 else v for k, v in enumerate(w)]))
    assert found(spark, items, docs) == brute_hits(docs, items)


def test_templates_against_brute_force(spark):
    """Items whose slots change: a document holds one if a one-to-one change of values turns it into the item."""
    names, changed = ["Tom", "Anna", "Ben"], ["Max", "Lisa", "Kim"]
    items, docs, want = [], [], set()
    for i in range(12):
        item = f"when {names[i % 3]} had {10 + i} apples in box {i} and gave {names[(i + 1) % 3]} some {chr(97 + i)}{chr(98 + i)} of them before noon then {names[i % 3]} kept {10 + i} for home"
        items.append(item)
        swap = {**dict(zip(names, changed, strict=True)), str(10 + i): str(70 + i)}
        for kind in range(3):
            w = [swap.get(x, x) for x in item.split()]
            if kind == 1:  # one value stands for two
                w[-3] = "99"
                w[w.index(str(70 + i))] = "98"
            if kind == 2:
                w = [x for k, x in enumerate(w) if k % 5]
            if kind == 0:
                want.add((len(docs), i))
            docs.append("so " + " ".join(w) + " end")
    got = found(spark, items, docs)
    assert want <= got
    assert {d for d, _ in got} <= {d for d, _ in want}


def test_without_broadcast(spark, monkeypatch):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + ITEM)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert decontaminate.contaminated(docs, bench).count() == 1


def test_verbatim_items_of_the_tables(spark):
    """Every item that stands whole in a document is found, and no document without a window of it."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: " ".join((r["text"] or "").lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: " ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {x} " in f" {t} "}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontaminate(spark, sf).collect()}
    assert whole <= got
    for d, i in got:
        w = items[i].split()
        assert any(" ".join(w[k : k + 6]) in docs[d] for k in range(len(w) - 5))
