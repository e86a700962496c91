"""Captured pages and run documents as data sources."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import captured, catalog

from .test_listing_operators import CARD


def capture(root, source, keyword, page, body, kind="html"):
    at = os.path.join(root, source, keyword)
    os.makedirs(at, exist_ok=True)
    with open(f"{at}/{page}.{kind}", "w", encoding="utf-8") as f:
        f.write(body)


def test_pages_of_all_sources(spark, tmp_path):
    root = str(tmp_path)
    captured.register(spark)
    for name in catalog.SOURCES:
        capture(root, name, "k", 1, CARD if name == "daijob" else "<p>nothing here</p>")
    capture(root, "daijob", "other", 2, CARD.replace("12345", "777"))
    capture(root, "japandev", "k", 3, json.dumps({"hits": [{"objectID": "9", "title": "Dev", "company_name": "C"}]}), "json")
    df = spark.read.format("captured_pages").option("path", root).load()
    rows = {(r["source"], r["source_id"], r["matched_keyword"]): r for r in df.collect()}
    assert set(rows) == {("daijob", "12345", "k"), ("daijob", "777", "other"), ("japandev", "9", "k")}
    assert rows["daijob", "12345", "k"]["title"] == "Platform Engineer" and rows["daijob", "777", "other"]["_ord"] == 2 << 16
    for name in catalog.SOURCES:
        assert df.where(F.col("source") == name).count() == {"daijob": 2, "japandev": 1}.get(name, 0)
    assert df.where("source in ('japandev', 'green')").count() == 1
    some = spark.read.format("captured_pages").option("path", root).option("sources", "daijob,green").load()
    assert some.count() == 2
    with pytest.raises(Exception, match="unknown source: nope"):
        spark.read.format("captured_pages").option("path", root).option("sources", "nope").load().count()


def test_a_filter_on_the_source_reads_no_other_folder(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    for name in ("daijob", "green", "doda"):
        for page in range(130):
            capture(str(tmp_path), name, "k", page, "")
    reader = captured.PageReader({"path": str(tmp_path)})
    assert len(reader.partitions()) == 9 and max(len(p.names) for p in reader.partitions()) == captured.FILES
    left = list(reader.pushFilters([EqualTo(("source",), "green"), GreaterThan(("_ord",), 1)]))
    assert len(left) == 1 and {p.source for p in reader.partitions()} == {"green"}


def test_a_registered_source_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "SOURCES", dict(catalog.SOURCES))
    catalog.register_source(catalog.Source("mine", "A source of one's own", cards="a", id_pattern=r"/(\d+)"))
    capture(str(tmp_path), "mine", "", 1, '<a href="/5">First role</a>')
    rows = list(captured.read_files(captured.PageReader({"path": str(tmp_path), "sources": "mine"}).partitions()[0]))
    assert rows[0][:2] == ("mine", "5")
    assert sum(s.status == "active" for s in catalog.SOURCES.values() if s.name != "mine") == 9 and catalog.SOURCES["linkedin"].status == "experimental"


def test_pages_as_a_stream(spark, tmp_path):
    captured.register(spark)
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = spark.readStream.format("captured_pages").option("path", root).load()

    def go():
        stream.select("source", "source_id").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r["source_id"] for r in spark.read.parquet(out).collect())

    capture(root, "daijob", "k", 1, CARD)
    assert go() == ["12345"]
    assert go() == ["12345"]  # nothing new
    capture(root, "daijob", "k", 2, CARD.replace("12345", "2"))
    capture(root, "daijob", "l", 1, CARD.replace("12345", "3"))
    assert go() == ["12345", "2", "3"]


def test_run_documents(spark, tmp_path):
    captured.register(spark)
    for k in range(3):
        with open(tmp_path / f"run{k}.json", "w") as f:
            json.dump({"scanned_at": f"2026-07-0{k + 1}", "jobs": [{"id": f"{k}-{i}", "title": "T\nU"} for i in range(k)]}, f, indent=2)
    docs = spark.read.format("run_documents").option("path", str(tmp_path)).load()
    got = sorted((r["scanned_at"], r["place"], json.loads(r["job"])["id"]) for r in docs.collect())
    assert got == [("2026-07-02", 0, "1-0"), ("2026-07-03", 0, "2-0"), ("2026-07-03", 1, "2-1")]
    same = captured.run_documents(spark, str(tmp_path), "id string, title string")
    assert sorted((r["scanned_at"], r["_ord"], r["id"]) for r in same.collect()) == got
