from datetime import date, datetime

from lodestrata import cli
from lodestrata.operators import filtering, lifecycle
from lodestrata.plans.scan import ScanOptions, scan
from lodestrata.plans.store import LifecycleStore, seconds_until_due

from .conftest import listings
from .test_lifecycle import BATCH, SOURCES


def test_scan_bundle(spark):
    rows = [{"source": "a", "source_id": "1", "title": "T", "company": "C", "date_posted": "2026-07-20"}, {"source": "b", "source_id": "1", "title": "T", "company": "C Inc"}, {"source": "b", "source_id": "2", "title": "Old", "company": "D", "date_posted": "2020-01-01"}]
    known = spark.createDataFrame([("b", "1", "2026-07-21")], "source string, source_id string, known_date string")
    crawl = spark.createDataFrame([("a", 1, True, None), ("b", 1, True, "HTTP 403 blocked"), ("c", 1, False, "HTTP 403 blocked")], "source string, pages_fetched int, coverage_complete boolean, error string")
    r = scan(listings(spark, *rows), ScanOptions(filtering.FilterOptions(date(2026, 7, 23), days=30), warnings=["w", "w"]), known, crawl)
    (one,) = r.listings.collect()
    assert one["merged_rows"] == 2 and one["date_posted"] == "2026-07-21" and r.warnings == ["w"]
    assert {x["source"]: (x["status"], x["total"]) for x in r.per_source.collect()} == {"a": ("success", 1), "b": ("partial", 1), "c": ("blocked", None)}
    assert [tuple(x) for x in r.filter_reasons.collect()] == [("before_date_window", 1)]


def test_store(spark, tmp_path):
    store = LifecycleStore(spark, str(tmp_path / "s"))
    batch = spark.createDataFrame([("j", "T", "C", None, "2026-07-01", "u", {"green": "1"}, {"green": "u"}, "{}", 0)], BATCH)
    stats = spark.createDataFrame([("green", "success", True, 1, 1)], SOURCES)
    for day in ("25", "26", "27"):
        got = store.save_run(batch, stats, lifecycle.RunOptions(f"2026-07-{day}T00:00:00Z", "2026-06-25", f"2026-07-{day}"))
    assert got["stored"] == 1 and got["new"] == 0 and store.current() == 3
    assert store.state()["source_runs"].count() == 3 and store.state()["listings"].count() == 1
    assert store.prune(2) == [1] and store.state()["listings"].count() == 1


def test_schedule():
    now = datetime(2026, 7, 25, 4, 0)
    assert seconds_until_due(now, "03:15", None) == 0
    assert seconds_until_due(now, "03:15", datetime(2026, 7, 25, 3, 30)) == 23.25 * 3600


def test_arguments():
    assert cli.main(["scan", "x", "--as-of", "2026-07-23", "--prefecture", "atlantis"]) == 2
    assert cli.main(["scan", "x", "--as-of", "2026-07-23", "--format", "csv"]) == 2
    assert cli.main(["report", "x", "--start", "2026-07-23", "--end", "2026-07-01"]) == 2
