from lodestrata.operators import lifecycle

SOURCES = "source string, status string, coverage_complete boolean, kept int, total int"
BATCH = "id string, title string, company string, prefecture string, date_posted string, url string, source_ids map<string,string>, source_urls map<string,string>, payload string, _ord long"


def run(spark, state, day, jobs, coverage=True, status="success", **o):
    """jobs: (id, {source: source_id}, date)."""
    rows = [(i, "T", "C", None, d, "u", ids, {k: "u" for k in ids}, "{}", n) for n, (i, ids, d) in enumerate(jobs)]
    names = {s for _, ids, _ in jobs for s in ids} | set(o.pop("also", ()))
    stats = [(s, status, coverage, sum(s in ids for _, ids, _ in jobs), len(jobs)) for s in sorted(names)]
    options = lifecycle.RunOptions(f"2026-{day}T00:00:00Z", o.pop("start", "2026-06-25"), f"2026-{day}", **o)
    r = lifecycle.apply_run(state, spark.createDataFrame(rows, BATCH), spark.createDataFrame(stats, SOURCES), options)
    tables = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in r.tables.items()}
    return r, tables


def one(i, source="green", day="2026-07-01"):
    return (f"job-{i}", {source: str(i)}, day)


def status(tables):
    return {r["id"]: (r["status"], r["missing_count"]) for r in tables["listings"].collect()}


def test_three_misses_withdraw(spark):
    r, t = run(spark, lifecycle.empty_state(spark), "07-25", [one(1), one(2)])
    assert {x["class"] for x in r.classes.collect()} == {"new"}
    for day in ("07-26", "07-27"):
        _, t = run(spark, t, day, [one(2)])
    assert status(t)["job-1"] == ("missing", 2)
    r, t = run(spark, t, "07-28", [one(2)])
    assert status(t) == {"job-1": ("withdrawn", 3), "job-2": ("active", 0)}
    row = t["listings"].where("id = 'job-1'").first()
    assert row["withdrawn_at"].startswith("2026-07-28") and row["removal_reason"] == "all_sources_withdrawn" and row["first_seen_at"].startswith("2026-07-25")
    r, t = run(spark, t, "07-29", [one(1), one(2)])
    assert {x["id"]: x["class"] for x in r.classes.collect()} == {"job-1": "reactivated", "job-2": "known"} and status(t)["job-1"] == ("active", 0)


def test_guards(spark):
    _, t = run(spark, lifecycle.empty_state(spark), "07-25", [one(1), one(2)])
    _, u = run(spark, t, "07-26", [one(2)], coverage=False)
    assert status(u)["job-1"] == ("active", 0)
    assert u["source_runs"].where("scanned_at like '%07-26%'").first()["reconciliation_reason"] == "coverage_incomplete"
    _, u = run(spark, t, "07-26", [one(2)], status="blocked")
    assert u["source_runs"].where("scanned_at like '%07-26%'").first()["reconciliation_reason"] == "discovery_status_blocked"
    _, t = run(spark, lifecycle.empty_state(spark), "07-25", [one(i) for i in range(20)])
    _, t = run(spark, t, "07-26", [one(0), one(1)])
    assert t["source_runs"].where("scanned_at like '%07-26%'").first()["reconciliation_reason"] == "sudden_drop_2_of_20"
    assert all(s == ("active", 0) for s in status(t).values())


def test_alive_in_another_source(spark):
    both = ("shared", {"green": "1", "gaijinpot": "1"}, "2026-07-01")
    other = ("shared", {"gaijinpot": "1"}, "2026-07-01")
    keep = one(9)
    _, t = run(spark, lifecycle.empty_state(spark), "07-25", [both, keep])
    for day in ("07-26", "07-27", "07-28"):
        _, t = run(spark, t, day, [other, keep])
    assert status(t)["shared"][0] == "active"
    assert {r["source"]: r["status"] for r in t["sightings"].where("job_id = 'shared'").collect()} == {"green": "withdrawn", "gaijinpot": "active"}


def test_expire_then_purge(spark):
    r, t = run(spark, lifecycle.empty_state(spark), "07-25", [one(1, day="2026-01-01")], start="2025-12-01")
    assert r.expired.count() == 1 and status(t)["job-1"][0] == "expired"
    r, t = run(spark, t, "08-25", [], also=["green"], status="no_results")
    assert r.purged.count() == 1 and t["listings"].count() == 0 and t["sightings"].count() == 0


def test_first_and_last_seen_without_maintenance(spark):
    _, t = run(spark, lifecycle.empty_state(spark), "07-22", [one(1)], maintenance=False)
    _, t = run(spark, t, "07-23", [one(1)], maintenance=False)
    (s,) = t["sightings"].collect()
    assert s["first_seen_at"].startswith("2026-07-22") and s["last_seen_at"].startswith("2026-07-23")
    assert {r["reconciliation_reason"] for r in t["source_runs"].collect()} == {"maintenance_disabled"}


def test_detail_retry(spark):
    sightings = spark.createDataFrame([("j", "green", "known", "active")], "job_id string, source string, source_id string, status string")
    attempts = spark.createDataFrame([("green", "tried", "2026-07-25T00:00:00Z")], "source string, source_id string, attempted_at string")
    keys = lambda day: {r["source_id"] for r in lifecycle.detail_skip_keys(sightings, attempts, day).collect()}
    assert keys("2026-07-25") == {"known", "tried"} and keys("2026-08-01") == {"known", "tried"} and keys("2026-08-02") == {"known"}


def test_payload_merge(spark):
    import json

    from pyspark.sql import functions as F

    old = json.dumps({"source": "a", "company": "Old", "description": "longer text", "wage": {"min": 1, "max": None, "unit": None, "raw": ""}, "language": ["x"], "source_ids": {"a": "1", "b": "2"}, "detail_status": "enriched"})
    new = json.dumps({"source": "a", "company": "", "description": "short", "language": ["y", "x"], "source_ids": {"a": "9"}})
    df = spark.createDataFrame([(old, new), (None, new), ("broken", new)], "o string, n string")
    got = [json.loads(r[0]) for r in df.coalesce(1).select(lifecycle.merge_payload(F.col("o"), F.col("n"))).collect()]
    m = got[0]
    assert (m["company"], m["description"], m["wage"]["min"], m["language"], m["source_ids"], m["detail_status"]) == ("Old", "longer text", 1, ["x", "y"], {"b": "2", "a": "9"}, "enriched")
    assert got[1] == got[2] == json.loads(new)
