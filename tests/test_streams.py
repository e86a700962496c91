"""Streams against their batch forms, in one and in many micro-batches."""

import random
from datetime import date

import pytest

from lodestrata.operators import coverage
from lodestrata.streaming import jobs, pages

SCHEMA = "source string, keyword string, context string, page int, rows int, added int, dates array<string>, has_next boolean, total_pages int, date_ordered boolean, server_date_filtered boolean, stop_on_no_new boolean, no_new_tolerance int"


def crawls(seed, n=60):
    r, out = random.Random(seed), []
    for k in range(n):
        key = (f"s{k % 4}", f"k{k // 4 % 5}", r.choice(["", '{"level":"mid"}']) + str(k // 20))
        total, ordered, filtered, repeats = r.choice([None, None, 3, 9]), r.random() < 0.7, r.random() < 0.3, r.random() < 0.6
        tolerance, last = r.choice([None, 0, 1, 2, 3]), r.randint(1, 12)
        for p in range(1, last + 1):
            rows = r.choice([0, 1, 5, 5, 5, 5])
            day = 25 - 2 * p
            dates = [r.choice([f"2026-07-{max(1, day):02d}", f"2026年7月{max(1, day)}日", f"２０２６-07-{max(1, day):02d}"]) for _ in range(r.randint(0, 3))] + (["soon"] if r.random() < 0.1 else [])
            out.append((*key, p, rows, r.choice([0, rows]), dates, r.choice([True, True, True, None, p < last]), total, ordered, filtered, repeats, tolerance))
    return out


OPTIONS = [
    coverage.PageOptions(cutoff=date(2026, 7, 21), max_pages=8, per_source={"s1": 3, "s2": 5}),
    coverage.PageOptions(auto=False, pages=4, cutoff=date(2026, 7, 20)),
    coverage.PageOptions(),
]


@pytest.mark.parametrize(("which", "batches"), [(0, 1), (0, 7), (1, 7), (2, 1)])
def test_stops_equal_first_stop(spark, tmp_path, which, batches):
    rows, o = crawls(which), OPTIONS[which]
    decided = coverage.decide(spark.createDataFrame(rows, SCHEMA), o)
    want = {(r["source"], r["keyword"], r["context"], r["page"], r["reason"], r["coverage_complete"]) for r in coverage.first_stop(decided).collect()}
    oldest = {(*[r[k] for k in coverage.KEY], r["page"]): r["oldest_date"] for r in decided.collect()}
    random.Random(which).shuffle(rows)  # out of order inside and across micro-batches
    for k in range(batches):
        spark.createDataFrame(rows[k::batches] + rows[:3], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = jobs.run_once(pages.stops(stream, o)).collect()
    assert {(r["source"], r["keyword"], r["context"], r["page"], r["reason"], r["coverage_complete"]) for r in got} == want and len(got) == len(want)
    assert all(r["oldest_date"] == oldest[(*[r[k] for k in coverage.KEY], r["page"])] for r in got)
    reasons = {r["reason"] for r in got}
    assert ("date_boundary" in reasons) == (which == 0) and len(reasons) >= 3
