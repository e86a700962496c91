"""Store versions, page checkpoints and the push, with crashes in between."""

import gzip
import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import lodestrata
from lodestrata.errors import CheckpointError, SyncError
from lodestrata.operators import coverage, delta, lifecycle
from lodestrata.plans import sync
from lodestrata.plans.files import Folder
from lodestrata.plans.store import LifecycleStore, retry_delay

from .test_lifecycle import one, run

SECRET = "s" * 32


def documents(spark, values):
    df = spark.createDataFrame([(k, json.dumps({"id": k, "v": v}, separators=(",", ":"))) for k, v in values.items()], "id string, doc string")
    return df.withColumn("hash", F.sha2("doc", 256))


class Receiver:
    """The other side: checks signatures and checksums, keeps the documents, fails when told to."""

    def __init__(self):
        self.docs, self.runs, self.broken = {}, [], False

    def __call__(self, name, chunk, body, timestamp, signature):
        if self.broken:
            raise ConnectionError
        assert signature == delta.signature(timestamp, body, SECRET)
        d = json.loads(gzip.decompress(body))
        own = {k: d[k] for k in ("jobs", "run", "sourceHealth")}
        assert d["checksum"] == hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        assert (d["runId"], d["chunkIndex"], d["schemaVersion"]) == (name, chunk, 1)
        assert (d["run"] is not None) == (chunk == 0) == bool(d["sourceHealth"])
        self.docs |= {j["id"]: j["v"] for j in d["jobs"]}
        self.runs.append((name, chunk, len(d["jobs"])))
        return {"complete": chunk == d["chunkCount"] - 1}


def test_push_survives_crashes(spark, tmp_path):
    root, other = str(tmp_path / "sync"), Receiver()
    health = [{"source": "a", "status": "success"}]
    push = lambda values, day: sync.sync(documents(spark, values), {"scannedAt": day}, health, root, other, SECRET, size=2)
    values = {f"k{i}": i for i in range(5)}
    state = push(values, "2026-01-01T00:00:00Z")
    assert other.docs == values and [r[1:] for r in other.runs] == [(0, 2), (1, 2), (2, 1)]
    want = hashlib.sha256(json.dumps({r["id"]: r["hash"] for r in documents(spark, values).collect()}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert state["manifestChecksum"] == want and state["jobCount"] == state["changedCount"] == 5
    n = len(other.runs)
    assert push(values, "2026-01-01T00:00:00Z") == state and len(other.runs) == n  # nothing to do
    state = push(values, "2026-01-02T00:00:00Z")  # a new run without a change is one empty chunk
    assert other.runs[n:] == [(state["runId"], 0, 0)]
    other.broken = True
    with pytest.raises(ConnectionError):
        push(values | {"k1": 99}, "2026-01-03T00:00:00Z")
    other.broken = False
    push(values | {"k1": 99, "k7": 7}, "2026-01-04T00:00:00Z")  # first what was left over, then its own
    assert other.docs == values | {"k1": 99, "k7": 7} and [r[2] for r in other.runs[n + 1 :]] == [1, 1]
    assert Folder(spark, root).names("outbox") == []
    with pytest.raises(SyncError):
        sync.sync(documents(spark, {"x": 1}), {"scannedAt": "2026-01-05"}, health, root, lambda *a: {}, SECRET)
    with pytest.raises(ValueError):
        sync.sync(documents(spark, {}), {"scannedAt": "x"}, [], root, other, "short")


def test_checkpoints_of_other_scans_are_refused(spark):
    head = coverage.check_head(None, {"keywords": ["a"], "as_of": "2026-01-01"})
    assert coverage.check_head(head, {"as_of": "2026-01-01", "keywords": ["a"]}) == head
    with pytest.raises(CheckpointError):
        coverage.check_head(head, {"keywords": ["b"], "as_of": "2026-01-01"})
    with pytest.raises(CheckpointError):
        coverage.check_head(head | {"version": 2}, head["parameters"])
    crawls = spark.createDataFrame([("a", "x", ""), ("b", "x", ""), ("c", "x", "")], "source string, keyword string, context string")
    old = spark.createDataFrame([("a", "x", "", 3, False), ("b", "x", "", 9, True)], "source string, keyword string, context string, page int, complete boolean")
    o = coverage.PageOptions(auto=True, max_pages=5)
    got = {r["source"]: (r["start_page"], r["last_page"], r["reason"], r["coverage_complete"]) for r in coverage.resume_plan(crawls, old, o, {"c": 2}).collect()}
    assert got == {"a": (4, 5, None, None), "b": (10, 0, "checkpoint_complete", True), "c": (2, 5, None, None)}
    with pytest.raises(Exception, match="page 4 lies behind the budget of 3"):
        coverage.resume_plan(crawls, old, coverage.PageOptions(auto=True, max_pages=3)).collect()
    assert coverage.single_page(crawls).first()["reason"] == "single_page_source"
    assert not coverage.aborted(crawls.withColumn("page", F.lit(2))).first()["coverage_complete"]


def test_daily_job_retries_later_each_time():
    now, slept, runs = [datetime(2026, 1, 1, 8, 0)], [], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += timedelta(seconds=seconds)

    def job():
        runs.append(now[0])
        if len(runs) in (1, 2):
            raise OSError

    sync.daily(job, "09:00", lambda: now[0], sleep, rounds=4)
    assert slept == [3600, 60, 120, 86400 - 180] and [retry_delay(k) for k in (0, 1, 99)] == [0, 60, 3600]


def test_public_names():
    assert callable(lodestrata.scan) and callable(lodestrata.list_sources) and callable(lodestrata.register_source) and lodestrata.LifecycleStore is LifecycleStore
    with pytest.raises(AttributeError):
        lodestrata.nothing  # noqa: B018
