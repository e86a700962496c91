"""The bucketed store and the stream of runs against whole recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.errors import StoreError
from lodestrata.operators import lifecycle
from lodestrata.plans import backup
from lodestrata.plans.files import Folder
from lodestrata.plans.store import LifecycleStore
from lodestrata.streaming import scans

from .test_lifecycle import BATCH, SOURCES


def options(day, **o):
    return lifecycle.RunOptions(f"{day}T00:00:00Z", o.pop("start", "2026-06-01"), day, **{"missing_threshold": 2, "retention_days": 20, "purge_grace_days": 2, **o})


class Model:
    """The rules of a run in plain Python over dictionaries, everything worked out anew each time."""

    def __init__(self):
        self.jobs, self.seen, self.runs = {}, {}, []

    def run(self, rows, sources, o):
        at = o.scanned_at
        last = {}
        for n, (i, ids, day) in enumerate(rows):
            last[i] = day
        keys = {}
        for i, ids, day in rows:
            for s, x in ids.items():
                keys[s, x] = i
        prior = {}
        for (j, s, x), v in self.seen.items():
            if (s, x) in keys:
                best = prior.get((s, x))
                if best is None or (v["last"], [-ord(c) for c in j]) > (best[0]["last"], [-ord(c) for c in best[1]]):
                    prior[s, x] = (v, j)
        for i, day in last.items():
            old = self.jobs.get(i)
            firsts = [prior[k][0]["first"] for k, j in keys.items() if j == i and k in prior]
            first = old["first"] if old else min(firsts, default=at)
            self.jobs[i] = {"day": day, "first": first, "last": at, "status": "active", "missing": 0, "withdrawn": None, "expired": None}
        fresh = {(j, *k): {"first": prior[k][0]["first"] if k in prior else at, "last": at, "status": "active", "missing": 0} for k, j in keys.items()}
        self.seen = {k: v for k, v in self.seen.items() if k[1:] not in keys} | fresh
        applied = {}
        if o.maintenance:
            inside = lambda j: j in self.jobs and o.window_start <= (self.jobs[j]["day"] or "") <= o.window_end
            live = {k for k, v in self.seen.items() if v["status"] in lifecycle.LIVE and inside(k[0])}
            for s, ok in sources.items():
                history = [k for a, src, k, done in sorted(self.runs, reverse=True) if src == s and done][:7]
                mid = sorted(history)[len(history) // 2] if len(history) % 2 else (sum(sorted(history)[len(history) // 2 - 1 : len(history) // 2 + 1]) / 2 if history else sum(k[1] == s for k in live))
                current = len({k for k in keys if k[0] == s})
                applied[s] = ok and not (mid >= 10 and current < mid * 0.2)
            for k in live:
                if applied.get(k[1]) and k[1:] not in keys:
                    v = self.seen[k]
                    v["missing"] += 1
                    v["status"] = "withdrawn" if v["missing"] >= o.missing_threshold else "missing"
            for i, j in self.jobs.items():
                own = [v for k, v in self.seen.items() if k[0] == i]
                if own:
                    j["status"] = next(s for s in ("active", "missing", "withdrawn", "expired") if any(v["status"] == s for v in own))
                    j["missing"] = max(v["missing"] for v in own)
                    j["withdrawn"] = (j["withdrawn"] or at) if j["status"] == "withdrawn" else None
                    j["expired"] = (j["expired"] or at) if j["status"] == "expired" else None
            for i, j in self.jobs.items():
                if j["day"] and j["day"] < o.day(o.retention_days) and j["status"] not in ("withdrawn", "expired"):
                    j["status"], j["expired"] = "expired", j["expired"] or at
                    for k, v in self.seen.items():
                        if k[0] == i:
                            v["status"] = "expired"
            gone = {i for i, j in self.jobs.items() if (j["withdrawn"] if j["status"] == "withdrawn" else j["expired"] if j["status"] == "expired" else "9") [:10] <= o.day(o.purge_grace_days)}
            self.seen = {k: v for k, v in self.seen.items() if k[0] not in gone}
            have = {k[0] for k in self.seen}
            self.jobs = {i: j for i, j in self.jobs.items() if i not in gone and i in have}
        self.runs = [r for r in self.runs if r[0] != at] + [(at, s, sum(s in ids for _, ids, _ in rows), applied.get(s, False)) for s in sources]

    def tables(self):
        jobs = sorted((i, j["day"], j["first"], j["last"], j["status"], j["missing"], j["withdrawn"], j["expired"]) for i, j in self.jobs.items())
        return jobs, sorted((*k, v["first"], v["last"], v["status"], v["missing"]) for k, v in self.seen.items())


def stored(store):
    s = store.state()
    jobs = sorted(tuple(r) for r in s["listings"].select("id", "date_posted", "first_seen_at", "last_seen_at", "status", "missing_count", "withdrawn_at", "expired_at").collect())
    return jobs, sorted(tuple(r) for r in s["sightings"].select("job_id", "source", "source_id", "first_seen_at", "last_seen_at", "status", "missing_count").collect())


def frames(spark, rows, sources):
    data = [(i, "T", "C", None, d, "u", ids, {k: "u" for k in ids}, "{}", n) for n, (i, ids, d) in enumerate(rows)]
    return spark.createDataFrame(data, BATCH), spark.createDataFrame([(s, "success", ok, sum(s in ids for _, ids, _ in rows), len(rows)) for s, ok in sources.items()], SOURCES)


def days(seed, n):
    r = random.Random(seed)
    for k in range(n):
        rows = []
        for i in r.sample(range(30), r.randint(8, 20)):
            ids = {s: f"{(i + r.choice([0, 0, 0, 1])) % 30}" for s in r.sample(["a", "b", "c"], r.choice([1, 1, 2]))}
            rows.append((f"j{i:02d}", ids, f"2026-07-{1 + i % 28:02d}"))
        yield f"2026-07-{10 + 3 * k:02d}", rows + rows[:1], {s: r.random() < 0.8 for s in "abc"}, r.random() < 0.8


def test_runs_equal_a_whole_recomputation(spark, tmp_path):
    model, store = Model(), LifecycleStore(spark, str(tmp_path / "s"), buckets=8)
    for day, rows, sources, maintenance in days(1, 4):
        model.run(rows, sources, options(day, maintenance=maintenance))
        store.save_run(*frames(spark, rows, sources), options(day, maintenance=maintenance))
        assert stored(store) == model.tables(), day
    assert store.prune(2) and stored(store) == model.tables()


def test_few_keys_write_few_bytes(spark, tmp_path):
    """5 keys over 20,000 stored ones rewrite their buckets alone."""
    store = LifecycleStore(spark, str(tmp_path / "s"), buckets=512)
    n = 20_000
    first = spark.range(n).select(F.concat(F.lit("j"), "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("title"), F.lit("C").alias("company"), F.lit(None).cast("string").alias("prefecture"), F.lit("2026-07-01").alias("date_posted"), F.lit("u").alias("url"), F.create_map(F.lit("a"), F.col("id").cast("string")).alias("source_ids"), F.create_map(F.lit("a"), F.lit("u")).alias("source_urls"), F.lit("{}").alias("payload"), F.col("id").alias("_ord"))
    sources = spark.createDataFrame([("a", "success", False, n, n)], SOURCES)
    whole = store.save_run(first, sources, options("2026-07-02"))
    again = store.save_run(first.where("id in ('j5', 'j77') or _ord < 3"), sources, options("2026-07-03"))
    assert whole["new"] == n and again["new"] == 0 and again["stored"] == 5
    assert again["bytes"] < 0.02 * whole["bytes"]
    state = store.state()
    assert state["listings"].count() == n and state["sightings"].where("last_seen_at like '2026-07-03%'").count() == 5
    assert store.state(1)["listings"].where("last_seen_at like '2026-07-03%'").count() == 0  # the older version is whole


def test_a_crash_and_a_second_writer_keep_the_store(spark, tmp_path, monkeypatch):
    store = LifecycleStore(spark, str(tmp_path / "s"), buckets=4)
    save = lambda day: store.save_run(*frames(spark, [("j1", {"a": "1"}, "2026-07-01")], {"a": True}), options(day))
    save("2026-07-02")
    before, move = stored(store), Folder.move
    monkeypatch.setattr(Folder, "move", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        save("2026-07-03")
    assert store.current() == 1 and stored(store) == before
    monkeypatch.setattr(Folder, "move", move)
    publish = LifecycleStore._publish

    def late(self, base, manifest):  # another writer publishes in between
        monkeypatch.setattr(LifecycleStore, "_publish", publish)
        save("2026-07-04")
        publish(self, base, manifest)

    monkeypatch.setattr(LifecycleStore, "_publish", late)
    with pytest.raises(StoreError):
        save("2026-07-03")
    assert store.current() == 2 and {r["scanned_at"] for r in store.latest_run()[0].collect()} == {"2026-07-04T00:00:00Z"}
    save("2026-07-05")
    assert store.current() == 3 and store.prune(1) == [1, 2] and stored(store)[0][0][3].startswith("2026-07-05")


def test_backup_restore_and_a_truncated_part(spark, tmp_path):
    store, root = LifecycleStore(spark, str(tmp_path / "s"), buckets=4), str(tmp_path / "b")
    with pytest.raises(StoreError):
        backup.backup(store, root)
    names = []
    for day in ("2026-07-02", "2026-07-04"):
        store.save_run(*frames(spark, [(f"j{k}", {"a": str(k)}, "2026-07-01") for k in range(9)], {"a": True}), options(day), stamp={"scan": {day: 1}})
        names.append(backup.backup(store, root, keep=1))
    files = Folder(spark, root)
    assert backup.backups(files) == names[1:] and [x for x in files.names() if not x.endswith(".json")] == names[1:]  # the older one is gone
    again = backup.restore(spark, root, names[-1], str(tmp_path / "r"))
    assert stored(again) == stored(store) and again.stamps() == {"scan": {"2026-07-04": 1}}
    again.save_run(*frames(spark, [("j1", {"a": "1"}, "2026-07-01")], {"a": False}), options("2026-07-05"))
    assert again.current() == 2 and again.state()["listings"].count() == 9
    with pytest.raises(StoreError):
        backup.restore(spark, root, names[-1], str(tmp_path / "r"))
    (part, *_) = (tmp_path / "b" / names[1] / "listings").glob("*.parquet")
    part.write_bytes(part.read_bytes()[:-10])
    with pytest.raises(StoreError, match="lost or changed"):
        backup.restore(spark, root, names[1], str(tmp_path / "t"))
    with pytest.raises(StoreError, match="no whole backup"):
        backup.verified(spark, root, names[0])


def captured(spark, path, rows, sources, day, part):
    data = [(day, s, "k", p, "success", ok, [(i, "T", "C", None, d, "u", {s: ids[s]}, {s: "u"}, "{}") for i, ids, d in rows if s in ids][p::2]) for s, ok in sources.items() for p in (0, 1)]
    for n, half in enumerate((data[::2], data[1::2])):
        spark.createDataFrame(half, scans.CAPTURED).coalesce(1).write.parquet(f"{path}/{part}{n}")


def test_a_stream_of_days_is_runs_of_days(spark, tmp_path, monkeypatch):
    """Also when it is killed between the tables and their version, and behind the version."""
    model, source = Model(), str(tmp_path / "in")
    for k, (day, rows, sources, _) in enumerate(days(3, 2)):
        rows = [(i, {s: x}, d) for i, ids, d in rows for s, x in list(ids.items())[:1]]
        rows = list({(s, x): (i, ids, d) for i, ids, d in rows for s, x in ids.items()}.values())
        model.run(rows, sources, options(day))
        captured(spark, source, rows, sources, day, k)
    store = LifecycleStore(spark, str(tmp_path / "s"), buckets=4)
    stream = spark.readStream.schema(scans.CAPTURED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    applied, publish = scans.ScanStream(store, options), LifecycleStore._publish
    for die_after in (False, True):

        def killed(self, base, manifest, after=die_after):
            if after:
                publish(self, base, manifest)
            raise OSError("killed")

        monkeypatch.setattr(LifecycleStore, "_publish", killed)
        with pytest.raises(Exception, match="killed"):
            scans.run(stream, applied, str(tmp_path / "c"))
        assert store.current() == int(die_after)
        monkeypatch.setattr(LifecycleStore, "_publish", publish)
    scans.run(stream, applied, str(tmp_path / "c"))
    assert store.current() == 2 and len(applied.done()) == 2 and stored(store) == model.tables()
    captured(spark, source, [("late", {"a": "99"}, "2026-07-01")], {"a": True}, "2026-07-10", 9)
    scans.run(stream, applied, str(tmp_path / "c"))
    assert store.current() == 2 and stored(store) == model.tables()
    assert applied.late().select(F.explode("listings.id")).count() == 1
