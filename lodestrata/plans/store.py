"""Versioned store of the lifecycle tables: a run rewrites the buckets that its keys fall in, and becomes visible by one rename.

Large tables lie in hash buckets of their keys.  A version is a small manifest that says in which folder each bucket's
files are, with their names and sizes; buckets that a run doesn't touch stay where they are, and belong to
both versions.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..operators import lifecycle
from .files import Folder

#: Columns whose hash gives the bucket; tables that aren't named here have one row for each run and source, and one bucket.
BUCKET_KEYS = {"listings": ("id",), "sightings": ("job_id",), "attempts": ("source", "source_id"), "stale": ("id",)}

#: Buckets of a new store; a run of k keys rewrites k of them at most.
BUCKETS = 256

#: A writer that claimed a version so long ago and didn't publish it is taken for dead.
CLAIM_MS = 3_600_000


class LifecycleStore:
    """Tables under root/<table>/<version folder>/bucket=<b>; the greatest n that has a manifest root/versions/<n> counts.

    All paths go through Hadoop's file systems, so root may be in any store that Spark writes to.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets
        self._files = Folder(spark, self.root)

    def current(self) -> int:
        """The version that counts; 0 before the first run."""
        return max((int(x) for x in self._files.names("versions") if x.isdigit()), default=0)

    def manifest(self, n: int | None = None) -> dict:
        """buckets, tables (bucket -> folder and files with sizes, for each table) and stamps of a version."""
        n = self.current() if n is None else n
        return json.loads(self._files.read(f"versions/{n}")) if n else {"buckets": self._buckets, "tables": {}, "stamps": {}}

    def stamps(self) -> dict:
        """What streams have noted with the version that counts."""
        return self.manifest()["stamps"]

    def _read(self, name: str, manifest: dict, only: list[int] | None = None) -> DataFrame:
        """A table, or some buckets of it; columns that an older version lacks are null."""
        parts = manifest["tables"].get(name, {})
        paths = [f"{self.root}/{name}/{x['folder']}/bucket={b}/{f}" for b, x in parts.items() if only is None or int(b) in only for f in x["files"]]
        empty = self.spark.createDataFrame([], lifecycle.TABLES[name])
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty

    def state(self, n: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version."""
        manifest = self.manifest(n)
        return {k: self._read(k, manifest) for k in lifecycle.TABLES}

    def bucket(self, name: str, manifest: dict) -> Column:
        """The bucket of a row."""
        key = BUCKET_KEYS.get(name)
        return F.pmod(F.xxhash64(*key), F.lit(manifest["buckets"])).cast("int") if key else F.lit(0)

    def _rewrite(self, name: str, change: lifecycle.Change, manifest: dict, folder: str) -> dict:
        """Write the buckets that a change touches; where all buckets are after it."""
        own = self.bucket(name, manifest)
        dirty = [0]
        if name in BUCKET_KEYS:  # no more than there are buckets
            dirty = sorted(r[0] for r in change.touched().select(own.alias("b")).distinct().collect())
        parts = dict(manifest["tables"].get(name, {}))
        if not dirty:
            return parts
        rows = change.apply(self._read(name, manifest, dirty)).withColumn("bucket", own)
        rows.repartition("bucket").sortWithinPartitions("bucket", *change.key).write.partitionBy("bucket").parquet(f"{self.root}/{name}/{folder}")
        for b in dirty:
            parts.pop(str(b), None)
        for path, size in self._files.sizes(f"{name}/{folder}").items():
            bucket, _, file = path.partition("/")
            parts.setdefault(bucket.partition("=")[2], {"folder": folder, "files": {}})["files"][file] = size
        return parts

    def save_run(self, batch: DataFrame, per_source: DataFrame, o: lifecycle.RunOptions, attempts: DataFrame | None = None, stamp: dict | None = None) -> dict[str, int]:
        """Apply a run and publish it, with what a stream wants to note; counters of what it did and the bytes it wrote."""
        base = self.current()
        manifest = self.manifest(base)
        r = lifecycle.apply_run({k: self._read(k, manifest) for k in lifecycle.TABLES}, batch, per_source, o, attempts)
        folder = f"v={base + 1}-{uuid.uuid4().hex[:8]}"  # its own, so that two writers never share files
        tables = manifest["tables"] | {name: self._rewrite(name, change, manifest, folder) for name, change in r.changes.items()}
        classes = {x["class"]: x["count"] for x in r.classes.groupBy("class").count().collect()}
        marked = {x["status"]: x["count"] for x in r.marked.groupBy("status").count().collect()}
        counters = {"stored": batch.count(), "new": classes.get("new", 0), "reactivated": classes.get("reactivated", 0), "marked_missing": marked.get("missing", 0), "withdrawn": marked.get("withdrawn", 0), "expired": r.expired.count(), "purged": r.purged.count()}
        counters["bytes"] = sum(size for t in tables.values() for x in t.values() if x["folder"] == folder for size in x["files"].values())
        self._publish(base, {"buckets": manifest["buckets"], "folder": folder, "tables": tables, "stamps": manifest["stamps"] | (stamp or {})})
        r.scratch.drop()
        return counters

    def load(self, tables: dict[str, DataFrame], stamps: dict) -> None:
        """Publish whole tables as the first version."""
        manifest, folder = self.manifest(0), f"v=1-{uuid.uuid4().hex[:8]}"
        keys = {"sightings": ("job_id", "source", "source_id"), "source_runs": ("scanned_at", "source"), "runs": ("scanned_at",)}
        changes = {k: lifecycle.Change(keys.get(k) or BUCKET_KEYS[k], df, df.select(*(keys.get(k) or BUCKET_KEYS[k])).limit(0)) for k, df in tables.items()}
        self._publish(0, {"buckets": manifest["buckets"], "folder": folder, "tables": {k: self._rewrite(k, c, manifest, folder) for k, c in changes.items()}, "stamps": stamps})

    def _publish(self, base: int, manifest: dict) -> None:
        """The only step that makes a version count; no file of an older one is touched before.

        Of two writers that began at one version the second gives up: its run has to be applied to what the first left.
        """
        claim = f"versions/.after-{base}"
        if not self._files.claim(claim, manifest["folder"].encode(), CLAIM_MS) or self.current() != base:
            raise StoreError(f"another writer is ahead: version {base} has a successor")
        try:
            self._files.publish(f"versions/{base + 1}", json.dumps(manifest, sort_keys=True).encode())
        finally:
            self._files.delete(claim)

    def latest_run(self) -> tuple[DataFrame, DataFrame]:
        """The newest run and its rows of source_runs."""
        state = self.state()
        run = state["runs"].orderBy(F.desc("scanned_at")).limit(1)
        return run, state["source_runs"].join(F.broadcast(run.select("scanned_at")), "scanned_at", "left_semi")  # one row

    def prune(self, keep: int = 14) -> list[int]:
        """Drop all but the newest versions, and the folders that no version left needs; the versions that went."""
        if keep < 1:
            raise ValueError("keep must be at least 1")
        versions = sorted(int(x) for x in self._files.names("versions") if x.isdigit())
        gone, left = versions[:-keep], [self.manifest(v) for v in versions[-keep:]]
        # Folders of runs that began behind the newest version may still be written.
        dead = {self.manifest(v)["folder"] for v in gone}
        for v in gone:
            self._files.delete(f"versions/{v}")
        for name in lifecycle.TABLES:
            used = {x["folder"] for m in left for x in m["tables"].get(name, {}).values()}
            newest = int(max((m["folder"] for m in left), key=lambda f: int(f[2:].partition("-")[0])).partition("-")[0][2:])
            for folder in self._files.names(name):
                old = int(folder[2:].partition("-")[0]) <= newest
                if folder not in used and (folder in dead or old):
                    self._files.delete(f"{name}/{folder}")
        return gone


def seconds_until_due(now: datetime, due: str, last_success: datetime | None) -> float:
    """Seconds until a daily job at `due` (HH:MM) has to run: 0 if it is due and hasn't succeeded today."""
    hour, minute = map(int, due.split(":"))
    at = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    if last_success is not None and last_success.date() >= now.date():
        at += timedelta(days=1)
    return max(0.0, (at - now).total_seconds())


def retry_delay(failures: int, first: float = 60.0, most: float = 3600.0) -> float:
    """Seconds to wait after so many failures in a row."""
    return 0.0 if failures < 1 else min(most, first * 2 ** (failures - 1))
