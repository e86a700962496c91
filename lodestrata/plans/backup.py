"""Backups of one version of the store: compacted copies with a manifest that a restore verifies.

Under the backup's root: <name>/<table>/*.parquet and, written last, <name>.json with the rows of each table and the length and
SHA-256 of each file.  A folder without its manifest is a backup that broke off; it doesn't count and
goes with the next rotation.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..operators import lifecycle
from .files import Folder
from .store import BUCKET_KEYS, LifecycleStore

#: Rows of a file at most.
FILE_ROWS = 2_000_000


def _digests(spark: SparkSession, path: str) -> dict[str, list]:
    """Length and digest of every file of a table's copy, worked out where the files are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("digest"))
    return {r["name"]: [r["length"], r["digest"]] for r in rows.collect()}  # a row for each file


def backups(files: Folder) -> list[str]:
    """Names of whole backups, oldest first."""
    return [x.removesuffix(".json") for x in files.names() if x.endswith(".json") and not x.startswith(".")]


def backup(store: LifecycleStore, root: str, keep: int = 14) -> str:
    """Copy the version that counts, then drop all but the newest backups; the copy's name."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    version = store.current()
    if not version:
        raise StoreError("the store has no version yet")
    spark, files, name = store.spark, Folder(store.spark, root), f"{version:012d}"
    if name not in backups(files):
        manifest, tables = store.manifest(version), {}
        for table, rows in store.state(version).items():
            path = files.path(f"{name}/{table}")
            rows.repartition(*BUCKET_KEYS.get(table, ())[:1] or ("scanned_at",)).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
            tables[table] = {"rows": spark.read.parquet(path).count(), "files": _digests(spark, path)}
        files.publish(f"{name}.json", json.dumps({"version": version, "buckets": manifest["buckets"], "stamps": manifest["stamps"], "tables": tables}, sort_keys=True).encode())
    rotate(files, keep)
    return name


def rotate(files: Folder, keep: int) -> list[str]:
    """Drop all but the newest backups, and folders without a manifest that are older than these; the names that went."""
    whole = backups(files)
    left = whole[-keep:]
    for name in whole[:-keep]:
        files.delete(f"{name}.json")  # first, so that half a backup never counts
    gone = [x for x in files.names() if not x.endswith(".json") and x not in left and left and x < left[-1]]
    for name in gone:
        files.delete(name)
    return gone


def verified(spark: SparkSession, root: str, name: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest and the tables of a backup whose files are all as they were written."""
    files = Folder(spark, root)
    if name not in backups(files):
        raise StoreError(f"there is no whole backup {name}")
    manifest, tables = json.loads(files.read(f"{name}.json")), {}
    for table, said in manifest["tables"].items():
        path = files.path(f"{name}/{table}")
        lengths = files.sizes(f"{name}/{table}")  # first without reading them: a short file may not be readable at all
        wrong = sorted(f for f in {*lengths, *said["files"]} if lengths.get(f) != said["files"].get(f, [None])[0])
        found = {} if wrong or not lengths else _digests(spark, path)
        wrong = wrong or sorted(f for f in {*found, *said["files"]} if found.get(f) != said["files"].get(f))
        if wrong:
            raise StoreError(f"backup {name}: {table} has lost or changed {', '.join(wrong)}")
        empty = spark.createDataFrame([], lifecycle.TABLES[table])
        tables[table] = spark.read.schema(empty.schema).parquet(path) if found else empty
        if tables[table].count() != said["rows"]:
            raise StoreError(f"backup {name}: {table} has not {said['rows']} rows")
    return manifest, tables


def restore(spark: SparkSession, root: str, name: str, target: str) -> LifecycleStore:
    """A new store with the tables and stamps of a verified backup as its first version."""
    manifest, tables = verified(spark, root, name)
    store = LifecycleStore(spark, target, manifest["buckets"])
    if store.current():
        raise StoreError(f"{target} holds a store already")
    store.load(tables, manifest["stamps"])
    return store
