"""Push of the stored listings to another service, in chunks that survive a crash at any step.

Under root: outbox/<run>/chunks (gzip JSON), outbox/<run>/hashes (a table) and, written last, outbox/<run>/state.json,
which makes the run pending.  A pending run is sent again until the other side has it complete; then its hashes become the
state that the next run is compared with, by one file in state/.  The same run has the same name and chunks, so sending it twice does no harm.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import SyncError
from ..operators import delta
from .files import Folder

#: Takes run, chunk number, body, timestamp and signature; returns the other side's answer.
Push = Callable[[str, int, bytes, str, str], dict]

MIN_SECRET = 32

_log = logging.getLogger(__name__)


def read_state(files: Folder) -> dict:
    """The last run that was taken as complete; empty before the first."""
    done = [x for x in files.names("state") if x.endswith(".json") and not x.startswith(".")]
    return json.loads(files.read(f"state/{done[-1]}")) if done else {}


def previous_hashes(spark: SparkSession, files: Folder, state: dict) -> DataFrame:
    if not state:
        return spark.createDataFrame([], "id string, hash string")
    return spark.read.parquet(files.path(f"state/{state['runId']}"))


def create_run(spark: SparkSession, files: Folder, docs: DataFrame, run: dict, health: list[dict], state: dict, checksum: str, size: int = delta.CHUNK_ROWS) -> str:
    """Write a run to the outbox; its name."""
    name = delta.run_id(run["scannedAt"], checksum)
    at = f"outbox/{name}"
    if files.exists(f"{at}/state.json"):
        return name
    previous = previous_hashes(spark, files, state)
    bodies = delta.envelopes(docs, previous, run | {"manifestChecksum": checksum}, health, name, size)
    # A folder for each chunk, so that its number survives the format.
    bodies.write.mode("overwrite").partitionBy("chunk").option("compression", "gzip").text(files.path(f"{at}/chunks"))
    docs.select("id", "hash").write.mode("overwrite").parquet(files.path(f"{at}/hashes"))
    head = {"schemaVersion": 1, "runId": name, "scannedAt": run["scannedAt"], "manifestChecksum": checksum, "jobCount": docs.count(), "changedCount": delta.changed(docs, previous).count(), "chunkCount": len(_chunks(files, name))}
    files.publish(f"{at}/state.json", json.dumps(head, sort_keys=True).encode())
    return name


def _chunks(files: Folder, name: str) -> list[int]:
    return sorted(int(x.partition("=")[2]) for x in files.names(f"outbox/{name}/chunks") if x.startswith("chunk="))


def send_run(files: Folder, name: str, push: Push, secret: str) -> dict:
    """Push all chunks of a pending run, one in memory at a time; its state."""
    answer: dict = {}
    for k in _chunks(files, name):
        folder = f"outbox/{name}/chunks/chunk={k}"
        (part,) = (x for x in files.names(folder) if x.endswith(".gz"))
        body, now = files.read(f"{folder}/{part}"), str(int(time.time()))
        answer = push(name, k, body, now, delta.signature(now, body, secret))
    if not answer.get("complete"):
        raise SyncError(f"run {name} was not taken as complete")
    return json.loads(files.read(f"outbox/{name}/state.json"))


def commit_run(files: Folder, name: str, state: dict) -> None:
    """The run's hashes become the state; a crash in between leaves a run that is sent once more."""
    if files.exists(f"outbox/{name}/hashes"):
        files.delete(f"state/{name}")
        files.move(f"outbox/{name}/hashes", f"state/{name}")
    done = [int(x.partition("-")[0]) for x in files.names("state") if x.endswith(".json") and not x.startswith(".")]
    files.publish(f"state/{max(done, default=0) + 1:012d}-{name}.json", json.dumps(state, sort_keys=True).encode())
    files.delete(f"outbox/{name}")
    for old in files.names("state"):  # hashes of earlier runs are compared with no more
        if not old.endswith(".json") and not old.startswith(".") and old != name:
            files.delete(f"state/{old}")


def sync(docs: DataFrame, run: dict, health: list[dict], root: str, push: Push, secret: str, size: int = delta.CHUNK_ROWS) -> dict:
    """Drain what is pending, then push what changed since; the state after it.

    docs: id, doc, hash of all stored listings; run has scannedAt.
    """
    if len(secret) < MIN_SECRET:
        raise ValueError(f"the secret must have at least {MIN_SECRET} characters")
    spark = docs.sparkSession
    files = Folder(spark, root)
    for name in files.names("outbox"):
        if files.exists(f"outbox/{name}/state.json"):
            commit_run(files, name, send_run(files, name, push, secret))
    state = read_state(files)
    checksum = delta.map_checksum(docs)
    if state.get("scannedAt") == run["scannedAt"] and state.get("manifestChecksum") == checksum:
        return state
    name = create_run(spark, files, docs, run, health, state, checksum, size)
    commit_run(files, name, send_run(files, name, push, secret))
    return read_state(files)


def daily(job: Callable[[], None], due: str, clock: Callable[[], object], sleep: Callable[[float], None], rounds: int | None = None) -> None:
    """Run a job (scan, save, sync) once a day at `due`; after a failure again, later each time."""
    from .store import retry_delay, seconds_until_due

    last, failures, done = None, 0, 0
    while rounds is None or done < rounds:
        sleep(max(seconds_until_due(clock(), due, last), retry_delay(failures)))
        try:
            job()
            last, failures = clock(), 0
        except Exception:
            failures += 1
            _log.exception("run failed, %d in a row", failures)
        done += 1
