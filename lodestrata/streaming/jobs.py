"""Streams with the same results as the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coverage import PageOptions
from ..operators.lifecycle import RunOptions
from ..plans.session import shared_folder
from ..plans.store import LifecycleStore
from . import scans
from .pages import stops


def _places(spark: SparkSession) -> tuple[str, str]:
    """Folders for a stream's checkpoint and its output, where all executors see them."""
    own = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    return f"{own}/state", f"{own}/out"


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, exactly once, and read what it wrote."""
    spark = stream.sparkSession
    state, out = _places(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema)
    if any(f.endswith("/events.parquet") for f in table.inputFiles()):  # a file by itself: its folder is the source
        return stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.parquet(path)


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, day, n, users: days of the event table as a stream with its final state."""
    e = _events(spark, sf_dir)
    days = e.groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("user_id")).cast("long").alias("users"))
    return run_once(days, "complete")


def page_stops(pages: DataFrame, o: PageOptions) -> DataFrame:
    """Where each crawl of a table of pages stops, through the stream; the same as coverage.first_stop()."""
    spark = pages.sparkSession
    source, _ = _places(spark)
    pages.write.parquet(f"{source}-pages")  # the landing folder of the stream
    return run_once(stops(spark.readStream.schema(pages.schema).parquet(f"{source}-pages"), o))


def lifecycle_of_days(pages: DataFrame, days: tuple[str, ...]) -> DataFrame:
    """Captured pages of some days through the stream of runs: sightings with the states of their listings."""
    spark = pages.sparkSession
    state, out = _places(spark)
    landing = f"{state}-pages"
    for day in days:  # a file of its own for each, in order
        pages.where(F.col("day") == day).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(scans.CAPTURED).option("maxFilesPerTrigger", 1).parquet(landing)
    applied = scans.ScanStream(LifecycleStore(spark, out, buckets=8), lambda day: RunOptions(f"{day}T00:00:00Z", "2023-12-01", day, missing_threshold=2))
    scans.run(stream, applied, state)
    tables = applied.store.state()
    status = tables["listings"].select(F.col("id").alias("job_id"), F.col("status").alias("listing_status"))
    return tables["sightings"].join(status, "job_id").select("job_id", "source", "source_id", "first_seen_at", "last_seen_at", "status", "missing_count", "listing_status")
