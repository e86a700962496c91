"""Captured pages as a stream of lifecycle runs: each day is applied to the store once.

A micro-batch first lands its pages in a folder of its own number, so a replayed one
writes the same again.  A day is complete when a page of a later day has come (or the stream is
finished); then it is one run of the store.  The days that were applied, and the micro-batch that completed each, are
published in the same file as the tables, so a crash at any point leaves either neither or
both: between tables and version the day is applied again to the version before, behind it the
replayed micro-batch finds it done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lifecycle import RunOptions
from ..plans.files import Folder
from ..plans.store import LifecycleStore

_LISTING = "id: string, title: string, company: string, prefecture: string, date_posted: string, url: string, source_ids: map<string,string>, source_urls: map<string,string>, payload: string"

#: A captured page: how it went, and its listings in order.
CAPTURED = f"day string, source string, keyword string, page long, status string, coverage_complete boolean, listings array<struct<{_LISTING}>>"


def run_batch(pages: DataFrame) -> DataFrame:
    """The listings of a day's pages as the batch of a run, in order of source, keyword, page and place."""
    flat = pages.select("source", "keyword", "page", F.posexplode("listings").alias("place", "x"))
    return flat.select("x.*", F.struct("source", "keyword", "page", "place").alias("_ord"))


def run_sources(pages: DataFrame) -> DataFrame:
    """source, status, coverage_complete, kept, total of a day's pages.

    A source is covered if every page that says something says so; its status is success if a page was read, else that of its last page.
    """
    kept = F.sum(F.greatest(F.size("listings"), F.lit(0))).cast("int")
    status = F.when(F.count_if(F.col("status") == "success") > 0, "success").otherwise(F.max_by("status", F.struct("page", "keyword")))
    return pages.groupBy("source").agg(status.alias("status"), F.bool_and("coverage_complete").alias("coverage_complete"), kept.alias("kept"), kept.alias("total"))


class ScanStream:
    """Applies a stream of captured pages to a store, under a name that its days are noted by."""

    def __init__(self, store: LifecycleStore, options: Callable[[str], RunOptions], name: str = "scan"):
        self.store, self._options, self._name = store, options, name
        self._root = f"{store.root}/arrivals/{name}"
        self._files = Folder(store.spark, self._root)

    def done(self) -> dict[str, int]:
        """Applied days, and the micro-batch that completed each."""
        return self.store.stamps().get(self._name, {})

    def arrivals(self) -> DataFrame:
        """All pages that came, with their micro-batch and whether they came late: when their day, or a later one, was applied already."""
        spark = self.store.spark
        rows = spark.read.schema(f"{CAPTURED}, batch int").option("basePath", self._root).parquet(self._root) if self._files.names() else spark.createDataFrame([], f"{CAPTURED}, batch int")
        late = F.lit(False)
        for day, number in self.done().items():
            late = late | ((F.col("day") <= day) & (F.col("batch") > number))
        return rows.withColumn("late", late)

    def late(self) -> DataFrame:
        """Pages that no run has read, for they came too late."""
        return self.arrivals().where("late").drop("late")

    def __call__(self, pages: DataFrame, number: int) -> None:
        """A micro-batch, for foreachBatch."""
        pages.write.mode("overwrite").parquet(f"{self._root}/batch={number}")
        self._apply(number, False)

    def finish(self) -> None:
        """Apply the last day too: no more pages of it are to come."""
        numbers = [int(x.partition("=")[2]) for x in self._files.names() if x.startswith("batch=")]
        if numbers:
            self._apply(max(numbers), True)

    def _apply(self, number: int, finished: bool) -> None:
        done = self.done()
        waiting = self.arrivals().where(~F.col("late") & (F.col("batch") <= number))
        days = sorted(r[0] for r in waiting.select("day").distinct().collect() if r[0] and r[0] not in done)
        newest = max([*days, *done], default=None)
        for day in days if finished else [d for d in days if d < newest]:
            pages = waiting.where(F.col("day") == day)
            done = done | {day: number}
            self.store.save_run(run_batch(pages), run_sources(pages), self._options(day), stamp={self._name: done})


def run(stream: DataFrame, scans: ScanStream, checkpoint: str, finish: bool = True) -> None:
    """Run a stream of captured pages over what there is."""
    q = stream.writeStream.foreachBatch(scans).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if finish:
        scans.finish()
