"""A scan over raw listings: normalise, filter with reasons, resolve, count."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import listing_id
from ..operators import filtering, resolve
from ..operators.normalize import blank, normalize_listings
from .session import checkpointed


@dataclass
class ScanOptions:
    filter: filtering.FilterOptions
    dedup: bool = True
    unicode: bool = True
    warnings: list[str] = field(default_factory=list)


@dataclass
class ScanResult:
    listings: DataFrame
    per_source: DataFrame
    filter_reasons: DataFrame
    warnings: list[str]


def scan(raw: DataFrame, o: ScanOptions, known_dates: DataFrame | None = None, crawl: DataFrame | None = None) -> ScanResult:
    """The bundle of one run.

    raw has the listing schema; known_dates(source, source_id, known_date) fills dates in;
    crawl(source, pages_fetched, coverage_complete, error) says how reading each source went.
    """
    df = raw.withColumn("id", F.when(blank(F.col("id")), listing_id(F.col("source"), F.col("source_id"))).otherwise(F.col("id")))
    df = normalize_listings(df, o.unicode)
    if known_dates is not None:
        df = filtering.hydrate_dates(df, known_dates)
    judged = checkpointed(filtering.apply_filter(df, o.filter, o.unicode))  # four results read it
    kept = filtering.kept(judged)
    listings = checkpointed(resolve.resolve(kept, o.unicode) if o.dedup else resolve.stamp_sources(kept))
    per_source = filtering.filtered_by_source(judged).withColumnRenamed("kept", "raw_kept").withColumn("raw_total", F.col("filtered") + F.col("raw_kept"))
    per_source = per_source.join(resolve.count_by_source(listings), "source", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    if crawl is not None:
        per_source = crawl.join(per_source, "source", "left")
        has = F.coalesce("raw_total", F.lit(0)) > 0
        failed = F.col("error").isNotNull()
        status = F.when(has & failed, "partial").when(has, "success").when(failed, filtering.status_of_error(F.col("error"))).otherwise("no_results")
        per_source = per_source.withColumn("status", status)
    return ScanResult(listings, per_source, filtering.reason_histogram(judged), list(dict.fromkeys(o.warnings)))
