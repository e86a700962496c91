"""Entity resolution of listings: native keys first, then equal fingerprints across sources.

Within a fingerprint, each row in arrival order joins the first cluster that lacks its
source and has a compatible region.  Where a fingerprint has at most one region,
that is the k-th cluster for the k-th row of a source, which a window gives.  Only fingerprints with several regions are folded
row by row, each by itself.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.schema import canonical_id
from .sample import ranked
from ..plans.session import written
from .normalize import blank, fingerprint, renew_flags

FILL = ("company", "workplace", "prefecture", "prefecture_name", "city", "employment_type", "matched_keyword")


def native_dedup(df: DataFrame, keys: tuple[str, ...] = ("source", "source_id"), order: str = "_ord") -> DataFrame:
    """The first row of each native key."""
    first = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def assign_clusters(df: DataFrame) -> DataFrame:
    """df(fp, source, prefecture, _ord) with `cluster`, its number inside the fingerprint; null fp gives null.

    A fingerprint may be a whole text, so clusters are worked out over its digest in a thin table.
    """
    region = F.when(~blank(F.col("prefecture")), F.col("prefecture"))
    key = F.sha2("fp", 256)
    known = written(df.where("fp IS NOT NULL").select(key.alias("key"), "source", region.alias("region"), "_ord"), "fingerprints")
    regions = known.groupBy("key").agg(F.coalesce(F.min("region") != F.max("region"), F.lit(False)).alias("mixed"))
    mixed = regions.where("mixed").select("key")
    nth = F.row_number().over(W.partitionBy("key", "source").orderBy("_ord"))
    plain = known.join(mixed, "key", "left_anti").select("key", "_ord", nth.cast("long").alias("cluster"))
    folded = known.join(mixed, "key", "left_semi").groupBy("key").applyInPandas(_fold, "key string, _ord bigint, cluster bigint")
    clusters = plain.unionByName(folded).withColumnsRenamed({"_ord": "_place", "key": "_key"})
    return df.join(clusters, (key == F.col("_key")) & (F.col("_ord") == F.col("_place")), "left").drop("_key", "_place")


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """Clusters of one fingerprint whose rows name several regions."""
    rows = rows.sort_values("_ord")
    clusters: list[tuple[set, list]] = []
    number = []
    for source, region in zip(rows["source"], rows["region"].where(rows["region"].notna(), None), strict=True):
        for k, (sources, own) in enumerate(clusters):
            if source not in sources and (own[0] is None or region is None or own[0] == region):
                sources.add(source)
                own[0] = own[0] or region
                number.append(k + 1)
                break
        else:
            clusters.append(({source}, [region]))
            number.append(len(clusters))
    return pd.DataFrame({"key": rows["key"], "_ord": rows["_ord"], "cluster": number})


def merge_clusters(df: DataFrame) -> DataFrame:
    """One listing for each (fp, cluster); its row stands at the cluster's first place.  `canonical` is the identifier of the fingerprint."""
    rows = lambda c: F.array_sort(F.collect_list(F.struct("_ord", c)))

    def first_filled(name: str) -> Column:
        return F.coalesce(F.min_by(F.when(~blank(F.col(name)), F.col(name)), F.when(~blank(F.col(name)), F.col("_ord"))), F.min_by(F.col(name), "_ord"))

    def union(name: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(rows(name), lambda x: F.coalesce(x[name], F.array().cast("array<string>")))))

    def longest(name: str) -> Column:
        return F.max_by(name, F.struct(F.char_length(F.coalesce(name, F.lit(""))), -F.col("_ord")))

    def maps(name: str) -> Column:
        listed = F.array_sort(F.collect_list(F.struct("_ord", F.map_entries(name).alias("entries"))))
        entries = F.flatten(F.transform(listed, lambda x: x["entries"]))
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda f: f["key"] == e["key"]))
        return F.map_from_entries(last)

    has_wage = ~blank(F.col("wage.raw")) | (F.coalesce("wage.min", F.lit(0)) != 0) | (F.coalesce("wage.max", F.lit(0)) != 0)
    keep_first = ["source", "source_id", "url", "title", "scraped_at", "detail_status", "first_seen_at", "last_seen_at"]
    n = F.count(F.lit(1))
    out = df.groupBy("fp", "cluster").agg(
        n.alias("merged_rows"),
        F.min("_ord").alias("_first"),
        F.when(n > 1, F.first("canonical")).otherwise(F.min_by("id", "_ord")).alias("id"),
        *(F.min_by(c, "_ord").alias(c) for c in keep_first),
        *(first_filled(c).alias(c) for c in FILL),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_ord", F.array_append(F.coalesce("found_on", F.array().cast("array<string>")), F.col("source")).alias("on")))), lambda x: x["on"]))).alias("found_on"),
        longest("description").alias("description"),
        longest("description_snippet").alias("description_snippet"),
        F.coalesce(F.min_by(F.when(has_wage, F.col("wage")), F.when(has_wage, F.col("_ord"))), F.min_by("wage", "_ord")).alias("wage"),
        F.max(F.when(~blank(F.col("date_posted")), F.col("date_posted"))).alias("date_posted"),
        F.when(F.bool_or("remote"), True).otherwise(F.min_by("remote", "_ord")).alias("remote"),
        union("language").alias("language"),
        union("quality_flags").alias("quality_flags"),
        maps("source_urls").alias("source_urls"),
        maps("source_ids").alias("source_ids"),
    )
    return renew_flags(out.withColumnRenamed("_first", "_ord"))


def resolve(df: DataFrame, unicode: bool = True, fp: Column | None = None) -> DataFrame:
    """Listings after both kinds of dedup, with merged_rows; rows without fingerprint stay alone.

    `fp` is the fingerprint where it isn't that of company and title.
    """
    fp = fingerprint(F.col("company"), F.col("title"), unicode) if fp is None else fp
    keyed = native_dedup(df).withColumn("_fp", fp)
    # From here on a fingerprint is its digest: it is a key of every step, and may be as long as a text.
    keyed = written(keyed.withColumns({"fp": F.sha2("_fp", 256), "canonical": canonical_id(F.col("_fp"))}).drop("_fp"), "keyed")
    placed = assign_clusters(keyed)
    merged = merge_clusters(placed.where("fp IS NOT NULL"))
    alone = placed.where("fp IS NULL")
    alone = alone.withColumns({"merged_rows": F.lit(1).cast("long"), "found_on": F.array_distinct(F.array_append(F.coalesce("found_on", F.array().cast("array<string>")), F.col("source")))})
    return merged.unionByName(alone.select(merged.columns)).drop("fp", "cluster")


def stamp_sources(df: DataFrame) -> DataFrame:
    """Without dedup, each row only notes its own source."""
    return df.withColumn("found_on", F.array_union(F.coalesce("found_on", F.array().cast("array<string>")), F.array("source")))


def count_by_source(df: DataFrame) -> DataFrame:
    """Rows by each source they were found on; a merged row counts for all of its sources."""
    return df.select(F.explode("found_on").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("total"))


def order() -> list[Column]:
    """Newest first, undated last; ties by source, title, arrival, nulls last in each."""
    return [F.col("date_posted").desc_nulls_last(), F.col("source").asc_nulls_last(), F.lower("title").asc_nulls_last(), F.col("_ord").asc_nulls_last()]


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(*order())


def numbered(df: DataFrame) -> DataFrame:
    """df whose _ord is the place in that order, from 0."""
    return ranked(df, order()).drop("_ord", "_total").withColumnRenamed("_rank", "_ord")
