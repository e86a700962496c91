"""Whole-row normalisation of listings: one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text

FLAGS = {"missing_company": "company", "missing_description": "description_snippet", "missing_date": "date_posted", "missing_prefecture": "prefecture"}


def blank(c: Column) -> Column:
    """Whether a value counts as missing."""
    return F.coalesce(c, F.lit("")) == ""


def normalize_listings(df: DataFrame, unicode: bool = True) -> DataFrame:
    """Clean texts, find region, remote, employment and languages, fill the source maps, renew the managed flags.

    unicode=False is for texts in composed form: it keeps the projection inside the JVM.
    """
    clean = lambda c: text.clean_text(F.col(c), unicode)
    step = df.withColumns(
        {
            "title": clean("title"),
            "company": text.normalize_company(F.col("company"), unicode),
            "description": clean("description"),
            "workplace": clean("workplace"),
            "date_posted": text.normalize_date(F.col("date_posted"), unicode),
        }
    )
    snippet = F.when(blank(F.col("description_snippet")), F.substring("description", 1, 400)).otherwise(F.col("description_snippet"))
    step = step.withColumn("description_snippet", F.substring(text.clean_text(snippet, unicode), 1, 400))
    step = step.withColumn("prefecture", F.coalesce(geo.detect_region(F.col("workplace"), unicode), F.col("prefecture")))
    parts = [F.when(~blank(c), c) for c in (F.col("title"), F.col("description_snippet"), F.col("workplace"), F.col("wage.raw"))]
    combined = F.concat_ws(" ", *parts)
    step = step.withColumns(
        {
            "prefecture_name": F.when(blank(F.col("prefecture")), F.col("prefecture_name")).otherwise(geo.slug_to_name(F.col("prefecture"))),
            "remote": F.coalesce(F.col("remote"), text.infer_remote(combined)),
            "employment_type": F.when(blank(F.col("employment_type")), text.infer_employment(combined)).otherwise(F.col("employment_type")),
            "language": F.array_distinct(F.concat(F.coalesce("language", F.array().cast("array<string>")), text.infer_languages(combined))),
            "source_urls": _filled_map("source_urls", "url"),
            "source_ids": _filled_map("source_ids", "source_id"),
        }
    )
    return renew_flags(step)


def _filled_map(name: str, value: str) -> Column:
    return F.when(F.coalesce(F.size(name), F.lit(0)) < 1, F.create_map("source", value)).otherwise(F.col(name))


def renew_flags(df: DataFrame) -> DataFrame:
    """Managed flags as the columns now are, other flags as they were, sorted."""
    own = F.array_compact(F.array(*(F.when(blank(F.col(c)), F.lit(k)) for k, c in FLAGS.items())))
    foreign = F.array_except(F.coalesce("quality_flags", F.array().cast("array<string>")), F.array(*map(F.lit, FLAGS)))
    return df.withColumn("quality_flags", F.array_sort(F.array_distinct(F.concat(foreign, own))))


def fingerprint(company: Column, title: Column, unicode: bool = True) -> Column:
    """Canonical company and title; null if either is empty."""
    c, t = text.canonical_text(company, unicode), text.canonical_text(title, unicode)
    return F.when((c != "") & (t != ""), F.concat(c, F.lit("|"), t))
