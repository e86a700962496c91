"""Data-quality reports: completeness, dates, duplicates, by source and overall, and their change between runs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .normalize import blank

FIELDS = ("title", "company", "description_snippet", "workplace", "prefecture", "employment_type", "date_posted")


def has_wage() -> Column:
    return ~blank(F.col("wage.raw")) | (F.coalesce("wage.min", F.lit(0)) != 0) | (F.coalesce("wage.max", F.lit(0)) != 0)


def present(name: str) -> Column:
    if name == "language":
        return F.coalesce(F.size("language"), F.lit(0)) > 0
    return has_wage() if name == "wage" else ~blank(F.col(name))


def completeness(df: DataFrame, fields: tuple[str, ...] = (*FIELDS, "language", "wage"), by: list[str] | None = None) -> DataFrame:
    """field, present, total, rate (4 digits) for each field, overall or for each group."""
    by = by or []
    one = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(present(f)).alias(f"n_{f}") for f in fields))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("present")) for f in fields)))
    rate = F.when(F.col("total") > 0, F.round(F.col("present") / F.col("total"), 4)).otherwise(0.0)
    return one.select(*by, "total", each.alias("x")).select(*by, "x.field", "x.present", "total").withColumn("rate", rate)


def date_counts(start: date, end: date) -> list[Column]:
    """Six counts over date_posted."""
    d = text.analysis_date(F.col("date_posted"))
    return [
        F.count_if(d.isNotNull()).alias("known"),
        F.count_if(d.isNull() & blank(F.col("date_posted"))).alias("unknown"),
        F.count_if(d.isNull() & ~blank(F.col("date_posted"))).alias("invalid"),
        F.count_if(d.between(F.lit(start), F.lit(end))).alias("in_window"),
        F.count_if(d < F.lit(start)).alias("before_window"),
        F.count_if(d > F.lit(end)).alias("after_window"),
    ]


def date_metrics(df: DataFrame, start: date, end: date) -> DataFrame:
    return df.agg(*date_counts(start, end))


def native_duplicates(df: DataFrame) -> DataFrame:
    """native_groups, native_rows."""
    g = df.groupBy("source", "source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("native_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("native_rows"))


def cross_source_groups(df: DataFrame, unicode: bool = True) -> DataFrame:
    """company_key, title_key, n, sources of texts that several sources share."""
    keyed = df.withColumns({"company_key": text.analysis_text(F.col("company"), unicode), "title_key": text.analysis_text(F.col("title"), unicode)})
    g = keyed.where("company_key != '' AND title_key != ''").groupBy("company_key", "title_key")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.min("_ord").alias("first_ord")).where("sources > 1")


def report(df: DataFrame, start: date, end: date) -> DataFrame:
    """Rows, completeness and date counts overall (source null) and by source, in one pass."""
    d = df.groupingSets([[], ["source"]], "source")
    return d.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(present(f)).alias(f"n_{f}") for f in (*FIELDS, "wage")), *date_counts(start, end))


def keyword_histogram(df: DataFrame) -> DataFrame:
    """Most common keywords first, ties by first arrival."""
    g = df.groupBy("matched_keyword").agg(F.count(F.lit(1)).alias("n"), F.min("_ord").alias("first_ord"))
    return g.orderBy(F.desc("n"), "first_ord")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """field, rates before and after, change in percentage points (2 digits)."""
    b, a = (x.select("field", F.col("present").alias(f"{n}_present"), F.col("rate").alias(f"{n}_rate")) for x, n in ((before, "before"), (after, "after")))
    return b.join(a, "field").withColumn("delta_pp", F.round((F.col("after_rate") - F.col("before_rate")) * 100, 2))
