"""Filters that say which rule a row fails first."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .normalize import blank

#: Sources whose detail pages are never asked for.
SKIP_DETAIL_SOURCES = ("hellowork", "linkedin")


# Words that show a row of the public board is open to speakers of English (case as written).
ENGLISH_SIGNAL = "英語|外資|ﾊﾞｲﾘﾝｶﾞﾙ|バイリンガル|グローバル|英文|英会話|English|english|Bilingual|bilingual|global|海外|外国"


@dataclass
class FilterOptions:
    as_of: date
    keywords: list[str] = field(default_factory=list)
    prefecture: str | None = None
    days: int | None = None
    employment_types: list[str] = field(default_factory=list)
    language: str | None = None
    english_filter: bool = False
    include_unknown_dates: bool = True

    @property
    def wanted_language(self) -> str | None:
        return self.language or ("english" if self.english_filter else None)


def keyword_match(keywords: list[str], unicode: bool = True) -> Column:
    """Any keyword inside title, company, snippet and workplace, all in canonical form."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "company", "description_snippet", "workplace")]
    hay = text.canonical_text(F.concat_ws(" ", *parts), unicode)
    hits = [F.contains(hay, text.canonical_text(F.lit(k), unicode)) for k in keywords]
    return F.greatest(*hits, F.lit(False)) if hits else F.lit(True)


def filter_reason(o: FilterOptions, unicode: bool = True) -> Column:
    """Name of the first rule that a row fails, in the order keyword, region, employment, language, date; null keeps it."""
    rules: list[tuple[Column, str]] = []
    if o.keywords:
        rules.append((~keyword_match(o.keywords, unicode), "keyword_mismatch"))
    if o.prefecture:
        other = ~F.col("prefecture").eqNullSafe(o.prefecture)
        rules += [(other & blank(F.col("prefecture")), "unknown_prefecture"), (other, "prefecture_mismatch")]
    if o.employment_types:
        other = ~F.coalesce(F.col("employment_type").isin(o.employment_types), F.lit(False))
        rules += [(other & blank(F.col("employment_type")), "unknown_employment_type"), (other, "employment_type_mismatch")]
    if o.wanted_language:
        accepted = [o.wanted_language, *(["bilingual"] if o.wanted_language == "english" else [])]
        rules.append((~F.coalesce(F.arrays_overlap("language", F.array(*map(F.lit, accepted))), F.lit(False)), "language_mismatch"))
    if o.days is not None:
        posted = text.parse_date(F.col("date_posted"), unicode)
        end = F.lit(o.as_of).cast("date")
        if not o.include_unknown_dates:
            rules.append((posted.isNull(), "unknown_date"))
        rules += [(posted < F.date_sub(end, o.days), "before_date_window"), (posted > end, "after_date_window")]
    reason = F.lit(None).cast("string")
    for failed, name in reversed(rules):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    return reason


def apply_filter(df: DataFrame, o: FilterOptions, unicode: bool = True) -> DataFrame:
    """df with filter_reason."""
    return df.withColumn("filter_reason", filter_reason(o, unicode))


def kept(df: DataFrame) -> DataFrame:
    return df.where("filter_reason IS NULL").drop("filter_reason")


def board_filter(df: DataFrame, prefecture: str | None = None, english: bool = False) -> DataFrame:
    """Rows of the public board for a region (or with 東京 in the workplace) and with an English signal."""
    if prefecture:
        df = df.where(F.col("prefecture").eqNullSafe(prefecture) | F.contains(F.coalesce("workplace", F.lit("")), F.lit("東京")))
    if english:
        df = df.where(F.concat(F.coalesce("title", F.lit("")), F.coalesce("description_snippet", F.lit(""))).rlike(ENGLISH_SIGNAL))
    return df


def plain_keyword(df: DataFrame, keyword: str | None, column: str = "title") -> DataFrame:
    """Rows whose text holds the keyword in any case; an empty one keeps all."""
    return df.where(F.contains(F.lower(column), F.lit(keyword.lower()))) if keyword else df


def reason_histogram(df: DataFrame) -> DataFrame:
    return df.where("filter_reason IS NOT NULL").groupBy("filter_reason").agg(F.count(F.lit(1)).alias("n"))


def filtered_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count_if(F.col("filter_reason").isNotNull()).alias("filtered"), F.count_if(F.col("filter_reason").isNull()).alias("kept"))


def needs_details(df: DataFrame, skip: DataFrame, as_of: date, days: int) -> DataFrame:
    """Rows worth a detail page: source not skipped, key not in skip(source, source_id), date unknown or in the window."""
    posted = text.parse_date(F.col("date_posted"), unicode=False)
    end = F.lit(as_of).cast("date")
    fresh = posted.isNull() | posted.between(F.date_sub(end, days), end)
    return df.where(~F.col("source").isin(*SKIP_DETAIL_SOURCES) & fresh).join(skip, ["source", "source_id"], "left_anti")


def hydrate_dates(df: DataFrame, known: DataFrame) -> DataFrame:
    """Missing dates from known(source, source_id, known_date)."""
    joined = df.join(known, ["source", "source_id"], "left")
    return joined.withColumn("date_posted", F.coalesce(F.when(~blank(F.col("date_posted")), F.col("date_posted")), "known_date")).drop("known_date")


def status_of_error(error: Column) -> Column:
    """Status class of an error text."""
    e = F.lower(error)
    return F.when(e.rlike("403|429|blocked|datadome|cloudflare|captcha"), "blocked").when(e.rlike("parse|selector|missing"), "parse_error").otherwise("error")
