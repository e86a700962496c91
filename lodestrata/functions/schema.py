"""The listing schema and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WAGE = "struct<min:bigint,max:bigint,unit:string,raw:string>"
LISTING = (
    "id string, source string, source_id string, url string, found_on array<string>, title string, company string, description string, "
    "description_snippet string, workplace string, prefecture string, prefecture_name string, city string, remote boolean, "
    f"wage {WAGE}, employment_type string, date_posted string, language array<string>, matched_keyword string, scraped_at string, "
    "source_urls map<string,string>, source_ids map<string,string>, detail_status string, quality_flags array<string>, "
    "first_seen_at string, last_seen_at string, _ord bigint"
)
ORDER = "_ord"


def listing_id(source: Column, source_id: Column) -> Column:
    return F.substring(F.sha1(F.concat(source, F.lit(":"), source_id)), 1, 16)


def canonical_id(fingerprint: Column) -> Column:
    return F.substring(F.sha1(F.concat(F.lit("canonical:"), fingerprint)), 1, 16)
