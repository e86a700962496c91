"""Lifecycle of listings over runs: new, seen, missing, withdrawn, expired, purged.

State is a set of tables (listings, sightings, source_runs, runs, attempts, stale); a run gives the
rows of each that change.  The store writes these alone and publishes them as one version.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.schema import LISTING
from ..plans.session import Scratch

LISTINGS = (
    "id string, title string, company string, prefecture string, date_posted string, first_seen_at string, last_seen_at string, status string, "
    "missing_count int, last_checked_at string, withdrawn_at string, expired_at string, removal_reason string, payload string"
)
SIGHTINGS = (
    "job_id string, source string, source_id string, url string, first_seen_at string, last_seen_at string, status string, missing_count int, "
    "last_checked_at string, withdrawn_at string"
)
SOURCE_RUNS = (
    "scanned_at string, source string, status string, kept int, total int, coverage_complete boolean, reconciliation_applied boolean, reconciliation_reason string"
)
RUNS = "scanned_at string, window_start string, window_end string, total int"
ATTEMPTS = "source string, source_id string, attempted_at string, status string"
#: Listings whose sightings changed since their states were worked out.
STALE = "id string"
TABLES = {"listings": LISTINGS, "sightings": SIGHTINGS, "source_runs": SOURCE_RUNS, "runs": RUNS, "attempts": ATTEMPTS, "stale": STALE}

LIVE = ("active", "missing")
#: Runs of which the median is the baseline, its least size to count, and the share under which a run is a sudden drop.
HISTORY, BASELINE_FLOOR, DROP_RATIO = 7, 10, 0.20


@dataclass
class RunOptions:
    scanned_at: str
    window_start: str
    window_end: str
    maintenance: bool = True
    missing_threshold: int = 3
    retention_days: int = 90
    purge_grace_days: int = 30
    sudden_drop_ratio: float = DROP_RATIO

    def __post_init__(self):
        if self.maintenance and not (self.window_start and self.window_end):
            raise ValueError("maintenance needs a bounded window")
        if self.missing_threshold < 1 or self.retention_days < 1 or self.purge_grace_days < 0:
            raise ValueError("thresholds must be positive")

    def day(self, back: int) -> str:
        return (date.fromisoformat(self.window_end) - timedelta(days=back)).isoformat()


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {k: spark.createDataFrame([], v) for k, v in TABLES.items()}


def in_window(o: RunOptions) -> Column:
    return F.try_to_date("date_posted").between(F.lit(o.window_start).cast("date"), F.lit(o.window_end).cast("date"))


def latest_sightings(sightings: DataFrame) -> DataFrame:
    """The last seen sighting of each (source, source_id)."""
    last = W.partitionBy("source", "source_id").orderBy(F.desc("last_seen_at"), "job_id")
    return sightings.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def known_dates(sightings: DataFrame, listings: DataFrame) -> DataFrame:
    """source, source_id, known_date of live sightings whose listing has a date."""
    live = sightings.where(F.col("status").isin(*LIVE)).select("job_id", "source", "source_id")
    dated = listings.where("coalesce(date_posted, '') != ''").select(F.col("id").alias("job_id"), F.col("date_posted").alias("known_date"))
    return live.join(dated, "job_id").select("source", "source_id", "known_date")


def detail_skip_keys(sightings: DataFrame, attempts: DataFrame, as_of: str, retry_days: int = 7) -> DataFrame:
    """Keys that need no detail page: live ones, and those tried within the retry window."""
    recent = attempts.where(F.to_date(F.substring("attempted_at", 1, 10)) >= F.date_sub(F.lit(as_of).cast("date"), retry_days))
    return sightings.where(F.col("status").isin(*LIVE)).select("source", "source_id").union(recent.select("source", "source_id")).distinct()


def baselines(source_runs: DataFrame) -> DataFrame:
    """source, baseline: median of what the last reconciled runs kept."""
    last = W.partitionBy("source").orderBy(F.desc("scanned_at"))
    recent = source_runs.where("reconciliation_applied").withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= HISTORY)
    return recent.groupBy("source").agg(F.median("kept").alias("baseline"))


def skip_reason(ratio: float = DROP_RATIO) -> Column:
    """Why a source's run must not mark anything as missing; null if it may."""
    status = F.col("status")
    drop = (F.col("baseline") >= BASELINE_FLOOR) & (F.col("current") < F.col("baseline") * ratio)
    return (
        F.when(~F.coalesce(status.isin("success", "no_results"), F.lit(False)), F.concat(F.lit("discovery_status_"), F.coalesce(status, F.lit(""))))
        .when(~F.col("coverage_complete").eqNullSafe(True), "coverage_incomplete")
        .when(drop, F.concat(F.lit("sudden_drop_"), F.col("current").cast("string"), F.lit("_of_"), F.col("baseline").cast("int").cast("string")))
    )


#: Fields of a payload that an older one fills in, that the longer text wins, and that are joined.
FILL = ("company", "workplace", "prefecture", "prefecture_name", "city", "employment_type", "matched_keyword", "detail_status")
LONGEST, JOINED, MAPS = ("description", "description_snippet"), ("language", "quality_flags", "found_on"), ("source_ids", "source_urls")


def merge_payload(old: Column, new: Column) -> Column:
    """JSON of a listing with what an older payload has more; the new one as it is where there is no older."""
    schema = LISTING.rpartition(", _ord")[0]
    a, b = F.from_json(old, schema), F.from_json(new, schema)
    text = lambda c: F.coalesce(c, F.lit(""))
    wage = lambda x: (text(x["wage"]["raw"]) != "") | (text(x["wage"]["unit"]) != "") | (F.coalesce(x["wage"]["min"], F.lit(0)) != 0) | (F.coalesce(x["wage"]["max"], F.lit(0)) != 0)
    none = F.array().cast("array<string>")
    empty = F.create_map().cast("map<string,string>")

    def field(name: str) -> Column:
        x, y = a[name], b[name]
        if name in FILL:
            return F.when(text(y) != "", y).when(text(x) != "", x).otherwise(y)
        if name in LONGEST:
            return F.when(F.char_length(text(x)) > F.char_length(text(y)), x).otherwise(y)
        if name == "wage":
            return F.when(wage(b), y).otherwise(F.coalesce(x, y))
        if name in JOINED:
            return F.array_distinct(F.concat(F.coalesce(x, none), F.coalesce(y, none)))
        if name in MAPS:
            entries = F.filter(F.map_entries(F.coalesce(x, empty)), lambda e: ~F.map_contains_key(F.coalesce(y, empty), e["key"]))
            return F.map_from_entries(F.concat(entries, F.map_entries(F.coalesce(y, empty))))
        return y

    names = [f.split()[0] for f in schema.split(", ")]
    merged = F.to_json(F.struct(*(field(n).alias(n) for n in names)), {"ignoreNullFields": "false"})
    return F.when(old.isNull() | a["source"].isNull(), new).otherwise(merged)


def classify(existing_status: Column, prior_status: Column) -> Column:
    """new, reactivated or known for a listing of the batch."""
    back = F.coalesce(existing_status != "active", F.lit(False)) | F.coalesce(~prior_status.isin(*LIVE), F.lit(False))
    return F.when(existing_status.isNull() & prior_status.isNull(), "new").when(back, "reactivated").otherwise("known")


def states(sightings: DataFrame) -> DataFrame:
    """job_id, state, missing_count, last_checked_at: the best state of its sightings."""
    rank = F.when(F.col("status") == "active", 3).when(F.col("status") == "missing", 2).when(F.col("status") == "withdrawn", 1).otherwise(0)
    g = sightings.groupBy("job_id").agg(F.max(rank).alias("_rank"), F.max("missing_count").alias("s_missing"), F.max("last_checked_at").alias("s_checked"))
    return g.select("job_id", F.element_at(F.array(*map(F.lit, ("expired", "withdrawn", "missing", "active"))), F.col("_rank") + 1).alias("state"), "s_missing", "s_checked")


def refresh(listings: DataFrame, sightings: DataFrame, at: str) -> DataFrame:
    """Listings with the states that their sightings give; those without sightings as they were."""
    j = listings.join(states(sightings), listings["id"] == F.col("job_id"), "left")
    has, state = F.col("state").isNotNull(), F.col("state")
    return j.withColumns(
        {
            "status": F.coalesce(state, "status"),
            "missing_count": F.when(has, F.coalesce("s_missing", F.lit(0))).otherwise(F.col("missing_count")).cast("int"),
            "last_checked_at": F.when(has, F.col("s_checked")).otherwise(F.col("last_checked_at")),
            "withdrawn_at": F.when(~has, F.col("withdrawn_at")).when(state == "withdrawn", F.coalesce("withdrawn_at", F.lit(at))),
            "expired_at": F.when(~has, F.col("expired_at")).when(state == "expired", F.coalesce("expired_at", F.lit(at))),
            "removal_reason": F.when(~has, F.col("removal_reason")).when(state == "withdrawn", "all_sources_withdrawn").when(state == "expired", "retention_window"),
        }
    ).select(listings.columns)


def expiring(listings: DataFrame, o: RunOptions) -> DataFrame:
    """Ids of live listings from before the retention window."""
    old = F.try_to_date("date_posted") < F.lit(o.day(o.retention_days)).cast("date")
    return listings.where(old & ~F.col("status").isin("withdrawn", "expired")).select("id")


def purging(listings: DataFrame, o: RunOptions) -> DataFrame:
    """Ids of tombstones whose grace is over."""
    cutoff = F.lit(o.day(o.purge_grace_days)).cast("date")
    gone = F.when(F.col("status") == "withdrawn", F.col("withdrawn_at")).when(F.col("status") == "expired", F.col("expired_at"))
    return listings.where(F.try_to_date(F.substring(gone, 1, 10)) <= cutoff).select("id")


def orphans(listings: DataFrame, sightings: DataFrame) -> DataFrame:
    return listings.join(sightings, listings["id"] == sightings["job_id"], "left_anti")


@dataclass
class Change:
    """What a run writes to a table: new forms of rows, and keys that go."""

    key: tuple[str, ...]
    upserts: DataFrame
    deletes: DataFrame

    def touched(self) -> DataFrame:
        return self.upserts.select(*self.key).unionByName(self.deletes.select(*self.key)).distinct()

    def apply(self, old: DataFrame) -> DataFrame:
        return old.join(self.touched(), list(self.key), "left_anti").select(self.upserts.columns).unionByName(self.upserts)


@dataclass
class RunResult:
    tables: dict[str, DataFrame]
    classes: DataFrame  # id, class
    marked: DataFrame  # sightings that this run marked, with their new status
    expired: DataFrame
    purged: DataFrame
    changes: dict[str, Change]
    scratch: Scratch  # holds all of these; dropped when they are stored


def missing(live: DataFrame, outcome: DataFrame, keys: DataFrame) -> DataFrame:
    """Live sightings of sources that count in this run and whose keys it didn't bring."""
    return live.join(outcome.where("reconciliation_applied").select("source"), "source", "left_semi").join(keys, ["source", "source_id"], "left_anti")


def mark_missing(rows: DataFrame, threshold: int, at: Column) -> DataFrame:
    """Missing sightings with one more miss, withdrawn from the threshold on."""
    n = F.col("missing_count") + 1
    gone = n >= threshold
    return rows.withColumns({"status": F.when(gone, "withdrawn").otherwise("missing"), "withdrawn_at": F.when(gone, at), "last_checked_at": at, "missing_count": n})


def apply_run(state: dict[str, DataFrame], batch: DataFrame, per_source: DataFrame, o: RunOptions, attempts: DataFrame | None = None) -> RunResult:
    """One run over the state, as changes to its tables.

    batch: id, title, company, prefecture, date_posted, first_seen_at?, source_ids and source_urls (maps), url,
    payload, _ord.  per_source: source, status, coverage_complete, kept, total.

    Only rows that change are written anywhere.  A listing's state is worked out anew where its sightings
    changed in this run, or since the states were worked out last (table stale); for all others it would come out the same.
    """
    scratch = Scratch(batch.sparkSession)
    keep = scratch.keep
    at, none = F.lit(o.scanned_at), F.lit(None).cast("string")
    listings, sightings, stale = state["listings"], state["sightings"], state["stale"]
    place, sighting = ["source", "source_id"], ["job_id", "source", "source_id"]
    # A repeated id is written twice in order: its last row stays.
    last = W.partitionBy("id").orderBy(F.desc("_ord"))
    rows = batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    keys = batch.select("id", "url", "source_urls", "_ord", F.explode("source_ids").alias("source", "source_id"))
    by_key = W.partitionBy("source", "source_id").orderBy(F.desc("_ord"))
    keys = keys.withColumn("_n", F.row_number().over(by_key)).where("_n = 1")
    keys = keep(keys.select(F.col("id").alias("job_id"), "source", "source_id", F.coalesce(F.try_element_at("source_urls", "source"), "url").alias("url")))
    replaced = keep(sightings.join(keys.select(place), place, "left_semi"))  # no more than the batch has keys, times the listings that one had
    prior = latest_sightings(replaced).select("source", "source_id", F.col("first_seen_at").alias("p_first"), F.col("status").alias("p_status"))
    seen = keys.join(prior, place, "left")
    # A prior sighting counts as live only if all of them are.
    known = seen.groupBy("job_id").agg(F.min("p_first").alias("p_first"), F.max_by("p_status", F.when(F.col("p_status").isin(*LIVE), 0).otherwise(1)).alias("p_status"))
    old = listings.join(rows.select("id"), "id", "left_semi").select(F.col("id").alias("job_id"), F.col("first_seen_at").alias("e_first"), F.col("status").alias("e_status"), F.col("payload").alias("e_payload"))
    joined = rows.join(known, rows["id"] == known["job_id"], "left").drop("job_id").join(old, F.col("id") == F.col("job_id"), "left").drop("job_id")
    first = F.coalesce("e_first", F.least("p_first", "e_first"), at)
    written = keep(joined.select(
        "id", "title", "company", "prefecture", "date_posted", first.alias("first_seen_at"), at.alias("last_seen_at"), F.lit("active").alias("status"), F.lit(0).alias("missing_count"),
        at.alias("last_checked_at"), none.alias("withdrawn_at"), none.alias("expired_at"), none.alias("removal_reason"), merge_payload(F.col("e_payload"), F.col("payload")).alias("payload"),
        classify(F.col("e_status"), F.col("p_status")).alias("class"),
    ))
    classes, written = written.select("id", "class"), written.drop("class")
    fresh = keep(seen.select("job_id", "source", "source_id", "url", F.coalesce("p_first", at).alias("first_seen_at"), at.alias("last_seen_at"), F.lit("active").alias("status"), F.lit(0).alias("missing_count"), at.alias("last_checked_at"), none.alias("withdrawn_at")))
    moved = replaced.select(sighting).join(fresh.select(sighting), sighting, "left_anti")

    none_yet = listings.sparkSession.createDataFrame([], "id string")
    marked, expired, purged, orphaned = fresh.limit(0), none_yet, none_yet, none_yet
    outcome = per_source.withColumns({"reconciliation_applied": F.lit(False), "reconciliation_reason": F.lit("maintenance_disabled")})
    named = lambda df, c: df.select(F.col(c).alias("id"))
    affected = named(fresh, "job_id").union(named(replaced, "job_id")).union(written.select("id"))
    new_listings, new_sightings, gone = written, fresh, moved
    if o.maintenance:
        others = sightings.join(keys.select(place), place, "left_anti")
        dated = listings.select("id", "date_posted").join(written.select("id"), "id", "left_anti").union(written.select("id", "date_posted")).where(in_window(o))
        live = others.unionByName(fresh).where(F.col("status").isin(*LIVE)).join(dated.select(F.col("id").alias("job_id")), "job_id", "left_semi")
        counted = live.groupBy("source").agg(F.count(F.lit(1)).alias("live"))
        current = keys.groupBy("source").agg(F.count_distinct("source_id").alias("current"))
        guard = per_source.join(baselines(state["source_runs"]), "source", "left").join(counted, "source", "left").join(current, "source", "left")
        guard = guard.withColumns({"current": F.coalesce("current", F.lit(0)), "baseline": F.coalesce("baseline", F.coalesce("live", F.lit(0)).cast("double"))})
        guard = guard.withColumn("reconciliation_reason", skip_reason(o.sudden_drop_ratio)).withColumn("reconciliation_applied", F.col("reconciliation_reason").isNull())
        outcome = keep(guard.select(outcome.columns))
        marked = keep(mark_missing(missing(live, outcome, keys), o.missing_threshold, at).select(fresh.columns))
        new_sightings = fresh.unionByName(marked)
        affected = keep(affected.union(named(marked, "job_id")).union(stale.select("id")).distinct())

        def present(ids: DataFrame) -> DataFrame:
            """Sightings of some listings as they stand after this run."""
            own = ids.withColumnRenamed("id", "job_id")
            untouched = sightings.join(own, "job_id", "left_semi").join(gone.unionByName(new_sightings.select(sighting)), sighting, "left_anti").select(fresh.columns)
            return untouched.unionByName(new_sightings.join(own, "job_id", "left_semi").select(fresh.columns))

        rest = listings.join(affected, "id", "left_anti")
        own = listings.join(affected, "id", "left_semi").join(written.select("id"), "id", "left_anti").select(written.columns).unionByName(written)
        refreshed = keep(refresh(own, present(affected), o.scanned_at))
        expired = keep(expiring(refreshed, o).union(expiring(rest, o)))
        hit = F.col("_expired").isNotNull()
        ids = expired.withColumn("_expired", F.lit(True))
        ended = refreshed.unionByName(rest.join(expired, "id", "left_semi").select(refreshed.columns)).join(ids, "id", "left").withColumns({"status": F.when(hit, "expired").otherwise(F.col("status")), "expired_at": F.when(hit, F.coalesce("expired_at", at)).otherwise(F.col("expired_at")), "removal_reason": F.when(hit, "retention_window").otherwise(F.col("removal_reason"))}).select(refreshed.columns)
        ended = keep(ended)
        over = keep(present(expired).withColumns({"status": F.lit("expired"), "last_checked_at": at}))
        new_sightings = new_sightings.join(over.select(sighting), sighting, "left_anti").unionByName(over.select(fresh.columns))
        purged = keep(purging(ended, o).union(purging(rest.join(expired, "id", "left_anti"), o)))
        gone = gone.unionByName(present(purged).select(sighting)).distinct()
        new_sightings = new_sightings.join(purged.withColumnRenamed("id", "job_id"), "job_id", "left_anti").select(fresh.columns)
        kept = ended.join(purged, "id", "left_anti")
        orphaned = keep(kept.join(present(kept.select("id")).select(F.col("job_id").alias("id")), "id", "left_anti").select("id"))
        new_listings = kept.join(orphaned, "id", "left_anti")
        stale = expired.join(purged.union(orphaned), "id", "left_anti")  # their checks are dated anew in the next run
    else:
        stale = stale.select("id").union(affected).distinct()
    spark = batch.sparkSession
    runs = spark.createDataFrame([(o.scanned_at, o.window_start, o.window_end, 0)], RUNS)
    new_sources = outcome.withColumn("scanned_at", at).selectExpr("scanned_at", "source", "status", "cast(kept as int) kept", "cast(total as int) total", "coverage_complete", "reconciliation_applied", "reconciliation_reason")
    if attempts is not None:
        tried = attempts.where("coalesce(source, '') != '' AND coalesce(source_id, '') != '' AND coalesce(status, '') != ''").select("source", "source_id", at.alias("attempted_at"), "status").dropDuplicates(place)
    nothing = lambda df, *key: df.select(*key).limit(0)
    changes = {
        "listings": Change(("id",), keep(new_listings), purged.union(orphaned)),
        "sightings": Change(tuple(sighting), keep(new_sightings.select(fresh.columns)), gone),
        "source_runs": Change(("scanned_at", "source"), new_sources, nothing(new_sources, "scanned_at", "source")),
        "runs": Change(("scanned_at",), runs, nothing(runs, "scanned_at")),
    }
    if attempts is not None:
        changes["attempts"] = Change(tuple(place), tried, nothing(tried, *place))
    changes["stale"] = Change(("id",), stale, state["stale"].select("id").join(stale, "id", "left_anti"))
    return RunResult(state | {k: c.apply(state[k]) for k, c in changes.items()}, classes, marked, expired, purged, changes, scratch)
