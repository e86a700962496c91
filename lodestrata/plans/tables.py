"""Listing-shaped views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import listing_id

#: The same views in SQL, for the oracles.
LISTING_SQL = """
    listing AS (
        SELECT o_orderpriority AS source, CAST(o_orderkey AS VARCHAR) AS source_id, c_name AS company, c_mktsegment AS title,
               lower(n_name) AS prefecture, o_orderstatus AS employment_type, strftime(o_orderdate, '%Y-%m-%d') AS date_posted,
               o_totalprice AS price, o_orderkey AS _ord
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""
SIGHTING_SQL = """
    sighting AS (
        SELECT 'u' || user_id AS job_id, event_type AS source, CAST(user_id AS VARCHAR) AS source_id, max(strftime(ts, '%Y-%m-%d')) AS last_seen_at,
               CASE max(event_id) % 3 WHEN 0 THEN 'withdrawn' WHEN 1 THEN 'active' ELSE 'missing' END AS status, CAST(max(event_id) % 3 AS INTEGER) AS missing_count
        FROM events GROUP BY user_id, event_type),
    job AS (SELECT 'u' || o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_posted, o_orderdate FROM orders)
"""
SEEN_SQL = """
    day AS (SELECT DISTINCT event_type AS source, CAST(ts AS DATE) AS d FROM events),
    seen AS (SELECT event_type AS source, user_id, max(CAST(ts AS DATE)) AS last FROM events GROUP BY 1, 2),
    missed AS (SELECT s.source, s.user_id, count(day.d) AS missed FROM seen s LEFT JOIN day ON day.source = s.source AND day.d > s.last GROUP BY 1, 2)
"""
PAGE_SQL = """
    page AS (
        SELECT event_type AS source, CAST(user_id % 5 AS VARCHAR) AS keyword, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY event_id) AS page,
               CAST(event_id % 11 AS INTEGER) AS "rows", CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(event_id % 11 AS INTEGER) END AS added, event_id % 13 <> 0 AS has_next
        FROM events)
"""


DATED_SQL = """
    dated AS (
        SELECT event_type AS source, CAST(user_id % 5 AS VARCHAR) AS keyword, CAST(user_id % 2 AS VARCHAR) AS context, row_number() OVER (PARTITION BY event_type, user_id % 5, user_id % 2 ORDER BY ts DESC, event_id) AS page,
               event_id % 11 AS "rows", CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 11 END AS added, CAST(ts AS DATE) AS day, event_id % 47 <> 0 AS has_next, CASE WHEN user_id % 5 = 4 THEN 6 END AS total_pages
        FROM events)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customers and nations as listings; only columns that are used are read."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.lit("")
    sid = F.col("o_orderkey").cast("string")
    return j.select(
        listing_id(F.col("o_orderpriority"), sid).alias("id"),
        F.col("o_orderpriority").alias("source"),
        sid.alias("source_id"),
        F.concat(F.lit("http://x/"), sid).alias("url"),
        F.array().cast("array<string>").alias("found_on"),
        F.col("c_mktsegment").alias("title"),
        F.col("c_name").alias("company"),
        none.alias("description"),
        none.alias("description_snippet"),
        none.alias("workplace"),
        F.lower("n_name").alias("prefecture"),
        F.col("n_name").alias("prefecture_name"),
        F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("boolean").alias("remote"),
        F.struct(F.col("o_totalprice").cast("bigint").alias("min"), F.lit(None).cast("bigint").alias("max"), F.lit(None).cast("string").alias("unit"), none.alias("raw")).alias("wage"),
        F.col("o_orderstatus").alias("employment_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_posted"),
        F.array().cast("array<string>").alias("language"),
        F.col("c_mktsegment").alias("matched_keyword"),
        F.lit(None).cast("string").alias("scraped_at"),
        F.create_map(F.col("o_orderpriority"), F.concat(F.lit("http://x/"), sid)).alias("source_urls"),
        F.create_map(F.col("o_orderpriority"), sid).alias("source_ids"),
        F.lit(None).cast("string").alias("detail_status"),
        F.array().cast("array<string>").alias("quality_flags"),
        F.lit(None).cast("string").alias("first_seen_at"),
        F.lit(None).cast("string").alias("last_seen_at"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").alias("_ord"),
    )


def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as listings: the text is the title, the language the company."""
    d = read(spark, sf_dir, "documents")
    base = listing(spark, sf_dir).limit(0)
    own = {"source": F.col("source"), "source_id": F.col("doc_id").cast("string"), "title": F.col("text"), "company": F.col("lang"), "_ord": F.col("doc_id"), "id": listing_id(F.col("source"), F.col("doc_id").cast("string"))}
    own |= {"source_urls": F.create_map("source", F.col("doc_id").cast("string")), "source_ids": F.create_map("source", F.col("doc_id").cast("string"))}
    return d.select(*(own.get(f.name, F.lit(None).cast(f.dataType) if f.name not in ("found_on", "language", "quality_flags") else F.array().cast("array<string>")).alias(f.name) for f in base.schema))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.date_format("ts", "yyyy-MM-dd")).alias("last_seen_at"), F.max("event_id").alias("e"))
    status = F.when(F.col("e") % 3 == 0, "withdrawn").when(F.col("e") % 3 == 1, "active").otherwise("missing")
    return g.select(F.concat(F.lit("u"), "user_id").alias("job_id"), F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("source_id"), "last_seen_at", status.alias("status"), (F.col("e") % 3).cast("int").alias("missing_count"), F.col("last_seen_at").alias("last_checked_at"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(F.concat(F.lit("u"), "o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(day).alias("date_posted"), "o_orderkey")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as crawled pages."""
    from pyspark.sql import Window as W

    e = read(spark, sf_dir, "events")
    n = F.row_number().over(W.partitionBy("event_type", F.col("user_id") % 5).orderBy("event_id"))
    rows = (F.col("event_id") % 11).cast("int")
    return e.select(
        F.col("event_type").alias("source"), (F.col("user_id") % 5).cast("string").alias("keyword"), F.lit("").alias("context"), n.alias("page"), rows.alias("rows"),
        F.when(F.col("event_id") % 3 == 0, 0).otherwise(rows).alias("added"), F.array().cast("array<string>").alias("dates"), (F.col("event_id") % 13 != 0).alias("has_next"),
        F.lit(None).cast("int").alias("total_pages"), F.lit(False).alias("date_ordered"), F.lit(False).alias("server_date_filtered"), F.lit(True).alias("stop_on_no_new"), F.lit(3).alias("no_new_tolerance"),
    )


def dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pages in two contexts, newest first, each with the day of its rows."""
    from pyspark.sql import Window as W

    e = read(spark, sf_dir, "events")
    n = F.row_number().over(W.partitionBy("event_type", F.col("user_id") % 5, F.col("user_id") % 2).orderBy(F.desc("ts"), "event_id"))
    rows = (F.col("event_id") % 11).cast("int")
    return e.select(
        F.col("event_type").alias("source"), (F.col("user_id") % 5).cast("string").alias("keyword"), (F.col("user_id") % 2).cast("string").alias("context"), n.alias("page"), rows.alias("rows"),
        F.when(F.col("event_id") % 3 == 0, 0).otherwise(rows).alias("added"), F.array(F.date_format("ts", "yyyy/MM/dd")).alias("dates"), (F.col("event_id") % 47 != 0).alias("has_next"),
        F.when(F.col("user_id") % 5 == 4, 6).alias("total_pages"), F.lit(True).alias("date_ordered"), F.lit(False).alias("server_date_filtered"), F.lit(True).alias("stop_on_no_new"), F.lit(3).alias("no_new_tolerance"),
    )


def captured_days(spark: SparkSession, sf_dir: str, days: tuple[str, ...]) -> DataFrame:
    """Events of some days as captured pages: a page for each source and day, with a listing for each user."""
    day = F.date_format("ts", "yyyy-MM-dd")
    e = read(spark, sf_dir, "events").where(F.to_date("ts").between(F.lit(days[0]).cast("date"), F.lit(days[-1]).cast("date"))).select(day.alias("day"), F.col("event_type").alias("source"), "user_id", (F.col("user_id") % 4).alias("page")).distinct()
    user = F.col("user_id").cast("string")
    one = F.struct(
        F.concat(F.lit("u"), user).alias("id"), F.lit("T").alias("title"), F.lit("C").alias("company"), F.lit(None).cast("string").alias("prefecture"), F.lit("2023-12-31").alias("date_posted"), F.lit("u").alias("url"),
        F.create_map("source", user).alias("source_ids"), F.create_map("source", F.lit("u")).alias("source_urls"), F.lit("{}").alias("payload"),
    )
    pages = e.withColumn("one", one).groupBy("day", "source", "page").agg(F.collect_list("one").alias("listings"))
    return pages.select("day", "source", F.lit("k").alias("keyword"), F.col("page").cast("long").alias("page"), F.lit("success").alias("status"), F.lit(True).alias("coverage_complete"), "listings")
