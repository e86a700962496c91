"""Delta export: documents with content hashes, what changed, manifest and chunks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .normalize import blank
from .sample import chunks

CHUNK_ROWS = 200


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON of the columns in order of their names, nulls kept."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in sorted(columns.items()))), {"ignoreNullFields": "false"})


def canonical_bytes(value: dict) -> bytes:
    """The same form of a small Python value; what JSON doesn't know stands as text."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str).encode()


def sorted_map(c: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(c)))


def export_columns() -> dict[str, Column]:
    """The export projection of stored listings."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    unnamed = blank(F.trim(e("company")))
    flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
    ids = F.when(~blank(F.col("source")) & ~blank(F.col("source_id")) & ~F.coalesce(F.map_contains_key("source_ids", F.coalesce("source", F.lit(""))), F.lit(False)), F.map_concat(F.coalesce("source_ids", F.create_map().cast("map<string,string>")), F.create_map("source", "source_id"))).otherwise(F.coalesce("source_ids", F.create_map().cast("map<string,string>")))
    url = F.when(~blank(F.col("url")), F.col("url")).otherwise(F.coalesce(F.try_element_at("source_urls", "source"), F.lit("")))
    body = F.concat_ws(" ", e("title"), e("description"), e("description_snippet"))
    plain = {"id": "id", "prefecture": "prefecture", "prefectureName": "prefecture_name", "city": "city", "remote": "remote", "employmentType": "employment_type", "datePosted": "date_posted"}
    return {k: F.col(c) for k, c in plain.items()} | {
        "source": e("source"),
        "sourceId": e("source_id"),
        "url": url,
        "title": e("title"),
        "company": F.when(unnamed, "Unknown company").otherwise(F.trim(e("company"))),
        "description": e("description"),
        "descriptionSnippet": F.substring(e("description_snippet"), 1, 2000),
        "workplace": e("workplace"),
        "wage": F.struct(F.col("wage.max").alias("max"), F.col("wage.min").alias("min"), F.coalesce("wage.raw", F.lit("")).alias("raw"), F.col("wage.unit").alias("unit")),
        "languages": F.coalesce("language", F.array().cast("array<string>")),
        "sourceIds": sorted_map(ids),
        "sourceUrls": sorted_map(F.coalesce("source_urls", F.create_map().cast("map<string,string>"))),
        "qualityFlags": F.when(unnamed, F.array_distinct(F.array_append(flags, F.lit("missing_company")))).otherwise(flags),
        "signals": F.transform(text.signals(body), lambda s: F.struct(s["confidence"].alias("confidence"), s["evidence"].alias("evidence"), s["extractorVersion"].alias("extractorVersion"), s["kind"].alias("kind"), s["value"].alias("value"))),
    }


def documents(stored: DataFrame) -> DataFrame:
    """id, doc, hash of every stored listing."""
    doc = canonical_json(export_columns())
    return stored.select("id", doc.alias("doc")).withColumn("hash", F.sha2("doc", 256))


def changed(docs: DataFrame, previous: DataFrame) -> DataFrame:
    """Documents whose (id, hash) isn't in the previous state."""
    return docs.join(previous.select("id", "hash"), ["id", "hash"], "left_anti")


def removed(docs: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.join(docs, "id", "left_anti")


def manifest(docs: DataFrame) -> DataFrame:
    """One row, checksum: SHA-256 over the sorted hashes of ranges of ids, so no task holds all of them."""
    part = docs.groupBy(F.substring(F.sha2("id", 256), 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "id", "hash"))), "\n"), 256).alias("h"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256).alias("checksum"), F.count(F.lit(1)).alias("parts"))


def map_checksum(docs: DataFrame) -> str:
    """SHA-256 of the JSON object of all hashes by id, in order of the ids.

    One digest has one order, so the sorted rows pass through the driver, partition after
    partition; nothing of them stays there.
    """
    import hashlib
    import json

    digest, first = hashlib.sha256(b"{"), True
    for r in docs.select(F.col("id").cast("string"), "hash").orderBy("id").toLocalIterator(prefetchPartitions=True):
        digest.update(("" if first else ",").encode() + f"{json.dumps(r[0], ensure_ascii=False)}:{json.dumps(r[1])}".encode())
        first = False
    digest.update(b"}")
    return digest.hexdigest()


def envelopes(docs: DataFrame, previous: DataFrame, run: dict, health: list[dict], name: str, size: int = CHUNK_ROWS, schema_version: int = 1) -> DataFrame:
    """chunk, body (canonical JSON of a push): the first chunk also has the run and the health of its sources."""
    import json

    dump = lambda x: F.lit(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    found = export_chunks(docs, previous, size)
    count = found.count()
    first = F.col("chunk") == 0
    parts = {"jobs": F.concat(F.lit("["), F.array_join("jobs", ","), F.lit("]")), "run": F.when(first, dump(run)).otherwise("null"), "sourceHealth": F.when(first, dump(health)).otherwise("[]")}

    def obj(fields: dict[str, Column]) -> Column:
        pairs = [x for k, v in sorted(fields.items()) for x in (F.lit(f',"{k}":'), v)]
        return F.concat(F.lit("{"), F.substr(F.concat(*pairs), F.lit(2)), F.lit("}"))

    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    extra = {"checksum": quoted(F.sha2(obj(parts), 256)), "chunkCount": F.lit(str(count)), "chunkIndex": F.col("chunk").cast("string"), "runId": dump(name), "schemaVersion": F.lit(str(schema_version))}
    return found.select("chunk", obj(parts | extra).alias("body"))


def run_id(scanned_at: str, checksum: str) -> str:
    import re

    return f"listings-{re.sub('[^0-9A-Za-z]+', '-', scanned_at).strip('-')}-{checksum[:12]}"


def export_chunks(docs: DataFrame, previous: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """chunk, n, jobs (array of documents by id), checksum; one empty chunk if nothing changed."""
    rows = chunks(changed(docs, previous), "id", size)
    full = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("id", "doc"))), lambda x: x["doc"]).alias("jobs"))
    if full.isEmpty():
        full = docs.sparkSession.createDataFrame([(0, 0, [])], "chunk long, n long, jobs array<string>")
    return full.withColumn("checksum", F.sha2(F.array_join("jobs", "\n"), 256))


def signature(timestamp: str, body: bytes, secret: str) -> str:
    """HMAC-SHA256 of the timestamp and the body's hash, for a push of one chunk."""
    import hashlib
    import hmac

    return hmac.new(secret.encode(), f"{timestamp}.{hashlib.sha256(body).hexdigest()}".encode(), hashlib.sha256).hexdigest()


def write_outbox(found: DataFrame, path: str) -> None:
    """Chunks as gzip JSON files; the same run replaces its own files."""
    found.write.mode("overwrite").option("compression", "gzip").json(path)
