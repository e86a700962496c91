"""Exact dedup over an extendible-hash index, in DataFrame operations only.

1. The directory starts with one bucket and doubles: as long as a bucket holds
   more than `capacity` keys it splits on one more leading bit of the key, to
   at most DEPTH bits.  It is worked out from a histogram of the distinct keys in 2**DEPTH cells,
   whatever the number of texts; beyond the last depth a bucket chains on.
2. Every text finds its bucket by its cell of the directory and goes to the task that owns it.  Equal texts
   (identical after lower-casing A-Z; null counts as empty) meet there in
   one group-by on (bucket, 64-bit key, text): the comparison is of all bytes, so keys
   that collide stay apart.  Copies are counted before the shuffle, so a group
   that holds a third of all rows costs one row for each map task.
3. Texts whose keys collide form a chain.  Owner tasks take ranges of (bucket, key) and write the index, a chain for each key, to the
   shared folder.
4. Every document looks up its chain by the directory's bucket and its key, and its entry in the chain by digest and
   length.

Of equal texts the row with the largest doc_id stays; null doc_ids stay only
where a text has no other.  Repeated rows (same doc_id, same text but for case) are each
returned, and one of them is kept.  An empty table gives an empty
result; other columns are ignored, and exact_dedup_rows() hands them through.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, materialise

#: Keys of a bucket before it splits.
CAPACITY = 50_000
#: Leading bits of the key that the directory uses at most.
DEPTH = 16


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _key(body: Column, bits: int) -> Column:
    return F.shiftleft(F.xxhash64(body), 64 - bits) if bits < 64 else F.xxhash64(body)


def directory(entries: DataFrame, capacity: int = CAPACITY, depth: int = DEPTH) -> DataFrame:
    """cell (leading `depth` bits of the key h), bucket (its leading bits) and local depth of every cell in use."""
    # 2**depth rows at most, read twice.
    cells = materialise(entries.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "dedup-cells")
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth")).withColumn("bucket", F.expr(f"shiftright(cell, {depth} - local_depth)"))
    load = levels.groupBy("local_depth", "bucket").agg(F.sum("n").alias("entries")).where((F.col("entries") <= capacity) | (F.col("local_depth") == depth))
    # The first depth at which a cell's bucket isn't overfull.
    return levels.drop("n").join(load, ["local_depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("local_depth", "bucket", "entries")).alias("b")).select("cell", "b.local_depth", "b.bucket", "b.entries")


class Index:
    """An extendible-hash index of the different texts of docs(doc_id, text)."""

    def __init__(self, docs: DataFrame, capacity: int = CAPACITY, depth: int = DEPTH, hash_bits: int = 64):
        self.depth, self.bits = depth, hash_bits
        keys = docs.select(_key(normalised(F.col("text")), hash_bits).alias("h")).distinct()
        #: 2**depth rows at most, whatever the number of texts.
        self.cells = materialise(directory(keys, capacity, depth), "dedup-directory")
        entries = (
            self.addressed(docs.select(F.col("doc_id").cast("long"), normalised(F.col("text")).alias("body")), "body")
            .groupBy("local_depth", "bucket", "h", "body")
            .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .select("local_depth", "bucket", "h", F.struct(F.sha2("body", 256).alias("text_sha256"), F.octet_length("body").cast("long").alias("n_bytes"), "keep_id", "group_size").alias("entry"))
        )
        owned = materialise(entries, "dedup-entries").repartitionByRange("local_depth", "bucket", "h")
        # A chain holds the different texts of one key, so hardly ever more than one.
        chained = owned.groupBy("local_depth", "bucket", "h").agg(F.array_sort(F.collect_list("entry")).alias("chain"))
        self.chains = materialise(chained, "dedup-index")

    def addressed(self, rows: DataFrame, body: str) -> DataFrame:
        """rows with the key of their text and the bucket that the directory names for it."""
        keyed = rows.withColumn("h", _key(F.col(body), self.bits)).withColumn("cell", F.shiftrightunsigned("h", 64 - self.depth))
        return keyed.join(F.broadcast(self.cells.select("cell", "local_depth", "bucket")), "cell").drop("cell")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows(local_depth, bucket, h, text_sha256, n_bytes, ...) with keep_id and group_size of their entries."""
        met = rows.join(self.chains, ["local_depth", "bucket", "h"])
        own = F.filter("chain", lambda e: (e["text_sha256"] == F.col("text_sha256")) & (e["n_bytes"] == F.col("n_bytes")))[0]
        return met.withColumn("entry", own).drop("chain").select("*", "entry.keep_id", "entry.group_size").drop("entry")


def exact_dedup(docs: DataFrame, **how: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text)."""
    index = Index(docs, **how)
    rows = index.addressed(docs.select(F.col("doc_id").cast("long"), normalised(F.col("text")).alias("body")), "body")
    rows = rows.select("doc_id", "local_depth", "bucket", "h", F.sha2("body", 256).alias("text_sha256"), F.octet_length("body").cast("long").alias("n_bytes"))
    # Repeated rows of a doc_id are told apart by their number.
    times = rows.groupBy(rows.columns).agg(F.count(F.lit(1)).alias("times"))
    each = index.lookup(times).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("time") == 1)).alias("kept"), "text_sha256")


def exact_dedup_rows(docs: DataFrame, **how: int) -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns: of each text exactly one."""
    index = Index(docs, **how)
    keep_id, digest_, id_, number = (fresh(x, docs) for x in ("_keep", "_digest", "_id", "_number"))
    keep = index.chains.select(F.explode("chain").alias("e")).select(F.col("e.keep_id").alias(keep_id), F.col("e.text_sha256").alias(digest_))
    digest = F.sha2(normalised(F.col("text")), 256)
    stays = docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id)) & (digest == F.col(digest_)), "left_semi")
    again = materialise(docs.groupBy(F.col("doc_id").cast("long").alias(id_)).count().where("count > 1").select(id_), "dedup-repeated")
    if again.isEmpty():
        return stays
    # Rows of a repeated doc_id may have the same text: the first of these in the order of the bytes stays.
    own = F.col("doc_id").cast("long").eqNullSafe(F.col(id_))
    order = W.partitionBy("doc_id", digest).orderBy("text")
    once = stays.join(again, own, "left_semi").withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number)
    return stays.join(again, own, "left_anti").unionAll(once)
