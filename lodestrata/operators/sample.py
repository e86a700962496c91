"""Order statistics, samples and chunks: no task ever sorts a whole source, or all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import written

#: monotonically_increasing_id() is the partition above so many bits, and the row in it below.
_ROW_BITS = 33


def ranked(df: DataFrame, order: list[str | Column], by: list[str] | None = None, rank: str = "_rank", total: str = "_total") -> DataFrame:
    """df with the place of each row (from 0) in its group by `order`, and the rows of its group.

    Rows are dealt out by ranges of (by, order) and sorted inside each; a row's place is that inside its
    range plus the rows of its group in the ranges before.  So a group that holds most rows
    is sorted by many tasks, and what is added up is a row for each range and group.  Rows that
    `order` doesn't tell apart come in the order in which they were read.
    """
    by = by or []
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*(F.asc(c) for c in by), *(F.asc(c) if isinstance(c, str) else c for c in order), F.asc("_tie")]
    at = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    at = written(at, "ranges")  # both the sums and the rows read it
    ranges = at.groupBy(*by, F.shiftright("_at", _ROW_BITS).alias("_range")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_range").alias("_own"), "_first", before.alias("_before"), F.sum("_rows").over(group).alias(total))
    same = F.shiftright("_at", _ROW_BITS) == F.col("_own")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    joined = at.join(ranges, same)
    return joined.withColumn(rank, F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_own", "_first", "_before", *(f"_by{k}" for k in range(len(by))))


def balanced_sample(df: DataFrame, n: int = 50) -> DataFrame:
    """The first n rows in rounds over the sources, which come in order of first appearance.

    Every task drops what isn't among its own first n rows of a source, so a source brings n rows from each to the shuffle.
    """
    by = W.partitionBy("source")
    top = df.withColumn("_round", F.row_number().over(by.orderBy("_ord"))).where(F.col("_round") <= n)
    return top.withColumn("_first", F.min("_ord").over(by)).orderBy("_round", "_first").limit(n).drop("_round", "_first")


def stride_sample(df: DataFrame, per_source: int = 20) -> DataFrame:
    """Evenly spaced rows of each source, at most per_source; halves round to even."""
    at = ranked(df, ["_ord"], ["source"], "_i", "_n")
    if per_source == 1:
        return at.where("_i = 0").drop("_i", "_n")
    # Row i is the spot of some p; only the p's next to i's own share of the way can be.
    near = F.floor(F.col("_i") * (per_source - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = F.lit(False)
    for step in (-1, 0, 1, 2):
        p = near + step
        hit = hit | (p.between(0, per_source - 1) & (F.bround(p * (F.col("_n") - 1) / F.lit(float(per_source - 1))).cast("long") == F.col("_i")))
    return at.where((F.col("_n") <= per_source) | hit).drop("_i", "_n")


def source_summary(df: DataFrame, sample: DataFrame) -> DataFrame:
    """source, available, sampled."""
    a = df.groupBy("source").agg(F.count(F.lit(1)).alias("available"))
    s = sample.groupBy("source").agg(F.count(F.lit(1)).alias("sampled"))
    return a.join(s, "source", "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)))


def chunks(df: DataFrame, order: str, size: int = 200) -> DataFrame:
    """df with chunk numbers of `size` rows in order."""
    return ranked(df, [order], None, "_i", "_n").withColumn("chunk", F.floor(F.col("_i") / size)).drop("_i", "_n")


def quantiles(df: DataFrame, column: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by, share, value: the exact lower quantiles of a column (nulls left out), by rank instead of a sort of each group."""
    own = ranked(df.where(F.col(column).isNotNull()).select(*(by or []), column), [column], by)
    spots = F.array(*(F.struct(F.lit(s).alias("share"), F.floor(F.lit(float(s)) * (F.col("_total") - 1)).alias("at")) for s in shares))
    hits = F.filter(spots, lambda x: x["at"] == F.col("_rank"))
    return own.select(*(by or []), F.explode(hits).alias("x"), F.col(column).alias("value")).select(*(by or []), "x.share", "value")
