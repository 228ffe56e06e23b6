"""Window idioms that queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; Spark filters most of them out before the shuffle. ``rank`` keeps the rank as a column."""
    r = rank or "_rank"
    out = df.withColumn(r, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(r) <= k)
    return out if rank else out.drop(r)


def latest_by(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """For each key the row with the greatest ``order``, by an aggregate that is combined before the shuffle."""
    rest = [x for x in df.columns if x not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, *[F.col("_r")[x].alias(x) for x in rest])


def nearest_ranks(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``key`` and, for each name in ``shares``, the smallest value that at least this share of the key's rows isn't above. Null values don't count; a key without others has no row; a null key is a key.

    Equal values are counted first. The counts are range-partitioned by key and value, each part adds up its own, and starts from what those before it hold; so a key with most rows, or most values, is
    spread over tasks, and only a sum a part and key meets in one.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    part = written(counts.repartitionByRange(key, value).withColumn("_p", F.spark_partition_id()), "counts")
    sums = part.groupBy(key, "_p").agg(F.sum("_n").alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy(key).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumns({"_before": before, "_all": F.sum("_s").over(W.partitionBy(key))}).select(F.col(key).alias("_key"), F.col("_p").alias("_part"), "_before", "_all")
    own = F.sum("_n").over(W.partitionBy(key, "_p").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    placed = part.withColumn("_own", own).join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_p") == F.col("_part")))
    reached = lambda share: F.min(F.when(F.col("_before") + F.col("_own") >= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("_all"))), F.col(value)))
    return placed.groupBy(key).agg(*[reached(share).alias(name) for name, share in shares.items()])


def runs(df: DataFrame, keys: list[str], order: list, breaks: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of rows that ``breaks`` separates (true on a run's first row; null counts as true)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """An upsert: new rows replace old ones with the same keys; null columns of the new keep the old value."""
    rest = [x for x in old.columns if x not in keys]
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(F.col(f"b.{x}"), F.col(f"a.{x}")).alias(x) for x in rest])
