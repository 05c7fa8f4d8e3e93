"""Order statistics, clustering and coverage on numbers. Groups are pre-counted by value before any window sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored


#: So many counted values of a group's order stand in a range; this decides on memory, not on results.
RANGE = 250_000


def _ranges(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """counts with __range, numbers of ranges in order of keys and value, of about RANGE rows each: a large group has several."""
    ranges = -(-counts.count() // RANGE)
    if ranges <= 1:
        return counts.withColumn("__range", F.lit(0))
    return stored(counts.repartitionByRange(ranges, *keys, value).withColumn("__range", F.spark_partition_id()))


def _at_rank(df: DataFrame, keys: list[str], value: str, rank, name: str) -> DataFrame:
    """The value at a 0-based rank within each group; rank: a column function of the group's size n.

    Sums of ranges tell which range has a group's rank; only the values of that one are sorted.
    """
    counts = _ranges(stored(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))), keys, value)
    own = Window.partitionBy(*keys)
    sums = counts.groupBy(*keys, "__range").agg(F.sum("__c").alias("__own")).withColumn("__n", F.sum("__own").over(own))
    sums = sums.withColumn("__to", F.sum("__own").over(own.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__before", F.col("__to") - F.col("__own"))
    sums = sums.withColumn("__rank", rank(F.col("__n"))).filter("__before <= __rank and __rank < __to")
    sums = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__range").alias("__at"), "__before", "__rank")
    at = F.col("__range") == F.col("__at")
    for i, k in enumerate(keys):
        at = at & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    upto = F.col("__before") + F.sum("__c").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.join(sums, at).withColumn("__upto", upto).filter("__upto > __rank").groupBy(*keys).agg(F.min(value).alias(name))


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """The value at rank floor(n / 2): of two middle values the larger one. Nulls don't count; groups without values are absent."""
    return _at_rank(df, keys, value, lambda n: F.floor(n / 2), name)


def floor_percentile(df: DataFrame, keys: list[str], value: str, q: float, name: str = "percentile") -> DataFrame:
    """The value at rank floor(q * (n - 1))."""
    return _at_rank(df, keys, value, lambda n: F.floor(F.lit(q) * (n - 1)), name)


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: str, seq: str, name: str = "mode") -> DataFrame:
    """The value with the largest summed weight in each group; of equal ones, the one that comes first by seq."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"), F.min(seq).alias("__first"))
    return sums.groupBy(*keys).agg(F.max_by(value, F.struct("__w", -F.col("__first"))).alias(name))


def gap_clusters(df: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """Each value with the number of its cluster: a value joins the one before it if they are at most `gap` apart."""
    w = Window.partitionBy(*keys).orderBy(value)
    starts = F.when(F.col(value) - F.lag(value).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("__start", starts).withColumn("cluster", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def cluster_values(df: DataFrame, keys: list[str], value: str, gap: float, least: int = 1) -> DataFrame:
    """(keys, cluster, first, mean, size) of the clusters with at least `least` values; equal values are one row to the window."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    sums = gap_clusters(counts, keys, value, gap).groupBy(*keys, "cluster").agg(F.min(value).alias("first"), (F.sum(F.col(value) * F.col("__c")) / F.sum("__c")).alias("mean"), F.sum("__c").alias("size"))
    return sums.filter(F.col("size") >= least)


def coverage(df: DataFrame, keys: list[str], begin: str, end: str, low: float, high: float) -> DataFrame:
    """(keys, covered): the share of [low, high] that the union of intervals covers."""
    cut = df.select(*keys, F.greatest(F.col(begin), F.lit(low)).alias("__b"), F.least(F.col(end), F.lit(high)).alias("__e")).filter("__e > __b").groupBy(*keys, "__b").agg(F.max("__e").alias("__e"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0.0), F.col("__e") - F.greatest(F.col("__b"), F.coalesce(F.max("__e").over(before), F.col("__b"))))
    return cut.withColumn("__fresh", fresh).groupBy(*keys).agg((F.sum("__fresh") / (high - low)).alias("covered"))


def bounds(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))


def running_lines(df: DataFrame, doc: str, page: str, line: str, share: float = 0.5) -> DataFrame:
    """(doc, masked, n): lines that stand on `share` of a document's pages or more (two at least), digits as #."""
    masked = df.select(doc, page, F.regexp_replace(F.trim(line), "[0-9]+", "#").alias("masked")).filter("masked <> ''")
    pages = df.groupBy(doc).agg(F.countDistinct(page).alias("__pages"))
    counts = masked.groupBy(doc, "masked").agg(F.countDistinct(page).alias("n"))
    return counts.join(pages, doc).filter(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("__pages") * share))).drop("__pages")


def sessions_by_gap(df: DataFrame, keys: list[str], order: str, joined, name: str = "segment") -> DataFrame:
    """Number the runs within keys: a row goes on with the run before unless joined(row before's columns) is false."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__new", F.when(joined(w), 0).otherwise(1)).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def spacing(df: DataFrame, keys: list[str], top: str, bottom: str, most: float = 72.0, name: str = "space_before") -> DataFrame:
    """Gap to the block above, between 0 and `most`; 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(top)
    return df.withColumn(name, F.least(F.lit(most), F.greatest(F.lit(0.0), F.coalesce(F.col(top) - F.lag(bottom).over(w), F.lit(0.0)))))


def distinct_top(df: DataFrame, keys: list[str], value: str, n: int, name: str = "tier") -> DataFrame:
    """The n largest distinct values of each group, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value))
    return df.select(*keys, value).distinct().withColumn(name, F.dense_rank().over(w)).filter(F.col(name) <= n)
