"""Grouped counts, ratios and shares of product analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_filled(dimension: DataFrame, counts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every row of a dimension with its values, 0 where counts has none. Groups outside the dimension disappear. counts is
    grouped by the keys already; the dimension is a small fixed list."""
    out = dimension.join(counts, keys, "left")
    return out.select(*dimension.columns, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def counted(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def without_blank(df: DataFrame, key: str) -> DataFrame:
    """Drop groups whose key is null or empty."""
    return df.filter(F.col(key).isNotNull() & (F.col(key) != ""))


def top_groups(df: DataFrame, key: str, n: int, count: str = "n") -> DataFrame:
    """The n largest groups, ties by key."""
    return df.orderBy(F.desc(count), F.asc(key)).limit(n)


def weighted_mean(df: DataFrame, value: str, group: str, groups: list[str]) -> DataFrame:
    """One row: sum of mean * count over the named groups, by the sum of counts; null if they have no row. Counts include rows
    whose value is null, and a mean of nulls counts as 0."""
    own = df.filter(F.col(group).isin(groups)).groupBy(group).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    total = F.sum("n")
    return own.agg(F.when(total > 0, F.sum(F.coalesce("mean", F.lit(0.0)) * F.col("n")) / F.greatest(total, F.lit(1))).alias("weighted_mean"))


def cross_tab(df: DataFrame, row: str, column: str, cells: dict[str, list[str]]) -> DataFrame:
    """A row per group, a column per cell with the count of its members' values, in one pass."""
    return df.groupBy(row).agg(*[F.count(F.when(F.col(column).isin(members), 1)).alias(name) for name, members in cells.items()])


def funnel(df: DataFrame, row: str, column: str, steps: list[str]) -> DataFrame:
    """Counts of the steps and each step's rate of the one before, 1 at the most, null if nobody got there."""
    counts = cross_tab(df, row, column, {s: [s] for s in steps})
    rates = [F.when(F.col(a) > 0, F.least(F.lit(1.0), F.col(b) / F.col(a))).alias(f"{b}_rate") for a, b in zip(steps, steps[1:])]
    return counts.select("*", *rates)


def share_of_largest(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """value by the largest value (1 at least). The maximum is one row, computed apart, so the rows stay where they are."""
    most = df.agg(F.greatest(F.lit(1), F.max(value)).alias("__most"))
    return df.withColumn(name, F.col(value) / most.scalar())


def daily_histogram(df: DataFrame, ts: str, last_day: Column, days: int = 14) -> DataFrame:
    """(day, n) for each of the days up to last_day, empty ones with 0."""
    first = F.date_sub(last_day, days - 1)
    counts = df.filter((F.col(ts) >= first) & (F.col(ts) < F.date_add(last_day, 1))).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(first, last_day)).alias("day"))
    return zero_filled(spine, counts, ["day"], ["n"])


def change_counts(df: DataFrame, before: str, after: str, key) -> DataFrame:
    """One row: rows, and those whose texts differ by more than `key` (a column function) ignores."""
    return df.agg(F.count("*").alias("n"), F.count(F.when(~key(F.col(before)).eqNullSafe(key(F.col(after))), 1)).alias("changed"))


def term_frequency(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """(term, n): occurrences of each term over all texts, side by side, in one pass; the plan doesn't grow with the rows."""
    sums = df.agg(*[F.sum(F.size(F.split(F.lower(text), F.lit(f"\\Q{t.lower()}\\E"), -1)) - 1).alias(f"c{i}") for i, t in enumerate(terms)])
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n")) for i, t in enumerate(terms)])
    return sums.select(F.inline(pairs))


def order_rank(partition: list[str], *order: Column):
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
