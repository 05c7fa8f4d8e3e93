"""Lookups, deletes, ordered dedup and set operations on keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import checkpointed


def keep_known(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Foreign-key check: the row stays, its key becomes null if the other table lacks it."""
    ids = known.select(F.col(known_key).alias("__id")).distinct()
    return df.join(ids, F.col(key) == F.col("__id"), "left").withColumn(key, F.col("__id")).select(*df.columns)


def cascade(df: DataFrame, key: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """Rows go with the rows that they refer to."""
    gone = deleted.select(F.col(deleted_key).alias("__id"))
    return df.join(gone, F.col(key) == F.col("__id"), "left_anti")


def set_null(df: DataFrame, key: str, deleted: DataFrame, deleted_key: str) -> DataFrame:
    """Rows stay, references to deleted rows become null."""
    gone = deleted.select(F.col(deleted_key).alias("__id")).distinct()
    return df.join(gone, F.col(key) == F.col("__id"), "left").withColumn(key, F.when(F.col("__id").isNull(), F.col(key))).select(*df.columns)


def null_preserving(df: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Rows whose key is allowed, null or empty; an empty list allows all."""
    return df.filter(F.col(key).isNull() | (F.col(key) == "") | F.col(key).isin(allowed)) if allowed else df


def first_occurrences(df: DataFrame, owner: list[str], key: Column, order: list[str]) -> DataFrame:
    """The first row of each key within its owner; rows with an empty key are dropped. Grouped minimum, so that a hot key is combined before the shuffle."""
    named = df.withColumn("__key", key).filter("__key <> ''")
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    return named.groupBy(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(owner)], "__key").agg(F.min(row).alias("__row")).select(*[F.col(f"__row.{c}") for c in df.columns])


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order."""
    return rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in rows.columns if c not in (key, order)])).alias("__row")).select(key, *[F.col(f"__row.{c}") for c in rows.columns if c != key])


def overlaid(base: DataFrame, found: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """base with the values that found has for its keys (the last of each); its own where found has none. Unknown keys in found are passed over."""
    own = last_wins(found, key, order).select(key, *[F.col(v).alias(f"__{v}") for v in values])
    return base.join(own, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in values else F.col(c) for c in base.columns])


def append_new(seen: DataFrame, page: DataFrame, key: str) -> DataFrame:
    """seen and those rows of page whose key it lacks."""
    return seen.unionByName(page.join(seen.select(key).distinct(), key, "left_anti").select(*seen.columns))


def forward_fill(df: DataFrame, keys: list[str], order: str, value: str, name: str | None = None) -> DataFrame:
    """Empty and null values take the last value before them."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name or value, F.last(F.when(F.col(value) != "", F.col(value)), ignorenulls=True).over(w))


def ordered_union(*sources: DataFrame, name: str = "source") -> DataFrame:
    """All rows with the number of the list that they come from."""
    out = sources[0].withColumn(name, F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn(name, F.lit(i)))
    return out


def union_distinct(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """A row per key; the first source wins."""
    both = ordered_union(first, second, name="__source")
    return both.groupBy(key).agg(F.min(F.struct("__source", *[c for c in first.columns if c != key])).alias("__row")).select(key, *[F.col(f"__row.{c}") for c in first.columns if c != key])


def unchanged(out: DataFrame, source: DataFrame, key: str, least_words: int = 4) -> DataFrame:
    """Rows of out whose key, or key without its first word, is a key of source with `least_words` words or more. Keys are normalised texts."""
    keys = source.filter(F.size(F.split(key, " ")) >= least_words).select(F.col(key).alias("__k")).distinct()
    tries = out.withColumn("__try", F.explode(F.array(F.col(key), F.regexp_replace(key, r"^\S+ ", ""))))
    hit = tries.join(keys, F.col("__try") == F.col("__k"), "left_semi").select(F.col(key).alias("__hit")).distinct()
    return out.join(hit, F.col(key) == F.col("__hit"), "left_semi")


def page_window(df: DataFrame, order: list[Column], page: int, size: int = 5, last_page: int = 20) -> DataFrame:
    """Rows of one page, with their rank and whether a further page follows. Only the rows up to the page's end and one more are kept, by a bounded top-k."""
    end = page * size
    top = df.orderBy(*order).limit(end + 1)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most end + 1 rows
    more = ranked.agg((F.max("rank") > end).alias("m")).scalar()
    return ranked.filter(F.col("rank").between(end - size + 1, end)).withColumn("has_more", F.lit(page < last_page) & more)


def cascade_of(attempts: list[DataFrame]) -> DataFrame:
    """The rows of the first attempt that has any, with its number: one tagged union, and the least tag that occurs."""
    tagged = ordered_union(*attempts, name="attempt")
    return tagged.filter(F.col("attempt") == tagged.agg(F.min("attempt").alias("m")).scalar())


def inherited(styles: DataFrame, key: str, parent: str, values: list[str]) -> DataFrame:
    """Values of each style, from the nearest ancestor that has one. Pointers to parents are doubled in each round, so a
    chain of any length takes the logarithm of the styles in joins; in a cycle, the nearest style on the way counts."""
    out = styles.select(key, parent, *values, F.col(parent).alias("__next"))
    for _ in range(styles.count().bit_length() + 1):
        out = checkpointed(out)
        if out.filter("__next is not null").isEmpty():
            break
        up = out.select(F.col(key).alias("__k"), F.col("__next").alias("__further"), *[F.col(v).alias(f"__{v}") for v in values])
        out = out.join(up, F.col("__next") == F.col("__k"), "left").select(key, parent, *[F.coalesce(v, f"__{v}").alias(v) for v in values], F.col("__further").alias("__next"))
    return out.select(key, parent, *values)


def zipped(a: DataFrame, b: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of two frames side by side: of each key the first with the first by order, and so on, with their place from 1. Where one
    runs out, its columns are null; order itself, which each numbers by, is left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    own = [x.withColumn("place", F.row_number().over(w)).drop(order) for x in (a, b)]
    return own[0].join(own[1], [*keys, "place"], "full")
