"""Numbered lists and sections of documents as window functions: counters, runs, roman numerals, inherited properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outline_counters(items: DataFrame, lists: list[str], order: str, level: str, starts: list[int]) -> DataFrame:
    """items with counters: the number of each level down to the item's own (levels from 0, as many as starts).

    An item counts its level up; deeper levels begin anew after it. A level that no item has counted yet stands just before
    its start. Level i counts the items of that level since the last one above it.
    """
    by = Window.partitionBy(*lists).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = items
    for i in range(len(starts)):
        out = out.withColumn(f"__g{i}", F.sum((F.col(level) < i).cast("int")).over(by))
        within = Window.partitionBy(*lists, f"__g{i}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"__c{i}", F.sum((F.col(level) == i).cast("int")).over(within) + starts[i] - 1)
    counters = F.slice(F.array(*[F.col(f"__c{i}") for i in range(len(starts))]), F.lit(1), F.col(level) + 1)
    return out.withColumn("counters", counters).select(*items.columns, "counters")


def list_runs(items: DataFrame, doc: str, order: str, key: Column, spacing: Column, size: Column) -> DataFrame:
    """items with run: a new one begins where the key differs from the item before or the gap above is over 1.5 sizes."""
    w = Window.partitionBy(doc).orderBy(order)
    rows = items.withColumn("__key", key)
    fresh = ~F.col("__key").eqNullSafe(F.lag("__key").over(w)) | (spacing > size * 1.5) | (F.row_number().over(w) == 1)
    return rows.withColumn("__new", F.when(fresh, 1).otherwise(0)).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__key", "__new")


def romans_repaired(items: DataFrame, doc: str, order: str) -> DataFrame:
    """items (fmt, token, start, marker_x) with fmt lowerRoman for letters i, v and x (upperRoman for I, V, X) that roman numerals follow.

    A letter that goes on from the one before stays a letter. Repairs pass from right to left: letters that can be numerals
    and follow each other are all repaired if a numeral ends them. marker_x must be within 4 of the next item's.
    """
    w = Window.partitionBy(doc).orderBy(order)
    low, near = F.col("fmt").startswith("lower"), F.abs(F.lead("marker_x").over(w) - F.col("marker_x")) < 4
    letter = F.col("fmt").isin("lowerLetter", "upperLetter")
    goes_on = (F.lag("fmt").over(w) == F.col("fmt")) & (F.lag("start").over(w) == F.col("start") - 1) & (F.abs(F.lag("marker_x").over(w) - F.col("marker_x")) < 4)
    may = letter & F.col("token").rlike("^[ivxIVX]$") & ~F.coalesce(goes_on, F.lit(False)) & F.coalesce(near & (F.lead(low).over(w) == low), F.lit(False))
    rows = items.withColumn("__may", may)
    ended = F.first(F.when(~F.col("__may"), F.col("fmt").isin("lowerRoman", "upperRoman")), True).over(w.rowsBetween(1, Window.unboundedFollowing))
    value = F.element_at(F.create_map(F.lit("i"), F.lit(1), F.lit("v"), F.lit(5), F.lit("x"), F.lit(10)), F.lower("token"))
    fixed = F.col("__may") & F.coalesce(ended, F.lit(False))
    fmt = F.when(fixed & low, "lowerRoman").when(fixed, "upperRoman").otherwise(F.col("fmt"))
    return rows.withColumn("__fmt", fmt).withColumn("start", F.when(fixed, value).otherwise(F.col("start"))).withColumn("fmt", F.col("__fmt")).drop("__may", "__fmt")


def section_properties(sections: DataFrame, doc: str, order: str, defaults: dict[str, float], absolute: tuple[str, ...] = ()) -> DataFrame:
    """sections with each property of `defaults` taken from the last section that states it, else the default; `absolute`
    ones without their sign."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.coalesce(F.last(c, True).over(w), F.lit(v)) for c, v in defaults.items()}
    return sections.withColumns({c: F.abs(v) if c in absolute else v for c, v in filled.items()})
