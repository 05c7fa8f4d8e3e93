"""K-d tree partitioning: split at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, rank_within

#: Coordinates are whole numbers below this bound, so that a split key holds one in its upper half.
SPAN = 1 << 31
LAST = (1 << 63) - 1


@dataclass
class Cell:
    """A node that is still to be split: its number, the shards below it, and the interval in which the split key is sought."""

    node: int
    shards: int
    first: int
    dim: int = 0
    goal: float = 0.0
    key: list[int] = field(default_factory=lambda: [0, LAST])
    tie: list[int] | None = None
    below: int = 0
    rows: int = 0
    done: bool = False

    def stop(self, key: int, tie: int) -> None:
        """Rows up to (key, tie) go to the left."""
        self.key, self.tie, self.done = [key, key], [tie, tie], True


def ranked(values: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the distinct values with their places in order, as the coordinate of a dimension: its width is the
    number of values in it. Values beyond SPAN in number share places."""
    placed = rank_in_order(values.select(column).distinct(), column)
    return placed.select(F.col(column).alias(f"__{column}"), F.least(F.col("__rank"), F.lit(SPAN - 1)).alias(name))


def rank_in_order(rows: DataFrame, by: str) -> DataFrame:
    """Add __rank, from 0 in the order of a column: sorted ranges are numbered by themselves and start after those before."""
    parts = rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    parts = materialise(parts, "ranges")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("__part", "__first", "__start")
    return parts.join(F.broadcast(starts), "__part").withColumn("__rank", (F.col("__start") + F.col("__id") - F.col("__first")).cast("long"))


def kd_partition(points: DataFrame, dims: list[str], weight: str, tie: str, shards: int | None = None, target: int | None = None, tolerance: float = 0.002, together: float = 0.01, most: int = 1 << 20) -> DataFrame:
    """Add `shard` (0 to shards - 1) to points; give either the number of leaves or their target weight.

    A node with m leaves below is cut along its widest dimension where floor(m/2) of m of its weight lie beneath. The cut
    is a pair (coordinate and crc, tie): equal coordinates are cut by `<tie>` (a crc, so that equal texts stay side by
    side) and then by a hash of the whole row. It is found by narrowing an interval, for all nodes of a level at once:
    a pass sums the weights of equal parts of each node's interval, and in the end the last rows of each are looked at, so
    the driver sees at most `most` sums or rows at a time. A cut is within `tolerance` of a leaf's weight, unless one row
    or rows equal in all columns weigh more. Rows of equal coordinates and tie are only parted if a cut beside them would
    miss by more than `together` of a leaf's weight.
    Weights must not be null. An empty table gets no row. points is read in each pass, so it should be materialised.
    """
    spark = points.sparkSession
    total = points.agg(F.sum(weight)).first()[0] or 0
    shards = shards or max(1, math.ceil(total / target))
    keyed = points.select("*", *[(F.shiftleft(F.col(d).cast("long"), 32) + F.col(tie)).alias(f"__k{i}") for i, d in enumerate(dims)], F.shiftrightunsigned(F.xxhash64(*points.columns), 1).alias("__tie"), F.lit(1).cast("long").alias("__node"))
    keys = [f"__k{i}" for i in range(len(dims))]

    def chosen(dim: str) -> Column:
        out = F.col(keys[0])
        for i in range(1, len(keys)):
            out = F.when(F.col(dim) == i, F.col(keys[i])).otherwise(out)
        return out

    leaves: list[Cell] = []
    level = [Cell(1, shards, 0)]
    while level:
        leaves += [c for c in level if c.shards == 1]
        level = [c for c in level if c.shards > 1]
        if not level:
            break
        nodes = F.broadcast(spark.createDataFrame(pd.DataFrame({"__node": [c.node for c in level]}), "__node long"))
        stats = {r["__node"]: r for r in keyed.join(nodes, "__node", "left_semi").groupBy("__node").agg(F.sum(weight).alias("w"), F.count("*").alias("n"), *[f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        for c in level:
            if (r := stats.get(c.node)) is None:
                c.stop(0, 0)
                continue
            c.dim = max(range(len(keys)), key=lambda i: (r[f"hi{i}"] >> 32) - (r[f"lo{i}"] >> 32))
            c.key, c.rows = [r[f"lo{c.dim}"], r[f"hi{c.dim}"]], r["n"]
            c.goal = r["w"] * (c.shards // 2) / c.shards
        slack, whole = tolerance * total / shards, together * total / shards
        while open_cells := [c for c in level if not c.done]:
            bins = max(16, min(4096, most // len(open_cells)))
            small = max(16, min(2048, most // len(open_cells)))
            rows = [(c.node, c.dim, c.tie is not None, c.key[0], *(c.tie or c.key)) for c in open_cells]
            sought = F.broadcast(spark.createDataFrame(pd.DataFrame(rows, columns=["__node", "dim", "tied", "key", "lo", "hi"]), "__node long, dim int, tied boolean, key long, lo long, hi long"))
            at = keyed.join(sought, "__node").withColumn("__key", chosen("dim")).filter(~F.col("tied") | (F.col("__key") == F.col("key"))).withColumn("__at", F.when(F.col("tied"), F.col("__tie")).otherwise(F.col("__key"))).filter(F.col("__at").between(F.col("lo"), F.col("hi")))
            if all(c.rows <= small for c in open_cells):
                found = at.select("__node", F.col("__key").alias("key"), F.col("__tie").alias("tie"), F.col(weight).alias("w")).toPandas().sort_values(["__node", "key", "tie"])
                of_node = dict(list(found.groupby("__node")))
                for c in open_cells:
                    own = of_node[c.node]
                    sums = c.below + np.r_[0, own["w"].cumsum()]
                    miss = np.abs(sums - c.goal)
                    best = int(miss.argmin())
                    if not c.tie:
                        keys_ = own["key"].to_numpy()
                        beside = np.flatnonzero(np.r_[True, keys_[1:] != keys_[:-1], True])
                        if miss[beside].min() <= whole:
                            best = int(beside[miss[beside].argmin()])
                    before = (c.key[0], c.tie[0] - 1) if c.tie else (c.key[0] - 1, LAST)
                    c.stop(*(before if best == 0 else (int(own["key"].iloc[best - 1]), int(own["tie"].iloc[best - 1]))))
                break
            width = F.expr(f"greatest(1, (hi - lo) div {bins} + 1)")
            found = at.groupBy("__node", F.floor((F.col("__at") - F.col("lo")) / width).alias("bin")).agg(F.sum(weight).alias("w"), F.count("*").alias("n"), F.min("__at").alias("least"), F.max("__at").alias("most")).toPandas().sort_values(["__node", "least"])
            of_node = dict(list(found.groupby("__node")))
            for c in open_cells:
                if c.rows <= small:
                    continue
                own = of_node[c.node]
                ends = c.below + own["w"].cumsum().to_numpy()
                i = min(int(np.searchsorted(ends, c.goal)), len(ends) - 1)
                least, most, n, w = (int(own[x].iloc[i]) for x in ("least", "most", "n", "w"))
                start, end = int(ends[i]) - w, int(ends[i])
                near = min((abs(start - c.goal), least - 1), (abs(end - c.goal), most))
                if near[0] <= slack / 2 or (least == most and (c.tie or near[0] <= whole)):
                    c.stop(c.key[0] if c.tie else near[1], near[1] if c.tie else LAST)
                    continue
                c.below, c.rows = start, n
                if c.tie:
                    c.tie = [least, most]
                elif least < most:
                    c.key = [least, most]
                else:
                    c.key, c.tie = [least, most], [0, LAST]
        cuts = F.broadcast(spark.createDataFrame(pd.DataFrame([(c.node, c.dim, c.key[0], c.tie[0]) for c in level], columns=["__node", "dim", "cut", "tie_cut"]), "__node long, dim int, cut long, tie_cut long"))
        k = chosen("dim")
        right = (k > F.col("cut")) | ((k == F.col("cut")) & (F.col("__tie") > F.col("tie_cut")))
        keyed = keyed.join(cuts, "__node", "left").withColumn("__node", F.when(F.col("cut").isNull(), F.col("__node")).otherwise(2 * F.col("__node") + right.cast("long"))).drop("dim", "cut", "tie_cut")
        level = [x for c in level for x in (Cell(2 * c.node, c.shards // 2, c.first), Cell(2 * c.node + 1, c.shards - c.shards // 2, c.first + c.shards // 2))]
    numbers = F.broadcast(spark.createDataFrame(pd.DataFrame([(c.node, c.first) for c in leaves], columns=["__node", "shard"]), "__node long, shard int"))
    return keyed.join(numbers, "__node").select(*points.columns, "shard")


def shard_documents(docs: DataFrame, target_bytes: int, together: float = 0.01) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each document, in leaves of `target_bytes`, by source and language.

    A dimension's coordinates are the places of its values in their order, so the widest one has most values in a leaf.
    Documents of equal texts lie at one place, that of the first source and language among them, and stay in one shard
    unless that would make it miss its size by `together`. Size is no dimension here: its far leaves would hold a few huge
    documents each, and miss equal sizes by one of them. Law: bytes. Nulls in source and lang are values of their own, a
    null text counts as none (size 16, crc 0); repeated rows count one by one. Slots are gapless from 0 within a shard.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("string")
    size = (F.octet_length(text) + 16).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    rows = materialise(rows, "sizes")
    first = F.min(F.struct(F.coalesce("source", F.lit("")), "source", "lang")).alias("x")
    groups = rows.groupBy("group").agg(first, F.count("*").alias("n")).filter("n > 1").select("group", F.col("x.source").alias("g_source"), F.col("x.lang").alias("g_lang"), F.lit(1).alias("many"))
    groups = broadcast_if_small(materialise(groups, "groups"), 1_000_000)
    points = rows.join(groups, "group", "left").withColumn("source", F.when(F.col("many") == 1, F.col("g_source")).otherwise(F.col("source"))).withColumn("lang", F.when(F.col("many") == 1, F.col("g_lang")).otherwise(F.col("lang")))
    for column in ("source", "lang"):
        places = broadcast_if_small(materialise(ranked(rows, column, f"by_{column}"), "places"), 1_000_000)
        points = points.join(places, points[column].eqNullSafe(places[f"__{column}"])).drop(f"__{column}")
    points = points.select("doc_id", "size", "text_crc32", "by_source", "by_lang")
    split = kd_partition(materialise(points, "points"), ["by_source", "by_lang"], "size", "text_crc32", target=target_bytes, together=together)
    return rank_within(materialise(split.select("doc_id", "size", "text_crc32", "shard"), "shards"), ["shard"], ["text_crc32", "doc_id"], "slot")
