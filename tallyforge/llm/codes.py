"""Vector codes: product quantisation over integers, trained by rounds of exact nearest-entry assignment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

#: Squared distances of parts up to 64 components within this bound fit 64 bits; beyond it Python's integers are used.
SMALL = 1 << 28
#: Components beyond this bound have no code.
LARGE = 1 << 62
#: Unit roundoff of float32.
UNIT = 2.0**-24


class Codebooks(NamedTuple):
    """entries: for each part, the integer components of each entry; width: components of a whole vector."""

    entries: list[list[list[int]]]
    width: int

    def bounds(self) -> list[int]:
        """Where the parts begin and the last one ends; parts of a width that can't be cut evenly differ by one at most."""
        return [k * self.width // len(self.entries) for k in range(len(self.entries) + 1)]

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, vector: str) -> DataFrame:
    """vectors without rows whose vector is null or holds null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(vector).isNotNull() & fine)


def integers(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, coded, rows): which vectors hold finite components only, which of those are `width` long and within bounds,
    and the floors of scale times the components of the latter."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    kept, coded = sizes >= 0, sizes == width
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(np.maximum(sizes, 0))
    broken = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    kept &= broken[ends] == broken[ends - np.maximum(sizes, 0)]
    coded &= kept
    scaled = np.floor(scale * flat[np.repeat(coded, np.maximum(sizes, 0))].reshape(-1, width))
    fits = (np.abs(scaled) <= LARGE).all(axis=1)
    coded[np.flatnonzero(coded)[~fits]] = False
    return kept, coded, scaled[fits].astype(np.int64)


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index, exactly.

    |c|² - 2 x·c orders a row's entries. One float32 matrix product gives all x·c within γ|x||c|, whatever the order of its
    sums and the rounding of its inputs; entries whose interval overlaps the best one's are evaluated in 64-bit integers.
    """
    wide = np.abs(part).max(axis=1, initial=0) > SMALL
    if wide.any() or np.abs(entries).max(initial=0) > SMALL or part.shape[1] > 64:
        far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(row, entry)) for entry in entries] for row in part]
        index = np.array([d.index(min(d)) for d in far], np.int64)
        return index, np.array([d[k] for d, k in zip(far, index)], object)
    m = part.shape[1]
    gamma = (m + 3) * UNIT / (1 - (m + 3) * UNIT)
    squares = (entries * entries).sum(axis=1).astype(np.float64)
    lengths = np.sqrt((part.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(squares)[None, :]
    about = squares[None, :] - 2 * (part.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    reach = (2 * gamma * lengths) * (1 + 1e-9) + 1e-12 * (squares[None, :] + 2 * lengths)
    row, entry = np.nonzero(about - reach <= (about + reach).min(axis=1, keepdims=True))
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else row
    apart = part[row] - entries[entry]
    exact = (apart * apart).sum(axis=1)
    best = np.minimum.reduceat(exact, first) if len(row) else exact
    hit = np.flatnonzero(exact == best[row])
    index = np.full(len(part), len(entries), np.int64)
    np.minimum.at(index, row[hit], entry[hit])
    return index, best


def _sums(batches: Iterator[pa.RecordBatch], books: Codebooks, scale: int) -> Iterator[pa.RecordBatch]:
    """(part, entry, position, total, n): what the nearest entries of this partition's parts gather."""
    bounds, entries = books.bounds(), [np.array(x, np.int64).reshape(len(x), -1) for x in books.entries]
    totals, counts = [np.zeros(x.shape, object) for x in entries], [np.zeros(len(x), np.int64) for x in entries]
    for batch in batches:
        rows = integers(batch.column(0), books.width, scale)[2]
        for k, own in enumerate(entries):
            part = rows[:, bounds[k] : bounds[k + 1]]
            index, _ = nearest(part, own)
            counts[k] += np.bincount(index, minlength=len(own))
            if np.abs(part).max(initial=0) <= SMALL:  # sums of fewer than 2^25 rows are exact in float64
                totals[k] += (np.eye(len(own))[index].T @ part.astype(np.float64)).astype(np.int64)
            else:
                np.add.at(totals[k], index, part.astype(object))
    found = [(k, e, at, Decimal(int(x)), int(counts[k][e])) for k, whole in enumerate(totals) for e, own in enumerate(whole) if counts[k][e] for at, x in enumerate(own)]
    if found:
        part, entry, at, total, n = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(at, pa.int32()), pa.array(total, pa.decimal128(38, 0)), pa.array(n, pa.int64())], ["part", "entry", "position", "total", "n"])


def train(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks | None:
    """Codebooks of vectors (id_col, vector), or None if no vector can be coded.

    Each part's entries start as that part of the vectors with the smallest ids (null ids last, ties by components; fewer
    vectors give fewer entries); each round moves every entry to the floored mean of the parts nearest to it, and leaves
    unused ones. The first vector's length is that of all: others, and components beyond 2^62, take no part. A round reads
    the table once and gathers one sum for each component of an entry.
    """
    order = [F.col(id_col).asc_nulls_last(), F.col(vector)]
    first = whole_vectors(vectors, vector).filter(F.size(vector) > 0).orderBy(*order).limit(1).select(F.size(vector)).collect()
    if not first:
        return None
    width = first[0][0]
    bounded = F.forall(vector, lambda x: F.abs(x.cast("double")) <= float(LARGE) / scale)
    starts = whole_vectors(vectors, vector).filter((F.size(vector) == width) & bounded).orderBy(*order).limit(entries).select(vector).collect()
    rows = np.floor(scale * np.array([r[0] for r in starts], np.float64)).astype(np.int64).reshape(-1, width)
    cuts = [k * width // parts for k in range(parts + 1)]
    books = Codebooks([rows[:, a:b].tolist() for a, b in zip(cuts, cuts[1:])], width)
    for _ in range(rounds if starts else 0):
        found = vectors.select(vector).mapInArrow(lambda it, books=books: _sums(it, books, scale), "part int, entry int, position int, total decimal(38,0), n long")
        for part, entry, at, total, n in found.groupBy("part", "entry", "position").agg(F.sum("total"), F.sum("n")).collect():
            books.entries[part][entry][at] = int(total) // n
    return books if starts else None


def _codes(batches: Iterator[pa.RecordBatch], books: Codebooks, scale: int) -> Iterator[pa.RecordBatch]:
    bounds, entries = books.bounds(), [np.array(x, np.int64).reshape(len(x), -1) for x in books.entries]
    digits = max(2, len(f"{max(map(len, entries)) - 1:x}"))
    for batch in batches:
        kept, coded, rows = integers(batch.column(batch.num_columns - 1), books.width, scale)
        found = [nearest(rows[:, a:b], own) for a, b, own in zip(bounds, bounds[1:], entries)]
        error = sum(x.astype(object) for _, x in found)
        names = [[f"{e:0{digits}x}" for e in range(len(own))] for own in entries]
        code, far = np.full(len(coded), None, object), np.full(len(coded), None, object)
        code[coded] = ["".join(own[k] for own, k in zip(names, row)) for row in zip(*(x.tolist() for x, _ in found))]
        far[coded] = [Decimal(int(x)) for x in error] if len(rows) else []
        own = [batch.column(k).filter(pa.array(kept)) for k in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(code[kept], pa.string()), pa.array(far[kept], pa.decimal128(38, 0))], [*batch.schema.names[:-1], "code", "__error"])


def assign(vectors: DataFrame, books: Codebooks | None, keep: list[str], vector: str = "embedding", scale: int = 4096) -> DataFrame:
    """The kept columns of each row whose vector holds finite components only, with its code (indexes of its parts' nearest
    entries, two hex digits each) and error (their squared distances, summed). Vectors of another length than the codebooks'
    and components beyond 2^62 have neither, errors beyond 63 bits are null. Repeated rows repeat."""
    fields = [vectors.schema[c] for c in keep]
    if books is None:
        return whole_vectors(vectors, vector).select(*keep, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    made = StructType([*fields, StructField("code", StringType()), StructField("__error", DecimalType(38, 0))])
    out = vectors.select(*keep, F.col(vector).alias("__vector")).mapInArrow(lambda it: _codes(it, books, scale), made)
    error = F.when(F.col("__error") < Decimal(1 << 63), F.col("__error").cast(LongType()))
    return out.select(*keep, "code", error.alias("error"))


def with_totals(coded: DataFrame, by: str, value: str, name: str, broadcast_groups: int = 100_000) -> DataFrame:
    """Add the sum of a value over rows that agree in a column, nulls together. Sums are combined before they are shuffled;
    they go by broadcast if a count shows few groups, else a join by shuffle, whose large partitions Spark splits."""
    sums = coded.groupBy(F.col(by).alias("__by")).agg(F.try_sum(value).alias(name))
    side = F.broadcast(sums) if sums.limit(broadcast_groups + 1).count() <= broadcast_groups else sums
    return coded.join(side, coded[by].eqNullSafe(side["__by"])).drop("__by")
