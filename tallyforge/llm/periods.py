"""Periodic runs of words: every lag of a text is compared with the text itself, and stretches that agree are measured."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialise, release_memory

RUNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string, collapsed_sha256 string"
Run = tuple[int, int, int]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Small numbers, equal where words are."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int32)


def stretches(agree: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, length) of the true stretches of `least` and more."""
    turned = np.flatnonzero(np.diff(np.concatenate(([0], agree.view(np.int8), [0]))))
    return [(int(a), int(b - a)) for a, b in zip(turned[::2], turned[1::2]) if b - a >= least]


def lag_runs(ids: np.ndarray, lags: range, least: int = 24, exponent: int = 3) -> list[Run]:
    """(start, length, period) of the maximal stretches with a period among `lags` of a length of max(least, exponent * period).

    A stretch of period q and length l shows as l - q positions in a row that agree with those q further. All lags of an
    octave are compared at once, at positions an eighth of the shortest such row apart; where eight in a row agree, the lag
    is compared in full and its true stretches are measured. Stretches whose smallest period is another lag in `lags` are
    left out: q words of a run with a period that divides q lie in no other stretch of period q.
    """
    n, found = len(ids), []
    lo, hi = max(lags.start, 1), min(lags.stop, n // exponent + 1)
    padded = np.concatenate((ids, np.full(n, -1, ids.dtype)))
    while lo < hi:
        to = min(hi, 2 * lo)
        shortest = min(max(least - q, (exponent - 1) * q) for q in {lo, to - 1, *range(least // exponent - 1, least // exponent + 2)} if lo <= q < to)
        step = max(1, shortest // 8)
        rows = 1 + max(1, (1 << 22) * step // n)
        for a in range(lo, to, rows):
            b = min(to, a + rows)
            agree = np.lib.stride_tricks.sliding_window_view(padded[a : b - 1 + n], n)[:, ::step] == ids[::step]
            for apart in (1, 2, 4) if shortest >= 8 else ():
                agree = agree[:, :-apart] & agree[:, apart:] if agree.shape[1] > apart else agree[:, :0]
            for row in np.flatnonzero(agree.any(axis=1)):
                q, at = a + int(row), np.flatnonzero(agree[row]) * step
                for start, length, period in found:
                    if q % period == 0:
                        at = at[(at < start) | (at + q > start + length)]
                if len(at):
                    needed = max(least - q, (exponent - 1) * q)
                    own = [(s, l + q, q) for s, l in stretches(ids[:-q] == ids[q:], needed)]
                    known = {(s, l) for s, l, _ in found}
                    found += [x for x in own if x[:2] not in known]
        lo = to
    return found


def smallest_periods(runs: list[Run]) -> list[Run]:
    """Of runs found by several lags the one with the smallest, by start and period."""
    least: dict[tuple[int, int], int] = {}
    for start, length, period in runs:
        least[start, length] = min(period, least.get((start, length), period))
    return sorted(((s, l, p) for (s, l), p in least.items()), key=lambda x: (x[0], x[2]))


def summary(words: list[bytes], runs: list[Run], with_text: bool) -> tuple:
    """What RUNS names, of a text's words and its runs by start and period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    text = b" ".join(words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k])
    digest = hashlib.sha256("".join(f"{s},{l},{p}\n" for s, l, p in runs).encode()).hexdigest()
    best = max(runs, key=lambda x: (_exact(x), -x[0], -x[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *told, digest, text.decode(errors="replace") if with_text else None, hashlib.sha256(text).hexdigest()


def _exact(run: Run):
    from fractions import Fraction

    return Fraction(run[1], run[2])


def _batch(columns: list, made: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = (*[pa.int64()] * 5, *[pa.string()] * 3)
    values = [pa.array(x, t) for x, t in zip(zip(*made) if made else [[]] * 8, types)]
    return pa.RecordBatch.from_arrays([*columns, *values], names)


NAMES = [x.split()[0] for x in RUNS.split(", ")]


def _scan(batches: Iterator[pa.RecordBatch], least: int, exponent: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) with what RUNS names, all lags of a text in one go."""
    for batch in batches:
        made = []
        for text in batch.column(1):
            words = (text.as_py() or b"").split()
            ids = word_ids(words)
            made.append(summary(words, smallest_periods(lag_runs(ids, range(1, len(ids)), least, exponent)), with_text))
        yield _batch([batch.column(0)], made, ["doc_id", *NAMES])
    release_memory()


def _scan_ranges(batches: Iterator[pa.RecordBatch], least: int, exponent: int) -> Iterator[pa.RecordBatch]:
    """(row, text, lag, lags) to (row, start, length, period), for the lags from `lag` on."""
    for batch in batches:
        row, text, lag, lags = (batch.column(k) for k in range(4))
        for at in range(batch.num_rows):
            found = lag_runs(word_ids(text[at].as_py().split()), range(lag[at].as_py(), lag[at].as_py() + lags[at].as_py()), least, exponent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([row[at].as_py()] * len(found), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*found))], ["row", "start", "length", "period"])
    release_memory()


def _sum_up(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs) with what RUNS names."""
    for batch in batches:
        made = []
        for text, runs in zip(batch.column(1), batch.column(2).to_pylist()):
            made.append(summary(text.as_py().split(), smallest_periods([(x["start"], x["length"], x["period"]) for x in runs or ()]), with_text))
        yield _batch([batch.column(0)], made, ["doc_id", *NAMES])
    release_memory()


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            h = zlib.crc32(str(doc).encode())
            if doc is not None and text and h % 10 == 0 and (words := text.split()):
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = b" ".join(words[i if i < a else a + (i - a) % p] for i in range(n))
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "text"])


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where a tenth of the documents, told by crc32 of their ids, repeat some words up to their end: cases to
    find, of all exponents around the least one. Texts are UTF-8 bytes; rows without a doc_id and empty texts stay as they are."""
    return keyed(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_tails, "doc_id long, text binary")


def periodic_runs(docs: DataFrame, least: int = 24, exponent: int = 3, short: int = 1 << 16, cells: int = 1 << 30, with_text: bool = True) -> DataFrame:
    """Each row's doc_id with its runs: stretches of words with smallest period q, of max(least, exponent * q) words at the
    least, that no neighbouring word continues; the one with the greatest length / period (ties: smallest start, then
    period), digests of all runs and of the text without repeats (each run keeps its first q words), and that text itself.

    A text of up to `short` bytes is scanned where it is read. Longer ones are dealt out by ranges of lags, each of at most
    `cells` comparisons if every lag had to be compared in full; runs found by several ranges are told apart by their
    smallest period. A null or empty text has no words and no run; repeated rows repeat; other columns are left behind.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    size = F.octet_length("text")
    out = rows.filter(size <= short).mapInArrow(lambda it: _scan(it, least, exponent, with_text), "doc_id long, " + RUNS)
    long = materialise(rows.filter(size > short).withColumn("row", F.monotonically_increasing_id()), "long")
    if long.isEmpty():
        return out
    words = F.octet_length("text") / 2 + 1  # at most
    lags = F.greatest(F.floor(F.lit(cells) / words), F.lit(1))
    ranges = long.withColumn("lags", lags).select("row", "text", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(words / exponent) + 1, F.col("lags"))).alias("lag"), "lags")
    found = materialise(ranges.repartition("row", "lag").select("row", "text", "lag", "lags").mapInArrow(lambda it: _scan_ranges(it, least, exponent), "row long, start long, length long, period long"), "runs")
    runs = found.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    joined = long.join(runs, "row", "left").select("doc_id", "text", "runs")
    return out.union(joined.mapInArrow(lambda it: _sum_up(it, with_text), "doc_id long, " + RUNS))
