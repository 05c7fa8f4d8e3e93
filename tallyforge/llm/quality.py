"""Quality rules by weak supervision: rules vote or abstain, and expectation-maximisation estimates how far each can be trusted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BAD, ABSTAIN, GOOD = 0, 1, 2
#: rule: (measure, bad below, good from, good to, bad above); in between the rule abstains.
RULES = {
    "length": ("n_words", 50, 100, float("inf"), float("inf")),
    "word_length": ("word_chars / n_words", 2.5, 3.5, 9.0, 12.0),
    "symbols": ("n_symbols / n_words", -1, -1, 0.02, 0.1),
    "separators": ("bare words / n_words", -1, -1, 0.01, 0.1),
    "repeated_words": ("n_repeat_words / n_words", -1, -1, 0.1, 0.3),
    "repeated_lines": ("n_dup_lines / lines", -1, -1, 0.1, 0.5),
    "variety": ("distinct words / expected from length", 0.25, 0.5, float("inf"), float("inf")),
    "sentences": ("lines that end a sentence / lines", 0.3, 0.7, float("inf"), float("inf")),
    "capitals": ("capitals / letters", -1, -1, 0.15, 0.4),
    "shouting": ("exclamation marks / n_words", -1, -1, 0.02, 0.1),
}
MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern int"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    symbol, capital, letter = re.compile(r"[#*$%&|<>]"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[^\W\d_]")
    bounds = np.array([r[1:] for r in RULES.values()], float)
    weights = 3 ** np.arange(len(RULES))
    for batch in batches:
        base = np.zeros((5, batch.num_rows), np.int64)
        values = np.zeros((batch.num_rows, len(RULES)))
        for i, text in enumerate(batch.column(1).to_pylist()):
            raw = (text or "").encode()
            words = raw.split()
            n = len(words)
            if not n:
                continue
            numbers: dict[bytes, int] = {}
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
            repeated = 0
            if n >= 3:
                m = len(numbers)
                if m < 2_000_000:
                    windows = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
                else:  # three numbers no longer fit into 63 bits
                    _, pairs = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)
                    windows = pairs[:-1] * m + ids[2:]
                _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
                twice = np.r_[times[at] > 1, False, False]
                repeated = int((twice | np.r_[False, twice[:-1]] | np.r_[False, False, twice[:-2]]).sum())
            lines = [x for x in raw.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
            signs = len(symbol.findall(text))
            base[:, i] = n, sum(map(len, words)) - sum(1 for b in raw if 0x80 <= b < 0xC0) if not raw.isascii() else sum(map(len, words)), signs, len(lines) - len(set(lines)), repeated
            letters = len(letter.findall(text))
            ends = sum(x.rstrip().endswith((b".", b"!", b"?", b'"', b"'", b":", b"\xe2\x80\xa6", b"\xc2\xbb", b"\xe2\x80\x9d")) for x in lines)
            bare = sum(1 for w in words if len(w) == 1 and not w.isalnum())
            values[i] = n, base[1, i] / n, signs / n, bare / n, repeated / n, base[3, i] / len(lines), len(numbers) / n**0.9, ends / len(lines), len(capital.findall(text)) / max(1, letters), raw.count(b"!") / n
        votes = np.full(values.shape, ABSTAIN)
        votes[(values >= bounds[:, 1]) & (values <= bounds[:, 2])] = GOOD
        votes[(values < bounds[:, 0]) | (values > bounds[:, 3])] = BAD
        votes[base[0] == 0] = [BAD] + [ABSTAIN] * (len(RULES) - 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in base], pa.array((votes @ weights).astype(np.int32))], [x.split()[0] for x in MEASURES.split(", ")])


def measures(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text) the base measures over its whole text and `pattern`, all rules' votes as digits to base 3."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measure, MEASURES)


def posteriors(patterns: np.ndarray, counts: np.ndarray, rules: int, rounds: int = 1000, shrink: float = 0.001, start: float = 0.98) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each vote pattern, P(a vote is against | class, rule), P(class)) by expectation-maximisation; class 0 is bad.

    Texts are of two classes, in which each rule votes against by a rate of its own; an abstention says nothing. All rates
    are estimated from how the rules agree. They start from the votes: a text that no rule votes against is good by
    `start`, each vote against quarters its chance. `shrink` of all texts pull both rates of a rule to its overall rate, so
    a rule whose votes against stand alone counts for little, and the others may outvote it. The class of more votes
    against is the bad one.
    """
    votes = patterns[:, None] // 3 ** np.arange(rules) % 3
    against, favour = (votes == BAD).astype(float), (votes == GOOD).astype(float)
    pull = shrink * counts.sum()
    overall = (counts @ against + 1e-3) / (counts @ (against + favour) + 2e-3)
    good = np.where(against.any(1), 0.25 ** against.sum(1), start)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        rate = (weight @ against + pull * overall) / (weight @ (against + favour) + pull)
        share = (weight.sum(1) + pull / 2) / (counts.sum() + pull)
        odds = np.log(share[1] / share[0]) + against @ np.log(rate[1] / rate[0]) + favour @ np.log((1 - rate[1]) / (1 - rate[0]))
        before, good = good, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if (np.abs(good - before) * counts).sum() < 1e-9 * counts.sum():
            break
    if rate[0].sum() < rate[1].sum():
        good, rate, share = 1 - good, rate[::-1], share[::-1]
    return good, rate, share


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The measures of each document with base_failed, quality (posterior probability of being good) and kept.

    Estimates come from the counts of vote patterns over all documents that the base rules pass, at most 3^10 whatever the
    input. base_failed: under 50 words, or over half of them in repeated windows; such documents aren't kept, and have quality 0. A null or empty text counts
    as no words: one vote against it, none for it. Repeated rows each get their row; an empty table gives none.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    own = materialise(measures(docs).withColumn("base_failed", failed), "measures")
    table = own.filter(~F.col("base_failed")).groupBy("pattern").agg(F.count("*").alias("n")).toPandas()
    good = posteriors(table["pattern"].to_numpy(np.int64), table["n"].to_numpy(float), len(RULES))[0] if len(table) else np.zeros(0)
    known = F.broadcast(docs.sparkSession.createDataFrame(pd.DataFrame({"pattern": table["pattern"].astype("int32"), "quality": np.asarray(good, float)}), "pattern int, quality double"))
    judged = own.join(known, "pattern", "left").withColumn("quality", F.when(F.col("base_failed"), 0.0).otherwise(F.col("quality")))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
