"""Toxicity by class-conditional Kneser-Ney models of the characters of words, with shared backoff counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, release_memory

ORDER = 6
START, END = "\x02", "\x03"
DISCOUNT = 0.75
#: Words of one stretch, whose likelihoods are compared for themselves. One word tells more than a stretch with its
#: ordinary neighbours: expressions of several words show by the words that they are made of.
STRETCH = 1
FEATURES = ["whole", "first", "second", "third", "words"]
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Ratios:
    """log P(toxic) - log P(ordinary) of a character after ORDER - 1 others: by n-gram if one class has seen it, else by
    context. Every n-gram has its row, by a 64-bit key in sorted order."""

    key: np.ndarray
    value: np.ndarray

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        hit = self.key[at] == keys
        return hit, np.where(hit, self.value[at], np.float32(0))


@dataclass
class ToxicityModel:
    grams: Ratios
    contexts: Ratios
    weights: list[float] = field(default_factory=lambda: [0.0] * (len(FEATURES) + 1))
    centre: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    spread: list[float] = field(default_factory=lambda: [1.0] * len(FEATURES))


def keys_of(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of the n characters that end at each place of codes (from place n - 1 on)."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for j in range(n):
        out = (out ^ codes[j : len(codes) - n + 1 + j].astype(np.uint64)) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return out * MULTIPLIER


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _grams(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    words: tuple[Counter, Counter] = (Counter(), Counter())

    def spend() -> pa.RecordBatch:
        counts: dict[str, list[int]] = {}
        for side, own in enumerate(words):
            for w, n in own.items():
                w = START * (ORDER - 1) + w + END
                for i in range(len(w) - ORDER + 1):
                    counts.setdefault(w[i : i + ORDER], [0, 0])[side] += n
            own.clear()
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array([x[0] for x in counts.values()], pa.int64()), pa.array([x[1] for x in counts.values()], pa.int64())], ["gram", "toxic", "plain"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words[0 if toxic else 1].update(words_of(text))
        if sum(map(len, words)) > held:
            yield spend()
    yield spend()


def gram_counts(rows: DataFrame, held_words: int = 150_000) -> DataFrame:
    """(gram, toxic, plain): how often each n-gram of ORDER characters within words occurs in either class of (text, toxic)."""
    return rows.select(F.col("text").cast("string"), F.col("toxic").cast("int")).mapInArrow(lambda it: _grams(it, held_words), "gram string, toxic long, plain long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def backed_off(counts: DataFrame) -> DataFrame:
    """(tail, p): Kneser-Ney probability of the last of ORDER - 1 characters after the others, from how many distinct
    characters precede an n-gram in either class: the shared backoff of both models."""
    levels = {ORDER - 1: counts.groupBy(F.substring("gram", 2, ORDER - 1).alias("g")).agg(F.count("*").alias("n"))}
    for k in range(ORDER - 2, 0, -1):
        levels[k] = levels[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("n"))
    total, kinds = levels[1].agg(F.sum("n").alias("x")).scalar(), levels[1].agg(F.count("*").alias("x")).scalar()
    p = levels[1].select("g", ((F.col("n") - DISCOUNT + DISCOUNT * kinds / (kinds + 1)) / total).alias("p"))
    for k in range(2, ORDER):
        own = levels[k].withColumn("h", F.substring("g", 1, k - 1)).withColumn("rest", F.substring("g", 2, k - 1))
        heads = own.groupBy("h").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        p = own.join(heads, "h").join(p.withColumnRenamed("g", "rest"), "rest").select("g", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("p")) / F.col("all")).alias("p"))
    return p.select(F.col("g").alias("tail"), "p")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = "".join(batch.column(0).to_pylist())
        n = len(text) // max(1, batch.num_rows)
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        keys = keys_of(codes, n)[::n] if n else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(1).cast(pa.float32())], ["key", "value"])


def _table(rows: DataFrame) -> Ratios:
    """rows: (n-gram, value), all of which are kept: the table grows with the distinct n-grams, 12 bytes each."""
    found = rows.mapInArrow(_keyed, "key long, value float").toArrow()
    key, value = (found.column(c).to_numpy() for c in ("key", "value"))
    order = np.argsort(key.view(np.uint64))
    return Ratios(key.view(np.uint64)[order], value[order])


def fit_language_models(rows: DataFrame) -> ToxicityModel:
    """Both classes' models from all of (text, toxic); rows with a null label are not learned from.

    A class's probability is discounted at the highest order only and backs off to the shared probability. Where neither
    class has seen an n-gram that probability cancels out of the ratio, so the tables of `Ratios` are all that scoring needs.
    """
    counts = materialise(gram_counts(rows.filter(F.col("toxic").isNotNull())), "grams")
    sides = ("toxic", "plain")
    split = counts.withColumn("h", F.substring("gram", 1, ORDER - 1))
    heads = split.groupBy("h").agg(*[F.sum(s).alias(f"all_{s}") for s in sides], *[F.count(F.when(F.col(s) > 0, 1)).alias(f"kinds_{s}") for s in sides])

    def left(s: str):
        return F.when(F.col(f"all_{s}") > 0, DISCOUNT * F.col(f"kinds_{s}") / F.col(f"all_{s}")).otherwise(1.0)

    def given(s: str):
        return F.when(F.col(f"all_{s}") > 0, F.greatest(F.col(s) - DISCOUNT, F.lit(0.0)) / F.col(f"all_{s}")).otherwise(0.0) + left(s) * F.col("p")

    full = split.join(heads, "h").join(backed_off(counts), F.substring("gram", 2, ORDER - 1) == F.col("tail"))
    grams = full.select("gram", F.log(given("toxic") / given("plain")).alias("value"))
    contexts = heads.select("h", F.log(left("toxic") / left("plain")).alias("value"))
    return ToxicityModel(_table(grams), _table(contexts))


def word_ratios(words: list[str], model: ToxicityModel) -> np.ndarray:
    """log-likelihood ratio of each word, its end included."""
    text = "".join([START * (ORDER - 1) + w + END for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    hit, value = model.grams.look(keys_of(codes, ORDER))
    _, other = model.contexts.look(keys_of(codes, ORDER - 1)[: len(value)])
    value = np.r_[np.zeros(ORDER - 1, np.float32), np.where(hit, value, other)].astype(np.float64)
    firsts = np.r_[0, np.cumsum(sizes[:-1])]
    inside = np.arange(len(codes)) - np.repeat(firsts, sizes) >= ORDER - 1
    return np.add.reduceat(value * inside, firsts)


def _features(batches: Iterator[pa.RecordBatch], model: ToxicityModel, remembered: int) -> Iterator[pa.RecordBatch]:
    known: dict[str, float] = {}
    for batch in batches:
        out = np.zeros((len(FEATURES), batch.num_rows))
        texts = batch.column(1)
        for at in range(0, batch.num_rows, 64):
            split = [words_of(x) for x in texts.slice(at, 64).to_pylist()]
            new = list({w for words in split for w in words if w not in known})
            if len(known) + len(new) > remembered:
                known.clear()
                new = list({w for words in split for w in words})
            for i in range(0, len(new), 8192):
                part = new[i : i + 8192]
                known.update(zip(part, word_ratios(part, model).tolist()))
            for i, words in enumerate(split, at):
                if words:
                    ratio = np.fromiter(map(known.__getitem__, words), float, len(words))
                    size = np.fromiter(map(len, words), float, len(words)) + 1
                    starts = np.arange(0, len(words), STRETCH)
                    best = np.sort(np.add.reduceat(ratio, starts) / np.add.reduceat(size, starts))[::-1][:3]
                    out[0, i] = ratio.sum() / size.sum()
                    out[1 : 1 + len(best), i] = best
                    out[4, i] = np.log(len(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in out]], ["doc_id", *FEATURES])
    known.clear()
    release_memory()


def features(docs: DataFrame, model: ToxicityModel, remembered_words: int = 200_000) -> DataFrame:
    """Per document: the length-normalised log-likelihood ratio of the whole text, the three largest of its stretches of
    words, and the logarithm of its words; all 0 for a text without words. Words are remembered up to a number, which changes no result."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _features(it, model, remembered_words), "doc_id long, " + ", ".join(f"{x} double" for x in FEATURES))


def calibrate(model: ToxicityModel, rows: DataFrame, at_most: int = 20_000, ridge: float = 1.0) -> ToxicityModel:
    """Fit a logistic curve from the features to P(toxic), on `at_most` labelled rows (doc_id, text, toxic) at the most
    (those with the smallest hashes of doc_id), both classes weighing alike. With one class only, scores stay 0.5."""
    sample = rows.filter(F.col("toxic").isNotNull()).orderBy(F.xxhash64("doc_id")).limit(at_most)
    sample = materialise(sample.select("doc_id", "text", "toxic"), "sample")
    got = features(sample, model).join(sample.select("doc_id", "toxic"), "doc_id").toPandas()
    x, y = got[FEATURES].to_numpy(float), got["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return model
    model.centre, model.spread = x.mean(0).tolist(), (x.std(0) + 1e-9).tolist()
    x = np.c_[np.ones(len(y)), (x - model.centre) / model.spread]
    w = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - ridge * np.r_[0, beta[1:]]
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(np.r_[1e-9, np.full(len(beta) - 1, ridge)])
        beta = beta + np.linalg.solve(curve, slope)
    model.weights = beta.tolist()
    return model


def train(docs: DataFrame, labels: DataFrame, at_most: int = 20_000, broadcast_rows: int = 1_000_000) -> ToxicityModel:
    """Learn from docs (doc_id, text) with labels (doc_id, toxic). A quarter of the labelled rows, by a hash of doc_id,
    is kept from the language models for calibration; null labels and labels of no document are passed over."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").join(broadcast_if_small(own, broadcast_rows), "doc_id").select("doc_id", "text", "toxic")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    return calibrate(fit_language_models(rows.filter(~apart)), rows.filter(apart), at_most)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted): P(toxic) for classes that weigh alike, and 1 where it is `threshold` or more. Null and empty texts get the score of no evidence."""
    z = F.lit(model.weights[0])
    for name, b, c, s in zip(FEATURES, model.weights[1:], model.centre, model.spread):
        z = z + F.lit(b) * (F.col(name) - F.lit(c)) / F.lit(s)
    p = 1 / (1 + F.exp(-z))
    return features(docs, model).select("doc_id", p.alias("score"), (p >= threshold).cast("int").alias("predicted"))
