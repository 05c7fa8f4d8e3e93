"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination and packing, each stage written before the next reads it."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontamination, langid, lines, packing, simhash
from tallyforge.llm.common import forget, materialise, table, third, without_rows


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay: `und` ones go (null, empty and letterless texts among them), and those whose
    likeliest language has less than half the probability. The declared language is what is learned from; it decides on
    no document. Rows equal in doc_id and text stay or go together; very long texts are scored whole."""
    model = langid.train(docs.filter(third() != 1), langid.vocabulary_path())
    rejected = langid.predict(docs, model).filter((F.col("lang_pred") == "und") | (F.col("score") < 0.5))
    return without_rows(docs, rejected)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one are taken out of the texts; every document stays, null and empty texts as they are.
    Of lines that tie, the one with the smaller doc_id and place is the earlier; see lines.repeated_lines for repeated rows."""
    return lines.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of a Jaccard similarity of 0.8 or more stays, the one with the smallest doc_id; texts
    without words are one group. Rows without a doc_id stay, and so do repeated rows of the one that stays."""
    return simhash.keep_one(docs, k=5, least=Fraction(4, 5))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item go; null and empty texts stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), least=5, coverage=0.5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2048 tokens at most; a null text is the end id alone, repeated rows repeat."""
    return packing.pack_documents(docs, packing.tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", packed)]

#: Fingerprints and token ids are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    return docs
