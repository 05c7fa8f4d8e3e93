"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontamination, langid, lines, oracles, packing, periods, quality, sharding, simhash, tokens, toxicity, warc
from .common import materialise, new_path, table, third


def op1_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load with estimates for a tenth of the documents, their recount (delivered twice), and the removal
    and return of another tenth: the totals of a plain count of all documents."""
    counts = materialise(tokens.token_counts(table(spark, sf_dir, "documents"), tokens.tokenizer_files()), "counts")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    estimated = counts.withColumn("tokens", F.when(part == 0, F.ceil(F.col("bytes") / 4)).otherwise(F.col("tokens")).cast("long"))
    rollup = tokens.Rollup(spark, new_path(spark, "rollup"))
    rollup.commit("load", tokens.inserts(estimated))
    for _ in range(2):
        rollup.commit("recount", tokens.revisions(estimated.filter(part == 0), counts.filter(part == 0)))
    rollup.commit("removal", tokens.deletes(counts.filter(part == 1)))
    rollup.commit("return", tokens.inserts(counts.filter(part == 1)))
    return rollup.totals()


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a fortieth of all bytes, so that there are 40."""
    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    out = sharding.shard_documents(docs, target_bytes=max(1, -(-total // 40)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models and curve from labelled rows that are not held out, scores of all whole texts. Null and empty texts score as no evidence."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.filter(third() != 1), table(spark, sf_dir, "labels").filter(third() != 1))
    return toxicity.score(docs, model, threshold=0.7).select("doc_id", (third() == 1).alias("held_out"), "score", "predicted")


def op4_segmentation_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from rows that are not held out, predicted for all. Null and letterless texts are und."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(third() != 1), langid.vocabulary_path())
    return langid.predict(docs, model).select("doc_id", (third() == 1).alias("held_out"), "lang_pred", "score")


def op5_splittable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back by byte ranges. A null html is an empty payload; rows that repeat in full each get a record."""
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_weak_supervision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, base rules and posterior of every document; a null text has no words."""
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles of all documents, linked at three differing bits; texts without words are linked as zero."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, limit=3)


def op8_set_join_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's removed lines, by number; which earlier line each matches is the operator's to say."""
    return lines.removals(table(spark, sf_dir, "documents")).drop("matched_docs", "matched_lines")


def op9_string_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item of which half or more stands in it. Null texts match nothing."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=5, coverage=0.5).drop("text_key")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2048 tokens; a null text is the end id alone."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


#: A conversation whose texts spell the marks of common chat templates.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op11_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, encoded and read back. Null texts are empty."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    path = chat.tokenizer_path()
    return chat.digests(chat.format_conversations(turns.union(added), path), path)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codebooks from six rounds over all embeddings, codes and errors of all, and errors by label. Without any vector, no row."""
    vectors = table(spark, sf_dir, "embeddings")
    books = codes.train(vectors, "vec_id", "embedding", parts=8, entries=16, rounds=6, scale=4096)
    coded = materialise(codes.assign(vectors, books, ["vec_id", "label"], "embedding", 4096), "codes")
    out = codes.with_totals(coded, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which get a periodic tail first. A null text has no words; a document without a
    doc_id gets no tail."""
    docs = periods.with_periodic_tails(table(spark, sf_dir, "documents"))
    return periods.periodic_runs(docs, least=24, exponent=3, with_text=False).drop("collapsed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_splittable_warc": oracles.SPLITTABLE_WARC,
        "op8_set_join_line_dedup": oracles.LINE_DEDUP,
        "op11_chat_masks": oracles.CHAT_MASKS,
        "op12_vector_codes": oracles.vector_codes(),
        "op13_periodic_runs": oracles.PERIODIC_RUNS,
    }
