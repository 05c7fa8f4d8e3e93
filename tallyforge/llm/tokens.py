"""Token counts as rollups that are kept up to date by signed deltas."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hadoop_path, per_worker, release_memory

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["documents", "tokens", "bytes"]
SCHEMA = "source string, lang string, tokenizer_version string, documents long, tokens long, bytes long"


def tokenizer_files() -> dict[str, str]:
    """Version names and files of two public vocabularies, one for each library that reads them."""
    import public_tokenizers

    return {x: public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")}


def _counter(path: str):
    """(count of each text's tokens, count of each word's after a space)."""
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(x)) for x in texts], lambda words: [len(encoding.encode_ordinary(" " + x)) for x in words]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(texts: list[str]) -> list[int]:
        return [len(x) for x in model.encode(texts, num_threads=1)] if texts else []

    return count, count


def _count(batches: Iterator[pa.RecordBatch], tokenizers: dict[str, str], remembered: int) -> Iterator[pa.RecordBatch]:
    counters = {k: (*per_worker(("counter", path), lambda path=path: _counter(path)), {}) for k, path in tokenizers.items()}
    merging = re.compile(r" \s|\s |^ | $|▁")  # elsewhere a single space parts words, where no token crosses
    for batch in batches:
        versions, numbers, rows = [], [], []
        texts = batch.column(batch.num_columns - 1).to_pylist()
        odd = [bool(x and merging.search(x)) for x in texts]
        for version, (whole, of_words, known) in counters.items():
            for i, text in enumerate(texts):
                first, *words = (text or "").split(" ")
                if odd[i]:
                    n = whole([text])[0]
                else:
                    new = list({w for w in words if w not in known})
                    if len(known) + len(new) > remembered:
                        known.clear()
                        new = list(set(words))
                    known.update(zip(new, of_words(new)))
                    n = whole([first])[0] + sum(map(known.__getitem__, words))
                versions.append(version)
                numbers.append(n)
                rows.append(i)
        taken = batch.take(pa.array(rows, pa.int64()))
        size = [len((texts[i] or "").encode()) for i in rows]
        yield pa.RecordBatch.from_arrays([*taken.columns[:-1], pa.array(versions, pa.string()), pa.array(numbers, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "source", "lang", "tokenizer_version", "tokens", "bytes"])
    del counters
    release_memory()


def token_counts(docs: DataFrame, tokenizers: dict[str, str], remembered_words: int = 200_000) -> DataFrame:
    """(doc_id, source, lang, tokenizer_version, tokens, bytes): a row for each document and tokenizer (version: file).

    A null or empty text has no tokens. Nulls in source and lang stay; repeated rows repeat.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: _count(it, tokenizers, remembered_words), "doc_id long, source string, lang string, tokenizer_version string, tokens long, bytes long")


def inserts(counts: DataFrame) -> DataFrame:
    """Deltas of documents that are new."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("documents"), "tokens", "bytes")


def deletes(counts: DataFrame) -> DataFrame:
    """Deltas of documents that go, with the counts that they were inserted with."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).alias("tokens"), (-F.col("bytes")).alias("bytes"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas of documents that are counted anew, or whose keys have changed."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Totals by source, language and tokenizer version under one folder, a subfolder of sums for each batch.

    A batch is written under a draft name and becomes visible by one rename, so a commit happens whole or not at all;
    a batch id that is there already is left alone, so a batch may be delivered any number of times. compact() writes a
    base, the sums of batches with their ids, which becomes visible by one rename as well; batches that the newest base
    names no longer count by themselves, whether or not their folders are still there. The folder must be on a file system
    with atomic renames that driver and executors share. One writer at a time commits a given batch id or compacts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self, prefix: str) -> list[str]:
        fs, path = hadoop_path(self.spark, self.folder)
        found = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(x.removeprefix(prefix) for x in found if x.startswith(prefix))

    def _base(self) -> tuple[int, set[str]]:
        """Number of the newest base, 0 without one, and the ids of the batches in it."""
        n = max(map(int, self._names("base-")), default=0)
        return n, {r["value"] for r in self.spark.read.text(f"{self.folder}/base-{n}/ids").collect()} if n else set()

    def _publish(self, draft: str, name: str) -> None:
        fs, path = hadoop_path(self.spark, f"{self.folder}/{draft}")
        if not fs.rename(path, hadoop_path(self.spark, f"{self.folder}/{name}")[1]):
            raise OSError(f"{name} could not be committed")

    def committed(self, batch_id: str) -> bool:
        fs, path = hadoop_path(self.spark, f"{self.folder}/batch-{batch_id}")
        return fs.exists(path) or batch_id in self._base()[1]

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add up deltas (KEYS and SUMS) as a batch; False if it was committed before."""
        if not batch_id or any(not (c.isalnum() or c in "_.") for c in batch_id):
            raise ValueError("a batch id is made of letters, digits, _ and .")
        if self.committed(batch_id):
            return False
        sums = deltas.groupBy(*KEYS).agg(*[F.sum(x).alias(x) for x in SUMS])
        sums.write.mode("overwrite").parquet(f"{self.folder}/_draft-{batch_id}")
        self._publish(f"_draft-{batch_id}", f"batch-{batch_id}")
        return True

    def totals(self) -> DataFrame:
        """Sums of the base and of all batches since; keys whose documents, tokens and bytes have come to nothing are left out."""
        n, merged = self._base()
        places = [f"{self.folder}/base-{n}/totals"] * bool(n) + [f"{self.folder}/batch-{x}" for x in self._names("batch-") if x not in merged]
        rows = self.spark.read.schema(SCHEMA).parquet(*places) if places else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(x).alias(x) for x in SUMS])
        return sums.filter(" or ".join(f"{x} <> 0" for x in SUMS))

    def compact(self) -> None:
        """Write a base of all that is committed, then remove what it replaces. If the driver dies before the rename, the
        old state holds; after it, the new one does, and what is left over is removed by the next compaction."""
        fs, _ = hadoop_path(self.spark, self.folder)
        n, merged = self._base()
        batches = self._names("batch-")
        draft = f"_draft-base-{n + 1}"
        self.totals().coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{draft}/totals")
        self.spark.createDataFrame([(x,) for x in sorted(merged.union(batches))], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{draft}/ids")
        self._publish(draft, f"base-{n + 1}")
        for name in [f"batch-{x}" for x in batches] + [f"base-{x}" for x in self._names("base-") if int(x) <= n]:
            fs.delete(hadoop_path(self.spark, f"{self.folder}/{name}")[1], True)
