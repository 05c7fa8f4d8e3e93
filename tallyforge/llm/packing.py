"""Best-fit packing of tokenised documents into fixed-length sequences, planned over a histogram of lengths."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, per_worker, rank_within, release_memory

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words that the tokenizer's own rules leave as one run of letters and one of signs: letters of the Latin blocks (composed
#: forms all; not the dotted capital I, whose small form has a loose dot), then ASCII signs. They skip its normaliser and pre-tokenizer, which take most of its time.
PLAIN = r"([A-Za-zÀ-ÖØ-öø-įı-ſ]*)([!-/:-@\[-`{-~]*)"


def byte_letters() -> dict[int, str]:
    """The byte-level spelling of each letter in PLAIN that is not ASCII."""
    from tokenizers.pre_tokenizers import ByteLevel

    rule = ByteLevel(add_prefix_space=False, use_regex=False)
    return {c: rule.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x180)}


def _encode(batches: Iterator[pa.RecordBatch], path: str, limit: int, end_id: int, remembered: int) -> Iterator[pa.RecordBatch]:
    """Each document's ids, cut into pieces of `limit` tokens. The tokenizer drops white space and no token crosses it, so ids are kept by word."""
    import operator
    import os
    import re
    import struct
    import zlib

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, end, known = per_worker(("tokenizer", path), lambda: Tokenizer.from_file(path)), struct.pack("<I", end_id), {}
    plain, latin, model = re.compile(PLAIN), byte_letters(), tokenizer.model

    number, runs = operator.attrgetter("id"), {"": b""}

    def run_ids(run: str) -> bytes:
        ids = [*map(number, model.tokenize(run if run.isascii() else run.translate(latin)))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(new: list[str]) -> None:
        if len(runs) > remembered:
            runs.clear()
            runs[""] = b""
        other = []
        for w in new:
            if m := plain.fullmatch(w):
                letters, signs = m.groups()
                letters = letters.lower()
                if letters not in runs:
                    runs[letters] = run_ids(letters)
                if signs not in runs:
                    runs[signs] = run_ids(signs)
                known[w] = runs[letters] + runs[signs]
            else:
                other.append(w)
        for w, e in zip(other, tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            ids = e.ids
            known[w] = struct.pack(f"<{len(ids)}I", *ids)

    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        texts = batch.column(1)
        for at in range(0, len(texts), 32):
            split = [(x or "").replace("\n", " ").split(" ") for x in texts.slice(at, 32).to_pylist()]
            for words in split:
                new = [w for w in set(words) if w not in known]
                if len(known) + len(new) > remembered:
                    known.clear()
                    new = list(set(words))
                learn(new)
                words[:] = [b"".join(map(known.__getitem__, words)) + end]
            for doc, (blob,) in zip(batch.column(0).slice(at, 32).to_pylist(), split):
                for k, begin in enumerate(range(0, len(blob), 4 * limit)):
                    own = blob[begin : begin + 4 * limit]
                    for column, x in zip(out, (doc, k, begin // 4, len(own) // 4, zlib.crc32(own))):
                        column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])
    known.clear()
    runs.clear()
    release_memory()


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, remembered_words: int = 150_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document; `tokenizer` is a file of the tokenizers library whose
    pre-tokenizer drops spaces and line ends. A null or empty text has the one token `end_id`. Repeated rows repeat."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _encode(it, tokenizer, capacity, end_id, remembered_words), PIECES)


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths.

    Rows are (length, first_rank, n, first_sequence, each, offset): the n pieces of that length from first_rank on fill
    sequences from first_sequence on, `each` pieces in a sequence, side by side from `offset`. Sequences with the same
    free space are kept as ranges, so work and plan depend on the distinct lengths, not on the number of documents.
    """
    plan, open_at, ranges, sequences = [], [], {}, 0

    def give(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in ranges:
                bisect.insort(open_at, space)
                ranges[space] = []
            ranges[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(open_at, length)
            space = open_at[at] if at < len(open_at) else capacity
            each = space // length
            if at < len(open_at):
                first, n = ranges[space].pop()
                if not ranges[space]:
                    del ranges[space]
                    open_at.pop(at)
            else:
                n = -(-left // each)
                first, sequences = sequences, sequences + n
            full = min(n, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, capacity - space))
                give(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            used = full
            if left and full < n:
                plan.append((length, rank, left, first + full, left, capacity - space))
                give(space - left * length, first + full, 1)
                rank, left, used = rank + left, 0, full + 1
            give(space, first + used, n - used)
    return plan


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add (sequence_id, offset) to pieces (doc_id, piece, start, length, ...), none longer than `capacity`.

    Pieces need a length of 1 at least. Ties (equal lengths) go by a hash of doc_id and piece; repeated rows take slots
    of their own. `pieces` is read three times, so it should be materialised. The histogram and the plan are bounded by
    the capacity, whatever the input's size.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = pd.DataFrame(plan_best_fit(counts, capacity), columns=["length", "first_rank", "n", "first_sequence", "each", "first_offset"], dtype="int64")
    planned = F.broadcast(pieces.sparkSession.createDataFrame(plan, "length long, first_rank long, n long, first_sequence long, each long, first_offset long").withColumnRenamed("length", "planned"))
    ranked = rank_within(pieces, ["length"], ["doc_id", "piece"], "rank")
    at = F.col("rank") - F.col("first_rank")
    placed = ranked.join(planned, (F.col("length") == F.col("planned")) & (at >= 0) & (at < F.col("n")))
    return placed.select(*pieces.columns, (F.col("first_sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"), (F.col("first_offset") + at % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack documents; one row per piece. An empty table gives no row."""
    return pack(materialise(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
