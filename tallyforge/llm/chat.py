"""Chat formatting: a conversation as one marked text, encoded once with offsets, and a loss mask over the tokens of its assistant texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, per_worker, release_memory

#: The marks of the template. Each is one token, so that tokens end where texts do.
START, MIDDLE, END = MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.S)

FORMATTED = "conv_id long, part long, whole boolean, n_turns int, formatted string, input_ids array<int>, loss array<boolean>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def escape(text: str) -> str:
    r"""text without any `<|`, by which all control strings begin: a backslash goes between, one more where there are some."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: Iterable[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The marked text of turns (role, text), and the spans of the texts of the role that is learned, in order."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        pieces += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(pieces), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that a marked text was made of."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens, given by sorted bounds, have a character in one of the sorted spans: two binary searches a span."""
    mask = np.zeros(len(starts), bool)
    if spans:
        begin, end = np.array(spans).T
        for lo, hi, long in zip(np.searchsorted(ends, begin, "right"), np.searchsorted(starts, end, "left"), end > begin):
            mask[lo:hi] |= long
    return mask


def tokenizer_with_marks(path: str):
    """A tokenizer of the tokenizers library that knows the marks as tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in MARKS])
    return tokenizer


def _format(batches: Iterator[pa.RecordBatch], path: str, learned: str, at_most: int) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text) in order of conversation and turn, as parts: a conversation, or as much of it as lies in
    this partition and goes into `at_most` characters."""
    from pyspark import TaskContext

    tokenizer = per_worker(("chat", path), lambda: tokenizer_with_marks(path))
    first, number = TaskContext.get().partitionId() << 32, 0
    nothing = object()
    current, turns, size, cut = nothing, [], 0, True
    made: list[tuple] = []

    def part(whole: bool) -> None:
        nonlocal number, turns, size
        formatted, spans = render(turns, learned)
        encoded = tokenizer.encode(formatted, add_special_tokens=False)
        bounds = np.fromiter(chain.from_iterable(encoded.offsets), np.int64, 2 * len(encoded)).reshape(-1, 2)
        made.append((current, first + number, whole, len(turns), formatted, np.array(encoded.ids, np.int32), loss_mask(bounds[:, 0], bounds[:, 1], spans)))
        number, turns, size = number + 1, [], 0

    def batch() -> pa.RecordBatch:
        conv, at, whole, n, text, ids, loss = zip(*made)
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        made.clear()
        lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x))) for x in (ids, loss))
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(at, pa.int64()), pa.array(whole), pa.array(n, pa.int32()), pa.array(text, pa.string()), *lists], ["conv_id", "part", "whole", "n_turns", "formatted", "input_ids", "loss"])

    for rows in batches:
        for conv, role, text in zip(*(rows.column(k).to_pylist() for k in range(3))):
            if conv != current:
                if turns:
                    part(whole=not cut)
                cut, current = current is nothing, conv  # what stands at an end of the partition may go on beyond it
            elif size + len(text or "") > at_most:
                cut = True
                part(whole=False)
            turns.append((role or "", text or ""))
            size += len(role or "") + len(text or "")
            if sum(len(x[4]) for x in made) > at_most:
                yield batch()
    if turns:
        part(whole=False)
    if made:
        yield batch()
    release_memory()


def format_conversations(turns: DataFrame, tokenizer: str, learned: str = "assistant", at_most: int = 1 << 18) -> DataFrame:
    """turns (conv_id, turn, role, text) as marked texts with their token ids and loss masks, written.

    Rows are dealt by ranges of conversation and turn, so that a conversation with very many turns is spread over tasks:
    parts of it (`whole` is false) follow one another by `part`, and since each mark is a token, their ids and masks join
    to those of the whole. The same goes for conversations of more than `at_most` characters; a turn is never cut. Null
    roles and texts are empty; rows without conv_id are one conversation; turns that tie go by role and text, null turns
    come first; repeated rows are turns each; other columns are left behind; an empty table gives no row.
    """
    turn, role, text = F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(text).alias("place"))
    order = ["conv_id", "turn", "role", "place"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("conv_id", "role", "text")
    return materialise(dealt.mapInArrow(lambda it: _format(it, tokenizer, learned, at_most), FORMATTED), "formatted")


def _read_back(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Parts in order of their conversations and numbers, as one row for each conversation: turns are parsed from the marked
    text, learned texts are decoded from the ids under the mask."""
    tokenizer = per_worker(("chat", path), lambda: tokenizer_with_marks(path))
    nothing = object()
    current, made, state = nothing, [], None

    def row() -> tuple:
        n, told, chars, learned, size = state
        return current, n, told.hexdigest(), chars, learned.hexdigest(), size

    def batch() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        made.clear()
        return out

    for rows in batches:
        for k, (conv, formatted) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())):
            if conv != current:
                if state:
                    made.append(row())
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            state[4] += len(formatted)
            ids, loss = (rows.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (2, 3))
            turned = np.flatnonzero(np.diff(np.concatenate(([0], loss.astype(np.int8), [0]))))
            for lo, hi in zip(turned[::2], turned[1::2]):
                text = unescape(tokenizer.decode(ids[lo:hi].tolist(), skip_special_tokens=False))
                state[2] += len(text)
                state[3].update(text.encode())
        if made:
            yield batch()
    if state:
        made.append(row())
        yield batch()
    release_memory()


def digests(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each conversation, read back from what format_conversations wrote. Whole conversations are read where they
    lie; the parts of others meet in order, and one after the other goes through a running digest."""
    columns = ["conv_id", "formatted", "input_ids", "loss"]
    meeting = formatted.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part").select(*columns)
    found = [materialise(x.mapInArrow(lambda it: _read_back(it, tokenizer), DIGESTS), "digests", rows=64) for x in (formatted.filter("whole").select(*columns), meeting)]
    return found[0].union(found[1])
