"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialise, without_rows

HITS = "doc_id long, text_key long, item_id long, coverage double, item_tokens int, matched int, tiles int, longest int"
BASE, PRIME = 1_000_003, (1 << 61) - 1
#: ASCII letters in lower case, all other ASCII signs but digits as spaces; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def _hashes(tokens: list[bytes], spans: list[tuple[int, int]], size: int) -> Iterator[tuple[int, int]]:
    """(rolling hash, place) of each run of `size` tokens within the spans."""
    lead = pow(BASE, size, PRIME)
    for begin, end in spans:
        if end - begin < size:
            continue
        h = 0
        for i in range(begin, end):
            h = (h * BASE + hash(tokens[i])) % PRIME
            if i >= begin + size:
                h = (h - lead * hash(tokens[i - size])) % PRIME
            if i >= begin + size - 1:
                yield h, i - size + 1


def _free(marked: bytearray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for begin, end in spans:
        while begin < end:
            start = marked.find(0, begin, end)
            if start < 0:
                break
            stop = marked.find(1, start, end)
            begin = end if stop < 0 else stop
            out.append((start, begin))
    return out


def _same(item: list[bytes], text: list[bytes], p: int, t: int, most: int) -> int:
    """How many tokens from p and t on are equal, `most` at most: whole slices are compared, of doubling, then halving length."""
    k, step = 0, 8
    while k < most and item[p + k : p + min(k + step, most)] == text[t + k : t + min(k + step, most)]:
        k = min(k + step, most)
        step *= 2
    while step > 1:
        step //= 2
        if k + step <= most and item[p + k : p + k + step] == text[t + k : t + k + step]:
            k += step
    return k


def _room(marks: bytearray, at: int) -> int:
    end = marks.find(1, at)
    return (len(marks) if end < 0 else end) - at


def tiles(item: list[bytes], text: list[bytes], least: int, spans: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, length), longest first, none overlapping in either, none
    shorter than `least`. Of equal lengths the first in item, then in text is marked. spans: where in text to look.

    The searched length starts high and halves (running Karp-Rabin); a match over twice as long raises it again. Matches are
    found by their first pair only, which the pair before doesn't extend, so that repeated tokens cost no square.
    """
    item_marks, text_marks, out = bytearray(len(item)), bytearray(len(text)), []
    spans = [(0, len(text))] if spans is None else spans
    size = max(least, min(20, len(item)))
    while True:
        # places of a run in item by the free token before it, None where there is none
        places: dict[int, dict[bytes | None, list[int]]] = {}
        for h, p in _hashes(item, _free(item_marks, [(0, len(item))]), size):
            before = item[p - 1] if p and not item_marks[p - 1] else None
            places.setdefault(h, {}).setdefault(before, []).append(p)
        found: dict[int, list[tuple[int, int]]] = {}
        longest = 0
        for begin, end in _free(text_marks, spans):
            for h, t in _hashes(text, [(begin, end)], size):
                before = text[t - 1] if t > begin else None
                for token, starts in places.get(h, {}).items():
                    if token is not None and token == before:
                        continue
                    for p in starts:
                        k = _same(item, text, p, t, min(_room(item_marks, p), end - t))
                        if k >= size:
                            longest = max(longest, k)
                            found.setdefault(k, []).append((p, t))
        if longest > 2 * size:
            size = longest
            continue
        while found:
            k = max(found)
            heap = found.pop(k)
            heap.sort()
            for p, t in heap:
                # what marks leave of the match: all of it becomes a tile, parts are looked at again by their length
                i = 0
                while i < k:
                    free_item, free_text = item_marks.find(0, p + i, p + k), text_marks.find(0, t + i, t + k)
                    if min(free_item, free_text) < 0:
                        break
                    if (ahead := max(free_item - p, free_text - t)) > i:
                        i = ahead
                        continue
                    n = min(_room(item_marks, p + i), _room(text_marks, t + i), k - i)
                    if n == k:
                        item_marks[p : p + k] = text_marks[t : t + k] = b"\x01" * k
                        out.append((p, t, k))
                    elif n >= size:
                        found.setdefault(n, []).append((p + i, t + i))
                    i += n
        if size == least:
            return sorted(out, key=lambda x: (-x[2], x[0]))
        size = max(least, size // 2)


def _scan(batches: Iterator[pa.RecordBatch], items: list[tuple[int | None, str | None]], least: int, coverage: float) -> Iterator[pa.RecordBatch]:
    tokens = {i: own for i, (_, text) in enumerate(items) if (own := tokens_of(text))}
    seeds: dict[int, dict[tuple, list[int]]] = {}
    for i, own in tokens.items():
        size = min(least, len(own))
        for gram in set(zip(*(own[j:] for j in range(size)))):
            seeds.setdefault(size, {}).setdefault(gram, []).append(i)
    known = {size: frozenset(grams) for size, grams in seeds.items()}
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    for batch in batches:
        rows: list[tuple] = []
        for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            words = tokens_of(text)
            spans: dict[int, list[list[int]]] = {}
            for size, grams in seeds.items():
                if known[size].isdisjoint(zip(*(words[j:] for j in range(size)))):
                    continue
                for t, gram in enumerate(zip(*(words[j:] for j in range(size)))):
                    for i in grams.get(gram, ()):
                        own = spans.setdefault(i, [])
                        if own and t <= own[-1][1]:
                            own[-1][1] = t + size
                        else:
                            own.append([t, t + size])
            best: dict[int | None, tuple] = {}
            for i, own in spans.items():
                n, name = len(tokens[i]), items[i][0]
                got = tiles(tokens[i], words, min(least, n), [tuple(x) for x in own])
                matched = sum(k for *_, k in got)
                row = (matched / n, n, matched, len(got), got[0][2]) if got else (0.0,)
                if matched >= coverage * n and row > best.get(name, ()):
                    best[name] = row
            rows += [(doc, key, name, *row) for name, row in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 8, types)], [x.split()[0] for x in HITS.split(", ")])


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5, block_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, text_key, item_id, coverage, ...): documents (doc_id, text) of which tiles of `least` tokens or more cover at
    least `coverage` of a benchmark item's (item_id, text) tokens, wherever in the document and in whatever order they stand.

    Tokens are runs of letters and digits, A-Z in lower case. Every run that a tile holds starts from a seed of `least`
    tokens that both texts share; a document is tiled only with items whose seeds it has, and only where they stand. Items
    of fewer tokens are sought whole; items without tokens, null texts among them, match nothing. The benchmark goes to the
    executors in blocks of `block_bytes` of text each, one after another, and every document meets every block. Empty
    tables give no row. Repeated documents each give their rows. Texts that share an item_id, or lack one, are sought each
    for itself; a document has one row for each item_id of a block, that of the text it covers best.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    rows, out = keyed(docs), None
    for k in range(blocks):
        own = [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]
        found = rows.mapInArrow(lambda it, own=own: _scan(it, own, least, coverage), HITS)
        found = found if blocks == 1 else materialise(found, "hits")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """The documents that no item contaminates; rows equal in doc_id and text go together."""
    return without_rows(docs, contaminated(docs, benchmark, least, coverage))
