"""The registered queries over whole small tables: columns, and plain versions of what they return."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from tallyforge.llm import packing, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def rows_of(spark, sf, name: str) -> list:
    return queries.queries()[name](spark, sf).collect()


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


def test_op2(spark, sf, documents):
    got = {r["doc_id"]: r for r in rows_of(spark, sf, "op2_kd_sharding")}
    assert len(got) == len(documents)
    shards, places = defaultdict(list), defaultdict(set)
    for d in documents:
        r, data = got[d["doc_id"]], (d["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        shards[r["shard"]].append(r["slot"])
        places[data].add(r["shard"])
    assert set(shards) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_op3_and_op4(spark, sf, documents):
    toxic = {r["doc_id"]: r for r in rows_of(spark, sf, "op3_kneser_ney_toxicity")}
    told = {r["doc_id"]: r for r in rows_of(spark, sf, "op4_segmentation_language_id")}
    known = {d["lang"] for d in documents if crc(d["doc_id"]) % 3 != 1 and d["lang"]}
    right = Counter()
    for d in documents:
        t, g = toxic[d["doc_id"]], told[d["doc_id"]]
        held = crc(d["doc_id"]) % 3 == 1
        assert t["held_out"] == g["held_out"] == held and 0 <= t["score"] <= 1 and 0 <= g["score"] <= 1 and t["predicted"] == int(t["score"] >= 0.7)
        letters = any(c.isalpha() for c in d["text"] or "")
        assert g["lang_pred"] in known if letters else g["lang_pred"] == "und"
        right[g["lang_pred"] == d["lang"]] += held and letters
    assert len(toxic) == len(told) == len(documents) and right[True] >= 0.95 * (right[True] + right[False])


def test_op6(spark, sf, documents):
    got = {r["doc_id"]: r for r in rows_of(spark, sf, "op6_weak_supervision_quality")}
    for d in documents:
        text = (d["text"] or "").encode()
        words = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split(b"\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in (i, i + 1, i + 2)}
        r = got[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(len(w.decode()) for w in words), len(re.findall(rb"[#*$%&|<>]", text)), dup, len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r["base_failed"] and r["kept"])
    assert len(got) == len(documents)


def test_op7(spark, sf, documents):
    from xxhash import xxh64_intdigest

    prints = {}
    for d in documents:
        words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (d["text"] or "").encode()))
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxh64_intdigest(s, 42) for s in shingles]
        prints[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    label = {i: i for i in prints}
    links = [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(spark, sf, "op7_simhash_near_dedup")} == {(i, f"{p:016x}", label[i]) for i, p in prints.items()}


def test_op10(spark, sf, documents):
    import struct

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, sf, "op10_best_fit_packing"):
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in documents:
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        cut = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert sorted(pieces[d["doc_id"]]) == [(k, 2048 * k, len(c), zlib.crc32(struct.pack(f"<{len(c)}I", *c))) for k, c in enumerate(cut)]
    total = 0
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048
        total += sum(own[-1])
    assert len(sequences) <= -(-total // 2048) + 1
