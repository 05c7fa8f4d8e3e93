"""SimHash near-duplicates by anchor points: the codewords of a Hamming code cover the fingerprints.

near_duplicates() links fingerprints of shingles within a few bits. similar_documents() takes anchors of a wider fingerprint
of the words as candidates and confirms them by the Jaccard similarity of whole sets of shingles; short texts, of which a
fingerprint says little, meet at their rarest shingles instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, forget, keyed, materialise, release_memory, without_rows
from .components import connected_components

#: Links join fingerprints that differ in so many of 64 bits at most. Two halves of 32 bits then have one that differs in
#: one bit at most, which is the threshold that the code's anchors are built for.
THRESHOLD = 3


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    for batch in batches:
        out = np.zeros(batch.num_rows, np.uint64)
        for i, text in enumerate(batch.column(1).to_pylist()):
            words = (text or "").encode().lower().split()
            if not words:
                continue
            shingles = map(b" ".join, zip(*(words[j:] for j in range(k)))) if len(words) >= k else (b" ".join(words),)
            h = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), ">u8")
            votes = np.zeros(64, np.int64)
            for at in range(0, len(h), 65536):
                votes += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            out[i] = np.packbits(2 * votes > len(h)).view(">u8")[0]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "bits"])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, bits): a bit is 1 if it is set in over half the XXH64 (seed 42) of the k-word shingles of the A-Z lower-cased
    whole text. Fewer words make one shingle; a text without words, or null, has zero."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _fingerprints(it, k), "doc_id long, bits long")


def hexadecimal(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def syndrome(half: Column) -> Column:
    """Of the (31,26) Hamming code on bits 0 to 30 of a half: the exclusive or of the 1-based places of the set bits; 0 for a codeword."""
    masks = [sum(1 << (place - 1) for place in range(1, 32) if place >> k & 1) for k in range(5)]
    out = F.lit(0)
    for k, mask in enumerate(masks):
        out = out + F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))) % 2, k)
    return out


def halves_of(*bits: str) -> Column:
    """The 31 covered bits of each half of 64-bit columns."""
    return F.array(*(x for c in bits for x in (F.col(c).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), F.shiftrightunsigned(c, 32).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")))))


def anchored(prints: DataFrame, *bits: str) -> DataFrame:
    """prints with a column anchor: each row at every anchor near a half of its fingerprint, the 64-bit columns `bits`.

    Anchors are the 2^26 codewords of the perfect (31,26) Hamming code, for each half by its number. The covering radius is
    1 and halves within the threshold of 1 are sought, so a half goes to each codeword within 2 of it: with syndrome s,
    flipping places i and i xor s gives a codeword, for each i < i xor s (place 0: no flip), 16 in all; a codeword is
    alone within 2. The 32nd bit of a half is not covered: it can't put halves within 1 further apart. Halves two bits apart
    meet as well, at the codeword next to a word between them.
    """
    halves = prints.select("*", F.posexplode(halves_of(*bits)).alias("__side", "__half"))
    flip = "shiftright(shiftleft(1L, __i), 1)"
    pair = "shiftright(shiftleft(1L, __i ^ __s), 1)"
    spread = halves.withColumn("__s", syndrome(F.col("__half"))).withColumn("__i", F.explode(F.expr("if(__s = 0, array(0), sequence(0, 31))"))).filter("__s = 0 or __i < (__i ^ __s)")
    code = F.expr(f"if(__s = 0, __half, __half ^ {flip} ^ {pair})")
    return spread.select((code * (2 * len(bits)) + F.col("__side")).alias("anchor"), *prints.columns)


def _merge(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member's number for each of n members linked by a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _stars(own: np.ndarray, limit: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Links of one anchor's distinct fingerprints, in blocks, thinned to a star for each group that they join."""
    label = np.arange(len(own))
    for i in range(0, len(own), block):
        x = own[i : i + block]
        for j in range(0, i + 1, block):
            y = own[j : j + block]
            a, b = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= limit)
            a, b = a + i, b + j
            keep = label[a] != label[b]
            if keep.any():
                roots, place = np.unique(np.concatenate([label[a[keep]], label[b[keep]]]), return_inverse=True)
                half = len(place) // 2
                merged = roots[_merge(place[:half], place[half:], len(roots))]
                table = np.arange(len(own))
                table[roots] = merged
                label = table[label]
    far = np.flatnonzero(label != np.arange(len(own)))
    return own[label[far]], own[far]


def _compare(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal anchors; the rows come sorted by anchor, and a run may go on in the next batch."""

    def links(anchor: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(anchor)) + 1
        starts, ends = np.r_[0, edges], np.r_[edges, len(anchor)]
        size, found = ends - starts, []
        small = np.repeat(size <= 24, size)
        a, b = anchor[small], bits[small]
        for lag in range(1, int(size[size <= 24].max(initial=1))):
            i = np.flatnonzero((a[lag:] == a[:-lag]) & (np.bitwise_count(b[lag:] ^ b[:-lag]) <= limit))
            found.append((b[i], b[i + lag]))
        found += [_stars(bits[s:e], limit) for s, e in zip(starts[size > 24], ends[size > 24])]
        x = np.concatenate([f[0] for f in found] or [np.zeros(0, np.uint64)])
        y = np.concatenate([f[1] for f in found] or [np.zeros(0, np.uint64)])
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1) if len(x) else np.zeros((2, 0), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p).view(np.int64)) for p in pairs], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        anchor, bits = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(anchor):
            continue
        last = np.searchsorted(anchor, anchor[-1])
        held.append((anchor, bits))
        if last or anchor[0] != held[0][0][0]:
            anchor, bits = (np.concatenate(x) for x in zip(*held))
            last = np.searchsorted(anchor, anchor[-1])
            if last:
                yield links(anchor[:last], bits[:last])
            held = [(anchor[last:], bits[last:])]
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held)))


def linked_prints(prints: DataFrame, limit: int = THRESHOLD) -> DataFrame:
    """(a, b): links between distinct fingerprints (column bits) that join all that reach each other by links of `limit` bits.

    At an anchor with many fingerprints, links are thinned to one star a group, so no square of a group's size is written.
    """
    if not 0 <= limit <= THRESHOLD:
        raise ValueError(f"the anchors cover 0 to {THRESHOLD} differing bits")
    rows = anchored(prints.select("bits"), "bits").repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(lambda it: _compare(it, limit), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 3, limit: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id that can be reached by links of `limit` differing bits.

    Equal fingerprints are linked, zero (no words) among them. A null doc_id counts as larger than all others, so it names
    no component unless alone. Repeated rows each get their row. An empty table gives no row.
    """
    prints = materialise(fingerprints(docs, k), "prints")
    distinct = materialise(prints.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "distinct")
    groups = connected_components(linked_prints(distinct.select("bits"), limit))
    labelled = distinct.join(groups.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    labelled = materialise(labelled, "labelled")
    heads = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(heads, "component").select("bits", "component_id")
    return prints.join(named, "bits").select("doc_id", hexadecimal(F.col("bits")).alias("fingerprint"), "component_id")


# documents by confirmed similarity

#: Bits of 128 in which fingerprints of words may differ to be compared by shingles. One word in 45 changed, which leaves a
#: Jaccard similarity of about 0.8 of five-word shingles, changes about 9 bits; unrelated texts differ in 40 and more.
NEAR = 24
#: Texts of up to so many distinct shingles meet at their rarest ones as well, where no similar pair is missed.
SHORT = 80
#: Shingles are ranked by how often those are that share so many bits of their hash.
RARITY_BITS = 16
#: Groups of an anchor up to this size are compared at once, larger ones by way of their middle first.
SMALL = 16


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the k-word shingles of the A-Z lower-cased text. Fewer words make one shingle, none an empty set."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[j:] for j in range(k)))) if len(words) >= k else (b" ".join(words),)
    return np.unique(np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def _word_prints(batches: Iterator[pa.RecordBatch], k: int, short: int) -> Iterator[pa.RecordBatch]:
    """A number for the sequence of words, and 128 bits: each 1 if set in over half the XXH3 of the distinct words; the set of
    shingles of texts with words, `short` shingles at most, else null."""
    from xxhash import xxh3_128_digest, xxh64_intdigest

    for batch in batches:
        node, out, sets = np.zeros(batch.num_rows, np.uint64), np.zeros((batch.num_rows, 16), np.uint8), [None] * batch.num_rows
        for i, text in enumerate(batch.column(2).to_pylist()):
            words = (text or "").encode().lower().split()
            node[i] = xxh64_intdigest(b" ".join(words), 42)
            if 0 < len(words) < short + k:
                sets[i] = shingle_set(text, k).view(np.int64)
            h = np.frombuffer(b"".join(map(xxh3_128_digest, set(words))), np.uint8).reshape(-1, 16)
            votes = np.zeros(128, np.int64)
            for at in range(0, len(h), 65536):
                votes += np.unpackbits(h[at : at + 65536], axis=1).sum(0, dtype=np.int64)
            out[i] = np.packbits(2 * votes > len(h))
        left, right = (np.ascontiguousarray(out[:, 8 * j : 8 * j + 8]).view(np.int64)[:, 0] for j in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node.view(np.int64)), pa.array(left), pa.array(right), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "text_key", "node", "left", "right", "short"])
    release_memory()


def _at_rarest(batches: Iterator[pa.RecordBatch], counts: np.ndarray, least: Fraction) -> Iterator[pa.RecordBatch]:
    """(anchor, node, left, right, label, size) of short sets (node, label, own) at each shingle of their prefix: the rarest ones,
    so many that sets with `least` of their shingles in common share one. left and right are 128 bits, each the parity of the
    shingles that fall on it."""
    for batch in batches:
        made = [np.zeros((0, 6), np.int64)]
        for node, label, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            hashes = np.array(own.values, np.int64).view(np.uint64)
            n = len(hashes)
            ranked = hashes[np.lexsort((hashes, counts[hashes & np.uint64(len(counts) - 1)]))]
            prefix = ranked[: n - -(-least.numerator * n // least.denominator) + 1].view(np.int64)
            bits = np.bincount((hashes >> np.uint64(32)).astype(np.int64) & 127, minlength=128) & 1
            left, right = np.packbits(bits.astype(np.uint8)).view(np.int64)
            rows = np.empty((len(prefix), 6), np.int64)
            rows[:, 0], rows[:, 1:] = prefix, (node, left, right, label, n)
            made.append(rows)
        rows = np.concatenate(made)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["anchor", "node", "left", "right", "label", "size"])


def at_rarest_shingles(short: DataFrame, least: Fraction) -> DataFrame:
    """Rows of _at_rarest() of sets (node, label, own). Shingles are counted by a part of their hash, so what goes to the driver
    and to each task is of one size always."""
    mask = (1 << RARITY_BITS) - 1
    found = short.select(F.explode("own").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit(mask).cast("long")).alias("b")).count().collect()
    counts = np.zeros(mask + 1, np.int64)
    for b, n in found:
        counts[b] = n
    return short.select("node", "label", "own").mapInArrow(lambda it: _at_rarest(it, counts, least), "anchor long, node long, left long, right long, label long, size long")

def _pairs_of(group: np.ndarray, reach, across: bool, block: int = 1024) -> Iterator[np.ndarray]:
    """Rows (a, b) of nodes of one anchor's rows (node, left, right, label, size) that may be similar: reach(sizes, sizes) is how
    many of their bits may differ.

    A large group is first compared with its middle only, the member nearest to the majority of each bit. With `across`, all
    pairs with different labels are compared, in blocks.
    """
    prints, sizes = group[:, 1:3].view(np.uint64), group[:, 4]
    if across or len(group) <= SMALL:
        for i in range(0, len(group), block):
            for j in range(0, i + 1, block):
                x, y = slice(i, i + block), slice(j, j + block)
                apart = group[x, 3][:, None] != group[y, 3][None, :]
                if not apart.any():
                    continue
                far = np.bitwise_count(prints[x, 0][:, None] ^ prints[y, 0][None, :]).astype(np.int16) + np.bitwise_count(prints[x, 1][:, None] ^ prints[y, 1][None, :])
                a, b = np.nonzero((far <= reach(sizes[x][:, None], sizes[y][None, :])) & apart)
                yield np.stack([group[x, 0][a], group[y, 0][b]], 1)
        return
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(group), 16), axis=1)
    middle = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(group)).view(np.uint64)
    at = int(np.bitwise_count(prints ^ middle).sum(1).argmin())
    near = np.bitwise_count(prints ^ prints[at]).sum(1) <= reach(sizes, sizes[at])
    yield np.stack([np.full(int(near.sum()), group[at, 0]), group[near, 0]], 1)


def _candidates(batches: Iterator[pa.RecordBatch], reach, across: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of nodes, and (anchor, null) for each large group; rows come sorted by anchor and may go on in the next batch."""

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(rows)]
        out, large = [np.zeros((0, 2), np.int64)], []
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            out += _pairs_of(rows[s:e, 1:], reach, across)
            if e - s > SMALL:
                large.append(rows[s, 0])
        pairs = np.concatenate(out)
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[pairs[:, 0], np.array(large, np.int64)]), pa.array([*pairs[:, 1].tolist(), *[None] * len(large)], pa.int64())], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
        held.append(rows)
        if rows[0, 0] == rows[-1, 0] == held[0][0, 0]:
            continue
        rows = np.concatenate(held)
        last = np.searchsorted(rows[:, 0], rows[-1, 0])
        if last:
            yield from found(rows[:last])
        held = [rows[last:]]
    if held:
        yield from found(np.concatenate(held))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            own = [shingle_set(x, k) for x in batch.column(1).slice(at, 256).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), lists], ["node", "own"])
    release_memory()


def _similar(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Of pairs (a, b) of nodes those whose sets (node, own) are similar; written."""
    a, b = least.numerator, least.denominator
    both = pairs.join(sets.select("node", "own").toDF("a", "x"), "a").join(sets.select("node", "own").toDF("b", "y"), "b")
    return materialise(both.filter((a + b) * F.size(F.array_intersect("x", "y")) >= a * (F.size("x") + F.size("y"))).select("a", "b"), "links")


def _confirmed(pairs: DataFrame, heads: DataFrame, docs: DataFrame, k: int, least: Fraction) -> DataFrame:
    """Of pairs (a, b) of nodes those whose whole sets of shingles are similar. heads: (node, first_id, text_key)."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    kept = materialise(heads.join(wanted, "node", "left_semi"), "wanted")
    rows = broadcast_if_small(kept.toDF("node", "w_id", "w_key"), 1_000_000)
    texts = docs.join(rows, docs["doc_id"].eqNullSafe(rows["w_id"]) & (docs["text_key"] == rows["w_key"])).select("node", "text")
    sets = materialise(texts.mapInArrow(lambda it: _sets(it, k), "node long, own array<long>").dropDuplicates(["node"]), "sets")
    out = _similar(pairs, sets, least)
    forget(sets)
    forget(kept)
    return out


def _linked(nodes: DataFrame, anchors, reach, confirm) -> DataFrame:
    """(a, b): links that join all similar nodes that meet at anchors. anchors(nodes with a label) are their rows (anchor, node, left,
    right, label, size), reach the bits that may differ, confirm(pairs) the pairs that are similar.

    A large group of an anchor is first linked to its middle; then only members that this hasn't joined meet.
    """

    def found(rows: DataFrame, across: bool) -> DataFrame:
        return materialise(rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda it: _candidates(it, reach, across), "a long, b long").distinct(), "candidates")

    tried = found(anchors(nodes.withColumn("label", F.col("node"))), False)
    links = confirm(tried.filter("b is not null"))
    large = tried.filter("b is null").select(F.col("a").alias("anchor"))
    if not large.isEmpty():
        named = nodes.join(connected_components(links), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        open_ = anchors(named).join(broadcast_if_small(large, 1_000_000), "anchor", "left_semi")
        others = found(open_, True)
        fresh = materialise(others.filter("b is not null").join(tried.filter("b is not null"), ["a", "b"], "left_anti"), "candidates")
        links = links.union(confirm(fresh))
        forget(others)
        forget(fresh)
    forget(tried)
    return links


def similar_documents(docs: DataFrame, k: int = 5, least: Fraction = Fraction(4, 5), limit: int = NEAR) -> DataFrame:
    """(doc_id, text_key, component_id): the smallest doc_id that can be reached by links of a Jaccard similarity of `least`
    or more between whole sets of k-word shingles. text_key is the hash of a row's text. Texts with equal words are linked,
    those without words among them.

    Fingerprints are of the distinct words, for changed words move these far less than shingles. Documents that meet at an
    anchor of one of four 32-bit parts and differ in `limit` of 128 bits at most are compared by shingles. Similar documents
    all of whose parts differ in three bits or more may be missed, which happens to short ones: texts of up to SHORT shingles
    also meet at their rarest ones, by prefixes of which similar sets share one, within the bits that sets so similar can
    differ in; of these no pair is missed. A null doc_id counts as larger than all others.
    """
    docs = keyed(docs)
    prints = materialise(docs.mapInArrow(lambda it: _word_prints(it, k, SHORT), "doc_id long, text_key long, node long, left long, right long, short array<long>"), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("x")
    nodes = materialise(prints.groupBy("node").agg(first, F.first("left").alias("left"), F.first("right").alias("right"), F.first("short").alias("own")).select("node", "x.doc_id", "x.text_key", "left", "right", "own"), "distinct")
    heads = nodes.select("node", F.col("doc_id").alias("first_id"), "text_key")
    by_words = _linked(nodes.select("node", "left", "right"), lambda own: anchored(own, "left", "right").withColumn("size", F.lit(0).cast("long")).select("anchor", "node", "left", "right", "label", "size"), lambda x, y: limit, lambda pairs: _confirmed(pairs, heads, docs, k, least))
    short = nodes.filter("own is not null").select("node", "own")
    share, whole = least.denominator - least.numerator, least.denominator + least.numerator
    by_shingles = _linked(short, lambda own: at_rarest_shingles(own, least), lambda x, y: share * (x + y) // whole, lambda pairs: _similar(pairs, short, least))
    named = heads.join(connected_components(by_words.union(by_shingles)), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialise(named, "labelled")
    least_id = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return prints.select("doc_id", "text_key", "node").join(named.join(least_id, "component").select("node", "component_id"), "node").select("doc_id", "text_key", "component_id")


def keep_one(docs: DataFrame, k: int = 5, least: Fraction = Fraction(4, 5), limit: int = NEAR) -> DataFrame:
    """The documents without the later members of each group of similar_documents(); the one with the smallest doc_id stays.

    Rows that share the smallest doc_id all stay, and so do rows without a doc_id.
    """
    found = similar_documents(docs, k, least, limit)
    return without_rows(docs, found.filter(F.col("doc_id") != F.col("component_id")))
