"""A positional inverted index over a document frame, and Boolean retrieval from it: the hits and scores of search.retrieve() without
a scan of the texts.

Postings lie in Parquet files by ranges of (term, document): a lookup reads the row groups whose range holds a term, and a
very common term is spread over files. What a query needs of each document is put together by one aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import leaf_pattern, leaves, parse

#: Runs of these signs are terms; everything else parts them.
TERM = re.compile("[a-z0-9]+")
#: Signs by code point, 128 and all above as one: 1 in a term, 0 a blank, which may stand between the words of a phrase, 2 other.
KINDS = np.full(129, 2, np.uint8)
KINDS[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = 1
KINDS[[ord(c) for c in " \t\n\x0b\f\r"]] = 0
#: Texts are taken together up to so many signs, or one by one if longer.
SIGNS = 1_000_000
PLACES = "array<struct<pos: int, start: int, spaced: boolean>>"


class Index(NamedTuple):
    """postings: (term, doc, places), a row for each term of a document; documents: (doc). place: number of the term in its document,
    where it starts, and whether nothing but blanks stands between it and the term before."""

    postings: DataFrame
    documents: DataFrame


def _together(texts: list[str]) -> Iterator[tuple[int, int]]:
    """First and last number, exclusive, of texts that make up about SIGNS signs."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and held + len(text) > SIGNS:
            yield first, i
            first, held = i, 0
        held += len(text)
    if texts:
        yield first, len(texts)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, lower-case text) to (term, doc, places), in batches of a bounded number of signs."""
    for rows in batches:
        texts = [t or "" for t in rows.column(1).to_pylist()]
        for first, last in _together(texts):
            data = "\0".join(texts[first:last])
            kinds = KINDS[np.minimum(np.frombuffer(data.encode("utf-32-le"), np.uint32), 128)]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], kinds == 1, [0])).astype(np.int8)))
            starts, ends = edges[::2], edges[1::2]
            if not len(starts):
                continue
            begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[first:last]])))
            own = np.searchsorted(begins, starts, "right") - 1
            pos = np.arange(len(starts)) - np.searchsorted(own, own)
            others = np.cumsum(kinds == 2)
            spaced = (pos > 0) & (others[starts] == np.concatenate(([-1], others[ends[:-1] - 1])))
            terms = pa.array(TERM.findall(data), pa.string()).dictionary_encode()
            key = own * len(terms.dictionary) + terms.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.diff(key[order], prepend=-1))
            place = [pos.astype(np.int32), (starts - begins[own]).astype(np.int32), spaced]
            places = pa.StructArray.from_arrays([pa.array(x[order]) for x in place], ["pos", "start", "spaced"])
            places = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)).astype(np.int32)), places)
            at = order[heads]
            made = [terms.dictionary.take(terms.indices.take(pa.array(at))), rows.column(0).take(pa.array(own[at] + first)), places]
            yield pa.RecordBatch.from_arrays(made, ["term", "doc", "places"])


def build_index(docs: DataFrame, key: str, text: str, path: str, files: int | None = None) -> Index:
    """Write the index of docs below path, which must be new. Keys must differ; a null text has no terms. Places count the
    signs of the lower-case text. files: into how many ranges the postings go (default: as many as shuffle partitions)."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("doc"), F.lower(F.col(text).cast("string")).alias("text"))
    rows = own.mapInArrow(_postings, f"term string, doc {kind}, places {PLACES}")
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "term", "doc").sortWithinPartitions("term", "doc").write.parquet(f"{path}/postings")
    own.select("doc").write.parquet(f"{path}/documents")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents"))


class Leaf(NamedTuple):
    """A word or phrase of a query: its terms in order, whether the last one is a beginning, and whether blanks alone part them."""

    terms: list[str]
    opens: bool
    plain: bool


def leaf_of(word: str) -> Leaf:
    bare = word.strip('"').lower()
    opens, body = bare.endswith("*"), bare.rstrip("*").strip()
    return Leaf(re.findall("[a-z0-9]+", body), opens, re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", body) is not None)


def _wanted(term: Column, leaf: Leaf, k: int) -> Column:
    return term.startswith(leaf.terms[k]) if leaf.opens and k == len(leaf.terms) - 1 else term == leaf.terms[k]


def _occurrences(leaf: Leaf, places: list[Column]) -> Column:
    """Starts and ends of a leaf's occurrences: places of the first term that the others follow, each after blanks."""

    def followed(k: int):
        return lambda a: F.exists(places[k], lambda b: (b["pos"] == a["pos"] + k) & b["spaced"])

    starts = places[0]
    for k in range(1, len(places)):
        starts = F.filter(starts, followed(k))
    length = len(leaf.terms[-1])
    if len(places) == 1:
        return F.transform(starts, lambda a: F.struct(a["start"].alias("start"), (a["start"] + length).alias("end")))
    last = len(places) - 1
    end = lambda a: F.filter(places[-1], lambda b: b["pos"] == a["pos"] + last)[0]["start"] + length
    return F.transform(starts, lambda a: F.struct(a["start"].alias("start"), end(a).alias("end")))


def _counted(leaf: Leaf, found: Column) -> Column:
    """How often a pattern search from left to right counts: a whole word takes the sign behind it along, so that of two occurrences
    one sign apart the second is passed over."""
    if leaf.opens:
        step = lambda s, x: F.when(x["start"] >= s["free"], F.struct((s["n"] + 1).alias("n"), x["end"].alias("free"))).otherwise(s)
    else:
        step = lambda s, x: F.when(x["start"] > s["free"], F.struct((s["n"] + 1).alias("n"), (x["end"] + 1).alias("free"))).otherwise(s)
    return F.aggregate(F.array_sort(found), F.struct(F.lit(0).alias("n"), F.lit(-1).alias("free")), step)["n"]


def lookup(index: Index, query: str, docs: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score) of the documents that a Boolean query matches; see search.retrieve() for its meaning.

    Only postings of the query's terms are read. Words with other signs than letters and digits within ("e-mail") are looked
    up by their parts, and confirmed in the texts of those documents alone: docs (key, text) must be given for them.
    """
    tree = parse(query)
    words = list(dict.fromkeys(_all(tree)))
    known = [(w, leaf_of(w)) for w in words]
    known = [(w, leaf) for w, leaf in known if leaf.terms]
    term = F.col("term")
    needed = F.lit(False)
    for _, leaf in known:
        for k in range(len(leaf.terms)):
            needed = needed | _wanted(term, leaf, k)
    rows = index.postings.filter(needed)
    gathered = {f"__{i}_{k}": F.flatten(F.collect_list(F.when(_wanted(term, leaf, k), F.col("places")))) for i, (_, leaf) in enumerate(known) for k in range(len(leaf.terms))}
    counts = rows.groupBy("doc").agg(*[v.alias(n) for n, v in gathered.items()]) if gathered else index.documents.limit(0)
    for i, (_, leaf) in enumerate(known):
        places = [F.col(f"__{i}_{k}") for k in range(len(leaf.terms))]
        n = _counted(leaf, _occurrences(leaf, places)) if leaf.plain else F.when(F.forall(F.array(*places), lambda p: F.size(p) > 0), F.lit(None)).otherwise(0)
        counts = counts.withColumn(f"__n{i}", n.cast("int"))
    counts = counts.select("doc", *[f"__n{i}" for i in range(len(known))])
    odd = [i for i, (_, leaf) in enumerate(known) if not leaf.plain]
    if odd:
        counts = _confirmed(counts, known, odd, docs, key, text)
    number = {w: i for i, (w, _) in enumerate(known)}

    def holds(tree: list | str) -> Column:
        if isinstance(tree, str):
            return F.coalesce(F.col(f"__n{number[tree]}"), F.lit(0)) > 0 if tree in number else F.lit(False)
        parts = [holds(x) for x in tree[1:]]
        if tree[0] == "NOT":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if tree[0] == "AND" else (out | p)
        return out

    score = F.lit(0)
    for w in dict.fromkeys(leaves(tree)):
        score = score + (F.coalesce(F.col(f"__n{number[w]}"), F.lit(0)) if w in number else 0)
    if _holds_of_nothing(tree):
        counts = index.documents.join(counts, "doc", "left")
    return counts.filter(holds(tree)).select("doc", score.cast("int").alias("score"))


def _all(tree: list | str) -> list[str]:
    return ([tree] if tree else []) if isinstance(tree, str) else [w for part in tree[1:] for w in _all(part)]


def _holds_of_nothing(tree: list | str) -> bool:
    """Whether a document without any of the words matches."""
    if isinstance(tree, str):
        return False
    parts = [_holds_of_nothing(x) for x in tree[1:]]
    return not parts[0] if tree[0] == "NOT" else all(parts) if tree[0] == "AND" else any(parts)


def _confirmed(counts: DataFrame, known: list[tuple[str, Leaf]], odd: list[int], docs: DataFrame | None, key: str, text: str) -> DataFrame:
    """counts with those of words that the index can't tell (null) taken from the texts of their documents."""
    if docs is None:
        raise ValueError(f"{known[odd[0]][0]} needs the documents' texts")
    unsure = F.lit(False)
    for i in odd:
        unsure = unsure | F.col(f"__n{i}").isNull()
    asked = counts.filter(unsure)
    low = F.lower(F.col(text))
    told = docs.join(asked.select(F.col("doc").alias("__doc")), F.col(key) == F.col("__doc"))
    told = told.select("__doc", *[F.regexp_count(low, F.lit(leaf_pattern(known[i][0]))).alias(f"__t{i}") for i in odd])
    joined = counts.join(told, F.col("doc") == F.col("__doc"), "left")
    return joined.select("doc", *[(F.coalesce(f"__n{i}", f"__t{i}") if i in odd else F.col(f"__n{i}")).alias(f"__n{i}") for i in range(len(known))])
