"""Retrieval from the index against retrieval by a scan."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import index as I
from tallyforge.operators import search as X
from tallyforge.operators.scratch import scratch


def texts() -> list[str | None]:
    rng = random.Random(13)
    parts = ["a", "a", "b", "ab", "abc", "License", "licensed", "under", "e-mail", "e", "mail", "x1", "é", "İ", "İa", "don't", "R.2", "日本"]
    gaps = [" ", " ", " ", "  ", "\n", "\t ", "-", ".", ", ", "é", " ", "日", "'"]
    out = [None, "", " ", "a", "a a", "a a a", "a  a", "ab a b", "a b a b a", "é", "license"]
    for _ in range(250):
        out.append("".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(1, 30))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, docs):
    return I.build_index(docs, "doc_id", "text", scratch(spark, "index"), files=5)


QUERIES = ["a", "ab*", '"a b"', '"a b a"', '"b a*"', "a AND b", "a OR abc", "NOT a", "a AND NOT b", "(a OR x1) AND NOT (b AND ab)", "licens*", '"licensed under" OR license', "zzz", "zzz OR NOT zzz", "", "NOT (a OR b)", "a a", "a AND (b OR NOT c)"]


@pytest.mark.parametrize("query", QUERIES)
def test_index_gives_the_hits_and_scores_of_a_scan(docs, index, query):
    expected = {(r["doc_id"], r["score"]) for r in X.retrieve(docs, "text", query).select("doc_id", F.col("score").cast("int")).filter("text is not null").collect()}
    got = {tuple(r) for r in I.lookup(index, query).collect()}
    assert {x for x in got if texts()[x[0]] is not None} == expected


@pytest.mark.parametrize("query", ["e-mail", "e-mail OR don't", "a AND NOT e-mail", "R.2", "e-m*"])
def test_words_with_signs_are_confirmed_in_texts(docs, index, query):
    with pytest.raises(ValueError, match="texts"):
        I.lookup(index, query)
    expected = {(r["doc_id"], r["score"]) for r in X.retrieve(docs, "text", query).select("doc_id", F.col("score").cast("int")).collect()}
    assert {tuple(r) for r in I.lookup(index, query, docs).collect()} == expected


def test_empty_tables(spark, docs):
    none = I.build_index(docs.limit(0), "doc_id", "text", scratch(spark, "index"))
    assert I.lookup(none, "a OR NOT b").count() == 0


def plain_postings(doc: int, text: str) -> list[tuple]:
    own, end = {}, 0
    for pos, m in enumerate(re.finditer("[a-z0-9]+", text)):
        own.setdefault(m[0], []).append({"pos": pos, "start": m.start(), "spaced": pos > 0 and re.fullmatch("[ \t\n\x0b\f\r]+", text[end : m.start()]) is not None})
        end = m.end()
    return [(term, doc, places) for term, places in own.items()]


@pytest.mark.parametrize("signs", [1, 40, 1_000_000])
def test_postings_of_texts_taken_together(monkeypatch, signs):
    monkeypatch.setattr(I, "SIGNS", signs)
    own = [None if t is None else t.lower() for t in texts()] + ["", "x" * 100, "a\0b \x0b\f c", None]
    rows = pa.RecordBatch.from_pydict({"doc": pa.array(range(len(own)), pa.int64()), "text": pa.array(own, pa.string())})
    made = list(I._postings(iter([rows, rows.slice(0, 0), rows.slice(3, 2)])))
    assert (len(made) > 2) == (signs < 1_000_000)
    expected = [x for i in [*range(len(own)), 3, 4] for x in plain_postings(i, own[i] or "")]
    got = [(r["term"], r["doc"], r["places"]) for b in made for r in b.to_pylist()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
