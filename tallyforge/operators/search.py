"""Boolean retrieval over a document frame."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prose import sanitize_query, stripped
from ..functions.scalars import query_from_keywords  # noqa: F401
from .records import cascade_of


@dataclass(frozen=True)
class Term:
    """A vocabulary entry: a keyword, the pattern of descriptions that it suits, its synonyms, and patterns that must or must not occur too."""

    keyword: str
    pattern: str
    synonyms: tuple[str, ...] = ()
    needs: str | None = None
    unless: str | None = None

    def suits(self, text: Column) -> Column:
        out = text.rlike(f"(?i){self.pattern}")
        if self.needs:
            out = out & text.rlike(f"(?i){self.needs}")
        if self.unless:
            out = out & ~text.rlike(f"(?i){self.unless}")
        return F.coalesce(out, F.lit(False))


def _spelled(word: str) -> str:
    return f'"{word}"' if " " in word else word


def plan_query(df: DataFrame, text: str, vocabulary: list[Term], defaults: list[str], most: int = 5) -> DataFrame:
    """Add keywords, boolean_query and broad_query: the vocabulary's terms that suit the text, in its order, defaults up to three.

    The first three terms that share no synonym are groups that must match together; the broad query asks for two of
    them, or any keyword.
    """
    hits = F.array_compact(F.array(*[F.when(t.suits(F.col(text)), F.lit(i)) for i, t in enumerate(vocabulary)]))
    words = F.array(*[F.lit(t.keyword) for t in vocabulary])
    groups = F.array(*[F.lit("(" + " OR ".join(map(_spelled, t.synonyms or (t.keyword,))) + ")") for t in vocabulary])
    names = F.array(*[F.array(*[F.lit(s.lower()) for s in (t.synonyms or (t.keyword,))]) for t in vocabulary])
    out = df.withColumn("__hits", hits).withColumn("__found", F.array_distinct(F.transform("__hits", lambda i: F.get(words, i))))
    spare = F.slice(F.array_except(F.array(*[F.lit(d) for d in defaults]), F.col("__found")), F.lit(1), F.greatest(F.lit(0), 3 - F.size("__found")))
    out = out.withColumn("keywords", F.slice(F.concat("__found", spare), 1, most))
    empty = F.array().cast("array<int>")
    apart = F.aggregate("__hits", empty, lambda kept, i: F.when(F.exists(kept, lambda k: F.arrays_overlap(F.get(names, k), F.get(names, i))), kept).otherwise(F.array_append(kept, i)))
    out = out.withColumn("__groups", F.transform(F.slice(apart, 1, 3), lambda i: F.get(groups, i)))
    loose, strict = query_from_keywords(F.col("keywords"), True), query_from_keywords(F.col("keywords"))
    rest = query_from_keywords(F.slice("keywords", 2, most), True)
    n = F.size("__groups")
    boolean = F.when(n >= 2, F.array_join("__groups", " AND ")).when(n == 1, F.concat(F.get("__groups", F.lit(0)), F.lit(" AND ("), rest, F.lit(")"))).otherwise(strict)
    broad = F.when(n >= 3, F.array_join(F.slice("__groups", 1, 2), " AND ")).otherwise(loose)
    return out.withColumn("boolean_query", boolean).withColumn("broad_query", broad).select(*df.columns, "keywords", "boolean_query", "broad_query")


def unjustified(text: Column, facts: Column, guards: list[tuple[str, str, str]]) -> Column:
    """Reasons why terms in text don't fit the facts; guards: (pattern of the term, pattern that the facts must show, reason)."""
    own = [F.when(text.rlike(f"(?i){term}") & ~facts.rlike(f"(?i){needs}"), F.lit(reason)) for term, needs, reason in guards]
    return F.array_compact(F.array(*own))


def without_unsupported(df: DataFrame, keywords: str, queries: list[str], facts: str, guards: list[tuple[str, str, str]]) -> DataFrame:
    """df with its keywords (an array) and queries without the terms whose guard the facts don't meet; see unjustified() for
    guards. Phrases and words that a term's pattern hits go from a query, which is sanitised after that, and stay where no
    guard fails. Null keywords and queries stay null; null facts meet no guard."""
    bad = F.concat_ws("\n", *[F.when(~F.coalesce(F.col(facts).rlike(f"(?i){needs}"), F.lit(False)), F.lit(term)) for term, needs, _ in guards]) if guards else F.lit("")
    patterns = F.filter(F.split("__bad", "\n"), lambda t: t != "")
    kept = F.filter(keywords, lambda k: ~F.exists(patterns, lambda t: F.rlike(k, F.concat(F.lit("(?i)"), t))))
    out = df.withColumn("__bad", bad)
    return out.withColumns({keywords: kept} | {q: stripped(q, "__bad") for q in queries}).select(*df.columns)


def parse(query: str) -> list | str:
    """A sanitised query as nested lists [op, parts...] with op AND, OR or NOT, and leaves of words and phrases. NOT binds most, AND before OR; parts side by side are joined by AND."""
    tokens = re.findall(r'"[^"]*"|[()]|[^\s()"]+', sanitize_query(query))
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def alternatives() -> list | str:
        nonlocal at
        parts = [together()]
        while peek() == "OR":
            at += 1
            parts.append(together())
        return parts[0] if len(parts) == 1 else ["OR", *parts]

    def together() -> list | str:
        nonlocal at
        parts = [single()]
        while peek() not in (None, "OR", ")"):
            if peek() == "AND":
                at += 1
            parts.append(single())
        return parts[0] if len(parts) == 1 else ["AND", *parts]

    def single() -> list | str:
        nonlocal at
        t = peek()
        at += 1
        if t == "NOT":
            return ["NOT", single()]
        if t == "(":
            inner = alternatives()
            at += peek() == ")"
            return inner
        return t or ""

    return alternatives() if tokens else ""


def leaf_pattern(word: str) -> str:
    """The pattern of a word or phrase in a lower-case text."""
    bare = word.strip('"').lower()
    star = bare.endswith("*")
    body = re.escape(bare.rstrip("*").strip()).replace(r"\ ", r"\s+").replace(" ", r"\s+")
    return rf"(^|[^a-z0-9]){body}" + ("" if star else "([^a-z0-9]|$)")


def leaves(tree: list | str) -> list[str]:
    if isinstance(tree, str):
        return [tree] if tree else []
    return [] if tree[0] == "NOT" else [x for part in tree[1:] for x in leaves(part)]


def predicate(tree: list | str, text: Column) -> Column:
    """A parsed query as a condition on a lower-case text; words match whole ASCII words, a trailing * the beginning of one."""
    if isinstance(tree, str):
        return text.rlike(leaf_pattern(tree)) if tree else F.lit(False)
    parts = [predicate(x, text) for x in tree[1:]]
    if tree[0] == "NOT":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if tree[0] == "AND" else (out | p)
    return out


def retrieve(docs: DataFrame, text: str, query: str) -> DataFrame:
    """Documents that a query matches, with a score: how often its terms occur. One scan without a shuffle."""
    tree, low = parse(query), F.lower(text)
    score = F.lit(0)
    for leaf in dict.fromkeys(leaves(tree)):
        score = score + F.regexp_count(low, F.lit(leaf_pattern(leaf)))
    return docs.filter(predicate(tree, low)).withColumn("score", score)


def first_answer(docs: DataFrame, text: str, queries: list[str]) -> DataFrame:
    """Hits of the first query that has any, with its number."""
    return cascade_of([retrieve(docs, text, q) for q in queries])


def pick_opinion(opinions: Column) -> Column:
    """Id of the first leading opinion that has one, else of the first that has one."""
    known = F.filter(opinions, lambda o: o["id"].isNotNull() & (o["id"] != 0))
    leading = F.filter(known, lambda o: F.coalesce(o["type"], F.lit("")).rlike("(?i)combined|lead|majority"))
    return F.coalesce(F.get(leading, F.lit(0))["id"], F.get(known, F.lit(0))["id"])
