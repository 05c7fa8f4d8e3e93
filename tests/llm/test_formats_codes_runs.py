"""Chat formatting, vector codes and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import chat, codes, periods, queries

CHAT = "conv_id long, turn long, role string, text string, part string, whole string, formatted string, loss string"
CONTROL = ["<|im_end|>", "<\\|im_end|>", "<|im_start|>assistant<|im_sep|>", "<|endoftext|>", "<", "|", "<\\", "\\|", "\n", "  é日本 ", "ok"]


def conversations() -> list[tuple]:
    """Nulls, empty, long and repeated rows, ties, control strings; a hot conversation and rows without one."""
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "<|im_end|>\n", None]), text()) for c in range(30) for t in range(rng.randint(1, 5))]
    rows += [(7, 1, "assistant", "tie b"), (7, 1, "assistant", "tie a"), (8, None, "assistant", "no turn"), (9, 0, "assistant", None), (9, 0, "assistant", ""), (None, 1, "assistant", "x"), (None, None, None, None)]
    rows += [(99, t, ["user", "assistant"][t % 2], f"turn {t} " + "word " * 30) for t in range(400)] + [(50, 0, "assistant", "long " * 40_000)]
    return [r + ("clash",) * 4 for r in rows + rows[:3]]


def plain_digests(rows: list[tuple]) -> dict:
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        size = sum(33 + len(chat.escape(r[2] or "")) + len(chat.escape(r[3] or "")) for r in own)
        out[conv] = (len(own), told, len(learned), learned, size)
    return out


def test_escaping_is_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("<|\\a") for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    turns = [(rng.choice(CONTROL), rng.choice(CONTROL) + rng.choice(CONTROL)) for _ in range(200)]
    assert chat.parse(chat.render(turns)[0]) == turns


def test_masks_are_those_of_a_plain_overlap():
    rng = random.Random(2)
    for _ in range(300):
        cuts = sorted(rng.choices(range(40), k=12))
        bounds = np.array([(a, max(b, a)) for a, b in zip(cuts, cuts[1:])])
        marks = sorted(rng.sample(range(40), 6))
        spans = [(marks[0], marks[1]), (marks[2], marks[2]), (marks[3], marks[5])]
        expected = [any(a < e and b > s and e > s and b > a or (a == b and s < a < e) for s, e in spans) for a, b in bounds]
        assert chat.loss_mask(bounds[:, 0], bounds[:, 1], spans).tolist() == expected


@pytest.mark.parametrize("at_most", [1 << 18, 500])
def test_conversations_read_back(spark, at_most):
    rows = conversations()
    turns = spark.createDataFrame(rows, CHAT).repartition(5)
    path = chat.tokenizer_path()
    formatted = chat.format_conversations(turns, path, at_most=at_most)
    expected = plain_digests(rows)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = chat.digests(formatted, path).collect()
    # rows that tie in conversation, turn and role go by a hash of the text: plain_digests knows no such order
    tied = {7, 9, None} | {r[0] for r in rows[:3]} | {c for c in expected if len({(r[1], r[2]) for r in rows if r[0] == c}) < sum(r[0] == c for r in rows)}
    assert sorted(map(str, (r["conv_id"] for r in got))) == sorted(map(str, expected))
    for r in got:
        n, told, chars, learned, size = expected[r["conv_id"]]
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (n, chars, size)
        if r["conv_id"] not in tied:
            assert (r["turns_sha256"], r["loss_sha256"]) == (digest(told), digest(learned))
    tokenizer = chat.tokenizer_with_marks(path)
    for conv in (99, 3, 50):  # parts join to the ids of the whole
        parts = formatted.filter(F.col("conv_id") == conv).orderBy("part").collect()
        assert sum((r["input_ids"] for r in parts), []) == tokenizer.encode("".join(r["formatted"] for r in parts), add_special_tokens=False).ids
        assert all(len(r["loss"]) == len(r["input_ids"]) for r in parts)
    if at_most == 500:
        assert formatted.filter("conv_id = 99").count() > 20
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], CHAT), path), path).count() == 0


def plain_codes(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[dict, str]:
    """By Python's integers, all entries of all parts."""
    kept = [(i, [math.floor(4096 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort()
    m = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * m : p * m + m]
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda a, own: min(range(len(own)), key=lambda k: (far(a, own[k]), k))
    for _ in range(rounds):
        for p, own in enumerate(books):
            got = [[] for _ in own]
            for _, v in kept:
                got[near(cut(v, p), own)].append(cut(v, p))
            books[p] = [[sum(c) // len(g) for c in zip(*g)] if g else e for g, e in zip(got, own)]
    out = {}
    for i, v in kept:
        best = [near(cut(v, p), own) for p, own in enumerate(books)]
        out.setdefault(i, []).append(("".join(f"{k:02x}" for k in best), sum(far(cut(v, p), own[k]) for p, (own, k) in enumerate(zip(books, best)))))
    return out, hashlib.sha256(",".join(str(x) for own in books for e in own for x in e).encode()).hexdigest()


@pytest.mark.parametrize("spread", [3, 4000, (1 << 27), (1 << 40)])
def test_nearest_is_exact(spread):
    """Near ties, ties, and components for which float32 says little or 64 bits don't do."""
    rng = np.random.default_rng(spread % 97)
    for _ in range(12):
        entries = rng.integers(-spread, spread + 1, (16, 8))
        entries[9] = entries[4]
        part = np.concatenate((rng.integers(-spread, spread + 1, (40, 8)), (entries[rng.integers(0, 16, 30)] + entries[rng.integers(0, 16, 30)]) // 2))
        index, error = codes.nearest(part, entries)
        for row, k, e in zip(part.tolist(), index.tolist(), error.tolist()):
            far = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in entries.tolist()]
            assert (k, e) == (far.index(min(far)), min(far))


def test_codes_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 10**6), [rng.uniform(-1, 1) if rng.random() < 0.9 else 0.25 for _ in range(16)]) for _ in range(150)]
    rows += [(i, [float(np.float32(x)) for x in v]) for i, v in rows[:20]] + [(5, None), (6, [0.5] * 15 + [None]), (7, [float("nan")] * 16), (8, [1.0] * 15 + [float("-inf")]), (9, [-1e-9] * 16), (10, [70000.0] + [0.0] * 15)]
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, [1, None, 2][n % 3], "clash") for n, (i, v) in enumerate(rows)], "vec_id long, embedding array<float>, label int, code string").repartition(4)
    expected, sha = plain_codes(rows)
    books = codes.train(df)
    assert books.sha256() == sha
    got = codes.assign(df, books, ["vec_id", "label"]).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted((i, *x) for i, own in expected.items() for x in own)
    totals = codes.with_totals(codes.assign(df, books, ["vec_id", "label"]), "label", "error", "label_error", broadcast_groups=0).collect()
    for label in (1, 2, None):
        own = [r for r in totals if r["label"] == label]
        assert len(own) == sum(r["label"] == label for r in got) and {r["label_error"] for r in own} == {sum(r["error"] for r in own)}
    odd = df.union(spark.createDataFrame([(10**7, [1.0] * 5, 1, ""), (10**7, [], 1, ""), (10**7, [3e38] * 16, 1, "")], df.schema))
    assert codes.train(odd).sha256() == sha
    assert [(r["code"], r["error"]) for r in codes.assign(odd, books, ["vec_id"]).collect() if r["vec_id"] == 10**7] == [(None, None)] * 3
    none = df.filter("embedding IS NULL")
    assert codes.train(none) is None and codes.assign(none, None, ["vec_id"]).count() == 0


def plain_runs(words: list, least: int = 24) -> list[tuple]:
    """Every lag, position by position."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end > at and end - at + q >= max(least, 3 * q):
                found.setdefault((at, end - at + q), q)
            at = end + 1
    return sorted(((s, l, q) for (s, l), q in found.items()), key=lambda x: (x[0], x[2]))


def texts() -> list[str | None]:
    rng = random.Random(6)
    out = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "a " * 600, "a b " * 12, "a b " * 11 + "a", "x " + "a\x0bb\tc " * 40 + "y", "ab\x1cc d " * 30, "é   " * 40]
    for _ in range(60):
        words, kinds = [], rng.randint(1, 30)
        for _ in range(rng.randint(1, 6)):
            own = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 40))]
            words += own * rng.choice([1, 1, 2, 3, 4, 9]) + own[: rng.randrange(len(own))]
        out.append(" ".join(words))
    out.append(" ".join(f"w{rng.randrange(50)}" for _ in range(2000)) + " one two three" * 2000)
    return out


def expected_summary(text: str | None) -> tuple:
    words = (text or "").encode().split()
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + l for s, l, q in runs)]
    best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return len(runs), *told, digest("".join(f"{s},{l},{q}\n" for s, l, q in runs).encode()), digest(b" ".join(kept))


def test_lag_ranges_find_the_runs_of_all_lags():
    for text in texts():
        ids = periods.word_ids((text or "").encode().split())
        expected = plain_runs(ids.tolist())
        n = len(ids)
        assert periods.smallest_periods(periods.lag_runs(ids, range(1, n))) == expected
        if n < 800:
            cut = [x for lo in range(1, n, 7) for x in periods.lag_runs(ids, range(lo, min(n, lo + 7)))]
            assert periods.smallest_periods(cut) == expected


@pytest.mark.parametrize("short, cells", [(1 << 16, 1 << 30), (40, 5000)])
def test_runs_of_documents(spark, short, cells):
    own = texts() if short > 40 else texts()[:-1]
    rows = [(i, t, "clash", 1) for i, t in enumerate(own)] + [(None, own[6], "", 1), (None, None, "", 1), (3, own[9], "", 1), (3, own[9], "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, row int").repartition(4)
    got = periods.periodic_runs(docs, short=short, cells=cells)
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda x: [str(v) for v in x]
    assert sorted(((r["doc_id"], *(r[c] for c in columns)) for r in got.collect()), key=key) == sorted(((i, *expected_summary(t)) for i, t, *_ in rows), key=key)
    if short > 40:
        assert got.filter("doc_id = 6").first()["collapsed"] == "a"
    assert periods.periodic_runs(docs.limit(0), short=short).count() == 0


def test_periodic_tails(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 90)))) for i in range(200)] + [(None, "a b"), (4, None)]
    got = {(r["doc_id"], None if r["text"] is None else bytes(r["text"]).decode()) for r in periods.with_periodic_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = set()
    for i, t in rows:
        h, w = zlib.crc32(str(i).encode()), (t or "").split()
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            t = " ".join(w[k if k < a else a + (k - a) % p] for k in range(len(w)))
        expected.add((i, t))
    assert got == expected


@pytest.mark.parametrize("name", ["op5_splittable_warc", "op11_chat_masks", "op12_vector_codes", "op13_periodic_runs"])
def test_registered_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    twin = con.sql(queries.oracle_sql()[name])
    columns = sorted(twin.columns)
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    key = lambda x: [str(v) for v in x]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted((tuple(r[k] for k in at) for r in twin.fetchall()), key=key)
