"""Blocks, list markers and tables against plain versions and literal pages."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import blocks as B

SEGMENT = "doc int, page int, part int, line int, y double, size double, bold boolean, label boolean, x0 double, x1 double, text string"


def plain_marker(text: str) -> tuple | None:
    """(kind, glyph, fmt, start) by trying each shape of marker by itself."""
    if (m := re.match(r"[•●○◦▪■□►▸‣⁃∙·✓✔➢➤\-–—*]", text)) and text[1:].strip():
        if m[0] in "-–—":
            return ("bullet", "•" if m[0] == "-" else m[0], None, None) if text[1].isspace() else None
        return ("bullet", "•" if m[0] in "*∙·" else m[0], None, None)
    for fmt, shape in (("decimal", r"\d{1,3}"), ("lowerRoman", "[ivxlcdm]{2,6}"), ("upperRoman", "[IVXLCDM]{2,6}"), ("lowerLetter", "[a-z]"), ("upperLetter", "[A-Z]")):
        if (m := re.match(rf"(\(?)({shape})([.)])\s+", text)) and len(text) > len(m[0]) + 1 and (m[1] == "" or m[3] == ")"):
            if "Roman" in fmt:
                v = [B.ROMAN[c] for c in m[2].lower()]
                start = sum(-a if any(a < b for b in v[k + 1 : k + 2]) else a for k, a in enumerate(v))
            else:
                start = int(m[2]) if fmt == "decimal" else ord(m[2].lower()) - 96
            return ("number", None, fmt, start) if 1 <= start <= (200 if fmt == "decimal" else 10**9) else None
    return None


def plain_blocks(lines: list[dict], body: float, pitch: float) -> list[tuple[int, str]]:
    """From the lines themselves: each line looks back at all of the block that stands before it."""
    left, edge = min(x["x"] for x in lines), sorted(x["right"] for x in lines)[int(0.95 * (len(lines) - 1))]
    listed = lambda x: plain_marker(x["text"]) is not None and x["size"] < body * 1.15
    multi = lambda x: len(x["starts"]) > 1 and not (len(x["starts"]) == 2 and len(x["first"]) < 5 and plain_marker(x["first"] + " x"))

    def places(rows: list[dict]) -> list[float]:
        all_, out = sorted(x for r in rows for x in r["starts"]), []
        for k, x in enumerate(all_):
            begins = k == 0 or x - all_[k - 1] > 6
            if begins and k + 1 < len(all_) and all_[k + 1] - x <= 6:
                out.append(x)
        return out

    def table(rows: list[dict]) -> bool:
        """Whether rows can stand in one table, so far."""
        for k, b in enumerate(rows):
            if k == 0:
                if not multi(b):
                    return False
                continue
            a, known = rows[k - 1], [x for r in rows[:k] if len(r["starts"]) > 1 for x in r["starts"]]
            goes_on = plain_marker(b["text"]) is None and b["y"] - a["y"] < 1.35 * b["size"] and all(any(abs(x - s) < 6 for s in known) for x in b["starts"])
            if b["y"] - a["y"] > 3 * max(a["size"], b["size"]) or not (multi(b) or goes_on):
                return False
        return True

    def paragraph(rows: list[dict]) -> bool:
        a, b = rows[-2:]
        if multi(b) or listed(b) or b["label"] or re.search(r"\.{4,}\s*\S{1,8}$", b["text"]):
            return False
        steps = sorted(y["y"] - x["y"] for x, y in zip(rows[:-1], rows[1:-1]))
        usual, gap = steps[len(steps) // 2] if steps else a["size"] * pitch, b["y"] - a["y"]
        centre = lambda x: abs((x["x"] + x["right"]) / 2 - (left + edge) / 2) < 6
        at = rows[0]["text_x"] if listed(rows[0]) else rows[1]["x"]
        full = a["right"] >= edge - max(0.12 * max(1, edge - left), 5 * a["size"]) or (b["text"][:1].islower() and b["text"][:1].isascii() and not re.search(r"""[.!?:]["')\]]?$""", a["text"]))
        fits = abs(a["size"] - b["size"]) < 0.6 and 0 < gap < 2.2 * a["size"] and gap <= max(1.3 * usual, 1.05 * a["size"]) and (a["bold"] == b["bold"] or len(rows) > 2)
        return fits and (centre(a) and centre(b) and a["x"] > left + 10 or abs(b["x"] - at) < 4 and full)

    out, at = [], 0
    while at < len(lines):
        end = at + 1
        if multi(lines[at]):
            while end < len(lines) and table(lines[at : end + 1]):
                end += 1
            rows = lines[at:end]
            wide, cols = [r for r in rows if len(r["starts"]) > 1], places(rows)
            good = len(rows) > 1 and len(cols) > 1 and sum(all(any(abs(x - c) < 6 for c in cols) for x in r["starts"]) for r in wide) > 1
            kind = "table" if good and not all(len(r["starts"]) == 2 and abs(r["right"] - edge) < 8 for r in wide) else "tabs"
            end = end if kind == "table" else at + 1
        elif re.search(r"^.*?\S\s*\.{4,}\s*\S{1,8}$", lines[at]["text"]):
            kind = "leader"
        else:
            kind = "item" if listed(lines[at]) else "paragraph"
            while end < len(lines) and paragraph(lines[at : end + 1]):
                end += 1
        out += [(out[-1][0] + 1 if out else 0, kind)] * (end - at)
        at = end
    return out


def random_page(rng: random.Random) -> list[tuple]:
    """(line, y, size, bold, label, [(x0, x1, text)]) with runs of each kind, and lines that nearly belong to them."""
    y, out = 0.0, []
    while len(out) < 30:
        kind, size = rng.randrange(7), rng.choice([10.0, 10.0, 10.0, 10.3, 13.0])
        for k in range(rng.randint(1, 5)):
            y += rng.choice([11, 12, 12, 12, 13, 14, 20, 23, 33, -1])
            jitter = lambda: rng.choice([0, 0, 1, 3, 5, 6, 7])
            if kind == 0:
                segs = [(10 + jitter(), 50, "a"), (100 + jitter(), 150, "b"), (200 + jitter(), 300, "c")]
                segs = rng.sample(segs, rng.choice([1, 2, 3, 3]))
            elif kind == 1:
                segs = [(10, 60, "label"), (300 - 50 - jitter(), 300, "value")]
            elif kind == 2:
                segs = [(20, rng.choice([150, 300]), rng.choice(["• point", "1. one", "iv) four", "- dash", "-no", "(a) letter", "(a. no", "300. no", "x. y", "*"]))]
            elif kind == 3:
                segs = [(10, 14, "1."), (30, 200, "item text")]
            elif kind == 4:
                segs = [(rng.choice([10, 10, 80, 100]), rng.choice([300, 300, 210, 230]), rng.choice(["Title .... 12", "dots.....", "..... 3 ", "body"]))]
            elif kind == 5:
                segs = [(100, 300, "more words")] if k else [(20, 300, "• point")]  # a marker of 2 in 7 signs ends at 100
            else:
                x = rng.choice([10, 10, 10, 30, 14, 80])
                segs = [(x, rng.choice([300, 299, 300, 310 - x, 120]), rng.choice(["Some words", "more words", "an end.", 'said "x."', "Über", "1 more"]))]
            out.append((len(out), y, size, rng.random() < 0.1, rng.random() < 0.05, segs))
    return out


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(11)
    return [random_page(rng) for _ in range(120)]


def test_blocks_equal_plain_ones(spark, pages):
    rows = [(d, 0, d % 2, n, y, size, bold, label, float(x0), float(x1), text) for d, page in enumerate(pages) for n, y, size, bold, label, segs in page for x0, x1, text in segs]
    lines = B.lines_of_segments(spark.createDataFrame(rows, SEGMENT))
    described = {(r["doc"], r["line"]): r.asDict() for r in B.described(lines, F.lit(10.0)).collect()}
    got = {(r["doc"], r["line"]): (r["block"], r["kind"]) for r in B.blocks(lines, F.lit(10.0)).collect()}
    kinds = set()
    for d, page in enumerate(pages):
        own = [described[d, n] for n, *_ in page]
        expected = plain_blocks(own, 10.0, 1.2)
        assert [got[d, n] for n, *_ in page] == expected, d
        kinds |= {(k, sum(e == (b, k) for e in expected) > 1) for b, k in expected}
    assert {("table", True), ("tabs", False), ("leader", False), ("item", True), ("paragraph", True), ("paragraph", False)} <= kinds


def test_markers(spark):
    texts = ["• a", "•", "● x", "* x", "- x", "-x", "—y", "— y", "1. one", "1.one", "1) xy", "1) x", "(2) xy", "(2. xy", "200. xy", "201. xy", "0. zero", "iv. four", "IX) nine", "mcm. xy", "i. xy", "(c) xy", "Z. xy", "", "iiiiiii. x", "xlii.  answer", "abc. x", "✓ done"]
    got = [r["m"] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(B.list_marker(F.col("t")).alias("m")).collect()]
    assert [m and (m["kind"], m["glyph"], m["fmt"], m["start"]) for m in got] == [plain_marker(t) for t in texts]
    assert spark.createDataFrame([(None,)], "t string").select(B.list_marker(F.col("t")).alias("m")).first()["m"] is None


def test_tables_of_one_line_and_of_none(spark):
    schema = "k int, line int, y double, size double, edge double, x0 double, text string"
    own = spark.createDataFrame([(1, 1, 10.0, 10.0, 300.0, 10.0, "a"), (1, 1, 10.0, 10.0, 300.0, 100.0, "b"), (1, 2, 22.0, 10.0, 300.0, 12.0, "c"), (1, 2, 22.0, 10.0, 300.0, 101.0, "d"), (1, 3, 34.0, 10.0, 300.0, 101.0, "e"), (1, 4, 46.0, 10.0, 300.0, 10.0, "f"), (1, 5, 70.0, 10.0, 300.0, 5.0, "g")], schema)
    columns = B.table_columns(own, ["k"], "edge")
    assert {tuple(r) for r in columns.collect()} == {(1, 0, 5.0, 95.0), (1, 1, 100.0, 204.0)}
    cells = {(r["row"], r["col"]): r["text"] for r in B.table_cells(B.table_rows(own, columns, ["k"]), ["k"]).collect()}
    assert cells == {(0, 0): "a", (0, 1): "b", (1, 0): "c\nf", (1, 1): "d\ne", (2, 0): "g"}
    assert B.table_columns(own.limit(0), ["k"], "edge").count() == 0


def test_rows_of_tables_are_found_without_a_join(spark):
    """Lines of two pieces, a wrapped one and one that lacks the first column; a plan of one large exchange, by the table alone."""
    from tallyforge.operators import blocks as B

    pieces = [(1, 1, 0.0, 10.0), (1, 1, 0.0, 100.0), (1, 2, 12.0, 10.0), (1, 3, 40.0, 10.0), (1, 3, 40.0, 100.0), (1, 4, 80.0, 100.0), (2, 1, 0.0, 10.0)]
    own = spark.createDataFrame(pieces, "doc int, line int, y double, x0 double").selectExpr("*", "10D AS size", "'t' AS text")
    starts = spark.createDataFrame([(d, i, x) for d in (1, 2) for i, x in enumerate((10.0, 100.0))], "doc int, col int, start double")
    rows = B.table_rows(own, starts, ["doc"])
    assert sorted((r.doc, r.line, r.col, r.row) for r in rows.collect()) == [(1, 1, 0, 0), (1, 1, 1, 0), (1, 2, 0, 0), (1, 3, 0, 1), (1, 3, 1, 1), (1, 4, 1, 1), (2, 1, 0, 0)]
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_edges_of_text_are_found_without_a_join(spark):
    from pyspark.sql import functions as F

    from tallyforge.operators import blocks as B

    own = spark.createDataFrame([(1, 0, 0, i, 12.0 * i, 10.0, False, False, 10.0, 100.0 + i, "x") for i in range(41)], "doc int, page int, part int, line int, y double, size double, bold boolean, label boolean, x0 double, x1 double, text string")
    lines = B.lines_of_segments(own)
    told = B.described(lines, F.lit(10.0))
    assert {(r.left, r.edge) for r in told.collect()} == {(r.left, r.edge) for r in B.text_boxes(lines).collect()} == {(10.0, 138.0)}
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()
