"""Lines, tables and pages against plain versions and literal cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import flow as W

RUN = "doc int, para int, seq int, kind string, text string, label boolean, font string, size double, caps boolean, width double"
PARA = "doc int, para int, width double, left double, right double, first double, stops array<struct<pos:double,align:string>>, step double, align string"
WIDTH = {" ": 0.25, "i": 0.25, "a": 0.5, "A": 0.75, "m": 1.0, ".": 0.25}


def measure(text: str, size: float) -> float:
    return sum(WIDTH.get(c, 0.5) for c in text) * size


def plain_lines(runs: list[tuple], para: tuple) -> list[tuple[str, float, float, bool]]:
    """(text, x of each visible piece..., last) line by line: pieces are tried one by one on a list of what fits."""
    _, _, width, left, right, first, stops, step, _ = para
    edge, lines, atoms = width - right, [], []
    for _, _, _, kind, text, label, _, size, caps, w in sorted(runs, key=lambda r: r[2]):
        if kind == "text":
            atoms += [("space" if p.isspace() else "word", re.sub(r"\s", " ", p), measure(re.sub(r"\s", " ", p), size), label, size) for p in re.findall(r"\s+|\S+", (text or "").upper() if caps else text or "")]
        else:
            atoms.append((kind, text or "", {"image": w, "field": measure(text or "", size)}.get(kind, 0.0), label, size))
    line, begin, x = [], left + first, left + first

    def close(last: bool) -> None:
        nonlocal line, begin, x
        while line and line[-1][0] == "space":
            line.pop()
        lines.append([tuple((t, round(at, 6)) for kind, t, at in line), last])
        line, begin, x = [], left, left

    for n, (kind, text, w, label, size) in enumerate(atoms):
        if kind == "break":
            close(True)
        elif kind == "tab":
            ahead = 0.0
            for other in atoms[n + 1 :]:
                if other[0] in ("tab", "break"):
                    break
                ahead += other[2]
            at, align = (left, "left") if (label or first < 0) and x < left - 0.01 else next(((p, a) for p, a in sorted(stops or []) if p > x + 0.01), (((x // step) + 1) * step, "left"))
            to = max(x, at - ahead) if align in ("right", "decimal") else max(x, at - ahead / 2) if align == "center" else at
            if label and x > left - 0.01:
                to = x + measure(" ", size)
            if to > edge + 0.5 and line:
                close(False)
            else:
                line.append(("tab", align, x))
                x = max(x, to)
        elif kind == "space":
            line.append((kind, text, x))
            x += w
        else:
            if x + w > edge + 0.01 and any(k != "space" for k, *_ in line):
                close(False)
            if kind == "word" and w > edge - begin + 0.01:
                while text:
                    k = max([1] + [k for k in range(1, len(text) + 1) if x + measure(text[:k], size) <= edge])
                    line.append((kind, text[:k], x))
                    x += measure(text[:k], size)
                    text = text[k:]
                    if text:
                        close(False)
            else:
                line.append((kind, text, x))
                x += w
    if line or not lines:
        close(True)
    else:
        lines[-1][1] = True
    return [(text, last) for text, last in lines]


@pytest.fixture(scope="module")
def paragraphs():
    rng = random.Random(9)
    runs, paras = [], []
    for d in range(150):
        stops = rng.sample([(30.0, "left"), (55.0, "right"), (60.0, "center"), (80.0, "decimal"), (95.0, "left"), (99.0, "right")], rng.randint(0, 3))
        paras.append((d % 7, d, rng.choice([40.0, 100.0, 100.0]), rng.choice([0.0, 0.0, 20.0]), rng.choice([0.0, 5.0]), rng.choice([0.0, 10.0, -12.0]), stops or None, rng.choice([36.0, 10.0]), rng.choice(["left", "right", "center", "both", None])))
        for seq in range(rng.randint(0, 9)):
            kind = rng.choice(["text", "text", "text", "tab", "break", "image", "field"])
            words = ["".join(rng.choice("aim.X") for _ in range(rng.choice([1, 2, 3, 5, 30]))) for _ in range(rng.randint(1, 8))]
            text = {"text": rng.choice([" ", ""]) + rng.choice([" ", "  ", "\t "]).join(words) + rng.choice(["", " "]), "break": rng.choice(["line", "page", "column"]), "field": "12"}.get(kind)
            runs.append((d % 7, d, seq, kind, text, seq < 2 and d % 3 == 0, "f", rng.choice([8.0, 10.0]), rng.random() < 0.2, 15.0 if kind == "image" else None))
    runs.append((0, 0, 50, "text", "long words " * 3000, False, "f", 10.0, False, None))
    return runs, paras


def test_lines_equal_plain_ones(spark, paragraphs):
    runs, paras = paragraphs
    widths = spark.createDataFrame([("f", s, w) for s, w in WIDTH.items()], "font string, sign string, w double")
    paras_df = spark.createDataFrame([(*p[:6], p[6] and [{"pos": a, "align": b} for a, b in p[6]], *p[7:]) for p in paras], PARA)
    out = W.broken_lines(W.atoms(spark.createDataFrame(runs, RUN).repartition(4), widths), paras_df).cache()
    got: dict = {}
    for r in sorted(out.collect(), key=lambda r: (r["doc"], r["para"], r["line"], r["kind"] == "end", r["seq"] or 0, r["at"] or 0, r["piece"] or 0)):
        line = got.setdefault((r["doc"], r["para"]), {}).setdefault(r["line"], [[], None])
        if r["kind"] == "end":
            line[1] = r["last"]
        else:
            line[0].append((r["text"], round(r["x"], 6)))
    for p in paras:
        own = got[p[:2]]
        assert [(tuple(own[k][0]), own[k][1]) for k in sorted(own)] == plain_lines([r for r in runs if r[:2] == p[:2]], p), p
    ends = {(r["doc"], r["para"], r["line"]): r for r in out.filter("kind = 'end'").collect()}
    moved: dict = {}
    for r in W.aligned(out, paras_df).collect():
        moved.setdefault((r["doc"], r["para"], r["line"]), []).append(r)
    seen = set()
    for p in paras:
        for key, rows in ((k, sorted(v, key=lambda r: (r["seq"], r["at"], r["piece"]))) for k, v in moved.items() if k[:2] == p[:2]):
            begin, room = ends[key]["x"], ends[key]["w"]
            used = sum(r["w"] for r in rows)
            if any(r["kind"] == "tab" for r in rows):
                continue
            seen.add(p[-1])
            gaps = sum(r["kind"] == "space" for r in rows)
            if p[-1] == "right":
                assert rows[-1]["x"] + rows[-1]["w"] == pytest.approx(begin + room)
            elif p[-1] == "center":
                assert rows[0]["x"] - begin == pytest.approx((room - used) / 2)
            elif p[-1] == "both" and not ends[key]["last"] and gaps and room > used:
                assert rows[0]["x"] == pytest.approx(begin) and rows[-1]["x"] + rows[-1]["w"] == pytest.approx(begin + room)
            else:
                assert rows[0]["x"] == pytest.approx(begin)
    assert {"left", "right", "center", "both"} <= seen


def test_line_heights(spark):
    lines = spark.createDataFrame([(1, 1, 0, 0, "word", None), (1, 1, 0, 1, "image", None), (1, 1, 0, None, "end", None), (1, 1, 1, 0, "word", None), (1, 1, 1, None, "end", "page"), (1, 2, 0, None, "end", "line"), (1, 3, 0, 0, "word", None), (1, 3, 0, None, "end", None)], "doc int, para int, line int, seq int, kind string, text string")
    fonts = spark.createDataFrame([(1, 1, 0, "Arial", 10.0, None), (1, 1, 1, "Arial", 10.0, 30.0), (1, 3, 0, "Courier New", 10.0, None)], "doc int, para int, seq int, font string, size double, image double")
    paras = spark.createDataFrame([(1, 1, None, 2.0, "Arial", 10.0), (1, 2, "exact", 9.0, "Calibri", 20.0), (1, 3, "atLeast", 11.0, "Arial", 10.0)], "doc int, para int, rule string, value double, font string, size double")
    got = {(r["para"], r["line"]): (round(r["height"], 4), round(r["baseline"], 4), r["brk"]) for r in W.line_heights(lines, fonts, paras).collect()}
    assert got == {(1, 0): (32.45, 30.33, None), (1, 1): (23.0, 20.88, "page"), (2, 0): (9.0, 3.62, None), (3, 0): (11.33, 8.33, None)}


def plain_boxes(grid: list[float], indent: float, align: str, avail: float, cells: dict, rules: dict) -> dict:
    """cells: row -> [(span, merge, content)]; margins of 1 above, below and beside."""
    shrink = (avail - indent) / sum(grid) if sum(grid) > avail - indent + 1 else 1.0
    edges = [sum(grid[:k]) * shrink for k in range(len(grid) + 1)]
    start = {"center": (avail - edges[-1]) / 2, "right": avail - edges[-1]}.get(align, indent)
    cols = {(r, k): sum(c[0] for c in own[:k]) for r, own in cells.items() for k in range(len(own))}
    heights = {}
    for r, own in cells.items():
        h = max([0.0] + [2 + (0 if merge == "continue" else content) for _, merge, content in own if merge != "restart"])
        rule, value = rules[r]
        heights[r] = max(1.0, value if rule == "exact" else max(h, value or 0.0))

    def end(r: int, k: int) -> int:
        while any(cols[r + 1, j] == cols[first, k] and m == "continue" for j, (_, m, _) in enumerate(cells.get(r + 1, []))):
            r += 1
        return r

    ends = {}
    for first, own in cells.items():
        for k, (_, merge, content) in enumerate(own):
            ends[first, k] = end(first, k) if merge == "restart" else first
            if merge == "restart":
                heights[ends[first, k]] += max(0.0, content + 2 - sum(heights[r] for r in range(first, ends[first, k] + 1)))
    out = {}
    for r, own in cells.items():
        for k, (span, _, _) in enumerate(own):
            at = min(cols[r, k], len(grid))
            out[r, k] = (cols[r, k], edges[at] + start, edges[min(cols[r, k] + span, len(grid))] - edges[at], sum(heights[q] for q in heights if q < r), sum(heights[q] for q in range(r, ends[r, k] + 1)))
    return out


def test_table_boxes_equal_plain_ones(spark):
    rng = random.Random(10)
    tables, cells, rows, expected = [], [], [], {}
    for t in range(80):
        grid = [rng.choice([20.0, 40.0, 90.0]) for _ in range(rng.randint(1, 4))]
        align, indent = rng.choice(["left", "center", "right", None]), rng.choice([0.0, 12.0])
        tables.append((1, t, grid, indent, align, 200.0, 1.0, 1.0, 1.0, 1.0))
        own = {r: [(rng.choice([1, 1, 2]), rng.choice([None, None, "restart", "continue", "continue"]), rng.choice([3.0, 10.0, 50.0])) for _ in range(rng.randint(1, 3))] for r in range(rng.randint(1, 5))}
        rules = {r: rng.choice([(None, None), ("exact", 15.0), ("atLeast", 30.0)]) for r in own}
        cells += [(1, t, r, k, *c) for r, x in own.items() for k, c in enumerate(x)]
        rows += [(1, t, r, *rules[r]) for r in own]
        expected |= {(t, *k): v for k, v in plain_boxes(grid, indent, align, 200.0, own, rules).items()}
    got = W.table_boxes(spark.createDataFrame(tables, "doc int, table int, grid array<double>, indent double, align string, avail double, left double, right double, top double, bottom double"), spark.createDataFrame(cells, "doc int, table int, row int, cell int, span int, merge string, content double"), spark.createDataFrame(rows, "doc int, table int, row int, rule string, value double"))
    found = {(r["table"], r["row"], r["cell"]): (r["col"], r["x"], r["w"], r["y"], r["h"]) for r in got.collect()}
    assert found.keys() == expected.keys()
    for k, v in expected.items():
        assert found[k] == pytest.approx(v), k


def test_table_boxes_over_many_partitions(spark, monkeypatch):
    from tallyforge.operators.scratch import dealt
    from tallyforge.plans import converted

    whole = converted.table_boxes(spark, "/root/testdata/sf0.001")
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [max(__plain") == 1 and plan.count("Window [") <= 4  # a chain of them for each use of the cells, before
    monkeypatch.setattr(W, "dealt", lambda df, keys, rows: dealt(df, keys, rows, 50))
    test_table_boxes_equal_plain_ones(spark)
    assert not converted.table_boxes(spark, "/root/testdata/sf0.001").exceptAll(whole).count()


def test_rules_of_keeping_and_pages(spark):
    blocks = [(1, 0, "para", 5.0, 6.0, False, True, False, False, "h"), (1, 1, "para", 4.0, 2.0, True, False, False, True, "b"), (1, 2, "para", 4.0, 2.0, False, False, True, True, "b"), (1, 3, "para", 1.0, 0.0, False, True, False, False, "b"), (1, 4, "table", 0.0, 0.0, False, False, False, False, None)]
    lines = [(1, b, n, h, None) for b, hs in enumerate([[10.0], [10.0, 10.0], [10.0, 10.0], [10.0], [15.0, 15.0]]) for n, h in enumerate(hs)]
    items = W.keep_rules(spark.createDataFrame(lines, "doc int, block int, line int, height double, brk string"), spark.createDataFrame(blocks, "doc int, block int, kind string, before double, after double, keep_lines boolean, keep_next boolean, break_before boolean, contextual boolean, style string"))
    got = {(r["block"], r["line"]): (r["before"], r["need"], r["after"], r["fresh"]) for r in items.collect()}
    assert got == {(0, 0): (5.0, 24.0, 6.0, False), (1, 0): (4.0, 20.0, 0.0, False), (1, 1): (None, None, 2.0, False), (2, 0): (-2.0, 10.0, 0.0, True), (2, 1): (None, None, 2.0, False), (3, 0): (1.0, 30.0, 0.0, False), (4, 0): (None, None, 0.0, False), (4, 1): (None, None, 0.0, False)}
    header = F.when(F.col("block") == 4, F.col("line") == 0)
    sections = spark.createDataFrame([(1, 0, 2, 0.0, 40.0, False)], "doc int, section int, cols int, top double, bottom double, continuous boolean")
    placed = W.flowed(items.withColumn("section", F.lit(0)).withColumn("header", header), sections)
    at = {(r["block"], r["line"]): (r["page"], r["col"], r["y"], r["repeated"]) for r in placed.collect()}
    assert at == {(0, 0): (1, 0, 0.0, 0.0), (1, 0): (1, 0, 20.0, 0.0), (1, 1): (1, 0, 30.0, 0.0), (2, 0): (2, 0, 0.0, 0.0), (2, 1): (2, 0, 10.0, 0.0), (3, 0): (2, 1, 0.0, 0.0), (4, 0): (2, 1, 10.0, 0.0), (4, 1): (2, 1, 25.0, 0.0)}
    longer = spark.createDataFrame([(1, 0, 0, n, 15.0, None, None, 0.0, False, None, n == 0) for n in range(5)], "doc int, section int, block int, line int, height double, before double, need double, after double, fresh boolean, brk string, header boolean")
    at = [(r["page"], r["col"], r["y"], r["repeated"]) for r in W.flowed(longer, sections).orderBy("line").collect()]
    assert at == [(1, 0, 0.0, 0.0), (1, 0, 15.0, 0.0), (1, 1, 15.0, 15.0), (2, 0, 15.0, 15.0), (2, 1, 15.0, 15.0)]


def test_aligned_lines_are_broken_once(spark):
    from tallyforge.plans import converted

    plan = converted.broken_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
