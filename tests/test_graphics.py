"""Shapes, rotated boxes and glyph colours on literal cases, and shapes of all kinds against a plain version."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import graphics as D

OPERATOR = "doc int, page int, seq int, op string, args array<double>, text string"


def plain_shapes(rows: list[tuple]) -> list[tuple]:
    """Page by page: matrices are multiplied out from the start for each painted path."""
    out = []
    for page in sorted({r[:2] for r in rows}):
        own = sorted((r for r in rows if r[:2] == page), key=lambda r: r[2])
        stack, path = [[]], []
        for _, _, seq, op, args, text in own:
            if op == "save":
                stack.append(list(stack[-1]))
            elif op == "restore" and len(stack) > 1:
                stack.pop()
            elif op in ("transform", "width", "fill", "stroke"):
                stack[-1].append((op, args, text))
            elif op in ("move", "line", "curve", "quadratic", "close"):
                path.append((op, args, [a for k, a, _ in stack[-1] if k == "transform"]))
            elif op.startswith("paint"):
                at, subs = lambda x, y, ms: (x, y) if not ms else at(ms[-1][0] * x + ms[-1][2] * y + ms[-1][4], ms[-1][1] * x + ms[-1][3] * y + ms[-1][5], ms[:-1]), []
                for kind, v, ms in path:
                    pts = [at(v[k], v[k + 1], ms) for k in range(0, len(v or []), 2)]
                    if kind == "move":
                        subs.append([pts, False, False])
                    elif kind == "close":
                        subs[-1][2] = True
                    else:
                        if kind == "quadratic":
                            (cx, cy), (x, y), (lx, ly) = *pts, subs[-1][0][-1]
                            pts = [((lx + 2 * cx) / 3, (ly + 2 * cy) / 3), ((x + 2 * cx) / 3, (y + 2 * cy) / 3), (x, y)]
                        subs[-1][0] += pts
                        subs[-1][1] |= kind != "line"
                path = []
                fill, stroke = "fill" in op, "stroke" in op
                if not (fill or stroke):
                    continue
                last = lambda k, default: next((x for kind, a, t in reversed(stack[-1]) if kind == k for x in [a[0] if k == "width" else t]), default)
                scale = 1.0
                for k, a, _ in stack[-1]:
                    scale *= abs(a[0] * a[3] - a[1] * a[2]) ** 0.5 if k == "transform" else 1.0
                lw, n, rest = max(0.25, last("width", 1.0) * (scale or 1.0)), 0, []
                color = last("fill" if fill else "stroke", "000000")
                for pts, curved, closed in subs:
                    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
                    x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
                    upright = not curved and all(min(abs(a - c), abs(b - d)) < 0.3 for (a, b), (c, d) in zip(pts, pts[1:]))
                    five = len(pts) == 5 and max(abs(pts[0][0] - pts[4][0]), abs(pts[0][1] - pts[4][1])) < 0.3
                    four = pts[:4] if five else pts
                    apart = lambda v: len([1 for k, a in enumerate(v) if not any(abs(a - b) < 0.3 for b in v[:k])])
                    if upright and len(pts) == 2 and stroke:
                        box = (x0, y0 - lw / 2, x1 - x0, lw) if y1 - y0 < 0.3 else (x0 - lw / 2, y0, lw, y1 - y0)
                        out.append((*page, seq, n, "line", *box, True, False, 0.0, last("stroke", "000000")))
                        n += 1
                    elif upright and len(four) == 4 and apart([p[0] for p in four]) == apart([p[1] for p in four]) == 2 and x1 - x0 > 0.1 and y1 - y0 > 0.1 and (closed or len(pts) == 5 or fill):
                        out.append((*page, seq, n, "rect", x0, y0, x1 - x0, y1 - y0, fill, stroke, lw if stroke else 0.0, color))
                        n += 1
                    else:
                        rest += pts
                if rest:
                    xs, ys = [p[0] for p in rest], [p[1] for p in rest]
                    out.append((*page, seq, n, "path", min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys), fill, stroke, lw if stroke else 0.0, color))
    return out


def test_shapes_equal_plain_ones(spark):
    rng, rows = random.Random(12), []
    for page in range(60):
        for _ in range(40):
            kind = rng.randrange(9)
            n = lambda: rng.choice([0.0, 0.1, 10.0, 10.2, 30.0, -5.0])
            ops = {
                0: [("save", None, None)],
                1: [("restore", None, None)],
                2: [("transform", rng.choice([[1, 0, 0, 1, 5, 5], [0, 1, -1, 0, 0, 0], [2, 0, 0, 3, 1, 1], [1, 1, -1, 1, 0, 0], [0, 0, 0, 0, 1, 1]]), None)],
                3: [(rng.choice(["fill", "stroke"]), None, rng.choice(["FF0000", "00FF00"])), ("width", [rng.choice([0.0, 2.0])], None)],
                4: [("move", [n(), n()], None), ("line", [n(), n()], None)],
                5: [("move", [0, 0], None), ("line", [w := n(), 0], None), ("line", [w, h := n()], None), ("line", [0, h], None)] + rng.choice([[], [("close", None, None)], [("line", [0, 0], None)]]),
                6: [("move", [n(), n()], None), ("curve", [n() for _ in range(6)], None), ("quadratic", [n() for _ in range(4)], None)],
                7: [("odd", None, None)],
            }.get(kind, [])
            if kind >= 4:
                ops += [(rng.choice(["paint:stroke", "paint:fill", "paint:fill+stroke", "paint"]), None, None)] if rng.random() < 0.8 else []
            rows += [(page % 3, page, len(rows) + k, op, args and [float(x) for x in args], text) for k, (op, args, text) in enumerate(ops)]
    got = sorted(tuple(r) for r in D.shapes(spark.createDataFrame(rows, OPERATOR).repartition(4)).collect())
    expected = sorted(plain_shapes(rows))
    assert {r[4] for r in expected} == {"line", "rect", "path"} and len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[:5] == b[:5] and a[9:11] == b[9:11] and a[12] == b[12] and a[5:9] == pytest.approx(b[5:9]) and a[11] == pytest.approx(b[11])
    assert D.shapes(spark.createDataFrame([], OPERATOR)).count() == 0


def test_colors_and_boxes(spark):
    pixels = [(1, k, 20, 20, 20) for k in range(3)] + [(2, 0, 130, 130, 130), (2, 1, 180, 182, 181), (2, 2, 255, 255, 255)] + [(3, 0, 200, 10, 10), (3, 1, 210, 20, 5), (3, 2, 10, 200, 10), (3, 3, 250, 250, 250)] + [(4, 0, 250, 250, 250)]
    got = {r["g"]: r["color"] for r in D.glyph_colors(spark.createDataFrame(pixels, "g int, seq int, r int, g_ int, b int").toDF("key", "seq", "r", "g", "b"), ["key"]).withColumnRenamed("key", "g").collect()}
    assert got == {1: None, 2: "828282", 3: "D01010"}
    one = spark.createDataFrame([(270.0,), (-268.0,), (0.0,), (450.0,)], "a double").select(D.rotated_box(F.lit(100.0), F.lit(200.0), F.lit(50.0), F.lit(10.0), F.col("a"), F.lit("Arial")).alias("b")).collect()
    assert [r["b"]["direction"] for r in one] == ["up", "down", "level", "down"]
    up, _, level, _ = (r["b"] for r in one)
    assert (up["w"], up["h"], up["y"]) == pytest.approx((10.6, 59.0, 141.0)) and (level["x"], level["y"], level["w"], level["turn"]) == (pytest.approx(100.0), pytest.approx(200 - 3.18 - 5.3), pytest.approx(59.0), 0)
