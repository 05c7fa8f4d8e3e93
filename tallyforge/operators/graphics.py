"""Drawing on a page: shapes out of a stream of drawing operators, boxes of rotated text, colours of glyphs out of their pixels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flow import font_metrics
from .layout import PAGE

#: How near coordinates of one line lie, the thinnest stroke, and how much longer rotated text is taken to be.
FLAT, THIN, LONGER = 0.3, 0.25, 1.08
#: Lightness from which a pixel is background, the spread of channels up to which it is neutral, the darkest
#: pixel from which text counts as grey, and the bits that colours are told apart by.
BACKGROUND, NEUTRAL, GREY, BITS = 215.0, 40, 110.0, 3

SHAPES = "seq {seq}, part int, kind string, x double, y double, w double, h double, filled boolean, stroked boolean, lw double, color string"


def combined(m: tuple, n: tuple) -> tuple:
    """The affine map that applies n first, then m; (a, b, c, d, e, f) takes (x, y) to (ax + cy + e, bx + dy + f)."""
    a, b, c, d, e, f = m
    return (a * n[0] + c * n[1], b * n[0] + d * n[1], a * n[2] + c * n[3], b * n[2] + d * n[3], a * n[4] + c * n[5] + e, b * n[4] + d * n[5] + f)


class _Pen:
    """What a page's operators have set up so far, and the path in hand: subpaths of (curved, points), points in page coordinates."""

    def __init__(self):
        self.matrix, self.width, self.ink, self.saved = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), 1.0, {"fill": "000000", "stroke": "000000"}, []
        self.subs: list[dict] = []

    def at(self, x: float, y: float) -> tuple[float, float]:
        a, b, c, d, e, f = self.matrix
        return a * x + c * y + e, b * x + d * y + f

    def do(self, op: str, v: list[float], text: str | None) -> list[tuple]:
        if op == "save":
            self.saved.append((self.matrix, self.width, dict(self.ink)))
        elif op == "restore":
            if self.saved:
                self.matrix, self.width, self.ink = self.saved.pop()
        elif op == "transform":
            self.matrix = combined(self.matrix, tuple(v))
        elif op == "width":
            self.width = v[0]
        elif op in self.ink:
            self.ink[op] = text or "000000"
        elif op == "move" or op in ("line", "curve", "quadratic") and not self.subs:
            self.subs.append({"points": [self.at(*v[-2:])], "curved": op in ("curve", "quadratic"), "closed": False})
        elif op in ("line", "curve", "quadratic"):
            own = self.subs[-1]
            own["curved"] |= op != "line"
            points = [self.at(*v[k : k + 2]) for k in range(0, len(v), 2)]
            if op == "quadratic":  # as a cubic one, whose control points lie two thirds of the way to its own
                (cx, cy), (x, y) = points
                points = [(p + 2 / 3 * (cx - p), q + 2 / 3 * (cy - q)) for p, q in (own["points"][-1], (x, y))] + [(x, y)]
            own["points"] += points
        elif op == "close" and self.subs:
            self.subs[-1]["closed"] = True
        elif op.startswith("paint"):
            found = self.shapes("fill" in op, "stroke" in op)
            self.subs = []
            return found
        return []

    def shapes(self, fill: bool, stroke: bool) -> list[tuple]:
        """Rows of SHAPES without their place: each straight stroke and upright rectangle, and what is left as one path."""
        if not (fill or stroke):
            return []
        a, b, c, d, _, _ = self.matrix
        lw = max(THIN, self.width * (abs(a * d - b * c) ** 0.5 or 1.0))
        out, rest = [], []
        for own in self.subs:
            points = own["points"]
            xs, ys = zip(*points)
            x, y, w, h = min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)
            upright = not own["curved"] and all(abs(p[0] - q[0]) < FLAT or abs(p[1] - q[1]) < FLAT for p, q in zip(points, points[1:]))
            back = len(points) == 5 and all(abs(p - q) < FLAT for p, q in zip(points[0], points[4]))
            corners = points[:4] if back else points
            if upright and stroke and len(points) == 2:
                flat = h < FLAT
                out.append(("line", x - (0 if flat else lw / 2), y - (lw / 2 if flat else 0), w if flat else lw, lw if flat else h, True, False, 0.0, self.ink["stroke"]))
            elif upright and len(corners) == 4 and all(_places(k) == 2 for k in zip(*corners)) and min(w, h) > 0.1 and (own["closed"] or back or len(points) == 5 or fill):
                out.append(("rect", x, y, w, h, fill, stroke, lw if stroke else 0.0, self.ink["fill" if fill else "stroke"]))
            else:
                rest += points
        if rest:
            xs, ys = zip(*rest)
            out.append(("path", min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys), fill, stroke, lw if stroke else 0.0, self.ink["fill" if fill else "stroke"]))
        return out


def _places(values: tuple) -> int:
    """How many of the values have none before them that is nearly the same."""
    return sum(all(abs(v - u) >= FLAT for u in values[:k]) for k, v in enumerate(values))


def shapes(operators: DataFrame) -> DataFrame:
    """(doc, page, seq, part, kind, x, y, w, h, filled, stroked, lw, color) of what operators (doc, page, seq, op, args, text) paint.

    op: save, restore, transform (six numbers), width, fill and stroke (a colour in text), move, line, curve, quadratic (points),
    close, and paint followed by fill or stroke or both, as in paint:fill+stroke; paint alone (a clip) paints nothing. kind is
    line (a straight upright stroke, as thick as it is), rect or path. Matrices stack, so a task walks over a page's
    operators in order, with the pen in hand; unknown operators do nothing, restore without save neither.
    """
    kinds = {f.name: f.dataType.simpleString() for f in operators.schema.fields}
    names = [*PAGE, *(x.split()[0] for x in SHAPES.split(", "))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, pen = object(), _Pen()
        for batch in batches:
            made = []
            for doc, number, seq, op, args, text in zip(*(c.to_pylist() for c in batch.columns)):
                if page != (doc, number):
                    page, pen = (doc, number), _Pen()
                made += [(doc, number, seq, k, *s) for k, s in enumerate(pen.do(op or "", args or [], text))]
            types = [*(batch.schema.field(k).type for k in range(3)), pa.int32(), pa.string(), *[pa.float64()] * 4, pa.bool_(), pa.bool_(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * len(types), types)], names)

    ordered = operators.select(*PAGE, "seq", "op", F.col("args").cast("array<double>"), "text").repartition(*PAGE).sortWithinPartitions(*PAGE, "seq")
    return ordered.mapInArrow(walk, f"doc {kinds['doc']}, page {kinds['page']}, " + SHAPES.format(seq=kinds["seq"]))


def rotated_box(x: Column, y: Column, length: Column, size: Column, angle: Column, font: Column) -> Column:
    """struct(x, y, w, h, direction, turn): the box of a text that starts at (x, y) and runs at an angle, in degrees.

    Text that reads upwards or downwards has an upright box of its own; other angles have a level box about the text's middle
    and are turned by 60000ths of a degree. A line is five descents high, which puts its baseline at four fifths.
    """
    descent = font_metrics(font)["descent"] * size
    line, run = descent * 5, length * LONGER + size * 0.5
    degrees = F.pmod(angle, F.lit(360.0))
    a = F.radians(angle)
    across = (descent * 2 - line) / 2
    middle = (x + run / 2 * F.cos(a) - across * F.sin(a), y + run / 2 * F.sin(a) + across * F.cos(a))
    box = lambda bx, by, w, h, direction, turn: F.struct(bx.alias("x"), by.alias("y"), w.alias("w"), h.alias("h"), F.lit(direction).alias("direction"), turn.cast("int").alias("turn"))
    up = box(x - line + descent, y - run, line, run, "up", F.lit(0))
    down = box(x - descent, y, line, run, "down", F.lit(0))
    level = box(middle[0] - run / 2, middle[1] - line / 2, run, line, "level", F.floor(degrees * 60000 + 0.5))
    return F.when(F.abs(degrees - 270) < 3, up).when(F.abs(degrees - 90) < 3, down).otherwise(level)


def glyph_colors(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, color): six hex digits of each glyph whose pixels (keys, seq, r, g, b) show one; null for black text.

    Pixels weigh by how dark they are, and near white ones don't count. If neutral ones weigh as much as coloured ones, the
    text is grey of its darkest pixel, if that is light enough, else black; else the coloured pixels that agree in their
    upper bits and weigh most give the middle of their range, of equal ones the first by seq. Sums are by glyph and bits, so
    a glyph's pixels needn't meet.
    """
    r, g, b = (F.col(c).cast("int") for c in "rgb")
    light = F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b
    dull = F.greatest(r, g, b) - F.least(r, g, b) < NEUTRAL
    shift = 8 - BITS
    bucket = F.when(~dull, F.shiftright(r, shift) * (1 << 2 * BITS) + F.shiftright(g, shift) * (1 << BITS) + F.shiftright(b, shift)).otherwise(-1)
    rows = pixels.withColumn("__light", light).filter(F.col("__light") <= BACKGROUND).withColumn("__bucket", bucket)
    sums = rows.groupBy(*keys, "__bucket").agg(F.sum(255 - F.col("__light")).alias("__w"), F.min("seq").alias("__first"), F.min("__light").alias("__dark"))
    neutral = F.coalesce(F.sum(F.when(F.col("__bucket") < 0, F.col("__w"))), F.lit(0.0))
    colored = F.coalesce(F.sum(F.when(F.col("__bucket") >= 0, F.col("__w"))), F.lit(0.0))
    best = F.max_by(F.when(F.col("__bucket") >= 0, F.col("__bucket")), F.when(F.col("__bucket") >= 0, F.struct(F.col("__w"), -F.col("__first"))))
    found = sums.groupBy(*keys).agg(neutral.alias("__n"), colored.alias("__c"), best.alias("__best"), F.min(F.when(F.col("__bucket") < 0, F.col("__dark"))).alias("__dark"))
    two = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    grey = two(F.floor(F.col("__dark") + 0.5))
    middle = lambda k: two(F.shiftright("__best", k * BITS).bitwiseAND(F.lit((1 << BITS) - 1)) * (1 << shift) + (1 << shift - 1))
    color = F.when(F.col("__n") < F.col("__c"), F.concat(middle(2), middle(1), middle(0))).when(F.col("__dark") >= GREY, F.concat(grey, grey, grey))
    return found.select(*keys, color.alias("color"))
