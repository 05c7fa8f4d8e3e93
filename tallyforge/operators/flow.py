"""Flow of text into lines, tables and pages: atoms with widths, tab stops, line breaking, table geometry, columns of pages.

Widths come from a table of signs, so no font is opened. What hangs on neighbours only is expressions and windows; where a
line or a page ends depends on all before it, so a task walks over sorted rows with one line or one column in hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import font_family
from .scratch import dealt, stored

#: Ascent, descent and height of a line of the families that stand in for fonts, for a size of 1.
METRICS = {"Carlito": (0.952, 0.269, 1.2207), "Caladea": (0.95, 0.222, 1.172), "Tinos": (0.891, 0.216, 1.15), "Arimo": (0.905, 0.212, 1.15), "Cousine": (0.833, 0.3, 1.133)}

PARA = ["doc", "para"]


def font_metrics(name: Column) -> Column:
    """struct(ascent, descent, line) of the family that stands in for a font, for a size of 1."""
    known = F.create_map(*[x for family, m in METRICS.items() for x in (F.lit(family), F.struct(*[F.lit(v).alias(n) for v, n in zip(m, ("ascent", "descent", "line"))]))])
    return known[font_family(name)]


def atoms(runs: DataFrame, widths: DataFrame, most_fonts: int = 10_000, unknown: float = 0.5) -> DataFrame:
    """Words, spaces, tabs, breaks, images and fields of runs (doc, para, seq, kind, text, font, size, caps, width, ...), with `at`,
    their place in the run, and their width w and the widths of their letters.

    kind is text, tab, break (text: line, page or column), image (of `width`) or field. widths: (font, sign, w) for a size of
    1; signs that it lacks are `unknown` wide. It goes along as one map a font, by broadcast if a count shows few fonts.
    """
    maps = widths.groupBy("font").agg(F.map_from_entries(F.collect_list(F.struct("sign", "w"))).alias("__signs"))
    side = F.broadcast(maps) if maps.limit(most_fonts + 1).count() <= most_fonts else maps
    rows = runs.withColumn("__text", F.when(F.col("caps"), F.upper("text")).otherwise(F.col("text"))).join(side, "font", "left")
    pieces = F.when(F.col("kind") == "text", F.regexp_extract_all("__text", F.lit(r"(\s+|\S+)"), 1)).otherwise(F.array(F.coalesce("__text", F.lit(""))))
    out = rows.select("*", F.posexplode(pieces).alias("at", "__piece"))
    space = (F.col("kind") == "text") & F.col("__piece").rlike(r"^\s")
    kind = F.when(space, "space").when(F.col("kind") == "text", "word").otherwise(F.col("kind"))
    out = out.withColumn("__kind", kind).withColumn("__piece", F.when(space, F.regexp_replace("__piece", r"\s", " ")).otherwise(F.col("__piece")))
    wide = lambda c: F.coalesce(F.try_element_at("__signs", c), F.lit(unknown)) * F.col("size")
    out = out.withColumn("letters", F.when(F.col("__kind").isin("word", "space", "field"), F.transform(F.filter(F.split("__piece", ""), lambda c: c != ""), wide)))
    w = F.when(F.col("__kind") == "image", F.col("width").cast("double")).when(F.col("letters").isNotNull(), F.aggregate("letters", F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
    return out.withColumn("w", F.coalesce(w, F.lit(0.0))).withColumn("blank", wide(F.lit(" "))).withColumn("kind", F.col("__kind")).withColumn("text", F.col("__piece")).drop("__text", "__signs", "__piece", "__kind")


def tab_stop(x: float, left: float, hangs: bool, stops: list[dict], step: float) -> tuple[float, str]:
    """(place, align) of the next stop after x: the indent where the first line hangs before it, one of the sorted stops, else the next
    multiple of the step."""
    if hangs and x < left - 0.01:
        return left, "left"
    own = next(((s["pos"], s["align"]) for s in stops if s["pos"] > x + 0.01), None)
    return own or ((x // step + 1) * step, "left")


class _Paragraph:
    """The line in hand of a paragraph; `closed` gets the pieces of finished lines, and a row of kind end for each."""

    def __init__(self, key: tuple, left: float, right: float, first: float, stops: list | None, step: float | None):
        self.key, self.left, self.right, self.hanging = key, left, right, first < 0
        self.stops, self.step = sorted(stops or [], key=lambda s: s["pos"]), step or 36.0
        self.at = self.x = left + first
        self.line, self.pieces, self.closed = 0, [], []

    def close(self, brk: str | None = None, last: bool = False) -> None:
        while self.pieces and self.pieces[-1][3] == "space":
            self.pieces.pop()
        self.closed += [(*self.key, self.line, *p, None) for p in self.pieces]
        self.closed.append((*self.key, self.line, None, None, None, "end", brk, self.at, self.right - self.at, last))
        self.line, self.pieces = self.line + 1, []
        self.at = self.x = self.left

    def put(self, seq: int, at: int, piece: int, kind: str, text: str, w: float) -> None:
        self.pieces.append((seq, at, piece, kind, text, self.x, w))
        self.x += w

    def tab(self, seq: int, at: int, label: bool, blank: float, ahead: float) -> None:
        stop, align = tab_stop(self.x, self.left, label or self.hanging, self.stops, self.step)
        share = {"right": 1.0, "decimal": 1.0, "center": 0.5}.get(align, 0.0)
        target = max(self.x, stop - ahead * share) if share else stop
        if label and self.x > self.left - 0.01:  # the label is wider than the indent
            target = self.x + blank
        if target > self.right + 0.5 and self.pieces:
            self.close()
        else:
            self.put(seq, at, 0, "tab", align, max(0.0, target - self.x))
            self.x = max(self.x, target)

    def place(self, seq: int, at: int, kind: str, text: str, w: float, letters: list[float] | None) -> None:
        if kind != "space":
            if self.x + w > self.right + 0.01 and any(p[3] != "space" for p in self.pieces):
                self.close()
            if kind == "word" and w > self.right - self.at + 0.01:
                return self.place_letters(seq, at, text, letters)
        self.put(seq, at, 0, kind, text, w)

    def place_letters(self, seq: int, at: int, text: str, letters: list[float]) -> None:
        """A word wider than a line, cut where a line is full; each line takes one letter at least."""
        piece = begin = 0
        used = 0.0
        for k, w in enumerate(letters):
            if k > begin and self.x + used + w > self.right:
                self.put(seq, at, piece, "word", text[begin:k], used)
                self.close()
                piece, begin, used = piece + 1, k, 0.0
            used += w
        self.put(seq, at, piece, "word", text[begin:], used)

    def end(self) -> None:
        if self.pieces or not self.line:
            self.close(last=True)
        else:
            for k in range(len(self.closed) - 1, -1, -1):
                if self.closed[k][6] == "end":
                    self.closed[k] = (*self.closed[k][:-1], True)
                    break


def broken_lines(placed: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Pieces of lines (doc, para, line, seq, at, piece, kind, text, x, w), and for each line a row of kind end: its break in text,
    its begin in x, its width in w, and whether it is the last or ends by a break.

    placed: as of atoms(), with label for a list's number and its tab; paragraphs: (doc, para, width, left, right, first,
    stops, step), indents from both sides, the first line's from the left one, stops (pos, align) with align left, right,
    center or decimal, and the distance of stops beyond them. Lines break at spaces, which go at their ends; words wider than
    a line break by letters. A paragraph of any length passes through in the order of its atoms; one without atoms is one
    empty line if it is in `paragraphs`.
    """
    order = Window.partitionBy(*PARA).orderBy("seq", "at")
    ends = F.sum(F.when(F.col("kind").isin("tab", "break"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = placed.withColumn("__part", ends)
    ahead = F.sum(F.when(~F.col("kind").isin("tab", "break"), F.col("w")).otherwise(0.0)).over(Window.partitionBy(*PARA, "__part"))
    rows = rows.withColumn("__ahead", F.when(F.col("kind") == "tab", ahead)).withColumn("label", F.coalesce("label", F.lit(False)))
    own = paragraphs.select(*PARA, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__{c}") for c in ("width", "left", "right", "first")], F.col("stops").alias("__stops"), F.col("step").cast("double").alias("__step"))
    rows = rows.withColumn("__opens", F.row_number().over(order) == 1)  # what holds for the paragraph goes with its first atom
    joined = own.join(rows, PARA, "left").withColumn("__opens", F.coalesce("__opens", F.lit(True))).withColumn("__stops", F.when(F.col("__opens"), F.col("__stops"))).withColumn("__letters", F.when((F.col("kind") == "word") & (F.col("w") > F.col("__width") - F.col("__left") - F.col("__right") - F.greatest("__first", F.lit(0.0))), F.col("letters")))
    taken = joined.select(*PARA, "seq", "at", "kind", "text", "w", "__letters", "label", "blank", "__ahead", "__left", (F.col("__width") - F.col("__right")).alias("__edge"), "__first", "__stops", "__step")
    kinds = {f.name: f for f in taken.schema.fields}
    names = ["doc", "para", "line", "seq", "at", "piece", "kind", "text", "x", "w", "last"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        para = None
        for batch in batches:
            made: list[tuple] = []
            keys = [batch.schema.field(k).type for k in range(4)]
            for doc, number, seq, at, kind, text, w, letters, label, blank, ahead, left, edge, first, stops, step in zip(*(c.to_pylist() for c in batch.columns)):
                if para is None or para.key != (doc, number):
                    if para:
                        para.end()
                        made += para.closed
                    para = _Paragraph((doc, number), left, edge, first, stops, step)
                if kind == "break":
                    para.close(text, True)
                elif kind == "tab":
                    para.tab(seq, at, label, blank or 0.0, ahead or 0.0)
                elif kind is not None:
                    para.place(seq, at, kind, text, w, letters)
                if len(para.closed) > 1000:  # all but the last line, which may turn out to end the paragraph
                    keep = max(k for k, row in enumerate(para.closed[:-1]) if row[6] == "end") + 1 if any(row[6] == "end" for row in para.closed[:-1]) else 0
                    made += para.closed[:keep]
                    para.closed = para.closed[keep:]
            yield _rows(made, keys, names)
        if para:
            para.end()
            yield _rows(para.closed, keys, names)

    schema = f"doc {kinds['doc'].dataType.simpleString()}, para {kinds['para'].dataType.simpleString()}, line int, seq {kinds['seq'].dataType.simpleString()}, at int, piece int, kind string, text string, x double, w double, last boolean"
    return taken.repartition(*PARA).sortWithinPartitions(*PARA, "seq", "at").mapInArrow(walk, schema)


def _rows(made: list[tuple], keys: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    types = [keys[0], keys[1], pa.int32(), keys[2], pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * len(types), types)], names)


def aligned(lines: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Pieces of broken_lines() with x moved by their paragraph's align (doc, para, align): left, right, center, both. Only what
    stands after a line's last tab is spread, and no line with a tab is moved; the last line of a paragraph isn't spread."""
    ends = F.col("kind") == "end"
    own, upto = Window.partitionBy(*PARA, "line"), Window.partitionBy(*PARA, "line").orderBy("seq", "at", "piece")
    rows = lines.withColumn("__room", F.max(F.when(ends, F.col("w"))).over(own)).withColumn("__last", F.max(F.when(ends, F.col("last"))).over(own)).filter(~ends)
    rows = rows.join(paragraphs.select(*PARA, "align"), PARA, "left")
    rows = rows.withColumn("__n", F.row_number().over(upto)).withColumn("__tab", F.coalesce(F.max(F.when(F.col("kind") == "tab", F.col("__n"))).over(own), F.lit(0)))
    gap = F.when((F.col("kind") == "space") & (F.col("__n") > F.col("__tab")), 1).otherwise(0)
    rows = rows.withColumn("__gap", gap).withColumn("__gaps", F.sum("__gap").over(own)).withColumn("__before", F.coalesce(F.sum("__gap").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    free = F.col("__room") - F.sum("w").over(own)
    rows = rows.withColumn("__free", free)
    spread = (F.col("align") == "both") & ~F.col("__last") & (F.col("__free") > 0) & (F.col("__gaps") > 0)
    moved = F.when((F.col("align") == "right") & (F.col("__tab") == 0), F.col("__free")).when((F.col("align") == "center") & (F.col("__tab") == 0), F.col("__free") / 2).when(spread, F.col("__free") / F.col("__gaps") * F.col("__before")).otherwise(0.0)
    return rows.withColumn("x", F.col("x") + moved).select(*lines.columns)


def line_heights(lines: DataFrame, fonts: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc, para, line, height, baseline, brk): boxes of lines by the fonts (doc, para, seq, font, size, image) of their runs, and
    by the rule (doc, para, rule, value, font, size) of their paragraph: exact, atLeast, or a multiple of the natural height.
    A line without text has its paragraph's font; images stand on the baseline."""
    ends = lines.filter("kind = 'end'").select(*PARA, "line", F.when(F.col("text").isin("page", "column"), F.col("text")).alias("brk"))
    runs = lines.filter("kind <> 'end'").select(*PARA, "line", "seq", "kind").distinct().join(fonts, [*PARA, "seq"])
    m, size = font_metrics(F.col("font")), F.col("size")
    text = lambda c: F.max(F.when(F.col("kind") != "image", size * m[c]))
    sums = runs.groupBy(*PARA, "line").agg(text("ascent").alias("__a"), text("descent").alias("__d"), text("line").alias("__l"), F.max(F.when(F.col("kind") == "image", F.col("image"))).alias("__i"))
    rows = ends.join(sums, [*PARA, "line"], "left").join(paragraphs, PARA, "left")
    rows = rows.withColumns({"__a": F.coalesce("__a", size * m["ascent"]), "__d": F.coalesce("__d", size * m["descent"]), "__l": F.coalesce("__l", size * m["line"]), "__i": F.coalesce("__i", F.lit(0.0))})
    natural, least = F.col("__l"), F.col("__i") + F.col("__d")
    height = F.when(F.col("rule") == "exact", F.col("value")).when(F.col("rule") == "atLeast", F.greatest("value", natural, least)).otherwise(F.greatest(natural * F.coalesce("value", F.lit(1.0)), least + natural - F.col("__a") - F.col("__d")))
    return rows.withColumn("height", height).select(*PARA, "line", "height", (F.col("height") - F.col("__d")).alias("baseline"), "brk")


def table_boxes(tables: DataFrame, cells: DataFrame, rows: DataFrame) -> DataFrame:
    """cells (doc, table, row, cell, span, merge, content) with col, x, w, y, h: boxes of a table's cells, from its corner.

    tables: (doc, table, grid, indent, align, avail, left, right, top, bottom), grid the widths of columns, which shrink to
    the room there is, and margins of cells; rows: (doc, table, row, rule, value), exact or least heights, null for none.
    merge is restart for a cell that goes on below where cells at its column say continue. Such a cell lengthens its last row
    if it doesn't fit, from the top on; a row is 1 high at the least.
    """
    key = ["doc", "table"]
    room = F.col("avail") - F.col("indent")
    total = F.aggregate("grid", F.lit(0.0), lambda a, g: a + g)
    scale = F.when((total > room + 1) & (total > 0), room / total).otherwise(1.0)
    shapes = tables.withColumn("__scale", scale).withColumn("__grid", F.transform("grid", lambda g: g * F.col("__scale")))
    edges = F.aggregate("__grid", F.array(F.lit(0.0)), lambda a, g: F.array_append(a, F.element_at(a, -1) + g))
    shapes = shapes.withColumn("__x", edges).withColumn("__wide", F.element_at("__x", -1))
    start = F.when(F.col("align") == "center", (F.col("avail") - F.col("__wide")) / 2).when(F.col("align") == "right", F.col("avail") - F.col("__wide")).otherwise(F.col("indent"))
    shapes = shapes.withColumn("__start", start).select(*key, "__x", "__start", (F.col("top") + F.col("bottom")).alias("__margins"))
    # a table's cells stay in one of a counted number of partitions, and what their neighbours tell is written before the rest reads it
    cells = stored(cells)
    count = cells.count()
    line = Window.partitionBy(*key, "row").orderBy("cell")
    restarts = F.coalesce(F.col("merge") == "restart", F.lit(False))
    plain = F.when(~restarts, F.when(F.col("merge") == "continue", 0.0).otherwise(F.col("content")))
    own = dealt(cells, key, count).withColumn("col", F.coalesce(F.sum("span").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    own = own.withColumn("__plain", F.max(plain).over(Window.partitionBy(*key, "row"))).withColumn("__opens", F.row_number().over(line) == 1)
    # a merged cell ends before the next row that doesn't continue it: from below, the last row of a run comes first
    up = Window.partitionBy(*key, "col").orderBy(F.desc("row"))
    goes_on = (F.col("merge") == "continue") & (F.col("row") - F.lead("row").over(up) == 1)
    own = own.withColumn("__on", F.coalesce(goes_on, F.lit(False)))
    last = F.when(~F.coalesce(F.lag("__on").over(up), F.lit(False)), F.col("row"))
    own = stored(own.withColumn("__end", F.last(last, True).over(up.rowsBetween(Window.unboundedPreceding, 0))).drop("__on"))

    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    merged = F.when(restarts, F.struct("row", "cell", "__end", "content"))
    told = own.filter(F.col("__opens") | restarts).select(*key, "row", F.lit(False).alias("__ruled"), none("rule"), none("value"), "__plain", merged.alias("__m"))
    told = told.unionByName(rows.select(*key, "row", F.lit(True).alias("__ruled"), "rule", "value"), allowMissingColumns=True)
    told = dealt(told, key, count).withColumn("__plain", F.max("__plain").over(Window.partitionBy(*key, "row")))
    told = told.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("__ruled"), F.struct("row", "rule", "value", "__plain")))).alias("__rows"), F.array_sort(F.collect_list("__m")).alias("__merged"))

    def high(r: Column) -> Column:
        need = F.coalesce(r["__plain"] + F.col("__margins"), F.lit(0.0))
        height = F.when(r["rule"] == "exact", r["value"]).when(r["value"].isNotNull(), F.greatest(need, r["value"])).otherwise(need)
        return F.struct(r["row"].alias("row"), F.greatest(height, F.lit(1.0)).alias("__h"))

    def longer(state: Column, m: Column) -> Column:
        have = F.aggregate(F.filter(state, lambda r: r["row"].between(m["row"], m["__end"])), F.lit(0.0), lambda a, r: a + r["__h"])
        need = m["content"] + F.col("__margins")
        return F.transform(state, lambda r: F.struct(r["row"].alias("row"), (r["__h"] + F.when(r["row"] == m["__end"], F.greatest(F.lit(0.0), need - have)).otherwise(0.0)).alias("__h")))

    grown = told.filter(F.size("__rows") > 0).join(dealt(shapes, key, count), key).withColumn("__rows", F.transform("__rows", high))
    grown = grown.withColumn("__rows", F.aggregate("__merged", F.col("__rows"), longer)).drop("__merged", "__margins")
    out = dealt(own.drop("__plain", "__opens"), key, count).join(grown, key)
    n = F.size("__x") - 1
    out = out.withColumn("x", F.get("__x", F.least("col", n)) + F.col("__start")).withColumn("w", F.get("__x", F.least((F.col("col") + F.col("span")).cast("int"), n)) - F.get("__x", F.least("col", n)))
    summed = lambda of: F.aggregate(F.filter("__rows", of), F.lit(0.0), lambda a, r: a + r["__h"])
    last = F.when(F.col("merge") == "restart", F.col("__end")).otherwise(F.col("row"))
    return out.withColumn("y", summed(lambda r: r["row"] < F.col("row"))).withColumn("__last", last).withColumn("h", summed(lambda r: r["row"].between(F.col("row"), F.col("__last")))).select(*cells.columns, "col", "x", "w", "y", "h")


def keep_rules(lines: DataFrame, blocks: DataFrame, other: float = 20.0) -> DataFrame:
    """lines (doc, block, line, height, brk) of paragraphs and tables as items of flowed(): with before, need and after.

    blocks: (doc, block, kind, before, after, keep_lines, keep_next, break_before, contextual, style), kind para or table. Paragraphs
    of one style side by side that are contextual leave no space between them. A paragraph that keeps its lines needs room
    for all of them, one that keeps with the next also for what comes first of it (`other` if that is a table).
    """
    w = Window.partitionBy("doc").orderBy("block")
    sums = lines.groupBy("doc", "block").agg(F.sum("height").alias("__all"), F.min_by("height", "line").alias("__first"), F.max("line").alias("__last"))
    b = blocks.join(sums, ["doc", "block"])
    is_para = F.col("kind") == "para"
    near = is_para & (F.lag("kind").over(w) == "para") & F.col("contextual") & F.lag("contextual").over(w) & (F.col("style") == F.lag("style").over(w))
    b = b.withColumn("__before", F.when(~is_para, 0.0).when(F.coalesce(near, F.lit(False)), -F.lag("after").over(w)).otherwise(F.col("before")))
    room = F.when(F.col("keep_lines") | F.col("keep_next"), F.col("__all")).otherwise(F.col("__first"))
    ahead = F.when(~F.col("keep_next") | F.lead("kind").over(w).isNull(), 0.0).when(F.lead("kind").over(w) == "para", F.lead("before").over(w) + F.lead("__first").over(w)).otherwise(other)
    b = b.withColumn("__room", F.when(is_para, room + ahead)).select("doc", "block", "__before", "__room", "__last", F.when(is_para, F.col("after")).otherwise(0.0).alias("__after"), (is_para & F.coalesce("break_before", F.lit(False))).alias("__fresh"), is_para.alias("__para"))
    rows = lines.join(b, ["doc", "block"]).withColumn("__opens", F.row_number().over(Window.partitionBy("doc", "block").orderBy("line")) == 1)
    opens = F.col("__opens") & F.col("__para")
    return rows.select(*lines.columns, F.when(opens, F.col("__before")).alias("before"), F.when(opens, F.col("__room")).alias("need"), F.when(F.col("line") == F.col("__last"), F.col("__after")).otherwise(0.0).alias("after"), (opens & F.col("__fresh")).alias("fresh"))


def flowed(items: DataFrame, sections: DataFrame) -> DataFrame:
    """items with page and col, from 1 and 0, and y on it, and repeated, the height of a table's headers set again above a row.

    items: (doc, section, block, line, height, before, need, after, fresh, brk, header), in order of section, block and line:
    before and need for the first line of a paragraph, else null; fresh opens a page; brk page or column ends one; header
    for the rows of a table that are headers, null for lines of text. sections: (doc, section, cols, top, bottom,
    continuous): a continuous one goes on below, in columns of its own. What doesn't fit goes to the next column, then page;
    the rows of a table take its headers along, except headers themselves and the first row.
    """
    place = ["section", "block", "line"]
    table = Window.partitionBy("doc", "section", "block")
    rows = items.withColumn("__first", F.row_number().over(table.orderBy("line")) == 1)
    again = F.when(F.col("header").isNotNull() & ~F.col("header") & ~F.col("__first"), F.sum(F.when(F.col("header"), F.col("height"))).over(table))
    rows = rows.withColumn("__again", F.coalesce(again, F.lit(0.0))).join(sections, ["doc", "section"])
    taken = rows.select("doc", *place, "height", "before", "need", F.coalesce("after", F.lit(0.0)).alias("after"), F.coalesce("fresh", F.lit(False)).alias("fresh"), "brk", "__again", "cols", F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"), F.coalesce("continuous", F.lit(False)).alias("continuous"))
    kinds = {f.name: f.dataType.simpleString() for f in taken.schema.fields}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = section = object()
        page = col = 0
        y = start = 0.0
        for batch in batches:
            made = []
            for own, part, _, _, height, before, need, after, fresh, brk, again, cols, top, bottom, continuous in zip(*(c.to_pylist() for c in batch.columns)):

                def turn() -> None:
                    nonlocal page, col, start, y
                    page, col, start = page + 1, 0, top
                    y = top

                def onward() -> None:
                    nonlocal col, y
                    if col + 1 < max(1, cols or 1):
                        col, y = col + 1, start
                    else:
                        turn()

                if own != doc:
                    page = 0
                    turn()
                elif part != section and continuous:
                    col, start = 0, y
                elif part != section:
                    turn()
                doc, section, repeated = own, part, 0.0
                if need is not None:
                    if fresh and abs(y - start) >= 0.01:
                        turn()
                    space = before if abs(y - start) >= 0.01 else 0.0
                    if y + space + need > bottom + 0.01 and abs(y - start) >= 0.01 and space + need < bottom - start:
                        onward()
                        space = 0.0
                    y += space
                if y + height > bottom + 0.01 and abs(y - start) >= 0.01:
                    onward()
                    repeated, y = again, y + again
                made.append((page, col, y, repeated))
                y += height
                if brk == "page":
                    turn()
                elif brk == "column":
                    onward()
                y += after
            columns = [pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 4, (pa.int32(), pa.int32(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], ["doc", *place, "page", "col", "y", "repeated"])

    ordered = taken.repartition("doc").sortWithinPartitions("doc", *place)
    keys = ", ".join(f"{c} {kinds[c]}" for c in ("doc", *place))
    return ordered.mapInArrow(walk, f"{keys}, page int, col int, y double, repeated double")
