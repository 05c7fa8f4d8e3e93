"""Blocks of a page's text: tables, tab lines, list items and paragraphs out of ordered lines; rows and cells out of tables."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .layout import PAGE
from .scratch import dealt
from .stats import cluster_values, floor_percentile

REGION = [*PAGE, "part"]

#: Signs that open list items, those shown as a dot, the shape of numbers before items, and of dotted leaders.
BULLET = r"^([•●○◦▪■□►▸‣⁃∙·✓✔➢➤\-–—*])\s*"
DOTS = ["*", "-", "∙", "·"]
NUMBER = r"^(\(?)(\d{1,3}|[a-zA-Z]|[ivxlcdm]{1,6}|[IVXLCDM]{1,6})([.)])\s+"
LEADER = r"^(.*?\S)\s*\.{4,}\s*(\S{1,8})$"
LEADER_END = r"\.{4,}\s*\S{1,8}$"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}

#: How near column starts agree, how tight a wrapped row follows, how far apart rows of a table may be, in sizes.
NEAR, TIGHT, APART, WRAPPED = 6.0, 1.35, 3.0, 1.3


def roman_value(token: Column) -> Column:
    """The value of a roman numeral in small letters: a sign before a larger one counts down."""
    values = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("before"))
    step = lambda s, sign: F.struct((s["total"] + values[sign] - F.when(s["before"] < values[sign], 2 * s["before"]).otherwise(0)).alias("total"), values[sign].alias("before"))
    return F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), start, step)["total"]


def list_marker(text: Column) -> Column:
    """struct(kind, glyph, fmt, prefix, suffix, start, length) of the marker that opens a line of a list, else null.

    A dash needs a space behind it, a number something to number; numbers over 200 are no markers, nor is an opening
    bracket that nothing closes.
    """
    sign, bullet = F.regexp_extract(text, BULLET, 1), F.regexp_extract(text, BULLET, 0)
    part = lambda i: F.regexp_extract(text, NUMBER, i)
    token, number = part(2), part(0)
    kinds = [("decimal", r"^\d+$", token.try_cast("int")), ("lowerRoman", "^[ivxlcdm]{2,}$", roman_value(token)), ("upperRoman", "^[IVXLCDM]{2,}$", roman_value(F.lower(token))), ("lowerLetter", "^[a-z]$", F.ascii(token) - 96), ("upperLetter", "^[A-Z]$", F.ascii(token) - 64)]
    fmt, start = F, F
    for name, pattern, value in kinds:
        fmt, start = fmt.when(token.rlike(pattern), name), start.when(token.rlike(pattern), value)
    shape = lambda *v: F.struct(*[x.cast(t).alias(n) for x, (n, t) in zip(v, (("kind", "string"), ("glyph", "string"), ("fmt", "string"), ("prefix", "string"), ("suffix", "string"), ("start", "int"), ("length", "int")))])
    none, dash = F.lit(None), sign.isin("-", "–", "—") & ~F.substring(text, 2, 1).rlike(r"^\s")
    as_bullet = shape(F.lit("bullet"), F.when(sign.isin(*DOTS), "•").otherwise(sign), none, none, none, none, F.length(bullet))
    as_number = shape(F.lit("number"), none, fmt, part(1), part(3), start, F.length(number))
    counted = (F.length(text) > F.length(number) + 1) & (start >= 1) & ~((fmt == "decimal") & (start > 200)) & ~((part(1) == "(") & (part(3) != ")"))
    return F.when((sign != "") & (F.length(text) > F.length(bullet)), F.when(~dash, as_bullet)).when((number != "") & counted, as_number)


def lines_of_segments(segments: DataFrame) -> DataFrame:
    """Lines (doc, page, part, line, y, size, bold, label, x, right, text, starts, first) of segments (doc, page, part, line,
    y, size, bold, label, x0, x1, text): starts are the sorted starts of a line's segments, first is the text of its first."""
    own = segments.groupBy(*REGION, "line").agg(
        *[F.max(c).alias(c) for c in ("y", "size", "bold", "label")],
        F.min("x0").alias("x"),
        F.max("x1").alias("right"),
        F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))).alias("__s"),
    )
    texts = F.transform("__s", lambda s: s["text"])
    return own.withColumn("text", F.array_join(texts, " ")).withColumn("starts", F.transform("__s", lambda s: s["x0"].cast("double"))).withColumn("first", texts[0]).drop("__s")


def text_boxes(lines: DataFrame) -> DataFrame:
    """(doc, page, part, left, edge): where the text of a region begins, and the 95th percentile of its lines' ends."""
    return lines.groupBy(*REGION).agg(F.min("x").alias("left")).join(floor_percentile(lines, REGION, "right", 0.95, "edge"), REGION)


class Line(NamedTuple):
    """What the walk needs of a line: facts that hold by itself and beside the line before."""

    multi: bool
    leader: bool
    listed: bool
    stops: bool  # opens a block of its own
    tight: bool  # may go on with a table's row
    far: bool
    follows: bool  # size, distance and, unless it is the paragraph's second line, weight fit the line before
    alike: bool  # in weight
    centred: bool  # as the line before
    flows: bool  # the line before is full, or breaks off within a sentence
    gap: float
    before: float  # size of the line before
    x: float
    text_x: float  # where the text begins after a marker
    right: float
    edge: float
    starts: list


def described(lines: DataFrame, body: Column) -> DataFrame:
    """lines with the facts of Line, by expressions and the line before in each region; body: the size of running text."""
    own = Window.partitionBy(*REGION).orderBy("line")
    before = lambda c: F.lag(c).over(own)
    region = Window.partitionBy(*REGION)
    ends = region.orderBy(F.asc_nulls_last("right"))
    at_edge = F.row_number().over(ends) == F.floor(F.lit(0.95) * (F.count("right").over(region) - 1)) + 1
    rows = lines.withColumn("left", F.min("x").over(region)).withColumn("__at_edge", at_edge)
    rows = rows.withColumn("edge", F.max(F.when(F.col("__at_edge"), F.col("right"))).over(region)).drop("__at_edge")  # as text_boxes()
    rows = rows.withColumn("marker", list_marker(F.col("text"))).withColumn("__body", body)
    small = F.col("size") < F.col("__body") * 1.15
    marked_first = (F.size("starts") == 2) & (F.length("first") <= 4) & list_marker(F.concat("first", F.lit(" x"))).isNotNull()
    rows = rows.withColumn("multi", (F.size("starts") >= 2) & ~marked_first).withColumn("listed", F.col("marker").isNotNull() & small)
    rows = rows.withColumn("leader", F.col("text").rlike(LEADER)).withColumn("stops", F.col("multi") | F.col("listed") | F.col("text").rlike(LEADER_END) | F.col("label"))
    rows = rows.withColumn("gap", F.col("y") - before("y")).withColumn("before", before("size"))
    middle, centre = (F.col("x") + F.col("right")) / 2, (F.col("left") + F.col("edge")) / 2
    rows = rows.withColumn("__middle", F.abs(middle - centre) < 6)
    short = before("right") < F.col("edge") - F.greatest(F.greatest(F.lit(1.0), F.col("edge") - F.col("left")) * 0.12, F.col("before") * 5)
    told = {
        "tight": F.col("marker").isNull() & (F.col("gap") < F.col("size") * TIGHT),
        "far": F.col("gap") > F.greatest("size", "before") * APART,
        "follows": (F.abs(F.col("size") - F.col("before")) < 0.6) & (F.col("gap") > 0) & (F.col("gap") < F.col("before") * 2.2),
        "alike": F.col("bold") == before("bold"),
        "centred": F.col("__middle") & before("__middle") & (before("x") > F.col("left") + 10),
        "flows": ~short | (~before("text").rlike(r"""[.!?:]["')\]]?$""") & F.col("text").rlike("^[a-z]")),
    }
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in told.items()})
    gone = F.when(F.col("listed"), F.col("marker.length")).otherwise(0)
    text_x = F.col("x") + gone * (F.col("right") - F.col("x")) / F.greatest(F.lit(1), F.length("text"))
    return rows.withColumn("text_x", F.coalesce(F.col("text_x"), text_x) if "text_x" in lines.columns else text_x).drop("__body", "__middle")


def _columns(starts: list[float]) -> list[float]:
    """The first of each cluster of two starts or more."""
    found, size = [], 0
    for at, x in enumerate(starts := sorted(starts)):
        size = size + 1 if at and x - starts[at - 1] <= NEAR else 1
        if size == 2:
            found.append(starts[at - 1])
    return found


def _near(x: float, places: list[float]) -> bool:
    """Whether one of the sorted places is nearer than NEAR."""
    at = bisect_left(places, x)
    return any(abs(p - x) < NEAR for p in places[max(0, at - 1) : at + 1])


def table_length(lines: list[Line], at: int) -> int:
    """How many lines from `at` on are a table; 0 if they are none. Lines of one segment belong if they start where the rows so
    far have columns; rows must share two columns, and more than labels with values flush to the right edge."""
    starts, n = [], 0
    for line in lines[at:]:
        if n and line.far or not (line.multi or n and line.tight and all(_near(x, starts) for x in line.starts)):
            break
        if len(line.starts) >= 2:
            starts = sorted(starts + line.starts)
        n += 1
    run = lines[at : at + n]
    rows, columns = [x for x in run if len(x.starts) >= 2], _columns([x for line in run for x in line.starts])
    shared = sum(all(_near(x, columns) for x in line.starts) for line in rows)
    flush = all(len(line.starts) == 2 and abs(line.right - line.edge) < 8 for line in rows)
    return n if n >= 2 and len(columns) >= 2 and shared >= 2 and not flush else 0


def paragraph_length(lines: list[Line], at: int, pitch: float) -> int:
    """How many lines from `at` on are one paragraph or list item; its steps are measured against their median so far."""
    first, gaps = lines[at], []
    body = first.text_x if first.listed else None
    for line in lines[at + 1 :]:
        usual = gaps[len(gaps) // 2] if gaps else line.before * pitch
        near = line.gap <= max(usual * 1.3, line.before * 1.05)
        aligned = body is None or abs(line.x - body) < 4
        if line.stops or not (line.follows and near and (line.alike or gaps) and (line.centred or aligned and line.flows)):
            break
        body = line.x if body is None else body
        insort(gaps, line.gap)
    return 1 + len(gaps)


def walk(lines: list[Line], pitch: float) -> Iterator[tuple[int, str]]:
    """(block, kind) of each line of a region, in order."""
    at = block = 0
    while at < len(lines):
        line = lines[at]
        if line.multi:
            n = table_length(lines, at)
            kind = "table" if n else "tabs"
        elif line.leader:
            n, kind = 1, "leader"
        else:
            n, kind = paragraph_length(lines, at, pitch), "item" if line.listed else "paragraph"
        n = max(n, 1)
        yield from [(block, kind)] * n
        at, block = at + n, block + 1


def blocks(lines: DataFrame, body: Column, pitch: float = 1.2) -> DataFrame:
    """lines (as of lines_of_segments; text_x, where the text after a marker begins, is estimated if absent) with their block,
    from 0 in each region (doc, page, part), its kind (table, tabs, leader, item, paragraph) and the marker of list items.

    Facts about a line and the one before are expressions and windows. What goes into an open table depends on the columns of
    its rows so far, and what goes into a paragraph on its steps so far: a task walks over the sorted regions, one in hand.
    """
    rows = described(lines, body)
    facts = rows.select(*REGION, "line", *Line._fields).fillna(0.0, ["gap", "before"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def batch(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], [*REGION, "line", "block", "kind"])

        made: list[tuple] = []
        for _, own in groupby(read(), key=lambda r: r[:3]):
            own = list(own)
            made += [(*r[:4], *b) for r, b in zip(own, walk([Line(*r[4:]) for r in own], pitch))]
            if len(made) >= 5000:
                yield batch(made)
                made = []
        if made:
            yield batch(made)

    types = [*[to_arrow_type(rows.schema[c].dataType) for c in (*REGION, "line")], pa.int32(), pa.string()]
    walked = facts.repartition(*REGION).sortWithinPartitions(*REGION, "line").mapInArrow(each, ", ".join(f"{c} {kinds[c]}" for c in (*REGION, "line")) + ", block int, kind string")
    return lines.join(walked, [*REGION, "line"]).withColumn("marker", F.when(F.col("kind") == "item", list_marker(F.col("text"))))


def table_columns(segments: DataFrame, keys: list[str], edge: str) -> DataFrame:
    """(keys, col, start, width): the columns of tables whose segments (keys, x0, edge) start at like places; a place counts
    if two segments start there. The last column reaches 4 beyond the text's right edge."""
    found = cluster_values(segments.withColumn("x0", F.col("x0").cast("double")), keys, "x0", NEAR, least=2)
    own = Window.partitionBy(*keys).orderBy("first")
    edges = segments.groupBy(*keys).agg((F.max(edge) + 4).alias("__edge"))
    rows = found.join(edges, keys).withColumn("col", F.row_number().over(own) - 1)
    return rows.select(*keys, "col", F.col("first").alias("start"), F.greatest(F.lit(20.0), F.coalesce(F.lead("first").over(own), F.col("__edge")) - F.col("first")).alias("width"))


def table_rows(segments: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """segments (keys, line, y, size, x0, ...) with col and row, both from 0.

    The column is the last that starts at or before x0 and NEAR more, else the first. A line opens a row unless it has
    nothing in the first column, or is one piece close below the line before: those go on with the row before.
    """
    starts = columns.select(*keys, F.col("start").alias("__at"), F.lit(0).alias("__kind"), "col")
    asof = segments.withColumn("__at", F.col("x0").cast("double") + NEAR).withColumn("__kind", F.lit(1)).withColumn("col", F.lit(None).cast("int"))
    upto = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = dealt(starts.unionByName(asof, allowMissingColumns=True), keys, segments.count())
    placed = both.withColumn("col", F.coalesce(F.last("col", True).over(upto), F.lit(0))).filter("__kind = 1").drop("__at", "__kind")
    line, own = Window.partitionBy(*keys, "line"), Window.partitionBy(*keys).orderBy("line")
    rows = placed.withColumns({"__y": F.max("y").over(line), "__size": F.max("size").over(line), "__least": F.min("col").over(line), "__n": F.count("*").over(line)})
    rows = rows.withColumn("__above", F.lag(F.struct("line", "__y")).over(own))  # of a line's first piece, the line before
    close = (F.col("__n") == 1) & (F.col("__y") - F.col("__above.__y") < F.col("__size") * WRAPPED)
    first = F.col("__above").isNull() | (F.col("__above.line") != F.col("line"))
    opens = first & (F.col("__above").isNull() | ((F.col("__least") == 0) & ~close))
    upto_line = own.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__opens", F.when(opens, 1).otherwise(0)).withColumn("row", F.sum("__opens").over(upto_line) - 1)
    return rows.drop("__y", "__size", "__least", "__n", "__above", "__opens")


def table_cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, text): the pieces of a cell of table_rows(), by line and place, a line each."""
    own = rows.groupBy(*keys, "row", "col").agg(F.array_sort(F.collect_list(F.struct("line", "x0", "text"))).alias("__s"))
    return own.select(*keys, "row", "col", F.array_join(F.transform("__s", lambda s: s["text"]), "\n").alias("text"))
