"""Relational kernels of page layout. Everything is joined and windowed within (doc, page), which bounds each group."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import shared_folder, stored
from .stats import distinct_top, floor_percentile, upper_median, weighted_mode

PAGE = ["doc", "page"]


def inside(points: DataFrame, boxes: DataFrame, order: str, values: list[str]) -> DataFrame:
    """points (doc, page, x, y, ...) with the values of the first box, by order, that holds them; null if none does. The join is equi on the page, and a row per point comes out of the grouped minimum."""
    p, b = points.withColumn("__id", F.monotonically_increasing_id()).alias("p"), boxes.alias("b")
    on = (F.col("p.doc") == F.col("b.doc")) & (F.col("p.page") == F.col("b.page")) & F.col("p.x").between(F.col("b.x0"), F.col("b.x1")) & F.col("p.y").between(F.col("b.y0"), F.col("b.y1"))
    hit = F.struct(F.col(f"b.{order}").alias("o"), *[F.col(f"b.{v}").alias(v) for v in values])
    own = [F.first(F.col(f"p.{c}")).alias(c) for c in points.columns]
    first = p.join(b, on, "left").groupBy("p.__id").agg(*own, F.min(F.when(F.col("b.x0").isNotNull(), hit)).alias("__hit"))
    return first.select(*points.columns, *[F.col(f"__hit.{v}").alias(v) for v in values])


def overlapping(a: DataFrame, b: DataFrame, low: str, high: str, share: float = 0.0) -> DataFrame:
    """Pairs (a_id, b_id, overlap) on one page whose intervals share more than `share` of the shorter one."""
    x, y = a.alias("x"), b.alias("y")
    common = F.least(F.col(f"x.{high}"), F.col(f"y.{high}")) - F.greatest(F.col(f"x.{low}"), F.col(f"y.{low}"))
    short = F.least(F.col(f"x.{high}") - F.col(f"x.{low}"), F.col(f"y.{high}") - F.col(f"y.{low}"))
    on = (F.col("x.doc") == F.col("y.doc")) & (F.col("x.page") == F.col("y.page")) & (F.col("x.id") != F.col("y.id")) & (common > 0) & (common >= share * short)
    return x.join(y, on).select(F.col("x.doc").alias("doc"), F.col("x.page").alias("page"), F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id"), common.alias("overlap"))


def justified(lines: DataFrame, tolerance: float = 1.5, least_words: int = 4) -> DataFrame:
    """Lines (doc, page, id, x0, x1, y, size, words) that share both edges, font size and a near baseline with another line."""
    a, b = lines.alias("a"), lines.alias("b")
    near = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tolerance for c in ("x0", "x1")]
    on = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.id") != F.col("b.id")) & near[0] & near[1] & (F.abs(F.col("a.size") - F.col("b.size")) <= 0.3)
    on = on & (F.abs(F.col("a.y") - F.col("b.y")) <= 3 * F.col("a.size")) & (F.col("a.words") >= least_words)
    return a.join(b, on, "left_semi")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder of spark.checkpoint.dir; a local master without one gets a folder of its own."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)  # a checkpoint writes in a job of its own, which reads this
    out = kept.checkpoint()
    kept.unpersist()
    return out


def components(nodes: DataFrame, links: DataFrame, most: int = 1_000_000) -> DataFrame:
    """nodes (doc, page, id) with the smallest id that links (doc, page, a_id, b_id) reach, within a page.

    Nodes and links are sorted by page, and a task walks over them with one page's nodes in hand, each hanging on a smaller
    one. A count shows pages of over `most` nodes; these go by rounds of joins instead, so that no task holds them.
    """
    keys = [*PAGE, "id"]
    kinds = {c: nodes.schema[c].dataType for c in keys}
    own, ends = nodes.select(*keys), {"id": "a_id", "other": "b_id"}
    both = links.dropna(subset=[*PAGE, *ends.values()]).select(*[F.col(c).cast(kinds[c]).alias(c) for c in PAGE], *[F.col(c).cast(kinds["id"]).alias(n) for n, c in ends.items()])
    huge = own.groupBy(*PAGE).count().filter(F.col("count") > most).select(*PAGE).dropna()
    if huge.isEmpty():
        return _walked_components(own, both)
    small, large = (_walked_components, "left_anti"), (_joined_components, "left_semi")
    parts = [find(own.join(huge, PAGE, how), both.join(huge, PAGE, how)) for find, how in (small, large)]
    return parts[0].unionByName(parts[1])


def _walked_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """components() of pages that a task can hold: nodes (doc, page, id), links (doc, page, id, other)."""
    names = [*PAGE, "id", "component"]
    kinds = {f.name: f.dataType for f in nodes.schema.fields}
    types = [to_arrow_type(kinds[c]) for c in (*PAGE, "id", "id")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def batch(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)

        made: list[tuple] = []
        for (doc, page), own in groupby(read(), key=lambda r: r[:2]):
            on: dict = {}  # what each node hangs on, itself at first
            ids = []

            def root(x):
                while on[x] != x:
                    on[x] = x = on[on[x]]
                return x

            for _, _, a, b in own:  # nodes come first
                if b is None:
                    on[a] = a
                    ids.append(a)
                elif a in on and b in on:
                    a, b = root(a), root(b)
                    on[max(a, b)] = min(a, b)
            made += [(doc, page, x, root(x)) for x in ids]
            if len(made) >= 5000:
                yield batch(made)
                made = []
        if made:
            yield batch(made)

    rows = nodes.withColumn("other", F.lit(None).cast(kinds["id"])).unionByName(links)
    ordered = rows.repartition(*PAGE).sortWithinPartitions(*PAGE, F.col("other").isNotNull())
    return ordered.mapInArrow(walk, ", ".join(f"{c} {kinds[k].simpleString()}" for c, k in zip(names, (*PAGE, "id", "id"))))


def _joined_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """components() of pages of any size: nodes (doc, page, id), links (doc, page, id, other). Labels pass over links and then over
    labels until none moves; rounds grow with the logarithm of a chain."""
    both = stored(links.union(links.select(*PAGE, F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    labels = stored(nodes.select(*PAGE, "id", F.col("id").alias("component")))
    moved = True
    while moved:
        seen = both.join(labels.select(*PAGE, F.col("id").alias("other"), "component"), [*PAGE, "other"]).groupBy(*PAGE, "id").agg(F.min("component").alias("least"))
        low = labels.join(seen, [*PAGE, "id"], "left").select(*PAGE, "id", "component", F.least("component", F.coalesce("least", "component")).alias("low"))
        jump = low.select(*PAGE, F.col("id").alias("low"), F.col("low").alias("further"))
        fresh = stored(low.join(jump, [*PAGE, "low"], "left").select(*PAGE, "id", "component", F.least("low", F.coalesce("further", "low")).alias("fresh")))
        moved = not fresh.filter("fresh < component").isEmpty()
        labels = fresh.select(*PAGE, "id", F.col("fresh").alias("component"))
    return labels


def merged_cells(cells: DataFrame, open_edges: DataFrame) -> DataFrame:
    """(doc, page, region, r0, r1, c0, c1, rectangular): cells (doc, page, id, r, c) merged over missing borders
    (doc, page, a_id, b_id); a group that doesn't fill its bounds is no rectangle, which no table cell can be."""
    named = components(cells, open_edges).join(cells, [*PAGE, "id"])
    out = named.groupBy(*PAGE, F.col("component").alias("region")).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n"))
    return out.withColumn("rectangular", (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1) == F.col("n")).drop("n")


def edges(shapes: DataFrame, thin: float = 2.5, least: float = 3.0) -> DataFrame:
    """(doc, page, shape, o, pos, a, b, w): rules that rectangles (doc, page, shape, x, y, w, h, stroked, filled, lw) draw.

    A thin filled one is a rule along its longer side, a stroked one four; shorter ones than `least` don't count.
    """
    x, y, w, h, lw = (F.col(c).cast("double") for c in ("x", "y", "w", "h", "lw"))

    def edge(o: str, pos: Column, start: Column, length: Column, width: Column) -> Column:
        return F.struct(F.lit(o).alias("o"), pos.alias("pos"), start.alias("a"), (start + length).alias("b"), width.alias("w"))

    rule = F.when(w >= h, F.array(edge("h", y + h / 2, x, w, h))).otherwise(F.array(edge("v", x + w / 2, y, h, w)))
    frame = F.array(edge("h", y, x, w, lw), edge("h", y + h, x, w, lw), edge("v", x, y, h, lw), edge("v", x + w, y, h, lw))
    found = F.when(F.col("filled") & ~F.col("stroked") & (F.least(w, h) <= thin), rule).when(F.col("stroked"), frame)
    return shapes.select(*PAGE, "shape", F.explode(found).alias("e")).select(*PAGE, "shape", "e.*").filter(F.col("b") - F.col("a") >= least)


def lines_of_glyphs(glyphs: DataFrame, tolerance: float = 0.42, least: float = 1.5) -> DataFrame:
    """Glyphs (doc, page, seq, x, y, w, size, ...) with the number of their line.

    In reading order (y, x, seq), a glyph joins the first line whose baseline is near its own, by `tolerance` of the larger
    size, `least` at the least, and which has nothing where it stands; else it opens one. A line takes on the size and
    baseline of its largest glyph. What a glyph joins depends on all before it: a task walks over sorted pages, with the lines
    of one in hand.
    """
    names = [f.name for f in glyphs.schema.fields]
    none = float("nan")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page: object = None
        levels: list[list[float]] = []
        taken: list[list[tuple[float, float]]] = []
        for batch in batches:
            numbers = []
            for doc, number, *box in zip(*(batch.column(names.index(c)).to_pylist() for c in (*PAGE, "x", "y", "w", "size"))):
                if (doc, number) != page:
                    page, levels, taken = (doc, number), [], []
                x, y, w, size = (none if v is None else float(v) for v in box)
                for n, (line_y, line_size) in enumerate(levels):
                    if abs(line_y - y) <= max(least, tolerance * max(line_size, size)):
                        at = bisect_left(taken[n], (x, x + w))
                        around = taken[n][max(0, at - 1) : at + 1]
                        if not any(x < end - 1 and start < x + w - 1 for start, end in around):
                            taken[n].insert(at, (x, x + w))
                            if size > line_size:
                                levels[n] = [y, size]
                            break
                else:
                    n = len(levels)
                    levels.append([y, size])
                    taken.append([(x, x + w)])
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], [*names, "line"])

    ordered = glyphs.repartition(*PAGE).sortWithinPartitions(*PAGE, *[F.asc_nulls_last(c) for c in ("y", "x", "seq")])
    return ordered.mapInArrow(walk, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in glyphs.schema.fields) + ", line int")


def tagged(lined: DataFrame, size: str = "line_size", y: str = "line_y") -> DataFrame:
    """Glyphs with vert: super or sub beside the line's base, else null. The base is the first glyph in the size that most
    of the line's characters have."""
    own = Window.partitionBy(*PAGE, "line")
    weights = lined.groupBy(*PAGE, "line", F.round("size", 2).alias("__size")).agg(F.sum(F.length("s")).alias("__n"), F.min(F.struct("x", "seq")).alias("__at"))
    main = weights.groupBy(*PAGE, "line").agg(F.max_by("__size", F.struct("__n", -F.col("__at.x"), -F.col("__at.seq"))).alias(size))
    near = F.when(F.abs(F.col("size") - F.col(size)) < 0.3, F.struct("x", "seq", "y"))
    rows = lined.join(main, [*PAGE, "line"]).withColumn(y, F.coalesce(F.min(near).over(own)["y"], F.min(F.struct("x", "seq", "y")).over(own)["y"]))
    return rows.withColumn("vert", raised(F.col("size"), F.col("y"), F.col(size), F.col(y)))


def spaced(gap: float = 0.12) -> Column:
    """Whether a space stands before a glyph: it starts more than `gap` of its size after the one before, neither raised."""
    w = Window.partitionBy(*PAGE, "line").orderBy("x", "seq")
    apart = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w) > gap * F.col("size")
    return F.coalesce(apart & F.col("vert").isNull() & F.lag(F.col("vert").isNull()).over(w), F.lit(False))


def line_texts(glyphs: DataFrame, gap: float = 0.12) -> DataFrame:
    """(doc, page, line, text, x0, x1): the text of each line of tagged glyphs (s, x, w, size, vert)."""
    rows = glyphs.withColumn("__t", F.concat(F.when(spaced(gap), " ").otherwise(""), "s"))
    lines = rows.groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(F.struct("x", "seq", "__t"))).alias("__x"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"))
    return lines.select(*PAGE, "line", F.array_join(F.transform("__x", lambda g: g["__t"]), "").alias("text"), "x0", "x1")


def style_runs(glyphs: DataFrame, styles: list[str], tolerance: float = 0.3) -> DataFrame:
    """(doc, page, run, styles, text): neighbouring glyphs of equal styles and near sizes as runs, over the lines of a page.

    A line ends with a space, or, where a hyphen after a small letter meets a small letter, with neither.
    """
    within, over = Window.partitionBy(*PAGE, "line").orderBy("x", "seq"), Window.partitionBy(*PAGE).orderBy("line", "x", "seq")
    rows = glyphs.withColumn("__before", F.when(spaced(), " ").otherwise("")).withColumn("__next_line", F.lead("line").over(over)).withColumn("__next", F.lead("s").over(over))
    ends = F.col("__next_line").isNotNull() & (F.col("__next_line") != F.col("line"))
    hyphen = F.col("s").rlike("-$") & F.concat(F.coalesce(F.lag("s").over(within), F.lit("")), F.col("s")).rlike("[a-z]-$") & F.col("__next").rlike("^[a-z]")
    text = F.when(ends & hyphen, F.expr("left(s, length(s) - 1)")).when(ends, F.concat("s", F.lit(" "))).otherwise(F.col("s"))
    same = F.abs(F.lag("size").over(over) - F.col("size")) < tolerance
    for c in styles:
        same = same & F.lag(c).over(over).eqNullSafe(F.col(c))
    rows = rows.withColumn("__t", F.concat("__before", text)).withColumn("__new", F.when(F.coalesce(same & F.lag(F.lit(True)).over(over), F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("__new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*PAGE, "run").agg(F.array_sort(F.collect_list(F.struct("line", "x", "seq", "__t"))).alias("__x"), *[F.first(c).alias(c) for c in styles])
    return runs.select(*PAGE, "run", *styles, F.array_join(F.transform("__x", lambda g: g["__t"]), "").alias("text"))


def raised(size: Column, y: Column, base_size: Column, base_y: Column) -> Column:
    """super, sub or null for a glyph beside its line's base."""
    small = size < 0.85 * base_size
    return F.when(small & (y < base_y - 0.12 * base_size), "super").when(small & (y > base_y + 0.08 * base_size), "sub")


def without_marker(glyphs: DataFrame, length: str) -> DataFrame:
    """Glyphs (doc, page, line, seq, s, x, w, length) after the first `length` characters of their line, a list's marker.

    A glyph that the marker fills goes, and a space with it; one that it fills in part is cut, by its mean width.
    """
    w = Window.partitionBy(*PAGE, "line").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = glyphs.withColumn("__left", F.col(length) - F.coalesce(F.sum(F.length("s") + 1).over(w), F.lit(0)))
    rest = F.ltrim(F.expr("substring(s, cast(__left as int) + 1)"))
    rows = rows.filter((F.col("__left") <= 0) | (F.length("s") > F.col("__left"))).withColumn("__s", F.when(F.col("__left") > 0, rest).otherwise(F.col("s")))
    gone = (F.length("s") - F.length("__s")) * F.col("w") / F.greatest(F.lit(1), F.length("s"))
    return rows.withColumn("x", F.col("x") + gone).withColumn("w", F.col("w") - gone).withColumn("s", F.col("__s")).drop("__left", "__s")


def gutters(lines: DataFrame, left: int, right: int, step: int = 2) -> DataFrame:
    """The gutter of each page that the fewest lines (x0, x1) cross, the first of equal ones, with the lines on either side.

    A line counts up where it begins and down where it ends; running sums over the candidates give the rest.
    """
    n = (right - left) // step + 1
    after = F.least(F.lit(n), F.greatest(F.lit(0), F.floor((F.col("x0") - left) / step).cast("int") + 1))
    until = F.least(F.lit(n), F.greatest(F.lit(0), F.ceil((F.col("x1") - left) / step).cast("int")))
    mark = lambda i, crossing, lefts, rights: F.struct(i.alias("i"), F.lit(crossing).alias("crossing"), F.lit(lefts).alias("lefts"), F.lit(rights).alias("rights"))
    marks = F.array(mark(F.lit(0), 0, 0, 1), mark(after, 1, 0, -1), mark(F.greatest(after, until), -1, 0, 0), mark(until, 0, 1, 0))
    rows = lines.select(*PAGE, F.explode(marks).alias("m")).select(*PAGE, "m.*").groupBy(*PAGE, "i").agg(*[F.sum(c).alias(c) for c in ("crossing", "lefts", "rights")])
    grid = lines.select(*PAGE).distinct().select(*PAGE, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    running = Window.partitionBy(*PAGE).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sides = grid.join(rows, [*PAGE, "i"], "left").select(*PAGE, "i", *[F.sum(F.coalesce(c, F.lit(0))).over(running).alias(c) for c in ("crossing", "lefts", "rights")])
    best = F.min(F.struct("crossing", (F.col("i") * step + left).alias("gutter"), "lefts", "rights"))
    return sides.groupBy(*PAGE).agg(best.alias("b")).select(*PAGE, "b.*")


def column_of(cells: DataFrame, starts: DataFrame, slack: float = 6.0) -> DataFrame:
    """As-of lookup: each cell (doc, page, id, x) with the last column start (doc, page, col, x0) at or before x + slack."""
    both = starts.select(*PAGE, F.col("x0").cast("double").alias("at"), F.lit(0).alias("kind"), F.col("col"), F.lit(None).alias("id")).unionByName(cells.select(*PAGE, (F.col("x") + slack).cast("double").alias("at"), F.lit(1).alias("kind"), F.lit(None).alias("col"), "id"))
    w = Window.partitionBy(*PAGE).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("col", F.last("col", True).over(w)).filter("kind = 1").select(*PAGE, "id", "col")


def margins(lines: DataFrame, width: float = 612.0) -> DataFrame:
    """(doc, left, right): upper medians over pages of the leftmost start and of the 97th percentile of ends (x0, x1), kept
    on a page of `width`; the right margin is never wider than the left."""
    left = upper_median(lines.groupBy(*PAGE).agg(F.min("x0").alias("left")), ["doc"], "left", "left")
    ends = upper_median(floor_percentile(lines, PAGE, "x1", 0.97, "end"), ["doc"], "end", "end")
    low = F.greatest(F.lit(18.0), F.col("left"))
    return left.join(ends, "doc").select("doc", low.alias("left"), F.least(F.lit(width - 18), F.greatest(F.col("end"), low + 100, F.lit(width) - low)).alias("right"))


def heading_sizes(lines: DataFrame, least: float = 1.2, longest: int = 120) -> DataFrame:
    """(doc, size, tier): the three largest sizes of short lines (doc, size, chars, seq), `least` times the body's or more.
    The body's size is that of most characters, of equal ones the first."""
    body = weighted_mode(lines, ["doc"], "size", "chars", "seq", "body")
    large = lines.join(body, "doc").filter((F.col("size") >= F.col("body") * least) & (F.col("chars") < longest))
    return distinct_top(large, ["doc"], "size", 3)


def heading_levels(paragraphs: DataFrame, tiers: DataFrame, most_lines: int = 3) -> DataFrame:
    """paragraphs (doc, para, size, lines, listed) with level: the first tier (doc, size, tier) within 0.6 of their size, if
    they have few lines and are no list items; else null."""
    near = F.abs(F.col("size") - F.col("__size")) < 0.6
    joined = paragraphs.join(tiers.select("doc", F.col("size").alias("__size"), "tier"), "doc", "left")
    level = F.min(F.when(near & (F.col("lines") <= most_lines) & ~F.col("listed"), F.col("tier")))
    return joined.groupBy("doc", "para").agg(level.alias("level"))


def regions(lines: DataFrame, gutters: DataFrame) -> DataFrame:
    """lines (doc, page, id, x0, x1, y) with their part: 0 above, 1 left, 2 right, 3 below of a two-column band.

    gutters: (doc, page, gutter), null or no row for pages of one column, whose lines are part 0. The band reaches from the
    first to the last line that keeps clear of the gutter.
    """
    g, own = F.col("gutter"), Window.partitionBy(*PAGE)
    rows = lines.join(gutters.select(*PAGE, "gutter"), PAGE, "left")
    clear = F.when((F.col("x1") < g - 2) | (F.col("x0") > g + 2), F.col("y"))
    rows = rows.withColumn("__top", F.min(clear).over(own)).withColumn("__end", F.max(clear).over(own))
    across = (F.col("x0") <= g + 2) & (F.col("x1") >= g - 2)
    part = F.when(g.isNull(), 0).when(across & (F.col("y") < F.col("__top")), 0).when(across & (F.col("y") > F.col("__end")), 3).when(F.col("x0") < g, 1).otherwise(2)
    return rows.select(*lines.columns, part.alias("part"))


def floating(images: DataFrame, lines: DataFrame, least: int = 2) -> DataFrame:
    """images (doc, page, image, x, y, w, h) with floats: whether `least` lines (x0, x1, y, size) or more stand over one."""
    i, t = images.alias("i"), lines.alias("t")
    on = (F.col("i.doc") == F.col("t.doc")) & (F.col("i.page") == F.col("t.page")) & (F.col("t.y") > F.col("i.y")) & (F.col("t.y") - F.col("t.size") < F.col("i.y") + F.col("i.h")) & (F.col("t.x1") > F.col("i.x")) & (F.col("t.x0") < F.col("i.x") + F.col("i.w"))
    over = i.join(t, on).groupBy("i.doc", "i.page", "i.image").count().filter(F.col("count") >= least).drop("count").withColumn("__f", F.lit(True))
    return images.join(over, [*PAGE, "image"], "left").withColumn("floats", F.coalesce("__f", F.lit(False))).drop("__f")


def alignment(lines: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(doc, para, align): center, right, both or left of paragraphs whose lines (doc, para, seq, x0, x1, left, right) lie
    between the margins left and right."""
    L, R, x0, x1 = F.col(left), F.col(right), F.col("x0"), F.col("x1")
    last = F.max("seq").over(Window.partitionBy("doc", "para"))
    rows = lines.withColumn("__last", F.col("seq") == last)
    centred = F.every(F.abs((x0 + x1) / 2 - (L + R) / 2) < F.greatest(F.lit(5.0), (R - L) * 0.02))
    found = rows.groupBy("doc", "para").agg(
        centred.alias("centred"),
        F.every(F.abs(x1 - R) < 5).alias("flush"),
        F.count("*").alias("n"),
        F.every(F.col("__last") | (F.abs(x1 - R) < 3.5)).alias("full"),
        F.max(F.when(F.col("__last"), x1 < R - 3)).alias("short"),
        F.min_by(x0 - L, "seq").alias("indent"),
    )
    align = F.when(F.col("centred") & (F.col("indent") > 10), "center").when(F.col("flush") & (F.col("indent") > 30), "right").when((F.col("n") >= 2) & F.col("full") & F.col("short"), "both").otherwise("left")
    return found.select("doc", "para", align.alias("align"))


def page_field(text: Column) -> Column:
    """struct(before, page, between, total, after) of a running line that holds a page number, and maybe a total; else null."""
    pattern = r"^(.*?)(\d+)(\D*?)(?:(\d+)(\D*))?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("before"), part(2).alias("page"), part(3).alias("between"), part(4).alias("total"), part(5).alias("after")))


def numbered_pages(lines: DataFrame, text: str) -> DataFrame:
    """Running lines (doc, page, text) with {page} and {pages} filled in, once all pages of a document are known."""
    pages = F.max("page").over(Window.partitionBy("doc"))
    return lines.withColumn(text, F.replace(F.replace(text, F.lit("{pages}"), pages.cast("string")), F.lit("{page}"), F.col("page").cast("string")))


#: Signs of symbol fonts, with what they show as.
SYMBOLS = {"\uf0b7": "•", "\uf0a7": "▪", "\uf0d8": "►", "\uf0fc": "✓", "\uf076": "❖", "\uf06e": "■", "\uf0a8": "□", "\uf0e0": "→", "\uf0a2": "•", "\uf0b0": "°", "\uf02d": "–"}


def symbols(text: Column, family: Column) -> Column:
    """Private signs of symbol fonts as the ones they show; others of that range as bullets, as is a lone · in Symbol."""
    out = F.regexp_replace(F.translate(text, "".join(SYMBOLS), "".join(SYMBOLS.values())), "[\ue000-\uf8ff]", "•")
    return F.when((family == "Symbol") & (out == "·"), "•").otherwise(out)


def form_pages(lines: DataFrame, pages: DataFrame, wide: float = 0.55) -> DataFrame:
    """(doc, page, form): whether a page is a form rather than prose.

    lines: (doc, page, seq, x0, x1, segments, chars, boxed), boxed the characters within boxes; pages: (doc, page, edges,
    grids, boxes). Prose are lines of one segment, `wide` of the text's width or more, with another such line above or below.
    """
    own, by = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE).orderBy("seq")
    width = F.greatest(F.lit(1.0), F.max("x1").over(own) - F.min("x0").over(own))
    rows = lines.withColumn("__long", (F.col("segments") == 1) & (F.col("x1") - F.col("x0") >= width * wide) & (F.col("chars") >= 35))
    prose = F.col("__long") & (F.coalesce(F.lag("__long").over(by), F.lit(False)) | F.coalesce(F.lead("__long").over(by), F.lit(False)))
    rows = rows.withColumn("__prose", F.when(prose, F.col("chars")).otherwise(0))
    sums = rows.groupBy(*PAGE).agg(F.sum("chars").alias("total"), F.sum("__prose").alias("prose"), F.sum("boxed").alias("boxed"), F.avg((F.col("segments") >= 2).cast("double")).alias("multi"))
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    all_ = pages.join(sums, PAGE, "left")
    form = ((F.least(F.lit(1.0), share("boxed")) >= 0.3) & (F.col("edges") >= 8) & (share("prose") < 0.55)) | ((F.col("grids") >= 2) & (share("prose") < 0.5)) | ((F.col("boxes") >= 4) & (share("prose") < 0.5)) | ((F.col("multi") >= 0.4) & (F.col("edges") >= 4) & (share("prose") < 0.55))
    return all_.select(*PAGE, F.coalesce(F.col("total").isNotNull() & form, F.lit(False)).alias("form"))


def line_pitch(lines: DataFrame) -> DataFrame:
    """(doc, pitch): the upper median of the steps between neighbouring lines."""
    w = Window.partitionBy(*PAGE).orderBy("y")
    return upper_median(lines.withColumn("step", F.lead("y").over(w) - F.col("y")).filter("step > 0"), ["doc"], "step", "pitch")


def forced_breaks(pages: DataFrame, full: float = 0.72) -> DataFrame:
    """Pages (doc, page, bottom, height, first_kind) before which a break is forced: the one before ends early, or this one opens with a main heading."""
    w = Window.partitionBy("doc").orderBy("page")
    early = F.lag(F.col("bottom") / F.col("height")).over(w) < full
    return pages.withColumn("forced", F.coalesce(early, F.lit(False)) | ((F.col("first_kind") == "h1") & F.lag("page").over(w).isNotNull()))


def paginated(blocks: DataFrame, full: float) -> DataFrame:
    """blocks (doc, seq, height, keep_next, break_before) with their page, from 1, and top on it.

    A block that no longer fits opens a page, as does one with break_before. Blocks that keep with the next one move
    together, unless they fill more than a page. Blocks are sorted by document and order, and a task walks over them with one
    page's height in hand. Blocks at the same place of a document come in the order of their heights.
    """
    w = Window.partitionBy("doc").orderBy("seq", "height")
    rows = blocks.select("doc", "seq", F.col("height").cast("double").alias("height"), F.coalesce("keep_next", F.lit(False)).alias("keep"), F.coalesce("break_before", F.lit(False)).alias("fresh"))
    rows = rows.withColumn("chain", F.sum(F.when(F.lag("keep", 1, False).over(w), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("doc", "chain")
    rows = rows.withColumn("whole", F.sum("height").over(chain)).withColumn("first", F.row_number().over(chain.orderBy("seq", "height")) == 1)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, page, used = object(), 1, 0.0
        for batch in batches:
            pages, tops = [], []
            for own, height, fresh, whole, first in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if own != doc:
                    doc, page, used = own, 1, 0.0
                together = first and whole <= full and used + whole > full
                if used and (fresh or together or used + height > full):
                    page, used = page + 1, 0.0
                pages.append(page)
                tops.append(used)
                used += height
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(pages, pa.int32()), pa.array(tops, pa.float64())], ["doc", "seq", "height", "page", "top"])

    ordered = rows.select("doc", "seq", "height", "fresh", "whole", "first").repartition("doc").sortWithinPartitions("doc", "seq", "height")
    return ordered.mapInArrow(walk, f"doc {kinds['doc']}, seq {kinds['seq']}, height double, page int, top double")


def page_mode(glyphs: Column, images: Column, is_form: Column) -> Column:
    return F.when((glyphs == 0) & (images > 0), "scan").when(is_form, "fixed").otherwise("flow")


def best_density(sizes: DataFrame, presets: list[tuple[str, float, float]]) -> DataFrame:
    """(doc, preset, pages) of the first preset that keeps within the doc's target, else of that with the fewest pages.

    sizes: (doc, height, target); presets: a few (name, scale, page height) in order, tried side by side in each row.
    """
    tried = []
    for i, (name, scale, page) in enumerate(presets):
        n = F.ceil(F.col("height") * scale / page)
        over = n > F.col("target")
        tried.append(F.struct(over.alias("over"), F.when(over, n).alias("n"), F.lit(i).alias("ord"), F.lit(name).alias("preset"), n.alias("pages")))
    return sizes.select("doc", F.array_min(F.array(*tried)).alias("b")).select("doc", "b.preset", "b.pages")


#: Patterns of font names in order, with the family of equal widths that stands in; serif faces only without "sans".
FAMILIES = [
    ("calibri|carlito|aptos|segoe|verdana|tahoma|open sans|lato|source sans", "Carlito"),
    ("cambria|caladea", "Caladea"),
    ("courier|consolas|mono|menlo|monaco|lucida console|cousine|code", "Cousine"),
    ("^(?!.*sans).*(?:times|tinos|georgia|garamond|book antiqua|palatino|century|baskerville|serif|minion|constantia|bookman|cochin|didot|rockwell)", "Tinos"),
]


def font_family(name: Column) -> Column:
    """The family that stands in for a font; Arimo where no pattern fits, and for null."""
    out = F
    for pattern, family in FAMILIES:
        out = out.when(name.rlike(f"(?i){pattern}"), family)
    return out.otherwise("Arimo")
