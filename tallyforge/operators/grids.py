"""Grids that rules draw on a page: lattices of crossing rules, cells merged where no rule parts them, borders, texts, shading."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import PAGE, components
from .scratch import stored
from .stats import cluster_values

GRID = [*PAGE, "grid"]

#: How far rules on one line lie apart, how much of a frame and of a boundary must be drawn, and least sizes.
SAME, REACH, FRAME, BOUNDARY = 1.2, 1.5, 0.9, 0.75
LEAST_WIDTH, LEAST_HEIGHT, LEAST_STEP, LATTICE = 20.0, 8.0, 2.5, 2.0


class Grids(NamedTuple):
    """edges: (doc, page, grid, o, pos, a, b, w) of the rules of grids; regions: (doc, page, grid, region, r0, r1, c0, c1, x0,
    x1, y0, y1) of their cells, merged ones once."""

    edges: DataFrame
    regions: DataFrame


def joined_rules(edges: DataFrame) -> DataFrame:
    """edges (doc, page, o, pos, a, b, w, ...) with grid: rules that touch share it. Rules of one direction touch if they lie on
    one line and overlap or nearly do, others if they cross or nearly do; all by their widths."""
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("o", "pos", "a", "b", "w"))
    rules = stored(edges.withColumn("id", number))
    sides = [rules.select(*[F.col(c).alias(c if c in PAGE else f"{n}_{c}") for c in (*PAGE, "id", "o", "pos", "a", "b", "w")]) for n in "xy"]
    slack = F.greatest("x_w", "y_w") + 1.5

    def spans(pos: str, low: str, high: str) -> Column:
        return (F.col(pos) >= F.col(low) - slack) & (F.col(pos) <= F.col(high) + slack)

    along = (F.col("x_o") == F.col("y_o")) & (F.abs(F.col("x_pos") - F.col("y_pos")) <= SAME) & (F.col("x_a") <= F.col("y_b") + slack) & (F.col("y_a") <= F.col("x_b") + slack)
    across = (F.col("x_o") != F.col("y_o")) & spans("x_pos", "y_a", "y_b") & spans("y_pos", "x_a", "x_b")
    links = sides[0].join(sides[1], PAGE).filter((F.col("x_id") < F.col("y_id")) & (along | across)).select(*PAGE, F.col("x_id").alias("a_id"), F.col("y_id").alias("b_id"))
    found = components(rules.select(*PAGE, "id"), links).withColumnRenamed("component", "grid")
    return stored(rules.join(found, [*PAGE, "id"]).drop("id"))


def drawn(sides: DataFrame, edges: DataFrame) -> DataFrame:
    """sides (doc, page, grid, side, o, pos, a, b) with share: how much of them the union of rules on their line covers."""
    s, e = sides.alias("s"), edges.alias("e")
    on = [F.col(f"s.{c}") == F.col(f"e.{c}") for c in (*GRID, "o")]
    near = (F.abs(F.col("s.pos") - F.col("e.pos")) <= F.col("e.w") / 2 + SAME) & (F.col("e.b") > F.col("s.a") - 1) & (F.col("e.a") < F.col("s.b") + 1)
    cut = s.join(e, [*on, near], "left").select("s.*", F.greatest(F.col("s.a"), F.col("e.a") - REACH).alias("__from"), F.least(F.col("s.b"), F.col("e.b") + REACH).alias("__to"), F.col("e.o").isNotNull().alias("__on"))
    before = Window.partitionBy(*GRID, "side").orderBy("__from", "__to").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("__to") - F.greatest("__from", F.coalesce(F.max("__to").over(before), F.col("__from")))
    own = cut.withColumn("__fresh", F.when(F.col("__on"), F.greatest(F.lit(0.0), fresh)).otherwise(0.0))
    return own.groupBy(*sides.columns).agg((F.sum("__fresh") / (F.max("b") - F.max("a"))).alias("share"))


def _lattice(rules: DataFrame, o: str, name: str) -> DataFrame:
    """(doc, page, grid, at, low, high): the steps between neighbouring places of a grid's rules of one direction."""
    places = cluster_values(rules.filter(F.col("o") == o), GRID, "pos", LATTICE)
    own = Window.partitionBy(*GRID).orderBy("mean")
    rows = places.withColumn("at", F.row_number().over(own) - 1).withColumn("high", F.lead("mean").over(own))
    rules_of = rules.filter(F.col("o") == o).groupBy(*GRID).agg(F.count("*").alias("__rules")).filter("__rules >= 2")
    return rows.filter("high IS NOT NULL").join(rules_of, GRID, "left_semi").select(*GRID, F.col("at").alias(name), F.col("mean").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))


def find_grids(edges: DataFrame) -> Grids:
    """Grids that edges (doc, page, o, pos, a, b, w) draw: lattices of two cells or more, at least 20 by 8, without double rules,
    whose outer frame is closed. Cells that no rule parts are one; a lattice of which such a group is no rectangle, or that
    is one group only, is no grid. Without edges there is no grid; repeated edges change nothing but what their width does."""
    rules = joined_rules(edges)
    columns, rows = _lattice(rules, "v", "c"), _lattice(rules, "h", "r")
    extent = lambda df, n, least: df.groupBy(*GRID).agg(F.min(f"{n}_low").alias(f"{n}0"), F.max(f"{n}_high").alias(f"{n}1"), F.count("*").alias(f"{n}n"), F.min(F.col(f"{n}_high") - F.col(f"{n}_low")).alias(f"{n}s")).filter((F.col(f"{n}1") - F.col(f"{n}0") >= least) & (F.col(f"{n}s") >= LEAST_STEP))
    frames = extent(columns, "c", LEAST_WIDTH).join(extent(rows, "r", LEAST_HEIGHT), GRID).filter("cn * rn >= 2")
    side = lambda n, o, pos, a, b: F.struct(F.lit(n).cast("long").alias("side"), F.lit(o).alias("o"), F.col(pos).alias("pos"), F.col(a).alias("a"), F.col(b).alias("b"))
    outer = frames.select(*GRID, F.explode(F.array(side(0, "h", "r0", "c0", "c1"), side(1, "h", "r1", "c0", "c1"), side(2, "v", "c0", "r0", "r1"), side(3, "v", "c1", "r0", "r1"))).alias("s")).select(*GRID, "s.*")
    closed = drawn(outer, rules).groupBy(*GRID).agg(F.min("share").alias("least")).filter(F.col("least") >= FRAME).select(*GRID)
    closed = stored(closed)
    place = (F.col("grid").cast("long") * (1 << 40)).alias("__p")
    cells = stored(columns.join(closed, GRID, "left_semi").join(rows, GRID).withColumn("id", place + F.col("r") * (1 << 20) + F.col("c")))
    right = cells.select(*GRID, (F.col("id") * 2).alias("side"), F.lit("v").alias("o"), F.col("c_high").alias("pos"), F.col("r_low").alias("a"), F.col("r_high").alias("b"))
    below = cells.select(*GRID, (F.col("id") * 2 + 1).alias("side"), F.lit("h").alias("o"), F.col("r_high").alias("pos"), F.col("c_low").alias("a"), F.col("c_high").alias("b"))
    a_id = F.expr("shiftright(side, 1)")
    open_ = drawn(right.union(below), rules).filter(F.col("share") < BOUNDARY).select(*PAGE, a_id.alias("a_id"), (a_id + F.when(F.col("o") == "v", 1).otherwise(1 << 20)).alias("b_id"))
    inner = open_.join(cells.select(*PAGE, F.col("id").alias("b_id")), [*PAGE, "b_id"], "left_semi")
    named = components(cells.select(*PAGE, "id"), inner).join(cells, [*PAGE, "id"])
    bounds = [F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("c_low").alias("x0"), F.max("c_high").alias("x1"), F.min("r_low").alias("y0"), F.max("r_high").alias("y1"), F.count("*").alias("n")]
    regions = named.groupBy(*GRID, F.col("component").alias("region")).agg(*bounds)
    whole = (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1) == F.col("n")
    own = Window.partitionBy(*GRID)
    kept = regions.withColumn("__ok", F.every(whole).over(own) & (F.count("*").over(own) >= 2)).filter("__ok").drop("__ok", "n")
    kept = stored(kept)
    return Grids(rules.join(kept.select(*GRID).distinct(), GRID, "left_semi"), kept)


def borders(grids: Grids) -> DataFrame:
    """regions with top, bottom, left and right: the width of the widest rule along half of that side or more, else null."""
    side = lambda n, o, pos, a, b: F.struct(F.lit(n).alias("side"), F.lit(o).alias("o"), F.col(pos).alias("pos"), F.col(a).alias("a"), F.col(b).alias("b"))
    sides = F.array(side("top", "h", "y0", "x0", "x1"), side("bottom", "h", "y1", "x0", "x1"), side("left", "v", "x0", "y0", "y1"), side("right", "v", "x1", "y0", "y1"))
    s, e = grids.regions.select(*GRID, "region", F.explode(sides).alias("s")).select(*GRID, "region", "s.*").alias("s"), grids.edges.alias("e")
    on = [F.col(f"s.{c}") == F.col(f"e.{c}") for c in (*GRID, "o")]
    along = (F.abs(F.col("s.pos") - F.col("e.pos")) <= F.col("e.w") / 2 + SAME) & (F.least("s.b", "e.b") - F.greatest("s.a", "e.a") >= (F.col("s.b") - F.col("s.a")) * 0.5)
    widest = [F.max(F.when(F.col("s.side") == n, F.col("e.w"))).alias(n) for n in ("top", "bottom", "left", "right")]
    found = s.join(e, [*on, along]).groupBy(*[F.col(f"s.{c}").alias(c) for c in (*GRID, "region")]).agg(*widest)
    return grids.regions.join(found, [*GRID, "region"], "left")


def placed(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """segments (doc, page, id, x0, x1, base, size, ...) with the grid and region that hold them, the first of several; else null."""
    top = F.col("s.base") - F.col("s.size") * 0.75
    inside = (F.col("s.x0") >= F.col("r.x0") - 1) & (F.col("s.x1") <= F.col("r.x1") + 2) & (top >= F.col("r.y0") - 1.5) & (F.col("s.base") <= F.col("r.y1") + 1)
    on = [F.col(f"s.{c}") == F.col(f"r.{c}") for c in PAGE]
    found = segments.alias("s").join(regions.alias("r"), [*on, inside]).groupBy(*[F.col(f"s.{c}").alias(c) for c in (*PAGE, "id")]).agg(F.min(F.struct("r.grid", "r.r0", "r.c0", "r.region")).alias("__at"))
    return segments.join(found, [*PAGE, "id"], "left").select(*segments.columns, F.col("__at.grid").alias("grid"), F.col("__at.region").alias("region"))


def cell_texts(segments: DataFrame) -> DataFrame:
    """(doc, page, grid, region, text): the text of each region that holds placed() segments (line, y, x0, x1, text): its
    lines from top to bottom, their pieces a tab apart."""
    own = segments.filter("region IS NOT NULL").groupBy(*GRID, "region", "line").agg(F.min("y").alias("y"), F.array_sort(F.collect_list(F.struct("x0", "id", "text"))).alias("s"))
    lines = own.select(*GRID, "region", "y", "line", F.array_join(F.transform("s", lambda s: s["text"]), "\t").alias("text"))
    texts = lines.groupBy(*GRID, "region").agg(F.array_sort(F.collect_list(F.struct("y", "line", "text"))).alias("s"))
    return texts.select(*GRID, "region", F.array_join(F.transform("s", lambda s: s["text"]), "\n").alias("text"))


def shaded(fills: DataFrame, regions: DataFrame) -> DataFrame:
    """regions with fill: the colour of the first filled rectangle (doc, page, shape, x, y, w, h, color) that whole cells make up
    to nine tenths or more, and that holds them; else null."""
    f, r = fills.filter("w > 3 AND h > 3").alias("f"), regions.alias("r")
    on = [F.col(f"f.{c}") == F.col(f"r.{c}") for c in PAGE]
    held = (F.col("r.x0") >= F.col("f.x") - 1.5) & (F.col("r.x1") <= F.col("f.x") + F.col("f.w") + 1.5) & (F.col("r.y0") >= F.col("f.y") - 1.5) & (F.col("r.y1") <= F.col("f.y") + F.col("f.h") + 1.5)
    both = f.join(r, [*on, held]).select("r.doc", "r.page", "r.grid", "r.region", "f.shape", "f.color", (F.col("f.w") * F.col("f.h")).alias("whole"), ((F.col("r.x1") - F.col("r.x0")) * (F.col("r.y1") - F.col("r.y0"))).alias("area"))
    full = both.withColumn("__sum", F.sum("area").over(Window.partitionBy(*GRID, "shape"))).filter(F.col("__sum") >= F.col("whole") * 0.9)
    colours = full.groupBy(*GRID, "region").agg(F.min_by("color", "shape").alias("fill"))
    return regions.join(colours, [*GRID, "region"], "left")


def cut_at_rules(glyphs: DataFrame, edges: DataFrame, gap: float = 0.55, least: float = 3.0) -> DataFrame:
    """glyphs (doc, page, line, seq, x, w, y, size, joined) with seg, from 0 in each line: a new one begins after more than a word's
    gap, unless joined, and wherever an upright rule stands between two glyphs."""
    own = Window.partitionBy(*PAGE, "line").orderBy("x", "seq")
    rows = glyphs.withColumn("__end", F.lag(F.col("x") + F.col("w")).over(own)).withColumn("__size", F.greatest("size", F.lag("size").over(own)))
    g, e = rows.alias("g"), edges.filter("o = 'v'").alias("e")
    between = (F.col("e.pos") > F.col("g.__end") - 0.5) & (F.col("e.pos") < F.col("g.x") + 0.5) & (F.col("e.a") <= F.col("g.y") + 1) & (F.col("e.b") >= F.col("g.y") - F.col("g.__size") * 0.7)
    parted = g.join(e, [*[F.col(f"g.{c}") == F.col(f"e.{c}") for c in PAGE], between], "left_semi").select(*PAGE, "line", "seq").withColumn("__rule", F.lit(True))
    apart = F.col("__rule").isNotNull() | (~F.coalesce("joined", F.lit(False)) & (F.col("x") - F.col("__end") > F.greatest(F.col("__size") * gap, F.lit(least))))
    rows = rows.join(parted, [*PAGE, "line", "seq"], "left").withColumn("__new", F.when(F.col("__end").isNotNull() & apart, 1).otherwise(0))
    return rows.withColumn("seg", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("__end", "__size", "__rule", "__new")
