"""Queries of page conversion: blocks, tables and grids, over geometry made from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import flow as W
from ..operators import graphics as D
from ..operators import grids as G
from .registry import query, table

ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def segments(spark, sf):
    """All of lineitem as lines of one to three segments: 32 orders make a document, and four orders in a row lines of one kind."""
    k = F.expr("l_orderkey div 4 % 5")
    doc, page = F.expr("l_orderkey div 32"), F.expr("l_linenumber % 2")
    rows = table(spark, sf, "lineitem").withColumn("line", F.row_number().over(Window.partitionBy(doc, page).orderBy(*ORDER.split(", "))))
    low, supp = F.col("l_partkey"), F.col("l_suppkey")
    item = F.concat(F.element_at(F.array(*map(F.lit, ["• ", "- ", "1. ", "(a) ", "iv. ", "250) ", ""])), (supp % 7 + 1).cast("int")), F.lit("value of "), low.cast("string"))
    end = F.when(supp % 6 == 0, 150.0).otherwise(298.0 + low % 3)
    prose = F.concat(F.when(low % 4 == 0, "The").otherwise("some"), F.lit(" words of "), supp.cast("string"), F.when(low % 3 == 0, ".").otherwise(""))
    seg = lambda x0, x1, text, on: F.when(on, F.struct(x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), text.alias("text")))
    number = low.cast("string")
    found = (
        F.when(k < 2, F.array(seg(F.lit(10) + low % 3, F.lit(60), number, supp % 5 > 0), seg(F.lit(120) + supp % 4, F.lit(180), number, low % 7 > 0), seg(F.lit(250), F.lit(290), number, F.col("l_quantity") % 2 == 0)))
        .when(k == 2, F.array(seg(F.lit(10) + low % 2, end, prose, F.lit(True))))
        .when(k == 3, F.array(seg(F.lit(20), F.lit(200), item, F.lit(True))))
        .otherwise(F.array(seg(F.lit(10), F.lit(300), F.concat(prose, F.when(supp % 2 == 0, " ..... 12").otherwise("")), F.lit(True))))
    )
    y, size = F.col("line") * 12 + F.when(low % 9 == 0, 6.0).otherwise(0.0), F.when(low % 13 == 0, 14.0).otherwise(10.0)
    rows = rows.select(doc.alias("doc"), page.alias("page"), F.lit(0).alias("part"), "line", y.alias("y"), size.alias("size"), (supp % 11 == 0).alias("bold"), (low % 17 == 0).alias("label"), F.explode(F.filter(found, lambda s: s.isNotNull())).alias("s"))
    return rows.select("*", "s.*").drop("s")


@query()
def page_blocks(spark, sf):
    """What a line belongs to depends on the blocks before it; a plain version stands in the tests."""
    out = B.blocks(B.lines_of_segments(segments(spark, sf)), F.lit(10.0))
    return out.select("doc", "page", "line", "block", "kind", F.col("marker.fmt").alias("fmt"), F.col("marker.start").alias("start"))


CELLS = f"""l AS (SELECT l_orderkey // 32 AS doc, row_number() OVER (PARTITION BY l_orderkey // 32 ORDER BY {ORDER}) AS line, l_partkey AS p, l_suppkey AS s, l_quantity AS q FROM lineitem),
s AS (SELECT doc, line, line * 12 + p % 3 * 2.0 AS y, 10.0 AS size, e.x0, e.text FROM (SELECT *, unnest([{{'x0': 10.0 + p % 3, 'text': 'a' || p, 'on': s % 4 > 0}}, {{'x0': 120.0 + s % 4, 'text': 'b' || s, 'on': true}}, {{'x0': 250.0 + p % 9, 'text': 'c' || p, 'on': q % 2 = 0}}]) AS e FROM l) WHERE e.on),
n AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc ORDER BY x0) <= 6 THEN 0 ELSE 1 END AS fresh FROM s), k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY x0 RANGE UNBOUNDED PRECEDING) AS k FROM n),
c AS (SELECT doc, start, row_number() OVER (PARTITION BY doc ORDER BY start) - 1 AS col FROM (SELECT doc, k, min(x0) AS start FROM k GROUP BY ALL HAVING count(*) >= 2))"""


@query(f"WITH {CELLS} SELECT doc, col::BIGINT AS col, start::DOUBLE AS start, greatest(20.0, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start), 304.0) - start)::DOUBLE AS width FROM c")
def table_columns(spark, sf):
    return B.table_columns(cells(spark, sf), ["doc"], "edge").select("doc", F.col("col").cast("long").alias("col"), "start", "width")


@query(f"""WITH {CELLS}, p AS (SELECT s.*, coalesce((SELECT max(col) FROM c WHERE c.doc = s.doc AND c.start <= s.x0 + 6), 0) AS col FROM s),
m AS (SELECT doc, line, max(y) AS y, min(col) AS least, count(*) AS n FROM p GROUP BY ALL),
o AS (SELECT *, CASE WHEN lag(line) OVER w IS NULL OR (least = 0 AND NOT (n = 1 AND y - lag(y) OVER w < 13)) THEN 1 ELSE 0 END AS opens FROM m WINDOW w AS (PARTITION BY doc ORDER BY line)),
r AS (SELECT doc, line, sum(opens) OVER (PARTITION BY doc ORDER BY line) - 1 AS row FROM o)
SELECT doc, row::BIGINT AS row, col::BIGINT AS col, string_agg(text, chr(10) ORDER BY line, x0) AS text FROM p JOIN r USING (doc, line) GROUP BY ALL""")
def table_cells(spark, sf):
    own = cells(spark, sf)
    rows = B.table_rows(own, B.table_columns(own, ["doc"], "edge"), ["doc"])
    return B.table_cells(rows, ["doc"]).select("doc", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text")


def cells(spark, sf):
    """All of lineitem as lines of tables: 32 orders make one, with rows that are wrapped or lack cells."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    doc = F.expr("l_orderkey div 32")
    rows = table(spark, sf, "lineitem").withColumn("line", F.row_number().over(Window.partitionBy(doc).orderBy(*ORDER.split(", "))))
    piece = lambda x0, text, on: F.when(on, F.struct((F.lit(0.0) + x0).alias("x0"), text.alias("text")))
    found = F.array(piece(10 + p % 3, F.concat(F.lit("a"), p), s % 4 > 0), piece(120 + s % 4, F.concat(F.lit("b"), s), F.lit(True)), piece(250 + p % 9, F.concat(F.lit("c"), p), F.col("l_quantity") % 2 == 0))
    return rows.select(doc.alias("doc"), "line", (F.col("line") * 12 + p % 3 * 2.0).alias("y"), F.lit(10.0).alias("size"), F.lit(300.0).alias("edge"), F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e")).select("doc", "line", "y", "size", "edge", "e.*")


PART_RULES = """t AS (SELECT p_partkey // 6 AS doc, p_partkey % 6 // 3 AS r, p_partkey % 3 AS c, p_partkey AS p, p_size AS s FROM part),
e AS (SELECT doc, o, pos, a, b, w, row_number() OVER (PARTITION BY doc ORDER BY o, pos, a, b, w) AS id FROM (
SELECT doc, 'v' AS o, 40.0 * c + s % 2 * 0.25 AS pos, 20.0 * r - 0.5 AS a, 20.0 * r + 20 AS b, 0.5 + s % 4 * 0.25 AS w FROM t WHERE CASE WHEN c = 0 THEN s <> 7 ELSE s % 3 > 0 END
UNION ALL SELECT doc, 'h', 20.0 * r + s % 2 * 0.25, 40.0 * c, 40.0 * c + 40 + s % 3, 0.5 FROM t WHERE CASE WHEN r = 0 THEN s <> 9 ELSE s % 5 > 0 END
UNION ALL SELECT doc, 'v', 120.0, 20.0 * r, 20.0 * r + 20, 1.0 FROM t WHERE c = 2 UNION ALL SELECT doc, 'h', 40.0, 40.0 * c, 40.0 * c + 40, 1.0 FROM t WHERE r = 1))"""

#: Links by recursion, places by clusters, coverage by running ends; NEAR joins sides to the rules on their line.
NEAR = "ON s.doc = e.doc AND s.grid = e.grid AND s.o = e.o AND abs(s.pos - e.pos) <= 1.2 + e.w / 2 AND e.b > s.a - 1 AND e.a < s.b + 1"
SHARE = "coalesce(sum(CASE WHEN hi IS NOT NULL THEN greatest(0, hi - greatest(lo, coalesce(before, lo))) END), 0) / max(b - a)"


def _share(sides: str) -> str:
    cut = f"SELECT s.*, CASE WHEN e.o IS NOT NULL THEN greatest(s.a, e.a - 1.5) END AS lo, CASE WHEN e.o IS NOT NULL THEN least(s.b, e.b + 1.5) END AS hi FROM {sides} s LEFT JOIN g e {NEAR}"
    return f"SELECT doc, grid, side, o, {SHARE} AS share FROM (SELECT *, max(hi) OVER (PARTITION BY doc, grid, side ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({cut})) GROUP BY ALL"


GRIDS = f"""WITH RECURSIVE {PART_RULES},
k AS (SELECT x.doc, x.id AS a, y.id AS b FROM e x JOIN e y ON x.doc = y.doc AND x.id <> y.id AND CASE WHEN x.o = y.o THEN abs(x.pos - y.pos) <= 1.2 AND x.a <= y.b + 1.5 + greatest(x.w, y.w) AND y.a <= x.b + 1.5 + greatest(x.w, y.w)
ELSE x.pos BETWEEN y.a - 1.5 - greatest(x.w, y.w) AND y.b + 1.5 + greatest(x.w, y.w) AND y.pos BETWEEN x.a - 1.5 - greatest(x.w, y.w) AND x.b + 1.5 + greatest(x.w, y.w) END),
u(doc, id, reach) AS (SELECT doc, id, id FROM e UNION SELECT u.doc, u.id, k.b FROM u JOIN k ON k.doc = u.doc AND k.a = u.reach),
g AS MATERIALIZED (SELECT e.*, grid FROM e JOIN (SELECT doc, id, min(reach) AS grid FROM u GROUP BY ALL) USING (doc, id)),
f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc, grid, o ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS fresh FROM g), q AS (SELECT *, sum(fresh) OVER (PARTITION BY doc, grid, o ORDER BY pos RANGE UNBOUNDED PRECEDING) AS q FROM f),
m AS (SELECT doc, grid, o, avg(pos) AS p FROM q GROUP BY doc, grid, o, q), n AS (SELECT *, row_number() OVER w - 1 AS i, lead(p) OVER w AS nx FROM m WINDOW w AS (PARTITION BY doc, grid, o ORDER BY p)),
l AS (SELECT * FROM n WHERE nx IS NOT NULL), z AS (SELECT doc, grid, o, min(p) AS lo, max(nx) AS hi, count(*) AS n, min(nx - p) AS step FROM l GROUP BY ALL),
x AS (SELECT v.doc, v.grid, v.lo AS x0, v.hi AS x1, h.lo AS y0, h.hi AS y1 FROM z v JOIN z h ON v.doc = h.doc AND v.grid = h.grid AND v.o = 'v' AND h.o = 'h' WHERE v.hi - v.lo >= 20 AND h.hi - h.lo >= 8 AND v.step >= 2.5 AND h.step >= 2.5 AND v.n * h.n >= 2),
o AS (SELECT doc, grid, 0 AS side, 'h' AS o, y0 AS pos, x0 AS a, x1 AS b FROM x UNION ALL SELECT doc, grid, 1, 'h', y1, x0, x1 FROM x UNION ALL SELECT doc, grid, 2, 'v', x0, y0, y1 FROM x UNION ALL SELECT doc, grid, 3, 'v', x1, y0, y1 FROM x),
y AS (SELECT doc, grid FROM ({_share("o")}) GROUP BY ALL HAVING min(share) >= 0.9),
c AS MATERIALIZED (SELECT v.doc, v.grid, h.i AS r, v.i AS c, v.p AS x0, v.nx AS x1, h.p AS y0, h.nx AS y1, (h.i * 100 + v.i)::BIGINT AS id FROM l v JOIN l h ON v.doc = h.doc AND v.grid = h.grid AND v.o = 'v' AND h.o = 'h' SEMI JOIN y ON v.doc = y.doc AND v.grid = y.grid),
i AS (SELECT doc, grid, id * 2 AS side, 'v' AS o, x1 AS pos, y0 AS a, y1 AS b FROM c UNION ALL SELECT doc, grid, id * 2 + 1, 'h', y1, x0, x1 FROM c),
d AS (SELECT s.doc, s.grid, s.side // 2 AS a, s.side // 2 + CASE WHEN o = 'v' THEN 1 ELSE 100 END AS b FROM ({_share("i")}) s WHERE share < 0.75),
j AS (SELECT d.* FROM d SEMI JOIN c ON c.doc = d.doc AND c.grid = d.grid AND c.id = d.b), j2 AS (SELECT * FROM j UNION SELECT doc, grid, b, a FROM j),
w(doc, grid, id, reach) AS (SELECT doc, grid, id, id FROM c UNION SELECT w.doc, w.grid, w.id, j2.b FROM w JOIN j2 ON j2.doc = w.doc AND j2.grid = w.grid AND j2.a = w.reach),
b AS (SELECT doc, grid, region, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM c JOIN (SELECT doc, grid, id, min(reach) AS region FROM w GROUP BY ALL) USING (doc, grid, id) GROUP BY ALL),
rg AS MATERIALIZED (SELECT * FROM b JOIN (SELECT doc, grid FROM b GROUP BY ALL HAVING count(*) >= 2 AND bool_and((r1 - r0 + 1) * (c1 - c0 + 1) = n)) USING (doc, grid))"""


def part_rules(spark, sf):
    """All of part as rules around cells, six parts to a page of two rows: some are left out, some are out of place."""
    p, s = F.col("p_partkey"), F.col("p_size")
    t = table(spark, sf, "part").select(F.expr("p_partkey div 6").alias("doc"), F.expr("p_partkey % 6 div 3").alias("r"), (p % 3).alias("c"), s.alias("s"))
    r, c, s, off = F.col("r") * 20.0, F.col("c") * 40.0, F.col("s"), F.col("s") % 2 * 0.25
    rule = lambda on, o, pos, a, b, w: F.when(on, F.struct(F.lit(o).alias("o"), (F.lit(0.0) + pos).alias("pos"), (F.lit(0.0) + a).alias("a"), (F.lit(0.0) + b).alias("b"), (F.lit(0.0) + w).alias("w")))
    found = F.array(
        rule(F.when(F.col("c") == 0, s != 7).otherwise(s % 3 > 0), "v", c + off, r - 0.5, r + 20, s % 4 * 0.25 + 0.5),
        rule(F.when(F.col("r") == 0, s != 9).otherwise(s % 5 > 0), "h", r + off, c, c + 40 + s % 3, F.lit(0.5)),
        rule(F.col("c") == 2, "v", F.lit(120.0), r, r + 20, F.lit(1.0)),
        rule(F.col("r") == 1, "h", F.lit(40.0), c, c + 40, F.lit(1.0)),
    )
    return t.select("doc", F.lit(0).alias("page"), F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e")).select("doc", "page", "e.*")


@query(f"""{GRIDS}, sd AS (SELECT doc, grid, region, unnest([{{'side': 'top', 'o': 'h', 'pos': y0, 'a': x0, 'b': x1}}, {{'side': 'bottom', 'o': 'h', 'pos': y1, 'a': x0, 'b': x1}}, {{'side': 'left', 'o': 'v', 'pos': x0, 'a': y0, 'b': y1}}, {{'side': 'right', 'o': 'v', 'pos': x1, 'a': y0, 'b': y1}}]) AS t FROM rg),
bd AS (SELECT s.doc, s.grid, s.region, max(w) FILTER (t.side = 'top') AS top, max(w) FILTER (t.side = 'bottom') AS bottom, max(w) FILTER (t.side = 'left') AS "left", max(w) FILTER (t.side = 'right') AS "right"
FROM sd s JOIN g e ON s.doc = e.doc AND s.grid = e.grid AND t.o = e.o AND abs(t.pos - e.pos) <= 1.2 + e.w / 2 AND least(t.b, e.b) - greatest(t.a, e.a) >= (t.b - t.a) * 0.5 GROUP BY ALL)
SELECT doc, r0, r1, c0, c1, round(x0, 4)::DOUBLE AS x0, round(x1, 4)::DOUBLE AS x1, round(y0, 4)::DOUBLE AS y0, round(y1, 4)::DOUBLE AS y1, top::DOUBLE AS top, bottom::DOUBLE AS bottom, "left"::DOUBLE AS "left", "right"::DOUBLE AS "right" FROM rg LEFT JOIN bd USING (doc, grid, region)""")
def grid_cells(spark, sf):
    long = [F.col(c).cast("long").alias(c) for c in ("r0", "r1", "c0", "c1")]
    out = G.borders(G.find_grids(part_rules(spark, sf)))
    return out.select("doc", *long, *[F.round(c, 4).alias(c) for c in ("x0", "x1", "y0", "y1")], "top", "bottom", "left", "right")


@query(f"""{GRIDS}, sg AS (SELECT doc, p AS id, r AS line, 20.0 * r + 14 AS base, 40.0 * c + 2 AS x0, 40.0 * c + 20 + s % 30 AS x1, s || '' AS text FROM t),
held AS (SELECT sg.doc, sg.id, min({{'g': grid, 'r': r0, 'c': c0, 'k': region}}) AS k FROM sg JOIN rg ON sg.doc = rg.doc AND sg.x0 >= rg.x0 - 1 AND sg.x1 <= rg.x1 + 2 AND sg.base - 7.5 >= rg.y0 - 1.5 AND sg.base <= rg.y1 + 1 GROUP BY ALL),
ln AS (SELECT sg.doc, k, line, min(base) AS y, string_agg(text, chr(9) ORDER BY x0) AS text FROM sg JOIN held USING (doc, id) GROUP BY ALL)
SELECT doc, k.r AS r0, k.c AS c0, string_agg(text, chr(10) ORDER BY y, line) AS text FROM ln GROUP BY ALL""")
def grid_texts(spark, sf):
    p, s = F.col("p_partkey"), F.col("p_size")
    r, c = F.expr("p_partkey % 6 div 3"), p % 3
    texts = table(spark, sf, "part").select(F.expr("p_partkey div 6").alias("doc"), F.lit(0).alias("page"), p.alias("id"), r.alias("line"), (r * 20.0 + 14).alias("base"), (r * 20.0 + 14).alias("y"), F.lit(10.0).alias("size"), (c * 40.0 + 2).alias("x0"), (c * 40.0 + 20 + s % 30).alias("x1"), s.cast("string").alias("text"))
    grids = G.find_grids(part_rules(spark, sf))
    out = G.cell_texts(G.placed(texts, grids.regions)).join(grids.regions, [*G.GRID, "region"])
    return out.select("doc", F.col("r0").cast("long").alias("r0"), F.col("c0").cast("long").alias("c0"), "text")


def turn_paragraphs(spark, sf):
    """All turns as paragraphs: the role as a label, a tab, the text; some narrow, indented, hanging, with stops."""
    t, n = F.col("turn"), F.length("text")
    own = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), t.alias("para"), "role", "text", n.alias("n"))
    run = lambda seq, kind, text, label: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(label).alias("label"))
    pieces = F.array(run(0, "text", F.col("role"), True), run(1, "tab", F.lit(None).cast("string"), True), run(2, "text", F.col("text"), False), run(3, "tab", F.lit(None).cast("string"), False), run(4, "text", F.col("role"), False))
    runs = own.select("doc", "para", F.explode(pieces).alias("r"), F.lit("plain").alias("font"), F.when(F.col("n") % 2 == 0, 10.0).otherwise(12.0).alias("size"), (F.col("n") % 7 == 0).alias("caps"), F.lit(None).cast("double").alias("width")).select("doc", "para", "r.*", "font", "size", "caps", "width")
    stop = lambda pos, align: F.struct(F.lit(pos).alias("pos"), F.lit(align).alias("align"))
    stops = F.when(F.col("n") % 3 == 0, F.array(stop(150.0, "center"), stop(290.0, "right"))).when(F.col("n") % 3 == 1, F.array(stop(200.0, "decimal")))
    paragraphs = own.select("doc", "para", F.when(F.col("n") % 5 == 0, 60.0).otherwise(300.0).alias("width"), (F.col("n") % 4 * 10.0).alias("left"), F.lit(5.0).alias("right"), F.when(F.col("n") % 4 > 1, -10.0).otherwise(4.0).alias("first"), stops.alias("stops"), F.lit(36.0).alias("step"), F.element_at(F.array(*map(F.lit, ["left", "right", "center", "both"])), F.col("n") % 4 + 1).alias("align"), F.when(F.col("n") % 3 == 0, "exact").when(F.col("n") % 3 == 1, "atLeast").alias("rule"), F.when(F.col("n") % 3 == 0, 14.0).when(F.col("n") % 3 == 1, 12.0).otherwise(1.15).alias("value"), F.lit("Calibri").alias("font"), F.lit(11.0).alias("size"))
    signs = own.select(F.explode(F.split(F.concat("text", F.upper("text"), "role", F.lit(" ")), "")).alias("sign")).filter("sign <> ''").distinct()
    return runs, paragraphs, signs.select(F.lit("plain").alias("font"), "sign", (0.3 + F.ascii("sign") % 5 * 0.1).alias("w"))


@query()
def broken_lines(spark, sf):
    """Where a line ends depends on the lines before it; a plain version stands in the tests."""
    runs, paragraphs, widths = turn_paragraphs(spark, sf)
    lines = W.broken_lines(W.atoms(runs, widths), paragraphs)
    return W.aligned(lines, paragraphs).select("doc", "para", "line", "seq", "at", "piece", "text", F.round("x", 6).alias("x"))


FLOW = f"""o AS (SELECT l_orderkey // 32 AS doc, l_orderkey // 8 % 4 AS section, l_orderkey AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS line, l_quantity::DOUBLE + 8 AS height, l_partkey AS p, l_suppkey AS s FROM lineitem),
t AS (SELECT *, block % 5 = 0 AS tab, line = 1 AS opens, CASE WHEN block % 5 = 0 THEN line <= 1 + block % 2 END AS header FROM o),
i AS (SELECT *, CASE WHEN opens AND NOT tab THEN (p % 20)::DOUBLE END AS before, CASE WHEN opens AND NOT tab THEN height + s % 60 END AS need, (s % 9)::DOUBLE AS after, NOT tab AND opens AND p % 23 = 0 AS fresh, CASE WHEN tab THEN NULL WHEN p % 31 = 0 THEN 'page' WHEN p % 29 = 0 THEN 'column' END AS brk,
CASE WHEN tab AND NOT header AND line > 1 THEN sum(CASE WHEN header THEN height ELSE 0 END) OVER (PARTITION BY doc, section, block) ELSE 0::DOUBLE END AS again, 1 + section % 3 AS cols, 20::DOUBLE AS top, (320 + section * 10)::DOUBLE AS bottom, section % 2 = 1 AS cont, row_number() OVER (PARTITION BY doc ORDER BY section, block, line) AS k FROM t)"""

#: One step after another, each a query around the one before: section, forced page, keeping together, fit.
STEPS = """SELECT doc, k, section, block, line, height, after, brk, cols, top, page, col, start, y, again,
CASE WHEN over THEN again ELSE 0 END AS repeated FROM (SELECT * REPLACE (CASE WHEN over AND NOT more THEN page + 1 ELSE page END AS page, CASE WHEN over THEN CASE WHEN more THEN col + 1 ELSE 0 END ELSE col END AS col, CASE WHEN over AND NOT more THEN top ELSE start END AS start, CASE WHEN over THEN CASE WHEN more THEN start ELSE top END + again ELSE y END AS y)
FROM (SELECT *, y + height > bottom + 0.01 AND y - start >= 0.01 AS over, col + 1 < cols AS more FROM (SELECT * REPLACE (CASE WHEN kept AND col + 1 >= cols THEN page + 1 ELSE page END AS page, CASE WHEN kept THEN CASE WHEN col + 1 < cols THEN col + 1 ELSE 0 END ELSE col END AS col, CASE WHEN kept AND col + 1 >= cols THEN top ELSE start END AS start,
CASE WHEN kept THEN CASE WHEN col + 1 < cols THEN start ELSE top END ELSE y + space END AS y) FROM (SELECT *, need IS NOT NULL AND y + space + need > bottom + 0.01 AND y - start >= 0.01 AND space + need < bottom - start AS kept
FROM (SELECT *, CASE WHEN need IS NOT NULL AND y - start >= 0.01 THEN before ELSE 0 END AS space FROM (SELECT * REPLACE (CASE WHEN turned THEN page + 1 ELSE page END AS page, CASE WHEN turned THEN 0 ELSE col END AS col, CASE WHEN turned THEN top ELSE start END AS start, CASE WHEN turned THEN top ELSE y END AS y)
FROM (SELECT *, need IS NOT NULL AND fresh AND y - start >= 0.01 AS turned FROM ({}))))))))"""
AFTER = "page + CASE WHEN brk = 'page' OR (brk = 'column' AND col + 1 >= cols) THEN 1 ELSE 0 END AS page, CASE WHEN brk = 'page' OR (brk = 'column' AND col + 1 >= cols) THEN 0 WHEN brk = 'column' THEN col + 1 ELSE col END AS col, CASE WHEN brk = 'page' OR (brk = 'column' AND col + 1 >= cols) THEN top ELSE start END AS start, CASE WHEN brk = 'page' OR (brk = 'column' AND col + 1 >= cols) THEN top WHEN brk = 'column' THEN start ELSE y + height END + after AS y"
NEXT = f"""SELECT i.*, CASE WHEN i.section <> r.section AND NOT i.cont THEN r.page + 1 ELSE r.page END AS page, CASE WHEN i.section <> r.section THEN 0 ELSE r.col END AS col, CASE WHEN i.section <> r.section THEN CASE WHEN i.cont THEN r.y ELSE i.top END ELSE r.start END AS start, CASE WHEN i.section <> r.section AND NOT i.cont THEN i.top ELSE r.y END AS y
FROM (SELECT doc, k, section, {AFTER} FROM r) r JOIN i ON i.doc = r.doc AND i.k = r.k + 1"""


@query(f"""WITH RECURSIVE {FLOW}, r AS ({STEPS.format("SELECT *, 1 AS page, 0 AS col, top AS start, top AS y FROM i WHERE k = 1")}
UNION ALL {STEPS.format(NEXT)}) SELECT doc, section, block, line::BIGINT AS line, page::BIGINT AS page, col::BIGINT AS col, round(y, 4)::DOUBLE AS y, repeated::DOUBLE AS repeated FROM r""")
def flowed_pages(spark, sf):
    """All of lineitem as lines of paragraphs and rows of tables, orders being blocks: sections of one to three columns, some continuous."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf, "lineitem").withColumn("line", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER.split(", "))))
    tab, opens = F.col("l_orderkey") % 5 == 0, F.col("line") == 1
    height = F.col("l_quantity").cast("double") + 8
    items = rows.select(
        F.expr("l_orderkey div 32").alias("doc"),
        F.expr("l_orderkey div 8 % 4").alias("section"),
        F.col("l_orderkey").alias("block"),
        "line",
        height.alias("height"),
        F.when(opens & ~tab, p % 20 * 1.0).alias("before"),
        F.when(opens & ~tab, height + s % 60).alias("need"),
        (s % 9 * 1.0).alias("after"),
        (~tab & opens & (p % 23 == 0)).alias("fresh"),
        F.when(~tab & (p % 31 == 0), "page").when(~tab & (p % 29 == 0), "column").alias("brk"),
        F.when(tab, F.col("line") <= F.col("l_orderkey") % 2 + 1).alias("header"),
    )
    k = F.col("section")
    sections = items.select("doc", "section").distinct().select("doc", "section", (k % 3 + 1).alias("cols"), F.lit(20.0).alias("top"), (k * 10 + 320.0).alias("bottom"), (k % 2 == 1).alias("continuous"))
    out = W.flowed(items, sections)
    return out.select("doc", "section", "block", F.col("line").cast("long").alias("line"), F.col("page").cast("long").alias("page"), F.col("col").cast("long").alias("col"), F.round("y", 4).alias("y"), "repeated")


@query()
def table_boxes(spark, sf):
    """All of lineitem as tables, orders being tables: merged cells lengthen rows one after another; a plain version stands in the tests."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf, "lineitem").withColumn("row", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER.split(", "))) - 1).cast("int"))
    own = rows.select(F.lit(0).alias("doc"), F.col("l_orderkey").alias("table"), "row", p.alias("p"), s.alias("s"), F.col("l_quantity").cast("double").alias("q"))
    merge = F.when(F.col("row") % 3 == 0, "restart").when(F.col("s") % 4 > 0, "continue")
    cell = lambda n, span, merge, content: F.struct(F.lit(n).alias("cell"), span.cast("int").alias("span"), merge.alias("merge"), content.cast("double").alias("content"))
    cells = own.select("doc", "table", "row", F.explode(F.array(cell(0, F.lit(1), merge, F.col("q") * 3), cell(1, 1 + F.col("p") % 2, F.lit(None).cast("string"), F.col("q")), cell(2, F.lit(1), F.when(F.col("row") % 2 == 0, "restart").otherwise("continue"), F.col("q") * 2))).alias("c")).select("doc", "table", "row", "c.*")
    heights = own.select("doc", "table", "row", F.when(F.col("s") % 3 == 0, "exact").when(F.col("s") % 3 == 1, "atLeast").alias("rule"), F.when(F.col("s") % 3 < 2, F.col("p") % 40 * 1.0).alias("value"))
    grid = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.col("table") % 5 * 10.0 + i * 20.0)
    tables = own.select("doc", "table").distinct().select("doc", "table", grid.alias("grid"), F.lit(6.0).alias("indent"), F.element_at(F.array(*map(F.lit, ["left", "center", "right"])), (F.col("table") % 3 + 1).cast("int")).alias("align"), F.lit(300.0).alias("avail"), F.lit(2.0).alias("left"), F.lit(2.0).alias("right"), F.lit(1.0).alias("top"), F.lit(1.0).alias("bottom"))
    return W.table_boxes(tables, cells, heights).select("table", "row", "cell", "col", *[F.round(c, 4).alias(c) for c in "xwyh"])


@query("""SELECT p_partkey, p_size % 3 AS k, round(b.x, 6) AS x, round(b.y, 6) AS y, round(b.w, 6) AS w, round(b.h, 6) AS h, b.d AS direction, b.t::INT AS turn FROM (SELECT *, CASE WHEN abs(g - 270) < 3 THEN {'x': 50 - d * 4, 'y': 80 - n, 'w': d * 5, 'h': n, 'd': 'up', 't': 0}
WHEN abs(g - 90) < 3 THEN {'x': 50 - d, 'y': 80.0::DOUBLE, 'w': d * 5, 'h': n, 'd': 'down', 't': 0} ELSE {'x': 50 + n / 2 * cos(radians(a)) + d * 1.5 * sin(radians(a)) - n / 2, 'y': 80 + n / 2 * sin(radians(a)) - d * 1.5 * cos(radians(a)) - d * 2.5, 'w': n, 'h': d * 5, 'd': 'level', 't': floor(g * 60000 + 0.5)} END AS b
FROM (SELECT *, (a % 360 + 360) % 360 AS g FROM (SELECT p_partkey, p_size, (0.212 * (8 + p_size % 5))::DOUBLE AS d, (length(p_name) * 4 * 1.08 + (8 + p_size % 5) * 0.5)::DOUBLE AS n, (p_partkey * 7 % 800 - 400)::DOUBLE AS a FROM part)))""")
def rotated_boxes(spark, sf):
    p, s = F.col("p_partkey"), F.col("p_size")
    box = D.rotated_box(F.lit(50.0), F.lit(80.0), F.length("p_name") * 4.0, 8 + s % 5, (p * 7 % 800 - 400).cast("double"), F.lit("Helvetica"))
    own = table(spark, sf, "part").select("p_partkey", (s % 3).alias("k"), box.alias("b"))
    return own.select("p_partkey", "k", *[F.round(f"b.{c}", 6).alias(c) for c in "xywh"], "b.direction", "b.turn")


@query("""WITH v AS (SELECT vec_id, unnest(range(len(embedding) // 3)) AS k, embedding AS e FROM embeddings), p AS (SELECT vec_id, k, [floor(abs(e[3 * k + j] * 1000) + CASE WHEN vec_id % 3 = 0 THEN 60 ELSE 0 END)::INT % 256 FOR j IN [1, 2, 3]] AS c, vec_id % 5 = 0 AS dull FROM v),
x AS (SELECT vec_id, k, c[1] AS r, CASE WHEN dull THEN c[1] ELSE c[2] END AS g, CASE WHEN dull THEN c[1] ELSE c[3] END AS b FROM p), l AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y FROM x),
s AS (SELECT vec_id, CASE WHEN greatest(r, g, b) - least(r, g, b) < 40 THEN -1 ELSE (r // 32) * 64 + (g // 32) * 8 + b // 32 END AS q, sum(255 - y) AS w, min(k) AS f, min(y) AS dark FROM l WHERE y <= 215 GROUP BY ALL),
t AS (SELECT vec_id, coalesce(sum(w) FILTER (q < 0), 0) AS n, coalesce(sum(w) FILTER (q >= 0), 0) AS c, arg_max(q, (round(w, 6), -f)) FILTER (q >= 0) AS best, min(dark) FILTER (q < 0) AS dark FROM s GROUP BY 1)
SELECT vec_id, CASE WHEN n < c THEN printf('%02X%02X%02X', best // 64 * 32 + 16, best // 8 % 8 * 32 + 16, best % 8 * 32 + 16) WHEN dark >= 110 THEN repeat(printf('%02X', floor(dark + 0.5)::INT), 3) END AS color FROM t""")
def glyph_colors(spark, sf):
    """All embeddings as pixels of glyphs, three components to a pixel; some glyphs are grey."""
    own = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("embedding") / 3).cast("int") - 1), lambda k: F.slice("embedding", k * 3 + 1, F.lit(3)))).alias("seq", "e"))
    channel = lambda j: (F.floor(F.abs(F.get("e", F.lit(j)) * 1000) + F.when(F.col("vec_id") % 3 == 0, 60).otherwise(0)) % 256).cast("int")
    dull = F.col("vec_id") % 5 == 0
    pixels = own.select("vec_id", "seq", channel(0).alias("r"), F.when(dull, channel(0)).otherwise(channel(1)).alias("g"), F.when(dull, channel(0)).otherwise(channel(2)).alias("b"))
    return D.glyph_colors(pixels, ["vec_id"])


@query()
def drawn_shapes(spark, sf):
    """All of part as drawing operators; matrices stack, so a plain version stands in the tests."""
    return D.shapes(drawing(spark, sf)).select("doc", "seq", "part", "kind", *[F.round(c, 4).alias(c) for c in ("x", "y", "w", "h", "lw")], "filled", "stroked", "color")


def drawing(spark, sf):
    """Each part draws a line, a box or a curve, within a matrix that it sets and takes back; some leave theirs to the next."""
    p, s = F.col("p_partkey"), F.col("p_size").cast("double")
    op = lambda name, *v, text=None: F.struct(F.lit(name).alias("op"), F.array(*[F.lit(0.0) + x for x in v]).cast("array<double>").alias("args"), F.lit(text).cast("string").alias("text"))
    zero = F.lit(0.0)
    line = F.array(op("move", zero, zero), op("line", s, F.when(p % 2 == 0, 0.0).otherwise(s)), op("paint:stroke"))
    box = F.array(op("move", zero, zero), op("line", s, zero), op("line", s, s * 2), op("line", zero, s * 2), op("close"), op("paint:fill+stroke"))
    curve = F.array(op("move", s, s), op("curve", s, zero, zero, s, zero, zero), op("line", zero, s), op("paint:fill"))
    clip = F.array(op("move", s, s), op("line", zero, s), op("paint"))
    drawn = F.when(p % 4 == 0, line).when(p % 4 == 1, box).when(p % 4 == 2, curve).otherwise(clip)
    turn = F.when(p % 3 == 0, F.array(op("transform", zero, F.lit(1.0), F.lit(-1.0), zero, s, zero))).otherwise(F.array(op("transform", F.lit(2.0), zero, zero, F.lit(1.5), s, F.lit(3.0)), op("width", s % 4)))
    ops = F.concat(F.array(op("save")), turn, F.array(op("stroke", text="FF0000")), drawn, F.when(p % 5 == 0, F.array(op("save"))).otherwise(F.array(op("restore"))))
    rows = table(spark, sf, "part").select(F.expr("p_partkey div 16").alias("doc"), F.lit(0).alias("page"), "p_partkey", F.posexplode(ops).alias("k", "o"))
    return rows.select("doc", "page", (F.col("p_partkey") * 100 + F.col("k")).alias("seq"), "o.*")
