"""Queries of layout kernels over geometry made from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import lists as N
from .registry import query, table

ORDER = "l_linenumber, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"
LINES = f"SELECT l_orderkey // 32 AS doc, l_linenumber AS page, (l_orderkey // 32) * 100000 + row_number() OVER (PARTITION BY l_orderkey // 32 ORDER BY {ORDER}) AS id, l_quantity * 4 AS x0, l_quantity * 4 + 40 + l_tax * 500 AS x1, l_extendedprice / 100 AS y, l_discount * 100 + 8 AS size, l_suppkey % 140 AS chars FROM lineitem"


def lines(spark, sf):
    """All of lineitem as lines of text on pages: 32 orders make a document, so pages stay small however large the table."""
    doc = F.expr("l_orderkey div 32")
    number = F.row_number().over(Window.partitionBy(doc).orderBy(*ORDER.split(", "))) + doc * 100000
    q, tax = F.col("l_quantity"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(doc.alias("doc"), F.col("l_linenumber").alias("page"), number.alias("id"), (q * 4).alias("x0"), (q * 4 + 40 + tax * 500).alias("x1"), (F.col("l_extendedprice") / 100).alias("y"), (F.col("l_discount") * 100 + 8).alias("size"), (F.col("l_suppkey") % 140).alias("chars"))


@query(f"""WITH l AS MATERIALIZED ({LINES}), p AS MATERIALIZED (SELECT x.id AS a_id, y.id AS b_id, x.x0 AS s, x.x1 AS t, y.x0 AS u, y.x1 AS v FROM l x JOIN l y USING (doc, page))
SELECT a_id, b_id FROM p WHERE a_id <> b_id AND least(t, v) - greatest(s, u) > 0 AND least(t, v) - greatest(s, u) >= 0.5 * least(t - s, v - u)""")
def interval_overlap(spark, sf):
    own = lines(spark, sf)
    return L.overlapping(own, own, "x0", "x1", 0.5).select("a_id", "b_id")


@query(f"""WITH l AS ({LINES}), b AS (SELECT doc, page, id AS box, x0, x0 + 20 AS x1, y - 20 AS y0, y + 20 AS y1 FROM l WHERE id % 5 = 0)
SELECT l.id, coalesce(min(box), -1) AS box FROM l LEFT JOIN b ON l.doc = b.doc AND l.page = b.page AND l.x0 BETWEEN b.x0 AND b.x1 AND l.y BETWEEN y0 AND y1 GROUP BY l.id""")
def point_in_box(spark, sf):
    own = lines(spark, sf)
    boxes = own.filter("id % 5 = 0").select("doc", "page", F.col("id").alias("box"), "x0", (F.col("x0") + 20).alias("x1"), (F.col("y") - 20).alias("y0"), (F.col("y") + 20).alias("y1"))
    return L.inside(own.select("doc", "page", "id", F.col("x0").alias("x"), "y"), boxes, "box", ["box"]).select("id", F.coalesce("box", F.lit(-1)).alias("box"))


@query(f"WITH l AS ({LINES}) SELECT DISTINCT x.id FROM l x JOIN l y ON x.doc = y.doc AND x.page = y.page AND x.id <> y.id AND abs(x.x0 - y.x0) <= 8 AND abs(x.x1 - y.x1) <= 8 AND abs(x.y - y.y) <= 36")
def justified_lines(spark, sf):
    own = lines(spark, sf).withColumn("size", F.lit(12.0)).withColumn("words", F.lit(6))
    return L.justified(own, 8.0).select("id")


@query(f"""WITH RECURSIVE l AS ({LINES}), e AS (SELECT x.doc, x.page, x.id AS a, y.id AS b FROM l x JOIN l y ON x.doc = y.doc AND x.page = y.page AND x.id <> y.id AND abs(x.x0 - y.x0) <= 4 AND abs(x.y - y.y) <= 60),
r(id, reach) AS (SELECT id, id FROM l UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach) SELECT id, min(reach) AS component FROM r GROUP BY 1""")
def touching_components(spark, sf):
    own = lines(spark, sf)
    a, b = own.alias("a"), own.alias("b")
    on = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.id") < F.col("b.id")) & (F.abs(F.col("a.x0") - F.col("b.x0")) <= 4) & (F.abs(F.col("a.y") - F.col("b.y")) <= 60)
    links = a.join(b, on).select("a.doc", "a.page", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))
    return L.components(own, links).select("id", "component")


@query(f"""WITH l AS ({LINES}), g AS (SELECT doc, page, g AS gutter, count(*) FILTER (x0 < g AND x1 > g) AS crossing, count(*) FILTER (x1 <= g) AS lefts, count(*) FILTER (x0 >= g) AS rights FROM l, range(100, 161, 2) t(g) GROUP BY ALL)
SELECT doc, page, crossing, gutter::INT AS gutter, lefts, rights FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY crossing, gutter) AS k FROM g) WHERE k = 1""")
def column_gutters(spark, sf):
    return L.gutters(lines(spark, sf), 100, 160)


@query(f"""WITH l AS ({LINES}), s AS (SELECT doc, page, id AS col, x0 FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, x0 ORDER BY id) AS k FROM l WHERE id % 4 = 0) WHERE k = 1)
SELECT l.id, coalesce(arg_max(s.col, s.x0), -1) AS col FROM l LEFT JOIN s ON l.doc = s.doc AND l.page = s.page AND s.x0 <= l.x0 + 6 GROUP BY l.id""")
def column_lookup(spark, sf):
    own = lines(spark, sf)
    starts = own.filter("id % 4 = 0").groupBy("doc", "page", "x0").agg(F.min("id").alias("col"))
    return L.column_of(own.select("doc", "page", "id", F.col("x0").alias("x")), starts).select("id", F.coalesce("col", F.lit(-1)).alias("col"))


@query(f"""WITH l AS ({LINES}), p AS (SELECT doc, min(x0) AS m, list(x1 ORDER BY x1)[floor(0.97 * (count(*) - 1))::INT + 1] AS e FROM l GROUP BY doc, page),
d AS (SELECT doc, greatest(18.0, list(m ORDER BY m)[count(*) // 2 + 1]) AS l, list(e ORDER BY e)[count(*) // 2 + 1] AS r FROM p GROUP BY 1) SELECT doc, l AS "left", least(282.0, greatest(r, l + 100, 300 - l)) AS "right" FROM d""")
def document_margins(spark, sf):
    return L.margins(lines(spark, sf), 300.0)


@query(f"""WITH l AS ({LINES}), w AS (SELECT doc, size, sum(chars) AS n, min(id) AS f FROM l GROUP BY 1, 2), b AS (SELECT doc, arg_max(size, (n, -f)) AS body FROM w GROUP BY 1)
SELECT doc, size, tier FROM (SELECT DISTINCT doc, size, dense_rank() OVER (PARTITION BY doc ORDER BY size DESC) AS tier FROM l JOIN b USING (doc) WHERE size >= body * 1.2 AND chars < 120) WHERE tier <= 3""")
def heading_sizes(spark, sf):
    return L.heading_sizes(lines(spark, sf).withColumn("seq", F.col("id"))).withColumn("tier", F.col("tier").cast("long"))


@query(f"""WITH l AS ({LINES}), w AS (SELECT doc, size, sum(chars) AS n, min(id) AS f FROM l GROUP BY 1, 2), b AS (SELECT doc, arg_max(size, (n, -f)) AS body FROM w GROUP BY 1),
t AS (SELECT doc, size, tier FROM (SELECT DISTINCT doc, size, dense_rank() OVER (PARTITION BY doc ORDER BY size DESC) AS tier FROM l JOIN b USING (doc) WHERE size >= body * 1.2 AND chars < 120) WHERE tier <= 3),
p AS (SELECT doc, page * 10 + chars // 35 AS para, max(size) AS size, count(*) AS lines FROM l GROUP BY ALL)
SELECT p.doc, para, min(tier) FILTER (abs(p.size - t.size) < 0.6 AND lines <= 3 AND para % 10 <> 2) AS level FROM p LEFT JOIN t USING (doc) GROUP BY ALL""")
def heading_levels(spark, sf):
    own = lines(spark, sf)
    paras = own.groupBy("doc", (F.col("page") * 10 + F.expr("chars div 35")).alias("para")).agg(F.max("size").alias("size"), F.count("*").alias("lines")).withColumn("listed", F.col("para") % 10 == 2)
    out = L.heading_levels(paras, L.heading_sizes(own.withColumn("seq", F.col("id"))))
    return out.withColumn("level", F.col("level").cast("long"))


GUTTERS = "SELECT doc, page, CASE WHEN page % 2 = 1 THEN 130 END AS gutter FROM l GROUP BY ALL"


@query(f"""WITH l AS ({LINES}), g AS ({GUTTERS}), b AS (SELECT doc, page, min(y) AS t, max(y) AS e FROM l JOIN g USING (doc, page) WHERE x1 < gutter - 2 OR x0 > gutter + 2 GROUP BY ALL)
SELECT id, CASE WHEN gutter IS NULL THEN 0 WHEN x0 <= gutter + 2 AND x1 >= gutter - 2 AND y < t THEN 0 WHEN x0 <= gutter + 2 AND x1 >= gutter - 2 AND y > e THEN 3 WHEN x0 < gutter THEN 1 ELSE 2 END AS part FROM l JOIN g USING (doc, page) LEFT JOIN b USING (doc, page)""")
def page_regions(spark, sf):
    own = lines(spark, sf)
    gutters = own.select("doc", "page").distinct().withColumn("gutter", F.when(F.col("page") % 2 == 1, 130))
    return L.regions(own, gutters).select("id", "part")


IMAGES = "SELECT doc, page, id AS image, x0 AS x, y, 30.0 AS w, 200.0 AS h FROM l WHERE chars % 10 = 0"


@query(f"WITH l AS ({LINES}), i AS ({IMAGES}) SELECT image, (SELECT count(*) >= 2 FROM l WHERE l.doc = i.doc AND l.page = i.page AND l.y > i.y AND l.y - l.size < i.y + i.h AND l.x1 > i.x AND l.x0 < i.x + i.w) AS floats FROM i")
def floating_images(spark, sf):
    own = lines(spark, sf)
    images = own.filter("chars % 10 = 0").select("doc", "page", F.col("id").alias("image"), F.col("x0").alias("x"), "y", F.lit(30.0).alias("w"), F.lit(200.0).alias("h"))
    return L.floating(images, own).select("image", "floats")


@query(f"""WITH l AS (SELECT *, page * 10 + chars // 35 AS para FROM ({LINES})), p AS (SELECT *, id = max(id) OVER (PARTITION BY doc, para) AS last FROM l),
a AS (SELECT doc, para, bool_and(abs((x0 + x1) / 2 - 105) < 5) AS centred, bool_and(abs(x1 - 200) < 5) AS flush, count(*) AS n, bool_and(last OR abs(x1 - 200) < 3.5) AS full_, bool_or(last AND x1 < 197) AS short, arg_min(x0 - 10, id) AS indent FROM (SELECT * FROM p) GROUP BY ALL)
SELECT doc, para, CASE WHEN centred AND indent > 10 THEN 'center' WHEN flush AND indent > 30 THEN 'right' WHEN n >= 2 AND full_ AND short THEN 'both' ELSE 'left' END AS align FROM a""")
def paragraph_alignment(spark, sf):
    own = lines(spark, sf).withColumn("para", F.col("page") * 10 + F.expr("chars div 35")).withColumn("seq", F.col("id"))
    return L.alignment(own.withColumn("left", F.lit(10.0)).withColumn("right", F.lit(200.0)))


@query(r"""SELECT page_id, t AS line, regexp_extract(t, p, 1) AS before, regexp_extract(t, p, 2) AS page, regexp_extract(t, p, 3) AS between, regexp_extract(t, p, 4) AS total, regexp_extract(t, p, 5) AS after
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Page ' || page_id || ' of ' || page_id * 2 || ' pages' WHEN 1 THEN '- ' || page_id || ' -' ELSE url END AS t, '^(.*?)(\d+)(\D*?)(?:(\d+)(\D*))?$' AS p FROM pages) WHERE regexp_matches(t, p)""")
def page_fields(spark, sf):
    n = F.col("page_id").cast("string")
    line = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Page "), n, F.lit(" of "), (F.col("page_id") * 2).cast("string"), F.lit(" pages"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("- "), n, F.lit(" -"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", line.alias("line")).select("page_id", "line", L.page_field(F.col("line")).alias("f")).filter("f is not null").select("page_id", "line", "f.*")


@query("SELECT conv_id AS doc, turn AS page, 'Page ' || turn || ' of ' || max(turn) OVER (PARTITION BY conv_id) AS text FROM conversations")
def numbered_pages(spark, sf):
    own = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.lit("Page {page} of {pages}").alias("text"))
    return L.numbered_pages(own, "text")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '• ▪ •' WHEN lang = 'en' THEN '•' ELSE '·' END AS shown FROM documents")
def symbol_glyphs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "\uf0b7 \uf0a7 \ue123").otherwise("·").alias("s"), F.when(F.col("lang") == "en", "Symbol").otherwise("Arial").alias("font"))
    return docs.select("doc_id", L.symbols(F.col("s"), F.col("font")).alias("shown"))


@query(f"""WITH l AS ({LINES}), r AS (SELECT *, page % 3 + 1 AS segments, CASE WHEN size > 12 THEN chars ELSE 0 END AS boxed, greatest(1.0, max(x1) OVER p - min(x0) OVER p) AS width FROM l WINDOW p AS (PARTITION BY doc, page)),
g AS (SELECT *, segments = 1 AND x1 - x0 >= width * 0.1 AND chars >= 35 AS long FROM r), h AS (SELECT *, CASE WHEN long AND (coalesce(lag(long) OVER o, false) OR coalesce(lead(long) OVER o, false)) THEN chars ELSE 0 END AS prose FROM g WINDOW o AS (PARTITION BY doc, page ORDER BY id)),
s AS (SELECT doc, page, sum(chars) AS t, sum(prose) / nullif(sum(chars), 0) AS prose, least(1.0, sum(boxed) / nullif(sum(chars), 0)) AS boxed, avg((segments >= 2)::INT) AS multi FROM h GROUP BY ALL)
SELECT doc, page, (coalesce(boxed, 0) >= 0.3 AND page * 2 >= 8 AND coalesce(prose, 0) < 0.55) OR (doc % 3 >= 2 AND coalesce(prose, 0) < 0.5) OR (doc % 7 >= 4 AND coalesce(prose, 0) < 0.5) OR (multi >= 0.4 AND page * 2 >= 4 AND coalesce(prose, 0) < 0.55) AS form FROM s""")
def form_pages(spark, sf):
    own = lines(spark, sf).withColumn("segments", F.col("page") % 3 + 1).withColumn("boxed", F.when(F.col("size") > 12, F.col("chars")).otherwise(0)).withColumn("seq", F.col("id"))
    pages = own.select("doc", "page").distinct().select("doc", "page", (F.col("page") * 2).alias("edges"), (F.col("doc") % 3).alias("grids"), (F.col("doc") % 7).alias("boxes"))
    return L.form_pages(own, pages, 0.1)


@query(f"""WITH RECURSIVE c AS (SELECT p_partkey // 24 AS doc, p_partkey % 24 AS id, p_partkey % 24 // 6 AS r, p_partkey % 24 % 6 AS c, p_size FROM part),
e AS (SELECT a.doc, a.id AS a, b.id AS b FROM c a JOIN c b ON a.doc = b.doc AND ((b.id = a.id + 1 AND a.c < 5 AND a.p_size % 3 = 0) OR (b.id = a.id + 6 AND a.p_size % 5 = 0))), u AS (SELECT * FROM e UNION SELECT doc, b, a FROM e),
t(doc, id, reach) AS (SELECT doc, id, id FROM c UNION SELECT t.doc, t.id, u.b FROM t JOIN u ON u.doc = t.doc AND u.a = t.reach), g AS (SELECT doc, id, min(reach) AS region FROM t GROUP BY ALL)
SELECT doc, region, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, (max(r) - min(r) + 1) * (max(c) - min(c) + 1) = count(*) AS rectangular FROM g JOIN c USING (doc, id) GROUP BY ALL""")
def merged_cells(spark, sf):
    k = F.col("p_partkey")
    cells = table(spark, sf, "part").select(F.expr("p_partkey div 24").alias("doc"), F.lit(0).alias("page"), (k % 24).alias("id"), F.expr("p_partkey % 24 div 6").alias("r"), (k % 24 % 6).alias("c"), "p_size")
    known = cells.select("doc", "page", F.col("id").alias("b_id"))
    right = cells.filter("c < 5 and p_size % 3 = 0").select("doc", "page", F.col("id").alias("a_id"), (F.col("id") + 1).alias("b_id"))
    below = cells.filter("p_size % 5 = 0").select("doc", "page", F.col("id").alias("a_id"), (F.col("id") + 6).alias("b_id"))
    return L.merged_cells(cells.drop("p_size"), right.union(below).join(known, ["doc", "page", "b_id"], "left_semi")).drop("page")


@query("""WITH s AS (SELECT p_partkey AS shape, p_size::DOUBLE AS w, p_retailprice % 40 AS h, p_partkey % 2 = 0 AS stroked FROM part), e AS (
SELECT shape, unnest(CASE WHEN NOT stroked AND least(w, h) <= 2.5 THEN CASE WHEN w >= h THEN [{'o': 'h', 'pos': 5 + h / 2, 'a': 1.0, 'b': 1 + w, 'w': h}] ELSE [{'o': 'v', 'pos': 1 + w / 2, 'a': 5.0, 'b': 5 + h, 'w': w}] END
WHEN stroked THEN [{'o': 'h', 'pos': 5.0, 'a': 1.0, 'b': 1 + w, 'w': 0.5}, {'o': 'h', 'pos': 5 + h, 'a': 1.0, 'b': 1 + w, 'w': 0.5}, {'o': 'v', 'pos': 1.0, 'a': 5.0, 'b': 5 + h, 'w': 0.5}, {'o': 'v', 'pos': 1 + w, 'a': 5.0, 'b': 5 + h, 'w': 0.5}] END) AS e FROM s)
SELECT shape, e.o AS o, round(e.pos, 4) AS pos, round(e.b, 4) AS b, round(e.w, 4) AS w FROM e WHERE e.b - e.a >= 3""")
def shape_edges(spark, sf):
    shapes = table(spark, sf, "part").select(F.lit(0).alias("doc"), F.lit(0).alias("page"), F.col("p_partkey").alias("shape"), F.lit(1.0).alias("x"), F.lit(5.0).alias("y"), F.col("p_size").alias("w"), (F.col("p_retailprice") % 40).alias("h"), (F.col("p_partkey") % 2 == 0).alias("stroked"), (F.col("p_partkey") % 2 != 0).alias("filled"), F.lit(0.5).alias("lw"))
    return L.edges(shapes).select("shape", "o", F.round("pos", 4).alias("pos"), F.round("b", 4).alias("b"), F.round("w", 4).alias("w"))


GLYPHS = "SELECT conv_id AS doc, 0 AS page, turn // 4 AS line, turn AS seq, role AS s, turn % 4 * 40 + turn % 3 * 2.0 AS x, len(role) * 5.0 AS w, CASE WHEN turn % 5 = 4 THEN 7.0 ELSE 10.0 END AS size, 100.0 - CASE WHEN turn % 5 = 4 THEN 3 ELSE 0 END AS y FROM conversations"


def glyphs(spark, sf):
    t = F.col("turn")
    small = t % 5 == 4
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.lit(0).alias("page"), F.expr("turn div 4").alias("line"), t.alias("seq"), F.col("role").alias("s"), (t % 4 * 40 + t % 3 * 2.0).alias("x"), (F.length("role") * 5.0).alias("w"), F.when(small, 7.0).otherwise(10.0).alias("size"), (100.0 - F.when(small, 3).otherwise(0)).alias("y"))


TAGGED = f"""g AS ({GLYPHS}), n AS (SELECT doc, line, size, sum(len(s)) AS n, min((x, seq)) AS f FROM g GROUP BY ALL), m AS (SELECT doc, line, size AS main FROM (SELECT *, row_number() OVER (PARTITION BY doc, line ORDER BY n DESC, f) AS k FROM n) WHERE k = 1),
b AS (SELECT g.*, main, arg_min(y, (x, seq)) FILTER (abs(size - main) < 0.3) OVER (PARTITION BY g.doc, g.line) AS base FROM g JOIN m USING (doc, line)),
v AS (SELECT *, CASE WHEN size < 0.85 * main AND y < base - 0.12 * main THEN 'super' WHEN size < 0.85 * main AND y > base + 0.08 * main THEN 'sub' END AS vert FROM b)"""


@query(f"WITH {TAGGED} SELECT doc, seq, vert FROM v")
def raised_glyphs(spark, sf):
    return L.tagged(glyphs(spark, sf)).select("doc", "seq", "vert")


SPACED = f"""{TAGGED}, t AS (SELECT *, CASE WHEN coalesce(x - lag(x + w) OVER l > 0.12 * size AND vert IS NULL AND lag(vert IS NULL) OVER l, false) THEN ' ' ELSE '' END AS before FROM v WINDOW l AS (PARTITION BY doc, line ORDER BY x, seq))"""


@query(f"WITH {SPACED} SELECT doc, line, string_agg(before || s, '' ORDER BY x, seq) AS text FROM t GROUP BY ALL")
def segment_texts(spark, sf):
    return L.line_texts(L.tagged(glyphs(spark, sf))).select("doc", "line", "text")


@query(f"""WITH {SPACED}, f AS (SELECT *, CASE WHEN lag(size) OVER p IS NOT NULL AND abs(lag(size) OVER p - size) < 0.3 AND lag(s) OVER p = s AND lag(vert) OVER p IS NOT DISTINCT FROM vert THEN 0 ELSE 1 END AS fresh,
CASE WHEN lead(line) OVER p <> line THEN ' ' ELSE '' END AS after FROM t WINDOW p AS (PARTITION BY doc ORDER BY line, x, seq)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY line, x, seq ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT doc, run::BIGINT AS run, min(s) AS font, string_agg(before || s || after, '' ORDER BY line, x, seq) AS text FROM r GROUP BY doc, run""")
def style_runs(spark, sf):
    own = L.tagged(glyphs(spark, sf)).withColumn("font", F.col("s"))
    return L.style_runs(own, ["font", "vert"]).select("doc", "run", "font", "text")


@query(f"""WITH g AS ({GLYPHS}), b AS (SELECT *, 9 - coalesce(sum(len(s) + 1) OVER (PARTITION BY doc, line ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM g)
SELECT doc, seq, CASE WHEN l > 0 THEN ltrim(s[l::INT + 1:]) ELSE s END AS s, round(x + CASE WHEN l > 0 THEN l * w / len(s) ELSE 0 END, 6) AS x FROM b WHERE l <= 0 OR len(s) > l""")
def marker_removal(spark, sf):
    return L.without_marker(glyphs(spark, sf).withColumn("length", F.lit(9)), "length").select("doc", "seq", "s", F.round("x", 6).alias("x"))


@query()
def assembled_lines(spark, sf):
    """Greedy assembly is beyond SQL; a plain version stands in the tests."""
    return L.lines_of_glyphs(glyphs(spark, sf).drop("line")).select("doc", "seq", "line")


@query("""WITH RECURSIVE b AS (SELECT conv_id AS doc, turn AS seq, (len(text) % 400 + 20)::DOUBLE AS h, turn % 3 = 0 AS keep, turn % 11 = 10 AS fresh FROM conversations),
c AS (SELECT *, sum(CASE WHEN lag_keep THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY seq) AS chain, row_number() OVER (PARTITION BY doc ORDER BY seq) AS i FROM (SELECT *, coalesce(lag(keep) OVER (PARTITION BY doc ORDER BY seq), false) AS lag_keep FROM b)),
g AS (SELECT *, sum(h) OVER (PARTITION BY doc, chain) AS whole, row_number() OVER (PARTITION BY doc, chain ORDER BY seq) = 1 AS opens FROM c),
r(doc, i, seq, page, top, used) AS (SELECT doc, i, seq, 1, 0.0::DOUBLE, h FROM g WHERE i = 1
UNION ALL SELECT doc, i, seq, CASE WHEN over THEN page + 1 ELSE page END, CASE WHEN over THEN 0.0 ELSE used END, CASE WHEN over THEN h ELSE used + h END
FROM (SELECT g.*, r.page, r.used, r.used > 0 AND (g.fresh OR (g.opens AND g.whole <= 700 AND r.used + g.whole > 700) OR r.used + g.h > 700) AS over FROM r JOIN g ON g.doc = r.doc AND g.i = r.i + 1))
SELECT doc, seq, page, top FROM r""")
def pagination(spark, sf):
    t = F.col("turn")
    blocks = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), t.alias("seq"), (F.length("text") % 400 + 20).alias("height"), (t % 3 == 0).alias("keep_next"), (t % 11 == 10).alias("break_before"))
    return L.paginated(blocks, 700.0).select("doc", "seq", "page", "top")


PAGES = "SELECT conv_id AS doc, turn AS page, len(text) % 100 AS bottom, CASE WHEN role = 'system' THEN 'h1' ELSE 'p' END AS kind, len(text) % 3 AS glyphs, turn % 2 AS images, turn % 3 = 0 AS form FROM conversations"


def page_rows(spark, sf):
    n = F.length("text")
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), (n % 100).alias("bottom"), F.lit(100).alias("height"), F.when(F.col("role") == "system", "h1").otherwise("p").alias("first_kind"), (n % 3).alias("glyphs"), (F.col("turn") % 2).alias("images"), (F.col("turn") % 3 == 0).alias("form"))


@query(f"SELECT doc, page, coalesce(lag(bottom) OVER w < 72, false) OR (kind = 'h1' AND lag(page) OVER w IS NOT NULL) AS forced FROM ({PAGES}) WINDOW w AS (PARTITION BY doc ORDER BY page)")
def forced_breaks(spark, sf):
    return L.forced_breaks(page_rows(spark, sf)).select("doc", "page", "forced")


@query(f"SELECT doc, page, CASE WHEN glyphs = 0 AND images > 0 THEN 'scan' WHEN form THEN 'fixed' ELSE 'flow' END AS mode FROM ({PAGES})")
def page_modes(spark, sf):
    return page_rows(spark, sf).select("doc", "page", L.page_mode(F.col("glyphs"), F.col("images"), F.col("form")).alias("mode"))


@query("""WITH g AS (SELECT conv_id, turn, len(text) % 3 AS lvl, sum((len(text) % 3 < 1)::INT) OVER w AS g1, sum((len(text) % 3 < 2)::INT) OVER w AS g2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT *, sum((lvl = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS c0, sum((lvl = 1)::INT) OVER (PARTITION BY conv_id, g1 ORDER BY turn) AS c1, sum((lvl = 2)::INT) OVER (PARTITION BY conv_id, g2 ORDER BY turn) + 4 AS c2 FROM g)
SELECT conv_id, turn, array_to_string(list_slice([c0, c1, c2], 1, lvl + 1), '.') AS number FROM c""")
def outline_numbers(spark, sf):
    items = table(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") % 3).alias("lvl"))
    out = N.outline_counters(items, ["conv_id"], "turn", "lvl", [1, 1, 5])
    return out.select("conv_id", "turn", F.array_join(F.transform("counters", lambda c: c.cast("string")), ".").alias("number"))


@query("""WITH r AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR len(text) % 20 > 15 OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM r""")
def list_runs(spark, sf):
    own = table(spark, sf, "conversations")
    return N.list_runs(own, "conv_id", "turn", F.col("role"), F.length("text") % 20, F.lit(10)).select("conv_id", "turn", "run")


ITEMS = "SELECT conv_id, turn, CASE WHEN len(text) % 5 < 3 THEN 'lowerLetter' WHEN len(text) % 5 = 3 THEN 'lowerRoman' ELSE 'decimal' END AS fmt, CASE WHEN len(text) % 2 = 0 THEN 'i' ELSE 'x' END AS token, CASE WHEN len(text) % 2 = 0 THEN 9 ELSE 24 END AS start FROM conversations"


@query(f"""WITH i AS ({ITEMS}), m AS (SELECT *, fmt = 'lowerLetter' AND NOT coalesce(lag(fmt) OVER w = fmt AND lag(start) OVER w = start - 1, false) AND coalesce(starts_with(lead(fmt) OVER w, 'lower'), false) AS may FROM i WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT *, may AND coalesce(first_value(CASE WHEN NOT may THEN fmt = 'lowerRoman' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS fixed FROM m)
SELECT conv_id, turn, CASE WHEN fixed THEN 'lowerRoman' ELSE fmt END AS fmt, CASE WHEN fixed THEN CASE token WHEN 'i' THEN 1 ELSE 10 END ELSE start END AS start FROM e""")
def roman_repair(spark, sf):
    n = F.length("text")
    items = table(spark, sf, "conversations").select("conv_id", "turn", F.when(n % 5 < 3, "lowerLetter").when(n % 5 == 3, "lowerRoman").otherwise("decimal").alias("fmt"), F.when(n % 2 == 0, "i").otherwise("x").alias("token"), F.when(n % 2 == 0, 9).otherwise(24).alias("start"), F.lit(0).alias("marker_x"))
    return N.romans_repaired(items, "conv_id", "turn").select("conv_id", "turn", "fmt", "start")


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN turn % 3 = 1 THEN len(text) END IGNORE NULLS) OVER w, 612) AS page_w, abs(coalesce(last_value(CASE WHEN turn % 4 = 2 THEN -turn END IGNORE NULLS) OVER w, 72)) AS top
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def section_inheritance(spark, sf):
    own = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, F.length("text")).alias("page_w"), F.when(F.col("turn") % 4 == 2, -F.col("turn")).alias("top"))
    return N.section_properties(own, "conv_id", "turn", {"page_w": 612, "top": 72}, ("top",)).select("conv_id", "turn", "page_w", "top")


@query(f"WITH l AS ({LINES}), s AS (SELECT doc, lead(y) OVER (PARTITION BY doc, page ORDER BY y) - y AS step FROM l) SELECT doc, round(list(step ORDER BY step)[len(list(step)) // 2 + 1], 6) AS pitch FROM s WHERE step > 0 GROUP BY 1")
def line_pitch(spark, sf):
    return L.line_pitch(lines(spark, sf)).select("doc", F.round("pitch", 6).alias("pitch"))


FONTS = ["Verdana", "Cambria Math", "Lucida Console", "Century Schoolbook", "Noto Sans Serif", "Segoe UI", "Menlo", "Helvetica", "Garamond", "Source Code"]
STAND_INS = ["Carlito", "Caladea", "Cousine", "Tinos", "Arimo", "Carlito", "Cousine", "Arimo", "Tinos", "Cousine"]


@query(f"SELECT p_partkey, ({STAND_INS})[p_partkey % 10 + 1] AS family FROM part")
def font_families(spark, sf):
    name = F.get(F.array(*map(F.lit, FONTS)), (F.col("p_partkey") % 10).cast("int"))
    return table(spark, sf, "part").select("p_partkey", L.font_family(name).alias("family"))


@query("""WITH s AS (SELECT o_custkey AS doc, sum(o_totalprice) / 100 AS h FROM orders GROUP BY 1), t AS (SELECT doc, p.*, ceil(h * scale / 700)::BIGINT AS pages FROM s, (VALUES ('roomy', 0, 1.0), ('normal', 1, 0.9), ('tight', 2, 0.8), ('dense', 3, 0.7)) p(preset, ord, scale))
SELECT doc, preset, pages FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pages > 20, CASE WHEN pages > 20 THEN pages END, ord) AS k FROM t) WHERE k = 1""")
def page_density(spark, sf):
    sizes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc")).agg((F.sum("o_totalprice") / 100).alias("height")).withColumn("target", F.lit(20))
    presets = [("roomy", 1.0, 700.0), ("normal", 0.9, 700.0), ("tight", 0.8, 700.0), ("dense", 0.7, 700.0)]
    return L.best_density(sizes, presets)
