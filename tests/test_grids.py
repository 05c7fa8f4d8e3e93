"""Grids of literal pages: frames, merged cells, borders, texts, shading, cuts at rules."""

from __future__ import annotations

from tallyforge.operators import grids as G

EDGE = "doc int, page int, o string, pos double, a double, b double, w double"


def lattice(page: int, xs: list[float], ys: list[float], without=()) -> list[tuple]:
    """Rules from crossing to crossing; without: (o, row, column) of those to leave out."""
    rows = [(1, page, "h", y, a, b, 0.5) for r, y in enumerate(ys) for c, (a, b) in enumerate(zip(xs, xs[1:])) if ("h", r, c) not in without]
    return rows + [(1, page, "v", x, a, b, 1.0) for c, x in enumerate(xs) for r, (a, b) in enumerate(zip(ys, ys[1:])) if ("v", r, c) not in without]


def test_lattices(spark):
    xs, ys = [0.0, 50.0, 100.0], [0.0, 20.0, 40.0]
    rows = lattice(1, xs, ys, {("v", 0, 1)})  # the upper cells are one
    rows += lattice(2, xs, ys, {("v", 0, 1), ("h", 1, 0)})  # a group of three is no rectangle
    rows += lattice(3, xs, ys, {("h", 0, 0)})  # the frame is open
    rows += lattice(4, [0.0, 2.4, 50.0], ys)  # a double rule
    rows += lattice(5, [0.0, 50.0], [0.0, 20.0])  # one cell
    rows += lattice(6, xs, ys, {("h", 1, 0), ("h", 1, 1), ("v", 0, 1), ("v", 1, 1)})  # one region
    rows += lattice(7, xs, ys) + lattice(7, [x + 200 for x in xs], ys, {("h", 1, 0)}) + [(1, 7, "h", 300.0, 0.0, 90.0, 1.0)]
    rows += [(1, 8, "h", y, 0.0, 60.0, 1.0) for y in (0.0, 30.0)] + [(1, 8, "h", y, 58.0, 100.0, 1.0) for y in (0.5, 30.0)] + [(1, 8, "v", x, -1.0, 31.0, 1.0) for x in (0.0, 50.0, 100.0)]  # rules in pieces
    grids = G.find_grids(spark.createDataFrame(rows, EDGE).repartition(3))
    got = sorted((r["page"], r["r0"], r["r1"], r["c0"], r["c1"], r["x0"]) for r in grids.regions.collect())
    assert got == sorted([(1, 0, 0, 0, 1, 0.0), (1, 1, 1, 0, 0, 0.0), (1, 1, 1, 1, 1, 50.0)] + [(7, r, r, c, c, 50.0 * c) for r in (0, 1) for c in (0, 1)] + [(7, 0, 1, 0, 0, 200.0), (7, 0, 0, 1, 1, 250.0), (7, 1, 1, 1, 1, 250.0)] + [(8, 0, 0, 0, 0, 0.0), (8, 0, 0, 1, 1, 50.0)])
    edges = {(r["page"], r["r0"], r["c0"]): (r["top"], r["bottom"], r["left"], r["right"]) for r in G.borders(grids).filter("page IN (1, 8)").collect()}
    assert edges == {(1, 0, 0): (0.5, 0.5, 1.0, 1.0), (1, 1, 0): (0.5, 0.5, 1.0, 1.0), (1, 1, 1): (0.5, 0.5, 1.0, 1.0), (8, 0, 0): (1.0,) * 4, (8, 0, 1): (1.0,) * 4}
    texts = spark.createDataFrame([(1, 1, 1, 0, 12.0, 10.0, 60.0, 90.0, 12.0, "b"), (1, 1, 2, 0, 12.0, 10.0, 5.0, 30.0, 12.0, "a"), (1, 1, 3, 1, 30.0, 10.0, 5.0, 40.0, 30.0, "c"), (1, 1, 4, 2, 38.0, 10.0, 5.0, 40.0, 38.0, "d"), (1, 1, 5, 3, 90.0, 10.0, 5.0, 40.0, 90.0, "outside")], "doc int, page int, id int, line int, base double, size double, x0 double, x1 double, y double, text string")
    found = G.placed(texts, grids.regions)
    assert {r["id"] for r in found.filter("region IS NULL").collect()} == {5}
    assert sorted(r["text"] for r in G.cell_texts(found).collect()) == ["a\tb", "c\nd"]
    fills = spark.createDataFrame([(1, 1, 0, -0.5, -0.5, 101.0, 21.0, "grey"), (1, 1, 1, 0.0, 20.0, 90.0, 20.0, "red"), (1, 1, 2, 0.0, 20.0, 50.0, 20.0, "blue"), (1, 1, 3, 0.0, 20.0, 50.0, 2.0, "thin")], "doc int, page int, shape int, x double, y double, w double, h double, color string")
    assert {(r["r0"], r["c0"]): r["fill"] for r in G.shaded(fills, grids.regions).filter("page = 1").collect()} == {(0, 0): "grey", (1, 0): "blue", (1, 1): None}
    none = G.find_grids(spark.createDataFrame([], EDGE))
    assert none.regions.count() == 0 and G.borders(none).count() == 0


def test_glyphs_part_at_rules(spark):
    glyphs = [(1, 1, 0, k, x, 8.0, 10.0, 10.0, joined) for k, (x, joined) in enumerate([(0.0, False), (9.0, False), (20.0, False), (34.0, True), (43.0, False), (200.0, False)])]
    rules = [(1, 1, "v", 42.5, 0.0, 20.0, 1.0), (1, 1, "v", 18.0, 50.0, 90.0, 1.0), (1, 2, "v", 8.5, 0.0, 20.0, 1.0), (1, 1, "h", 8.5, 0.0, 20.0, 1.0)]
    own = spark.createDataFrame(glyphs, "doc int, page int, line int, seq int, x double, w double, y double, size double, joined boolean")
    got = G.cut_at_rules(own, spark.createDataFrame(rules, EDGE)).orderBy("seq").collect()
    assert [r["seg"] for r in got] == [0, 0, 0, 0, 1, 2]
