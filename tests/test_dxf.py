"""Drawings in files: curves and hatches, records that can't be read, placements with base points, arrays and mirrors, zones and sizes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import drawing as D
from plumbline.operators import previews as P
from plumbline.operators import zones as Z
from plumbline.sources import dxf


def text(*parts):
    return "\n".join(str(x) for p in parts for x in p) + "\n"


def drawing(entities, blocks=(), units=6):
    return text((0, "SECTION", 2, "HEADER", 9, "$INSUNITS", 70, units, 0, "ENDSEC", 0, "SECTION", 2, "BLOCKS"), *blocks, (0, "ENDSEC", 0, "SECTION", 2, "ENTITIES"), *entities, (0, "ENDSEC", 0, "EOF"))


def parsed(*entities, **more):
    names = [f.strip().split(" ")[0] for f in dxf._NAMES]
    return [dict(zip(names, r)) for r in dxf.parse(drawing(entities, **more), "d")]


def basis(i, p, t, u):
    """Cox and de Boor's recursion, as it is defined."""
    if p == 0:
        return 1.0 if u[i] <= t < u[i + 1] or (t == u[-1] and u[i] < u[i + 1] == u[-1]) else 0.0
    part = lambda a, b, c: (a / b * c) if b else 0.0
    return part(t - u[i], u[i + p] - u[i], basis(i, p - 1, t, u)) + part(u[i + p + 1] - t, u[i + p + 1] - u[i + 1], basis(i + 1, p - 1, t, u))


def test_splines_against_their_definition():
    rng = random.Random(2)
    for degree in (1, 2, 3, 4):
        for n in (degree + 1, degree + 4):
            inner = sorted(rng.random() for _ in range(n - degree - 1))
            knots = [0.0] * (degree + 1) + inner + [1.0] * (degree + 1)
            points = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(n)]
            for weights in ([], [rng.uniform(0.5, 2) for _ in range(n)]):
                got = dxf.curve_points(degree, knots, points, weights, 16)
                for k, (x, y) in enumerate(got):
                    b = [basis(i, degree, k / 16, knots) * (weights[i] if weights else 1.0) for i in range(n)]
                    assert math.dist((x, y), tuple(sum(v * p[axis] for v, p in zip(b, points)) / sum(b) for axis in (0, 1))) < 1e-9
    half = math.sqrt(0.5)  # a quarter circle, exactly
    assert all(abs(math.hypot(x, y) - 1) < 1e-12 for x, y in dxf.curve_points(2, [0, 0, 0, 1, 1, 1], [(1, 0), (1, 1), (0, 1)], [1, half, 1], 8))
    with pytest.raises(ValueError):
        dxf.curve_points(3, [0, 0, 1, 1], [(0, 0), (1, 1)], [], 8)


SPLINE = (0, "SPLINE", 8, "S", 70, 8, 71, 2, 72, 6, 73, 3, 74, 0, 40, 0, 40, 0, 40, 0, 40, 1, 40, 1, 40, 1, 10, 0, 20, 0, 30, 0, 10, 1, 20, 2, 30, 0, 10, 2, 20, 0, 30, 0)
ELLIPSE = (0, "ELLIPSE", 8, "E", 10, 5, 20, 5, 11, 0, 21, 4, 40, 0.5, 41, 0, 42, 6.283185307179586)


def square(a, b):
    return (92, 7, 72, 0, 73, 1, 93, 4, 10, a, 20, a, 10, b, 20, a, 10, b, 20, b, 10, a, 20, b, 97, 0)


def hatch(*loops, layer="H"):
    return (0, "HATCH", 8, layer, 10, 0, 20, 0, 30, 0, 2, "SOLID", 70, 1, 71, 0, 91, len(loops), *(x for loop in loops for x in loop), 75, 1, 76, 1, 98, 1, 10, 3, 20, 3)


ARCS = (92, 1, 93, 2, 72, 2, 10, 0, 20, 0, 40, 2, 50, 0, 51, 180, 73, 1, 72, 1, 10, -2, 20, 0, 11, 2, 21, 0, 97, 0)  # half a disc
DISC = (92, 1, 93, 1, 72, 2, 10, 5, 20, 5, 40, 1, 50, 0, 51, 360, 73, 1, 97, 0)
OVAL = (92, 1, 93, 1, 72, 3, 10, 0, 20, 0, 11, 3, 21, 0, 40, 0.5, 50, 0, 51, 360, 73, 1, 97, 0)
CURVED = (92, 1, 93, 2, 72, 4, 94, 2, 73, 0, 74, 0, 95, 6, 96, 3, 40, 0, 40, 0, 40, 0, 40, 1, 40, 1, 40, 1, 10, 0, 20, 0, 10, 1, 20, 2, 10, 2, 20, 0, 72, 1, 10, 2, 20, 0, 11, 0, 21, 0, 97, 0)


def test_curves_and_hatches(spark, tmp_path):
    entities = (SPLINE, ELLIPSE, hatch(square(0, 10), square(2, 8), square(4, 6), layer="NEST"), hatch(ARCS, layer="HALF"), hatch(square(0, 10), DISC, layer="HOLE"), hatch(OVAL, layer="OVAL"), hatch(CURVED, layer="BEND"), (0, "LINE", 8, "L", 10, 0, 20, 0, 11, 3, 21, 4))
    (tmp_path / "c.dxf").write_text(drawing(entities))
    e = dxf.read_drawings(spark, str(tmp_path)).cache()
    assert {r["etype"]: r["count"] for r in e.groupBy("etype").count().collect()} == {"SPLINE": 1, "ELLIPSE": 1, "HATCH": 5, "LINE": 1}
    m = {r["layer"]: r for r in D.entity_layer_metrics(e, "m").collect()}
    assert m["NEST"]["area"] == 100 - 36 + 4 and m["HALF"]["area"] == pytest.approx(math.pi * 2, rel=0.02)
    assert m["HOLE"]["area"] == pytest.approx(100 - math.pi, rel=0.001) and m["OVAL"]["area"] == pytest.approx(math.pi * 4.5, rel=0.01) and m["BEND"]["area"] == pytest.approx(4 / 3, rel=0.01)
    assert m["L"]["length"] == 5.0
    box = {r["etype"]: [r["b"][k] for k in ("minx", "miny", "maxx", "maxy")] for r in e.withColumn("o", D.outline(e)).where("etype <> 'HATCH'").selectExpr("etype", "o").select("etype", D.G.bounds(F.col("o")).alias("b")).collect()}
    assert box["ELLIPSE"] == pytest.approx([3, 1, 7, 9], abs=1e-9) and box["SPLINE"] == pytest.approx([0, 0, 2, 1], abs=1e-9)
    c = {r["layer"] for r in D.entity_layer_colours(e).collect()}
    assert {"NEST", "L"} <= c
    drawn = {r["layer"] for r in P.pixels(e, ["layer"]).select("layer").distinct().collect()}
    assert drawn == {"S", "E", "L"}


def test_records_that_cannot_be_read(spark, tmp_path):
    bad = [
        (0, "LINE", 5, "A1", 8, "L", 10, "x1", 20, 0, 11, 1, 21, 1),  # a number that isn't one
        (0, "SPLINE", 5, "A2", 8, "L", 71, 3, 40, 0, 10, 0, 20, 0),  # too few knots
        (0, "CIRCLE", 5, "A3", 8, "L", "1x", 5, 40, 1),  # not a group code
        hatch((92, 1, 93, 1, 72, 9, 97, 0)),
    ]
    good = (0, "LINE", 5, "B1", 8, "L", 10, 0, 20, 0, 11, 1, 21, 1)
    rows = parsed(good, *bad, good)
    assert [r["etype"] for r in rows] == ["LINE", "ERROR", "ERROR", "ERROR", "ERROR", "LINE"]
    assert [(r["name"], r["handle"]) for r in rows if r["etype"] == "ERROR"] == [("LINE", "A1"), ("SPLINE", "A2"), ("CIRCLE", "A3"), ("HATCH", None)]
    assert [r["ent_ord"] for r in rows] == sorted(r["ent_ord"] for r in rows)
    (tmp_path / "a.dxf").write_text(drawing([good, *bad, good]))
    (tmp_path / "b.dxf").write_text("nothing\nof the kind\n0\nSECTION\n2\nENTITIES\n" + text(good) + "odd")
    (tmp_path / "c.dxf").write_text("")
    e = dxf.read_drawings(spark, str(tmp_path)).cache()
    assert e.where("etype = 'LINE'").count() == 3 and dxf.errors(e).where("drawing LIKE '%a.dxf'").count() == 4 and dxf.errors(e).where("drawing LIKE '%b.dxf'").count() == 1
    assert D.report(e, "m").count() >= 2
    assert parsed((0, "INSERT", 2, "B", 66, 1, 10, 0, 20, 0), (0, "ATTRIB", 2, "N", 1, "v"), (0, "SEQEND",))[0]["attribs"] == {"N": "v"}
    assert [r["etype"] for r in parsed((0, "POLYLINE", 70, 1), (0, "VERTEX", 10, 1, 20, 2), (0, "VERTEX", 10, "?", 20, 2), good)] == ["POLYLINE", "ERROR", "LINE"]


def affine(x, y, base=(0, 0), at=(0, 0), scale=(1, 1), turn=0.0, flipped=False, cell=(0, 0)):
    x, y = (x - base[0]) * scale[0], (y - base[1]) * scale[1]
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    x, y = c * (x + cell[0]) - s * (y + cell[1]) + at[0], s * (x + cell[0]) + c * (y + cell[1]) + at[1]
    return (-x, y) if flipped else (x, y)


def test_placements(spark, tmp_path):
    line = (0, "LINE", 8, "0", 10, 1, 20, 1, 11, 4, 21, 2)
    arc = (0, "LWPOLYLINE", 8, "0", 90, 2, 70, 0, 10, 1, 20, 1, 42, 1, 10, 3, 20, 1)
    blocks = [(0, "BLOCK", 2, "IN", 10, 1, 20, 1), line, arc, (0, "ENDBLK",), (0, "BLOCK", 2, "OUT", 10, 5, 20, 0), (0, "INSERT", 2, "IN", 10, 6, 20, 2, 41, 2, 42, 0.5, 50, 90), (0, "ENDBLK",)]
    inserts = [
        (0, "INSERT", 5, "P", 2, "IN", 10, 7, 20, 8),
        (0, "INSERT", 5, "M", 2, "IN", 10, 7, 20, 8, 50, 30, 210, 0, 220, 0, 230, -1),
        (0, "INSERT", 5, "G", 2, "IN", 10, 0, 20, 0, 50, 90, 70, 3, 71, 2, 44, 10, 45, 20),
        (0, "INSERT", 5, "N", 2, "OUT", 10, 100, 20, 0, 41, -1, 42, 3, 50, 15),
        (0, "INSERT", 2, "IN", 10, 50, 20, 50),  # without a handle
    ]
    (tmp_path / "p.dxf").write_text(drawing(inserts, blocks))
    e = dxf.read_drawings(spark, str(tmp_path)).cache()
    got = {}
    for r in dxf.explode_inserts(e).where("etype = 'LINE'").collect():
        got.setdefault(r["insert_id"], set()).update({(round(r["p0"]["x"], 6), round(r["p0"]["y"], 6), round(r["p1"]["x"], 6), round(r["p1"]["y"], 6))})
    ends = lambda f: {tuple(round(v, 6) for p in ((1, 1), (4, 2)) for v in f(*p))}
    inner = lambda x, y: affine(x, y, (1, 1), (6, 2), (2, 0.5), 90)
    assert got["P"] == ends(lambda x, y: affine(x, y, (1, 1), (7, 8)))
    assert got["M"] == ends(lambda x, y: affine(x, y, (1, 1), (7, 8), turn=30, flipped=True))
    assert got["G"] == set().union(*(ends(lambda x, y, i=i, j=j: affine(x, y, (1, 1), (0, 0), turn=90, cell=(10 * i, 20 * j))) for i in range(3) for j in range(2)))
    assert got["N"] == ends(lambda x, y: affine(*inner(x, y), (5, 0), (100, 0), (-1, 3), 15))
    assert len(got) == 5 and [k for k in got if k.startswith("#")]
    # A half circle below its chord is above it once mirrored, in extents too.
    boxes = {r["insert_id"]: r for r in D.insert_boxes(e).collect()}
    assert boxes["P"]["miny"] == pytest.approx(7.0, abs=1e-3) and boxes["P"]["maxy"] == pytest.approx(9.0)
    mirrored = parsed((0, "ARC", 8, "0", 10, 3, 20, 1, 40, 2, 50, 10, 51, 80, 230, -1), (0, "CIRCLE", 8, "0", 10, 3, 20, 1, 40, 2, 230, -1), (0, "LWPOLYLINE", 8, "0", 10, 1, 20, 1, 42, 0.5, 10, 3, 20, 1, 230, -1))
    assert mirrored[0]["p0"] == (-3, 1) and (mirrored[0]["a0"], mirrored[0]["a1"]) == (100, 170) and mirrored[1]["p0"] == (-3, 1) and mirrored[2]["verts"] == [(-1, 1, -0.5), (-3, 1, 0)]


def test_zones_by_outlines_and_labels(spark, tmp_path):
    ring = lambda layer, a, b, closed=1, kind="LWPOLYLINE": (0, kind, 8, layer, 70, closed, *(x for p in ((a, a), (b, a), (b, b), (a, b)) for x in (10, p[0], 20, p[1])))
    label = lambda x, y, t, kind="TEXT", layer="N": (0, kind, 8, layer, 10, x, 20, y, 1, t)
    entities = [ring("PLANNER", 0, 10), ring("PLANNER", 20, 30), ring("PLANNER", 40, 50), ring("PLANNER", 60, 70, 0), ring("planner", 60, 70), label(1, 1, " A "), label(50, 50, "far", "MTEXT"), label(500, 500, " ")]
    (tmp_path / "a.dxf").write_text(drawing(entities))
    zones = D.planner_zones(dxf.read_drawings(spark, str(tmp_path))).collect()
    assert [(z["zone_ord"], z["zone"]) for z in sorted(zones, key=lambda z: z["zone_ord"])] == [(1, "A"), (2, "far"), (3, "Zone 03")]


def test_zones_of_all_sizes(spark):
    rng = random.Random(4)
    box = lambda d, n, x, y, s: (d, n, f"z{n}", [(x, y, 0.0), (x + s, y, 0.0), (x + s, y + s * 0.9, 0.0), (x, y + s * 0.9, 0.0)])
    zones = [box(rng.choice("ab"), n, rng.uniform(-1e3, 1e3), rng.uniform(-1e3, 1e3), 10.0 ** rng.uniform(-3, 6)) for n in range(60)]
    points = [(rng.choice("abc"), i, *(v + rng.uniform(-0.01, 1) for v in rng.choice(zones)[3][0][:2])) for i in range(300)] + [("a", 999, None, 1.0)]
    z = spark.createDataFrame(zones, "drawing string, zone_ord long, zone string, poly array<struct<x:double,y:double,bulge:double>>")
    p = spark.createDataFrame(points, "drawing string, i int, x double, y double")
    got = {(r["i"], r["zone"]) for r in Z.leveled_pairs(p, z, ["drawing"]).collect()}
    inside = lambda x, y, r: r[0][0] < x < r[2][0] and r[0][1] < y < r[2][1]
    assert got == {(i, name) for d, i, x, y in points if x is not None for e, _, name, r in zones if d == e and inside(x, y, r)} and got


def test_previews_of_blocks(spark, tmp_path):
    import base64

    import numpy as np

    from plumbline.sources import images

    line = (0, "LINE", 8, "0", 10, 0, 20, 0, 11, 10, 21, 0)
    blocks = [(0, "BLOCK", 2, "ELL", 10, 0, 20, 0), line, (0, "LINE", 8, "0", 10, 0, 20, 0, 11, 0, 21, 5), (0, "TEXT", 8, "0", 10, 900, 20, 900, 1, "no"), (0, "ENDBLK",), (0, "BLOCK", 2, "NONE", 10, 0, 20, 0), (0, "ENDBLK",)]
    inserts = [(0, "INSERT", 5, "1", 2, "ELL", 10, 70, 20, 0), (0, "INSERT", 5, "2", 2, "ELL", 10, 0, 20, 0, 41, -2, 42, 2), (0, "INSERT", 5, "3", 2, "ELL", 10, 5, 20, 5, 41, 9, 42, 1), (0, "INSERT", 5, "4", 2, "NONE", 10, 0, 20, 0)]
    (tmp_path / "p.dxf").write_text(drawing(inserts, blocks))
    e = dxf.read_drawings(spark, str(tmp_path))
    cells = {}
    for r in P.block_pixels(e).collect():
        cells.setdefault((r["block_name"], r["mirrored"]), set()).add((r["y"], r["x"]))
    assert set(cells) == {("ELL", False), ("ELL", True)}
    near = lambda a, b: all(any((y + i, x + j) in b for i in (-1, 0, 1) for j in (-1, 0, 1)) for y, x in a)
    assert near(cells["ELL", False], cells["ELL", True]) and near(cells["ELL", True], cells["ELL", False])
    bill = P.with_previews(D.report(e, "m"), e).where("entity_type = 'INSERT'").collect()
    shown = {r["boq_name"]: r["preview"] for r in bill}
    assert shown["NONE"] is None
    image = images.grey(base64.b64decode(shown["ELL"]))
    assert image.shape == (256, 256) and set(zip(*map(list, np.nonzero(image == 0)))) == cells["ELL", False]
