"""Plane geometry as Column expressions: every helper builds a JVM-side expression.

Vertices are arrays of structs with fields x and y (and bulge where arcs matter).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres in one drawing unit, by the header's unit code; other codes count as metres.
METRES = {0: 0.001, 1: 0.0254, 2: 0.3048, 4: 0.001, 5: 0.01, 6: 1.0}
# Target units in one metre.
TARGETS = {"m": 1.0, "mm": 1000.0, "cm": 100.0, "ft": 1 / 0.3048}
TINY = 1e-12


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def rounded(x: Column, places: int = 4) -> Column:
    """Half-up rounding by floor; the small surplus keeps exact ties, with their last-bit errors, on one side."""
    scale = float(10**places)
    return F.floor(x * scale + 0.50001) / F.lit(scale)


def unit_scale(code: Column) -> Column:
    out = F.lit(1.0)
    for key, value in METRES.items():
        out = F.when(code == key, F.lit(value)).otherwise(out)
    return out


def to_units(metres: Column, target: str, power: int = 1) -> Column:
    """A length (power 1) or area (power 2) in target units; unknown ones leave it unchanged."""
    return metres * F.lit(TARGETS.get(target.strip().lower(), 1.0) ** power)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def closed_pairs(verts: Column, closed: Column) -> Column:
    """Consecutive vertices as structs (a, b), with the closing pair where closed."""
    n = F.size(verts)
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    open_pairs = F.when(n >= 2, F.zip_with(F.slice(verts, 1, F.greatest(n - 1, F.lit(0))), F.slice(verts, 2, F.greatest(n - 1, F.lit(0))), pair))
    return F.when(n < 2, F.array().cast(_pairs_type())).when(closed, F.concat(open_pairs, F.array(pair(F.element_at(verts, -1), verts[0])))).otherwise(open_pairs)


def _pairs_type() -> str:
    point = "struct<x:double,y:double,bulge:double>"
    return f"array<struct<a:{point},b:{point}>>"


def path_length(verts: Column, closed: Column) -> Column:
    """Edges' lengths as roots of squares, from the last edge, as the SQL has them: hypot differs in the last bit, which decides where a ring has no area."""
    square = lambda p: (p["b"]["x"] - p["a"]["x"]) * (p["b"]["x"] - p["a"]["x"]) + (p["b"]["y"] - p["a"]["y"]) * (p["b"]["y"] - p["a"]["y"])
    return F.aggregate(F.reverse(closed_pairs(verts, closed)), F.lit(0.0), lambda t, p: t + F.sqrt(square(p)))


def signed_area(verts: Column, closing_first: bool = False) -> Column:
    """Shoelace over the closed ring; positive anticlockwise, 0 below three vertices.

    Edges are summed from the last to the first, or the closing one and then from the
    first, as a query's SQL does: where a ring has no area the last bits are all that is
    left, and they hang on the order.
    """
    cross = lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
    pairs = closed_pairs(_closing_first(verts), F.lit(True)) if closing_first else F.reverse(closed_pairs(verts, F.lit(True)))
    total = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + cross(p))
    return F.when(F.size(verts) < 3, F.lit(0.0)).otherwise(total / 2)


def _closing_first(verts: Column) -> Column:
    """A ring's vertices, the last one put before the first."""
    return F.concat(F.slice(verts, -1, 1), F.slice(verts, 1, F.greatest(F.size(verts) - 1, F.lit(0))))


def ring_area(verts: Column) -> Column:
    return F.abs(signed_area(verts))


def centroid(verts: Column, closing_first: bool = False) -> Column:
    """The vertices' mean, summed in the order of signed_area()."""
    mean = lambda axis: F.aggregate(_closing_first(verts) if closing_first else F.reverse(verts), F.lit(0.0), lambda t, v: t + v[axis]) / F.size(verts)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def bounds(verts: Column) -> Column:
    axis = lambda name: F.transform(verts, lambda v: v[name])
    return F.struct(F.array_min(axis("x")).alias("minx"), F.array_min(axis("y")).alias("miny"), F.array_max(axis("x")).alias("maxx"), F.array_max(axis("y")).alias("maxy"))


def boxes_touch(a: Column, b: Column, gap: Column | float = 0.0) -> Column:
    """Boxes overlap, touching edges included, once grown by a gap."""
    return (a["minx"] <= b["maxx"] + gap) & (b["minx"] <= a["maxx"] + gap) & (a["miny"] <= b["maxy"] + gap) & (b["miny"] <= a["maxy"] + gap)


def inside_edges(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd test of a point against a ring's edges, as closed_pairs() gives them."""

    def crosses(p: Column) -> Column:
        a, b = p["a"], p["b"]
        return ((b["y"] > y) != (a["y"] > y)) & (x < (a["x"] - b["x"]) * (y - b["y"]) / (a["y"] - b["y"] + TINY) + b["x"])

    return F.aggregate(edges, F.lit(False), lambda odd, p: odd != crosses(p))


def inside(x: Column, y: Column, verts: Column) -> Column:
    """Even-odd test of a point against a ring."""
    return inside_edges(x, y, closed_pairs(verts, F.lit(True)))


def arc_sweep(start: Column, end: Column) -> Column:
    """Degrees from start to end, anticlockwise; a full turn stays a full turn."""
    turn = F.pmod(end - start, F.lit(360.0))
    return F.when((turn == 0) & (end != start), F.lit(360.0)).otherwise(turn)


def arc_points(cx: Column, cy: Column, r: Column, start: Column, end: Column, least: int = 16, step: float = 6.0) -> Column:
    """Points along an arc, one for each `step` degrees, `least` pieces or more."""
    sweep = arc_sweep(start, end)
    fixed = F.struct(cx.alias("x"), cy.alias("y"), r.alias("r"), F.radians(start).alias("from"), F.radians(sweep).alias("turn"), F.greatest(F.lit(least), F.floor(sweep / step).cast("int")).alias("n"))
    point = lambda v, t: F.struct((v["x"] + v["r"] * F.cos(t)).alias("x"), (v["y"] + v["r"] * F.sin(t)).alias("y"))
    return let(fixed, lambda v: F.transform(F.sequence(F.lit(0), v["n"]), lambda i: point(v, v["from"] + v["turn"] * i / v["n"])))


def bulge_points(a: Column, b: Column, bulge: Column, least: int = 8, step: float = 6.0) -> Column:
    """Points along the arc of a polyline segment; a bulge is the tangent of a quarter of its angle.

    The point at fraction t of the arc's angle is found by turning the chord's start
    about the centre, which lies on the chord's bisector.
    """
    angle = F.atan(bulge) * 4
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    apothem = (1 - bulge * bulge) / (4 * bulge)  # centre's distance from the chord, in chords, to its left
    cx, cy = (a["x"] + b["x"]) / 2 - dy * apothem, (a["y"] + b["y"]) / 2 + dx * apothem
    pieces = F.greatest(F.lit(least), F.floor(F.abs(angle) / math.radians(step) + 1e-9).cast("int"))
    fixed = F.struct(cx.alias("x"), cy.alias("y"), (a["x"] - cx).alias("u"), (a["y"] - cy).alias("v"), angle.alias("turn"), pieces.alias("n"))
    turned = lambda k, c, s: F.struct((k["x"] + k["u"] * c - k["v"] * s).alias("x"), (k["y"] + k["u"] * s + k["v"] * c).alias("y"))
    curve = let(fixed, lambda k: F.transform(F.sequence(F.lit(0), k["n"]), lambda i: turned(k, F.cos(k["turn"] * i / k["n"]), F.sin(k["turn"] * i / k["n"]))))
    straight = F.array(F.struct(a["x"].alias("x"), a["y"].alias("y")), F.struct(b["x"].alias("x"), b["y"].alias("y")))
    return F.when((F.abs(bulge) < TINY) | (F.hypot(dx, dy) < TINY), straight).otherwise(curve)


def arc_length(r: Column, start: Column, end: Column) -> Column:
    return 2 * math.pi * r * arc_sweep(start, end) / 360


def rectangle_sides(perimeter: Column, area: Column) -> Column:
    """(length, width) of the rectangle with this perimeter and area, longer first; null where there is none."""
    half = perimeter / 2
    square = half * half - 4 * area
    root = F.sqrt(F.greatest(square, F.lit(0.0)))
    long_side, short_side = (half + root) / 2, (half - root) / 2
    return F.when((perimeter > 0) & (area > 0) & (square >= -1e-9) & (short_side > 0), F.struct(long_side.alias("length"), short_side.alias("width")))


def point_segment(px: Column, py: Column, a: Column, b: Column) -> Column:
    """Distance from a point to a segment; a segment without length is a point."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(((px - a["x"]) * dx + (py - a["y"]) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.hypot(px - a["x"] - t * dx, py - a["y"] - t * dy)


def hausdorff(p: Column, q: Column, samples: int = 64) -> Column:
    """Greatest distance from sampled vertices of either path to the other's segments."""

    def one_way(a: Column, b: Column) -> Column:
        stride = F.greatest(F.lit(1), F.floor(F.size(a) / samples).cast("int"))
        picked = F.transform(F.sequence(F.lit(0), F.size(a) - 1, stride), lambda i: a[i])
        pairs = closed_pairs(b, F.lit(False))
        return F.array_max(F.transform(picked, lambda v: F.array_min(F.transform(pairs, lambda s: point_segment(v["x"], v["y"], s["a"], s["b"])))))

    return F.greatest(one_way(p, q), one_way(q, p))


def vector_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between two vectors; 0 where one has no length."""
    size = F.hypot(ax, ay) * F.hypot(bx, by)
    return F.when(size > 0, F.acos(F.least(F.greatest((ax * bx + ay * by) / size, F.lit(-1.0)), F.lit(1.0)))).otherwise(F.lit(0.0))


def fold_angle(dx: Column, dy: Column) -> Column:
    """A direction without sense, from 0 up to pi."""
    return F.pmod(F.atan2(dy, dx), F.lit(math.pi))


def crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where segments ab and cd cross strictly inside both, as (x, y); else null. Parallel ones never do."""
    rx, ry, sx, sy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    den = rx * sy - ry * sx
    safe = F.when(F.abs(den) >= TINY, den)
    t = ((c["x"] - a["x"]) * sy - (c["y"] - a["y"]) * sx) / safe
    u = ((c["x"] - a["x"]) * ry - (c["y"] - a["y"]) * rx) / safe
    edge = 1e-9
    return F.when((t > edge) & (t < 1 - edge) & (u > edge) & (u < 1 - edge), F.struct((a["x"] + t * rx).alias("x"), (a["y"] + t * ry).alias("y")))


def densified(verts: Column, most: float) -> Column:
    """The path with spans longer than `most` cut into equal parts, floor(length / most) of them and one more."""

    def parts(p: Column) -> Column:
        inner = F.floor(distance(p["a"], p["b"]) / most).cast("int")
        count = F.when(distance(p["a"], p["b"]) > most, inner + 1).otherwise(F.lit(1))
        step = lambda i, axis: p["a"][axis] + (p["b"][axis] - p["a"][axis]) * i / count
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(step(i, "x").alias("x"), step(i, "y").alias("y")))

    last = F.element_at(verts, -1)
    return F.concat(F.flatten(F.transform(closed_pairs(verts, F.lit(False)), parts)), F.array(F.struct(last["x"].alias("x"), last["y"].alias("y"))))


def moved_to_pivot(x: Column, y: Column, old_pivot: Column, new_pivot: Column) -> Column:
    """A position shifted so that the new pivot falls on the old one."""
    return F.struct((x + old_pivot["x"] - new_pivot["x"]).alias("x"), (y + old_pivot["y"] - new_pivot["y"]).alias("y"))


def replaced_pose(at: Column, rotation: Column, sx: Column, sy: Column, old_pivot: Column, new_pivot: Column, turn: Column) -> Column:
    """(x, y, rotation) of an insert that takes another's place, turned on by some degrees: its pivot falls on the old one's in the drawing.

    Pivots are places in the blocks; position, scales and rotation are the old insert's.
    """
    to = rotation + turn

    def placed(p: Column, degrees: Column) -> tuple[Column, Column]:
        c, s, x, y = F.cos(F.radians(degrees)), F.sin(F.radians(degrees)), p["x"] * sx, p["y"] * sy
        return c * x - s * y, s * x + c * y

    (ox, oy), (nx, ny) = placed(old_pivot, rotation), placed(new_pivot, to)
    return F.struct((at["x"] + ox - nx).alias("x"), (at["y"] + oy - ny).alias("y"), to.alias("rotation"))


def circle_samples(cx: Column, cy: Column, r: Column, n: int = 64) -> Column:
    """n points around a circle, the first one not repeated."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _on_circle(cx, cy, r, i * (2 * math.pi / n)))


def arc_samples(cx: Column, cy: Column, r: Column, start: Column, end: Column, n: int = 32) -> Column:
    """n + 1 points from start to end, in radians; an end before the start goes backwards."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: _on_circle(cx, cy, r, start + (end - start) * (i / F.lit(float(n)))))


def _on_circle(cx: Column, cy: Column, r: Column, angle: Column) -> Column:
    return F.struct((cx + r * F.cos(angle)).alias("x"), (cy + r * F.sin(angle)).alias("y"))
