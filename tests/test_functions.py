"""Hand-computed fixtures of the functions."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import similarity as C
from plumbline.functions import strings as S


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first()["v"]


def ring(*points):
    return F.array(*(F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y"), F.lit(float(p[2]) if len(p) > 2 else 0.0).alias("bulge")) for p in points))


def point(x, y):
    return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(0.0).alias("bulge"))


def test_units(value):
    assert value(G.to_units(F.lit(304.8) * G.unit_scale(F.lit(4)), "ft")) == pytest.approx(1.0)
    assert value(G.to_units(G.unit_scale(F.lit(0)), "m")) == 0.001
    assert value(G.to_units(G.unit_scale(F.lit(99)), "m")) == 1.0
    assert value(G.to_units(F.lit(2.0), "furlong")) == 2.0


def test_rectangle(value):
    assert tuple(value(G.rectangle_sides(F.lit(14.0), F.lit(12.0)))) == (4.0, 3.0)
    assert tuple(value(G.rectangle_sides(F.lit(8.0), F.lit(4.0)))) == (2.0, 2.0)
    assert value(G.rectangle_sides(F.lit(10.0), F.lit(100.0))) is None


def test_ring_measures(value):
    r = ring((0, 0), (4, 0), (4, 3), (0, 3))
    assert value(G.ring_area(r)) == 12.0
    assert value(G.path_length(r, F.lit(True))) == 14.0
    assert value(G.path_length(r, F.lit(False))) == 11.0
    assert value(G.signed_area(ring((0, 0), (0, 2), (2, 2), (2, 0)))) == -4.0
    assert value(G.ring_area(ring((0, 0), (1, 1)))) == 0.0
    assert value(G.path_length(ring((1, 1)), F.lit(True))) == 0.0


def test_area_does_not_depend_on_the_start(value):
    pts = [(0, 0), (5, 1), (6, 4), (2, 7), (-1, 3)]
    assert {round(value(G.ring_area(ring(*(pts[k:] + pts[:k])))), 9) for k in range(5)} == {round(value(G.ring_area(ring(*pts))), 9)}


def test_bulge_half_circle(value):
    pts = value(G.bulge_points(point(0, 0), point(2, 0), F.lit(1.0)))
    assert len(pts) == 31
    assert min(p["y"] for p in pts) == pytest.approx(-1.0)
    assert sum(math.dist(a, b) for a, b in zip(pts, pts[1:])) == pytest.approx(3.140157374577)
    assert len(value(G.bulge_points(point(0, 0), point(2, 0), F.lit(0.0)))) == 2


def test_arcs(value):
    assert value(G.arc_length(F.lit(5.0), F.lit(350.0), F.lit(10.0))) == pytest.approx(2 * math.pi * 5 * 20 / 360)
    assert value(G.arc_length(F.lit(5.0), F.lit(0.0), F.lit(360.0))) == pytest.approx(2 * math.pi * 5)
    pts = value(G.arc_points(F.lit(0.0), F.lit(0.0), F.lit(5.0), F.lit(0.0), F.lit(360.0)))
    assert max(p["x"] for p in pts) - min(p["x"] for p in pts) == pytest.approx(10.0)


def test_inside(value):
    box = ring((0, 0), (10, 0), (10, 10), (0, 10))
    assert value(G.inside(F.lit(7.0), F.lit(7.0), box))
    assert not value(G.inside(F.lit(20.0), F.lit(7.0), box))


def test_densify(value):
    assert [round(p["x"], 6) for p in value(G.densified(ring((0, 0), (10, 0)), 4.0))] == [0, 3.333333, 6.666667, 10]
    assert len(value(G.densified(ring((0, 0), (3, 0)), 4.0))) == 2


def test_crossing(value):
    hit = value(G.crossing(point(0, 0), point(2, 2), point(2, 0), point(0, 2)))
    assert tuple(hit) == (1.0, 1.0)
    assert value(G.crossing(point(0, 0), point(1, 0), point(0, 1), point(1, 1))) is None


def test_hausdorff(value):
    assert value(G.hausdorff(ring((0, 0), (4, 0)), ring((0, 1), (4, 1)))) == pytest.approx(1.0)


def test_strings(value):
    assert value(S.key(F.lit("Chair-01 (A)"))) == "chair01a"
    assert value(S.base_key(F.lit("CHAIR_001"))) == "chair"
    assert value(S.or_misc(F.lit("  "))) == "misc"
    assert value(S.category(F.lit(" a   b "))) == "A B"
    assert value(S.unicode_category(F.lit("﻿a b–c"))) == "A B-C"
    assert value(S.handle(F.lit("CHAIR__001"))) is None
    assert value(S.handle(F.lit("CHAIR__1000"))) == "1000"
    assert value(S.handle(F.lit("X_H1A2B3"))) == "1A2B3"
    assert value(S.handle(F.lit("THEADBEEF"))) == "EADBEEF"
    assert value(S.name_similarity(F.lit("Chair"), F.lit("armchair"))) == pytest.approx(0.275)
    assert value(S.rgb_hex(F.lit(255), F.lit(0), F.lit(10))) == "#FF000A"
    assert value(S.safe_chars(F.lit('a<>b"'))) == "a__b_"
    assert value(S.safe_runs(F.lit('a<>b'))) == "a_b"
    assert value(S.without_index(F.lit("Chair__012"))) == "Chair"
    assert value(S.first_line(F.lit("a \nb"))) == "a"
    assert value(S.stem(F.lit("/x/y/Chair.PNG"))) == "Chair"
    assert value(S.suffix(F.lit("/x/y/Chair.PNG"))) == ".png"
    assert value(S.first_of(F.lit(" "), F.lit(None).cast("string"), F.lit("z"))) == "z"


def test_similarity(value):
    assert value(C.hamming(F.lit(12).cast("long"), F.lit(10).cast("long"))) == 2
    assert value(C.cosine(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(1.0)))) == pytest.approx(0.8)
    h = value(C.hash_similarity(F.lit(8), F.lit(16)))
    assert h == pytest.approx(0.825)
    assert value(C.final_score(F.lit(h), F.lit(0.5))) == pytest.approx(0.7275)
    assert value(C.composite_score(F.lit(10), F.lit(3.0), F.lit(0.1), F.lit(0.4), F.lit(20), F.lit(12))) == pytest.approx(12.44)
    same = F.array(*(F.lit(float(i)) for i in range(8)))
    turned = F.array(*(F.lit(float((i + 3) % 8)) for i in range(8)))
    assert value(C.circular_correlation(same, turned, 8)) == pytest.approx(1.0)
    assert value(C.correlation(same, same)) == pytest.approx(1.0)
    gaps = dict(width=F.lit(0.2), depth=F.lit(0.0), aspect=F.lit(math.log(2 / 1.6)), angles=F.lit(0.0), counts=F.lit(0.2), parts=F.lit(0.5))
    assert value(C.geometry_similarity(**gaps)) == pytest.approx(0.867819, abs=2e-6)


def test_accepted(value):
    from plumbline.operators.matching import accepted

    assert value(accepted(F.lit(10), F.lit(20), F.lit(12), F.lit(0.4)))
    assert not value(accepted(F.lit(20), F.lit(10), F.lit(20), F.lit(0.9)))


def test_images():
    import numpy as np

    from plumbline.functions.images import difference_word, frequency_word

    image = np.tile(np.arange(32) * 8, 32)
    assert difference_word(image, 32) == -1
    assert difference_word(image[::-1].copy(), 32) == 0
    assert frequency_word(image, 32) == frequency_word(np.repeat(np.repeat(image.reshape(32, 32), 2, 0), 2, 1).ravel(), 64)


def test_otsu(value):
    from plumbline.functions.images import dark_share, otsu_threshold

    pixels = F.array(*(F.lit(v) for v in [10, 12, 11, 200, 210, 205, 10]))
    assert 12 <= value(otsu_threshold(pixels)) < 200
    assert value(dark_share(pixels)) == pytest.approx(4 / 7)
