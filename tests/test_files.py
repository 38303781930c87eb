"""Image files, reports as files, samples of curves, selections and counters on small inputs."""

import math
import random
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import paths as P
from plumbline.functions import strings as S
from plumbline.operators import cleanup, selection
from plumbline.sources import images, sinks


def encoded(pixels, kind, colour):
    """An RGB or grey PNG whose rows all use one prediction, written plainly."""
    h, w, n = pixels.shape
    flat = pixels.reshape(h, w * n).astype(int)
    raw = bytearray()
    for y in range(h):
        raw.append(kind)
        for x in range(w * n):
            a = flat[y, x - n] if x >= n else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - n] if y and x >= n else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            raw.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")


def test_png_predictions():
    rng = np.random.default_rng(1)
    for kind in range(5):
        one = rng.integers(0, 256, (7, 5, 1))
        assert (images.grey(encoded(one, kind, 0)) == one[:, :, 0]).all()
        rgb = rng.integers(0, 256, (4, 6, 3))
        want = np.floor(rgb @ np.array([0.299, 0.587, 0.114]) + 0.5)
        assert (images.grey(encoded(rgb, kind, 2)) == want).all()
    pixels = rng.integers(0, 256, (9, 3)).astype(np.uint8)
    assert (images.grey(images.png(pixels)) == pixels).all()
    for bad in (b"", b"GIF89a", images.png(pixels)[:40], images.png(pixels)[:-30]):
        assert images.grey(bad) is None


def test_image_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    pixels = np.arange(12, dtype=np.uint8).reshape(3, 4)
    (tmp_path / "a" / "One.PNG").write_bytes(images.png(pixels))
    (tmp_path / "two.jpg").write_bytes(b"not an image")
    (tmp_path / "three.txt").write_text("text")
    rows = {r["stem"]: r for r in images.decoded(images.list_images(spark, str(tmp_path))).collect()}
    assert set(rows) == {"One", "two"}
    assert rows["One"]["width"] == 4 and rows["One"]["pixels"] == list(range(12))
    assert rows["two"]["width"] is None and rows["two"]["pixels"] is None
    table = spark.createDataFrame([("x/y", 1, 2, [1, 2, 3, 4]), ("x/y", 2, 2, [5, 6, 7, 8]), ("z", 3, None, None)], "block string, ent int, width int, pixels array<int>")
    out = {r["file"]: r["content"] for r in images.image_rows(table, "block", "ent").collect()}
    assert set(out) == {"x_y__001.png", "x_y__002.png", "z__001.png"} and out["z__001.png"] is None
    assert images.grey(bytes(out["x_y__002.png"])).tolist() == [[5, 6], [7, 8]]
    assert "z__cluster001.png" in {r["file"] for r in images.image_rows(table, "block", "ent", clusters=True).collect()}


def test_report_files(spark, tmp_path):
    rows = spark.createDataFrame([("d/one.dxf", "INSERT", "ä"), ("d/two.dxf", "LAYER", "b")], "drawing string, entity_type string, qty string")
    named = sinks.renamed(rows, {"entity_type": "Type", "absent": "x"})
    assert named.columns == ["drawing", "Type", "qty"]
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "mark"), mark=True)
    for file in (tmp_path / "mark").glob("*.csv"):
        assert file.read_bytes().startswith(b"\xef\xbb\xbfdrawing,")
    sinks.write_csv_by_drawing(rows, str(tmp_path / "by"))
    assert {p.name for p in (tmp_path / "by").glob("file=*")} == {"file=one_raw_extract", "file=two_raw_extract"}
    for _ in range(2):
        sinks.write_tabs(rows, str(tmp_path / "tabs"), replace=False)
    assert spark.read.parquet(str(tmp_path / "tabs" / "detail")).count() == 2
    assert [r["qty"] for r in spark.read.parquet(str(tmp_path / "tabs" / "summary")).collect()] == ["b"]


def test_samples(spark):
    row = spark.range(1).select(G.circle_samples(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("c"), G.arc_samples(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(math.pi), F.lit(0.0)).alias("a")).first()
    assert len(row["c"]) == 64 and len(row["a"]) == 33
    assert all(abs(math.dist((p["x"], p["y"]), (1, 2)) - 3) < 1e-9 for p in row["c"])
    assert abs(row["a"][0]["x"] + 2) < 1e-9 and abs(row["a"][32]["x"] - 2) < 1e-9 and abs(row["a"][16]["y"] - 2) < 1e-9
    line = P.sampled([(0.0, 0.0), (10.0, 0.0)], 3.0)
    assert [round(x, 9) for x, _ in line] == [0.0, 2.5, 5.0, 7.5, 10.0]
    assert P.sampled([(1.0, 1.0), (1.0, 1.0)], 3.0) == []
    circle = [(math.cos(t / 500 * 2 * math.pi), math.sin(t / 500 * 2 * math.pi)) for t in range(501)]
    fine = P.sampled(circle, 1.0)
    turns = [abs(math.degrees(math.atan2(u[0] * v[1] - u[1] * v[0], u[0] * v[0] + u[1] * v[1]))) for u, v in (((b[0] - a[0], b[1] - a[1]), (c[0] - b[0], c[1] - b[1])) for a, b, c in zip(fine, fine[1:], fine[2:]))]
    assert len(P.sampled(circle, 100.0)) >= 3 and max(turns) < 61
    assert len(P.sampled([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], 0.7)) < 200
    shape = "array<struct<x:double,y:double>>"
    paths = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0)]), (2, [(0.0, 0.0)]), (3, [(0.0, 0.0), (5.0, 5.0), (5.0, -5.0), (0.0, 0.0)])], f"id int, verts {shape}")
    got = {r["id"]: r for r in paths.select("id", P.samples_by_length(F.col("verts"), 3.0).alias("s"), P.spline_samples(F.col("verts")).alias("b")).collect()}
    assert (len(got[1]["s"]), len(got[1]["b"])) == (5, 65) and (len(got[2]["s"]), len(got[2]["b"])) == (0, 1) and len(got[3]["b"]) == 64


def test_selections(spark):
    e = spark.createDataFrame([(1, "LINE", "WALL"), (2, "TEXT", "WALL"), (3, "LINE", "DIM"), (4, None, None), (5, "LEADER", "WALL")], "ent_id int, etype string, layer string")
    ids = lambda df: sorted(r["ent_id"] for r in df.collect())
    assert ids(selection.drawn(e)) == [1, 4, 5] and ids(selection.featured(e)) == [1, 3, 4]
    assert ids(selection.selected(e, ["LINE"])) == [1, 3]
    assert ids(selection.selected(e, ["LINE"], spark.createDataFrame([(3,), (3,), (9,)], "ent_id int"))) == [3]
    b = spark.createDataFrame([("A",), ("*U12",), ("*Model_Space",), (None,)], "block string")
    assert [r["block"] for r in selection.named_blocks(b).collect()] == ["A"]


def test_text_of_content(spark):
    data = bytes(range(256))
    row = spark.createDataFrame([(data,)], "c binary").select(S.as_base64(F.col("c")).alias("t"), S.from_base64(S.as_base64(F.col("c"))).alias("c"), S.run_id().alias("run")).first()
    import base64
    import re

    assert row["t"] == base64.b64encode(data).decode() and bytes(row["c"]) == data
    assert re.fullmatch(r"r\d{8}-\d{4}-[0-9a-f]{6}", row["run"])


def test_counters_and_own_cells(spark):
    line = lambda *p: [(x, y, 0.0) for x, y in p]
    rows = [
        ("a", "d", "s", line((0.0, 0.0), (10.0, 0.0)), False),
        ("b", "d", "s", line((10.0, 0.0), (0.0, 0.0)), False),  # equal from the other end
        ("c", "d", "s", line((0.0, 0.2), (10.0, 0.2)), False),  # near a
        ("d", "d", "s", line((50.0, 0.0), (50.1, 0.0)), False),  # short
        ("e", "d", "t", line((0.0, 0.0), (10.0, 0.0)), False),  # another style
    ]
    kind = "piece_id string, drawing string, style string, verts array<struct<x:double,y:double,bulge:double>>, closed boolean"
    got = cleanup.run_counters(spark.createDataFrame(rows, kind), 0.5, 1.0).first().asDict()
    assert got == {"created": 2, "duplicates": 1, "twins": 1, "short": 1}
    assert cleanup.run_counters(spark.createDataFrame([], kind), 0.5).first().asDict() == {"created": 0, "duplicates": 0, "twins": 0, "short": 0}
    ends = [("a", 1, "s", line((0.0, 0.0), (1.4, 0.0)), False), ("b", 1, "s", line((1.6, 0.0), (5.0, 0.0)), False)]
    kind = kind.replace("drawing string", "drawing long")
    chains = lambda own: sorted(r["n_pieces"] for r in cleanup.join_chains(spark.createDataFrame(ends, kind), 1.0, own).collect())
    assert chains(False) == [2] and chains(True) == [1, 1]
