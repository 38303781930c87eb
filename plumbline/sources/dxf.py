"""Drawings in ASCII DXF as a Spark data source.

The public format is pairs of lines, a group code and a value. Each file is one
partition; rows are entities of the drawing in document order, and of its block
definitions, with nested inserts left to explode_inserts().

    spark.dataSource.register(DxfSource)
    spark.read.format("plumbline_dxf").load("folder/*.dxf")
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_POINT = "struct<x:double,y:double>"
_CORNER = "struct<x:double,y:double,bulge:double>"
SCHEMA = (
    "drawing string, insunits int, block string, ent_ord long, handle string, etype string, layer string, name string, text string, "
    f"true_color int, aci int, closed boolean, p0 {_POINT}, p1 {_POINT}, radius double, a0 double, a1 double, rotation double, sx double, sy double, "
    f"verts array<{_CORNER}>, attribs map<string,string>, "
    f"ratio double, curve array<{_POINT}>, loops array<array<{_CORNER}>>, base {_POINT}, flipped boolean, n_cols int, n_rows int, col_gap double, row_gap double"
)
_NAMES = [f.strip().split(" ")[0] for f in re.sub(r"<[^ ]*>", "", SCHEMA).split(",")]
#: Entity types that are read; LAYER rows come from the layer table, ERROR rows stand for records that can't be read.
TYPES = ("LINE", "LWPOLYLINE", "POLYLINE", "ARC", "CIRCLE", "ELLIPSE", "SPLINE", "HATCH", "INSERT", "TEXT", "MTEXT")
#: Points of a spline's curve and of an ellipse's, less one.
SPLINE_STEPS, ELLIPSE_STEPS = 32, 64

Tags = list[tuple[int, str]]


def records(text: str) -> Iterator[tuple[str, Tags, str | None]]:
    """(type, group codes with values, what is wrong) of each record: what starts with a code 0.

    Where a group code isn't a number, the record is given with what is wrong, and
    reading goes on with the next record. A trailing odd line is passed over.
    """
    lines = text.splitlines()
    kind, tags, i = "", [], 0
    while i + 1 < len(lines):
        try:
            code = int(lines[i].strip())
        except ValueError:
            yield kind, tags, f"line {i + 1}: not a group code: {lines[i].strip()[:40]!r}"
            while i + 1 < len(lines) and not (lines[i].strip() == "0" and re.fullmatch(r"[A-Z][A-Z0-9_]*", lines[i + 1].strip())):
                i += 1
            kind, tags = "", []
            continue
        if code == 0:
            if kind:
                yield kind, tags, None
            kind, tags = lines[i + 1].strip(), []
        else:
            tags.append((code, lines[i + 1].strip()))
        i += 2
    if kind:
        yield kind, tags, None


def _first(tags: Tags, code: int, cast=str, default=None):
    for c, value in tags:
        if c == code:
            return cast(value)
    return default


def _corners(tags: Tags, x: int = 10, bulges: bool = True) -> list[tuple[float, ...]]:
    """Points that begin with code x, each with the bulge behind it."""
    out: list[list[float]] = []
    for code, value in tags:
        if code == x:
            out.append([float(value), 0.0, 0.0])
        elif out and code == x + 10:
            out[-1][1] = float(value)
        elif out and bulges and code == 42:
            out[-1][2] = float(value)
    return [tuple(p) if bulges else tuple(p[:2]) for p in out]


def curve_points(degree: int, knots: list[float], points: list[tuple[float, float]], weights: list[float], steps: int) -> list[tuple[float, float]]:
    """A rational B-spline at equal steps of its parameter, by corner cutting for all steps at once."""
    n = len(points)
    if degree < 1 or n <= degree or len(knots) != n + degree + 1 or weights and len(weights) != n:
        raise ValueError(f"a spline of degree {degree} with {n} points, {len(knots)} knots and {len(weights)} weights")
    u = np.asarray(knots, float)
    w = np.asarray(weights or [1.0] * n, float)
    held = np.column_stack((np.asarray(points, float) * w[:, None], w))
    t = np.linspace(u[degree], u[n], steps + 1)
    span = np.clip(np.searchsorted(u, t, side="right") - 1, degree, n - 1)
    d = [held[span - degree + j] for j in range(degree + 1)]
    for r in range(1, degree + 1):
        for j in range(degree, r - 1, -1):
            low, high = u[span - degree + j], u[span + 1 + j - r]
            share = np.divide(t - low, high - low, out=np.zeros_like(t), where=high > low)[:, None]
            d[j] = (1 - share) * d[j - 1] + share * d[j]
    out = d[degree][:, :2] / d[degree][:, 2:]
    return [(float(x), float(y)) for x, y in out]


def _ellipse(c: tuple, major: tuple, ratio: float, start: float, end: float, steps: int) -> list[tuple[float, float]]:
    """Points of an ellipse from one parameter to another, anticlockwise."""
    turn = (end - start) % (2 * math.pi) or 2 * math.pi
    at = [start + turn * i / steps for i in range(steps + 1)]
    return [(c[0] + math.cos(t) * major[0] - math.sin(t) * ratio * major[1], c[1] + math.cos(t) * major[1] + math.sin(t) * ratio * major[0]) for t in at]


def _edge(kind: int, tags: Tags) -> list[tuple[float, float, float]]:
    """An edge of a boundary as corners without its last point."""
    if kind == 1:
        (x, y), = _corners(tags, 10, False)
        return [(x, y, 0.0)]
    if kind == 2:
        (x, y), = _corners(tags, 10, False)
        r, a, b, left = _first(tags, 40, float), _first(tags, 50, float), _first(tags, 51, float), _first(tags, 73, int, 1)
        sweep = (b - a) % 360 or 360.0
        side = 1 if left else -1  # a clockwise arc has its angles mirrored
        halves = [(math.radians(side * (a + sweep * k / 2)), side * math.tan(math.radians(sweep / 8))) for k in (0, 1)]
        return [(x + r * math.cos(t), y + r * math.sin(t), bulge) for t, bulge in halves]
    if kind == 3:
        (c,), (major,) = _corners(tags, 10, False), _corners(tags, 11, False)
        a, b, left = (math.radians(_first(tags, k, float)) for k in (50, 51)), None, _first(tags, 73, int, 1)
        start, end = a
        ratio = _first(tags, 40, float) * (1 if left else -1)
        return [(x, y, 0.0) for x, y in _ellipse(c, major, ratio, start, end, ELLIPSE_STEPS)[:-1]]
    if kind == 4:
        knots, weights = ([float(v) for c, v in tags if c == k] for k in (40, 42))
        return [(x, y, 0.0) for x, y in curve_points(_first(tags, 94, int), knots, _corners(tags, 10, False), weights, SPLINE_STEPS)[:-1]]
    raise ValueError(f"boundary edge of type {kind}")


def boundaries(tags: Tags) -> list[list[tuple[float, float, float]]]:
    """The closed loops of a hatch as corners, arcs as bulges, other curves as points."""
    at = next((i for i, (c, _) in enumerate(tags) if c == 91), None)
    loops: list = []
    if at is None:
        return loops
    count, i = int(tags[at][1]), at + 1
    while len(loops) < count and i < len(tags):
        if tags[i][0] != 92:
            i += 1
            continue
        flags, i = int(tags[i][1]), i + 1
        end = next((j for j in range(i, len(tags)) if tags[j][0] in (92, 97, 75)), len(tags))
        own = tags[i:end]
        if flags & 2:
            loops.append(_corners([t for t in own if t[0] in (10, 20, 42)]))
        else:
            starts = [j for j, (c, _) in enumerate(own) if c == 72]
            loops.append([p for a, b in zip(starts, [*starts[1:], len(own)]) for p in _edge(int(own[a][1]), own[a + 1 : b])])
        i = end
    return loops


def _row(drawing: str, units: int, block: tuple | None, order: int, kind: str, tags: Tags, verts: list, attribs: dict) -> tuple:
    """A row of SCHEMA. What is given in a mirrored plane (its normal points down) is turned over, an insert only marked."""
    first = lambda code, cast=float, default=None: _first(tags, code, cast, default)
    point = lambda code: (first(code), first(code + 10)) if first(code) is not None and first(code + 10) is not None else None
    flags = first(70, int, 0)
    p0, p1 = point(10), point(11)
    a0, a1 = first(50), first(51)
    closed, curve, loops, ratio = bool(flags & 1), None, None, None
    verts = _corners(tags) if kind == "LWPOLYLINE" else verts
    if kind == "ELLIPSE":
        ratio = first(40, float, 1.0)
        curve = _ellipse(p0, p1, ratio, first(41, float, 0.0), first(42, float, 2 * math.pi), ELLIPSE_STEPS)
    elif kind == "SPLINE":
        p0 = p1 = None
        knots, weights = ([float(v) for c, v in tags if c == k] for k in (40, 41))
        points = _corners(tags, 10, False)
        curve = curve_points(first(71, int, 3), knots, points, weights, SPLINE_STEPS) if points else _corners(tags, 11, False)
    elif kind == "HATCH":
        p0 = p1 = None
        loops = boundaries(tags)
    down = first(230, float, 1.0) < 0 and kind in ("LWPOLYLINE", "POLYLINE", "ARC", "CIRCLE", "TEXT", "INSERT", "HATCH")
    if down and kind != "INSERT":
        over = lambda ring: [(-x, y, -b) for x, y, b in ring]
        p0, verts = p0 and (-p0[0], p0[1]), over(verts)
        loops = loops and [over(x) for x in loops]
        if kind == "ARC":
            a0, a1 = 180.0 - a1, 180.0 - a0
    text = "".join(v for c, v in tags if c in (1, 3)) if kind == "MTEXT" else first(1, str)
    cells = (max(1, first(70, int, 1)), max(1, first(71, int, 1)), first(44, float, 0.0), first(45, float, 0.0)) if kind == "INSERT" else (1, 1, 0.0, 0.0)
    return (
        drawing, units, block and block[0], order, first(5, str), kind, first(8, str), first(2, str), text, first(420, int), first(62, int), closed, p0, p1,
        first(40) if kind in ("ARC", "CIRCLE") else None, a0, a1, first(50, float, 0.0), first(41, float, 1.0) if kind == "INSERT" else 1.0, first(42, float, 1.0) if kind == "INSERT" else 1.0,
        verts, attribs, ratio, curve, loops, block and block[1], down, *cells,
    )


def parse(text: str, drawing: str) -> Iterator[tuple]:
    """Rows of SCHEMA for one drawing; layers are rows of type LAYER, with their colours.

    A record that can't be read gives a row of type ERROR with its type as name and
    what is wrong as text; all others are as they would be without it.
    """
    units, block, order = 0, None, 0
    owner: tuple | None = None  # a POLYLINE or INSERT whose VERTEX or ATTRIB records follow: its order, type, tags, vertices, attributes

    def made(order: int, kind: str, tags: Tags, verts: list, attribs: dict, wrong: str | None = None) -> tuple:
        if wrong is None:
            try:
                return _row(drawing, units, block, order, kind, tags, verts, attribs)
            except (ValueError, TypeError, IndexError) as error:
                wrong = str(error)
        blank = dict.fromkeys(_NAMES)
        blank |= {"drawing": drawing, "insunits": units, "block": block and block[0], "ent_ord": order, "handle": _first(tags, 5), "etype": "ERROR", "layer": _first(tags, 8), "name": kind, "text": wrong, "closed": False}
        return tuple(blank.values())

    for kind, tags, wrong in records(text):
        if kind in ("VERTEX", "ATTRIB", "SEQEND") and owner is not None and wrong is None:
            try:
                if kind == "VERTEX":
                    owner[3].append((_first(tags, 10, float, 0.0), _first(tags, 20, float, 0.0), _first(tags, 42, float, 0.0)))
                elif kind == "ATTRIB":
                    owner[4][_first(tags, 2, str, "").upper()] = _first(tags, 1, str, "")
            except ValueError as error:
                wrong = str(error)
            if kind == "SEQEND":
                done, owner = owner, None
                yield made(*done)
            if wrong is None:
                order += kind in ("VERTEX", "ATTRIB", "SEQEND")
                continue
        if owner is not None:
            done, owner = owner, None
            yield made(*done)
        if wrong is not None:
            yield made(order, kind, tags, [], {}, wrong)
            order += 1
            continue
        if kind in ("SECTION", "ENDSEC", "ENDBLK", "EOF"):
            block = None if kind in ("ENDBLK", "ENDSEC") else block
            for (code, name), (next_code, value) in zip(tags, tags[1:]):
                if code == 9 and name == "$INSUNITS" and next_code == 70:
                    try:
                        units = int(value)
                    except ValueError as error:
                        yield made(order, "$INSUNITS", [], [], {}, str(error))
                        order += 1
            continue
        if kind == "BLOCK":
            try:
                block = (_first(tags, 2, str, ""), (_first(tags, 10, float, 0.0), _first(tags, 20, float, 0.0)))
            except ValueError as error:
                block = (_first(tags, 2, str, ""), (0.0, 0.0))
                yield made(order, kind, tags, [], {}, str(error))
                order += 1
            continue
        if kind == "POLYLINE" or kind == "INSERT" and _first(tags, 66):
            owner = (order, kind, tags, [], {})
        elif kind in TYPES or kind == "LAYER":
            yield made(order, kind, tags, [], {})
        order += 1
    if owner is not None:
        yield made(*owner)


def errors(entities: DataFrame) -> DataFrame:
    """(drawing, ent_ord, block, type, message) of records that couldn't be read."""
    return entities.where("etype = 'ERROR'").select("drawing", "ent_ord", "block", F.col("name").alias("type"), F.col("text").alias("message"))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "**", "*.dxf"), recursive=True) if os.path.isdir(self.path) else glob.glob(self.path))
        return [_File(p) for p in found if p.lower().endswith(".dxf")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8", errors="replace") as f:
            yield from parse(f.read(), partition.value)


class DxfSource(DataSource):
    """Files that each worker can open by their path; read_drawings() takes any store that Spark reads."""

    @classmethod
    def name(cls) -> str:
        return "plumbline_dxf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_drawings(spark, path: str) -> DataFrame:
    """Drawings below a path of any store, through Spark's binary files: one row for each entity."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dxf").option("recursiveFileLookup", "true").load(path)

    names = StructType.fromDDL(SCHEMA).names

    def read(batches):
        import pandas as pd

        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                rows = list(parse(bytes(content).decode("utf-8", "replace"), p))
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(read, SCHEMA)


def nestings(entities: DataFrame) -> int:
    """How many blocks deep inserts go, 1 at least; an error where a placed block contains itself.

    Works on the names of blocks inside blocks alone. Those that nothing is nested
    below are taken away round by round; what can't be taken away is a cycle.
    """
    spark = entities.sparkSession
    cut = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) else (lambda df: df.persist())
    inserts = entities.where("etype = 'INSERT'")
    inner = cut(inserts.where("block IS NOT NULL").select("drawing", "block", F.col("name").alias("inner")).distinct())
    placed, n = cut(inserts.where("block IS NULL").select("drawing", F.col("name").alias("block")).distinct()), -1
    while (m := placed.count()) != n:
        n = m
        placed = cut(placed.unionByName(placed.join(inner, ["drawing", "block"]).select("drawing", F.col("inner").alias("block"))).distinct())
    left, rounds, n = cut(inner.join(placed, ["drawing", "block"], "left_semi")), 1, -1
    while m := left.count():
        if m == n:
            raise ValueError(f"blocks contain themselves: {[tuple(r) for r in left.limit(5).collect()]}")
        n, rounds = m, rounds + 1
        left = cut(left.join(left.select("drawing", F.col("block").alias("inner")).distinct(), ["drawing", "inner"], "left_semi"))
    return rounds


def explode_inserts(entities: DataFrame, depth: int | None = None) -> DataFrame:
    """Block geometry in world coordinates, by composing placements as deep as they are nested.

    A placement takes a block's base point to each cell of its insert's array, scaled,
    turned and, where the insert's normal points down, mirrored. A bound on the depth
    may be given; drawings nested deeper are then an error. Each round joins inserts
    with the entities of the blocks they place; entities that aren't inserts come out
    with transformed points (and curves and loops), inserts go into the next round.
    """
    have = set(entities.columns)
    col = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    grid = lambda n: F.sequence(F.lit(0), col(n, 1) - 1)
    cells = F.flatten(F.transform(grid("n_rows"), lambda r: F.transform(grid("n_cols"), lambda c: F.struct((c * col("col_gap", 0.0)).alias("x"), (r * col("row_gap", 0.0)).alias("y")))))
    none = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    base = F.coalesce(F.col("base"), none[0]) if "base" in have else none[0]
    flip = F.when(col("flipped", False), -1.0).otherwise(1.0)
    turn = F.radians(F.coalesce(F.col("rotation"), F.lit(0.0)))
    # An insert's own placement, in the coordinates of the block or drawing that it stands in.
    at_x, at_y = (F.coalesce(F.col(f"p0.{k}"), F.lit(0.0)) for k in "xy")
    cell_x, cell_y = F.col("_cell.x"), F.col("_cell.y")
    own = F.struct(
        (flip * (at_x + F.cos(turn) * cell_x - F.sin(turn) * cell_y)).alias("tx"), (at_y + F.sin(turn) * cell_x + F.cos(turn) * cell_y).alias("ty"),
        (flip * F.cos(turn) * F.col("sx")).alias("m00"), (-flip * F.sin(turn) * F.col("sy")).alias("m01"), (F.sin(turn) * F.col("sx")).alias("m10"), (F.cos(turn) * F.col("sy")).alias("m11"),
    )
    rows = entities.withColumn("_cell", F.explode(F.when(F.col("etype") == "INSERT", cells).otherwise(none)))
    extra = [c for c in ("curve", "loops") if c in have]
    blocks = rows.where("block IS NOT NULL").select("drawing", F.col("block").alias("placed"), base.alias("base"), F.struct("etype", "layer", "name", "closed", "p0", "p1", "radius", "verts", *extra, F.when(F.col("etype") == "INSERT", own).alias("own")).alias("e"))
    live = rows.where("block IS NULL AND etype = 'INSERT'").select("drawing", F.coalesce("handle", F.concat(F.lit("#"), F.col("ent_ord").cast("string"))).alias("insert_id"), F.col("name").alias("placed"), own.alias("m"))
    out, rounds = None, nestings(entities)
    if depth is not None and rounds > depth:
        raise ValueError(f"inserts are nested {rounds} deep, beyond {depth}")
    mul = lambda k, x, y: F.col(f"m.{k}0") * x + F.col(f"m.{k}1") * y
    for _ in range(rounds):
        j = live.join(blocks, ["drawing", "placed"])
        shift = lambda x, y: (x - F.col("base.x"), y - F.col("base.y"))
        place = lambda p: F.struct((mul("m0", *shift(p["x"], p["y"])) + F.col("m.tx")).alias("x"), (mul("m1", *shift(p["x"], p["y"])) + F.col("m.ty")).alias("y"))
        side = F.signum(F.col("m.m00") * F.col("m.m11") - F.col("m.m01") * F.col("m.m10"))  # a mirrored bulge goes to the other side
        corners = lambda ring: F.transform(ring, lambda v: F.struct(place(v)["x"].alias("x"), place(v)["y"].alias("y"), (side * v["bulge"]).alias("bulge")))
        more = {"curve": lambda: F.transform("e.curve", place), "loops": lambda: F.transform("e.loops", corners)}
        point = lambda k: F.when(F.col(f"e.{k}").isNotNull(), place(F.col(f"e.{k}")))
        size = F.sqrt(F.abs(F.col("m.m00") * F.col("m.m11") - F.col("m.m01") * F.col("m.m10")))
        flat = j.where("e.etype <> 'INSERT'").select("drawing", "insert_id", "e.etype", "e.layer", "e.closed", point("p0").alias("p0"), point("p1").alias("p1"), (F.col("e.radius") * size).alias("radius"), corners(F.col("e.verts")).alias("verts"), *(more[c]().alias(c) for c in extra))
        out = flat if out is None else out.unionByName(flat)
        o = lambda k: F.col(f"e.own.{k}")
        there = place(F.struct(o("tx").alias("x"), o("ty").alias("y")))
        deeper = F.struct(there["x"].alias("tx"), there["y"].alias("ty"), mul("m0", o("m00"), o("m10")).alias("m00"), mul("m0", o("m01"), o("m11")).alias("m01"), mul("m1", o("m00"), o("m10")).alias("m10"), mul("m1", o("m01"), o("m11")).alias("m11"))
        live = j.where("e.etype = 'INSERT'").select("drawing", "insert_id", F.col("e.name").alias("placed"), deeper.alias("m"))
    return out
