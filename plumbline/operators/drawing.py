"""From the entities of drawings to bills of quantities: measures, colours, zones, inserts, the report.

Entities are rows as sources/dxf.py gives them. All measures are columns; only the
greedy naming of zones by labels works on a drawing as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import strings as S
from ..session import kept
from . import boq, labels
from .zones import leveled_pairs

#: The colours of indices 1 to 9 and 250 to 255.
FIRST = [(255, 0, 0), (255, 255, 0), (0, 255, 0), (0, 255, 255), (0, 0, 255), (255, 0, 255), (255, 255, 255), (128, 128, 128), (192, 192, 192)]
GREYS = [51, 91, 132, 173, 214, 255]
#: Brightness of the five shades of a hue.
SHADES = (1.0, 0.65, 0.5, 0.3, 0.15)
GREY = (200, 200, 200)
#: Types without geometry that counts, and layers that are notes.
SKIPPED_TYPES = ("TEXT", "MTEXT", "DIMENSION", "LEADER", "ATTRIB", "ATTDEF")
ZONE_LAYER = "PLANNER"
#: Attributes that may name a zone.
ZONE_TAGS = ("NAME", "ROOM", "ZONE", "LABEL", "TITLE")


# ---------------------------------------------------------------- colours
def palette() -> list[tuple[int, int, int]]:
    """The colours of indices 0 to 255, by the rule: 24 hues from 10 on, five shades of each, full and half saturated."""
    out = [(0, 0, 0), *FIRST]
    for i in range(10, 250):
        sector, part = divmod((i // 10 - 1) * 15, 60)
        top = 255 * SHADES[i % 10 // 2]
        floor = top / 2 if i % 2 else 0.0
        rise = floor + (top - floor) * part / 60
        fall = floor + (top - floor) * (60 - part) / 60
        rgb = [(top, rise, floor), (fall, top, floor), (floor, top, rise), (floor, fall, top), (rise, floor, top), (top, floor, fall)][sector]
        out.append(tuple(int(x) for x in rgb))
    return out + [(g, g, g) for g in GREYS]


def _number(rgb: tuple[int, int, int]) -> int:
    return rgb[0] << 16 | rgb[1] << 8 | rgb[2]


def index_colour(aci: Column) -> Column:
    """The colour of an index as a number; null outside 1 to 255."""
    table = F.array(*(F.lit(_number(c)) for c in palette()))
    return F.when(aci.between(1, 255), F.element_at(table, aci + 1))


def entity_colour(true_color: Column, aci: Column, layer_color: Column) -> Column:
    """The entity's true colour, else its index, else its layer's colour, else grey; as a number."""
    return F.coalesce(F.nullif(true_color, F.lit(0)), index_colour(aci), layer_color, F.lit(_number(GREY)))


def layer_colours(entities: DataFrame) -> DataFrame:
    """(drawing, layer, layer_color) from the layer table's rows: a true colour, else the index, 7 where it is none."""
    rows = entities.where("etype = 'LAYER'")
    colour = F.coalesce(F.nullif("true_color", F.lit(0)), index_colour(F.abs("aci")), F.lit(_number(FIRST[6])))
    return rows.groupBy("drawing", S.or_misc(F.col("name")).alias("layer")).agg(F.first(colour).alias("layer_color"))


def hex_colour(number: Column) -> Column:
    part = lambda n: F.shiftright(number, n).bitwiseAND(255)
    return S.rgb_hex(part(16), part(8), part(0))


# ---------------------------------------------------------------- measures
def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(0.0).alias("bulge"))


def flattened(verts: Column, closed: Column) -> Column:
    """A polyline's points with its bulges as arcs; a closed one ends before its first point."""
    part = lambda p: G.let(G.bulge_points(p["a"], p["b"], p["a"]["bulge"]), lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda v: _point(v["x"], v["y"])))
    dense = F.flatten(F.transform(G.closed_pairs(verts, closed), part))
    last = F.element_at(verts, -1)
    return F.when(F.size(verts) < 2, F.transform(verts, lambda v: _point(v["x"], v["y"]))).when(closed, dense).otherwise(F.concat(dense, F.array(_point(last["x"], last["y"]))))


def outline(e: DataFrame) -> Column:
    """The points that an entity's extents come from: of hatches the corners of their loops, of ellipses and splines their curve."""
    col = lambda c: e[c] if c in e.columns else F.lit(None)
    arc = lambda a, b: F.transform(G.arc_points(col("p0")["x"], col("p0")["y"], col("radius"), a, b), lambda v: _point(v["x"], v["y"]))
    kind = col("etype")
    out = F.when(kind == "LINE", F.array(_point(col("p0")["x"], col("p0")["y"]), _point(col("p1")["x"], col("p1")["y"])))
    out = out.when(kind.isin("LWPOLYLINE", "POLYLINE"), flattened(col("verts"), col("closed"))).when(kind == "ARC", arc(col("a0"), col("a1")))
    out = out.when((kind == "CIRCLE") | (kind == "ELLIPSE") & col("radius").isNotNull(), arc(F.lit(0.0), F.lit(360.0)))
    if "loops" in e.columns:
        out = out.when(kind == "HATCH", F.flatten(F.transform("loops", lambda r: flattened(r, F.lit(True)))))
    if "curve" in e.columns:
        out = out.when(kind.isin("ELLIPSE", "SPLINE"), F.transform("curve", lambda v: _point(v["x"], v["y"])))
    return out.otherwise(F.transform(col("verts"), lambda v: _point(v["x"], v["y"])))


def filled_area(loops: Column) -> Column:
    """The area that nested loops fill by turns: a loop inside an even number of others adds its area, any other takes it away. Loops may touch, but not cross."""

    def signed(rings: Column) -> Column:
        depth = lambda ring, i: F.size(F.filter(rings, lambda other, j: (i != j) & G.inside(ring[0]["x"], ring[0]["y"], other)))
        return F.aggregate(F.transform(rings, lambda ring, i: G.ring_area(ring) * F.when(depth(ring, i) % 2 == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda t, x: t + x)

    whole = F.filter(F.transform(loops, lambda r: flattened(r, F.lit(True))), lambda r: F.size(r) >= 3)
    return F.when(loops.isNotNull(), G.let(whole, signed))


def measured(entities: DataFrame, rings: bool = False) -> DataFrame:
    """entities of the six measured types with open_len, perimeter, area and weight, in drawing units.

    Lines, arcs and open polylines have a length, closed polylines and circles a
    perimeter and an area, hatches their filled_area, or where that is missing and
    `rings` says so the area of their vertices. weight is the length or area that
    counts in a vote on colours. Other types go.
    """
    kind, closed = F.col("etype"), F.coalesce("closed", F.lit(False))
    path = kind.isin("LWPOLYLINE", "POLYLINE")
    rows = entities.where(kind.isin("LINE", "LWPOLYLINE", "POLYLINE", "ARC", "CIRCLE", "HATCH")).withColumn("_dense", F.when(path, flattened(F.col("verts"), closed)))
    length = G.path_length(F.col("_dense"), closed)
    known = [F.col("filled_area")] if "filled_area" in entities.columns else []
    if "loops" in entities.columns:
        known.append(filled_area(F.col("loops")))
    filled = F.coalesce(*known, F.lit(None).cast("double"))
    hatch = F.when(filled > 0, filled)
    if rings:
        hatch = F.coalesce(hatch, G.ring_area(F.col("verts")))
    open_len = F.when(kind == "LINE", G.distance(F.col("p0"), F.col("p1"))).when(kind == "ARC", G.arc_length(F.col("radius"), F.col("a0"), F.col("a1"))).when(path & ~closed, length)
    perimeter = F.when(kind == "CIRCLE", 2 * math.pi * F.col("radius")).when(path & closed, length)
    area = F.when(kind == "CIRCLE", math.pi * F.col("radius") * F.col("radius")).when(path & closed, G.ring_area(F.col("_dense"))).when(kind == "HATCH", hatch)
    out = rows.withColumn("open_len", open_len).withColumn("perimeter", perimeter).withColumn("area", area).drop("_dense")
    return out.withColumn("weight", F.when(kind == "HATCH", F.col("area")).otherwise(F.coalesce("open_len", "perimeter")))


def entity_layer_metrics(entities: DataFrame, target: str = "ft", rings: bool = False) -> DataFrame:
    """(drawing, layer, length, perimeter, area) in target units over all six types; values of 0 or less don't count.

    Sums are of decimals of nine places, so that they don't hang on the order, and are rounded once.
    """
    scale = G.unit_scale(F.col("insunits"))
    m = measured(entities, rings).withColumn("layer", S.or_misc(F.col("layer")))
    total = lambda c, power: G.rounded(F.coalesce(F.sum(F.when(F.col(c) > 0, G.to_units(F.col(c) * F.pow(scale, F.lit(power)), target, power).cast("decimal(38,9)"))).cast("double"), F.lit(0.0)))
    return m.groupBy("drawing", "layer").agg(total("open_len", 1).alias("length"), total("perimeter", 1).alias("perimeter"), total("area", 2).alias("area"))


def entity_layer_colours(entities: DataFrame) -> DataFrame:
    """(drawing, layer, colour, weight): the colour with the largest weight among a layer's entities, in metres; of equal ones the first seen."""
    scale = G.unit_scale(F.col("insunits"))
    rows = measured(entities).withColumn("layer", S.or_misc(F.col("layer"))).join(layer_colours(entities), ["drawing", "layer"], "left")
    rows = rows.withColumn("colour", entity_colour(F.col("true_color"), F.col("aci"), F.col("layer_color"))).withColumn("weight", F.col("weight") * F.when(F.col("etype") == "HATCH", scale * scale).otherwise(scale))
    keyed = rows.withColumn("_key", F.struct("drawing", "layer"))
    return boq.dominant(keyed, "_key", "colour", "weight", "ent_ord").select("_key.*", "colour", "weight")


# ---------------------------------------------------------------- zones and inserts
def insert_id() -> Column:
    """An insert's handle, or its place where it has none, as explode_inserts names it."""
    return F.coalesce("handle", F.concat(F.lit("#"), F.col("ent_ord").cast("string")))


def exploded(entities: DataFrame) -> DataFrame:
    """(drawing, insert_id, etype, closed, verts): block geometry in world coordinates, every entity as points."""
    from ..sources.dxf import explode_inserts

    flat = entities.withColumn("verts", outline(entities)).drop("curve", "loops")
    return explode_inserts(flat)


def insert_boxes(entities: DataFrame) -> DataFrame:
    """(drawing, insert_id, minx, miny, maxx, maxy) of each insert with geometry, over all that its block holds at any depth."""
    shapes = exploded(entities.where(~F.col("etype").isin(*SKIPPED_TYPES))).where("size(verts) > 0")
    return shapes.select("drawing", "insert_id", G.bounds(F.col("verts")).alias("b")).groupBy("drawing", "insert_id").agg(*(getattr(F, c[:3])(f"b.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")))


def planner_zones(entities: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """(drawing, zone_ord, zone, poly): the zones of each drawing, in order.

    Zones are the boxes of inserts on the zone layer, named by the first of their
    attributes NAME, ROOM, ZONE, LABEL, TITLE that has a text, else by their block;
    those of equal name and box count once. Only in a drawing without any, zones are
    the closed light polylines of that layer. These take the first unused label inside
    (texts, then the first lines of paragraphs), else the nearest unused one, else
    "Zone" and their number.
    """
    boxes = insert_boxes(entities) if boxes is None else boxes
    top = entities.where("block IS NULL")
    own = F.filter(F.map_entries("attribs"), lambda a: a["key"].isin(*ZONE_TAGS) & (F.trim(a["value"]) != ""))
    name = F.coalesce(F.trim(F.try_element_at(own, F.lit(1))["value"]), F.nullif(F.trim("name"), F.lit("")), F.lit("Zone"))
    marks = top.where((F.col("etype") == "INSERT") & (F.col("layer") == ZONE_LAYER)).select("drawing", insert_id().alias("insert_id"), "ent_ord", name.alias("zone"))
    corner = lambda x, y: _point(F.col(x), F.col(y))
    placed = marks.join(boxes, ["drawing", "insert_id"]).select("drawing", "zone", F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy")).alias("poly"), "ent_ord")
    placed = placed.groupBy("drawing", "zone", "poly").agg(F.min("ent_ord").alias("ent_ord"))
    number = F.row_number().over(Window.partitionBy("drawing").orderBy("ent_ord")).cast("long")
    drawn = top.where((F.col("etype") == "LWPOLYLINE") & (F.col("layer") == ZONE_LAYER) & F.col("closed")).select("drawing", "ent_ord", outline(top).alias("poly")).where("size(poly) >= 3")
    drawn = drawn.join(placed.select("drawing").distinct(), "drawing", "left_anti").withColumn("zone_ord", number)
    line = F.trim(F.when(F.col("etype") == "MTEXT", F.split(F.trim("text"), "\n")[0]).otherwise(F.col("text")))
    texts = top.where("etype IN ('TEXT', 'MTEXT') AND p0 IS NOT NULL").select("drawing", line.alias("text"), F.col("p0.x").alias("x"), F.col("p0.y").alias("y"), (F.col("etype") == "MTEXT").alias("later"), "ent_ord").where("text <> ''")
    texts = texts.withColumn("label_ord", F.row_number().over(Window.partitionBy("drawing").orderBy("later", "ent_ord")).cast("long")).drop("ent_ord", "later")
    near = texts.join(drawn.withColumn("c", G.centroid(F.concat("poly", F.slice("poly", 1, 1)))), "drawing")  # the first corner closes the outline and counts twice
    square = F.pow(F.col("x") - F.col("c.x"), F.lit(2.0)) + F.pow(F.col("y") - F.col("c.y"), F.lit(2.0))
    found = near.select("drawing", "zone_ord", "label_ord", "text", G.inside(F.col("x"), F.col("y"), F.col("poly")).alias("within"), square.alias("square"))
    named = labels.name_zones(found, "drawing").withColumnRenamed("text", "label")
    default = F.concat(F.lit("Zone "), F.lpad(F.col("zone_ord").cast("string"), F.greatest(F.lit(2), F.length(F.col("zone_ord").cast("string"))), F.lit("0")))
    drawn = drawn.join(named, ["drawing", "zone_ord"], "left").select("drawing", "zone_ord", F.coalesce("label", default).alias("zone"), "poly")
    return placed.withColumn("zone_ord", number).select("drawing", "zone_ord", "zone", "poly").unionByName(drawn)


def placed_inserts(entities: DataFrame, boxes: DataFrame | None = None, references: bool = False) -> DataFrame:
    """(drawing, insunits, ent_ord, handle, block_name, layer, x, y, length, width) of each insert but those on the zone layer.

    x and y are the middle of its box, length the box's longer extent; all four are null
    without geometry. External references (a bar in the name) are left out unless asked for.
    """
    boxes = insert_boxes(entities) if boxes is None else boxes
    top = entities.where(F.col("block").isNull() & (F.col("etype") == "INSERT") & (F.upper(S.or_misc(F.col("layer"))) != ZONE_LAYER))
    if not references:
        top = top.where(~F.coalesce(F.col("name"), F.lit("")).contains("|"))
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    sized = boxes.select("drawing", "insert_id", ((F.col("minx") + F.col("maxx")) * 0.5).alias("x"), ((F.col("miny") + F.col("maxy")) * 0.5).alias("y"), F.greatest(w, h).alias("length"), F.least(w, h).alias("width"))
    rows = top.select("drawing", "insunits", "ent_ord", "handle", insert_id().alias("insert_id"), F.col("name").alias("block_name"), "layer")
    return rows.join(sized, ["drawing", "insert_id"], "left").drop("insert_id")


def zoned_inserts(inserts: DataFrame, zones: DataFrame, target: str) -> DataFrame:
    """inserts with `zone`, the first in order that holds their middle, else empty; sizes in target units of two places."""
    size = lambda c: G.rounded(G.to_units(F.col(c) * G.unit_scale(F.col("insunits")), target), 2)
    held = leveled_pairs(inserts.select("drawing", "ent_ord", "x", "y"), zones, ["drawing"])
    first = held.groupBy("drawing", "ent_ord").agg(F.min_by("zone", "zone_ord").alias("zone"))
    return inserts.withColumns({"length": size("length"), "width": size("width")}).join(first, ["drawing", "ent_ord"], "left").withColumn("zone", F.coalesce("zone", F.lit("")))


#: The bill's columns.
BILL = ("drawing", "entity_type", "category", "zone", "category1", "boq_name", "qty_type", "qty_value", "length", "width", "perimeter", "area", "preview", "remarks")


def _bill(rows: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"qty_value": "double", "length": "double", "width": "double", "perimeter": "double", "area": "double"}
    return rows.select(*(columns.get(c, F.lit(None) if c in kinds or c == "preview" else F.lit("")).cast(kinds.get(c, "string")).alias(c) for c in BILL))


def insert_rows(entities: DataFrame, target: str = "ft", aggregated: bool = True, references: bool = False) -> DataFrame:
    """The bill's rows of inserts: by block and zone with their count and upper medians of the sizes, or one for each."""
    boxes = kept(insert_boxes(entities), "boxes")  # inserts and zones both ask for them
    rows = zoned_inserts(placed_inserts(entities, boxes, references), planner_zones(entities, boxes), target)
    rows = rows.withColumn("category1", F.lower(F.trim(F.coalesce("layer", F.lit("")))))
    name = F.coalesce("block_name", F.lit(""))
    if not aggregated:
        category = F.when(F.col("zone") != "", F.lit(ZONE_LAYER)).otherwise(S.or_misc(F.col("layer")))
        remark = F.concat(F.lit("dwg_layer="), F.coalesce("layer", F.lit("")), F.lit("; aggregated 1 inserts"))
        return _bill(rows, drawing=F.col("drawing"), entity_type=F.lit("INSERT"), category=category, zone=F.col("zone"), category1=F.col("category1"), boq_name=name, qty_type=F.lit("count"), qty_value=F.lit(1.0), length=F.col("length"), width=F.col("width"), remarks=remark)
    rows = rows.withColumn("block_name", name)
    keys = ["drawing", "block_name", "zone"]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by("category1", "ent_ord").alias("category1"))
    sizes = boq.upper_medians(rows.where("length IS NOT NULL AND width IS NOT NULL"), keys, ["length", "width"])
    detail = counted.join(sizes, keys, "left")
    remark = F.concat(F.lit("aggregated "), F.col("n").cast("string"), F.lit(" inserts"))
    return _bill(detail, drawing=F.col("drawing"), entity_type=F.lit("INSERT"), category=F.lit(ZONE_LAYER), zone=F.col("zone"), category1=F.col("category1"), boq_name=F.col("block_name"), qty_type=F.lit("count"), qty_value=F.col("n").cast("double"), length=F.col("length"), width=F.col("width"), remarks=remark)


def layer_rows(entities: DataFrame, target: str = "ft", combined: bool = False) -> DataFrame:
    """The bill's rows of layers: an open row with the length and a closed one with perimeter, area and the rectangle's sides that they give; or one row with all lengths, and the area as width."""
    top = entities.where("block IS NULL") if "block" in entities.columns else entities
    colours = entity_layer_colours(top).select("drawing", "layer", hex_colour(F.col("colour")).alias("preview"))
    m = entity_layer_metrics(top, target).join(colours, ["drawing", "layer"], "left")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    common = {"drawing": F.col("drawing"), "entity_type": F.lit("LAYER_SUMMARY"), "category": F.col("layer"), "qty_type": F.lit("layer"), "preview": F.col("preview")}
    if combined:
        m = m.withColumn("total", F.expr("length + perimeter")).where("total > 0 OR area > 0")
        return _bill(m, **common, length=positive("total"), width=positive("area"), remarks=F.lit("totals per layer (open+closed length; area from closed)"))
    open_ = _bill(m.where("length > 0"), **common, length=F.col("length"), remarks=F.lit("OPEN length only"))
    m = m.where("perimeter > 0 OR area > 0").withColumn("sides", G.rectangle_sides(F.col("perimeter"), F.col("area")))
    return open_.unionByName(_bill(m, **common, length=F.col("sides.length"), width=F.col("sides.width"), perimeter=positive("perimeter"), area=positive("area"), remarks=F.lit("CLOSED (rectangle): length/width + perimeter & area")))


def report(entities: DataFrame, target: str = "ft", aggregated: bool = True, combined: bool = False, references: bool = False) -> DataFrame:
    """The bill of quantities of each drawing, in its order: rows of inserts, then of layers, as insert_rows() and layer_rows() give them.

    Entities are stored first, so that files are read and parsed once for all steps.
    """
    entities = kept(entities, "entities")
    return insert_rows(entities, target, aggregated, references).unionByName(layer_rows(entities, target, combined)).orderBy("drawing", *boq.boq_order(F.lower("category1")), "remarks")
