"""Queries on the entities of drawings: layer metrics over six types, colours, indices by handle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import drawing as D
from ..session import table
from . import views as V
from .shaping import SQL as SHAPES
from .shaping import q_name_match_tiered
from .views import r4

_TYPES = ("LINE", "LWPOLYLINE", "POLYLINE", "ARC", "CIRCLE", "HATCH")
_UNITS = (0, 1, 2, 4, 5, 6)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity for each order line, of six types, in the units of its drawing; layer AF has a colour of its own."""
    line = table(spark, sf_dir, "lineitem")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    kind = pick(_TYPES, F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber"))
    w, h = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corner = lambda x, y, b: F.struct(x.alias("x"), y.alias("y"), b.alias("bulge"))
    zero = F.lit(0.0)
    rows = line.select(
        (F.col("l_orderkey") % 100).cast("string").alias("drawing"), pick(_UNITS, F.col("l_orderkey") % 100).alias("insunits"), V.line_order().alias("ent_ord"), kind.alias("etype"), F.concat("l_returnflag", "l_linestatus").alias("layer"),
        (F.col("l_linenumber") % 2 == 0).alias("closed"), point(zero, zero).alias("p0"), point(w, h).alias("p1"), w.alias("radius"), (F.col("l_partkey") % 360).cast("double").alias("a0"), (F.col("l_suppkey") % 360).cast("double").alias("a1"),
        F.array(corner(zero, zero, F.col("l_discount")), corner(w, zero, zero), corner(w, h, zero), corner(zero, h, zero)).alias("verts"), F.when(F.col("l_partkey") % 3 != 0, w * h / 2).alias("filled_area"),
        F.when(F.col("l_partkey") % 7 == 0, (F.col("l_partkey") * 7919 % 16777216).cast("int")).alias("true_color"), F.when(F.col("l_partkey") % 7 < 4, (F.col("l_partkey") % 9 + 1).cast("int")).alias("aci"), F.lit(None).cast("string").alias("name"),
    )
    layer = rows.select("drawing", "insunits").distinct()
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("drawing", "insunits", "etype", "true_color", "name")]
    return rows.unionByName(layer.select("drawing", "insunits", F.lit("LAYER").alias("etype"), F.lit(0x10C807).alias("true_color"), F.lit("AF").alias("name"), *blank))


def q_entity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open length, perimeter and area by drawing and layer over six types, in feet."""
    return D.entity_layer_metrics(entities(spark, sf_dir))


def q_entity_metrics_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two measures: all lengths, and areas with hatches' boundaries where they have no area of their own."""
    m = D.entity_layer_metrics(entities(spark, sf_dir), rings=True)
    return m.select("drawing", "layer", G.rounded(F.expr("length + perimeter")).alias("length"), "area")


def q_entity_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By drawing and layer, the colour of the largest weight."""
    c = D.entity_layer_colours(entities(spark, sf_dir))
    return c.select("drawing", "layer", D.hex_colour(F.col("colour")).alias("preview_hex"), G.rounded(F.col("weight"), 2).alias("weight"))


def q_index_by_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insert's place among those of its block in its drawing, by the handle's number."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", V.line_order().alias("ent_ord"), F.lower("l_returnflag").alias("block"), F.hex(F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("handle"))
    by = Window.partitionBy("l_orderkey", "block").orderBy(F.conv("handle", 16, 10).cast("long"), "ent_ord")
    return line.select("ent_ord", "block", "handle", F.row_number().over(by).alias("n"))


def q_selected_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected inserts (by a list of types and ids) gathered by block name: how many, the first and the last."""
    chosen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("drawing"))
    i = V.inserts(spark, sf_dir).join(chosen, "drawing", "left_semi")
    return i.groupBy("block_name").agg(F.count(F.lit(1)).alias("n"), F.min("ent_ord").alias("first"), F.max("ent_ord").alias("last"))


def q_match_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run: items that matched a row, and (item, row) writes, by tier."""
    m = q_name_match_tiered(spark, sf_dir)
    return m.groupBy("tier").agg(F.countDistinct("item").alias("matched"), F.count(F.lit(1)).alias("wrote"))


def q_sheet_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a sheet by category, equal ones in their first order: each row's new place in its source's sheet."""
    s = table(spark, sf_dir, "documents").select("doc_id", "source", F.upper("lang").alias("category"))
    by = Window.partitionBy("source").orderBy("category", "doc_id")
    return s.select("doc_id", "source", "category", F.row_number().over(by).alias("place"))


#: Blocks of each drawing: rectangles from (0, 0), with a base point; one is dynamic, one an external reference.
_BLOCKS = ("CHAIR", "DESK", "*U12", "LAMP", "A|REF", "SOFA")


def drawing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole drawings: entities(), blocks, an insert for each order, and zones.

    Two drawings of three have inserts on the zone layer (of lines that give a box,
    some with a name); the others outlines, with one label or two.
    """
    flat = entities(spark, sf_dir)
    each = flat.select("drawing", "insunits").distinct()
    point, corner = "struct<x:double,y:double>", "array<struct<x:double,y:double,bulge:double>>"
    kinds = {f.name: f.dataType.simpleString() for f in flat.schema} | {"block": "string", "handle": "string", "text": "string", "rotation": "double", "sx": "double", "sy": "double", "attribs": "map<string,string>", "base": point, "n_cols": "int", "n_rows": "int", "col_gap": "double", "row_gap": "double"}

    def rows(df: DataFrame, **columns) -> DataFrame:
        return df.select(*((columns[c] if c in columns else F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()))

    at = lambda x, y: F.struct(F.lit(0.0 + x).alias("x") if isinstance(x, (int, float)) else x.cast("double").alias("x"), F.lit(0.0 + y).alias("y") if isinstance(y, (int, float)) else y.cast("double").alias("y"))
    ring = lambda x, y, w, h: F.array(*(F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"), F.lit(0.0).alias("bulge")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))))
    zero, text = F.lit(0.0), lambda x: F.lit(x)
    blocks = each.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(_BLOCKS) - 1))))
    blocks = rows(blocks, block=F.element_at(F.array(*map(F.lit, _BLOCKS)), F.col("k") + 1), ent_ord=F.concat(F.lit("b"), F.col("k")), etype=text("LWPOLYLINE"), layer=text("0"), closed=F.lit(True), verts=ring(zero, zero, 3 + F.col("k"), 2 + F.col("k") / 2), base=at(F.col("k") % 2, 0))
    sides = rows(each.withColumn("y", F.explode(F.array(zero, F.lit(30.0)))), block=text("ZONE"), ent_ord=text("z"), etype=text("LINE"), layer=text("0"), closed=F.lit(False), p0=at(0, F.col("y")), p1=at(30, F.col("y")))
    zoned = each.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(F.col("drawing").cast("int") % 3 == 0, 1).otherwise(3))))
    there, order = at(F.col("j") * 25, 0), F.concat(F.lit("zone"), F.col("j"))
    room = F.when(F.col("j") % 2 == 0, F.create_map(F.lit("OTHER"), F.lit("x"), F.lit("LABEL"), F.lit(" "), F.lit("ROOM"), F.concat(F.lit("Room "), F.col("j"))))
    boxes = rows(zoned.where("drawing % 3 <> 0"), ent_ord=order, handle=order, etype=text("INSERT"), layer=text(D.ZONE_LAYER), closed=F.lit(False), name=text("ZONE"), p0=there, rotation=zero, sx=F.lit(1.0), sy=F.lit(1.0), attribs=room)
    outlines = rows(zoned.where("drawing % 3 = 0"), ent_ord=order, etype=text("LWPOLYLINE"), layer=text(D.ZONE_LAYER), closed=F.lit(True), verts=ring(F.col("j") * 25, zero, F.lit(30.0), F.lit(30.0)))
    labels = rows(each.where("drawing % 3 = 0"), ent_ord=text("label1"), etype=text("TEXT"), layer=text("NOTES"), text=text(" Hall "), p0=at(40, 10))
    more = rows(each.where("drawing % 6 = 0"), ent_ord=text("label0"), etype=text("MTEXT"), layer=text("NOTES"), text=text("Yard\nof stone"), p0=at(12, 12))
    o = table(spark, sf_dir, "orders").withColumn("drawing", (F.col("o_orderkey") % 100).cast("string")).join(each, "drawing")
    name = F.element_at(F.array(*map(F.lit, _BLOCKS)), (F.col("o_custkey") % len(_BLOCKS) + 1).cast("int"))
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    inserts = rows(
        o, ent_ord=key, handle=F.hex("o_orderkey"), etype=text("INSERT"), layer=F.concat("o_orderpriority", F.lit(" ")), closed=F.lit(False), name=name, p0=at(F.col("o_orderkey") * 7 % 110 + 0.3, F.col("o_custkey") * 3 % 34 + 0.3),
        rotation=zero, sx=(1 + F.col("o_orderkey") % 2), sy=F.lit(1.0), n_cols=F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1), n_rows=F.lit(1), col_gap=F.lit(4.0), row_gap=zero,
    )
    out = rows(flat)
    for part in (blocks, sides, boxes, outlines, labels, more, inserts):
        out = out.unionByName(part)
    return out


def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bill of quantities of each drawing, from its entities: inserts by block and zone, then open and closed rows of layers."""
    bill = D.report(drawing_rows(spark, sf_dir))
    return bill.select(*(G.rounded(F.col(c), 2).alias(c) if c in ("length", "width", "perimeter", "area") else F.col(c) for c in D.BILL))


def q_report_by_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a row for each insert, external references too, and one row for each layer."""
    bill = D.report(drawing_rows(spark, sf_dir), target="m", aggregated=False, combined=True, references=True)
    return bill.select(*(G.rounded(F.col(c), 2).alias(c) if c in ("length", "width", "perimeter", "area") else F.col(c) for c in D.BILL))


QUERIES = [q_report, q_report_by_insert, q_entity_metrics, q_entity_metrics_two, q_entity_colours, q_index_by_handle, q_selected_by_block, q_match_counters, q_sheet_sort]

_NAMES = "[" + ", ".join(f"'{t}'" for t in _TYPES) + "]"
_SCALES = "[0.001::DOUBLE, 0.0254, 0.3048, 0.001, 0.01, 1.0]"
_FEET = "(1 / 0.3048::DOUBLE)"
# an arc in k pieces: its length, and the area between it and its chord
_ENT = f"""e0 AS (SELECT (l_orderkey % 100)::VARCHAR AS drawing, {_SCALES}[(l_orderkey % 100 % 6 + 1)::INTEGER] AS scale, {V.ORDER} AS ent_ord, {_NAMES}[((l_partkey + l_suppkey + l_linenumber) % 6 + 1)::INTEGER] AS etype,
  l_returnflag || l_linestatus AS layer, l_linenumber % 2 = 0 AS closed, l_quantity AS w, l_extendedprice / 1000 AS h, l_discount AS b, 4 * atan(l_discount) AS ang, (l_suppkey % 360 - l_partkey % 360 + 360) % 360 AS turn, l_partkey AS pk FROM lineitem),
e1 AS (SELECT *, greatest(8, floor(ang / (6 * pi() / 180) + 1e-9)) AS k, CASE WHEN b > 0 THEN w * (1 + b * b) / (4 * b) END AS r FROM e0),
e2 AS (SELECT *, CASE WHEN b > 0 THEN k * 2 * r * sin(ang / k / 2) ELSE w END AS bottom, CASE WHEN b > 0 THEN r * r / 2 * (k * sin(ang / k) - sin(ang)) ELSE 0 END AS lens FROM e1),
ent AS (SELECT *, CASE WHEN etype = 'LINE' THEN sqrt(w * w + h * h) WHEN etype = 'ARC' THEN 2 * pi() * w * turn / 360 WHEN etype IN ('LWPOLYLINE', 'POLYLINE') AND NOT closed THEN bottom + h + w END AS open_len,
  CASE WHEN etype = 'CIRCLE' THEN 2 * pi() * w WHEN etype IN ('LWPOLYLINE', 'POLYLINE') AND closed THEN bottom + h + w + h END AS perimeter,
  CASE WHEN etype = 'CIRCLE' THEN pi() * w * w WHEN etype IN ('LWPOLYLINE', 'POLYLINE') AND closed THEN w * h + lens WHEN etype = 'HATCH' AND pk % 3 <> 0 THEN w * h / 2 END AS area,
  CASE WHEN etype = 'HATCH' AND pk % 3 = 0 THEN w * h END AS ring FROM e2)"""
_SUM = lambda c, power: r4(f"coalesce(sum(({c} * pow(scale * {_FEET}, {power}))::DECIMAL(38, 9)) FILTER ({c} > 0)::DOUBLE, 0)")
_ACI = "[" + ", ".join(str(r << 16 | g << 8 | b) for r, g, b in D.FIRST) + "]"
_NULLS = "NULL::DOUBLE"
_R2 = lambda c: f"floor(({c}) * 100 + 0.50001) / 100.0::DOUBLE"


def _report_sql(target: str, aggregated: bool) -> str:
    """Inserts by their boxes, then layers, as the bill has them."""
    unit = {"ft": _FEET, "m": "1.0::DOUBLE"}[target]
    names = "[" + ", ".join(f"'{b}'" for b in _BLOCKS) + "]"
    total = lambda c, power: r4(f"coalesce(sum(({c} * pow(scale * {unit}, {power}))::DECIMAL(38, 9)) FILTER ({c} > 0)::DOUBLE, 0)")
    inserts = f"""ins AS (SELECT (o_orderkey % 100)::VARCHAR AS drawing, {_SCALES}[(o_orderkey % 100 % 6 + 1)::INTEGER] AS scale, o_orderkey, {names}[(o_custkey % 6 + 1)::INTEGER] AS name, o_orderpriority AS layer, o_custkey % 6 AS k, 1 + o_orderkey % 2 AS sx,
  o_orderkey * 7 % 110 + 0.3::DOUBLE AS x, o_custkey * 3 % 34 + 0.3::DOUBLE AS y, CASE WHEN o_orderkey % 5 = 0 THEN 4 ELSE 0 END AS more FROM orders WHERE o_orderkey % 100 IN (SELECT l_orderkey % 100 FROM lineitem)),
bx AS (SELECT *, x - sx * (k % 2) AS minx, x + sx * (3 + k - k % 2) + more AS maxx, y AS miny, y + 2 + k / 2.0::DOUBLE AS maxy FROM ins {'' if not aggregated else "WHERE name NOT LIKE '%|%'"}),
sz AS (SELECT *, {_R2(f'greatest(maxx - minx, maxy - miny) * scale * {unit}')} AS length, {_R2(f'least(maxx - minx, maxy - miny) * scale * {unit}')} AS width, (minx + maxx) * 0.5 AS mx, (miny + maxy) * 0.5 AS my FROM bx),
zn AS (SELECT d.drawing, j, CASE WHEN d.drawing::INTEGER % 3 <> 0 THEN CASE WHEN j % 2 = 0 THEN 'Room ' || j ELSE 'ZONE' END WHEN d.drawing::INTEGER % 6 = 0 THEN ['Yard', 'Hall'][(j + 1)::INTEGER] ELSE ['Hall', 'Zone 02'][(j + 1)::INTEGER] END AS zone
  FROM (SELECT DISTINCT (l_orderkey % 100)::VARCHAR AS drawing FROM lineitem) d, range(4) t(j) WHERE d.drawing::INTEGER % 3 <> 0 OR j < 2),
zo AS (SELECT sz.*, coalesce(f.zone, '') AS zone FROM sz LEFT JOIN (SELECT o_orderkey, arg_min(zn.zone, j) AS zone FROM sz JOIN zn ON sz.drawing = zn.drawing AND mx > 25 * j AND mx < 25 * j + 30 AND my > 0 AND my < 30 GROUP BY o_orderkey) f ON f.o_orderkey = sz.o_orderkey)"""
    mid = lambda c: f"list_sort(list({c}))[(count(*) // 2 + 1)::INTEGER]"
    detail = (
        f"SELECT drawing, 'INSERT' AS entity_type, 'PLANNER' AS category, zone, lower(arg_min(layer, o_orderkey)) AS category1, name AS boq_name, 'count' AS qty_type, count(*)::DOUBLE AS qty_value, {mid('length')} AS length, {mid('width')} AS width, {_NULLS} AS perimeter, {_NULLS} AS area, NULL::VARCHAR AS preview, 'aggregated ' || count(*) || ' inserts' AS remarks FROM zo GROUP BY drawing, name, zone"
        if aggregated
        else f"SELECT drawing, 'INSERT' AS entity_type, CASE WHEN zone <> '' THEN 'PLANNER' ELSE layer END AS category, zone, lower(layer) AS category1, name AS boq_name, 'count' AS qty_type, 1.0::DOUBLE AS qty_value, length, width, {_NULLS} AS perimeter, {_NULLS} AS area, NULL::VARCHAR AS preview, 'dwg_layer=' || layer || ' ; aggregated 1 inserts' AS remarks FROM zo"
    )
    layers = f"""c0 AS (SELECT drawing, layer, ent_ord, CASE WHEN pk % 7 = 0 AND pk * 7919 % 16777216 <> 0 THEN pk * 7919 % 16777216 WHEN pk % 7 < 4 THEN {_ACI}[(pk % 9 + 1)::INTEGER] WHEN layer = 'AF' THEN 1099783 ELSE 13158600 END AS colour,
  CASE WHEN etype = 'HATCH' THEN area * scale * scale ELSE coalesce(open_len, perimeter) * scale END AS wt FROM ent),
c1 AS (SELECT drawing, layer, colour, sum(CASE WHEN wt > 0 THEN wt ELSE 1 END) AS weight, min(ent_ord) AS first FROM c0 GROUP BY drawing, layer, colour),
c2 AS (SELECT drawing, layer, '#' || upper(printf('%06x', colour::BIGINT)) AS preview FROM c1 QUALIFY row_number() OVER (PARTITION BY drawing, layer ORDER BY weight DESC, first) = 1 UNION ALL SELECT DISTINCT drawing, 'PLANNER', '#C8C8C8' FROM ent WHERE drawing::INTEGER % 3 = 0),
e3 AS (SELECT drawing, layer, scale, open_len, perimeter, area FROM ent UNION ALL SELECT DISTINCT drawing, 'PLANNER', scale, NULL, 120.0, 900.0 FROM ent WHERE drawing::INTEGER % 3 = 0 UNION ALL SELECT DISTINCT drawing, 'PLANNER', scale, NULL, 120.0, 900.0 FROM ent WHERE drawing::INTEGER % 3 = 0),
lm AS (SELECT e3.drawing, e3.layer, {total('open_len', 1)} AS len, {total('perimeter', 1)} AS per, {total('area', 2)} AS ar FROM e3 GROUP BY e3.drawing, e3.layer),
lc AS (SELECT lm.*, preview, per / 2 * per / 2 - 4 * ar AS d FROM lm LEFT JOIN c2 ON lm.drawing = c2.drawing AND lm.layer = c2.layer)"""
    head = "drawing, 'LAYER_SUMMARY', layer, '', '', '', 'layer', NULL"
    rect = lambda sign: f"CASE WHEN per > 0 AND ar > 0 AND d >= -1e-9 AND per / 2 - sqrt(greatest(d, 0)) > 0 THEN {_R2(f'(per / 2 {sign} sqrt(greatest(d, 0))) / 2')} END"
    positive = lambda c: f"CASE WHEN {c} > 0 THEN {_R2(c)} END"
    rows = (
        f"SELECT {head}, {_R2('len')}, NULL, NULL, NULL, preview, 'OPEN length only' FROM lc WHERE len > 0 UNION ALL SELECT {head}, {rect('+')}, {rect('-')}, {positive('per')}, {positive('ar')}, preview, 'CLOSED (rectangle): length/width + perimeter & area' FROM lc WHERE per > 0 OR ar > 0"
        if aggregated
        else f"SELECT {head}, {positive('(len + per)')}, {positive('ar')}, NULL, NULL, preview, 'totals per layer (open+closed length; area from closed)' FROM lc WHERE len + per > 0 OR ar > 0"
    )
    return f"WITH {_ENT}, {inserts}, {layers} {detail} UNION ALL {rows}"


SQL = {
    "q_report": _report_sql("ft", True),
    "q_report_by_insert": _report_sql("m", False),
    "q_entity_metrics": f"WITH {_ENT} SELECT drawing, layer, {_SUM('open_len', 1)} AS length, {_SUM('perimeter', 1)} AS perimeter, {_SUM('area', 2)} AS area FROM ent GROUP BY drawing, layer",
    "q_entity_metrics_two": f"WITH {_ENT}, m AS (SELECT *, coalesce(area, ring) AS both_ FROM ent) SELECT drawing, layer, {r4(_SUM('open_len', 1) + ' + ' + _SUM('perimeter', 1))} AS length, {_SUM('both_', 2)} AS area FROM m GROUP BY drawing, layer",
    "q_entity_colours": f"""WITH {_ENT}, c AS (SELECT drawing, layer, ent_ord, CASE WHEN pk % 7 = 0 AND pk * 7919 % 16777216 <> 0 THEN pk * 7919 % 16777216 WHEN pk % 7 < 4 THEN {_ACI}[(pk % 9 + 1)::INTEGER] WHEN layer = 'AF' THEN 1099783 ELSE 13158600 END AS colour,
  CASE WHEN etype = 'HATCH' THEN area * scale * scale ELSE coalesce(open_len, perimeter) * scale END AS wt FROM ent),
t AS (SELECT drawing, layer, colour, sum(CASE WHEN wt > 0 THEN wt ELSE 1 END) AS weight, min(ent_ord) AS first FROM c GROUP BY drawing, layer, colour)
SELECT drawing, layer, '#' || upper(printf('%06x', colour::BIGINT)) AS preview_hex, floor(weight * 100 + 0.50001) / 100.0::DOUBLE AS weight FROM t QUALIFY row_number() OVER (PARTITION BY drawing, layer ORDER BY weight DESC, first) = 1""",
    "q_match_counters": f"SELECT tier, count(DISTINCT item) AS matched, count(*) AS wrote FROM ({SHAPES['q_name_match_tiered']}) GROUP BY tier",
    "q_index_by_handle": f"SELECT {V.ORDER} AS ent_ord, lower(l_returnflag) AS block, to_hex(l_partkey * 1000 + l_suppkey) AS handle, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_partkey * 1000 + l_suppkey, {V.ORDER})::INTEGER AS n FROM lineitem",
    "q_selected_by_block": f"WITH {V.INSERTS} SELECT block_name, count(*) AS n, min(ent_ord) AS first, max(ent_ord) AS last FROM ins WHERE drawing IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY block_name",
    "q_sheet_sort": "SELECT doc_id, source, upper(lang) AS category, row_number() OVER (PARTITION BY source ORDER BY upper(lang), doc_id)::INTEGER AS place FROM documents",
}
