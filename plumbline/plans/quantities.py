"""Queries on quantities: bill of quantities, units, lengths, areas, colours, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import strings as S
from ..operators import boq
from ..operators.zones import with_zone
from . import views as V
from .views import r4


def q_boq_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zoned insert rows and layer totals in one report, in report order."""
    placed = with_zone(V.inserts(spark, sf_dir), V.zones(spark, sf_dir))
    rows = boq.aggregate_inserts(placed)
    detail = rows.select(F.lit("INSERT").alias("entity_type"), F.lit("PLANNER").alias("category"), "zone", F.col("block_name").alias("boq_name"), "layer", F.col("qty").cast("double").alias("qty_value"), "length", "width")
    totals = boq.layer_rows(boq.layer_metrics(V.rings(spark, sf_dir)), "split")
    summary = totals.select(F.lit("LAYER").alias("entity_type"), F.col("layer").alias("category"), F.lit("").alias("zone"), F.col("kind").alias("boq_name"), "layer", F.lit(1.0).alias("qty_value"), "length", F.col("area").alias("width"))
    return detail.unionByName(summary).orderBy(*boq.boq_order())


_PLACED = """pl AS (SELECT ent_ord, arg_min(zone, zone_ord) AS zone FROM (
  SELECT ent_ord, zone_ord, zone FROM ins, zedge
  WHERE (by_ > y) <> (ay > y) AND x < (ax - bx) * (y - by_) / (ay - by_ + 1e-12::DOUBLE) + bx
  GROUP BY ent_ord, zone_ord, zone HAVING count(*) % 2 = 1) GROUP BY ent_ord)"""
_METRICS = f"""mt AS (SELECT ring_id, layer, closed, sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))) FILTER (closed OR NOT closing) AS len,
  abs(sum(ax * by_ - bx * ay)) / 2 AS area FROM edge GROUP BY ring_id, layer, closed),
lm AS (SELECT layer, {r4(f"coalesce(sum({r4('len')}) FILTER (NOT closed AND len > 0), 0)")} AS length, {r4(f"coalesce(sum({r4('len')}) FILTER (closed AND len > 0), 0)")} AS perimeter,
  {r4(f"coalesce(sum({r4('area')}) FILTER (closed AND area > 0), 0)")} AS area, count(*) FILTER (NOT closed) AS n_open, count(*) FILTER (closed) AS n_closed FROM mt GROUP BY layer)"""
_SPLIT = "SELECT layer, 'OPEN' AS kind, length, 0.0::DOUBLE AS area FROM lm WHERE n_open > 0 UNION ALL SELECT layer, 'CLOSED', perimeter, area FROM lm WHERE n_closed > 0"
_UPPER = lambda c: f"list_sort(list({c}))[count(*) // 2 + 1]"

_BOQ_DETAIL = f"""WITH {V.INSERTS}, {V.ZONES}, {_PLACED}, {V.VERTS}, {_METRICS}
SELECT 'INSERT' AS entity_type, 'PLANNER' AS category, coalesce(zone, '') AS zone, block_name AS boq_name, arg_min(layer, ent_ord) AS layer, count(*)::DOUBLE AS qty_value, {_UPPER('length')} AS length, {_UPPER('width')} AS width
FROM ins LEFT JOIN pl USING (ent_ord) GROUP BY coalesce(zone, ''), block_name
UNION ALL SELECT 'LAYER', layer, '', kind, layer, 1.0::DOUBLE, length, area FROM ({_SPLIT})"""


def q_boq_true_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.inserts(spark, sf_dir).groupBy("block_name", "layer").agg(F.count(F.lit(1)).alias("qty"), F.median("length").alias("length"), F.median("width").alias("width"))


def q_boq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.inserts(spark, sf_dir).groupBy(F.col("layer").alias("category"), F.col("block_name").alias("name")).agg(F.count(F.lit(1)).alias("qty")).orderBy("category", "name")


def q_boq_unaggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each insert; external references and zone markers are left out."""
    i = V.inserts(spark, sf_dir).where(~F.contains("block_name", F.lit("|")) & (F.upper("layer") != "PLANNER"))
    return i.select("ent_ord", F.lit("INSERT").alias("entity_type"), S.or_misc(F.col("layer")).alias("category"), "block_name", F.lit(1.0).alias("qty_value"), "length", "width")


def q_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and areas under every unit code, in every target unit."""
    codes = spark.createDataFrame([(c,) for c in (0, 1, 2, 4, 5, 6, 99)], "code int")
    sizes = V.inserts(spark, sf_dir).select("length").distinct()
    metres = sizes.crossJoin(F.broadcast(codes)).withColumn("m", F.col("length") * G.unit_scale(F.col("code")))  # seven codes
    return metres.select("code", "length", *(G.rounded(G.to_units(F.col("m"), t)).alias(t) for t in ("m", "mm", "cm", "ft")), G.rounded(G.to_units(F.col("m") * F.col("m"), "ft", 2)).alias("ft2"))


_SCALE = "CASE code WHEN 0 THEN 0.001::DOUBLE WHEN 1 THEN 0.0254 WHEN 2 THEN 0.3048 WHEN 4 THEN 0.001 WHEN 5 THEN 0.01 ELSE 1.0 END"


def q_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rings(spark, sf_dir).select("ring_id", "closed", F.size("verts").cast("long").alias("n"), G.rounded(G.path_length(F.col("verts"), F.col("closed"))).alias("length"))


def q_ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.centroid(F.col("verts"))
    return V.rings(spark, sf_dir).select("ring_id", G.rounded(G.ring_area(F.col("verts"))).alias("area"), (G.signed_area(F.col("verts")) < 0).alias("clockwise"), G.rounded(c["x"]).alias("cx"), G.rounded(c["y"]).alias("cy"))


def q_layer_metrics_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boq.layer_rows(boq.layer_metrics(V.rings(spark, sf_dir)), "split")


def q_layer_metrics_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boq.layer_rows(boq.layer_metrics(V.rings(spark, sf_dir)), "combined")
    return rows.withColumn("length", G.rounded(F.col("length")))


def q_layer_metrics_two_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = boq.layer_metrics(V.rings(spark, sf_dir)).select("layer", G.rounded(F.expr("length + perimeter")).alias("length"), "area")
    return m.unpivot("layer", ["length", "area"], "measure", "value").where("value > 0")


def q_layer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["1-URGENT", "5-LOW"]
    rings = V.rings(spark, sf_dir).where(F.upper("layer").isin(wanted))
    return rings.select("layer", G.path_length(F.col("verts"), F.col("closed")).alias("l")).where("l > 0").groupBy("layer").agg(F.count(F.lit(1)).alias("n"), G.rounded(F.sum(G.rounded(F.col("l")))).alias("length"))


def q_rect_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangle that each closed ring's perimeter and area could be."""
    m = V.rings(spark, sf_dir).where("closed").select("ring_id", G.path_length(F.col("verts"), F.lit(True)).alias("p"), G.ring_area(F.col("verts")).alias("a"))
    return m.select("ring_id", G.rectangle_sides(F.col("p"), F.col("a")).alias("r")).where("r IS NOT NULL").select("ring_id", G.rounded(F.col("r.length")).alias("length"), G.rounded(F.col("r.width")).alias("width"))


def q_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.rings(spark, sf_dir).select("ring_id", G.bounds(F.col("verts")).alias("b"))
    w, h = F.col("b.maxx") - F.col("b.minx"), F.col("b.maxy") - F.col("b.miny")
    return b.select("ring_id", "b.minx", "b.miny", "b.maxx", "b.maxy", G.rounded(F.greatest(w, h)).alias("longer"), G.rounded(F.least(w, h)).alias("shorter"), G.rounded((F.col("b.minx") + F.col("b.maxx")) / 2).alias("cx"), G.rounded((F.col("b.miny") + F.col("b.maxy")) / 2).alias("cy"))


def q_dominant_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By layer, the colour with the largest total length; of equal ones the first seen."""
    best = boq.dominant(V.inserts(spark, sf_dir), "layer", "colour", "length", "ent_ord")
    return best.select("layer", "colour", "weight")


def q_layer_color_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers with a colour from a palette, grey where there is none."""
    palette = spark.createDataFrame([("AF", 255, 0, 0), ("NO", 0, 128, 255), ("RF", 16, 200, 7)], "name string, r int, g int, b int")
    layers = V.inserts(spark, sf_dir).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    joined = layers.join(F.broadcast(palette), F.col("layer") == F.col("name"), "left")  # three rows
    part = lambda c: F.coalesce(F.col(c), F.lit(200))
    return joined.select("layer", "n", S.rgb_hex(part("r"), part("g"), part("b")).alias("preview_hex"))


def q_preview_first_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name's first insert gives its preview; inserts per name carry it along."""
    i = V.inserts(spark, sf_dir)
    first = i.groupBy("block_name").agg(F.min("ent_ord").alias("preview_of"))
    return i.join(first, "block_name", "left").select("ent_ord", "block_name", "preview_of")


def q_seq_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running number for inserts of one name in one drawing, three digits or more."""
    safe = S.safe_runs(F.col("block_name"))
    i = V.inserts(spark, sf_dir).withColumn("safe", safe)
    n = F.row_number().over(Window.partitionBy("drawing", "safe").orderBy("ent_ord"))
    padded = lambda c: F.when(c < 1000, F.lpad(c.cast("string"), 3, "0")).otherwise(c.cast("string"))
    return i.withColumn("n", n).select("ent_ord", F.concat_ws("__", "safe", padded(F.col("n"))).alias("file_stem"))


def q_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of two rows within each drawing's rows, with their sizes."""
    n = F.row_number().over(Window.partitionBy("drawing").orderBy("ent_ord"))
    b = V.inserts(spark, sf_dir).select("drawing", F.floor((n - 1) / 2).alias("batch"), "ent_ord")
    return b.groupBy("drawing", "batch").agg(F.count(F.lit(1)).alias("rows"), F.min("ent_ord").alias("first"))


def q_arc_tessellate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled arcs: radius and angles from orders' lines, points counted and measured."""
    v = V.rings(spark, sf_dir).select("ring_id", F.explode("verts").alias("v"))
    start, end = F.col("v.x") * 7, F.col("v.x") * 7 + F.col("v.y")
    pts = G.arc_points(F.lit(0.0), F.lit(0.0), F.col("v.x"), start, end)
    one = v.select("ring_id", F.size(pts).cast("long").alias("n"), G.rounded(G.arc_length(F.col("v.x"), start, end)).alias("len"))
    return one.groupBy("ring_id").agg(F.sum("n").alias("points"), G.rounded(F.sum("len")).alias("length"))


def q_bulge_tessellate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines with their bulged segments as arcs: points and length along them."""
    pairs = V.rings(spark, sf_dir).select("ring_id", F.explode(G.closed_pairs(F.col("verts"), F.lit(False))).alias("p"))
    pts = G.bulge_points(F.col("p.a"), F.col("p.b"), F.col("p.a.bulge"))
    one = pairs.select("ring_id", pts.alias("pts"))
    chord = F.aggregate(F.zip_with(F.slice("pts", 1, F.size("pts") - 1), F.slice("pts", 2, F.size("pts") - 1), lambda a, b: G.distance(a, b)), F.lit(0.0), lambda t, x: t + x)
    return one.select("ring_id", F.size("pts").cast("long").alias("n"), G.rounded(chord, 3).alias("len")).groupBy("ring_id").agg(F.sum("n").alias("points"), G.rounded(F.sum("len"), 3).alias("length"))


def q_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.densified(F.col("verts"), 7.5)
    d = V.rings(spark, sf_dir).select("ring_id", d.alias("d"))
    total = lambda axis: G.rounded(F.aggregate("d", F.lit(0.0), lambda t, v: t + v[axis]), 3)
    return d.select("ring_id", F.size("d").cast("long").alias("points"), total("x").alias("sum_x"), total("y").alias("sum_y"))


def q_layer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's log: totals by layer, with counters of created and skipped pieces."""
    m = V.rings(spark, sf_dir).select("layer", F.size("verts").alias("n"), G.rounded(G.path_length(F.col("verts"), F.lit(False))).alias("l"))
    return m.groupBy("layer").agg(F.count_if(F.col("n") >= 4).alias("created"), F.count_if(F.col("n") < 4).alias("skipped_short"), G.rounded(F.sum("l")).alias("length"))


QUERIES = [q_boq_detail, q_boq_true_median, q_boq_summary, q_boq_unaggregated, q_units, q_path_length, q_ring_area, q_layer_metrics_split, q_layer_metrics_combined, q_layer_metrics_two_rows, q_layer_filter, q_rect_dims, q_bbox, q_dominant_color, q_layer_color_lookup, q_preview_first_per_name, q_seq_per_name, q_batches, q_arc_tessellate, q_bulge_tessellate, q_densify, q_layer_totals]

_LEN = "sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))"
SQL = {
    "q_boq_detail": _BOQ_DETAIL,
    "q_boq_true_median": f"WITH {V.INSERTS} SELECT block_name, layer, count(*) AS qty, median(length) AS length, median(width) AS width FROM ins GROUP BY block_name, layer",
    "q_boq_summary": f"WITH {V.INSERTS} SELECT layer AS category, block_name AS name, count(*) AS qty FROM ins GROUP BY layer, block_name",
    "q_boq_unaggregated": f"WITH {V.INSERTS} SELECT ent_ord, 'INSERT' AS entity_type, coalesce(nullif(trim(layer), ''), 'misc') AS category, block_name, 1.0::DOUBLE AS qty_value, length, width FROM ins WHERE NOT contains(block_name, '|') AND upper(layer) <> 'PLANNER'",
    "q_units": f"""WITH {V.INSERTS}, u AS (SELECT code, length, length * {_SCALE} AS m FROM (SELECT DISTINCT length FROM ins), (VALUES (0::INTEGER), (1), (2), (4), (5), (6), (99)) AS c(code))
SELECT code, length, {r4('m')} AS m, {r4('m * 1000')} AS mm, {r4('m * 100')} AS cm, {r4('m * (1 / 0.3048::DOUBLE)')} AS ft, {r4('m * m * pow(1 / 0.3048::DOUBLE, 2)')} AS ft2 FROM u""",
    "q_path_length": f"WITH {V.VERTS} SELECT ring_id, closed, n, {r4(_LEN + ' FILTER (closed OR NOT closing)')} AS length FROM edge GROUP BY ring_id, closed, n",
    "q_ring_area": f"WITH {V.VERTS} SELECT ring_id, {r4('abs(sum(ax * by_ - bx * ay)) / 2')} AS area, sum(ax * by_ - bx * ay) < 0 AS clockwise, {r4('sum(ax) / any_value(n)')} AS cx, {r4('sum(ay) / any_value(n)')} AS cy FROM edge GROUP BY ring_id",
    "q_layer_metrics_split": f"WITH {V.VERTS}, {_METRICS} {_SPLIT}",
    "q_layer_metrics_combined": f"WITH {V.VERTS}, {_METRICS} SELECT layer, 'COMBINED' AS kind, {r4('length + perimeter')} AS length, area FROM lm",
    "q_layer_metrics_two_rows": f"WITH {V.VERTS}, {_METRICS} SELECT * FROM (SELECT layer, 'length' AS measure, {r4('length + perimeter')} AS value FROM lm UNION ALL SELECT layer, 'area', area FROM lm) WHERE value > 0",
    "q_layer_filter": f"WITH {V.VERTS}, {_METRICS} SELECT layer, count(*) AS n, {r4('sum(' + r4('len') + ')')} AS length FROM mt WHERE upper(layer) IN ('1-URGENT', '5-LOW') AND len > 0 GROUP BY layer",
    "q_rect_dims": f"""WITH {V.VERTS}, {_METRICS}, s AS (SELECT ring_id, len / 2 AS half, area, (len / 2) * (len / 2) - 4 * area AS d FROM mt WHERE closed AND len > 0 AND area > 0),
t AS (SELECT ring_id, (half + sqrt(greatest(d, 0))) / 2 AS a, (half - sqrt(greatest(d, 0))) / 2 AS b FROM s WHERE d >= -1e-9)
SELECT ring_id, {r4('a')} AS length, {r4('b')} AS width FROM t WHERE b > 0""",
    "q_bbox": f"""WITH {V.VERTS}, b AS (SELECT ring_id, min(ax) AS minx, min(ay) AS miny, max(ax) AS maxx, max(ay) AS maxy FROM edge GROUP BY ring_id)
SELECT *, {r4('greatest(maxx - minx, maxy - miny)')} AS longer, {r4('least(maxx - minx, maxy - miny)')} AS shorter, {r4('(minx + maxx) / 2')} AS cx, {r4('(miny + maxy) / 2')} AS cy FROM b""",
    "q_dominant_color": f"""WITH {V.INSERTS}, w AS (SELECT layer, colour, sum(CASE WHEN length > 0 THEN length ELSE 1 END) AS weight, min(ent_ord) AS first FROM ins GROUP BY layer, colour)
SELECT layer, colour, weight FROM w QUALIFY row_number() OVER (PARTITION BY layer ORDER BY weight DESC, first) = 1""",
    "q_layer_color_lookup": f"""WITH {V.INSERTS} SELECT layer, count(*) AS n, CASE layer WHEN 'AF' THEN '#FF0000' WHEN 'NO' THEN '#0080FF' WHEN 'RF' THEN '#10C807' ELSE '#C8C8C8' END AS preview_hex FROM ins GROUP BY layer""",
    "q_preview_first_per_name": f"WITH {V.INSERTS} SELECT ent_ord, block_name, min(ent_ord) OVER (PARTITION BY block_name) AS preview_of FROM ins",
    "q_seq_per_name": f"""WITH {V.INSERTS}, s AS (SELECT ent_ord, drawing, regexp_replace(block_name, '[<>:"/\\\\|?*]+', '_', 'g') AS safe FROM ins), n AS (SELECT *, row_number() OVER (PARTITION BY drawing, safe ORDER BY ent_ord) AS k FROM s)
SELECT ent_ord, safe || '__' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS file_stem FROM n""",
    "q_batches": f"""WITH {V.INSERTS}, b AS (SELECT drawing, (row_number() OVER (PARTITION BY drawing ORDER BY ent_ord) - 1) // 2 AS batch, ent_ord FROM ins)
SELECT drawing, batch, count(*) AS rows, min(ent_ord) AS first FROM b GROUP BY drawing, batch""",
    "q_arc_tessellate": f"""WITH {V.VERTS}, a AS (SELECT ring_id, ax AS r, ay - floor(ay / 360) * 360 AS s0, ay FROM edge),
s AS (SELECT ring_id, r, CASE WHEN s0 = 0 AND ay <> 0 THEN 360 ELSE s0 END AS sweep FROM a)
SELECT ring_id, sum(greatest(16, floor(sweep / 6)::INTEGER) + 1)::BIGINT AS points, {r4('sum(' + r4('2 * pi() * r * sweep / 360') + ')')} AS length FROM s GROUP BY ring_id""",
    "q_bulge_tessellate": f"""WITH {V.VERTS}, s AS (SELECT ring_id, bulge, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS c, 4 * atan(bulge) AS angle FROM edge WHERE NOT closing),
t AS (SELECT ring_id, CASE WHEN abs(bulge) < 1e-12 OR c < 1e-12 THEN 1 ELSE greatest(8, floor(abs(angle) / (6 * pi() / 180) + 1e-9)::INTEGER) END AS k, bulge, c, angle FROM s),
u AS (SELECT ring_id, k + 1 AS n, CASE WHEN abs(bulge) < 1e-12 OR c < 1e-12 THEN c ELSE k * 2 * (c * (1 + bulge * bulge) / (4 * bulge)) * sin(angle / k / 2) END AS len FROM t)
SELECT ring_id, sum(n)::BIGINT AS points, floor(sum(floor(len * 1000 + 0.50001) / 1000.0::DOUBLE) * 1000 + 0.50001) / 1000.0::DOUBLE AS length FROM u GROUP BY ring_id""",
    "q_densify": f"""WITH {V.VERTS}, s AS (SELECT ring_id, ax, ay, bx, by_, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS d, i, n FROM edge WHERE NOT closing),
p AS (SELECT *, CASE WHEN d > 7.5 THEN floor(d / 7.5)::INTEGER + 1 ELSE 1 END AS k FROM s),
q AS (SELECT ring_id, ax + (bx - ax) * j / k AS x, ay + (by_ - ay) * j / k AS y FROM (SELECT *, unnest(range(k)) AS j FROM p)
  UNION ALL SELECT ring_id, bx, by_ FROM p WHERE i = n - 2)
SELECT ring_id, count(*) AS points, floor(sum(x) * 1000 + 0.50001) / 1000.0::DOUBLE AS sum_x, floor(sum(y) * 1000 + 0.50001) / 1000.0::DOUBLE AS sum_y FROM q GROUP BY ring_id""",
    "q_layer_totals": f"""WITH {V.VERTS}, m AS (SELECT ring_id, layer, n, {r4(_LEN + ' FILTER (NOT closing)')} AS l FROM edge GROUP BY ring_id, layer, n)
SELECT layer, count(*) FILTER (n >= 4) AS created, count(*) FILTER (n < 4) AS skipped_short, {r4('sum(l)')} AS length FROM m GROUP BY layer""",
}
