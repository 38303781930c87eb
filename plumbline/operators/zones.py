"""Points in zones, by a grid of cells instead of a comparison of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def cells_of(zones: DataFrame, cell: float, poly: str = "poly") -> DataFrame:
    """zones with a row for each grid cell (cx, cy) that their bounding boxes touch."""
    box = zones.withColumn("_b", G.bounds(F.col(poly)))
    span = lambda lo, hi: F.sequence(F.floor(F.col(f"_b.{lo}") / cell), F.floor(F.col(f"_b.{hi}") / cell))
    return box.withColumn("cell_x", F.explode(span("minx", "maxx"))).withColumn("cell_y", F.explode(span("miny", "maxy"))).drop("_b")


def zone_pairs(points: DataFrame, zones: DataFrame, cell: float = 4.0) -> DataFrame:
    """(point columns, zone_ord, zone) for each zone that holds a point: an equi-join on the cell, then the exact test."""
    keyed = points.withColumn("cell_x", F.floor(F.col("x") / cell)).withColumn("cell_y", F.floor(F.col("y") / cell))
    joined = keyed.join(cells_of(zones, cell), ["cell_x", "cell_y"])
    return joined.where(G.inside(F.col("x"), F.col("y"), F.col("poly"))).select(*points.columns, "zone_ord", "zone")


def leveled_pairs(points: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """(point columns, zone_ord, zone) for each zone of equal keys that holds a point, whatever the zones' sizes.

    A zone lies in squares whose side is the power of two from its larger extent on: in
    four at most. A point asks for the one square that holds it, for each size that
    zones of its keys have; there are as many sizes as binary orders of magnitude, and
    not as many as zones. Points without a place have no zone.
    """
    box = zones.withColumn("_b", G.bounds(F.col("poly")))
    extent = F.greatest(F.col("_b.maxx") - F.col("_b.minx"), F.col("_b.maxy") - F.col("_b.miny"))
    sized = box.withColumn("_level", F.when(extent > 0, F.ceil(F.log2(extent))).otherwise(F.lit(-40)).cast("int"))
    side = F.pow(F.lit(2.0), F.col("_level"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(f"_b.{lo}") / side), F.floor(F.col(f"_b.{hi}") / side))
    cells = sized.withColumn("_cx", F.explode(span("minx", "maxx"))).withColumn("_cy", F.explode(span("miny", "maxy"))).select(*keys, "_level", "_cx", "_cy", "zone_ord", "zone", "poly")
    levels = sized.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    asked = points.where("x IS NOT NULL AND y IS NOT NULL").join(levels, keys).withColumn("_level", F.explode("_levels"))
    asked = asked.withColumn("_cx", F.floor(F.col("x") / side)).withColumn("_cy", F.floor(F.col("y") / side)).drop("_levels")
    joined = asked.join(cells, [*keys, "_level", "_cx", "_cy"])
    return joined.where(G.inside(F.col("x"), F.col("y"), F.col("poly"))).select(*points.columns, "zone_ord", "zone")


def with_zone(points: DataFrame, zones: DataFrame, cell: float = 4.0) -> DataFrame:
    """points with a zone column: of the zones that hold a point the first in zone order, null where none does.

    A grid cell's zones are one row, so a point meets them by one equi-join on its cell
    and keeps its own row; the first zone that passes the exact test is picked there.
    """
    entry = F.struct("zone_ord", "zone", "edges")
    table = cells_of(zones.withColumn("edges", G.closed_pairs(F.col("poly"), F.lit(True))), cell).groupBy("cell_x", "cell_y").agg(F.array_sort(F.collect_list(entry)).alias("_near"))
    keyed = points.withColumn("cell_x", F.floor(F.col("x") / cell)).withColumn("cell_y", F.floor(F.col("y") / cell))
    held = keyed.join(table, ["cell_x", "cell_y"], "left")
    first = F.filter("_near", lambda z: G.inside_edges(F.col("x"), F.col("y"), z["edges"]))
    return held.select(*(F.col(c) for c in points.columns), F.try_element_at(first, F.lit(1))["zone"].alias("zone"))
