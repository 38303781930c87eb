"""Names for zones from labels: inside first, else the nearest, each label used once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def label_candidates(labels: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone_ord, zone, label_ord, text, within, square): every zone of a drawing with its labels.

    A drawing's zones are few; they are the small side of the pairing. square is the
    squared distance of the label from the mean of the zone's vertices.
    """
    c = G.centroid(F.col("poly"))
    z = zones.select("zone_ord", "zone", "poly", c.alias("c"))
    pairs = labels.crossJoin(z)
    dx, dy = F.col("x") - F.col("c.x"), F.col("y") - F.col("c.y")
    return pairs.select("zone_ord", "zone", "label_ord", "text", G.inside(F.col("x"), F.col("y"), F.col("poly")).alias("within"), (dx * dx + dy * dy).alias("square"))


def first_candidates(candidates: DataFrame, drawing: str, zones: int) -> DataFrame:
    """All candidates that name_zones can choose, where a drawing has at most so many zones.

    The zones before one use up fewer labels than there are zones, so a zone's label is
    among its first ones inside or, where fewer are inside, those or its nearest.
    """
    rank = lambda *by: F.row_number().over(Window.partitionBy(drawing, "zone_ord").orderBy(*by))
    columns = candidates.columns
    inside = candidates.where("within").withColumn("_rank", rank("label_ord")).where(F.col("_rank") <= zones)
    nearest = candidates.withColumn("_rank", rank("square", "label_ord")).where(F.col("_rank") <= zones)
    return inside.select(*columns).unionByName(nearest.select(*columns)).dropDuplicates([drawing, "zone_ord", "label_ord"])


def name_zones(candidates: DataFrame, drawing: str) -> DataFrame:
    """(drawing, zone_ord, text): in zone order, the first unused label inside, else the nearest unused one.

    Depends on the order, so a drawing's candidates are worked on together.
    """

    def name(part: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        rows = []
        for order, own in part.groupby("zone_ord", sort=True):
            free = own[~own["label_ord"].isin(used)]
            inside = free[free["within"]].sort_values("label_ord")
            best = inside if len(inside) else free.sort_values(["square", "label_ord"])
            if len(best):
                used.add(int(best["label_ord"].iloc[0]))
                rows.append((part[drawing].iloc[0], int(order), best["text"].iloc[0]))
        return pd.DataFrame(rows, columns=["drawing", "zone_ord", "text"])

    kind = candidates.schema[drawing].dataType.simpleString()
    return candidates.groupBy(drawing).applyInPandas(name, f"drawing {kind}, zone_ord long, text string")
