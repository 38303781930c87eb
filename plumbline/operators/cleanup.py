"""Polyline validation, duplicate paths, near twins, and chains of pieces."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import paths as P

_ISSUES = "array<struct<kind:string,x:double,y:double>>"


def ring_issues(rings: DataFrame, near: float = 1e-4, bend: float = 0.5) -> DataFrame:
    """(ring_id, kind, x, y): what is wrong with each ring.

    Rings below three vertices and open ones have that one issue. Others: vertices
    that nearly coincide with the next, vertices where the direction changes by less
    than `bend` degrees, crossings of edges that aren't neighbours, and clockwise
    order. The same issue at the same place (to four decimals) counts once.
    """
    n, first = F.size("verts"), F.col("verts")[0]
    one = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    close = F.transform(F.filter(G.closed_pairs(F.col("verts"), F.lit(True)), lambda p: G.distance(p["a"], p["b"]) <= near), lambda p: one("near_duplicate", p["a"]["x"], p["a"]["y"]))
    angle = lambda c: G.vector_angle(c["b"]["x"] - c["a"]["x"], c["b"]["y"] - c["a"]["y"], c["c"]["x"] - c["b"]["x"], c["c"]["y"] - c["b"]["y"])
    flat = F.filter(_corners(F.col("verts")), lambda c: (angle(c) <= math.radians(bend)) & (G.distance(c["a"], c["b"]) > near) & (G.distance(c["b"], c["c"]) > near))
    straight = F.transform(flat, lambda c: one("collinear", c["b"]["x"], c["b"]["y"]))
    cross = F.transform("_cross", lambda p: one("self_intersection", p["x"], p["y"]))
    middle = G.centroid(F.col("verts"), closing_first=True)
    clockwise = F.when(G.signed_area(F.col("verts"), closing_first=True) < 0, F.array(one("clockwise", middle["x"], middle["y"]))).otherwise(F.array().cast(_ISSUES))
    full = F.concat(close, straight, cross, clockwise)
    found = F.when(n < 3, F.array(one("few", first["x"], first["y"]))).when(~F.col("closed"), F.array(one("open", first["x"], first["y"]))).otherwise(full)
    # Only whole rings are swept; all issues come from one pass over them.
    swept = rings.select("ring_id", "closed", "verts", P.ring_crossings(F.when((n >= 3) & F.col("closed"), F.col("verts"))).alias("_cross"))
    out = swept.select("ring_id", F.explode(found).alias("i"))
    return out.select("ring_id", "i.kind", G.rounded(F.col("i.x")).alias("x"), G.rounded(F.col("i.y")).alias("y")).distinct()


def _corners(verts: Column) -> Column:
    """Each vertex with the ones before and after it, around the ring."""
    n = F.size(verts)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(verts[F.pmod(i + n - 1, n)].alias("a"), verts[i].alias("b"), verts[F.pmod(i + 1, n)].alias("c")))


def messages(issues: DataFrame) -> DataFrame:
    """One marker for each place: the kinds there, in order, joined by semicolons."""
    return issues.groupBy("ring_id", "x", "y").agg(F.array_join(F.array_sort(F.collect_set("kind")), "; ").alias("message"))


def canonical_path(verts: Column, digits: int = 2) -> Column:
    """A path as text that is the same from either end, with coordinates in steps of 10**-digits."""
    scale = 10**digits
    forward = F.transform(verts, lambda v: F.concat_ws(",", F.floor(v["x"] * scale + 0.5).cast("string"), F.floor(v["y"] * scale + 0.5).cast("string")))
    return F.least(F.array_join(forward, " "), F.array_join(F.reverse(forward), " "))


def distinct_paths(paths: DataFrame, key: str, order: str) -> DataFrame:
    """(path, first, copies): of equal paths, from either end, the first in order."""
    return paths.groupBy(F.col(key).alias("path")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))


def twin_pairs(pieces: DataFrame, tolerance: float, share: float = 0.01) -> DataFrame:
    """Pairs (a < b) of pieces of one style whose lengths differ by less than a share and whose Hausdorff distance is within a tolerance.

    Pieces meet in bands of the length's logarithm and in cells of their box's lower
    corner, which twins have within the tolerance, so only pieces of like length and
    place are compared, however many a style has.
    """
    m = pieces.select("piece_id", "style", "verts", G.bounds(F.col("verts")).alias("box"), G.path_length(F.col("verts"), F.lit(False)).alias("len")).where("len > 0")
    # Bands and cells are several times as wide as twins may be apart, so that few pieces reach into a second one.
    width, apart = math.log1p(10 * share), 1e-9 - math.log1p(-min(share, 1 - 1e-9))
    band = lambda by=0.0: F.floor((F.ln("len") + by) / width)
    cell, slack = 16 * max(tolerance, 1e-6), tolerance + 1e-9
    at = lambda axis, by=0.0: F.floor((F.col(f"box.min{axis}") + by) / cell)
    reach = lambda axis: F.explode(F.sequence(at(axis, -slack), at(axis, slack)))
    left = m.withColumn("band", F.explode(F.sequence(band(-apart), band(apart)))).withColumn("cx", reach("x")).withColumn("cy", reach("y"))
    right = m.withColumn("band", band()).withColumn("cx", at("x")).withColumn("cy", at("y"))
    keys = ["style", "band", "cx", "cy"]
    sided = lambda df, s: df.select(*keys, *(F.col(c).alias(c + s) for c in ("piece_id", "verts", "box", "len")))
    near = sided(left, "1").join(sided(right, "2"), keys).where("piece_id1 < piece_id2").where(F.abs(F.col("len1") - F.col("len2")) <= share * F.greatest("len1", "len2"))
    for side in ("minx", "miny", "maxx", "maxy"):  # the sides of two boxes differ by no more than the paths do
        near = near.where(F.abs(F.col(f"box1.{side}") - F.col(f"box2.{side}")) <= tolerance + 1e-9)
    return near.withColumn("gap", G.hausdorff(F.col("verts1"), F.col("verts2"))).where(F.col("gap") <= tolerance).select(F.col("piece_id1").alias("a"), F.col("piece_id2").alias("b"), "gap")


def twins(pieces: DataFrame, tolerance: float, share: float = 0.01) -> DataFrame:
    """(piece_id) of pieces that are a twin of one kept before, in order of piece_id.

    A piece whose only twins were dropped stays. The order matters, so the ids of a
    style's pairs are worked on together; their shapes have been compared before that.
    Only pieces of one style are twins: put the drawing into the style where drawings
    are apart.
    """
    pairs = twin_pairs(pieces, tolerance, share).select("a", "b").join(pieces.select(F.col("piece_id").alias("a"), "style"), "a")
    kind = pieces.schema["piece_id"].dataType.simpleString()

    def drop(part: pd.DataFrame) -> pd.DataFrame:
        dropped = set()
        for a, b in part.sort_values(["b", "a"])[["a", "b"]].itertuples(index=False):  # a comes before b, so a is settled
            if a not in dropped:
                dropped.add(b)
        return pd.DataFrame({"piece_id": pd.Series(list(dropped), dtype=part["b"].dtype)})

    return pairs.groupBy("style").applyInPandas(drop, f"piece_id {kind}")


def without_twins(pieces: DataFrame, tolerance: float, share: float = 0.01) -> DataFrame:
    """pieces without their twins()."""
    return pieces.join(twins(pieces, tolerance, share), "piece_id", "left_anti").select(*pieces.columns)


def run_counters(pieces: DataFrame, tolerance: float, least: float = 0.0, digits: int = 2) -> DataFrame:
    """One row (created, duplicates, twins, short): what becomes of open pieces.

    Pieces no longer than `least` are short; of equal paths of one style, from either
    end, the first stays; of the rest, those near one that stays are twins.
    """
    length = G.path_length(F.col("verts"), F.lit(False))
    measured = pieces.withColumns({"long": F.coalesce(length > least, F.lit(False)), "path": canonical_path(F.col("verts"), digits)})
    # Equal paths are counted as they are found; only the first ones are compared with each other.
    paths = measured.groupBy("style", "long", "path").agg(F.min("piece_id").alias("piece_id"), F.count(F.lit(1)).alias("n"))
    counts = paths.agg(F.coalesce(F.sum(F.when(F.col("long"), F.col("n"))), F.lit(0)).alias("long"), F.count_if("long").alias("firsts"), F.coalesce(F.sum(F.when(~F.col("long"), F.col("n"))), F.lit(0)).alias("short"))
    first = measured.join(paths.where("long").select("piece_id"), "piece_id", "left_semi").drop("path", "long")
    gone = twins(first, tolerance).agg(F.count(F.lit(1)).alias("twins"))
    return counts.crossJoin(gone).select(F.expr("firsts - twins").alias("created"), F.expr("long - firsts").alias("duplicates"), "twins", "short")


def join_chains(pieces: DataFrame, tolerance: float, own_cell: bool = False) -> DataFrame:
    """Open pieces of one drawing and style joined end to end: (drawing, style, chain, n_pieces, points, closed).

    In order of piece_id, a chain grows at its tail and then at its head by the nearest
    end within the tolerance; a piece is turned so that its near end comes first. The
    order of joining matters, so a style of a drawing is worked on as a whole, as the
    drawing it belongs to would be. Closed pieces pass as they are. With `own_cell` only
    ends whose coordinates round to the same cell meet, so near ends of two cells do not.
    """

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("piece_id")
        ids = part["piece_id"].tolist()
        paths = [[(p["x"], p["y"]) for p in v] for v in part["verts"]]
        shut = part["closed"].tolist()
        ends: dict[tuple[int, int], list[tuple[int, int]]] = {}
        whole = round if own_cell else math.floor
        reach = (0,) if own_cell else (-1, 0, 1)
        cell = lambda p: (whole(p[0] / tolerance), whole(p[1] / tolerance))
        for i, path in enumerate(paths):
            if not shut[i]:
                for side in (0, -1):
                    ends.setdefault(cell(path[side]), []).append((i, side))
        free = [not x for x in shut]

        def nearest(p: tuple[float, float]) -> tuple[int, int] | None:
            cx, cy = cell(p)
            found = [(math.dist(p, paths[i][side]), ids[i], i, side) for dx in reach for dy in reach for i, side in ends.get((cx + dx, cy + dy), ()) if free[i]]
            found = [f for f in found if f[0] <= tolerance]
            return min(found)[2:] if found else None

        rows = []
        for i in range(len(paths)):
            if shut[i]:
                rows.append((ids[i], 1, len(paths[i]), True))
            elif free[i]:
                free[i] = False
                chain, n = list(paths[i]), 1
                for tail in (True, False):
                    while hit := nearest(chain[-1] if tail else chain[0]):
                        j, side = hit
                        free[j], n = False, n + 1
                        more = paths[j] if side == 0 else paths[j][::-1]
                        chain = chain + more[1:] if tail else more[:0:-1] + chain
                rows.append((ids[i], n, len(chain), len(chain) > 2 and math.dist(chain[0], chain[-1]) <= tolerance))
        out = pd.DataFrame(rows, columns=["chain", "n_pieces", "points", "closed"])
        out.insert(0, "style", part["style"].iloc[0])
        out.insert(0, "drawing", part["drawing"].iloc[0])
        return out

    return pieces.groupBy("drawing", "style").applyInPandas(join, "drawing long, style string, chain string, n_pieces long, points long, closed boolean")
