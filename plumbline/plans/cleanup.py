"""Queries that clean polylines: validation, duplicates, twins, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import cleanup as P
from . import views as V
from .views import r4


def q_ring_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of issues by ring and kind."""
    return P.ring_issues(V.rings(spark, sf_dir)).groupBy("ring_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def q_issue_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One marker for each place, with its messages."""
    return P.messages(P.ring_issues(V.rings(spark, sf_dir)))


def q_dedup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of open rings on a coarse grid: equal ones, from either end, once."""
    pairs = V.rings(spark, sf_dir).where("NOT closed").select("ring_id", F.explode(G.closed_pairs(F.col("verts"), F.lit(False))).alias("p"))
    coarse = lambda v: F.struct(F.floor(v["x"] / 10).cast("double").alias("x"), F.floor(v["y"] / 10).cast("double").alias("y"))
    paths = pairs.select("ring_id", P.canonical_path(F.array(coarse(F.col("p.a")), coarse(F.col("p.b"))), 0).alias("path"))
    return P.distinct_paths(paths, "path", "ring_id")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-vertex pieces of open rings; a drawing is a thousand orders, its style the priority."""
    r = V.rings(spark, sf_dir).where("NOT closed")
    p = r.select("ring_id", "layer", F.posexplode(G.closed_pairs(F.col("verts"), F.lit(False))).alias("i", "p"))
    point = lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), F.lit(0.0).alias("bulge"))
    return p.select(F.concat_ws("-", F.lpad(F.col("ring_id").cast("string"), 12, "0"), F.lpad(F.col("i").cast("string"), 4, "0")).alias("piece_id"), F.floor(F.col("ring_id") / 1000).cast("long").alias("drawing"), F.col("layer").alias("style"), F.array(point(F.col("p.a")), point(F.col("p.b"))).alias("verts"), F.lit(False).alias("closed"))


def q_near_twin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of one drawing and style that nearly coincide."""
    p = _pieces(spark, sf_dir).withColumn("style", F.concat_ws("/", F.col("drawing").cast("string"), "style"))
    return P.twin_pairs(p, 1.5, 0.02).select("a", "b", G.rounded(F.col("gap")).alias("gap"))


def q_smart_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.join_chains(_pieces(spark, sf_dir), 0.5)


def q_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces stay, and how many are too short, duplicates or near twins."""
    p = _pieces(spark, sf_dir).withColumn("style", F.concat_ws("/", F.col("drawing").cast("string"), "style"))
    return P.run_counters(p, 1.5, 2.0)


QUERIES = [q_ring_issues, q_issue_markers, q_dedup_paths, q_near_twin_pairs, q_smart_join, q_run_counters]

_DIST = lambda a, b: f"sqrt(pow({a}x - {b}x, 2) + pow({a}y - {b}y, 2))"
_ISSUES = f"""ve AS (SELECT v.ring_id, v.i, v.n, v.x, v.y, r.closed FROM vert v JOIN ring r USING (ring_id)),
tri AS (SELECT b.ring_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy FROM ve b JOIN ve a ON a.ring_id = b.ring_id AND a.i = (b.i + b.n - 1) % b.n JOIN ve c ON c.ring_id = b.ring_id AND c.i = (b.i + 1) % b.n WHERE b.closed),
ang AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS l1, sqrt(pow(cx - bx, 2) + pow(cy - by_, 2)) AS l2, (bx - ax) * (cx - bx) + (by_ - ay) * (cy - by_) AS dt FROM tri),
ed AS (SELECT ring_id, i, n, ax, ay, bx, by_ FROM edge WHERE closed),
pr AS (SELECT p.ring_id, p.ax, p.ay, p.bx - p.ax AS rx, p.by_ - p.ay AS ry, q.ax AS sx0, q.ay AS sy0, q.bx - q.ax AS sx, q.by_ - q.ay AS sy FROM ed p JOIN ed q ON p.ring_id = q.ring_id AND p.i + 1 < q.i AND NOT (p.i = 0 AND q.i = p.n - 1)),
dn AS (SELECT *, rx * sy - ry * sx AS den FROM pr), tu AS (SELECT *, ((sx0 - ax) * sy - (sy0 - ay) * sx) / den AS t, ((sx0 - ax) * ry - (sy0 - ay) * rx) / den AS u FROM dn WHERE abs(den) >= 1e-12),
iss AS (SELECT DISTINCT ring_id, kind, {r4('x')} AS x, {r4('y')} AS y FROM (
  SELECT ring_id, 'open' AS kind, x, y FROM ve WHERE NOT closed AND i = 0
  UNION ALL SELECT ring_id, 'near_duplicate', ax, ay FROM edge WHERE closed AND sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) <= 1e-4
  UNION ALL SELECT ring_id, 'collinear', bx, by_ FROM ang WHERE l1 > 1e-4 AND l2 > 1e-4 AND acos(least(greatest(dt / (l1 * l2), -1), 1)) <= radians(0.5::DOUBLE)
  UNION ALL SELECT ring_id, 'self_intersection', ax + t * rx, ay + t * ry FROM tu WHERE t > 1e-9 AND t < 1 - 1e-9 AND u > 1e-9 AND u < 1 - 1e-9
  UNION ALL SELECT ring_id, 'clockwise', sum(ax) / any_value(n), sum(ay) / any_value(n) FROM edge WHERE closed GROUP BY ring_id HAVING sum(ax * by_ - bx * ay) < 0))"""
_PIECES = """pc AS (SELECT lpad(ring_id::VARCHAR, 12, '0') || '-' || lpad(i::VARCHAR, 4, '0') AS piece_id, (ring_id // 1000)::VARCHAR || '/' || layer AS style, ax, ay, bx, by_, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len FROM edge WHERE NOT closed AND NOT closing)"""


def _seg(px: str, py: str, s: str) -> str:
    """Distance of a point from piece s's segment."""
    t = f"least(greatest((({px} - {s}.ax) * ({s}.bx - {s}.ax) + ({py} - {s}.ay) * ({s}.by_ - {s}.ay)) / pow({s}.len, 2), 0), 1)"
    return f"sqrt(pow({px} - {s}.ax - {t} * ({s}.bx - {s}.ax), 2) + pow({py} - {s}.ay - {t} * ({s}.by_ - {s}.ay), 2))"


_HAUS = "greatest(" + ", ".join([_seg("p.ax", "p.ay", "q"), _seg("p.bx", "p.by_", "q"), _seg("q.ax", "q.ay", "p"), _seg("q.bx", "q.by_", "p")]) + ")"
SQL = {
    "q_ring_issues": f"WITH {V.VERTS}, {_ISSUES} SELECT ring_id, kind, count(*) AS n FROM iss GROUP BY ring_id, kind",
    "q_issue_markers": f"WITH {V.VERTS}, {_ISSUES} SELECT ring_id, x, y, string_agg(DISTINCT kind, '; ' ORDER BY kind) AS message FROM iss GROUP BY ring_id, x, y",
    "q_dedup_paths": f"""WITH {V.VERTS}, p AS (SELECT ring_id, floor(ax / 10)::BIGINT::VARCHAR || ',' || floor(ay / 10)::BIGINT::VARCHAR AS a, floor(bx / 10)::BIGINT::VARCHAR || ',' || floor(by_ / 10)::BIGINT::VARCHAR AS b FROM edge WHERE NOT closed AND NOT closing)
SELECT least(a || ' ' || b, b || ' ' || a) AS path, min(ring_id) AS first, count(*) AS copies FROM p GROUP BY least(a || ' ' || b, b || ' ' || a)""",
    "q_near_twin_pairs": f"""WITH {V.VERTS}, {_PIECES} SELECT p.piece_id AS a, q.piece_id AS b, {r4(_HAUS)} AS gap FROM pc p JOIN pc q ON p.style = q.style AND p.piece_id < q.piece_id
WHERE p.len > 0 AND q.len > 0 AND abs(p.len - q.len) <= 0.02::DOUBLE * greatest(p.len, q.len) AND {_HAUS} <= 1.5""",
}
_CELL = lambda c: f"floor({c} * 100 + 0.5)::BIGINT::VARCHAR"
SQL["q_run_counters"] = f"""WITH RECURSIVE {V.VERTS}, {_PIECES},
lg AS (SELECT *, {_CELL('ax')} || ',' || {_CELL('ay')} AS a, {_CELL('bx')} || ',' || {_CELL('by_')} AS b FROM pc WHERE len > 2.0),
ft AS (SELECT style, least(a || ' ' || b, b || ' ' || a) AS path, min(piece_id) AS piece_id FROM lg GROUP BY ALL),
fp AS (SELECT lg.* FROM lg WHERE piece_id IN (SELECT piece_id FROM ft)),
tw AS (SELECT p.style, p.piece_id AS a, q.piece_id AS b FROM fp p JOIN fp q ON p.style = q.style AND p.piece_id < q.piece_id WHERE abs(p.len - q.len) <= 0.01::DOUBLE * greatest(p.len, q.len) AND {_HAUS} <= 1.5),
bl AS (SELECT style, b, list(a) AS befores, row_number() OVER (PARTITION BY style ORDER BY b) AS k FROM tw GROUP BY style, b),
r AS (SELECT DISTINCT style, 0::BIGINT AS k, []::VARCHAR[] AS dropped FROM bl
  UNION ALL SELECT bl.style, bl.k, CASE WHEN len(list_filter(bl.befores, lambda x: NOT list_contains(r.dropped, x))) > 0 THEN list_append(r.dropped, bl.b) ELSE r.dropped END FROM r JOIN bl ON bl.style = r.style AND bl.k = r.k + 1),
gone AS (SELECT coalesce(sum(n), 0) AS n FROM (SELECT style, max(len(dropped)) AS n FROM r GROUP BY style))
SELECT (SELECT count(*) FROM ft) - gone.n::BIGINT AS created, (SELECT count(*) FROM lg) - (SELECT count(*) FROM ft) AS duplicates, gone.n::BIGINT AS twins, (SELECT count(*) FROM pc) - (SELECT count(*) FROM lg) AS short FROM gone"""
