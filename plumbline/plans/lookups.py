"""Queries on lookups: tiers of names, best per key, descriptors, folders, cleaned paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import strings as S
from ..operators import lookups as L
from ..operators import matching as O
from ..session import table
from . import matching as M
from . import views as V


def q_block_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions by name: as it is, without its index, with safe characters, and both, then by normalised keys, then by a normalised prefix.

    The SQL has no tier for prefixes; at sf0.01 no item comes to it.
    """
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    rows = names.select(F.col("p_name").alias("definition"))
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit("__012"))).when(F.col("p_partkey") % 4 == 2, F.upper("p_name")).otherwise(F.concat(F.lit("no "), "p_name")).alias("name"))
    n, d = F.col("name"), F.col("definition")
    return L.tiered_join(wanted, rows, "item", [(n, d), (S.without_index(n), d), (S.safe_runs(n), S.safe_runs(d)), (S.safe_runs(S.without_index(n)), S.safe_runs(d)), (S.key(n), S.key(d))], (S.comparable(n), S.comparable(d))).select("item", "definition", "tier")


def q_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's insert of the least width, then length and place."""
    i = V.inserts(spark, sf_dir).select("block_name", "width", "length", "ent_ord")
    return L.keep_best(i, "block_name", "width")


def q_nearest_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest descriptors of the work items, by differing bits."""
    h = V.hashes(spark, sf_dir)
    return O.nearest_bits(h.where(F.col("vec_id") % M.EVERY == 0), h, 2).withColumnRenamed("candidate", "vec_id")


def q_ratio_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ratio_matches(q_nearest_two(spark, sf_dir), "query", 0.9)


def q_match_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each work item and its best candidate are filed."""
    return L.bucket_table(M.q_composite_top5(spark, sf_dir), "query", "candidate")


def q_without_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts left when one layer's are removed, by layer."""
    return L.without_layer(V.inserts(spark, sf_dir), "rf").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def q_clean_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings without repeated and turning-back vertices: vertices before and after."""
    r = V.rings(spark, sf_dir)
    points = F.transform("verts", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return r.select("ring_id", F.size("verts").alias("before"), F.size(P.clean_vertices(points, F.col("closed"))).alias("after"))


QUERIES = [q_block_resolution, q_keep_best, q_nearest_two, q_ratio_matches, q_match_buckets, q_without_layer, q_clean_vertices]

_KEY = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
_SAFE = lambda c: f"regexp_replace({c}, '[<>:\"/\\\\|?*]+', '_', 'g')"
_STEM = "regexp_replace(name, '__[0-9]{2,}$', '')"
_NEAR = f"""WITH {V.HASHES}, p AS (SELECT q.vec_id AS query, h.vec_id, bit_count(xor(q.word, h.word))::INTEGER AS bits FROM hs q JOIN hs h ON q.vec_id % {M.EVERY} = 0 AND h.vec_id <> q.vec_id),
k AS (SELECT query, vec_id, bits, row_number() OVER (PARTITION BY query ORDER BY bits, vec_id)::INTEGER AS rank FROM p QUALIFY rank <= 2)"""
SQL = {
    "q_block_resolution": f"""WITH d AS (SELECT DISTINCT p_name AS definition FROM part),
w AS (SELECT p_partkey AS item, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '__012' WHEN 2 THEN upper(p_name) ELSE 'no ' || p_name END AS name FROM part),
e AS (SELECT item, definition, 1 AS tier FROM w JOIN d ON name = definition UNION ALL SELECT item, definition, 2 FROM w JOIN d ON {_STEM} = definition
  UNION ALL SELECT item, definition, 3 FROM w JOIN d ON {_SAFE('name')} = {_SAFE('definition')} UNION ALL SELECT item, definition, 4 FROM w JOIN d ON {_SAFE(_STEM)} = {_SAFE('definition')} UNION ALL SELECT item, definition, 5 FROM w JOIN d ON {_KEY('name')} = {_KEY('definition')})
SELECT item, definition, tier FROM e QUALIFY tier = min(tier) OVER (PARTITION BY item)""",
    "q_keep_best": f"WITH {V.INSERTS} SELECT block_name, width, length, ent_ord FROM ins QUALIFY row_number() OVER (PARTITION BY block_name ORDER BY width, length, ent_ord) = 1",
    "q_nearest_two": f"{_NEAR} SELECT query, vec_id, bits, rank FROM k",
    "q_ratio_matches": f"{_NEAR} SELECT query FROM k GROUP BY query HAVING min(bits) FILTER (rank = 1) < 0.9 * min(bits) FILTER (rank = 2)",
    "q_match_buckets": M.SQL["q_composite_top5"].replace("SELECT * FROM t5", "SELECT CASE WHEN accepted THEN 'accepted' ELSE 'review' END || '/' || query::VARCHAR AS folder, query, candidate, score FROM t5 WHERE rank = 1"),
    "q_without_layer": f"WITH {V.INSERTS} SELECT layer, count(*) AS n FROM ins WHERE lower(layer) <> 'rf' GROUP BY layer",
}

# Vertices go onto a list one by one; one that the next turns back on is taken off again.
SQL["q_clean_vertices"] = f"""WITH RECURSIVE {V.VERTS},
rg AS (SELECT ring_id, list({{'x': x, 'y': y}} ORDER BY i) AS vs FROM vert GROUP BY ring_id),
dd AS (SELECT ring_id, closed, len(vs) AS n, list_reduce(list_transform(vs, lambda v: [v]), lambda a, b: CASE WHEN sqrt(pow(a[-1].x - b[1].x, 2) + pow(a[-1].y - b[1].y, 2)) > 1e-4 THEN list_concat(a, b) ELSE a END) AS ps FROM rg JOIN ring USING (ring_id)),
pp AS (SELECT ring_id, closed, n, CASE WHEN closed AND len(ps) > 1 AND sqrt(pow(ps[1].x - ps[-1].x, 2) + pow(ps[1].y - ps[-1].y, 2)) <= 1e-4 THEN ps[1:len(ps) - 1] ELSE ps END AS ps FROM dd),
r AS (SELECT ring_id, closed, n, ps, 1::BIGINT AS k, ps[1:0] AS st FROM pp
  UNION ALL SELECT ring_id, closed, n, ps, CASE WHEN back THEN k ELSE k + 1 END, CASE WHEN back THEN st[1:len(st) - 1] ELSE list_append(st, ps[k]) END FROM (
    SELECT *, coalesce(len(st) >= 2 AND l1 * l2 > 0 AND ((st[-1].x - st[-2].x) * (ps[k].x - st[-1].x) + (st[-1].y - st[-2].y) * (ps[k].y - st[-1].y)) / (l1 * l2) <= cos(radians(179.75::DOUBLE)), false) AS back FROM (
      SELECT *, sqrt(pow(st[-1].x - st[-2].x, 2) + pow(st[-1].y - st[-2].y, 2)) AS l1, sqrt(pow(ps[k].x - st[-1].x, 2) + pow(ps[k].y - st[-1].y, 2)) AS l2 FROM r WHERE k <= len(ps))))
SELECT ring_id, n::INTEGER AS before, (len(st) + CASE WHEN closed AND len(st) > 2 THEN 1 ELSE 0 END)::INTEGER AS after FROM r WHERE k = len(ps) + 1"""
