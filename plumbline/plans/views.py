"""Drawing-shaped views of the input tables, and the same views as SQL.

Inserts come from order lines, rings from orders, points from customers, zones from
nations, embeddings from the embeddings table. Document order is an explicit sortable
key, never a running number over a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import table


def line_order() -> F.Column:
    """A line's place in its document, as text that sorts."""
    return F.concat_ws("-", *(F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("l_orderkey", 12), ("l_linenumber", 4), ("l_partkey", 12), ("l_suppkey", 12))))


def inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block inserts: one for each order line, named by its part."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("double").alias("size"))
    joined = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        line_order().alias("ent_ord"),
        F.col("p_name").alias("block_name"),
        F.concat("l_returnflag", "l_linestatus").alias("layer"),
        F.greatest("l_quantity", "size").alias("length"),
        F.least("l_quantity", "size").alias("width"),
        (F.col("l_extendedprice") / 1000).alias("x"),
        (F.col("l_quantity") * 2).alias("y"),
        F.col("p_brand").alias("colour"),
        F.col("l_orderkey").alias("drawing"),
    )


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines: the lines of an order with three or more, in document order."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(line_order().alias("o"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_discount").alias("bulge")).alias("v"))
    verts = line.groupBy(F.col("l_orderkey").alias("ring_id")).agg(F.array_sort(F.collect_list("v")).alias("vs")).where(F.size("vs") >= 3)
    verts = verts.select("ring_id", F.transform("vs", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["bulge"].alias("bulge"))).alias("verts"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("layer"), (F.col("o_orderstatus") == "F").alias("closed"))
    return verts.join(orders, F.col("ring_id") == F.col("o_orderkey")).select("ring_id", "layer", "closed", "verts")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("point_id"), F.col("c_name").alias("name"), ((F.col("c_custkey") * 37 % 1000) / 10.0).alias("x"), ((F.col("c_acctbal") + 1000) / 110.0).alias("y"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diamonds on a grid of five by five; neighbours overlap."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone_ord"), F.col("n_name").alias("zone"), (F.col("n_nationkey") % 5 * 20 + 10).cast("double").alias("cx"), (F.floor(F.col("n_nationkey") / 5) * 20 + 10).cast("double").alias("cy"))
    corner = lambda dx, dy: F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"), F.lit(0.0).alias("bulge"))
    return n.select("zone_ord", "zone", F.array(corner(12.0, 0.0), corner(0.0, 12.0), corner(-12.0, 0.0), corner(0.0, -12.0)).alias("poly"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four orientations for each owner."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id"), F.floor(F.col("vec_id") / 4).cast("long").alias("owner"), (F.col("vec_id") % 4).cast("int").alias("orient"), F.col("embedding").cast("array<double>").alias("vec"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """63-bit words of the signs of the first 63 components."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 63).alias("v"))
    word = F.aggregate("v", F.lit(0).cast("long"), lambda t, x: t * 2 + (x > 0).cast("long"))
    return e.select("vec_id", word.alias("word"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry features of a block for each brand."""
    p = table(spark, sf_dir, "part")
    one = [F.count_if(F.col("p_size") % 8 == i).alias(f"h{i}") for i in range(8)]
    kinds = [F.count_if(F.col("p_size") % 4 == i).alias(f"n{i}") for i in range(4)]
    g = p.groupBy(F.col("p_brand").alias("name")).agg((F.sum("p_size") * 10.0 / F.count(F.lit(1))).alias("width"), (F.sum(G.rounded(F.col("p_retailprice"), 2)) / F.count(F.lit(1)) / 10).alias("depth0"), F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("components"), *one, *kinds)
    g = g.withColumn("depth", G.rounded(F.col("depth0")))
    hist = F.array(*(F.bround(F.col(f"h{i}") * 1000.0 / F.col("n")).cast("int") for i in range(8)))
    return g.select("name", "width", "depth", (F.greatest("width", "depth") / F.least("width", "depth")).alias("aspect"), *(F.col(f"n{i}") for i in range(4)), "n", "components", hist.alias("angles"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles, by part."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("box_id"), F.col("p_brand").alias("drawing"), (F.col("p_partkey") * 37 % 307).cast("double").alias("x"), (F.col("p_partkey") * 61 % 293).cast("double").alias("y"), (F.col("p_size") % 9 + 1).cast("double").alias("w"), (F.col("p_size") % 5 + 1).cast("double").alias("h"))
    return p.select("box_id", "drawing", F.struct(F.col("x").alias("minx"), F.col("y").alias("miny"), (F.col("x") + F.col("w")).alias("maxx"), (F.col("y") + F.col("h")).alias("maxy")).alias("box"))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a sheet: documents by id, with every seventh zone blank."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("source")).alias("zone"), "lang", "n_chars")


ORDER = "lpad(l_orderkey::VARCHAR, 12, '0') || '-' || lpad(l_linenumber::VARCHAR, 4, '0') || '-' || lpad(l_partkey::VARCHAR, 12, '0') || '-' || lpad(l_suppkey::VARCHAR, 12, '0')"

INSERTS = f"""ins AS (SELECT {ORDER} AS ent_ord, p_name AS block_name, l_returnflag || l_linestatus AS layer,
  greatest(l_quantity, p_size::DOUBLE) AS length, least(l_quantity, p_size::DOUBLE) AS width, l_extendedprice / 1000 AS x, l_quantity * 2 AS y,
  p_brand AS colour, l_orderkey AS drawing FROM lineitem JOIN part ON l_partkey = p_partkey)"""

VERTS = f"""vert AS (SELECT * FROM (SELECT l_orderkey AS ring_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n,
  l_quantity AS x, l_extendedprice / 1000 AS y, l_discount AS bulge FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {ORDER})) WHERE n >= 3),
ring AS (SELECT o_orderkey AS ring_id, o_orderpriority AS layer, o_orderstatus = 'F' AS closed FROM orders WHERE o_orderkey IN (SELECT ring_id FROM vert)),
edge AS (SELECT a.ring_id, a.i, a.n, r.layer, r.closed, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, a.bulge, a.i = a.n - 1 AS closing
  FROM vert a JOIN vert b ON a.ring_id = b.ring_id AND b.i = (a.i + 1) % a.n JOIN ring r ON a.ring_id = r.ring_id)"""

POINTS = "pt AS (SELECT c_custkey AS point_id, c_name AS name, (c_custkey * 37 % 1000) / 10.0::DOUBLE AS x, (c_acctbal + 1000) / 110.0::DOUBLE AS y FROM customer)"

ZONES = """zn AS (SELECT n_nationkey AS zone_ord, n_name AS zone, (n_nationkey % 5 * 20 + 10)::DOUBLE AS cx, (n_nationkey // 5 * 20 + 10)::DOUBLE AS cy FROM nation),
zedge AS (SELECT zone_ord, zone, cx + dx1 AS ax, cy + dy1 AS ay, cx + dx2 AS bx, cy + dy2 AS by_ FROM zn, (VALUES (12::DOUBLE, 0::DOUBLE, 0::DOUBLE, 12::DOUBLE), (0, 12, -12, 0), (-12, 0, 0, -12), (0, -12, 12, 0)) AS e(dx1, dy1, dx2, dy2))"""

EMB = "emb AS (SELECT vec_id, vec_id // 4 AS owner, (vec_id % 4)::INTEGER AS orient, embedding::DOUBLE[] AS vec FROM embeddings)"

HASHES = "hs AS (SELECT vec_id, sum(CASE WHEN embedding[k] > 0 THEN (1::BIGINT << (63 - k)::INTEGER) ELSE 0 END)::BIGINT AS word FROM embeddings, range(1, 64) t(k) GROUP BY vec_id)"

FEATURES = """ft AS (SELECT *, greatest(width, depth) / least(width, depth) AS aspect FROM (
  SELECT p_brand AS name, sum(p_size) * 10.0::DOUBLE / count(*) AS width, floor(sum(floor(p_retailprice * 100 + 0.50001) / 100.0::DOUBLE) / count(*) / 10 * 10000 + 0.50001) / 10000.0::DOUBLE AS depth,
  count(*) AS n, count(DISTINCT p_type) AS components,
""" + ",\n".join(f"  count(*) FILTER (p_size % 4 = {i}) AS n{i}" for i in range(4)) + ",\n  [" + ", ".join(f"round_even(count(*) FILTER (p_size % 8 = {i}) * 1000.0::DOUBLE / count(*), 0)::INTEGER" for i in range(8)) + "] AS angles FROM part GROUP BY p_brand))"

BOXES = "bx AS (SELECT p_partkey AS box_id, p_brand AS drawing, (p_partkey * 37 % 307)::DOUBLE AS minx, (p_partkey * 61 % 293)::DOUBLE AS miny, (p_partkey * 37 % 307 + p_size % 9 + 1)::DOUBLE AS maxx, (p_partkey * 61 % 293 + p_size % 5 + 1)::DOUBLE AS maxy FROM part)"

SHEET = "sh AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS zone, lang, n_chars FROM documents)"


def r4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.50001) / 10000.0::DOUBLE"
