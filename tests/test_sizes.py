"""Tables that the given ones don't show: rings whose points lie on a line, and more of the same."""

import duckdb
import pytest

from plumbline import catalogue

from . import oracle

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
FLAT = [(12864, 2, 17212, 749, 27.0, 75297.89), (12864, 3, 19841, 742, 27.0, 41361.03), (12864, 4, 8351, 496, 27.0, 13596.14), (57203, 2, 17690, 248, 24.0, 100130.75), (57203, 6, 4642, 823, 18.0, 26443.9), (57203, 7, 5658, 415, 24.0, 20043.06), (57203, 7, 16430, 585, 18.0, 29630.49), (61305, 6, 7609, 488, 49.0, 7475.59), (61305, 6, 11263, 542, 49.0, 40625.09), (61305, 7, 12570, 369, 49.0, 7146.93)]


def closed_rings(folder, lines):
    """Tables of these order lines, all orders closed."""
    con = duckdb.connect()
    con.sql(f"create table l as select *, 0.0::DOUBLE as l_discount from (values {', '.join(map(str, lines))}) t(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)")
    con.sql(f"copy (select * replace (l_orderkey::BIGINT as l_orderkey, l_partkey::BIGINT as l_partkey, l_suppkey::BIGINT as l_suppkey, l_quantity::DOUBLE as l_quantity, l_extendedprice::DOUBLE as l_extendedprice) from l) to '{folder}/lineitem.parquet'")
    con.sql(f"copy (select distinct l_orderkey::BIGINT as o_orderkey, '5-LOW' as o_orderpriority, 'F' as o_orderstatus from l) to '{folder}/orders.parquet'")
    return folder


@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    """Orders of sf0.1 whose rings have no area but that of rounding, closed."""
    return closed_rings(str(tmp_path_factory.mktemp("flat")), FLAT)


@pytest.mark.parametrize("name", ["q_ring_area", "q_ring_issues", "q_issue_markers"])
def test_flat_rings(spark, flat, name):
    oracle.compare(spark, oracle.connect(flat), flat, QUERIES[name], SQL[name])


def crowd(spark):
    """Two heaps of a hundred boxes each, two apart, with one box between them that touches neither."""
    rows = [(100 * h + i, "d", (20.0 * h, 0.0, 20.0 * h + 1 + i % 7, 1.0 + i % 5)) for h in (0, 1) for i in range(100)]
    return spark.createDataFrame([*rows, (500, "d", (12.0, 0.0, 13.0, 1.0))], "box_id long, drawing string, box struct<minx:double,miny:double,maxx:double,maxy:double>")


def test_pairs_are_found_once(spark):
    from plumbline.operators import clusters as K

    pairs = K.touching_pairs(crowd(spark), 1.5, 1.0)
    assert pairs.count() == pairs.distinct().count() == 2 * 100 * 99 // 2
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_heaps_are_one_box(spark):
    from pyspark.sql import functions as F

    from plumbline.operators import clusters as K

    boxes = crowd(spark)
    members, few = K.touching_classes(boxes, ["drawing"], F.lit(1.5))
    assert members.count() == 201 and few.count() == 3
    want = {r["box_id"]: r["component"] for r in K.components(boxes.select("box_id"), K.touching_pairs(boxes, 1.5, 4.0)).collect()}
    assert {r["box_id"]: r["component"] for r in K.touching_components(boxes, 1.5, 4.0).collect()} == want
    assert set(want.values()) == {0, 100, 500}


def test_parts_of_heaps(spark):
    from plumbline.operators import clusters as K

    assert K.part_counts(crowd(spark).withColumnRenamed("drawing", "block")).first()["parts"] == 3


@pytest.fixture(scope="module")
def bows(tmp_path_factory):
    """Two thousand closed rings of four corners that cross themselves, so that both halves cancel out."""
    lines = [(i, k + 1, 1, 1, float(1 + (i * 7 + k % 2 * (1 + i % 40)) % 50), (90068 + (i * 7919 + k * 104729 * (i % 89 + 1)) % 10409931) / 100) for i in range(2000) for k in range(4)]
    return closed_rings(str(tmp_path_factory.mktemp("bows")), lines)


@pytest.mark.parametrize("name", ["q_rect_dims", "q_ring_issues", "q_issue_markers"])
def test_rings_that_cancel_out(spark, bows, name):
    oracle.compare(spark, oracle.connect(bows), bows, QUERIES[name], SQL[name])


@pytest.mark.parametrize("least", [2, 3])
def test_clusters_without_pairs(spark, least):
    """Boxes of many tiles, some of them equal, and one as wide as a tile: the clusters of all pairs, from rows that don't grow with the pairs."""
    from plumbline.operators import clusters as K

    at = lambda i, a, n: i * a % n
    rows = [(i, f"d{i % 2}", (float(at(i, 37, 307)), float(at(i, 61, 293)), float(at(i, 37, 307) + 1 + i % 9), float(at(i, 61, 293) + 1 + i % 5))) for i in range(1500)]
    rows += [(5000 + i, "d0", rows[2 * i][2]) for i in range(200)] + [(6000, "d1", (0.0, 0.0, 90.0, 4.0))]
    boxes = spark.createDataFrame(rows, "box_id long, drawing string, box struct<minx:double,miny:double,maxx:double,maxy:double>")
    limits = K.thresholds(boxes)
    want = sorted(map(tuple, K.anchor_clusters(K.anchor_pairs(boxes, limits), least).collect()))
    assert len({c for _, c, _ in want}) > 50
    assert sorted(map(tuple, K.clusters_around_anchors(boxes, limits, least=least).collect())) == want
