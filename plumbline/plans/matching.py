"""Queries that match blocks to a catalogue: hashes, embeddings, geometry, composite scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import similarity as C
from ..functions import strings as S
from ..operators import hamming as H
from ..operators import matching as M
from . import views as V
from .views import r4

#: Ids that this divides are the work items, held against all rows.
EVERY = 100


def _pick(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def q_hash_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the work items' hashes the five nearest others, by bits and then number."""
    h = V.hashes(spark, sf_dir)
    return M.nearest_bits(h.where(F.col("vec_id") % EVERY == 0), h, 5).select("query", "candidate", "bits", G.rounded(C.hash_similarity(F.col("bits"), F.col("bits"))).alias("similarity"), "rank")


def q_hash_topk_by_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the index of bands."""
    h = V.hashes(spark, sf_dir)
    found, _ = H.nearest_by_bands(h.where(F.col("vec_id") % EVERY == 0), h, 5)
    return found.select("query", "candidate", "bits", G.rounded(C.hash_similarity(F.col("bits"), F.col("bits"))).alias("similarity"), "rank")


def q_prefilter_top80(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.embeddings(spark, sf_dir)
    best = M.prefilter(e.where(F.col("owner") % EVERY == 0), e, 80)
    return best.select("query", "owner", G.rounded(F.col("sim"), 5).alias("sim"))


def q_geom_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex counts by kind, extents and the histogram of segment directions, scaled to 1000, by layer."""
    r = V.rings(spark, sf_dir).select("ring_id", "layer", "closed", F.explode(G.closed_pairs(F.col("verts"), F.col("closed"))).alias("p"))
    dx, dy = F.col("p.b.x") - F.col("p.a.x"), F.col("p.b.y") - F.col("p.a.y")
    bins = r.where((dx != 0) | (dy != 0)).select("layer", F.least(F.floor(G.fold_angle(dx, dy) / (3.141592653589793 / 8) + 1e-9).cast("int"), F.lit(7)).alias("bin"), (F.col("p.a.bulge") == 0).alias("straight"))
    g = bins.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count_if("straight").alias("n_line"), F.count_if(~F.col("straight")).alias("n_arc"), *(F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(8)))
    return g.select("layer", "n", "n_line", "n_arc", *(F.bround(F.col(f"b{i}") * 1000.0 / F.col("n")).cast("int").alias(f"h{i}") for i in range(8)))


def _feature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of blocks whose widths lie within a fifth."""
    f = V.features(spark, sf_dir)
    return M.band_join(_pick(f, "a_"), _pick(f, "b_"), "a_width", "b_width").where("a_name <> b_name")


def _geometry(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("geometry", C.geometry_similarity(**M.geometry_gaps("a_", "b_")))


def q_geom_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geometry(_feature_pairs(spark, sf_dir)).select(F.col("a_name").alias("source"), F.col("b_name").alias("candidate"), G.rounded(F.col("geometry")).alias("geometry"))


_BITS = lambda side: F.conv(F.substring(F.md5(F.col(f"{side}name").cast("binary")), 1, 4), 16, 10).cast("bigint")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by 0.7 of the hashes' and 0.3 of the geometry's likeness; the best 50, then those of 0.65 or more."""
    p = _geometry(_feature_pairs(spark, sf_dir))
    bits = C.hamming(_BITS("a_"), _BITS("b_"))
    score = C.final_score(C.hash_similarity(bits, bits), F.col("geometry"))
    best = M.top_k(p.withColumn("score", G.rounded(score)), "a_name", [F.desc("score"), F.col("b_name")], 50)
    return best.where("score >= 0.65").select(F.col("a_name").alias("source"), F.col("b_name").alias("candidate"), "score", "rank", "a_width", "a_depth", "b_width", "b_depth")


def q_rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("source", "candidate", "score", "rank")


def q_fallback_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorer without features: sizes, names and given visual parts; sizes below 0.25 are out; the best five."""
    f = V.features(spark, sf_dir).select("name", "width", "depth")
    p = _pick(f, "a_").join(_pick(f, "b_"), F.col("a_name") != F.col("b_name"))
    size = C.size_similarity(F.col("a_width"), F.col("a_depth"), F.col("b_width"), F.col("b_depth"))
    visual = 1 - C.hamming(_BITS("a_"), _BITS("b_")) / 16.0
    total = C.fallback_score(visual, visual, F.col("size"), S.name_similarity(F.col("a_name"), F.col("b_name")))
    scored = p.withColumn("size", size).where("size >= 0.25").withColumn("score", G.rounded(total))
    return M.top_k(scored, "a_name", [F.desc("score"), F.col("b_name")], 5).select(F.col("a_name").alias("source"), F.col("b_name").alias("candidate"), G.rounded(F.col("size")).alias("size"), "score", "rank")


def _image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items against prefiltered catalogue entries, with the features that image tools would give."""
    e = V.embeddings(spark, sf_dir)
    top = M.prefilter(e.where(F.col("owner") % EVERY == 0), e, 80)
    h = V.hashes(spark, sf_dir).where("vec_id % 4 = 0").select(F.floor(F.col("vec_id") / 4).cast("long").alias("o"), "word")
    j = top.join(h.select(F.col("o").alias("query"), F.col("word").alias("qw")), "query").join(h.select(F.col("o").alias("owner"), "word"), "owner")
    mod = lambda a, b, m: ((F.col("query") * a + F.col("owner") * b) % m)
    return j.select(
        "query", F.col("owner").alias("candidate"), C.hamming(F.col("qw"), F.col("word")).cast("int").alias("bits"), mod(7, 13, 41).cast("int").alias("good"), mod(5, 3, 23).cast("int").alias("inliers"),
        (mod(3, 11, 60) / 10.0).alias("hu"), (mod(2, 5, 90) / 10.0).alias("chamfer"), (1 + mod(1, 7, 10) / 10.0).alias("qa"), (1 + mod(4, 9, 10) / 10.0).alias("ca"),
    ).withColumn("aspect", C.log_ratio(F.col("qa"), F.col("ca"), 1e-6))


def _composite(pairs: DataFrame) -> DataFrame:
    score = C.composite_score(F.col("bits"), F.col("chamfer"), F.col("aspect"), F.col("hu"), F.col("good"), F.col("inliers"))
    return pairs.withColumn("score", G.rounded(score)).withColumn("accepted", M.accepted(F.col("bits"), F.col("good"), F.col("inliers"), F.col("hu")))


def q_composite_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five by composite score, of those within the aspect and hash gates."""
    scored = _composite(_image_pairs(spark, sf_dir)).where("aspect <= 0.45 AND bits <= 26")
    return M.top_k(scored, "query", [F.col("score"), F.col("candidate")], 5).select("query", "candidate", "score", "accepted", "rank")


def q_composite_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with tighter gates, and without them for items that then have no candidate."""
    scored = _composite(_image_pairs(spark, sf_dir))
    both = M.with_fallback(scored, scored.where("aspect <= 0.30 AND bits <= 20"), scored, "query")
    return M.top_k(both, "query", [F.col("score"), F.col("candidate")], 5).select("query", "candidate", "score", "scorer", "rank")


def q_match_map_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match map: for each work item its candidates as JSON, in rank order."""
    top = q_composite_top5(spark, sf_dir)
    entry = F.struct("rank", F.col("candidate").cast("string").alias("master_block"), "score")
    g = top.groupBy("query").agg(F.array_sort(F.collect_list(entry)).alias("topk"), F.min("score").alias("best"))
    return g.select(F.concat(F.lit("H"), F.col("query").cast("string")).alias("key"), F.to_json(F.transform("topk", lambda t: F.struct(t["master_block"].alias("master_block"), t["rank"].alias("rank")))).alias("topk"), "best")


def q_circular_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best correlation over all turns of each signature with the one after it."""
    e = V.embeddings(spark, sf_dir).select("vec_id", F.col("vec").alias("v"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return p.select("vec_id", G.rounded(C.circular_correlation(F.col("v"), F.col("w"), 64), 5).alias("best"))


def q_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.embeddings(spark, sf_dir).select("vec_id", "vec")
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("w")), "vec_id")
    return p.select("vec_id", G.rounded(C.correlation(F.col("vec"), F.col("w")), 5).alias("ncc"))


def q_edit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements by the first candidate: what to insert, where its pivot goes, and what to erase."""
    best = _ranked(spark, sf_dir).where("rank = 1")
    names = best.select(F.col("source").alias("colour"), "candidate", "a_width", "a_depth", "b_width", "b_depth")
    j = V.inserts(spark, sf_dir).join(names, "colour")
    moved = G.moved_to_pivot(F.col("x"), F.col("y"), F.struct((F.col("a_width") / 2).alias("x"), (F.col("a_depth") / 2).alias("y")), F.struct((F.col("b_width") / 2).alias("x"), (F.col("b_depth") / 2).alias("y")))
    plan = j.select("ent_ord", "candidate", moved.alias("m"))
    put = plan.select(F.lit("insert").alias("op"), F.col("ent_ord").alias("target"), F.col("candidate").alias("block"), G.rounded(F.col("m.x")).alias("x"), G.rounded(F.col("m.y")).alias("y"))
    return put.unionByName(plan.select(F.lit("erase").alias("op"), F.col("ent_ord").alias("target"), F.lit(None).cast("string").alias("block"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")))


def q_edit_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of inserts that are replaced: turned on by a given angle, their pivots where the old ones were."""
    i = V.inserts(spark, sf_dir).withColumn("n", F.substring("ent_ord", 1, 12).cast("long"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    pose = G.replaced_pose(point(F.col("x"), F.col("y")), (F.col("n") % 360).cast("double"), (1 + F.col("n") % 3).cast("double"), F.when(F.col("n") % 2 == 0, -1.0).otherwise(1.0), point(F.col("length") / 2, F.col("width") / 2), point(F.col("width") / 2, F.col("length") / 3), (F.col("n") % 24 * 15).cast("double"))
    return i.select("ent_ord", pose.alias("p")).select("ent_ord", *(G.rounded(F.col(f"p.{c}")).alias(c) for c in ("x", "y", "rotation")))


QUERIES = [q_edit_poses, q_hash_topk, q_hash_topk_by_bands, q_prefilter_top80, q_geom_features, q_geom_similarity, q_rank_candidates, q_fallback_rank, q_composite_top5, q_composite_with_fallback, q_match_map_json, q_circular_corr, q_ncc, q_edit_plan]

_DOT = lambda a, b: f"list_sum([p[1] * p[2] for p in list_zip({a}, {b})])"
_PRE = f"""sims AS (SELECT q.owner AS query, m.owner, max(list_inner_product(q.vec, m.vec)) AS sim FROM emb q JOIN emb m ON q.owner % {EVERY} = 0 AND m.owner <> q.owner GROUP BY q.owner, m.owner),
pre AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, owner) <= 80)"""
_GAP = lambda c, least: f"abs(greatest(a.{c}, {least}) - greatest(b.{c}, {least})) / greatest(a.{c}, b.{c}, {least})"
_CHI = " + ".join(f"CASE WHEN a.angles[{i}] + b.angles[{i}] > 0 THEN pow(a.angles[{i}] - b.angles[{i}], 2)::DOUBLE / (a.angles[{i}] + b.angles[{i}]) ELSE 0 END" for i in range(1, 9))
_PAIRS = f"""gp AS (SELECT a.name AS source, b.name AS candidate, a.width AS aw, a.depth AS ad, b.width AS bw, b.depth AS bd,
  0.30::DOUBLE * exp(-({_GAP('width', '1e-6::DOUBLE')})) + 0.20::DOUBLE * exp(-({_GAP('depth', '1e-6::DOUBLE')})) + 0.20::DOUBLE * exp(-abs(ln((a.aspect + 1e-9::DOUBLE) / (b.aspect + 1e-9::DOUBLE))))
  + 0.15::DOUBLE * exp(-({_CHI}) / 1000.0::DOUBLE) + 0.10::DOUBLE * exp(-({_GAP('n', '1.0::DOUBLE')})) + 0.05::DOUBLE * exp(-({_GAP('components', '1.0::DOUBLE')})) AS geometry
  FROM ft a JOIN ft b ON a.name <> b.name AND b.width BETWEEN a.width * (1 - 0.2::DOUBLE) AND a.width * (1 + 0.2::DOUBLE))"""
_HB = "bit_count(xor(('0x' || md5({a})[1:4])::BIGINT, ('0x' || md5({b})[1:4])::BIGINT))::INTEGER"
_RANKED = f"""rk AS (SELECT source, candidate, aw, ad, bw, bd, {r4("least(greatest(0.7::DOUBLE * least(greatest(0.6::DOUBLE * (1 - bits / 64.0::DOUBLE) + 0.4::DOUBLE * (1 - bits / 64.0::DOUBLE), 0), 1) + (1 - 0.7::DOUBLE) * geometry, 0), 1)")} AS score
  FROM (SELECT *, {_HB.format(a='source', b='candidate')} AS bits FROM gp)),
rc AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, candidate)::INTEGER AS rank FROM rk QUALIFY rank <= 50)"""
_NAMES = "least(greatest((CASE WHEN lower(a.name) = lower(b.name) THEN 100 ELSE 0 END + CASE WHEN contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)) THEN 50 ELSE 0 END + len(list_intersect(list_distinct(string_split(lower(a.name), '')), list_distinct(string_split(lower(b.name), ''))))) / 200.0::DOUBLE, 0), 1)"
_IMG = f"""ho AS (SELECT vec_id // 4 AS o, word FROM hs WHERE vec_id % 4 = 0),
im AS (SELECT query, pre.owner AS candidate, bit_count(xor(a.word, b.word))::INTEGER AS bits, ((query * 7 + pre.owner * 13) % 41)::INTEGER AS good, ((query * 5 + pre.owner * 3) % 23)::INTEGER AS inliers,
  ((query * 3 + pre.owner * 11) % 60) / 10.0::DOUBLE AS hu, ((query * 2 + pre.owner * 5) % 90) / 10.0::DOUBLE AS chamfer, abs(ln((1 + ((query + pre.owner * 7) % 10) / 10.0::DOUBLE + 1e-6::DOUBLE) / (1 + ((query * 4 + pre.owner * 9) % 10) / 10.0::DOUBLE + 1e-6::DOUBLE))) AS aspect
  FROM pre JOIN ho a ON a.o = query JOIN ho b ON b.o = pre.owner),
cs AS (SELECT *, {r4('bits + 2.2::DOUBLE * least(chamfer, 8) + 6.0::DOUBLE * least(aspect, 0.8::DOUBLE) + 0.6::DOUBLE * least(hu, 5) - 0.10::DOUBLE * least(good, 40) - 0.25::DOUBLE * least(inliers, 40)')} AS score,
  (bits <= 12 AND (good >= 12 OR inliers >= 10)) OR (bits <= 18 AND inliers >= 14) OR (hu <= 0.55 AND good >= 16) AS accepted FROM im)"""
_TOP5 = "t5 AS (SELECT query, candidate, score, accepted, row_number() OVER (PARTITION BY query ORDER BY score, candidate)::INTEGER AS rank FROM cs WHERE aspect <= 0.45 AND bits <= 26 QUALIFY rank <= 5)"
_STD = lambda v: f"(SELECT list((x - m) / greatest(s, 1e-9) ORDER BY k) FROM (SELECT x, k, avg(x) OVER () AS m, stddev_pop(x) OVER () AS s FROM (SELECT unnest({v}) AS x, unnest(range(len({v}))) AS k)))"

SQL = {
    "q_hash_topk": f"""WITH {V.HASHES}, p AS (SELECT q.vec_id AS query, h.vec_id AS candidate, bit_count(xor(q.word, h.word))::INTEGER AS bits FROM hs q JOIN hs h ON q.vec_id % {EVERY} = 0 AND h.vec_id <> q.vec_id)
SELECT query, candidate, bits, {r4('least(greatest(0.6::DOUBLE * (1 - bits / 64.0::DOUBLE) + 0.4::DOUBLE * (1 - bits / 64.0::DOUBLE), 0), 1)')} AS similarity, row_number() OVER (PARTITION BY query ORDER BY bits, candidate)::INTEGER AS rank FROM p QUALIFY rank <= 5""",
    "q_prefilter_top80": f"WITH {V.EMB}, {_PRE} SELECT query, owner, floor(sim * 100000 + 0.50001) / 100000.0::DOUBLE AS sim FROM pre",
    "q_geom_features": f"""WITH {V.VERTS}, b AS (SELECT layer, bulge = 0 AS straight, least(floor((CASE WHEN t < 0 THEN t + pi() WHEN t >= pi() THEN t - pi() ELSE t END) / (pi() / 8) + 1e-9)::INTEGER, 7) AS bin
  FROM (SELECT layer, bulge, atan2(by_ - ay, bx - ax) AS t FROM edge WHERE (closed OR NOT closing) AND (bx <> ax OR by_ <> ay)))
SELECT layer, count(*) AS n, count(*) FILTER (straight) AS n_line, count(*) FILTER (NOT straight) AS n_arc, """
    + ", ".join(f"round_even(count(*) FILTER (bin = {i}) * 1000.0::DOUBLE / count(*), 0)::INTEGER AS h{i}" for i in range(8))
    + " FROM b GROUP BY layer",
    "q_geom_similarity": f"WITH {V.FEATURES}, {_PAIRS} SELECT source, candidate, {r4('geometry')} AS geometry FROM gp",
    "q_rank_candidates": f"WITH {V.FEATURES}, {_PAIRS}, {_RANKED} SELECT source, candidate, score, rank FROM rc WHERE score >= 0.65",
    "q_fallback_rank": f"""WITH {V.FEATURES}, s AS (SELECT a.name AS source, b.name AS candidate, 0.6::DOUBLE * exp(-abs(ln((a.width / a.depth) / (b.width / b.depth)))) + 0.4::DOUBLE * exp(-abs(ln((a.width * a.depth) / (b.width * b.depth)))) AS size,
  1 - {_HB.format(a='a.name', b='b.name')} / 16.0::DOUBLE AS visual, {_NAMES} AS nm FROM ft a JOIN ft b ON a.name <> b.name),
t AS (SELECT source, candidate, {r4('size')} AS size, {r4('0.50::DOUBLE * visual + 0.30::DOUBLE * visual + 0.15::DOUBLE * size + 0.05::DOUBLE * nm')} AS score FROM s WHERE size >= 0.25)
SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, candidate)::INTEGER AS rank FROM t QUALIFY rank <= 5""",
    "q_edit_plan": f"""WITH {V.FEATURES}, {_PAIRS}, {_RANKED}, {V.INSERTS}, p AS (SELECT ent_ord, candidate, {r4('x + aw / 2 - bw / 2')} AS x, {r4('y + ad / 2 - bd / 2')} AS y FROM ins JOIN rc ON colour = source AND rank = 1 AND score >= 0.65)
SELECT 'insert' AS op, ent_ord AS target, candidate AS block, x, y FROM p UNION ALL SELECT 'erase', ent_ord, NULL, NULL, NULL FROM p""",
    "q_composite_top5": f"WITH {V.EMB}, {_PRE}, {V.HASHES}, {_IMG}, {_TOP5} SELECT * FROM t5",
    "q_composite_with_fallback": f"""WITH {V.EMB}, {_PRE}, {V.HASHES}, {_IMG}, g AS (SELECT *, 'gated' AS scorer FROM cs WHERE aspect <= 0.30 AND bits <= 20), both_ AS (SELECT * FROM g UNION ALL SELECT *, 'fallback' FROM cs WHERE query NOT IN (SELECT query FROM g))
SELECT query, candidate, score, scorer, row_number() OVER (PARTITION BY query ORDER BY score, candidate)::INTEGER AS rank FROM both_ QUALIFY rank <= 5""",
    "q_match_map_json": f"""WITH {V.EMB}, {_PRE}, {V.HASHES}, {_IMG}, {_TOP5}
SELECT 'H' || query::VARCHAR AS key, '[' || string_agg('{{"master_block":"' || candidate::VARCHAR || '","rank":' || rank::VARCHAR || '}}', ',' ORDER BY rank) || ']' AS topk, min(score) AS best FROM t5 GROUP BY query""",
    "q_circular_corr": """WITH e AS (SELECT vec_id, k, embedding[k]::DOUBLE AS x FROM embeddings, range(1, 65) t(k)),
z AS (SELECT vec_id, k, (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-9) AS x FROM e WINDOW w AS (PARTITION BY vec_id)),
c AS (SELECT a.vec_id, s.k AS turn, sum(a.x * b.x) / 64 AS r FROM z a JOIN z b ON b.vec_id = a.vec_id + 1 JOIN range(0, 64) s(k) ON (a.k - 1 + s.k) % 64 = b.k - 1 GROUP BY a.vec_id, s.k)
SELECT vec_id, floor(max(r) * 100000 + 0.50001) / 100000.0::DOUBLE AS best FROM c GROUP BY vec_id""",
    "q_ncc": """WITH e AS (SELECT vec_id, k, embedding[k]::DOUBLE AS x FROM embeddings, range(1, 65) t(k)),
z AS (SELECT vec_id, k, (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 1e-9) AS x FROM e WINDOW w AS (PARTITION BY vec_id))
SELECT a.vec_id, floor(sum(a.x * b.x) / 64 * 100000 + 0.50001) / 100000.0::DOUBLE AS ncc FROM z a JOIN z b ON b.vec_id = a.vec_id + 1 AND a.k = b.k GROUP BY a.vec_id""",
}
SQL["q_hash_topk_by_bands"] = SQL["q_hash_topk"]

SQL["q_edit_poses"] = f"""WITH {V.INSERTS}, i AS (SELECT *, ent_ord[1:12]::BIGINT AS n FROM ins),
p AS (SELECT *, radians((n % 360)::DOUBLE) AS a, radians((n % 360 + n % 24 * 15)::DOUBLE) AS b, length / 2 * (1 + n % 3) AS ox, width / 2 * CASE WHEN n % 2 = 0 THEN -1 ELSE 1 END AS oy, width / 2 * (1 + n % 3) AS nx, length / 3 * CASE WHEN n % 2 = 0 THEN -1 ELSE 1 END AS ny FROM i)
SELECT ent_ord, {r4('x + (cos(a) * ox - sin(a) * oy) - (cos(b) * nx - sin(b) * ny)')} AS x, {r4('y + (sin(a) * ox + cos(a) * oy) - (sin(b) * nx + cos(b) * ny)')} AS y, (n % 360 + n % 24 * 15)::DOUBLE AS rotation FROM p"""
