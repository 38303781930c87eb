"""Queries that shape sheets: bands, names, keys, JSON, attribute merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import strings as S
from ..operators import selection as E
from ..operators.banding import anchor, filled_bands, islands, strict_bands
from ..operators.lookups import merged_attributes
from ..session import table
from . import views as V


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sheet rows: a sheet for each user, rows in time order."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return e.withColumn("row_ord", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))


_EV = "ev AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_ord FROM events)"


def _bands(b: DataFrame) -> DataFrame:
    first, last = F.col("first"), F.col("last")
    return b.select("user_id", "value", "first", "last", "rows", anchor(first, last, "middle").alias("middle"))


def q_band_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type."""
    return _bands(strict_bands(_events(spark, sf_dir), F.col("event_type"), ["row_ord"], ["user_id"], "row_ord"))


def q_band_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every third event's type blank, continuing the band above."""
    value = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.col("event_type"))
    return _bands(filled_bands(_events(spark, sf_dir).withColumn("label", value), F.col("label"), ["row_ord"], ["user_id"], "row_ord"))


def q_band_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a type inside runs of a day."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.to_date("ts").alias("day"))
    e = e.withColumn("row_ord", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    pair = F.concat_ws("/", F.date_format("day", "yyyy-MM-dd"), F.col("event_type"))
    marked = islands(e, pair, ["row_ord"], ["user_id"])
    return marked.groupBy("user_id", "band", F.col("_v").alias("value")).agg(F.min("row_ord").alias("first"), F.max("row_ord").alias("last")).select("user_id", "value", "first", "last")


def q_misc_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones with blanks as misc, which comes last."""
    s = V.sheet(spark, sf_dir).withColumn("zone", S.or_misc(F.col("zone")))
    g = s.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    key = F.when(F.col("zone") == "misc", F.lit("1")).otherwise(F.lit("0"))
    return g.select(F.concat(key, F.lit(":"), F.lower("zone")).alias("sort_key"), "zone", "n", "chars").orderBy("sort_key")


def q_norm_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), F.col("p_name"), F.lit(" / "), F.col("p_brand"), F.lit("__"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")).alias("s"))
    s = F.col("s")
    return p.select(
        "p_partkey", S.or_misc(s).alias("misc"), S.category(s).alias("category"), S.header(s).alias("header"), S.key(s).alias("key"), S.base_key(s).alias("base"),
        S.safe_chars(s).alias("safe"), S.safe_runs(s).alias("runs"), S.without_index(s).alias("stem"), S.comparable(s).alias("comparable"), S.token(s).alias("token"), S.shortened(s, 12).alias("short"), S.file_name(s).alias("file"),
    )


def q_handle_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("B"), F.hex("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("_H"), F.lpad(F.hex("c_custkey"), 5, "0"))).otherwise(F.lit("__1000"))).alias("name"))
    h = S.handle(F.col("name"))
    return c.select("c_custkey", "name", h.alias("handle"), S.handle_number(h).alias("number"), S.handle_key(F.col("name")).alias("key"))


def q_name_match_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to sheet rows by name: equal keys, else equal base keys, else a prefix either way of eight characters or more.

    The prefix tier meets on the keys' first eight characters, which both must share.
    """
    rows = table(spark, sf_dir, "part").select("p_name").distinct().select(F.col("p_name").alias("row_name"), S.key(F.col("p_name")).alias("k"), S.base_key(F.col("p_name")).alias("b"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("__"), F.col("p_partkey").cast("string"))).otherwise(F.concat("p_name", F.lit(" extra"))).alias("item_name"))
    items = names.select("item", S.key(F.col("item_name")).alias("ik"), S.base_key(F.col("item_name")).alias("ib"))
    exact = items.join(rows, F.col("ik") == F.col("k")).select("item", "row_name", F.lit(1).alias("tier"))
    base = items.join(rows, F.col("ib") == F.col("b")).select("item", "row_name", F.lit(2).alias("tier"))
    prefix = items.join(rows, F.substring("ik", 1, 8) == F.substring("k", 1, 8)).where(S.prefix_either(F.col("ik"), F.col("k"))).select("item", "row_name", F.lit(3).alias("tier"))
    every = exact.unionByName(base).unionByName(prefix)
    best = every.groupBy("item").agg(F.min("tier").alias("tier"))
    return every.join(best, ["item", "tier"]).select("item", "row_name", "tier")


def q_name_similarity_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of the catalogue's names (64 of them, whatever the size) the five most alike."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    heads = names.select(F.col("p_name").alias("name"))
    pairs = heads.join(names.select(F.col("p_name").alias("other")), F.col("name") != F.col("other"))
    scored = pairs.withColumn("similarity", S.name_similarity(F.col("name"), F.col("other")))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("similarity"), "other"))
    return scored.withColumn("rank", rank.cast("int")).where("rank <= 5").select("name", "other", "similarity", "rank")


def q_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "struct<k: long>").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("largest"))


def q_attr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of old inserts onto new definitions: by tag ignoring case, blanks take the definition's default, constants stay the definition's."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("D"), F.col("user_id") % 5).alias("definition"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("Kind"), F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.col("event_type")), F.lit("Maker"), F.lit("any")).alias("attribs"))
    # Each definition has tags of its own: a row each, with its default and whether it is constant.
    one = lambda tag, default, constant: F.struct(F.lit(tag).alias("tag"), default.alias("default"), F.lit(constant).alias("constant"))
    known = e.select("definition").distinct().where("definition <> 'D4'")
    tags = known.select("definition", F.explode(F.array(one("K", F.lit("0"), False), one("KIND", F.concat(F.lit("none of "), "definition"), False), one("MAKER", F.col("definition"), True), one("FINISH", F.lit("matt"), False))).alias("t")).select("definition", "t.*")
    return merged_attributes(e, tags, ["event_id"])


def q_round_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as circles of 64 points and as arcs of 33, which run backwards where they end before their start."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("r"), (F.col("p_partkey") % 7).cast("double").alias("a"), (F.col("p_partkey") % 5).cast("double").alias("b"))
    zero = F.lit(0.0)
    both = p.select("p_partkey", F.explode(F.array(F.struct(F.lit("circle").alias("kind"), G.circle_samples(zero, zero, F.col("r")).alias("v")), F.struct(F.lit("arc").alias("kind"), G.arc_samples(zero, zero, F.col("r"), F.col("a"), F.col("b")).alias("v")))).alias("s"))
    points = both.select("p_partkey", "s.kind", F.posexplode("s.v").alias("i", "p"))
    return points.select("p_partkey", "kind", "i", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


# Types that stand for line numbers, from 1, in q_entity_filters.
_TYPES = ["LINE", "TEXT", "HATCH", "DIMENSION", "ARC", "INSERT", "LEADER"]


def q_entity_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by type: drawn ones, ones that give features, and selected ones."""
    e = table(spark, sf_dir, "lineitem").select(F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("l_linenumber") % 7 + 1).cast("int")).alias("etype"), F.when(F.col("l_returnflag") == "R", F.lit("DIM")).otherwise(F.lit("WALL")).alias("layer"))
    parts = [("drawn", E.drawn(e)), ("featured", E.featured(e)), ("selected", E.selected(e, ["LINE", "ARC"]))]
    out = None
    for name, df in parts:
        one = df.groupBy("etype").agg(F.count(F.lit(1)).alias("n")).withColumn("filter", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = [q_band_strict, q_band_fill, q_band_nested, q_misc_last, q_norm_strings, q_handle_extract, q_name_match_tiered, q_name_similarity_top5, q_props_json, q_attr_merge, q_round_samples, q_entity_filters]


def _band_sql(source: str, value: str) -> str:
    return f"""WITH {_EV}, src AS ({source}),
c AS (SELECT *, CASE WHEN lag({value}) OVER w IS DISTINCT FROM {value} THEN 1 ELSE 0 END AS ch FROM src WINDOW w AS (PARTITION BY user_id ORDER BY row_ord)),
b AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY row_ord) AS band FROM c)
SELECT user_id, {value} AS value, min(row_ord) AS first, max(row_ord) AS last, count(*) AS rows, (min(row_ord) + max(row_ord)) // 2 AS middle FROM b WHERE {value} <> '' GROUP BY user_id, band, {value}"""


_FORBIDDEN = "[<>:\"/\\\\|?*]"
# Three places, without a negative zero.
_THREE = lambda x: f"CASE WHEN abs({x}) < 0.0005 THEN 0.0::DOUBLE ELSE round({x}, 3) END"

SQL = {
    "q_band_strict": _band_sql("SELECT *, event_type AS label FROM ev", "label"),
    "q_band_fill": _band_sql("SELECT * FROM (SELECT user_id, row_ord, last_value(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY row_ord) AS label FROM ev) WHERE label IS NOT NULL", "label"),
    "q_band_nested": """WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') || '/' || event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_ord FROM events),
c AS (SELECT *, CASE WHEN lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS ch FROM e WINDOW w AS (PARTITION BY user_id ORDER BY row_ord)),
b AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY row_ord) AS band FROM c)
SELECT user_id, label AS value, min(row_ord) AS first, max(row_ord) AS last FROM b GROUP BY user_id, band, label""",
    "q_misc_last": f"""WITH {V.SHEET}, z AS (SELECT coalesce(nullif(trim(zone), ''), 'misc') AS zone, n_chars FROM sh)
SELECT CASE WHEN zone = 'misc' THEN '1' ELSE '0' END || ':' || lower(zone) AS sort_key, zone, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM z GROUP BY zone""",
    "q_norm_strings": f"""WITH s AS (SELECT p_partkey, '  ' || p_name || ' / ' || p_brand || '__' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS s FROM part)
SELECT p_partkey, trim(s) AS misc, upper(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS category, lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS header,
  regexp_replace(lower(s), '[^a-z0-9]', '', 'g') AS key, regexp_replace(regexp_replace(lower(s), '[^a-z0-9]', '', 'g'), '[0-9]+$', '') AS base,
  trim(regexp_replace(s, '{_FORBIDDEN}', '_', 'g')) AS safe, regexp_replace(s, '{_FORBIDDEN}+', '_', 'g') AS runs, regexp_replace(s, '__[0-9]{{2,}}$', '') AS stem,
  lower(replace(regexp_replace(regexp_replace(s, '__[0-9]{{2,}}$', ''), '{_FORBIDDEN}+', '_', 'g'), ' ', '_')) AS comparable,
  lower(regexp_replace(s, '[<>:"/\\\\|?* ]', '_', 'g')) AS token, s[1:12] AS short, regexp_replace(s, '[^0-9A-Za-z_]+', '_', 'g')[1:120] AS file FROM s""",
    "q_handle_extract": """WITH c AS (SELECT c_custkey, 'B' || to_hex(c_custkey) || CASE WHEN c_custkey % 2 = 0 THEN '_H' || lpad(to_hex(c_custkey), 5, '0') ELSE '__1000' END AS name FROM customer),
h AS (SELECT *, upper(coalesce(nullif(regexp_extract(name, '(?i)H([0-9A-F]{4,})', 1), ''), nullif(regexp_extract(name, '(?i)([0-9A-F]{4,})$', 1), ''))) AS handle FROM c)
SELECT c_custkey, name, handle, CASE WHEN regexp_matches(handle, '^[0-9A-Fa-f]{1,15}$') THEN ('0x' || handle)::BIGINT ELSE 9223372036854775807 END AS number, regexp_replace(upper(name), '^H', '') AS key FROM h""",
    "q_name_match_tiered": """WITH r AS (SELECT DISTINCT p_name AS row_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part),
r2 AS (SELECT *, regexp_replace(k, '[0-9]+$', '') AS b FROM r),
i AS (SELECT p_partkey AS item, regexp_replace(lower(CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || '__' || p_partkey::VARCHAR ELSE p_name || ' extra' END), '[^a-z0-9]', '', 'g') AS ik FROM part),
i2 AS (SELECT *, regexp_replace(ik, '[0-9]+$', '') AS ib FROM i),
every AS (SELECT item, row_name, 1 AS tier FROM i2 JOIN r2 ON ik = k UNION ALL SELECT item, row_name, 2 FROM i2 JOIN r2 ON ib = b
  UNION ALL SELECT item, row_name, 3 FROM i2 JOIN r2 ON length(ik) >= 8 AND length(k) >= 8 AND (starts_with(ik, k) OR starts_with(k, ik)))
SELECT item, row_name, tier FROM every QUALIFY tier = min(tier) OVER (PARTITION BY item)""",
    "q_name_similarity_top5": """WITH n AS (SELECT DISTINCT p_name AS name FROM part),
p AS (SELECT a.name, b.name AS other, CASE WHEN lower(a.name) = lower(b.name) THEN 100 ELSE 0 END + CASE WHEN contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name)) THEN 50 ELSE 0 END
  + len(list_intersect(list_distinct(string_split(lower(a.name), '')), list_distinct(string_split(lower(b.name), '')))) AS points FROM n a JOIN n b ON a.name <> b.name),
s AS (SELECT name, other, least(greatest(points / 200.0::DOUBLE, 0), 1) AS similarity FROM p)
SELECT name, other, similarity, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, other)::INTEGER AS rank FROM s QUALIFY rank <= 5""",
    "q_props_json": "SELECT event_type, count(CAST(props->>'k' AS BIGINT)) AS n, sum(CAST(props->>'k' AS BIGINT))::BIGINT AS total, max(CAST(props->>'k' AS BIGINT)) AS largest FROM events GROUP BY event_type",
    "q_attr_merge": """WITH e AS (SELECT event_id, 'D' || (user_id % 5) AS d, props->>'k' AS k, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS kind FROM events WHERE user_id % 5 <> 4)
SELECT event_id, 'K' AS tag, coalesce(nullif(k, ''), '0') AS value FROM e UNION ALL SELECT event_id, 'KIND', coalesce(nullif(kind, ''), 'none of ' || d) FROM e UNION ALL SELECT event_id, 'MAKER', d FROM e UNION ALL SELECT event_id, 'FINISH', 'matt' FROM e""",
    "q_round_samples": f"""SELECT p_partkey, kind, i, {_THREE("p_size * cos(t)")} AS x, {_THREE("p_size * sin(t)")} AS y FROM (
  SELECT p_partkey, p_size, 'circle' AS kind, i::INTEGER AS i, i * (2 * pi() / 64) AS t FROM part, range(64) c(i)
  UNION ALL SELECT p_partkey, p_size, 'arc', i::INTEGER, p_partkey % 7 + (p_partkey % 5 - p_partkey % 7) * (i / 32.0::DOUBLE) FROM part, range(33) a(i))""",
    "q_entity_filters": f"""WITH e AS (SELECT ({_TYPES!r})[l_linenumber % 7 + 1] AS etype, CASE WHEN l_returnflag = 'R' THEN 'DIM' ELSE 'WALL' END AS layer FROM lineitem)
SELECT etype, count(*) AS n, 'drawn' AS filter FROM e WHERE etype NOT IN ('TEXT', 'MTEXT', 'DIMENSION') AND layer <> 'DIM' GROUP BY etype
UNION ALL SELECT etype, count(*), 'featured' FROM e WHERE etype NOT IN ('TEXT', 'HATCH', 'DIMENSION', 'LEADER') GROUP BY etype
UNION ALL SELECT etype, count(*), 'selected' FROM e WHERE etype IN ('LINE', 'ARC') GROUP BY etype""",
}
