"""Tiered lookups: conditions tried in order, the first tier with a hit wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S

#: Prefix and contains joins meet on so many characters.
BLOCK = 8


def _pieces(text: Column, n: int, inner: bool) -> Column:
    """The distinct pieces of a text of 1 to n characters: its prefixes, or all inside it."""
    sizes = F.sequence(F.lit(1), F.least(F.length(text), F.lit(n)))
    of = (lambda k: F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda a: F.substring(text, a, k))) if inner else (lambda k: F.array(F.substring(text, F.lit(1), k)))
    return F.when(F.length(text) > 0, F.array_distinct(F.flatten(F.transform(sizes, of))))


def part_join(items: DataFrame, rows: DataFrame, left: Column, right: Column, inner: bool = False) -> DataFrame:
    """Pairs where the rows' text begins with the items' text, or with `inner` holds it; empty texts meet none.

    Texts meet on a block of the items' first characters, which the rows' text must
    begin with or hold, and the whole text is compared afterwards.
    """
    n = 4 if inner else BLOCK
    a = items.withColumn("_l", left).where(F.length("_l") > 0).withColumn("_k", F.substring("_l", 1, n))
    b = rows.withColumn("_r", right).withColumn("_k", F.explode(_pieces(F.col("_r"), n, inner)))
    return a.join(b, "_k").where(F.contains("_r", "_l") if inner else F.startswith("_r", "_l")).drop("_k", "_l", "_r")


def tiered_join(items: DataFrame, rows: DataFrame, key: str, tiers: list[tuple[Column, Column]], prefix: tuple[Column, Column] | None = None) -> DataFrame:
    """items with the columns of the rows found and `tier`, from 1.

    Each tier is a pair of expressions, over items and over rows, that must be equal
    and not null; in a last tier, `prefix`, the rows' text begins with the items'. Items keep all rows of their first tier with a hit; items without
    one are left out. Column names of the two sides must differ.
    """
    found = None
    for n, (left, right) in enumerate(tiers, 1):
        one = items.withColumn("_k", left).join(rows.withColumn("_k", right), "_k").drop("_k").withColumn("tier", F.lit(n))
        found = one if found is None else found.unionByName(one)
    if prefix:
        found = found.unionByName(part_join(items, rows, *prefix).withColumn("tier", F.lit(len(tiers) + 1)))
    best = found.groupBy(key).agg(F.min("tier").alias("tier"))
    return found.join(best, [key, "tier"])


def preview_files(items: DataFrame, files: DataFrame, key: str, name: str) -> DataFrame:
    """(key, path, tier): each name's preview, the first path of its first tier with a hit.

    files has (path, stem, cluster); stems are file names without an extension. In
    order: instance stems that begin with the safe name and two underscores, or hold
    the name's token; cluster stems that begin with the safe name and __cluster, hold
    the token, or hold it when underscores are left out of both. Case plays no part.
    Names without a hit are left out.
    """
    safe, stem = F.lower(S.safe_chars(F.col(name))), F.lower("stem")
    token = S.token(S.safe_chars(F.col(name)))
    one, many = files.where("NOT cluster"), files.where("cluster")
    tiers = [
        part_join(items, one, F.concat(safe, F.lit("__")), stem),
        part_join(items, one, token, stem, inner=True),
        part_join(items, many, F.concat(safe, F.lit("__cluster")), stem),
        part_join(items, many, token, stem, inner=True),
        part_join(items, many, F.replace(token, F.lit("_"), F.lit("")), S.token(F.col("stem"), False), inner=True),
    ]
    found = None
    for n, tier in enumerate(tiers, 1):
        one = tier.select(key, F.struct(F.lit(n).alias("tier"), "path").alias("_f"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy(key).agg(F.min("_f").alias("_f")).select(key, "_f.path", "_f.tier")


def coalesced_lookup(items: DataFrame, first: DataFrame, second: DataFrame, on_first: str, on_second: str, value: str) -> DataFrame:
    """items with a value from one map, else from another: by handle, else by name."""
    one = first.select(on_first, F.col(value).alias("_one"))
    two = second.select(on_second, F.col(value).alias("_two"))
    return items.join(one, on_first, "left").join(two, on_second, "left").withColumn(value, F.coalesce("_one", "_two")).drop("_one", "_two")


def bucket_table(matches: DataFrame, query: str, candidate: str) -> DataFrame:
    """Which folder each work item and its best candidate go to: accepted, or review."""
    best = matches.where("rank = 1")
    folder = F.concat_ws("/", F.when(F.col("accepted"), F.lit("accepted")).otherwise(F.lit("review")), F.col(query).cast("string"))
    return best.select(folder.alias("folder"), query, candidate, "score")


def nearest_k(queries: DataFrame, others: DataFrame, query: str, other: str, bits: Column, k: int = 2) -> DataFrame:
    """The k nearest descriptors of each stated query by differing bits, then by name."""
    from .matching import top_k

    pairs = others.crossJoin(queries).withColumn("bits", bits)
    return top_k(pairs, query, [F.col("bits"), F.col(other)], k).select(query, other, "bits", "rank")


def ratio_matches(nearest: DataFrame, query: str, ratio: float = 0.75) -> DataFrame:
    """Queries whose nearest descriptor is clearly nearer than the second."""
    g = nearest.groupBy(query).agg(F.min(F.when(F.col("rank") == 1, F.col("bits"))).alias("a"), F.min(F.when(F.col("rank") == 2, F.col("bits"))).alias("b"))
    return g.where(F.col("b").isNull() | (F.col("a") < ratio * F.col("b"))).select(query)


def without_layer(entities: DataFrame, layer: str) -> DataFrame:
    """Everything but one layer's entities: how markers are removed."""
    return entities.where(F.lower(F.coalesce("layer", F.lit(""))) != layer.lower())


def keep_best(matches: DataFrame, key: str, score: str) -> DataFrame:
    """One row for each key, that with the lowest score."""
    rest = [c for c in matches.columns if c not in (key, score)]
    best = matches.groupBy(key).agg(F.min(F.struct(score, *rest)).alias("_b"))
    return best.select(key, *(F.col(f"_b.{c}").alias(c) for c in (score, *rest)))


def merged_attributes(inserts: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tag, value): what a new insert of its definition has for each of the definition's tags.

    inserts has (keys, definition, attribs), a map of tags to values; tags has
    (definition, tag, default, constant), each tag once. A tag takes the old value of
    that name, whatever its case, unless that is blank or the tag is constant; else the
    default. Of old tags that differ in case alone, the last in order of their names
    counts. Old tags that the definition lacks are dropped; an insert whose definition
    has no tags gives no row.
    """
    old = F.array_sort(F.map_entries("attribs"))
    found = F.filter(old, lambda a: F.upper(a["key"]) == F.upper(F.col("tag")))
    value = F.nullif(F.try_element_at(found, F.lit(-1))["value"], F.lit(""))
    joined = inserts.join(tags, "definition")
    return joined.select(*keys, "tag", F.when(F.col("constant"), F.col("default")).otherwise(F.coalesce(value, "default")).alias("value"))
