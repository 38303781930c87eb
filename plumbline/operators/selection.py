"""Which entities and block definitions take part in a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Layers and types that are not drawn, and types that give no features.
SKIP_LAYERS = ["DEFPOINTS", "DIM", "DIMENSIONS", "ANNOTATION", "TEXT", "NOTES"]
SKIP_TYPES = ["TEXT", "MTEXT", "DIMENSION"]
NO_FEATURES = ["TEXT", "MTEXT", "HATCH", "DIMENSION", "LEADER", "MULTILEADER"]


def selected(entities: DataFrame, kinds: list[str], chosen: DataFrame | None = None, key: str = "ent_id") -> DataFrame:
    """Entities of these types; with a table of chosen keys, only those in it."""
    out = entities.where(F.col("etype").isin(kinds))
    return out if chosen is None else out.join(chosen.select(key), key, "left_semi")


def drawn(entities: DataFrame) -> DataFrame:
    """Without annotation layers and types; a null layer or type is drawn."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return entities.where(~text("layer").isin(SKIP_LAYERS) & ~text("etype").isin(SKIP_TYPES))


def featured(entities: DataFrame) -> DataFrame:
    """Entities that give features; a null type does."""
    return entities.where(~F.coalesce("etype", F.lit("")).isin(NO_FEATURES))


def named_blocks(definitions: DataFrame, name: str = "block") -> DataFrame:
    """Block definitions that a user named: anonymous and layout blocks begin with an asterisk."""
    return definitions.where(F.col(name).isNotNull() & ~F.startswith(F.col(name), F.lit("*")))


def on_layer(entities: DataFrame, layer: str, kinds: list[str] | None = None) -> DataFrame:
    """Entities on a layer, whatever the case of its name; with a list of types, only those."""
    out = entities.where(F.lower("layer") == layer.lower())
    return out if kinds is None else out.where(F.col("etype").isin(kinds))


def by_block(chosen: DataFrame, name: str = "name", key: str = "ent_id") -> DataFrame:
    """(name, ids) of chosen inserts: the ids of each block in order. What is chosen by hand fits a row."""
    return chosen.where(F.col(name).isNotNull()).groupBy(name).agg(F.sort_array(F.collect_list(key)).alias("ids"))
