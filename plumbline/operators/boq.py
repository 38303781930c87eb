"""Bill of quantities: aggregated inserts, layer totals, colours, sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import kept


def upper_median(c: str) -> Column:
    """Element n // 2 of the sorted values; expects groups that fit a row, as a block's inserts in a drawing do."""
    values = F.array_sort(F.collect_list(c))
    return F.element_at(values, F.floor(F.size(values) / 2).cast("int") + 1)


def order_statistics(rows: DataFrame, keys: list[str], asked: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """(keys, one column for each name asked): exact order statistics of each group, however many values it has.

    asked has for each name a numeric column and a function from the number of its
    values in the group, nulls aside, to the place wanted, from 0. Null keys are a group
    of their own; groups without any value have no row. Values are counted, sorted over
    all tasks by ranges and stored; the counts of a group's ranges tell the range that
    holds a place, and only that range is walked. So a group of any size is spread over
    as many tasks as it fills ranges, and no row holds a group's values.
    """
    columns = sorted({c for c, _ in asked.values()})
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns)))
    group = [*(f"_k{i}" for i in range(len(keys))), "_c"]
    melted = rows.select(*(F.col(k).alias(g) for k, g in zip(keys, group)), each.alias("_m")).select(*group[:-1], F.col("_m.c").alias("_c"), F.col("_m.v").alias("_v")).where("_v IS NOT NULL")
    counted = melted.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranges = kept(counted.repartitionByRange(*group, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy(*group, "_part").agg(F.sum("_n").alias("_size"))
    own = Window.partitionBy(*group)
    so_far = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumns({"_upto": F.sum("_size").over(so_far), "_total": F.sum("_size").over(own)})
    wanted = F.filter(F.array(*(F.struct(F.lit(name).alias("name"), F.when(F.col("_c") == c, place(F.col("_total"))).cast("long").alias("at")) for name, (c, place) in asked.items())), lambda w: (w["at"] < F.col("_upto")) & (w["at"] >= F.col("_upto") - F.col("_size")))
    picks = sizes.select(*(F.col(g).alias(f"{g}_") for g in group), F.col("_part").alias("_part_"), (F.col("_upto") - F.col("_size")).alias("_before"), F.explode(wanted).alias("_w"))
    same = F.col("_part") == F.col("_part_")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
    walk = Window.partitionBy(*group, "_part", "_w.name").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranges.join(picks, same).withColumn("_run", F.col("_before") + F.sum("_n").over(walk)).where("_run > _w.at AND _run - _n <= _w.at")
    return found.groupBy(*group[:-1]).agg(*(F.max(F.when(F.col("_w.name") == name, F.col("_v"))).alias(name) for name in asked)).withColumnsRenamed(dict(zip(group, keys)))


def upper_medians(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, values): the upper median of each column, element n // 2 of its sorted values; nulls don't count."""
    return order_statistics(rows, keys, {c: (c, lambda n: F.floor(n / 2)) for c in values})


def aggregate_inserts(inserts: DataFrame, zoned: bool = True) -> DataFrame:
    """Count, upper medians of the sizes, and the first layer, by block and zone.

    inserts has (ent_ord, block_name, layer, length, width, zone); a null zone is its
    own group. The sizes' medians are independent of each other.
    """
    keyed = inserts.withColumn("zone", F.coalesce(F.col("zone"), F.lit(""))) if zoned else inserts.withColumn("zone", F.col("layer"))
    counted = keyed.groupBy("block_name", "zone").agg(F.count(F.lit(1)).alias("qty"), F.min(F.struct("ent_ord", "layer"))["layer"].alias("layer"))
    return counted.join(upper_medians(keyed, ["block_name", "zone"], ["length", "width"]), ["block_name", "zone"])


def layer_metrics(rings: DataFrame) -> DataFrame:
    """Open length, closed perimeter and area by layer, positive values alone, in one grouping."""
    measured = rings.select("layer", "closed", G.path_length(F.col("verts"), F.col("closed")).alias("len"), G.ring_area(F.col("verts")).alias("area"))
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond & (F.col(c) > 0), G.rounded(F.col(c)))), F.lit(0.0))
    closed = F.col("closed")
    return measured.groupBy("layer").agg(
        G.rounded(total("len", ~closed)).alias("length"), G.rounded(total("len", closed)).alias("perimeter"), G.rounded(total("area", closed)).alias("area"), F.count_if(~closed).alias("n_open"), F.count_if(closed).alias("n_closed")
    )


def layer_rows(metrics: DataFrame, mode: str = "split") -> DataFrame:
    """Summary rows by layer: an open and a closed one, or a combined one."""
    if mode == "combined":
        return metrics.select("layer", F.lit("COMBINED").alias("kind"), F.expr("length + perimeter").alias("length"), "area")
    one = metrics.where("n_open > 0").select("layer", F.lit("OPEN").alias("kind"), "length", F.lit(0.0).alias("area"))
    return one.unionByName(metrics.where("n_closed > 0").select("layer", F.lit("CLOSED").alias("kind"), F.col("perimeter").alias("length"), "area"))


def dominant(rows: DataFrame, key: str, value: str, weight: str, order: str) -> DataFrame:
    """The value with the largest total weight by key; of equal ones the first seen. Weights of 0 or less count 1.

    The totals are used once: their last bits hang on the order in which a shuffle
    delivers, so a second computation may not equal the first.
    """
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(F.lit(1.0))
    totals = rows.groupBy(key, value).agg(F.sum(w).alias("_w"), F.min(order).alias("_first"))
    best = totals.groupBy(key).agg(F.min(F.struct((~F.isnan("_w")).alias("number"), (-F.col("_w")).alias("less"), "_first", F.col(value).alias("value"))).alias("_best"))
    return best.select(key, F.col("_best.value").alias(value), (-F.col("_best.less")).alias("weight"))


def boq_order(*after_zone: Column) -> list[Column]:
    """The report's order: category, zone, what else is given, inserts before summaries, name."""
    return [F.upper(F.trim(F.regexp_replace("category", r"\s+", " "))), F.lower("zone"), *after_zone, F.when(F.col("entity_type") == "INSERT", 0).otherwise(1), F.col("boq_name")]


def earlier_order() -> list[Column]:
    """The order of earlier reports: category, inserts before summaries, name."""
    category, _, kind, name = boq_order()
    return [category, kind, name]


def sheet_order(rows: DataFrame, primary: int, *others: int) -> list[Column]:
    """A sheet's sort by its columns' numbers from 1; numbers below that are passed over."""
    return [F.col(rows.columns[n - 1]) for n in (primary, *others) if n >= 1]
