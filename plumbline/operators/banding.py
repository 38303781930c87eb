"""Bands of rows: gaps and islands over an ordered column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, value: Column, order: list[str], within: list[str]) -> DataFrame:
    """rows with `band`, a number that changes where the value does, in each partition of `within`."""
    w = Window.partitionBy(*within).orderBy(*order)
    before = F.lag("_v").over(w)
    changed = F.when(before.isNull() | (before != F.col("_v")), 1).otherwise(0)
    return rows.withColumn("_v", value).withColumn("_c", changed).withColumn("band", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def strict_bands(rows: DataFrame, value: Column, order: list[str], within: list[str], row: str) -> DataFrame:
    """Runs of one value, blanks left out: (within, value, first, last, rows)."""
    marked = islands(rows, F.coalesce(value, F.lit("")), order, within).where("_v <> ''")
    return marked.groupBy(*within, "band", F.col("_v").alias("value")).agg(F.min(row).alias("first"), F.max(row).alias("last"), F.count(F.lit(1)).alias("rows"))


def filled_bands(rows: DataFrame, value: Column, order: list[str], within: list[str], row: str) -> DataFrame:
    """As strict_bands(), with blanks continuing the band above; leading blanks belong to none."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    full = rows.withColumn("_f", F.last(F.nullif(value, F.lit("")), ignorenulls=True).over(w))
    return strict_bands(full.where("_f IS NOT NULL"), F.col("_f"), order, within, row)


def anchor(first: Column, last: Column, at: str) -> Column:
    """The row of a band that holds its label."""
    return {"first": first, "middle": F.floor((first + last) / 2).cast("bigint"), "last": last}[at]
