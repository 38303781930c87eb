"""Sinks: typed CSV and JSON files, sheets that are replaced or appended to, and edit plans.

All write files through Spark. Nothing is sent over a network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the report, in order, by the names that readers know.
DETAIL = ["entity_type", "category", "zone", "category1", "boq_name", "qty_type", "qty_value", "length", "width", "perimeter", "area", "unit", "preview_hex", "remarks"]
BY_LAYER = ["category", "zone", "boq_name", "qty_type", "qty_value", "length", "width", "perimeter", "area", "unit", "preview_hex"]


def fixed_places(c: Column, places: int = 2) -> Column:
    """A number as text with fixed places, null as blank; places are held to 0..10."""
    return F.when(c.isNull() | F.isnan(c), F.lit("")).otherwise(F.format_string(f"%.{min(max(places, 0), 10)}f", c.cast("double")))


def report(rows: DataFrame, columns: list[str] = DETAIL, places: int = 2) -> DataFrame:
    """rows as a report's text columns; those that rows lacks are blank."""
    kinds = dict(rows.dtypes)
    text = lambda c: fixed_places(F.col(c), places) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(*((text(c) if c in kinds else F.lit("")).alias(c) for c in columns))


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """rows with the columns that readers know, by another name; names that rows lacks are passed over."""
    return rows.withColumnsRenamed({k: v for k, v in names.items() if k in rows.columns})


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite", mark: bool = False) -> None:
    """CSV files with a header; with `mark` each begins with a byte-order mark, as its header does."""
    if mark:
        rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    rows.write.mode(mode).option("header", True).option("encoding", "UTF-8").option("emptyValue", "").csv(path)


def write_sheet(rows: DataFrame, path: str, replace: bool = True) -> None:
    """Replace a sheet's data or append to it; no row is lost in either way."""
    rows.write.mode("overwrite" if replace else "append").parquet(path)


def write_json_map(rows: DataFrame, path: str, key: str, value: str) -> None:
    """A line of JSON for each key with its value."""
    rows.select(F.to_json(F.create_map(F.col(key), F.col(value))).alias("value")).write.mode("overwrite").text(path)


def split_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(detail rows, layer summary rows)."""
    layer = F.upper(F.coalesce("entity_type", F.lit(""))) == "LAYER"
    return rows.where(~layer), rows.where(layer)


def drop_columns(rows: DataFrame, *names: str) -> DataFrame:
    """Without these columns, found by their normalised names."""
    plain = lambda s: " ".join(s.lower().split())
    gone = {plain(n) for n in names}
    return rows.drop(*(c for c in rows.columns if plain(c) in gone))


def write_csv_by_drawing(rows: DataFrame, path: str, drawing: str = "drawing") -> None:
    """A folder of CSV for each drawing, file=<stem>_raw_extract; a large drawing may have several files."""
    stem = F.regexp_extract(drawing, r"([^/]*?)(\.[^./]*)?$", 1)
    rows.withColumn("file", F.concat(stem, F.lit("_raw_extract"))).write.mode("overwrite").partitionBy("file").option("header", True).csv(path)


def write_tabs(rows: DataFrame, path: str, replace: bool = True) -> None:
    """Two tabs: detail rows replace the first or are appended to it, layer rows overwrite the second."""
    detail, summary = split_classes(rows)
    write_sheet(detail, f"{path}/detail", replace)
    write_sheet(summary, f"{path}/summary")
