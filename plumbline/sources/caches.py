"""Snapshots that are loaded or built: catalogue indexes, embeddings, maps, settings.

A snapshot is keyed by its input's content, so a changed input is built anew.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept


def content_key(rows: DataFrame, **settings) -> str:
    """A digest of a table's rows, whatever their order, and of settings."""
    line = F.xxhash64(F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns)))))
    state = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(line.cast("decimal(38,0)")).alias("s"), F.bit_xor(line).alias("x")).first()
    return hashlib.md5(json.dumps([str(state["n"]), str(state["s"]), str(state["x"]), sorted(settings.items())], default=str).encode()).hexdigest()


def load_or_build(spark: SparkSession, folder: str, source: DataFrame, build: Callable[[DataFrame], DataFrame], **settings) -> DataFrame:
    """The snapshot of build(source) below folder, written if it isn't there."""
    path = f"{folder.rstrip('/')}/{content_key(source, **settings)}"
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    build(source).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def json_map(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """(key, value): a file that is one JSON object of entries of the given type; keys in upper case without a leading H."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("key", "value"))
    return parsed.select(F.regexp_replace(F.upper("key"), "^H", "").alias("key"), "value")


class WatchedMap:
    """A JSON map that is read anew when its file has changed, as its time and size tell: between the micro-batches of a stream, say.

    entries() costs one look at the file's status. A file that isn't there gives no
    entries, and neither does one that isn't a JSON object.
    """

    def __init__(self, spark: SparkSession, path: str, entry: str):
        self.spark, self.path, self.entry = spark, path, entry
        self.state: tuple | None = None
        self.loads = 0
        self._rows: DataFrame | None = None

    def _status(self) -> tuple | None:
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(self.path)
        store = where.getFileSystem(context._jsc.hadoopConfiguration())
        if not store.exists(where):
            return None
        status = store.getFileStatus(where)
        return status.getModificationTime(), status.getLen()

    def entries(self) -> DataFrame:
        """(key, value), as json_map() gives them; a key that comes twice once it is normalised keeps one value."""
        now = self._status()
        if self._rows is None or now != self.state:
            empty = self.spark.createDataFrame([], f"key string, value {self.entry}")
            rows = empty if now is None else json_map(self.spark, self.path, self.entry).dropDuplicates(["key"])
            self._rows, self.state, self.loads = kept(rows, "map"), now, self.loads + 1
        return self._rows


@dataclass(frozen=True)
class MatchSettings:
    """Weights and limits of ranking."""

    hash_weight: float = 0.7
    geometry_weight: float = 0.3
    p_weight: float = 0.6
    d_weight: float = 0.4
    max_candidates: int = 50
    min_score: float = 0.65
    extra: dict = field(default_factory=dict)


def settings(path: str | None = None, variable: str = "PLUMBLINE_SETTINGS") -> MatchSettings:
    """From a JSON file: the path given, else that of the environment variable, else MatchConfig.json beside the program; else the defaults."""
    beside = os.path.join(os.path.dirname(os.path.abspath(sys.argv[0] or ".")), "MatchConfig.json")
    path = path or os.environ.get(variable) or beside
    if not path or not os.path.exists(path):
        return MatchSettings()
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    names = {x.name for x in fields(MatchSettings)} - {"extra"}
    return MatchSettings(**{k: v for k, v in found.items() if k in names}, extra={k: v for k, v in found.items() if k not in names})
