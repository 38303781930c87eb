"""Sinks that Spark lacks: one file for each name, and sheets sent in chunks, as Python data sources.

Each attempt of a task writes below a folder of its own. Only the attempts that Spark
commits are published, so a lost executor, a repeated or a speculative task leaves
every file and chunk once; an aborted job leaves nothing.

    register(spark)
    rows.write.format("plumbline_files").option("path", folder).mode("append").save()
    rows.write.format("plumbline_sheet").option("path", folder).mode("overwrite").save()
"""

from __future__ import annotations

import importlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship_package

# Rows of a chunk, tries for each, and the base of the seconds between tries.
CHUNK_ROWS, TRIES, BASE = 3000, 4, 2.0


def register(spark: SparkSession) -> None:
    ship_package(spark)
    for source in (FilesSink, SheetSink):
        spark.dataSource.register(source)


def _store(path: str):
    """(file system, path) of a URI or a plain path."""
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def _remove(path: str) -> None:
    from pyarrow import fs as arrow_fs

    fs, at = _store(path)
    if fs.get_file_info(at).type == arrow_fs.FileType.Directory:
        fs.delete_dir(at)


@dataclass
class Written(WriterCommitMessage):
    """What one attempt has left: its folder and, in order, the names in it."""

    folder: str
    names: list[str] = field(default_factory=list)


# ---------------------------------------------------------------- files
def _safe(name: str) -> str:
    """A name that stays below its folder."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".", "..")]
    return "/".join(parts) or "unnamed"


class FilesWriter(DataSourceWriter):
    """Rows of (file, content): neighbours of one name make one file, in their order."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{self.path}/_staging-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        fs, at = _store(folder)
        done, out, last = Written(folder), None, None
        try:
            for row in iterator:
                name, content = row["file"], row["content"]
                if name is None or content is None:
                    continue
                name = _safe(name)
                if name != last:
                    if out is not None:
                        out.close()
                    if name in done.names:
                        raise ValueError(f"rows of {name} aren't neighbours")
                    fs.create_dir(f"{at}/{name}".rpartition("/")[0], recursive=True)
                    out, last = fs.open_output_stream(f"{at}/{name}"), name
                    done.names.append(name)
                out.write(content.encode() if isinstance(content, str) else bytes(content))
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs as arrow_fs

        fs, at = _store(self.path)
        fs.create_dir(at, recursive=True)
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several tasks have rows of one file; deal rows by file before writing")
        if self.overwrite:
            for info in fs.get_file_info(arrow_fs.FileSelector(at)):
                if info.base_name != self.staging.rpartition("/")[2]:
                    (fs.delete_dir if info.type == arrow_fs.FileType.Directory else fs.delete_file)(info.path)
        for m in messages:
            for name in m.names if m else ():
                fs.create_dir(f"{at}/{name}".rpartition("/")[0], recursive=True)
                if fs.get_file_info(f"{at}/{name}").type == arrow_fs.FileType.File:
                    fs.delete_file(f"{at}/{name}")
                fs.move(f"{_store(m.folder)[1]}/{name}", f"{at}/{name}")
        _remove(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        _remove(self.staging)


class FilesSink(DataSource):
    """One file for each name, from rows of (file string, content binary or string); rows without either are passed over.

    Overwriting empties the folder first; appending replaces files of the same name.
    """

    @classmethod
    def name(cls) -> str:
        return "plumbline_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if missing := {"file", "content"} - set(schema.names):
            raise ValueError(f"rows lack {sorted(missing)}")
        return FilesWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, order: list[str] | None = None, overwrite: bool = True) -> None:
    """Files below a path from rows of (file, content); rows of one name are joined in the order of `order`.

    A file is written by one task, as it must be; it passes row by row, and many files
    are dealt over all tasks.
    """
    register(rows.sparkSession)
    dealt = rows.repartition("file").sortWithinPartitions("file", *(order or []))
    dealt.select("file", "content").write.format("plumbline_files").option("path", path).mode("overwrite" if overwrite else "append").save()


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `content`, their columns as a line of CSV; nulls are blank, and what needs quotes has them."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = lambda v: F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    return rows.withColumn("content", F.concat(F.concat_ws(",", *(quoted(text(c)) for c in columns)), F.lit("\r\n")))


def write_csv_files(rows: DataFrame, path: str, columns: list[str], drawing: str = "drawing", order: list[str] | None = None) -> None:
    """One CSV file for each drawing, <stem>_raw_extract.csv, with a byte-order mark and a header, rows in the order given."""
    stem = F.regexp_extract(drawing, r"([^/]*?)(\.[^./]*)?$", 1)
    named = csv_lines(rows, columns).withColumn("file", F.concat(stem, F.lit("_raw_extract.csv")))
    keys = [f"_o{i}" for i in range(len(order or []))]
    lines = named.select("file", "content", F.lit(1).alias("_line"), *(F.col(c).alias(k) for c, k in zip(order or [], keys)))
    head = "﻿" + ",".join(columns) + "\r\n"
    blank = [F.lit(None).cast(lines.schema[k].dataType).alias(k) for k in keys]
    heads = lines.select("file").distinct().select("file", F.lit(head).alias("content"), F.lit(0).alias("_line"), *blank)
    write_files(heads.unionByName(lines), path, ["_line", *keys])


# ---------------------------------------------------------------- sheets
class Folder:
    """The default transport: each chunk as a file by its number, so that sending one again changes nothing."""

    def __init__(self, target: str):
        self.target = target.rstrip("/")

    def send(self, chunk: dict) -> None:
        fs, at = _store(self.target)
        if chunk["mode"] == "replace":
            _remove(self.target)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{chunk['job']}-{chunk['number']:06d}.json") as out:
            out.write(json.dumps(chunk, ensure_ascii=False).encode())


def with_retries(send: Callable[[dict], None], chunk: dict, tries: int = TRIES, base: float = BASE, sleep: Callable[[float], None] = time.sleep) -> None:
    """Send a chunk; after a time-out wait and try again, each time longer. Other errors aren't repeated."""
    for k in range(tries):
        try:
            return send(chunk)
        except TimeoutError:
            if k + 1 == tries:
                raise
            sleep(base ** (k + 1))


class SheetWriter(DataSourceWriter):
    """Rows as chunks of JSON below the staging path; the driver sends them one by one when all tasks are done."""

    def __init__(self, names: list[str], overwrite: bool, options: dict):
        self.names, self.overwrite, self.job = names, overwrite, uuid.uuid4().hex
        self.target = options["path"]
        self.staging = f"{options.get('staging', self.target + '-staging').rstrip('/')}/{self.job}"
        self.rows, self.tries, self.base = int(options.get("chunkrows", options.get("chunkRows", CHUNK_ROWS))), int(options.get("tries", TRIES)), float(options.get("base", BASE))
        self.transport = options.get("transport", f"{__name__}:Folder")

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        fs, at = _store(folder)
        fs.create_dir(at, recursive=True)
        done, held = Written(folder), []

        def close() -> None:
            name = f"{part:08d}-{len(done.names):08d}.json"
            with fs.open_output_stream(f"{at}/{name}") as out:
                out.write(json.dumps(held, ensure_ascii=False, default=str).encode())
            done.names.append(name)
            held.clear()

        for row in iterator:
            held.append([row[n] for n in self.names])
            if len(held) == self.rows:
                close()
        if held:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        module, _, kind = self.transport.partition(":")
        transport = getattr(importlib.import_module(module), kind)(self.target)
        staged = sorted((name, m.folder) for m in messages if m for name in m.names)
        for number, (name, folder) in enumerate(staged or [(None, None)]):
            rows = []
            if name is not None:
                fs, at = _store(folder)
                with fs.open_input_stream(f"{at}/{name}") as file:
                    rows = json.loads(file.read())
            mode = "replace" if self.overwrite and number == 0 else "append"
            if rows or mode == "replace":  # an empty sheet still replaces the one before
                with_retries(transport.send, {"job": self.job, "number": number, "mode": mode, "headers": self.names, "rows": rows}, self.tries, self.base)
        _remove(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        _remove(self.staging)


class SheetSink(DataSource):
    """Rows as a sheet that is sent in chunks of `chunkRows`: the first replaces what is there when overwriting, all others are appended.

    Options: path (the target), staging (a shared folder; beside the target by default),
    chunkRows, tries, base, and transport, `module:Class` of an object that is made with
    the target and has send(chunk); the default writes files. Chunks go in the order of
    partitions, so a sorted table arrives sorted. A chunk's job and number tell a
    receiver what it has already.
    """

    @classmethod
    def name(cls) -> str:
        return "plumbline_sheet"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SheetWriter(list(schema.names), overwrite, dict(self.options))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a sheet that the Folder transport has written, as text columns in their order: (number, place, headers, cells)."""
    chunks = spark.read.schema("job string, number int, mode string, headers array<string>, rows array<array<string>>").json(path)
    return chunks.select("number", "headers", F.posexplode("rows").alias("place", "cells"))
