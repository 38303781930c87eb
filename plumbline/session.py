"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors, as --py-files would.

    Nothing is sent where the executors were given the package already by the
    submit command; sending it twice is harmless.
    """
    context = spark.sparkContext
    if getattr(context, "_plumbline_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(_ROOT)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("plumbline", os.path.relpath(path, _ROOT)))
    path = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline_src.zip")
    with open(path, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(path)
    context._plumbline_shipped = True


def kept(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the folder that spark.checkpoint.dir names: computed once, survives lost executors, cuts lineage.

    Without that setting a local session gets a temporary folder; on a cluster it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plumbline-kept-")
        context.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/plumbline/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
