"""Scratch tables in the cluster's shared folder, and this package's code for executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str = "live") -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Only a local session may do without: it has one disk."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df from a written table: its lineage ends there, and a lost executor takes nothing with it."""
    path = path or shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _place(spark: SparkSession, path: str):
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(sc._jsc.hadoopConfiguration())


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            place, system = _place(t.sparkSession, path)
            system.delete(place, True)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    place, system = _place(spark, f"{path}/_SUCCESS")
    return system.exists(place)


def ship(spark: SparkSession) -> None:
    """Gives executors this package's code, once for each context: they need not have it on their path."""
    sc = spark.sparkContext
    if not getattr(sc, "_tallyloom_shipped", False):
        top = Path(__file__).resolve().parents[2]
        if top.is_dir():  # else the code runs from an archive that was shipped already
            base = os.path.join(tempfile.mkdtemp(prefix="tallyloom-"), "tallyloom")
            sc.addPyFile(shutil.make_archive(base, "zip", top, "tallyloom"))
        sc._tallyloom_shipped = True
