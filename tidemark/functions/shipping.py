"""Puts this package on the Python path of the executors, so that a cluster needs no copy of it installed."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset: on one machine a temporary one, on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors can reach")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Give executors the package as a zip, once for each Spark application, by way of the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.writestr(zipfile.ZipInfo(f"{root.name}/{file.relative_to(root)}", (2024, 1, 1, 0, 0, 0)), file.read_bytes())
    data = packed.getvalue()
    path = f"{shared_dir(spark)}/{root.name}-{hashlib.sha256(data).hexdigest()[:12]}.zip"
    write_bytes(spark, path, data)
    delete_at_exit(spark, path)
    context.addPyFile(path)
    context._tidemark_shipped = True


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file on any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """The files at path, which must be there, go when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends at files that outlive executors and go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
