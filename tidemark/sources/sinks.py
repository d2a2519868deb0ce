"""Sinks: typed and masked Parquet, sorted JSON lines, sharded partitions with a commit record, Iceberg, JDBC and Kafka."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import canonical_json, shard_index
from tidemark.functions.shipping import write_bytes
from tidemark.operators.records import fingerprint, fingerprints


def masked(df: DataFrame, schema: T.StructType, hide: Sequence[str] = ()) -> DataFrame:
    """The schema's columns in its order and types; hidden ones are null."""
    return df.select(*[(F.lit(None) if f.name in hide else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema])


def write_typed(df: DataFrame, schema: T.StructType, path: str, hide: Sequence[str] = ()) -> None:
    masked(df, schema, hide).write.mode("errorifexists").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(canonical_json({c: F.col(c) for c in df.columns}).alias("value")).write.mode("errorifexists").text(path)


def write_partitions(df: DataFrame, key: str, kind: str, path: str, shards: int, most_rows: int = 1_000_000) -> dict:
    """Rows by shard of the key and by kind, files of at most most_rows rows, then a manifest as the commit record."""
    sharded = df.withColumn("partition_id", shard_index(F.col(key), shards)).withColumnRenamed(kind, "logical_type")
    sharded.repartition("partition_id", "logical_type").write.mode("errorifexists").option("maxRecordsPerFile", most_rows).partitionBy("partition_id", "logical_type").parquet(path)
    written = df.sparkSession.read.parquet(path)
    counts = {f"{r.partition_id}/{r.logical_type}": r["count"] for r in written.groupBy("partition_id", "logical_type").count().collect()}
    manifest = {"shards": shards, "rows": counts, "fingerprint": fingerprint(df).first()["fingerprint"]}
    write_bytes(df.sparkSession, f"{path}/_manifest.json", json.dumps(manifest, sort_keys=True).encode())
    return manifest


def resume_partitions(df: DataFrame, key: str, path: str, shards: int) -> list[int]:
    """Write the shards that are not there yet, each with a marker of its rows' fingerprint; returns those written.

    One pass works out the fingerprints of all shards, and one write makes the missing ones. A shard whose marker equals the
    fingerprint of its rows is left alone, so a run that was cut off can be repeated.
    """
    spark = df.sparkSession
    sharded = df.withColumn("shard", shard_index(F.col(key), shards))
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    marks = {r.shard: f"{path}/shard={r.shard}/_fingerprint-{r.fingerprint[:32]}" for r in fingerprints(sharded, "shard", df.columns).collect()}  # a row for each shard
    missing = sorted(k for k, mark in marks.items() if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(mark)))
    if missing:
        rows = sharded.where(F.col("shard").isin(missing)).repartition("shard")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
        for k in missing:
            write_bytes(spark, marks[k], b"")
    return missing


def maintain_iceberg(spark: SparkSession, table: str, older_than: str, *, dry_run: bool = True) -> list[str]:
    """The maintenance calls for a table; they run only where dry_run is off."""
    catalog = table.split(".")[0]
    calls = [f"CALL {catalog}.system.expire_snapshots(table => '{table}', older_than => TIMESTAMP '{older_than}')", f"CALL {catalog}.system.rewrite_data_files(table => '{table}')", f"CALL {catalog}.system.remove_orphan_files(table => '{table}', older_than => TIMESTAMP '{older_than}')"]
    for call in [] if dry_run else calls:
        spark.sql(call)
    return calls


def read_partitions(spark: SparkSession, path: str, *, shard: int | None = None, kind: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Partition and column pruning do the selection."""
    out = spark.read.parquet(path)
    out = out if shard is None else out.where(F.col("partition_id") == shard)
    out = out if kind is None else out.where(F.col("logical_type") == kind)
    return out if columns is None else out.select(*columns)


def append_iceberg(df: DataFrame, table: str) -> None:
    """Append with added columns; Iceberg's package must be on the class path."""
    try:
        df.writeTo(table).option("mergeSchema", "true").append()
    except Exception as missing:
        raise RuntimeError("the Iceberg connector is not on the class path, or the table is missing") from missing


def upsert_jdbc(df: DataFrame, url: str, table: str, key: str, properties: dict[str, str]) -> str:
    """Rows go to a staging table over many connections; returns the statement that moves them, which skips keys that are there.

    The statement is one transaction of the database, so two writers cannot both insert a key, and it can be run again.
    """
    staging = f"{table}_staging_{fingerprint(df).first()['fingerprint'][:12]}"
    df.write.jdbc(url, staging, mode="overwrite", properties=properties)
    columns = ", ".join(df.columns)
    return f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staging} ON CONFLICT ({key}) DO NOTHING"


def publish_kafka(df: DataFrame, servers: str, topic: str, key: str) -> None:
    rows = df.select(F.col(key).cast("string").alias("key"), canonical_json({c: F.col(c) for c in df.columns}).alias("value"))
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
