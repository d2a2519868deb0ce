"""Typed scans, and the payment view of the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import MICROS, hash_uniform, micros

#: Availability delay in seconds by event type, and the share and length of the late tail.
DELAYS = {"purchase": 5, "signup": 5, "click": 2, "view": 2, "error": 2}
LATE_SHARE, LATE_SECONDS = 0.02, 900


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_typed(spark: SparkSession, path: str, schema: T.StructType, *, fallbacks: dict[str, str] | None = None) -> DataFrame:
    """A Parquet scan that must have the schema's columns with their types.

    fallbacks: for a column that older files lack, the column whose value it takes.
    """
    found = spark.read.parquet(path)
    have = {f.name: f.dataType for f in found.schema}
    out = []
    for f in schema:
        name = f.name if f.name in have else (fallbacks or {}).get(f.name)
        if name is None or name not in have:
            raise ValueError(f"{path}: column {f.name} is missing")
        if have[name] != f.dataType:
            raise ValueError(f"{path}: column {name} is {have[name].simpleString()}, not {f.dataType.simpleString()}")
        out.append(F.col(name).alias(f.name))
    return found.select(*out)


def payment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as payment events: t, available (microseconds), customer, amount, category, device.

    available is t plus a delay by type; a hash of the id puts LATE_SHARE of the events LATE_SECONDS later still.
    """
    e = read(spark, sf_dir, "events")
    delay = F.coalesce(F.create_map(*[F.lit(x) for kv in DELAYS.items() for x in kv])[F.col("event_type")], F.lit(2)).cast("long")
    late = F.when(hash_uniform("late", F.col("event_id")) < LATE_SHARE, LATE_SECONDS).otherwise(0)
    t = micros(F.col("ts"))
    return e.select(
        "event_id", t.alias("t"), (t + (delay + late) * MICROS).alias("available"), F.col("user_id").alias("customer"),
        F.col("value").alias("amount"), F.col("event_type").alias("category"), F.get_json_object("props", "$.k").alias("device"),
    )


def sql_over(source: DataFrame, query: str) -> DataFrame:
    """The caller's SQL over {source}; the placeholder is mandatory."""
    if "{source}" not in query:
        raise ValueError("the query must read from {source}")
    return source.sparkSession.sql(query, source=source)


def iter_rows(df: DataFrame) -> Iterator[Row]:
    """Rows without collecting: one partition at a time, the next one prefetched."""
    return df.toLocalIterator(prefetchPartitions=True)


def kafka(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """A bounded read of Kafka topics; Spark's Kafka package must be on the class path."""
    try:
        return spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load()
    except Exception as missing:
        raise RuntimeError("the Kafka connector is not on the class path") from missing
