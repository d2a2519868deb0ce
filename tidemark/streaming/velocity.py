"""Streaming velocity: normalise, flag late events, deduplicate, and count by sliding windows; and its batch equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK, WINDOW, SLIDE = "10 minutes", "5 minutes", "1 minute"
LATE_MICROS = 600_000_000


def is_late(ingested: Column, event_time: Column) -> Column:
    """Later than ten minutes, strictly."""
    return F.unix_micros(ingested) - F.unix_micros(event_time) > LATE_MICROS


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def velocity(events: DataFrame, *, key: str = "customer", time: str = "event_time", id_: str = "event_id", amount: str = "amount", device: str | None = "device") -> DataFrame:
    """Per window and key: events, amount, and approximately how many distinct devices (left out where device is None).

    Works on a stream and on a table. On a stream, an id is kept only for as long as the watermark needs it. The sketch of the
    devices is most of a window's state, and a stream cannot drop it later.
    """
    marked = events.withWatermark(time, WATERMARK)
    unique = marked.dropDuplicatesWithinWatermark([id_]) if events.isStreaming else events.dropDuplicates([id_])
    per = unique.groupBy(F.window(time, WINDOW, SLIDE).alias("w"), key)
    devices = [F.approx_count_distinct(device).alias("devices")] if device else []
    out = per.agg(F.count("*").alias("n"), F.sum(amount).alias("total"), *devices)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "total", *(["devices"] if device else []))


#: State is kept on disk, with a bound of the memory of each executor; the number of keys is not counted at each write.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def write(stream: DataFrame, path: str, checkpoint: str):
    """An append query that takes what there is and stops. Its state store is that of STATE; the session's settings stay."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            conf.set(k, v)
        return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def split_late(events: DataFrame, time: str = "event_time", ingested: str = "ingested_at") -> tuple[DataFrame, DataFrame]:
    """(on time, late): the side output of late events goes by ingestion lag, not by the watermark."""
    late = is_late(F.col(ingested), F.col(time))
    return events.where(~late), events.where(late)


def progress(query) -> dict:
    """Rows and rates of the last micro-batch."""
    last = query.lastProgress or {}
    return {k: last.get(k) for k in ("batchId", "numInputRows", "inputRowsPerSecond", "processedRowsPerSecond")}
