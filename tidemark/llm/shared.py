"""Tables and folders that the driver and all executors can reach, and session settings."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shipping import delete, delete_at_exit, shared_dir, ship_package

#: Rows in one Arrow batch: with long texts, Spark's default of 10,000 would not fit in a Python worker.
ARROW_ROWS = 256


def configure(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, and give the workers this package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


class Stored:
    """A table in the shared folder: its lineage ends at files that outlive executors.

    The files go with discard(), called once nothing reads them any more, or else when the driver ends.
    """

    def __init__(self, df: DataFrame, name: str) -> None:
        self._spark = df.sparkSession
        self.path = fresh_path(self._spark, name)
        df.write.parquet(self.path)
        delete_at_exit(self._spark, self.path)
        self.rows = self._spark.read.schema(df.schema).parquet(self.path)

    def discard(self) -> None:
        delete(self._spark, self.path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows of a stored table that is read until the driver ends."""
    return Stored(df, name).rows


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores before it until no column of df has that name."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = "_" + wanted
    return wanted


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    return [free_name(df, w) for w in wanted]


#: Keys with more rows than this, and more than one HOT_KEYS-th of all, are joined by broadcast: HOT_KEYS of them at most.
HOT_ROWS, HOT_KEYS = 300, 10_000


def attach(rows: DataFrame, summary: DataFrame, keys: str | Sequence[str], count: str, spread: str, *, total: int | None = None, keep: bool = False) -> DataFrame:
    """rows with the columns of summary (one row for each key, with `count`, the key's rows) but for the count.

    Rows of a hot key get them from a broadcast list of bounded length, and are dealt by `spread` from then on; so no task
    gathers a hot key. Keys without a summary are dropped, or with `keep` get nulls; null keys have no summary. total: the sum
    of the counts, where it is known; it is asked for otherwise.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    values = [c for c in summary.columns if c not in (*keys, count)]
    total = (summary.agg(F.sum(count)).first()[0] or 0) if total is None else total
    is_hot = F.col(count) > max(HOT_ROWS, total // HOT_KEYS)
    hot = summary.where(is_hot).select(*[F.col(k).alias(f"_hot{j}") for j, k in enumerate(keys)], F.struct(*values).alias("_hot_values"))
    cold = summary.where(~is_hot).select(F.lit(True).alias("_cold"), *[F.col(k).alias(f"_key{j}") for j, k in enumerate(keys)], F.struct(*values).alias("_values"))
    marked = rows.join(F.broadcast(hot), _all(F.col(k) == F.col(f"_hot{j}") for j, k in enumerate(keys)), "left")
    dealt = marked.withColumn("_is_cold", F.col("_hot0").isNull()).withColumn("_dealt", F.when(F.col("_hot0").isNull(), F.col(keys[0])).otherwise(F.col(spread).cast(rows.schema[keys[0]].dataType)))
    same = _all([F.col("_is_cold") == F.col("_cold"), F.col("_dealt") == F.col("_key0"), *[F.col(k) == F.col(f"_key{j}") for j, k in enumerate(keys) if j]])
    both = dealt.join(cold, same, "left")
    found = F.when(F.col("_is_cold"), F.col("_values")).otherwise(F.col("_hot_values"))
    out = (both if keep else both.where(~F.col("_is_cold") | F.col("_cold"))).withColumn("_found", found)
    return out.select(*rows.columns, *[F.col("_found")[c].alias(c) for c in values])


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


#: Equal rows that one task numbers at a time.
FOLD = 10_000


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """rows with `out`, which numbers equal rows from 0, so that no two rows are equal.

    Equal rows fold into one with their number on the map side; a group of more than FOLD unfolds in many tasks.
    """
    n, block = free_names(rows, "n", "block")
    per = rows.groupBy(*rows.columns).agg(F.count("*").alias(n))
    few = per.where(F.col(n) <= FOLD).select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(out))
    many = per.where(F.col(n) > FOLD).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / FOLD))).alias(block))
    each = F.sequence(F.col(block) * FOLD, F.least(F.col(n), (F.col(block) + 1) * FOLD) - 1)
    return few.unionByName(many.repartition(F.col(block), *[F.col(c) for c in rows.columns]).select(*rows.columns, F.explode(each).alias(out)))
