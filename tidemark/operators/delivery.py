"""Delivery and layout: stable partitions, ordinal ranges, fault groups in time, exports for graph tools, run metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import canonical_json, hash_uniform
from tidemark.functions.ranges import comparable
from tidemark.operators.running import running


def transport_partition(key: Column, partitions: int = 16) -> Column:
    """The first 8 hex digits of the SHA-256 of the key as a JSON string, modulo partitions."""
    quoted = F.to_json(F.array(key.cast("string")))
    inner = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return (F.conv(F.substring(F.sha2(inner, 256), 1, 8), 16, 10).cast("long") % partitions).cast("int")


def ordinal_ranges(spark: SparkSession, rows: int, shards: int, chunk: int) -> DataFrame:
    """(shard, chunk, first, last): contiguous ranges by shard, the larger ones first, cut into chunks; last is exclusive."""
    base, more = divmod(rows, shards)
    s = F.col("id")
    size = base + (s < more).cast("long")
    start = s * base + F.least(s, F.lit(more))
    out = spark.range(shards).select(s.alias("shard"), start.alias("start"), size.alias("size")).where("size > 0")
    out = out.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(chunk).cast("long"))).alias("chunk", "at"))
    return out.select("shard", "chunk", (F.col("start") + F.col("at")).alias("first"), (F.col("start") + F.least(F.col("at") + chunk, F.col("size"))).alias("last"))


def outages(rows: DataFrame, time: str, windows: Sequence[tuple[int, int, str]]) -> DataFrame:
    """Rows under outages (start, end, mode): DROP loses them, DELAY and BUFFER move `delivered` to the end."""
    lost, delivered = F.lit(False), F.col(time)
    for start, end, mode in windows:
        inside = (F.col(time) >= start) & (F.col(time) < end)
        if mode == "DROP":
            lost = lost | inside
        elif mode in ("DELAY", "BUFFER"):
            delivered = F.when(inside, end).otherwise(delivered)
        else:
            raise ValueError(f"unknown mode {mode!r}")
    return rows.withColumn("delivered", delivered.cast("long")).where(~lost)


def spikes(rows: DataFrame, group: Column, id_: str, probability: float, times: int) -> DataFrame:
    """All rows of a chosen group are repeated; copy numbers the repeats."""
    hit = hash_uniform("spike", group) < probability
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(hit, times - 1).otherwise(0))))


def rotated(rows: DataFrame, by: str, order: Sequence[str], shift: int) -> DataFrame:
    """delivery: the position of each row in its group, rotated by shift; the first order column is a number or time."""
    keyed = rows.withColumns({"_first": comparable(rows, order[0]), "_one": F.lit(1).cast("long")})
    placed = running(keyed, [by], ["_first", *order[1:]], {"_k": ("sum", "_one")})
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    both = placed.join(sizes, F.col(by).eqNullSafe(F.col("_by")))
    return both.select(*rows.columns, ((F.col("_k") - 1 + shift) % F.col("_n")).cast("long").alias("delivery"))


def publication_order(rows: DataFrame, topic: Column, key: Column, time: str, id_: str) -> DataFrame:
    """(topic, partition, key, value, sequence): what is published, in order within each topic and partition.

    Large partitions are numbered in ranges of time, so a topic needs no more tasks than rows ask for, and no fewer.
    """
    out = rows.select(topic.alias("topic"), transport_partition(key).alias("partition"), key.cast("string").alias("key"), canonical_json({c: F.col(c) for c in rows.columns}).alias("value"), F.col(time).alias("_t"), F.col(id_).alias("_i"), F.lit(1).cast("long").alias("_one"))
    return running(out, ["topic", "partition"], ["_t", "_i"], {"sequence": ("sum", "_one")}).drop("_t", "_i", "_one")


def referenced_ids(rows: DataFrame, columns: Sequence[str], arrays: Sequence[str] = ()) -> DataFrame:
    """(kind, id): the distinct ids that the columns and array columns name."""
    pairs = [F.array(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("id"))) for c in columns]

    def named(array: str) -> Column:
        return F.transform(F.coalesce(F.col(array).cast("array<string>"), F.array().cast("array<string>")), lambda x: F.struct(F.lit(array).alias("kind"), x.alias("id")))

    pairs += [named(a) for a in arrays]
    return rows.select(F.explode(F.concat(*pairs)).alias("x")).select("x.*").where("id is not null").distinct()


def graph_csv(nodes: DataFrame, edges: DataFrame, path: str) -> list[str]:
    """Node and edge files for a property-graph import, and the constraints to run first."""
    nodes.select(F.col("node").alias(":ID"), F.col("kind").alias(":LABEL")).write.mode("errorifexists").option("header", True).csv(f"{path}/nodes")
    edges.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.col("kind").alias(":TYPE"), F.col("at").alias("at:long")).write.mode("errorifexists").option("header", True).csv(f"{path}/edges")
    return [f"CREATE CONSTRAINT IF NOT EXISTS FOR (n:{k}) REQUIRE n.id IS UNIQUE" for k in sorted(r.kind for r in nodes.select("kind").distinct().collect())]


def run_metrics(rows: DataFrame, id_: str, valid: Column) -> DataFrame:
    """One row: rows, duplicate rate and invalid rate."""
    return rows.agg(F.count("*").alias("rows"), (1 - F.count_distinct(id_) / F.count("*")).alias("duplicate_rate"), F.avg((~F.coalesce(valid, F.lit(False))).cast("double")).alias("invalid_rate"))


def contract(rows: DataFrame, fields: dict[str, tuple[str, object]]) -> DataFrame:
    """Exactly the contract's fields in its order, cast to their types, with defaults for missing or null ones."""
    have = set(rows.columns)
    return rows.select(*[(F.coalesce(F.col(n), F.lit(d)) if n in have and d is not None else F.col(n) if n in have else F.lit(d)).cast(t).alias(n) for n, (t, d) in fields.items()])


def match_rules(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows with `rule`, violations): each row may match one rule at most."""
    names = F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))
    out = rows.withColumn("_m", names)
    bad = out.where(F.size("_m") > 1).select(F.lit("several_rules").alias("rule"), F.concat_ws(",", "_m").alias("key"), F.size("_m").cast("string").alias("detail"))
    return out.withColumn("rule", F.get("_m", F.lit(0))).drop("_m"), bad
