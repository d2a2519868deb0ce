"""Replay of a period: the closure of the records that belong to it, their order, and chaos in delivery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import hash_uniform
from tidemark.functions.shipping import stored
from tidemark.operators.evaluation import global_rank


def closure(facts: DataFrame, inside: Column, references: Sequence[tuple[str, DataFrame, str, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The facts inside, and for each (name, table, fact key, table key) the rows they refer to."""
    kept = facts.where(inside)
    return kept, {name: table.join(kept.select(F.col(mine).alias("_k")).distinct(), F.col(theirs) == F.col("_k"), "left_semi") for name, table, mine, theirs in references}


def sequence_numbers(rows: DataFrame, order: Sequence[str], out: str = "sequence") -> DataFrame:
    """Replay sequence numbers from 1 in a total order, without one task for all rows."""
    return global_rank(rows, [F.col(c) for c in order], out)


#: The columns of a replayed event.
ENVELOPE = ("event_id", "event_type", "payment_id", "customer_id", "event_time", "source_created_at", "source_available_at", "ingested_at", "processed_at", "correlation_id", "causation_id", "scenario_id")


def envelopes(tables: dict[str, DataFrame], start: int, end: int) -> DataFrame:
    """The rows of the tables with an event time in [start, end), as (source_table, source_row_number, ENVELOPE...).

    Columns that a table lacks are null. A row's number is its place by event id in its table, so it is the same in every run.
    """
    out = None
    for name, table in tables.items():
        have = set(table.columns)
        numbered = global_rank(table, [F.col("event_id")], "source_row_number")
        one = numbered.where((F.col("event_time") >= start) & (F.col("event_time") < end))
        one = one.select(F.lit(name).alias("source_table"), (F.col("source_row_number") - 1).alias("source_row_number"), *[F.col(c) if c in have else F.lit(None).cast("long" if c.endswith(("_at", "_time")) else "string").alias(c) for c in ENVELOPE])
        out = one if out is None else out.unionByName(one)
    return out


#: The orders of a replay.
ORDERS = {
    "event_time_order": ("event_time", "source_created_at", "event_id", "source_table", "source_row_number"),
    "original_delivery": ("ingested_at", "processed_at", "source_available_at", "source_table", "source_row_number", "event_id"),
    "delivery_fallback": ("source_available_at", "event_time", "source_table", "source_row_number", "event_id"),
}


def replay(tables: dict[str, DataFrame], start: int, end: int, order: str) -> DataFrame:
    """The envelopes of a period with replay_sequence from 1. Where no row was ingested, delivery falls back to availability."""
    if order not in ("event_time_order", "original_delivery"):
        raise ValueError(f"unknown order {order!r}")
    if end <= start:
        raise ValueError("the end must come after the start")
    rows = stored(envelopes(tables, start, end), "replay")  # numbered over the whole tables; read by each step of the rank
    if order == "original_delivery" and rows.where("ingested_at is null or processed_at is null").limit(1).count():
        order = "delivery_fallback"
    return global_rank(rows, [F.col(c) for c in ORDERS[order]], "replay_sequence")


def chaos(rows: DataFrame, id_: str, time: str, *, drop: float, duplicate: float, delay: float, delay_by: int, window: int = 1) -> DataFrame:
    """Deliveries of the rows: some dropped, some twice, some late, and reordered inside windows of time.

    All choices are hashes of the id. attempt counts the deliveries of a row; delivered is when it arrives.
    """
    kept = rows.where(hash_uniform("drop", F.col(id_)) >= drop)
    twice = F.when(hash_uniform("duplicate", F.col(id_)) < duplicate, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = kept.withColumn("attempt", F.explode(twice))
    late = hash_uniform("delay", F.col(id_)) < delay
    shuffled = F.floor(F.col(time) / window) * window + F.floor(hash_uniform("reorder", F.concat_ws("/", F.col(id_).cast("string"), F.col("attempt").cast("string"))) * window)
    return out.withColumn("late", late).withColumn("delivered", (shuffled + F.when(late, delay_by).otherwise(0)).cast("long"))
