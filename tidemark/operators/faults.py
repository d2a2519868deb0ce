"""Injected quality faults and delivery chaos: every choice is a hash of the row's id, so reruns and partitions change nothing.

Faults come in the fixed order of FAULTS: fields, then sources and contracts, then delivery, then copies, then groups and order. A
row may have several. Null ids are never chosen. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import MICROS, canonical_json, hash_uniform
from tidemark.operators.delivery import rotated, transport_partition
from tidemark.operators.evaluation import global_rank

#: The names of the faults.
FAULTS = (
    "duplicate_records",
    "duplicate_events",
    "missing_optional_fields",
    "invalid_values",
    "invalid_enums",
    "invalid_references",
    "negative_amounts",
    "corrupted_timestamps",
    "timezone_errors",
    "schema_mismatches",
    "extreme_values",
    "encoding_errors",
    "partition_skews",
    "late_events",
    "out_of_order_events",
    "source_delay_events",
    "fraud_spikes",
    "traffic_spikes",
)
EXTREME = 1.0e15
#: Positions in a block.
BLOCK = 10_000


@dataclass(frozen=True)
class Settings:
    """Probabilities by fault, seconds of delays, copies of a spike's rows, positions a delivery is rotated by."""

    probability: dict[str, float]
    source_delay: int = 0
    late_delay: int = 900
    spike: int = 3
    shift: int = 1

    def of(self, fault: str) -> float:
        return self.probability.get(fault, 0.0)


def inject(events: DataFrame, settings: Settings, optional: Sequence[str] = (), placed: bool = True) -> DataFrame:
    """events with faults, `faults` (an array of names), `copy` (0 for the row itself), `delivery` and `raw_payload`.

    placed: False leaves `delivery` out, which takes an order of each payment's rows; all else is the same.

    events: event_id, payment_id, event_type, event_time, source_available_at, ingested_at, processed_at (microseconds),
    schema_version, amount, scenario_id, and `optional` columns that may go missing, each by a draw of its own.
    """
    unknown = set(settings.probability) - set(FAULTS)
    if unknown:
        raise ValueError(f"unknown faults {sorted(unknown)}")
    i = F.col("event_id")
    hit = lambda fault, key=i: F.coalesce(hash_uniform(fault, key) < settings.of(fault), F.lit(False))
    out, found = events, []

    def change(fault: str, columns: dict[str, Column]) -> None:
        nonlocal out
        mark = f"_{fault}"
        out = out.withColumn(mark, hit(fault))
        out = out.withColumns({c: F.when(F.col(mark), v).otherwise(F.col(c)) for c, v in columns.items()})
        found.append(F.when(F.col(mark), fault))

    gone = [F.coalesce(hash_uniform(f"missing/{c}", i) < settings.of("missing_optional_fields"), F.lit(False)) & F.col(c).isNotNull() for c in optional]
    out = out.withColumn("_missing", F.array_contains(F.array(*gone), True) if gone else F.lit(False))
    out = out.withColumns({c: F.when(~g, F.col(c)) for c, g in zip(optional, gone, strict=True)})
    found.append(F.when(F.col("_missing"), "missing_optional_fields"))
    change("negative_amounts", {"amount": -F.abs("amount")})
    change("invalid_values", {"amount": -F.abs("amount")})
    change("invalid_enums", {"event_type": F.concat(F.lit("INVALID_ENUM:"), i.cast("string"))})
    change("invalid_references", {"payment_id": F.concat(F.lit("PAYMENT-UNKNOWN-"), i.cast("string"))})
    change("corrupted_timestamps", {"source_available_at": F.col("event_time") - MICROS})
    out = out.withColumn("timezone", F.lit("UTC"))
    change("timezone_errors", {"timezone": F.lit(None)})
    change("schema_mismatches", {"schema_version": F.concat(F.lit("unregistered-"), "schema_version", F.lit("-"), i.cast("string"))})
    change("extreme_values", {"amount": F.lit(EXTREME)})
    payload = canonical_json({c: F.col(c) for c in ("event_id", "payment_id", "event_type", "amount")})
    out = out.withColumn("raw_payload", F.lit(None).cast("string"))
    change("encoding_errors", {"raw_payload": F.base64(F.concat(payload.cast("binary"), F.unhex(F.lit("FF"))))})
    skewed = hit("partition_skews", F.col("payment_id"))
    out = out.withColumn("transport_partition", F.when(skewed, 0).otherwise(transport_partition(F.col("payment_id"))))
    found.append(F.when(skewed, "partition_skews"))
    moved = ("source_available_at", "ingested_at", "processed_at")
    if settings.source_delay:
        out = out.withColumns({c: F.col(c) + settings.source_delay * MICROS for c in moved})
        found.append(F.lit("source_delay_events"))
    change("late_events", {c: F.col(c) + settings.late_delay * MICROS for c in moved})
    # Copies: of single events, of all records of a payment, and of groups, one factor after the other.
    factors = {
        "duplicate_events": (hit("duplicate_events"), 2),
        "duplicate_records": (hit("duplicate_records", F.col("payment_id")), 2),
        "traffic_spikes": (hit("traffic_spikes", F.col("payment_id")), settings.spike),
        "fraud_spikes": (hit("fraud_spikes", F.col("scenario_id")), settings.spike),
    }
    times = F.lit(1)
    for fault, (chosen, factor) in factors.items():
        times = times * F.when(chosen, factor).otherwise(1)
        found.append(F.when(chosen, fault))
    out = out.withColumn("faults", F.array_compact(F.array(*found)))
    # Never empty; for a plain explode the optimizer would filter by its size, and work all draws out once more.
    out = out.withColumn("copy", F.explode_outer(F.sequence(F.lit(0), times - 1)))
    chosen = hit("out_of_order_events", F.col("payment_id"))
    plain = F.when(F.col("_chosen"), F.array_append("faults", F.lit("out_of_order_events"))).otherwise(F.col("faults"))
    out = out.withColumn("_chosen", chosen)
    columns = [*events.columns, "timezone", "raw_payload", "transport_partition", "faults", "copy"]
    if not placed:
        return out.withColumn("faults", plain).select(*columns)
    out = rotated(out, "payment_id", ["event_time", "event_id", "copy"], settings.shift)
    return out.withColumns({"faults": plain, "delivery": F.when(F.col("_chosen"), F.col("delivery"))}).select(*columns, "delivery")


def counts(faulty: DataFrame) -> DataFrame:
    """(fault, rows) for every fault, 0 where there is none: rows that it hit, copies included."""
    per = faulty.select(F.explode_outer("faults").alias("fault")).where("fault is not null").groupBy("fault").agg(F.count("*").alias("rows"))
    names = faulty.sparkSession.createDataFrame([(f,) for f in FAULTS], "fault string")
    return names.join(per, "fault", "left").select("fault", F.coalesce("rows", F.lit(0)).alias("rows"))


def realign(dependants: DataFrame, events: DataFrame, key: str, times: Sequence[str]) -> DataFrame:
    """dependants (ledger entries, workflow records) with their times not before their event's availability after faults.

    A time that is null stays null; rows without an event are kept as they are. Copies of an event count by their latest.
    """
    latest = events.groupBy(F.col("event_id").alias("_event")).agg(F.max("source_available_at").alias("_at"))
    both = dependants.join(latest, F.col(key) == F.col("_event"), "left")
    return both.select(*[F.when(F.col(c).isNotNull(), F.greatest(c, "_at")).alias(c) if c in times else F.col(c) for c in dependants.columns])


@dataclass(frozen=True)
class Outage:
    """From start to before end: DROP, BUFFER_AND_FLUSH (to the end), DELAY (by seconds) or PARTIAL_REJECT (a share meets it, and goes through)."""

    start: int
    end: int
    behavior: str
    reject: float = 0.5
    delay: int = 0

    def __post_init__(self) -> None:
        if self.end <= self.start or self.behavior not in ("DROP", "BUFFER_AND_FLUSH", "DELAY", "PARTIAL_REJECT") or (self.behavior == "DELAY" and self.delay < 1):
            raise ValueError(f"not an outage: {self}")


@dataclass(frozen=True)
class Chaos:
    drop: float = 0.0
    duplicate: float = 0.0
    retry: float = 0.0
    max_delay: int = 0
    partitions: int = 3
    skew: float = 0.0
    outages: tuple[Outage, ...] = ()


def deliver(records: DataFrame, chaos: Chaos) -> DataFrame:
    """What becomes of records(record_id, key, scheduled): a row for each delivery, and one with a null attempt for what was dropped.

    (record_id, key, scheduled, delivered, attempt, copy, partition, late, fate): delays are whole seconds by a draw, and a second
    attempt comes a second later.
    """
    i, at = F.col("record_id"), F.col("scheduled")
    u = lambda name: hash_uniform(name, i)
    outage, fate, wait = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0).cast("long")
    for o in reversed(chaos.outages):  # the first that holds counts
        inside = (at >= o.start) & (at < o.end)
        inside = inside & (u("reject") < o.reject) if o.behavior == "PARTIAL_REJECT" else inside
        outage = F.when(inside, o.behavior).otherwise(outage)
        if o.behavior in ("BUFFER_AND_FLUSH", "DELAY"):
            wait = F.when(inside, F.floor((o.end - at) / MICROS) if o.behavior == "BUFFER_AND_FLUSH" else F.lit(o.delay).cast("long")).otherwise(wait)
        else:
            wait = F.when(inside, F.lit(0).cast("long")).otherwise(wait)
    fate = F.when(outage == "DROP", "outage").when(u("drop") < chaos.drop, "drop").otherwise("sent")
    out = records.withColumns({"_outage": outage, "fate": fate, "_wait": wait + F.floor(u("delay") * (chaos.max_delay + 1)).cast("long")})
    tries = lambda name, p: F.sequence(F.lit(0), F.when(u(name) < p, 1).otherwise(0))
    sent = out.where("fate = 'sent'").withColumn("attempt", F.explode(tries("retry", chaos.retry))).withColumn("copy", F.explode(tries("duplicate", chaos.duplicate)))
    delivered = at + (F.col("_wait") + F.col("attempt")) * MICROS
    part = F.when(u("skew") < chaos.skew, 0).otherwise(transport_partition(F.col("key"), chaos.partitions))
    sent = sent.select("record_id", "key", "scheduled", delivered.alias("delivered"), (F.col("attempt") + 1).alias("attempt"), "copy", part.alias("partition"), (delivered > at).alias("late"), "fate")
    lost = out.where("fate <> 'sent'").select("record_id", "key", "scheduled", "fate")
    return sent.unionByName(lost, allowMissingColumns=True)


def delivery_counts(deliveries: DataFrame) -> DataFrame:
    """One row: emitted, dropped, retried, duplicated, late, deduplicated: deliveries, and records that were dropped."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    sent = F.col("fate") == "sent"
    out = deliveries.agg(n(sent).alias("emitted"), n(~sent).alias("dropped"), n(F.col("attempt") > 1).alias("retried"), n(F.col("copy") > 0).alias("duplicated"), n(F.col("late")).alias("late"), F.count_distinct(F.when(sent, F.col("record_id"))).alias("_ids"))
    return out.select("emitted", "dropped", "retried", "duplicated", "late", (F.col("emitted") - F.col("_ids")).alias("deduplicated"))


def reordered(deliveries: DataFrame, window: int) -> DataFrame:
    """The deliveries that were sent with their position from 1: by schedule, id, attempt and copy, and within windows of as many by a draw."""
    sent = global_rank(deliveries.where("fate = 'sent'"), [F.col(c) for c in ("scheduled", "record_id", "attempt", "copy")], "position")
    if window <= 1:
        return sent
    drawn = hash_uniform("reorder", F.concat_ws("/", *[F.col(c).cast("string") for c in ("record_id", "attempt", "copy")]))
    placed = sent.withColumns({"_window": F.floor((F.col("position") - 1) / window), "_draw": drawn}).drop("position")
    # Positions have no gaps, so all windows before one are full.
    within = F.row_number().over(Window.partitionBy("_window").orderBy("_draw", "record_id", "attempt", "copy"))
    return placed.withColumn("position", F.col("_window") * window + within).drop("_window", "_draw")


def out_of_order(placed: DataFrame) -> DataFrame:
    """One row, out_of_order: deliveries after which one that was delivered earlier comes. Positions are whole numbers without gaps.

    Rows are dealt into blocks of positions, the last of each block into the next one too.
    """
    block, last = F.floor(F.col("position") / BLOCK), F.col("position") % BLOCK == BLOCK - 1
    dealt = placed.select("position", "delivered", F.explode(F.when(last, F.array(block, block + 1)).otherwise(F.array(block))).alias("_block"), block.alias("_own"))
    before = F.lag("delivered").over(Window.partitionBy("_block").orderBy("position"))
    late = F.coalesce((before > F.col("delivered")) & (F.col("_block") == F.col("_own")), F.lit(False))
    return dealt.withColumn("_late", late).agg(F.sum(F.col("_late").cast("long")).alias("out_of_order"))
