"""Data quality: key, envelope, reference and rule checks, delivery order, lifecycle checks, and injected faults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import hash_uniform
from tidemark.operators.running import running

#: The lifecycle moves that are allowed, (from, to), and what a payment starts with, as events carry them.
CARD = [
    ("CARD_PAYMENT_INITIATED", "CARD_AUTHORIZATION_REQUESTED"),
    ("CARD_AUTHORIZATION_REQUESTED", "CARD_AUTHORIZED"),
    ("CARD_AUTHORIZATION_REQUESTED", "CARD_DECLINED"),
    ("CARD_AUTHORIZED", "CARD_REVERSED"),
    ("CARD_AUTHORIZED", "CARD_CAPTURED"),
    ("CARD_CAPTURED", "CARD_REVERSED"),
    ("CARD_CAPTURED", "CARD_CLEARED"),
    ("CARD_CLEARED", "CARD_SETTLED"),
    ("CARD_SETTLED", "CARD_REFUNDED"),
    ("CARD_SETTLED", "CARD_CHARGEBACK_CREATED"),
    ("CARD_REFUNDED", "CARD_CHARGEBACK_CREATED"),
    ("CARD_CHARGEBACK_CREATED", "CARD_CHARGEBACK_RESOLVED"),
]
PIX = [
    ("PIX_INITIATED", "PIX_VALIDATED"),
    ("PIX_VALIDATED", "PIX_AUTHORIZED"),
    ("PIX_VALIDATED", "PIX_REJECTED"),
    ("PIX_AUTHORIZED", "PIX_SUBMITTED"),
    ("PIX_SUBMITTED", "PIX_SETTLED"),
    ("PIX_SUBMITTED", "PIX_TIMEOUT"),
    ("PIX_SETTLED", "PIX_RECEIVED"),
    ("PIX_SETTLED", "PIX_RETURN_REQUESTED"),
    ("PIX_RECEIVED", "PIX_RETURN_REQUESTED"),
    ("PIX_RETURN_REQUESTED", "PIX_RETURNED"),
]
FIRST = {"CARD": "CARD_PAYMENT_INITIATED", "PIX": "PIX_INITIATED"}


def key_summary(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, unique keys, duplicates and the unique rate (1 when empty)."""
    per = rows.groupBy(key).agg(F.count("*").alias("_n"))
    out = per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("unique_keys"))
    return out.select("rows", "unique_keys", (F.col("rows") - F.col("unique_keys")).alias("duplicates"), F.when(F.col("rows") == 0, 1.0).otherwise(F.col("unique_keys") / F.col("rows")).alias("unique_rate"))


def reference_rate(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """One row: checked (not null), null and valid references, and the valid rate (1 when none is checked).

    References are counted by value before they meet the parents, so a hot value is one row in the join.
    """
    per = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    known = parents.select(F.col(parent_key).alias("_p")).distinct()
    both = per.join(known, F.col("_k") == F.col("_p"), "left")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).cast("long")
    out = both.agg(total(F.col("_k").isNotNull()).alias("checked"), total(F.col("_k").isNull()).alias("nulls"), total(F.col("_p").isNotNull()).alias("valid"))
    return out.withColumn("rate", F.when(F.col("checked") == 0, 1.0).otherwise(F.col("valid") / F.col("checked")))


def rule_violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): all rules in one pass; a rule that is null does not count."""
    sums = rows.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return sums.select(F.explode(pairs).alias("x")).select("x.*")


def partition_skew(rows: DataFrame, part: Column) -> DataFrame:
    """(part, n, share) for each partition."""
    per = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    return per.select("part", "n", (F.col("n") / per.agg(F.sum("n")).scalar()).alias("share"))


def inversions(rows: DataFrame, key: str, delivered: Sequence[str], time: str) -> DataFrame:
    """Per key: rows, and rows whose time lies before that of the row delivered before."""
    seen = running(rows.select(key, time, *[c for c in delivered if c not in (key, time)]), [key], delivered, {"_b": ("previous", time)})
    return seen.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.coalesce((F.col(time) < F.col("_b")).cast("long"), F.lit(0))).alias("inversions"))


def lifecycle_violations(events: DataFrame, moves: Sequence[tuple[str, str]], initial: str, *, payment: str = "payment_id", state: str = "event_type", time: str = "event_time", id_: str = "event_id", cause: str = "causation_id", cuts: DataFrame | str | None = "find") -> DataFrame:
    """violations(rule, key, detail): first state, allowed moves, strictly increasing times, and the chain of causes.

    cuts: as in running; None if no payment has many events, as where lifecycles are generated, which saves a pass over them.
    """
    keyed = events.select(payment, state, time, id_, cause).withColumn("_one", F.lit(1).cast("long"))
    seen = running(keyed, [payment], [time, id_], {"_s": ("previous", state), "_t": ("previous", time), "_i": ("previous", id_), "_n": ("sum", "_one")}, cuts=cuts)
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in moves])
    later = F.col("_n") > 1
    rules = {
        "first_state": (F.col("_n") == 1) & (F.col(state) != initial),
        "first_cause": (F.col("_n") == 1) & F.col(cause).isNotNull(),
        "move": later & ~F.array_contains(allowed, F.concat_ws(">", "_s", state)),
        "time": later & (F.col(time) <= F.col("_t")),
        "cause": later & ~F.col(cause).eqNullSafe(F.col("_i")),
    }
    found = F.array_compact(F.array(*[F.when(bad, rule) for rule, bad in rules.items()]))
    return seen.select(F.explode(found).alias("rule"), F.col(payment).cast("string").alias("key"), F.col(id_).cast("string").alias("detail"))


def assert_none(violations: DataFrame) -> None:
    """Raise ValueError with a few examples if there is a violation; one action."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError("violations: " + "; ".join(f"{r.rule}({r.key}): {r.detail}" for r in some))


def inject_faults(rows: DataFrame, id_: str, faults: dict[str, tuple[float, dict[str, Column]]], duplicate: float = 0.0) -> DataFrame:
    """rows with faults: each, with its probability and by a hash of (fault, id), replaces columns; duplicates are repeated rows.

    faults are applied in the given order; `faults` lists those that hit a row.
    """
    out, hit = rows, []
    for name, (probability, changes) in faults.items():
        chosen = hash_uniform(name, F.col(id_)) < probability
        out = out.withColumns({c: F.when(chosen, value).otherwise(F.col(c)) for c, value in changes.items()})
        hit.append(F.when(chosen, name))
    out = out.withColumn("faults", F.array_compact(F.array(*hit)))
    if duplicate:
        times = F.when(hash_uniform("duplicate", F.col(id_)) < duplicate, 2).otherwise(1)
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
    return out


#: The times of an event's envelope, in the order they must have.
ENVELOPE_TIMES = ("event_time", "source_created_at", "source_available_at", "ingested_at", "processed_at")


def envelope_order(events: DataFrame, times: Sequence[str] = ENVELOPE_TIMES) -> DataFrame:
    """One row: events, those whose times (where present) follow one another, and the rate (1 when empty)."""
    good = F.lit(True)
    for earlier, later in zip(times, times[1:], strict=False):
        good = good & F.coalesce(F.col(earlier) <= F.col(later), F.lit(True))
    out = events.agg(F.count("*").alias("n"), F.coalesce(F.sum(good.cast("long")), F.lit(0)).alias("in_order"))
    return out.withColumn("rate", F.when(F.col("n") == 0, 1.0).otherwise(F.col("in_order") / F.col("n")))


def fraud_counts(payments: DataFrame, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., payments, frauds, rate): how many payments are fraud by their truth; a null truth is none."""
    out = payments.groupBy(*by).agg(F.count("*").alias("payments"), F.sum(F.coalesce(truth, F.lit(False)).cast("long")).alias("frauds"))
    return out.withColumn("rate", F.when(F.col("payments") == 0, 0.0).otherwise(F.col("frauds") / F.col("payments")))


def run_report(rows: DataFrame, id_: str, valid: Column, truth: Column, times: Sequence[str] = ENVELOPE_TIMES) -> DataFrame:
    """(metric, value): correctness of a run: unique, valid and ordered shares, and prevalence; each 1 or 0 when empty."""
    ordered = envelope_order(rows, times).select(F.col("rate")).scalar()
    unique = key_summary(rows, id_).select("unique_rate").scalar()
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    wide = rows.agg(share(valid).alias("valid_rate"), share(truth).alias("prevalence")).withColumns({"order_rate": ordered, "unique_rate": unique})
    return wide.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("unique_rate", "valid_rate", "order_rate", "prevalence")])).alias("x")).select("x.*")
