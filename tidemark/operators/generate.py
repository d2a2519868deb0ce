"""Row producers: entities, payments, their lifecycle, ledger entries, fraud and workflow, from hashes of ordinals.

Every value is a function of (seed, stream, ordinal): the number of partitions changes nothing, and any range of
ordinals can be produced alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import DAY, MICROS, bounded_lognormal, hash_uniform, weighted_choice

#: 2024-01-01 in microseconds.
START = 1_704_067_200 * MICROS
RAILS = {"CARD": 0.6, "PIX": 0.3, "ACCOUNT_TRANSFER": 0.1}
#: Chances on the way of a payment, and how many seconds each step takes.
CHANCES = {"card_approved": 0.9, "reversed": 0.05, "refunded": 0.1, "charged_back": 0.0, "pix_approved": 0.98, "pix_rejected": 0.02, "timeout": 0.0, "returned": 0.05}
SECONDS = {
    "CARD_AUTHORIZATION_REQUESTED": 1,
    "CARD_AUTHORIZED": 1,
    "CARD_DECLINED": 1,
    "CARD_CAPTURED": 5,
    "CARD_CLEARED": 30,
    "CARD_SETTLED": 60,
    "CARD_REVERSED": 10,
    "CARD_REFUNDED": 60,
    "CARD_CHARGEBACK_CREATED": 86_400,
    "CARD_CHARGEBACK_RESOLVED": 86_400,
    "PIX_VALIDATED": 1,
    "PIX_AUTHORIZED": 1,
    "PIX_REJECTED": 1,
    "PIX_SUBMITTED": 1,
    "PIX_TIMEOUT": 1,
    "PIX_SETTLED": 1,
    "PIX_RECEIVED": 1,
    "PIX_RETURN_REQUESTED": 60,
    "PIX_RETURNED": 60,
}
#: Seconds until an event is available at its source, by rail; ingestion and processing follow a second apart.
SOURCE_SECONDS = {"CARD": 5, "PIX": 2, "ACCOUNT_TRANSFER": 5}
POSTED, TAKEN_BACK = ("PIX_SETTLED", "TRANSFER_COMPLETED", "CARD_SETTLED"), ("PIX_RETURNED", "CARD_REFUNDED", "CARD_CHARGEBACK_RESOLVED")


def _id(prefix: str, ordinal: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(ordinal.cast("string"), 12, "0"))


def _pick(stream: str, key: Column, count: int) -> Column:
    return F.floor(hash_uniform(stream, key) * count).cast("long")


def customers(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(_id("CUS-", i).alias("customer_id"), weighted_choice(f"{seed}/country", i, {"BR": 0.7, "US": 0.2, "PT": 0.1}).alias("country"), weighted_choice(f"{seed}/risk", i, {"LOW": 0.8, "MEDIUM": 0.15, "HIGH": 0.05}).alias("risk_segment"), (F.lit(START) - _pick(f"{seed}/since", i, 1000) * DAY).alias("registered"))


def accounts(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(_id("ACC-", i).alias("account_id"), _id("CUS-", i).alias("customer_id"), F.round(bounded_lognormal(f"{seed}/opening", i, 2000.0, 1.0, 0.0, 1e6), 2).alias("opening_balance"))


def payments(spark: SparkSession, first: int, last: int, population: int, seed: int = 42) -> DataFrame:
    """Payments with ordinals first to last - 1; payee and payer differ when there are two accounts."""
    i = F.col("id")
    payer = _pick(f"{seed}/payer", i, population)
    payee = (payer + 1 + _pick(f"{seed}/payee", i, max(1, population - 1))) % population
    t = F.lit(START) + i * 20 * MICROS + F.floor(hash_uniform(f"{seed}/time", i) * 20 * MICROS)
    return spark.range(first, last).select(
        _id("PAY-", i).alias("payment_id"), weighted_choice(f"{seed}/rail", i, RAILS).alias("payment_rail"), _id("ACC-", payer).alias("payer_account_id"), _id("ACC-", payee).alias("payee_account_id"),
        F.round(bounded_lognormal(f"{seed}/amount", i, 80.0, 0.65, 1.0, 50_000.0), 2).alias("amount"), t.cast("long").alias("initiated"),
    )


def path(rail: Column, key: Column, seed: int = 42, chances: dict[str, float] | None = None) -> Column:
    """The states a payment goes through, by hashes of its key: an array of names."""
    p = CHANCES | (chances or {})
    hit = lambda name: hash_uniform(f"{seed}/{name}", key) < p[name]
    steps = lambda *names: F.array(*[F.lit(n) for n in names])
    maybe = lambda condition, *names: F.when(condition, steps(*names)).otherwise(F.array().cast("array<string>"))
    backed = maybe(hit("charged_back"), "CARD_CHARGEBACK_CREATED", "CARD_CHARGEBACK_RESOLVED")
    settled = F.concat(steps("CARD_CAPTURED", "CARD_CLEARED", "CARD_SETTLED"), maybe(hit("refunded"), "CARD_REFUNDED"), backed)
    undone = F.when(hash_uniform(f"{seed}/early", key) < 0.5, steps("CARD_REVERSED")).otherwise(steps("CARD_CAPTURED", "CARD_REVERSED"))
    approved = F.concat(steps("CARD_AUTHORIZED"), F.when(hit("reversed"), undone).otherwise(settled))
    card = F.concat(steps("CARD_PAYMENT_INITIATED", "CARD_AUTHORIZATION_REQUESTED"), F.when(hit("card_approved"), approved).otherwise(steps("CARD_DECLINED")))
    received = F.concat(steps("PIX_SETTLED", "PIX_RECEIVED"), maybe(hit("returned"), "PIX_RETURN_REQUESTED", "PIX_RETURNED"))
    sent = F.concat(steps("PIX_AUTHORIZED", "PIX_SUBMITTED"), F.when(hit("timeout"), steps("PIX_TIMEOUT")).otherwise(received))
    pix = F.concat(steps("PIX_INITIATED", "PIX_VALIDATED"), F.when(hit("pix_approved") & ~hit("pix_rejected"), sent).otherwise(steps("PIX_REJECTED")))
    return F.when(rail == "CARD", card).when(rail == "PIX", pix).otherwise(steps("TRANSFER_COMPLETED"))


def lifecycle(payment: DataFrame, seed: int = 42, chances: dict[str, float] | None = None, states: Column | None = None) -> DataFrame:
    """The events of each payment: its states (by default those of path) with their causes and times, strictly later one after the other."""
    took = F.create_map(*[F.lit(x) for kv in SECONDS.items() for x in kv])
    walked = payment.withColumn("_path", path(F.col("payment_rail"), F.col("payment_id"), seed, chances) if states is None else states)
    offset = F.transform("_path", lambda s, k: F.struct(s.alias("event_type"), F.aggregate(F.slice("_path", 1, k + 1), F.lit(0), lambda sum_, x: sum_ + F.coalesce(took[x], F.lit(0))).alias("seconds")))
    rows = walked.select("*", F.posexplode(offset).alias("step", "state")).drop("_path")
    number = lambda step: F.concat_ws("-", F.regexp_replace("payment_id", "PAY", "EVT"), step.cast("string"))
    at = F.col("initiated") + F.col("state.seconds").cast("long") * MICROS
    return rows.select(
        number(F.col("step")).alias("event_id"), "payment_id", F.col("state.event_type").alias("event_type"), at.alias("event_time"), *event_times(at, F.col("payment_rail")),
        F.when(F.col("step") > 0, number(F.col("step") - 1)).alias("causation_id"), F.col("payment_id").alias("correlation_id"), "payment_rail", "payer_account_id", "payee_account_id", "amount",
    )


def event_times(at: Column, rail: Column) -> list[Column]:
    """source_available_at, ingested_at and processed_at of an event."""
    source = at + F.create_map(*[F.lit(x) for kv in SOURCE_SECONDS.items() for x in kv])[rail].cast("long") * MICROS
    return [source.alias("source_available_at"), (source + MICROS).alias("ingested_at"), (source + 2 * MICROS).alias("processed_at")]


def ledger_entries(events: DataFrame) -> DataFrame:
    """A debit and a credit for each event that posts money, the other way round where money is taken back; none without a payee."""
    posting = events.where(F.col("event_type").isin(*POSTED, *TAKEN_BACK) & F.col("payee_account_id").isNotNull())
    back = F.col("event_type").isin(*TAKEN_BACK)
    entry = lambda side, account: F.struct(F.lit(side).alias("entry_type"), account.alias("account_id"))
    payer, payee = F.col("payer_account_id"), F.col("payee_account_id")
    sides = F.explode(F.array(entry("DEBIT", F.when(back, payee).otherwise(payer)), entry("CREDIT", F.when(back, payer).otherwise(payee))))
    return posting.select("event_id", "payment_id", "amount", F.col("event_time").alias("effective_at"), F.col("processed_at").alias("posted_at"), sides.alias("s")).select("event_id", "payment_id", "s.entry_type", "s.account_id", "amount", "effective_at", "posted_at")
