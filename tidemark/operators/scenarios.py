"""Fraud scenarios, their legitimate lookalikes, and the workflow that follows them.

A campaign is a slot of its scenario; its target, payee, device and amounts are draws of the campaign's id, so attempts are
one explode and nothing is joined. Without the entities a scenario needs (a card, two accounts) it has no campaigns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import MICROS
from tidemark.operators import generate, ledger
from tidemark.operators.generate import START, _id
from tidemark.operators.population import Draws, Population, account_columns, card_columns

#: The trigger of each scenario and of its lookalike.
TRIGGERS = {
    "F01": ("CNP_NEW_DEVICE", "TRAVEL_NEW_DEVICE"),
    "F02": ("LOW_VALUE_AUTHORIZATION_BURST", "LEGITIMATE_LOW_VALUE_BURST"),
    "F03": ("NEW_BENEFICIARY", "NEW_PHONE_TRAVEL_LEGITIMATE_BENEFICIARY"),
    "F04": ("NEW_BENEFICIARY_HIGH_VALUE", "LEGITIMATE_NEW_BENEFICIARY"),
    "F05": ("PAYMENT_VELOCITY_BURST", "LEGITIMATE_ACTIVITY_BURST"),
}
REPEAT_TRANSFER, TAKEOVER_DEVICE = "REPEAT_TRANSFER", "NEW_UNTRUSTED_DEVICE"
SIGNALS = ("FRAUD_AUTHENTICATION_SUSPICIOUS", "FRAUD_PROFILE_CHANGED", "FRAUD_BENEFICIARY_ADDED")
BURSTS, ON_CARDS, CARD_ATTEMPTS = ("F02", "F05"), ("F01", "F02", "F05"), 3
ALERT, OPEN, CONFIRM, DISPUTE, LABEL = 60, 300, 86_400, 172_800, 3_600


@dataclass(frozen=True)
class Scenario:
    """How often a scenario is planted and within which bounds."""

    weight: float = 1.0
    count: int = 1
    amount_min: float = 1.0
    amount_max: float = 50_000.0
    attempts: int = 20
    window: int = 60


def campaigns(spark: SparkSession, settings: dict[str, Scenario], payments: int, target_rate: float, most: int, seed: int = 42) -> DataFrame:
    """(scenario_type, scenario_id) of the planted campaigns.

    Their number is the least of most, payments times target_rate and the slots of all scenarios; slots are drawn without
    replacement by weight, each by a key of its own.
    """
    chosen = {k: s for k, s in sorted(settings.items()) if s.weight > 0 and s.count > 0}
    wanted = min(most, int(payments * target_rate), sum(s.count for s in chosen.values()))
    slots = [spark.range(s.count).select(F.lit(k).alias("scenario_type"), F.concat(F.lit(f"{k}-"), _id("", F.col("id"))).alias("scenario_id"), F.lit(float(s.weight)).alias("_w")) for k, s in chosen.items()]
    if not slots or wanted <= 0:
        return spark.range(0).select(F.lit("").alias("scenario_type"), F.lit("").alias("scenario_id"))
    drawn = reduce(DataFrame.unionByName, slots)
    return drawn.orderBy(-F.log(F.lit(1.0) - Draws(seed, "campaigns", "scenario_id").u("slot")) / F.col("_w"), "scenario_id").limit(wanted).select("scenario_type", "scenario_id")


def _by_type(values: dict[str, Column | float | int]) -> Column:
    return F.coalesce(*[F.when(F.col("scenario_type") == k, v if isinstance(v, Column) else F.lit(v)) for k, v in values.items()])


def attempts(planted: DataFrame, p: Population, settings: dict[str, Scenario], *, lookalikes: bool = True) -> DataFrame:
    """The payments of the campaigns, and of a legitimate lookalike of each.

    Columns: those of generate.payments, and scenario_type, scenario_id, attempt, trigger, fraud_truth, customer_id, card_id,
    merchant_id, device_id, pix_key_id (null where the rail has none), and path, the payment's states. Bounds that leave no
    amount (the payer's balance, half or a quarter of it in transfers) leave no payment.
    """
    possible = [k for k in TRIGGERS if (p.cards and p.accounts and p.merchants if k in ON_CARDS else p.accounts > 1 and (k != "F04" or p.pix_keys))]
    kinds = F.array(F.lit(True), F.lit(False)) if lookalikes else F.array(F.lit(True))
    base = planted.where(F.col("scenario_type").isin(*possible)).withColumn("fraud_truth", F.explode(kinds))
    base = base.withColumn("scenario_id", F.when(F.col("fraud_truth"), F.col("scenario_id")).otherwise(F.concat(F.lit("HN-"), "scenario_id")))
    number = _by_type({k: CARD_ATTEMPTS if k == "F01" else settings[k].attempts if k in BURSTS else 2 if k == "F03" else 1 for k in settings})
    c = Draws(p.seed, "campaigns", "scenario_id")
    on_card = F.col("scenario_type").isin(*ON_CARDS)
    base = base.withColumns({
        "_n": number,
        "_card": F.when(on_card, c.below("card", p.cards)),
        "_payer": F.when(on_card, Draws(p.seed, "cards", c.below("card", p.cards)).below("account", p.accounts)).otherwise(c.below("payer", p.accounts)),
    })
    base = base.withColumn("_payee", F.when(~on_card, (F.col("_payer") + 1 + c.below("payee", max(1, p.accounts - 1))) % max(1, p.accounts)))
    rows = base.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    key = F.concat_ws("-", "scenario_id", _id("", F.col("attempt")))
    a, owner = Draws(p.seed, "attempts", key), account_columns(p, F.col("_payer"))
    low = _by_type({k: max(s.amount_min, 0.75 * s.amount_max) if k == "F04" else s.amount_min for k, s in settings.items()})
    high = _by_type({k: min(s.amount_max, max(s.amount_min, 2 * s.amount_min)) if k == "F02" else s.amount_max for k, s in settings.items()})
    share = _by_type({"F03": F.when(F.col("fraud_truth"), 0.5).otherwise(0.25), "F04": F.lit(1.0)})
    high = F.when(share.isNull(), high).otherwise(F.least(high, owner["balance"] * share))
    one_amount = F.when(on_card, a.u("amount")).otherwise(c.u("amount"))  # both transfers of a takeover have the same amount
    offset = _by_type({k: F.floor((F.col("attempt") - 1) * settings[k].window / F.col("_n")).cast("long") if k in BURSTS else (F.col("attempt") + 2).cast("long") if k == "F03" else (F.col("attempt") - 1).cast("long") for k in settings})
    start = F.lit(START) + c.below("start", p.days * 86_400) * MICROS
    trigger = F.when((F.col("scenario_type") == "F03") & F.col("fraud_truth") & (F.col("attempt") == 2), REPEAT_TRANSFER).otherwise(_by_type({k: F.when(F.col("fraud_truth"), f).otherwise(ok) for k, (f, ok) in TRIGGERS.items()}))
    rows = rows.withColumns({"_low": low, "_high": high}).where((F.col("_high") >= F.col("_low")) & (F.col("_high") > 0))
    rail = _by_type({k: F.lit("CARD") if k in ON_CARDS else F.lit("ACCOUNT_TRANSFER" if k == "F03" else "PIX") for k in settings})
    payment = F.concat(F.lit("PAY-"), key)
    out = rows.select(
        payment.alias("payment_id"), rail.alias("payment_rail"), _id("ACC-", F.col("_payer")).alias("payer_account_id"), F.when(F.col("_payee").isNotNull(), _id("ACC-", F.col("_payee"))).alias("payee_account_id"),
        F.round(F.greatest(F.col("_low"), F.col("_low") + one_amount * (F.col("_high") - F.col("_low"))), 2).alias("amount"), (start + offset * MICROS).alias("initiated"), "scenario_type", "scenario_id", "attempt", trigger.alias("trigger"), "fraud_truth",
        owner["customer_id"].alias("customer_id"), F.when(on_card, card_columns(p, F.col("_card"))["card_id"]).alias("card_id"), F.when(on_card, a.ref("merchant", "MER-", p.merchants)).alias("merchant_id"), c.ref("device", "DEV-", p.devices).alias("device_id"),
        F.when(F.col("scenario_type") == "F04", c.ref("pix", "PIX-", p.pix_keys)).alias("pix_key_id"), "_n",
    )
    usual = generate.path(F.col("payment_rail"), F.col("payment_id"), p.seed)
    sure = generate.path(F.col("payment_rail"), F.col("payment_id"), p.seed, {"pix_approved": 1.0, "pix_rejected": 0.0})
    refused = F.col("fraud_truth") & (((F.col("scenario_type") == "F01") & (F.col("attempt") < F.col("_n"))) | ((F.col("scenario_type") == "F02") & (F.col("attempt") % 4 != 0)))
    states = F.when(F.col("scenario_type") == "F04", sure).when(refused & F.array_contains(usual, "CARD_AUTHORIZED"), F.concat(F.slice(usual, 1, F.array_position(usual, "CARD_AUTHORIZED").cast("int") - 1), F.array(F.lit("CARD_DECLINED")))).otherwise(usual)
    return out.withColumn("path", states).drop("_n")


def scenario_events(payments: DataFrame, seed: int = 42) -> DataFrame:
    """The payments' events, and the three signals before each account takeover, which cause its first transfer."""
    events = generate.lifecycle(payments, seed, states=F.col("path"))
    first = payments.where((F.col("scenario_type") == "F03") & F.col("fraud_truth") & (F.col("attempt") == 1))
    rows = first.select("*", F.posexplode(F.array(*map(F.lit, SIGNALS))).alias("step", "event_type"))
    signal = lambda k: F.concat(F.lit("EVT-"), "scenario_id", F.lit("-SIGNAL-"), k.cast("string"))
    at = F.col("initiated") + (F.col("step") - 3) * MICROS
    signals = rows.select(
        signal(F.col("step")).alias("event_id"), "payment_id", "event_type", at.alias("event_time"), *generate.event_times(at, F.lit("ACCOUNT_TRANSFER")),
        F.when(F.col("step") > 0, signal(F.col("step") - 1)).alias("causation_id"), F.col("payment_id").alias("correlation_id"), "payment_rail", "payer_account_id", "payee_account_id", "amount",
    )
    # payment ids end in the attempt's twelve digits; a lookalike's scenario starts with HN
    takeover = F.col("payment_id").startswith("PAY-F03-")
    scenario, nth = F.expr("substring(payment_id, 5, length(payment_id) - 17)"), F.expr("cast(right(payment_id, 12) as int)")
    before = F.when(nth == 1, F.concat(F.lit("EVT-"), scenario, F.lit("-SIGNAL-2"))).otherwise(F.concat(F.lit("EVT-"), scenario, F.lit("-"), F.lpad((nth - 1).cast("string"), 12, "0"), F.lit("-0")))
    return events.withColumn("causation_id", F.when(takeover & F.col("causation_id").isNull(), before).otherwise(F.col("causation_id"))).unionByName(signals)


def records(payments: DataFrame) -> DataFrame:
    """A record for each fraudulent payment, and one for each lookalike, of its first payment."""
    kept = payments.where(F.col("fraud_truth") | (F.col("attempt") == 1))
    ids = [F.concat(F.lit("FRD-"), F.substring("payment_id", 5, 1_000)).alias("fraud_record_id"), F.concat(F.lit("EVT-"), F.substring("payment_id", 5, 1_000), F.lit("-0")).alias("event_id")]
    entities = F.array_compact(F.array("customer_id", "payer_account_id", "payee_account_id", "card_id", "merchant_id", "pix_key_id"))
    return kept.select(*ids, "payment_id", "scenario_type", "scenario_id", "trigger", "fraud_truth", F.col("initiated").alias("occurred_at"), "payment_rail", "amount", "customer_id", F.col("payer_account_id").alias("account_id"), "card_id", "merchant_id", "device_id", entities.alias("affected_entity_ids"))


def investigate(found: DataFrame, loss: DataFrame, *, alerted: float = 1.0, opened: float = 1.0, confirmed: float = 1.0, disputed: float = 1.0, seed: int = 42) -> DataFrame:
    """What follows each fraud record, in one row: its alert, case, confirmation, dispute, outcome, loss and label.

    found has fraud_record_id, payment_id, payment_rail, occurred_at and fraud_truth; loss has (payment_id, loss). A step
    that does not happen has null times, and so have those after it; records without an alert are left out. A case closes
    with its last evidence, and its label is available an hour after. Only frauds are disputed.
    """
    d = Draws(seed, "workflow", "fraud_record_id")
    late = F.create_map(*[F.lit(x) for kv in generate.SOURCE_SECONDS.items() for x in kv])
    after = lambda c, seconds: F.col(c) + F.lit(seconds * MICROS)
    out = found.where(d.u("alert") <= alerted).withColumn("alert_created_at", F.col("occurred_at") + (F.coalesce(late[F.col("payment_rail")], F.lit(0)).cast("long") + 2 + ALERT) * MICROS)
    out = out.withColumn("case_opened_at", F.when(d.u("case") <= opened, after("alert_created_at", OPEN)))
    out = out.withColumns({"confirmed_at": F.when(d.u("confirm") <= confirmed, after("case_opened_at", CONFIRM)), "dispute_at": F.when(F.col("fraud_truth") & (d.u("dispute") <= disputed), after("case_opened_at", DISPUTE))})
    out = out.withColumn("dispute_processed_at", after("dispute_at", 4))
    closed = F.greatest("confirmed_at", "dispute_processed_at")
    outcome = F.when(F.col("case_opened_at").isNull(), None).when(F.col("confirmed_at").isNotNull(), F.when(F.col("fraud_truth"), "CONFIRMED_FRAUD").otherwise("FALSE_POSITIVE")).when(F.col("dispute_at").isNotNull(), "CUSTOMER_DISPUTE").otherwise("UNRESOLVED")
    out = out.withColumns({"case_closed_at": closed, "investigation_outcome": outcome, "label_available_at": F.greatest("case_opened_at", "occurred_at", closed) + F.when(closed.isNotNull(), F.lit(LABEL * MICROS))})
    out = out.withColumn("label", F.when(F.col("label_available_at").isNotNull(), F.when(F.col("investigation_outcome").isin("CONFIRMED_FRAUD", "CUSTOMER_DISPUTE"), "FRAUD").otherwise("LEGITIMATE")))
    lost = loss.select(F.col("payment_id").alias("_p"), "loss").dropDuplicates(["_p"])
    zero = F.lit(0).cast(ledger.MONEY)
    joined = out.join(lost, F.col("payment_id") == F.col("_p"), "left").drop("_p")
    return joined.withColumn("loss", F.when(F.col("investigation_outcome") == "CONFIRMED_FRAUD", F.coalesce("loss", zero)).otherwise(zero))


def final_status(payments: DataFrame) -> Column:
    """The state in which a payment ends, without its rail; RECEIVED counts as such, and a declined one as DECLINED."""
    return F.regexp_replace(F.element_at("path", -1), "^(CARD|PIX|TRANSFER)_", "")
