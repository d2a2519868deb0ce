"""The point-in-time dataset: one row for each payment with what was known of it, and nothing later, at its prediction time.

Everything a row has was available at T = its initial event's source_available_at plus a delay: earlier payments of the customer and
device, mature labels, posted ledger entries, and the entities themselves. Frames are those of `frames`, so time grows with the rows.

Times are microseconds since the epoch. Tables and their columns:
payments: payment_id, event_id, customer_id, account_id, merchant_id, card_id, device_id, payment_rail, payment_type, amount, online,
  event_time, source_available_at
accounts: account_id, ledger_balance, credit_limit, opening_date, valid_from, valid_to, system_from
merchants: merchant_id, country, created_at; devices: device_id, first_seen_at, trusted; cards: card_id, issued_at
labels: payment_id, customer_id, merchant_id, label, amount, fraud_occurred_at, fraud_confirmed_at, label_available_at, fraud_truth
entries: account_id, entry_type, amount, effective_at, posted_at
observations (optional): payment_id, version, observed_label, available

Nulls: a null merchant, device or card passes through and has no entity; device frames and merchant rates take null as equal to
null. Payments without an account that is valid at T are violations. Copies of a payment with equal contents fold into one row; a
payment id with different contents is a violation. Empty tables give an empty dataset.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import DAY, MICROS, whole_days
from tidemark.functions.shipping import stored
from tidemark.operators.frames import Frame, frames
from tidemark.operators.point_in_time import latest_as_of
from tidemark.operators.quality import assert_none
from tidemark.operators.records import exact_dedup

#: The default width of each frame in seconds.
WINDOWS = {
    "transaction_count_1m": 60,
    "transaction_count_5m": 300,
    "transaction_count_1h": 3_600,
    "transaction_count_24h": 86_400,
    "transaction_count_7d": 604_800,
    "transaction_count_30d": 2_592_000,
    "transaction_amount_1h": 3_600,
    "transaction_amount_24h": 86_400,
    "transaction_amount_7d": 604_800,
    "avg_transaction_amount_30d": 2_592_000,
    "distinct_merchants_1d": 86_400,
    "distinct_merchants_30d": 2_592_000,
    "merchant_fraud_rate_historical": 31_536_000,
    "distinct_countries_24h": 86_400,
    "device_customer_count_30d": 2_592_000,
    "customers_per_device_24h": 86_400,
    "confirmed_fraud_count_90d": 7_776_000,
    "fraud_loss_365d": 31_536_000,
}
#: Event types that open a payment.
INITIAL = ("CARD_PAYMENT_INITIATED", "CARD_AUTHORIZATION_REQUESTED", "PIX_INITIATED", "TRANSFER_COMPLETED")
FEATURES = (
    "amount", "payment_rail", "payment_type", "merchant_id", "card_id", "device_id", "online",
    "transaction_count_1m", "transaction_count_5m", "transaction_count_1h", "transaction_count_24h", "transaction_count_7d", "transaction_count_30d",
    "transaction_amount_1h", "transaction_amount_24h", "transaction_amount_7d", "avg_transaction_amount_30d", "max_transaction_amount_7d", "amount_vs_customer_avg",
    "distinct_merchants_1d", "distinct_merchants_30d", "new_merchant_flag", "merchant_fraud_rate_historical", "distinct_countries_24h", "new_country_flag",
    "device_age_days", "new_device_flag", "trusted_device_flag", "device_customer_count_30d", "customers_per_device_24h",
    "account_age_days", "balance", "available_balance", "credit_limit", "credit_utilization",
    "days_since_last_payment", "confirmed_fraud_count_90d", "fraud_loss_365d", "days_since_last_confirmed_fraud",
)
COLUMNS = (
    "dataset_row_id", "payment_id", "event_id", "customer_id", "account_id", "prediction_time", "business_event_time", "event_time",
    "source_available_at", "feature_available_at", "label_available_at", "label", "fraud_truth", *FEATURES, "split",
)


def initial_events(events: DataFrame) -> DataFrame:
    """The events that open a payment: of an opening type, and without a cause."""
    return events.where(F.col("event_type").isin(*INITIAL) & F.col("causation_id").isNull())


def source_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """violations(rule, key, detail): payments with several contents, without an account, or that are available before they happen;
    labels of no payment; entries of no account."""
    payments, accounts = tables["payments"], tables["accounts"]
    row = lambda rule, key, detail: [F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail")]
    _, conflicts = exact_dedup(payments, "payment_id")
    found = [
        conflicts.select(*row("payment_conflict", F.col("payment_id"), F.col("contents"))),
        payments.join(accounts, "account_id", "left_anti").select(*row("unknown_account", F.col("payment_id"), F.col("account_id"))),
        payments.where("source_available_at < event_time").select(*row("availability", F.col("payment_id"), F.col("source_available_at"))),
        tables["labels"].join(payments, "payment_id", "left_anti").select(*row("unknown_payment", F.col("payment_id"), F.col("label"))),
        tables["entries"].join(accounts, "account_id", "left_anti").select(*row("unknown_entry_account", F.col("account_id"), F.col("amount"))),
    ]
    return reduce(DataFrame.unionByName, found)


def build(tables: Mapping[str, DataFrame], *, run_id: str, delay: int = 0, start: int | None = None, end: int | None = None, windows: Mapping[str, int] | None = None, unresolved: str = "include", split: Column | None = None, check: bool = True) -> DataFrame:
    """The dataset with COLUMNS; delay in microseconds. unresolved: include or exclude rows whose label is not mature.

    split: a column over prediction_time; rows without one are dropped. check: raise ValueError for sources that contradict themselves.
    """
    if unresolved not in ("include", "exclude"):
        raise ValueError("unresolved is include or exclude")
    if check:
        assert_none(source_violations(tables))
    w = {n: s * MICROS for n, s in (WINDOWS | dict(windows or {})).items()}
    payments, _ = exact_dedup(tables["payments"], "payment_id")
    p = payments.withColumns({"t": F.col("event_time"), "available": F.col("source_available_at"), "now": F.col("source_available_at") + delay})
    merchants = tables["merchants"].select("merchant_id", F.col("country"), F.col("created_at").alias("_merchant_at"))
    devices = tables["devices"].select("device_id", F.col("first_seen_at").alias("_device_at"), F.col("trusted").alias("_trusted"))
    p = p.join(merchants, "merchant_id", "left").join(devices, "device_id", "left").join(tables["cards"].select("card_id", F.col("issued_at").alias("_card_at")), "card_id", "left")
    accounts = tables["accounts"].select("account_id", "ledger_balance", "credit_limit", "opening_date", "valid_from", "valid_to", "system_from")
    p = stored(p.join(accounts, "account_id", "left"), "payments")  # read by every group of features
    inside = (F.lit(True) if start is None else F.col("now") >= start) & (F.lit(True) if end is None else F.col("now") < end)
    asked = p if start is None and end is None else p.where(inside)
    if check:
        stale = asked.where(F.col("opening_date").isNull() | (F.col("now") < F.col("valid_from")) | (F.col("now") >= F.col("valid_to")))
        assert_none(stale.select(F.lit("no_valid_account").alias("rule"), F.col("payment_id").cast("string").alias("key"), F.col("account_id").cast("string").alias("detail")))

    of_customer = {n: Frame("count", w[n]) for n in w if n.startswith("transaction_count")}
    of_customer |= {n: Frame("sum", w[n], "amount") for n in w if n.startswith("transaction_amount")}
    month = w["avg_transaction_amount_30d"]
    of_customer |= {
        "_sum": Frame("sum", month, "amount"),
        "_count": Frame("count", month),
        # The largest amount goes by the frame of transaction_amount_7d; it has none of its own.
        "max_transaction_amount_7d": Frame("max", w["transaction_amount_7d"], "amount"),
        "distinct_merchants_1d": Frame("distinct", w["distinct_merchants_1d"], "merchant_id"),
        "distinct_merchants_30d": Frame("distinct", w["distinct_merchants_30d"], "merchant_id"),
        "_merchant_seen": Frame("seen", w["distinct_merchants_30d"], "merchant_id"),
        "distinct_countries_24h": Frame("distinct", w["distinct_countries_24h"], "country"),
        "_country_seen": Frame("seen", w["distinct_merchants_30d"], "country"),
        "_device_seen": Frame("seen", w["transaction_count_30d"], "device_id"),
        "_last": Frame("max", None, "t_"),
    }
    known, queries = p.withColumn("t_", F.col("t")), asked.withColumn("t_", F.col("t"))
    parts = [frames(known, queries, ["customer_id"], of_customer, id_="payment_id")]
    on_device = {n: Frame("distinct", w[n], "customer_id") for n in ("device_customer_count_30d", "customers_per_device_24h")}
    parts.append(frames(known, queries, ["device_id"], on_device, id_="payment_id"))
    parts += [_label_features(stored(tables["labels"], "labels"), asked, w), _balances(stored(tables["entries"], "entries"), asked), _latest_event(p, asked)]
    out = asked
    for part in parts:
        out = out.join(stored(part, "features"), "payment_id")  # one plan of all groups takes the driver's memory, and longer than the rows take
    out = _with_label(out, tables, unresolved)
    mean = F.when(F.col("_count") > 0, F.col("_sum").cast("double") / F.col("_count"))
    balance = F.col("ledger_balance") + F.col("_moved").cast("double")
    days = lambda at: F.coalesce((F.col("now") - F.col(at)) / float(DAY), F.lit(-1.0))
    latest = F.greatest(*[F.col(c) for c in ("source_available_at", "_event_at", "_label_at", "opening_date", "valid_from", "system_from", "_posted_at", "_merchant_at", "_device_at", "_card_at")])
    out = out.withColumns({
        **{n: F.col(n).cast("double") for n in of_customer if n.startswith("transaction_amount")},
        "avg_transaction_amount_30d": mean,
        "amount_vs_customer_avg": F.when(mean.isNotNull(), F.try_divide("amount", mean)),
        "new_merchant_flag": F.col("merchant_id").isNotNull() & ~F.col("_merchant_seen"),
        "new_country_flag": F.col("country").isNotNull() & ~F.col("_country_seen"),
        "new_device_flag": F.col("device_id").isNotNull() & ~F.col("_device_seen"),
        "device_age_days": whole_days(F.col("now"), F.col("_device_at")).cast("double"),
        "trusted_device_flag": F.coalesce("_trusted", F.lit(False)),
        "account_age_days": whole_days(F.col("now"), F.col("opening_date")).cast("double"),
        "balance": balance,
        "available_balance": balance,
        "credit_utilization": F.when(F.col("credit_limit") > 0, (F.col("credit_limit") - balance) / F.col("credit_limit")).otherwise(0.0),
        "days_since_last_payment": days("_last"),
        "days_since_last_confirmed_fraud": days("_last_fraud"),
        "prediction_time": F.col("now"),
        "business_event_time": F.col("event_time"),
        "feature_available_at": latest,
        "dataset_row_id": row_id(run_id, F.col("payment_id"), F.col("now")),
    })
    out = out.withColumn("device_age_days", F.when(F.col("_device_at").isNotNull(), F.col("device_age_days"))).withColumn("split", F.lit("all") if split is None else split)
    return out.where(F.col("split").isNotNull()).select(*COLUMNS)


def row_id(run_id: str, payment: Column, at: Column) -> Column:
    """DSR- and 24 hex digits of the SHA-256 of run, payment and ISO time."""
    whole = F.date_format(F.timestamp_micros(at), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.when(at % MICROS == 0, "").otherwise(F.concat(F.lit("."), F.lpad((at % MICROS).cast("string"), 6, "0")))
    return F.concat(F.lit("DSR-"), F.substring(F.sha2(F.concat_ws("|", F.lit(run_id), payment.cast("string"), F.concat(whole, part, F.lit("+00:00"))), 256), 1, 24))


def _label_features(labels: DataFrame, asked: DataFrame, w: Mapping[str, int]) -> DataFrame:
    """Per payment what mature labels of other payments say of its customer and merchant, and when the last of them came."""
    known = labels.select("payment_id", "customer_id", "merchant_id", F.col("fraud_occurred_at").alias("t"), F.col("label_available_at").alias("available"), F.col("amount").alias("loss"), (F.col("label") == "FRAUD").alias("fraud"), F.col("fraud_confirmed_at").isNotNull().alias("sure"))
    known = known.withColumns({"is_fraud": F.col("fraud").cast("int"), "occurred": F.col("t"), "came": F.col("available"), "all": F.lit(0)})
    fraud = known.where("fraud and sure")
    everywhere = asked.withColumn("all", F.lit(0))
    own = known.select("payment_id", "t", "available", "loss", "is_fraud", "fraud", "sure")

    def queries(by: str, chosen: Column) -> DataFrame:
        """A payment's own label is one of the values, if it has one that is chosen; it is left out."""
        mine = own.where(chosen).drop("fraud", "sure")
        return everywhere.select("payment_id", by, "now").join(mine, "payment_id", "left")

    sure = F.col("fraud") & F.col("sure")
    customer = {"confirmed_fraud_count_90d": Frame("count", w["confirmed_fraud_count_90d"]), "_loss": Frame("sum", w["fraud_loss_365d"], "loss"), "_last_fraud": Frame("max", w["fraud_loss_365d"], "occurred")}
    merchant = {"_labels": Frame("count", w["merchant_fraud_rate_historical"]), "_frauds": Frame("sum", w["merchant_fraud_rate_historical"], "is_fraud"), "_came": Frame("max", w["merchant_fraud_rate_historical"], "came")}
    everyone = frames(fraud, queries("all", sure), ["all"], {"_any": Frame("max", None, "came")}, id_="payment_id")
    out = frames(fraud, queries("customer_id", sure), ["customer_id"], customer, id_="payment_id")
    out = out.join(frames(known, queries("merchant_id", F.lit(True)), ["merchant_id"], merchant, id_="payment_id"), "payment_id").join(everyone, "payment_id")
    rate = F.when(F.col("_labels") > 0, F.col("_frauds").cast("double") / F.col("_labels")).otherwise(0.0)
    return out.select("payment_id", "confirmed_fraud_count_90d", F.col("_loss").cast("double").alias("fraud_loss_365d"), "_last_fraud", rate.alias("merchant_fraud_rate_historical"), F.greatest("_any", "_came").alias("_label_at"))


def _balances(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """Per payment the sum of its account's entries that are effective before T and posted by T, and when the last was posted."""
    delta = F.when(F.col("entry_type") == "CREDIT", F.col("amount")).otherwise(-F.col("amount"))
    known = entries.select("account_id", F.col("effective_at").alias("t"), F.col("posted_at").alias("available"), delta.alias("delta"), F.col("posted_at").alias("posted"))
    numbered = known.withColumn("payment_id", F.lit("entry"))  # no payment's id: nothing is left out
    queries = asked.select(F.concat(F.lit("payment/"), F.col("payment_id").cast("string")).alias("payment_id"), F.col("payment_id").alias("own"), "account_id", "now")
    found = frames(numbered, queries, ["account_id"], {"_moved": Frame("sum", None, "delta"), "_posted_at": Frame("max", None, "posted")}, id_="payment_id")
    return queries.join(found, "payment_id").select(F.col("own").alias("payment_id"), "_moved", "_posted_at")


def _latest_event(payments: DataFrame, asked: DataFrame) -> DataFrame:
    """Per payment when the last event of any customer that it could know became available."""
    known = payments.select(F.lit(0).alias("all"), "payment_id", "t", "available", F.col("available").alias("x"))
    return frames(known, asked.select(F.lit(0).alias("all"), "payment_id", "now"), ["all"], {"_event_at": Frame("max", None, "x")}, id_="payment_id")


def _with_label(rows: DataFrame, tables: Mapping[str, DataFrame], unresolved: str) -> DataFrame:
    """rows with label, label_available_at and fraud_truth: an observed version wins over the label; both only count once mature."""
    labels = tables["labels"].select("payment_id", F.col("label").alias("_label"), F.col("label_available_at").alias("_at"), F.col("fraud_truth").alias("_truth"))
    out = rows.join(labels, "payment_id", "left")
    if "observations" in tables:
        versions = tables["observations"].select("payment_id", F.col("available").alias("_seen_at"), F.col("version").alias("_version"), F.col("observed_label").alias("_observed"))
        out = latest_as_of(out, versions, "payment_id", "now", "_seen_at", "_version", ["_seen_at", "_version", "_observed"])
        has = out.join(versions.select("payment_id").distinct().withColumn("_has", F.lit(True)), "payment_id", "left")
        out = has.withColumn("_has", F.coalesce("_has", F.lit(False)))
    else:
        out = out.withColumns({"_seen_at": F.lit(None).cast("long"), "_version": F.lit(None).cast("int"), "_observed": F.lit(None).cast("string"), "_has": F.lit(False)})
    mature = F.when(F.col("_has"), F.coalesce(F.col("_version") > 0, F.lit(False))).otherwise(F.coalesce(F.col("_at") <= F.col("now"), F.lit(False)))
    out = out.withColumn("_mature", mature)
    if unresolved == "exclude":
        out = out.where("_mature")
    return out.withColumns({
        "label_available_at": F.when(F.col("_has"), F.col("_seen_at")).otherwise(F.col("_at")),
        "label": F.when(F.col("_mature"), F.when(F.col("_has"), F.col("_observed")).otherwise(F.col("_label"))),
        "fraud_truth": F.when(F.col("_mature") & ~F.col("_has"), F.col("_truth")),
    })


def labelled(rows: DataFrame, label: str = "label") -> DataFrame:
    """The rows whose label is FRAUD or LEGITIMATE."""
    return rows.where(F.col(label).isin("FRAUD", "LEGITIMATE"))


def write(dataset: DataFrame, path: str, times: Sequence[str] = ("prediction_time", "business_event_time", "event_time", "source_available_at", "feature_available_at", "label_available_at")) -> None:
    """The dataset as Parquet with timestamps, where there is none yet."""
    dataset.withColumns({c: F.timestamp_micros(c) for c in times}).write.mode("errorifexists").parquet(path)


def isolation_violations(whole: DataFrame, prefix: DataFrame, cutoff: int) -> DataFrame:
    """violations(rule, key, detail): rows before the cutoff that differ between the whole history's dataset and that of a prefix of it."""
    before = lambda d: d.where(F.col("prediction_time") < cutoff).select("dataset_row_id", F.xxhash64(*[c for c in COLUMNS if c != "split"]).alias("_h"))
    a, b = before(whole).withColumnRenamed("_h", "a"), before(prefix).withColumnRenamed("_h", "b")
    both = a.join(b, "dataset_row_id", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    why = F.when(F.col("a").isNull(), "only_prefix").when(F.col("b").isNull(), "only_whole").otherwise("changed")
    return both.select(F.lit("future_leak").alias("rule"), F.col("dataset_row_id").alias("key"), why.alias("detail"))
