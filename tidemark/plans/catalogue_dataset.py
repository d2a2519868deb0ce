"""Queries of the point-in-time dataset, its sources, replay and backtests, over the tables seen as payments.

Each event is a payment of its user's account; suppliers are merchants, the device is the event's property. Labels, ledger entries
and entities follow from ids by fixed rules, the same in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import DAY, MICROS
from tidemark.functions.shipping import stored
from tidemark.operators import backtest, dataset, point_in_time, replay
from tidemark.plans.catalogue import EV, HOUR, MID, query
from tidemark.sources.tables import payment_events, read

#: Times of entities: 2020-01-01, 2019-01-01 and 2023-06-01.
OPENED, FOUNDED, FIRST_SEEN = 1_577_836_800 * MICROS, 1_546_300_800 * MICROS, 1_685_577_600 * MICROS
DELAY, RUN = 3 * DAY, "RUN-1"
SPLIT = (MID - 5 * DAY, MID + 5 * DAY, 2 * DAY)


def tables(spark, d) -> dict[str, DataFrame]:
    """The payment tables of operators.dataset from the driver's tables."""
    e, i = payment_events(spark, d), F.col("event_id")
    suppliers = read(spark, d, "supplier")
    shops = suppliers.agg(F.count("*")).scalar()
    merchant = F.when(F.col("category").isin("purchase", "view"), (i * 13 % shops).cast("long"))
    payments = e.select(
        F.concat(F.lit("P"), i.cast("string")).alias("payment_id"), F.concat(F.lit("E"), i.cast("string")).alias("event_id"), F.col("customer").alias("customer_id"), F.col("customer").alias("account_id"),
        merchant.alias("merchant_id"), F.when(F.col("category") == "purchase", F.col("customer") * 2).alias("card_id"), F.when(i % 10 != 0, F.col("device")).alias("device_id"),
        F.when(F.col("category") == "purchase", "CARD").when(F.col("category") == "view", "PIX").otherwise("ACCOUNT_TRANSFER").alias("payment_rail"), F.when(merchant.isNotNull(), "PURCHASE").otherwise("TRANSFER").alias("payment_type"),
        "amount", (i % 3 == 0).alias("online"), F.col("t").alias("event_time"), F.col("available").alias("source_available_at"),
    )
    users = e.select(F.col("customer").alias("c")).distinct()
    opened = F.lit(OPENED) + F.col("c") % 1000 * DAY
    none = F.lit(None).cast("long")
    accounts = users.select(F.col("c").alias("account_id"), (F.col("c") * 37 % 1000).cast("double").alias("ledger_balance"), (F.col("c") % 5 * 500).cast("double").alias("credit_limit"), opened.alias("opening_date"), opened.alias("valid_from"), none.alias("valid_to"), opened.alias("system_from"))
    cards = users.select((F.col("c") * 2).alias("card_id"), (opened + DAY).alias("issued_at"))
    merchants = suppliers.select(F.col("s_suppkey").cast("long").alias("merchant_id"), F.col("s_nationkey").alias("country"), F.lit(FOUNDED).alias("created_at"))
    devices = e.where("device is not null").select("device").distinct().select(F.col("device").alias("device_id"), (F.lit(FIRST_SEEN) + F.col("device").cast("long") * DAY).alias("first_seen_at"), (F.col("device").cast("long") % 2 == 0).alias("trusted"))
    own = payments.join(e.select(F.concat(F.lit("E"), i.cast("string")).alias("event_id"), i.alias("number")), "event_id").where("number % 5 = 0")
    fraud, t, n = F.col("number") % 25 == 0, F.col("event_time"), F.col("number")
    labels = own.select("payment_id", "customer_id", "merchant_id", F.when(fraud, "FRAUD").otherwise("LEGITIMATE").alias("label"), "amount", t.alias("fraud_occurred_at"), F.when(n % 50 == 0, t + DAY).alias("fraud_confirmed_at"), (t + 2 * DAY + n % 7 * HOUR).alias("label_available_at"), fraud.alias("fraud_truth"))
    entries = e.where("category = 'purchase'").select(F.col("customer").alias("account_id"), F.when(i % 2 == 0, "CREDIT").otherwise("DEBIT").alias("entry_type"), "amount", (F.col("t") + 2 * MICROS).alias("effective_at"), (F.col("t") + i % 4 * DAY).alias("posted_at"))
    observations = own.where("number % 15 = 0").select("payment_id", F.explode(F.array(*[F.struct(F.lit(v).alias("version"), label.alias("observed_label"), at.alias("available")) for v, label, at in ((0, F.lit(None).cast("string"), none), (1, F.lit("LEGITIMATE"), t + DAY), (2, F.lit("FRAUD"), t + 3 * DAY + n % 2 * DAY))])).alias("v")).select("payment_id", "v.*")
    return {"payments": payments, "accounts": accounts, "cards": cards, "merchants": merchants, "devices": devices, "labels": labels, "entries": entries, "observations": observations}


SOURCES = f"""{EV},
pay AS (SELECT event_id AS n, 'P' || event_id AS payment_id, 'E' || event_id AS event_id, customer AS customer_id, customer AS account_id, CASE WHEN category IN ('purchase', 'view') THEN event_id * 13 % (SELECT count(*) FROM supplier) END AS merchant_id,
  CASE WHEN category = 'purchase' THEN customer * 2 END AS card_id, CASE WHEN event_id % 10 <> 0 THEN device END AS device_id, CASE category WHEN 'purchase' THEN 'CARD' WHEN 'view' THEN 'PIX' ELSE 'ACCOUNT_TRANSFER' END AS payment_rail,
  CASE WHEN category IN ('purchase', 'view') THEN 'PURCHASE' ELSE 'TRANSFER' END AS payment_type, amount, event_id % 3 = 0 AS online, t, available, available + {DELAY} AS now FROM ev),
acc AS (SELECT DISTINCT customer AS c, (customer * 37 % 1000)::DOUBLE AS ledger_balance, (customer % 5 * 500)::DOUBLE AS credit_limit, {OPENED} + customer % 1000 * {DAY} AS opened FROM ev),
lab AS (SELECT payment_id, n, customer_id, merchant_id, CASE WHEN n % 25 = 0 THEN 'FRAUD' ELSE 'LEGITIMATE' END AS label, amount, t AS occurred, n % 50 = 0 AS sure, t + 2 * {DAY} + n % 7 * {HOUR} AS came, n % 25 = 0 AS truth FROM pay WHERE n % 5 = 0),
ent AS (SELECT customer AS account_id, CAST(amount AS DECIMAL(20,6)) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS delta, t + 2000000 AS effective, t + event_id % 4 * {DAY} AS posted FROM ev WHERE category = 'purchase'),
obs AS (SELECT payment_id, unnest([{{'v': 1, 'l': 'LEGITIMATE', 'at': t + {DAY}}}, {{'v': 2, 'l': 'FRAUD', 'at': t + 3 * {DAY} + n % 2 * {DAY}}}]) AS o FROM pay WHERE n % 15 = 0)"""


def _count(width: int, name: str) -> str:
    return f"count(*) FILTER (p.t >= q.now - {width * MICROS}) AS {name}"


PIT_SQL = f"""{SOURCES},
prior AS (SELECT q.payment_id, {", ".join(_count(w, n) for n, w in dataset.WINDOWS.items() if n.startswith("transaction_count"))},
  {", ".join(f"coalesce(sum(CAST(p.amount AS DECIMAL(20,6))) FILTER (p.t >= q.now - {w * MICROS}), 0)::DOUBLE AS {n}" for n, w in dataset.WINDOWS.items() if n.startswith("transaction_amount"))},
  sum(CAST(p.amount AS DECIMAL(20,6))) FILTER (p.t >= q.now - {30 * DAY})::DOUBLE / count(*) FILTER (p.t >= q.now - {30 * DAY}) AS avg30, max(p.amount) FILTER (p.t >= q.now - {7 * DAY}) AS max7,
  count(DISTINCT p.merchant_id) FILTER (p.t >= q.now - {DAY}) AS m1, count(DISTINCT p.merchant_id) FILTER (p.t >= q.now - {30 * DAY}) AS m30, coalesce(bool_or(p.merchant_id = q.merchant_id) FILTER (p.t >= q.now - {30 * DAY}), false) AS merchant_seen,
  count(DISTINCT ps.s_nationkey) FILTER (p.t >= q.now - {DAY}) AS c1, coalesce(bool_or(ps.s_nationkey = qs.s_nationkey) FILTER (p.t >= q.now - {30 * DAY}), false) AS country_seen,
  coalesce(bool_or(p.device_id = q.device_id) FILTER (p.t >= q.now - {30 * DAY}), false) AS device_seen, max(p.t) AS last_t
  FROM pay q JOIN pay p ON p.customer_id = q.customer_id AND p.payment_id <> q.payment_id AND p.t < q.now AND p.available <= q.now LEFT JOIN supplier ps ON ps.s_suppkey = p.merchant_id LEFT JOIN supplier qs ON qs.s_suppkey = q.merchant_id GROUP BY q.payment_id),
dev AS (SELECT q.payment_id, count(DISTINCT p.customer_id) AS d30, count(DISTINCT p.customer_id) FILTER (p.t >= q.now - {DAY}) AS d1
  FROM pay q JOIN pay p ON p.device_id IS NOT DISTINCT FROM q.device_id AND p.payment_id <> q.payment_id AND p.t < q.now AND p.available <= q.now AND p.t >= q.now - {30 * DAY} GROUP BY q.payment_id),
sure AS (SELECT * FROM lab WHERE label = 'FRAUD' AND sure),
cust AS (SELECT q.payment_id, count(*) FILTER (l.occurred >= q.now - {90 * DAY}) AS n90, sum(CAST(l.amount AS DECIMAL(20,6)))::DOUBLE AS loss, max(l.occurred) AS last_fraud
  FROM pay q JOIN sure l ON l.customer_id = q.customer_id AND l.payment_id <> q.payment_id AND l.came <= q.now AND l.occurred < q.now AND l.occurred >= q.now - {365 * DAY} GROUP BY q.payment_id),
mer AS (SELECT q.payment_id, avg((l.label = 'FRAUD')::INT) AS rate, max(l.came) AS came
  FROM pay q JOIN lab l ON l.merchant_id IS NOT DISTINCT FROM q.merchant_id AND l.payment_id <> q.payment_id AND l.came <= q.now AND l.occurred < q.now AND l.occurred >= q.now - {365 * DAY} GROUP BY q.payment_id),
known AS (SELECT q.payment_id, max(l.came) AS came FROM pay q JOIN sure l ON l.payment_id <> q.payment_id AND l.came <= q.now AND l.occurred < q.now GROUP BY q.payment_id),
bal AS (SELECT q.payment_id, sum(e.delta)::DOUBLE AS moved, max(e.posted) AS posted FROM pay q JOIN ent e ON e.account_id = q.account_id AND e.effective < q.now AND e.posted <= q.now GROUP BY q.payment_id),
newest AS (SELECT q.payment_id, p.available AS came FROM pay q ASOF JOIN (SELECT available, max(t) AS t FROM pay GROUP BY 1) p ON q.now >= p.available),
ver AS (SELECT q.payment_id, max({{'at': b.o.at, 'v': b.o.v, 'l': b.o.l}}) AS best FROM pay q JOIN obs b USING (payment_id) WHERE b.o.at <= q.now GROUP BY 1),
r AS (SELECT q.*, x.*, a.*, dev.*, cust.*, mer.*, bal.*, l.*, q.payment_id AS pid, q.n % 15 = 0 AS observed, mer.came AS mer_came, known.came AS known_came, newest.came AS event_came, l.came AS label_came, l.label AS own_label, ver.best AS best, s.s_nationkey AS country, a.ledger_balance + coalesce(bal.moved, 0) AS bal_now,
  CASE WHEN q.device_id IS NOT NULL THEN {FIRST_SEEN} + q.device_id::BIGINT * {DAY} END AS device_at, q.amount AS own_amount, q.t AS own_t, q.merchant_id AS own_merchant, q.customer_id AS own_customer
  FROM pay q JOIN acc a ON a.c = q.account_id LEFT JOIN prior x USING (payment_id) LEFT JOIN dev USING (payment_id) LEFT JOIN cust USING (payment_id) LEFT JOIN mer USING (payment_id) LEFT JOIN known USING (payment_id) LEFT JOIN bal USING (payment_id) LEFT JOIN newest USING (payment_id) LEFT JOIN lab l USING (payment_id) LEFT JOIN ver USING (payment_id) LEFT JOIN supplier s ON s.s_suppkey = q.merchant_id),
z AS (SELECT *, CASE WHEN observed THEN best IS NOT NULL ELSE coalesce(label_came <= now, false) END AS mature, CASE WHEN now < {SPLIT[0] - SPLIT[2]} THEN 'train' WHEN now >= {SPLIT[0]} AND now < {SPLIT[1] - SPLIT[2]} THEN 'validation' WHEN now >= {SPLIT[1]} THEN 'test' END AS split FROM r)
SELECT 'DSR-' || substr(sha256('{RUN}|' || pid || '|' || strftime(make_timestamp(now), '%Y-%m-%dT%H:%M:%S') || CASE WHEN now % 1000000 = 0 THEN '' ELSE '.' || lpad((now % 1000000)::VARCHAR, 6, '0') END || '+00:00'), 1, 24) AS dataset_row_id,
 pid AS payment_id, event_id, own_customer AS customer_id, account_id, now AS prediction_time, own_t AS business_event_time, own_t AS event_time, available AS source_available_at,
 greatest(available, event_came, known_came, mer_came, opened, posted, CASE WHEN own_merchant IS NOT NULL THEN {FOUNDED} END, device_at, CASE WHEN card_id IS NOT NULL THEN opened + {DAY} END) AS feature_available_at,
 CASE WHEN observed THEN best.at ELSE label_came END AS label_available_at, CASE WHEN mature THEN CASE WHEN observed THEN best.l ELSE own_label END END AS label, CASE WHEN mature AND NOT observed THEN truth END AS fraud_truth,
 own_amount AS amount, payment_rail, payment_type, own_merchant AS merchant_id, card_id, device_id, online,
 {", ".join(f"coalesce({n}, 0) AS {n}" for n in dataset.WINDOWS if n.startswith("transaction_count"))}, {", ".join(f"round(coalesce({n}, 0), 6) AS {n}" for n in dataset.WINDOWS if n.startswith("transaction_amount"))},
 round(avg30, 10) AS avg_transaction_amount_30d, max7 AS max_transaction_amount_7d, round(own_amount / avg30, 10) AS amount_vs_customer_avg, coalesce(m1, 0) AS distinct_merchants_1d, coalesce(m30, 0) AS distinct_merchants_30d,
 own_merchant IS NOT NULL AND NOT coalesce(merchant_seen, false) AS new_merchant_flag, round(coalesce(rate, 0), 9) AS merchant_fraud_rate_historical, coalesce(c1, 0) AS distinct_countries_24h, country IS NOT NULL AND NOT coalesce(country_seen, false) AS new_country_flag,
 CASE WHEN device_at IS NOT NULL THEN greatest(0, floor((now - device_at) / {DAY}))::DOUBLE END AS device_age_days, device_id IS NOT NULL AND NOT coalesce(device_seen, false) AS new_device_flag, coalesce(device_id::BIGINT % 2 = 0, false) AS trusted_device_flag,
 coalesce(d30, 0) AS device_customer_count_30d, coalesce(d1, 0) AS customers_per_device_24h, greatest(0, floor((now - opened) / {DAY}))::DOUBLE AS account_age_days, round(bal_now, 6) AS balance, round(bal_now, 6) AS available_balance, credit_limit,
 round(CASE WHEN credit_limit > 0 THEN (credit_limit - bal_now) / credit_limit ELSE 0 END, 6) AS credit_utilization, round(coalesce((now - last_t) / {DAY}.0, -1), 9) AS days_since_last_payment, coalesce(n90, 0) AS confirmed_fraud_count_90d, round(coalesce(loss, 0), 6) AS fraud_loss_365d,
 round(coalesce((now - last_fraud) / {DAY}.0, -1), 9) AS days_since_last_confirmed_fraud, split FROM z WHERE split IS NOT NULL"""

ROUNDED = {6: ("transaction_amount_1h", "transaction_amount_24h", "transaction_amount_7d", "balance", "available_balance", "credit_utilization", "fraud_loss_365d"), 9: ("merchant_fraud_rate_historical", "days_since_last_payment", "days_since_last_confirmed_fraud"), 10: ("avg_transaction_amount_30d", "amount_vs_customer_avg")}


@query("a01_pit_features", f"WITH {PIT_SQL}")
def a01_pit_features(spark, d):
    """All columns of the dataset, for every payment that is not in a gap of the split."""
    split = point_in_time.temporal_split(F.col("now"), *SPLIT)
    out = dataset.build(tables(spark, d), run_id=RUN, delay=DELAY, split=split)
    return out.withColumns({c: F.round(c, digits) for digits, names in ROUNDED.items() for c in names})


@query("p03_labelled", f"WITH {PIT_SQL.split('SELECT ' + chr(39) + 'DSR-')[0]} SELECT CASE WHEN mature THEN CASE WHEN observed THEN best.l ELSE own_label END END AS label, count(*) AS n FROM z WHERE split IS NOT NULL AND mature GROUP BY 1")
def p03_labelled(spark, d):
    split = point_in_time.temporal_split(F.col("now"), *SPLIT)
    rows = dataset.labelled(dataset.build(tables(spark, d), run_id=RUN, delay=DELAY, split=split, unresolved="exclude"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query("v05_source_violations", f"""WITH {SOURCES} SELECT 'payment_conflict' AS rule, count(*) AS n FROM pay WHERE n % 7 = 0 UNION ALL SELECT 'unknown_account', count(*) FROM pay WHERE account_id % 9 = 1
UNION ALL SELECT 'availability', count(*) FROM pay WHERE n % 11 = 0 UNION ALL SELECT 'unknown_payment', count(*) FROM lab WHERE n % 10 = 0 UNION ALL SELECT 'unknown_entry_account', count(*) FROM ent WHERE account_id % 9 = 1""")
def v05_source_violations(spark, d):
    """The sources with faults of every kind: how many violations each rule finds."""
    t = tables(spark, d)
    number = F.substring("event_id", 2, 20).cast("long")
    checked = {
        "payment_conflict": {"payments": t["payments"].unionByName(t["payments"].where(number % 7 == 0).withColumn("amount", F.col("amount") + 1))},
        "unknown_account": {"accounts": t["accounts"].where("account_id % 9 <> 1")},
        "availability": {"payments": t["payments"].withColumn("source_available_at", F.when(number % 11 == 0, F.col("event_time") - 1).otherwise(F.col("source_available_at")))},
        "unknown_payment": {"payments": t["payments"].where(number % 10 != 0)},
        "unknown_entry_account": {"accounts": t["accounts"].where("account_id % 9 <> 1")},
    }
    found = [dataset.source_violations(t | changed).where(F.col("rule") == rule).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, changed in checked.items()]
    return reduce(DataFrame.unionByName, found)


#: Three days of history in each step; labels mature in one.
BACKTEST = {"start": MID - 14 * DAY, "end": MID + 13 * DAY, "test": 5 * DAY, "step": 6 * DAY, "gap": DAY, "validation": 2 * DAY}
PLAN = [backtest.Fold(f.name, f.train, f.test, f.validation, (f.test[1] + DAY, f.test[1] + 2 * DAY)) for f in backtest.folds(**BACKTEST)]
PARTS = ", ".join(f"('{f.name}', '{name}', {k}, {span[0]}, {span[1]})" for f in PLAN for k, (name, span) in enumerate((("train", f.train), ("validation", f.validation), ("test", f.test), ("stress", f.stress))))


@query("p15_fold_assignment", f"WITH {EV}, f(fold, part, k, a, b) AS (VALUES {PARTS}), x AS (SELECT event_id, fold, arg_min(part, k) AS part FROM ev JOIN f ON t >= a AND t < b GROUP BY 1, 2) SELECT fold, part, count(*) AS n, sum(event_id)::BIGINT AS ids FROM x GROUP BY 1, 2")
def p15_fold_assignment(spark, d):
    return backtest.assign(payment_events(spark, d), "t", PLAN).groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("v06_future_isolation", f"WITH {EV} SELECT 'clean' AS sources, 0 AS leaks UNION ALL SELECT 'tampered', count(*) FROM ev WHERE available < {MID} AND customer % 9 = 1")
def v06_future_isolation(spark, d):
    """Rows before a cutoff that change when later records go: none; and when earlier payments of some customers are changed: theirs."""
    t, cutoff = {n: x for n, x in tables(spark, d).items() if n != "observations"}, MID
    past = dict(t)
    past["payments"] = t["payments"].where(F.col("source_available_at") < cutoff)
    past["labels"] = t["labels"].where(F.col("label_available_at") < cutoff).join(past["payments"], "payment_id", "left_semi")
    past["entries"] = t["entries"].where(F.col("posted_at") < cutoff)
    changed = past | {"payments": past["payments"].withColumn("amount", F.when(F.col("customer_id") % 9 == 1, F.col("amount") + 1).otherwise(F.col("amount")))}
    # When a row's own label will come is not known at its time; the comparison is of what was.
    whole, clean, tampered = (dataset.build(x, run_id=RUN, end=cutoff, check=False).withColumn("label_available_at", F.lit(None).cast("long")) for x in (t, past, changed))
    whole = stored(whole, "whole")
    found = [dataset.isolation_violations(whole, x, cutoff).agg(F.count("*").alias("leaks")).select(F.lit(name).alias("sources"), "leaks") for name, x in (("clean", clean), ("tampered", tampered))]
    return found[0].unionByName(found[1])


REPLAYED = f"""{EV}, pe AS (SELECT 'payment_events' AS source_table, 'E' || lpad(event_id::VARCHAR, 9, '0') AS event_id, t, available, available + 1000000 AS ingested, available + 2000000 AS processed FROM ev),
cd AS (SELECT 'customer_disputes' AS source_table, 'D' || lpad(event_id::VARCHAR, 9, '0') AS event_id, t + {DAY} AS t, available + {DAY} AS available, available + {DAY} + 1000000 AS ingested, available + {DAY} + 2000000 AS processed FROM ev WHERE event_id % 10 = 0),
al AS (SELECT *, row_number() OVER (PARTITION BY source_table ORDER BY event_id) - 1 AS source_row_number FROM (SELECT * FROM pe UNION ALL SELECT * FROM cd)), ins AS (SELECT * FROM al WHERE t >= {MID} AND t < {MID + 4 * DAY})"""


def _replayed(spark, d) -> dict[str, DataFrame]:
    e = payment_events(spark, d)
    number = F.lpad(F.col("event_id").cast("string"), 9, "0")
    shape = lambda prefix, later: [F.concat(F.lit(prefix), number).alias("event_id"), F.col("category").alias("event_type"), (F.col("t") + later).alias("event_time"), (F.col("t") + later).alias("source_created_at"), (F.col("available") + later).alias("source_available_at"), (F.col("available") + later + MICROS).alias("ingested_at"), (F.col("available") + later + 2 * MICROS).alias("processed_at")]
    return {"payment_events": e.select(*shape("E", 0)), "customer_disputes": e.where("event_id % 10 = 0").select(*shape("D", DAY))}


@query("p10_replay_envelopes", f"WITH {REPLAYED} SELECT source_table, source_row_number, event_id, row_number() OVER (ORDER BY t, event_id, source_table, source_row_number) AS by_event_time, row_number() OVER (ORDER BY ingested, processed, available, source_table, source_row_number, event_id) AS by_delivery FROM ins")
def p10_replay_envelopes(spark, d):
    t = _replayed(spark, d)
    keys = ["source_table", "source_row_number", "event_id"]
    a = replay.replay(t, MID, MID + 4 * DAY, "event_time_order").select(*keys, F.col("replay_sequence").alias("by_event_time"))
    return a.join(replay.replay(t, MID, MID + 4 * DAY, "original_delivery").select(*keys, F.col("replay_sequence").alias("by_delivery")), keys)


@query("o01_delivery_fallback", f"WITH {REPLAYED} SELECT event_id, row_number() OVER (ORDER BY available, t, source_table, source_row_number, event_id) AS replay_sequence FROM ins")
def o01_delivery_fallback(spark, d):
    t = {n: x.withColumn("ingested_at", F.lit(None).cast("long")) for n, x in _replayed(spark, d).items()}
    return replay.replay(t, MID, MID + 4 * DAY, "original_delivery").select("event_id", "replay_sequence")
