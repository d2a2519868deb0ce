"""Queries of the generators, faults, delivery, contracts and graph extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import DAY, MICROS, hash_uniform, micros, shard_index
from tidemark.operators import campaigns, contracts, faults, generate, graph, labels, ledger, quality
from tidemark.plans.catalogue import EV, HOUR, MID, SHARD, U, query
from tidemark.plans.catalogue_dataset import SOURCES, tables
from tidemark.sources.tables import payment_events, read

#: More late states than by default, so that every one occurs.
CHANCES = {"charged_back": 0.1, "timeout": 0.05, "reversed": 0.1}
_P = generate.CHANCES | CHANCES


def _normal(stream: str, key: str) -> str:
    return f"(sqrt(-2 * ln(1.0 - {U.format(stream + '/u', key)})) * cos(6.283185307179586 * {U.format(stream + '/v', key)}))"


def _cumulative(weights: dict[str, float], u: str) -> str:
    so_far, total, out = 0.0, sum(weights.values()), []
    for name, w in weights.items():
        so_far += w / total
        out.append(f"WHEN {u} < {so_far!r} THEN '{name}'")
    return f"CASE {' '.join(out)} ELSE '{name}' END"


def states(p: dict[str, float]) -> str:
    """The states of a payment in SQL, by its rail and payment_id, as generate.path has them."""

    def hit(name: str) -> str:
        return f"{U.format('42/' + name, 'payment_id')} < {p[name]!r}"

    return f"""CASE rail WHEN 'CARD' THEN ['CARD_PAYMENT_INITIATED', 'CARD_AUTHORIZATION_REQUESTED'] || CASE WHEN {hit('card_approved')} THEN ['CARD_AUTHORIZED'] || CASE WHEN {hit('reversed')} THEN CASE WHEN {U.format('42/early', 'payment_id')} < 0.5 THEN ['CARD_REVERSED'] ELSE ['CARD_CAPTURED', 'CARD_REVERSED'] END
    ELSE ['CARD_CAPTURED', 'CARD_CLEARED', 'CARD_SETTLED'] || CASE WHEN {hit('refunded')} THEN ['CARD_REFUNDED'] ELSE [] END || CASE WHEN {hit('charged_back')} THEN ['CARD_CHARGEBACK_CREATED', 'CARD_CHARGEBACK_RESOLVED'] ELSE [] END END ELSE ['CARD_DECLINED'] END
  WHEN 'PIX' THEN ['PIX_INITIATED', 'PIX_VALIDATED'] || CASE WHEN {hit('pix_approved')} AND NOT {hit('pix_rejected')} THEN ['PIX_AUTHORIZED', 'PIX_SUBMITTED'] || CASE WHEN {hit('timeout')} THEN ['PIX_TIMEOUT'] ELSE ['PIX_SETTLED', 'PIX_RECEIVED'] || CASE WHEN {hit('returned')} THEN ['PIX_RETURN_REQUESTED', 'PIX_RETURNED'] ELSE [] END END ELSE ['PIX_REJECTED'] END
  ELSE ['TRANSFER_COMPLETED'] END"""


PAYMENTS = f"""n AS (SELECT count(*) AS n, greatest(2, count(*) // 20) AS pop FROM orders),
g AS (SELECT unnest(range(n)) AS i, pop FROM n),
g2 AS (SELECT i, pop, floor({U.format('42/payer', 'i')} * pop)::BIGINT AS payer FROM g),
pm AS (SELECT 'PAY-' || lpad(i::VARCHAR, 12, '0') AS payment_id, {_cumulative(generate.RAILS, U.format('42/rail', 'i'))} AS rail, 'ACC-' || lpad(payer::VARCHAR, 12, '0') AS payer,
  'ACC-' || lpad(((payer + 1 + floor({U.format('42/payee', 'i')} * greatest(1, pop - 1))::BIGINT) % pop)::VARCHAR, 12, '0') AS payee,
  round(least(50000.0, greatest(1.0, exp(ln(80.0::DOUBLE) + 0.65 * {_normal('42/amount', 'i')}))), 2) AS amount, ({generate.START} + i * {20 * MICROS} + floor({U.format('42/time', 'i')} * {20 * MICROS}))::BIGINT AS t FROM g2),
st AS (SELECT *, {states(_P)} AS states FROM pm),
sec(s, took) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in generate.SECONDS.items())}),
un AS (SELECT * EXCLUDE (states), unnest(states) AS event_type, unnest(range(len(states))) AS step FROM st),
le AS (SELECT 'EVT' || substr(payment_id, 4) || '-' || step AS event_id, payment_id, rail, payer, payee, amount, event_type, step, t + sum(coalesce(took, 0)) OVER (PARTITION BY payment_id ORDER BY step) * 1000000 AS event_time,
  CASE WHEN step > 0 THEN 'EVT' || substr(payment_id, 4) || '-' || (step - 1) END AS cause FROM un LEFT JOIN sec ON s = event_type)"""


def _lifecycle(spark, d) -> DataFrame:
    n = read(spark, d, "orders").count()
    return generate.lifecycle(generate.payments(spark, 0, n, max(2, n // 20)), chances=CHANCES)


@query("n04_lifecycle", f"WITH {PAYMENTS} SELECT event_id, event_type, event_time::BIGINT AS event_time, cause AS causation_id, amount FROM le")
def n04_lifecycle(spark, d):
    return _lifecycle(spark, d).select("event_id", "event_type", "event_time", "causation_id", "amount")


BACK = ", ".join(f"'{x}'" for x in generate.TAKEN_BACK)


@query("n03_generated_ledger", f"""WITH {PAYMENTS}, p AS (SELECT * FROM le WHERE event_type IN ({BACK}, {", ".join(f"'{x}'" for x in generate.POSTED)})),
e AS (SELECT payment_id, 'DEBIT' AS side, CASE WHEN event_type IN ({BACK}) THEN payee ELSE payer END AS account, amount FROM p UNION ALL SELECT payment_id, 'CREDIT', CASE WHEN event_type IN ({BACK}) THEN payer ELSE payee END, amount FROM p)
SELECT {SHARD.format('account', 16)} AS shard, CAST(sum(CASE WHEN side = 'DEBIT' THEN CAST(amount AS DECIMAL(38,2)) ELSE 0 END) AS DOUBLE) AS debits, CAST(sum(CASE WHEN side = 'CREDIT' THEN CAST(amount AS DECIMAL(38,2)) ELSE 0 END) AS DOUBLE) AS credits, count(*) AS entries,
 sum(CASE WHEN side = 'DEBIT' THEN CAST(amount AS DECIMAL(38,2)) ELSE -CAST(amount AS DECIMAL(38,2)) END) = 0 AS balanced FROM e GROUP BY 1""")
def n03_generated_ledger(spark, d):
    out = ledger.totals_by(generate.ledger_entries(_lifecycle(spark, d)), shard_index(F.col("account_id"), 16), "amount", F.col("entry_type") == "DEBIT")
    return out.withColumns({c: F.col(c).cast("double") for c in ("debits", "credits")})


CORRUPT = U.format("corrupt", "payment_id")


@query("j15_lifecycle_violations", f"""WITH {PAYMENTS}, c AS (SELECT event_id, payment_id, rail, CASE WHEN {CORRUPT} >= 0.05 AND {CORRUPT} < 0.10 AND step = 1 THEN 'UNKNOWN' ELSE event_type END AS s, CASE WHEN {CORRUPT} >= 0.10 AND {CORRUPT} < 0.15 AND step = 1 THEN min(event_time) OVER (PARTITION BY payment_id) ELSE event_time END AS t,
  CASE WHEN {CORRUPT} >= 0.15 AND {CORRUPT} < 0.20 AND step = 1 THEN NULL WHEN {CORRUPT} >= 0.20 AND {CORRUPT} < 0.25 AND step = 0 THEN 'X' ELSE cause END AS cause FROM le WHERE rail IN ('CARD', 'PIX') AND NOT ({CORRUPT} < 0.05 AND step = 0)),
w AS (SELECT *, lag(s) OVER o AS ps, lag(t) OVER o AS pt, lag(event_id) OVER o AS pi, row_number() OVER o AS k FROM c WINDOW o AS (PARTITION BY payment_id ORDER BY t, event_id)),
mv(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in [*quality.CARD, *quality.PIX])}),
r AS (SELECT *, unnest([CASE WHEN k = 1 AND s <> CASE rail WHEN 'CARD' THEN 'CARD_PAYMENT_INITIATED' ELSE 'PIX_INITIATED' END THEN 'first_state' END, CASE WHEN k = 1 AND cause IS NOT NULL THEN 'first_cause' END, CASE WHEN k > 1 AND NOT EXISTS (SELECT 1 FROM mv WHERE a = ps AND b = s) THEN 'move' END, CASE WHEN k > 1 AND t <= pt THEN 'time' END, CASE WHEN k > 1 AND cause IS DISTINCT FROM pi THEN 'cause' END]) AS rule FROM w)
SELECT rule, payment_id AS key, event_id AS detail FROM r WHERE rule IS NOT NULL""")
def j15_lifecycle_violations(spark, d):
    """Lifecycles of which a fifth are corrupted: without their first event, with an unknown state, equal times, wrong causes."""
    u, step = hash_uniform("corrupt", F.col("payment_id")), F.substring_index("event_id", "-", -1).cast("int")
    between = lambda a, b, k: (u >= a) & (u < b) & (step == k)
    e = _lifecycle(spark, d).where(~((u < 0.05) & (step == 0)))
    start = F.col("event_time") - generate.SECONDS["CARD_AUTHORIZATION_REQUESTED"] * MICROS  # both rails' second event comes a second after the first
    e = e.withColumns({"event_type": F.when(between(0.05, 0.10, 1), "UNKNOWN").otherwise(F.col("event_type")), "event_time": F.when(between(0.10, 0.15, 1), start).otherwise(F.col("event_time"))})
    e = e.withColumn("causation_id", F.when(between(0.20, 0.25, 0), "X").when(~between(0.15, 0.20, 1), F.col("causation_id")))
    card = quality.lifecycle_violations(e.where("payment_rail = 'CARD'"), quality.CARD, quality.FIRST["CARD"], cuts=None)
    return card.unionByName(quality.lifecycle_violations(e.where("payment_rail = 'PIX'"), quality.PIX, quality.FIRST["PIX"], cuts=None))


def _wait(stream: str) -> str:
    return f"CAST(least(30.0, greatest(0.05, exp(ln(1.0::DOUBLE) + 0.5 * {_normal(stream, 'o_orderkey')}))) * {DAY} AS DECIMAL(38, 6))::DOUBLE"


@query("n08_label_policy", f"""WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) AS t, o_orderstatus = 'F' AS truth, {U.format('investigate', 'o_orderkey')} < 0.7 AND {U.format('missing', 'o_orderkey')} >= 0.05 AS seen, {U.format('error', 'o_orderkey')} < 0.02 AS wrong, {U.format('correct', 'o_orderkey')} < 0.01 AS fixed, floor({_wait('delay')})::BIGINT AS a, floor({_wait('correction')})::BIGINT AS b FROM orders),
v AS (SELECT CASE WHEN seen AND (wrong OR fixed) AND a + b <= 2 * {DAY} THEN 'CORRECTED' WHEN seen AND a <= 2 * {DAY} THEN CASE WHEN wrong THEN 'PRELIMINARY' ELSE 'CONFIRMED' END ELSE 'UNOBSERVED' END AS status, truth, wrong FROM o)
SELECT status, CASE status WHEN 'UNOBSERVED' THEN NULL WHEN 'PRELIMINARY' THEN NOT truth ELSE truth END AS label, count(*) AS n FROM v GROUP BY 1, 2""")
def n08_label_policy(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", micros(F.col("o_orderdate")).alias("t"), (F.col("o_orderstatus") == "F").alias("truth"))
    observed = labels.observe(o, "o_orderkey", F.col("truth"), F.col("t")).join(o, "o_orderkey")
    seen = labels.visible_at(F.col("versions"), F.col("t") + 2 * DAY)
    return observed.groupBy(seen["status"].alias("status"), seen["label"].alias("label")).agg(F.count("*").alias("n"))


def _i(k: str) -> str:
    return f"range({k}) {{0}}({{0}})"


#: Sizes of the planted patterns: r regions and n nations.
@query("g10_motifs", """WITH s AS (SELECT (SELECT count(*) FROM region) AS r, (SELECT count(*) FROM nation) AS n), a AS (SELECT unnest(range(n)) AS i FROM s),
x AS (SELECT 'CYCLIC_RING' AS kind, i AS src, CASE WHEN i = r - 1 THEN 0 ELSE i + 1 END AS dst FROM a, s WHERE i < r
UNION ALL SELECT 'MULE_NETWORK', i, r FROM a, s WHERE i < r UNION ALL SELECT 'MULE_NETWORK', r, r + 1 FROM s
UNION ALL SELECT 'BENEFICIARY_NETWORK', i, r FROM a, s WHERE i < r UNION ALL SELECT 'FAN_OUT', 0, i + 1 FROM a, s WHERE i < n
UNION ALL SELECT 'BIPARTITE_NETWORK', u.i, r + v.i FROM a u, a v, s WHERE u.i < r AND v.i < 3
UNION ALL SELECT 'STACKED_NETWORK', u.i, 2 + v.i FROM a u, a v, s WHERE u.i < 2 AND v.i < r UNION ALL SELECT 'STACKED_NETWORK', 2 + u.i, 2 + r + v.i FROM a u, a v, s WHERE u.i < r AND v.i < 4
UNION ALL SELECT 'SCATTER_GATHER', 0, i + 1 FROM a, s WHERE i < r UNION ALL SELECT 'SCATTER_GATHER', i + 1, r + 1 FROM a, s WHERE i < r
UNION ALL SELECT 'GATHER_SCATTER', i, r FROM a, s WHERE i < r UNION ALL SELECT 'GATHER_SCATTER', r, r + 1 + i FROM a, s WHERE i < 3
UNION ALL SELECT kind, src, dst FROM (SELECT 'DENSE_CAMPAIGN' AS kind, u.i AS src, v.i AS dst, row_number() OVER (ORDER BY u.i, v.i) AS k, r FROM a u, a v, s WHERE u.i < r AND v.i < r AND u.i <> v.i) WHERE k <= 2 * r + 3
UNION ALL SELECT 'RANDOM_ALERT_CONTROL', i % r, (i + 1) % r FROM a, s WHERE i < 2 * r + 1
UNION ALL SELECT 'MERCHANT_CUSTOMER_COMMUNITY', i % r, (i + 1) % r FROM a, s WHERE i < r * 2 * 2
UNION ALL SELECT 'SHARED_DEVICE_INFRASTRUCTURE', i, (i + 1) % r FROM a, s WHERE i < r UNION ALL SELECT 'SHARED_IP_INFRASTRUCTURE', i, (i + 1) % n FROM a, s)
SELECT kind, src, dst, count(*) AS times FROM x GROUP BY ALL""")
def g10_motifs(spark, d):
    r, n = read(spark, d, "region").count(), read(spark, d, "nation").count()
    sizes = {
        "CYCLIC_RING": (r,), "MULE_NETWORK": (r,), "BENEFICIARY_NETWORK": (r,), "FAN_OUT": (n,), "BIPARTITE_NETWORK": (r, 3), "STACKED_NETWORK": (2, r, 4), "SCATTER_GATHER": (r,), "GATHER_SCATTER": (r, 3),
        "DENSE_CAMPAIGN": (r, 2 * r + 3), "RANDOM_ALERT_CONTROL": (r, 2 * r + 1), "MERCHANT_CUSTOMER_COMMUNITY": (r, 2, 2), "SHARED_DEVICE_INFRASTRUCTURE": (r,), "SHARED_IP_INFRASTRUCTURE": (n,),
    }
    each = [campaigns.motif(spark, kind, **dict(zip(campaigns.MOTIFS[kind], s, strict=True))).select(F.lit(kind).alias("kind"), "src", "dst") for kind, s in sizes.items()]
    return reduce(DataFrame.unionByName, each).groupBy("kind", "src", "dst").agg(F.count("*").alias("times"))


# Faults and delivery

PROBABILITY = {
    "missing_optional_fields": 0.04, "negative_amounts": 0.03, "invalid_values": 0.01, "invalid_enums": 0.02, "invalid_references": 0.02, "corrupted_timestamps": 0.03, "timezone_errors": 0.02, "schema_mismatches": 0.02,
    "extreme_values": 0.01, "encoding_errors": 0.02, "partition_skews": 0.05, "late_events": 0.06, "duplicate_events": 0.03, "duplicate_records": 0.02, "traffic_spikes": 0.04, "fraud_spikes": 0.3, "out_of_order_events": 0.1,
}
FAULTY = faults.Settings(PROBABILITY, source_delay=7, late_delay=900, spike=3, shift=1)


def _events(spark, d) -> DataFrame:
    """Payments of ten events each, some of which belong to a scenario."""
    e = payment_events(spark, d)
    group = F.floor(F.col("event_id") / 10)
    return e.select(
        "event_id", F.concat(F.lit("P"), group.cast("string")).alias("payment_id"), F.col("category").alias("event_type"), F.col("t").alias("event_time"), F.col("available").alias("source_available_at"), (F.col("available") + MICROS).alias("ingested_at"), (F.col("available") + 2 * MICROS).alias("processed_at"),
        F.lit("1.0.0").alias("schema_version"), "amount", F.when(group % 4 == 0, F.concat(F.lit("S"), (group % 20).cast("string"))).alias("scenario_id"), F.col("device").alias("device_id"),
    )


def _f(fault: str, key: str = "event_id") -> str:
    return f"({U.format(fault, key)} < {PROBABILITY[fault]})"


# What is chosen by payment goes by the payment an event claims to be of, after invalid references.
FAULTY_SQL = f"""{EV}, e0 AS (SELECT *, event_id // 10 AS grp FROM ev), e1 AS (SELECT *, 'P' || grp AS own, CASE WHEN {_f('invalid_references')} THEN 'PAYMENT-UNKNOWN-' || event_id ELSE 'P' || grp END AS pid, CASE WHEN grp % 4 = 0 THEN 'S' || grp % 20 END AS sid FROM e0),
e2 AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {_f(f)} THEN '{f}' END" for f in ('negative_amounts', 'invalid_values', 'invalid_enums', 'invalid_references', 'corrupted_timestamps', 'timezone_errors', 'schema_mismatches', 'extreme_values', 'encoding_errors', 'late_events', 'duplicate_events'))},
  CASE WHEN {U.format('missing/device_id', 'event_id')} < 0.04 AND device IS NOT NULL THEN 'missing_optional_fields' END, CASE WHEN {_f('partition_skews', 'pid')} THEN 'partition_skews' END, 'source_delay_events',
  CASE WHEN {_f('duplicate_records', 'pid')} THEN 'duplicate_records' END, CASE WHEN {_f('traffic_spikes', 'pid')} THEN 'traffic_spikes' END, CASE WHEN sid IS NOT NULL AND {_f('fraud_spikes', 'sid')} THEN 'fraud_spikes' END, CASE WHEN {_f('out_of_order_events', 'pid')} THEN 'out_of_order_events' END], lambda x: x IS NOT NULL) AS faults,
  (1 + {_f('duplicate_events')}::INT) * (1 + {_f('duplicate_records', 'pid')}::INT) * (1 + 2 * {_f('traffic_spikes', 'pid')}::INT) * (1 + 2 * (sid IS NOT NULL AND {_f('fraud_spikes', 'sid')})::INT) AS times FROM e1)"""


@query("n09_faults", f"WITH {FAULTY_SQL}, x AS (SELECT unnest(faults) AS fault, times FROM e2), names(fault) AS (VALUES {', '.join(f'({chr(39)}{f}{chr(39)})' for f in faults.FAULTS)}) SELECT names.fault, coalesce(sum(times), 0)::BIGINT AS rows FROM names LEFT JOIN x USING (fault) GROUP BY 1")
def n09_faults(spark, d):
    return faults.counts(faults.inject(_events(spark, d), FAULTY, ["device_id"], placed=False))


@query("n09_faulty_events", f"""WITH {FAULTY_SQL} SELECT event_id, unnest(range(times)) AS copy, pid AS payment_id, CASE WHEN {_f('invalid_enums')} THEN 'INVALID_ENUM:' || event_id ELSE category END AS event_type,
 CASE WHEN {_f('extreme_values')} THEN 1e15 WHEN {_f('negative_amounts')} OR {_f('invalid_values')} THEN -abs(amount) ELSE amount END AS amount, CASE WHEN {_f('corrupted_timestamps')} THEN t - 1000000 ELSE available END + 7000000 + CASE WHEN {_f('late_events')} THEN 900000000 ELSE 0 END AS source_available_at,
 CASE WHEN {_f('partition_skews', 'pid')} THEN 0 ELSE CAST(('0x' || substr(sha256('"' || pid || '"'), 1, 8))::BIGINT % 16 AS INT) END AS transport_partition, len(faults) AS n_faults FROM e2""")
def n09_faulty_events(spark, d):
    out = faults.inject(_events(spark, d), FAULTY, ["device_id"], placed=False)
    return out.select("event_id", F.col("copy").cast("long").alias("copy"), "payment_id", "event_type", "amount", "source_available_at", "transport_partition", F.size("faults").cast("long").alias("n_faults"))


@query("n11_realign", f"""WITH {FAULTY_SQL}, m AS (SELECT event_id, max(CASE WHEN {_f('corrupted_timestamps')} THEN t - 1000000 ELSE available END + 7000000 + CASE WHEN {_f('late_events')} THEN 900000000 ELSE 0 END) AS latest FROM e2 GROUP BY 1)
SELECT ev.event_id, greatest(ev.t + 5000000, m.latest) AS posted_at FROM ev JOIN m ON m.event_id = ev.event_id WHERE ev.category = 'purchase'""")
def n11_realign(spark, d):
    entries = payment_events(spark, d).where("category = 'purchase'").select("event_id", (F.col("t") + 5 * MICROS).alias("posted_at"))
    return faults.realign(entries, faults.inject(_events(spark, d), FAULTY, ["device_id"], placed=False), "event_id", ["posted_at"])


OUTAGES = (faults.Outage(MID, MID + 6 * HOUR, "DROP"), faults.Outage(MID + DAY, MID + DAY + 5 * HOUR, "BUFFER_AND_FLUSH"), faults.Outage(MID + 2 * DAY, MID + 2 * DAY + 9 * HOUR, "DELAY", delay=120), faults.Outage(MID + 3 * DAY, MID + 4 * DAY, "PARTIAL_REJECT"))
CHAOS = faults.Chaos(drop=0.03, duplicate=0.05, retry=0.04, max_delay=30, partitions=3, skew=0.1, outages=OUTAGES)
CHAOS_SQL = f"""{EV}, c AS (SELECT event_id, customer, t, CASE WHEN t >= {MID} AND t < {MID + 6 * HOUR} THEN 'outage' WHEN {U.format('drop', 'event_id')} < 0.03 THEN 'drop' ELSE 'sent' END AS fate,
  CASE WHEN t >= {MID + DAY} AND t < {MID + DAY + 5 * HOUR} THEN ({MID + DAY + 5 * HOUR} - t) // 1000000 WHEN t >= {MID + 2 * DAY} AND t < {MID + 2 * DAY + 9 * HOUR} THEN 120 ELSE 0 END + floor({U.format('delay', 'event_id')} * 31)::BIGINT AS wait,
  {U.format('retry', 'event_id')} < 0.04 AS retry, {U.format('duplicate', 'event_id')} < 0.05 AS dup FROM ev),
s AS (SELECT *, unnest(CASE WHEN retry THEN [1, 2] ELSE [1] END) AS attempt FROM c WHERE fate = 'sent'), s2 AS (SELECT *, unnest(CASE WHEN dup THEN [0, 1] ELSE [0] END) AS copy, t + (wait + attempt - 1) * 1000000 AS delivered FROM s)"""


def _deliveries(spark, d) -> DataFrame:
    return faults.deliver(payment_events(spark, d).select(F.col("event_id").alias("record_id"), F.col("customer").alias("key"), F.col("t").alias("scheduled")), CHAOS)


@query("t07_deliveries", f"WITH {CHAOS_SQL} SELECT event_id AS record_id, attempt, copy, delivered, CASE WHEN {U.format('skew', 'event_id')} < 0.1 THEN 0 ELSE CAST(('0x' || substr(sha256('\"' || customer || '\"'), 1, 8))::BIGINT % 3 AS INT) END AS partition FROM s2")
def t07_deliveries(spark, d):
    return _deliveries(spark, d).where("fate = 'sent'").select("record_id", "attempt", "copy", "delivered", "partition")


@query("a40_delivery_counts", f"""WITH {CHAOS_SQL}, o AS (SELECT delivered, row_number() OVER (ORDER BY t, event_id, attempt, copy) AS k, event_id, attempt, copy FROM s2),
o2 AS (SELECT delivered, lag(delivered) OVER (ORDER BY (k - 1) // 20, {U.format('reorder', "(event_id || '/' || attempt || '/' || copy)")}, event_id, attempt, copy) AS before FROM o)
SELECT (SELECT count(*) FROM s2) AS emitted, (SELECT count(*) FROM c WHERE fate <> 'sent') AS dropped, (SELECT count(*) FROM s2 WHERE attempt > 1) AS retried, (SELECT count(*) FROM s2 WHERE copy > 0) AS duplicated, (SELECT count(*) FROM s2 WHERE delivered > t) AS late,
 (SELECT count(*) - count(DISTINCT event_id) FROM s2) AS deduplicated, (SELECT count(*) FROM o2 WHERE before > delivered) AS out_of_order""")
def a40_delivery_counts(spark, d):
    sent = _deliveries(spark, d)
    return faults.delivery_counts(sent).withColumn("out_of_order", faults.out_of_order(faults.reordered(sent, 20)).scalar())


# Contracts


@query("v08_contract_violations", f"""WITH {FAULTY_SQL}, x AS (SELECT event_id, unnest([CASE WHEN {_f('invalid_enums')} THEN 'enum:event_type' END, CASE WHEN {_f('schema_mismatches')} THEN 'version' END, CASE WHEN device IS NULL OR {U.format('missing/device_id', 'event_id')} < 0.04 THEN 'missing:device_id' END]) AS rule, times FROM e2)
SELECT rule, count(*) AS events FROM x WHERE rule IS NOT NULL GROUP BY 1""")
def v08_contract_violations(spark, d):
    rows = faults.inject(_events(spark, d), FAULTY, ["device_id"], placed=False).where("copy = 0")
    found = contracts.contract_violations(rows, "event_id", {"device_id": "long", "amount": "double"}, {"event_type": ["click", "view", "signup", "purchase", "error"]}, ["1.0.0"])
    return found.groupBy("rule").agg(F.count("*").alias("events"))


@query("v10_schema_compatibility", """WITH c AS (SELECT table_name AS t, column_name AS c, data_type AS k FROM (VALUES ('x', 'a', 1)) v(table_name, column_name, data_type)) SELECT * FROM (VALUES ('add', 'FULLY_COMPATIBLE', 'FULLY_COMPATIBLE'), ('rename', 'BREAKING', 'BREAKING'), ('remove', 'BREAKING', 'BREAKING'), ('type', 'BREAKING', 'BACKWARD_COMPATIBLE'), ('same', 'FULLY_COMPATIBLE', 'FULLY_COMPATIBLE')) t(change, registered, declared)""")
def v10_schema_compatibility(spark, d):
    """Versions of the events' schema after each kind of change, as the registry classes them, and as the change itself is classed."""
    e = read(spark, d, "events")
    changes = {"add": ("add_optional_field", ["channel"]), "rename": ("rename", {"value": "amount"}), "remove": ("remove_field", ["props"]), "type": ("type", {"event_id": "string"}), "same": ("enum", {"event_type": ["x"]})}
    book = contracts.SchemaRegistry()
    fields = lambda df: {f.name: f.dataType.simpleString() for f in df.schema}
    book.register("base", fields(e))
    out = []
    for name, (kind, what) in changes.items():
        book.register(name, fields(contracts.apply_change(e, kind, what)))
        out.append((name, book.compatibility("base", name), "FULLY_COMPATIBLE" if name == "same" else contracts.infer_compatibility(kind, what if isinstance(what, dict) else {})))
    return spark.createDataFrame(out, "change string, registered string, declared string")


@query("a07_versions_and_extremes", f"""WITH {FAULTY_SQL} SELECT 'unregistered' AS what, count(*) FILTER ({_f('schema_mismatches')}) AS n FROM e2 UNION ALL SELECT 'extreme', count(*) FILTER (CASE WHEN {_f('extreme_values')} THEN 1e15 WHEN {_f('negative_amounts')} OR {_f('invalid_values')} THEN -abs(amount) ELSE amount END NOT BETWEEN 0 AND 1000000) FROM e2""")
def a07_versions_and_extremes(spark, d):
    rows = faults.inject(_events(spark, d), FAULTY, ["device_id"], placed=False).where("copy = 0")
    other = contracts.version_histogram(rows).where("version <> '1.0.0'").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).select(F.lit("unregistered").alias("what"), "n")
    return other.unionByName(contracts.extreme_values(rows, "amount", 0.0, 1e6).select(F.lit("extreme").alias("what"), F.col("extreme").alias("n")))


@query("f11_encoded_payloads", "SELECT event_id, to_base64(encode(props)) AS encoded, props AS decoded FROM events")
def f11_encoded_payloads(spark, d):
    e = read(spark, d, "events").select("event_id", contracts.encode(F.col("props")).alias("encoded"))
    return e.withColumn("decoded", contracts.decode(F.col("encoded")))


# Graph extraction


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """Nodes of eight kinds and edges of all domain kinds, from the payment tables."""
    t = tables(spark, d)
    p, name = t["payments"], lambda prefix, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(prefix), F.col(c).cast("string")))
    users = t["accounts"].select("account_id", "opening_date", (F.col("account_id") % 25).alias("bank"))
    customers = users.select(name("CUS", "account_id").alias("customer_id"), (F.col("opening_date") - DAY).alias("valid_from"))
    accounts = users.select(name("ACC", "account_id").alias("account_id"), name("CUS", "account_id").alias("customer_id"), name("INS", "bank").alias("institution_id"), "opening_date")
    institutions = read(spark, d, "nation").select(name("INS", "n_nationkey").alias("institution_id"), F.lit(MID - 900 * DAY).alias("valid_from"))
    cards = t["cards"].select(name("CRD", "card_id").alias("card_id"), F.concat(F.lit("CUS"), (F.col("card_id") / 2).cast("long").cast("string")).alias("customer_id"), F.col("issued_at"), (F.col("issued_at") + 3000 * DAY).alias("expires_at"))
    devices = t["devices"].select(name("DEV", "device_id").alias("device_id"), "first_seen_at")
    merchants = t["merchants"].select(name("MER", "merchant_id").alias("merchant_id"), F.concat(F.lit("INS"), F.col("country").cast("string")).alias("acquirer_id"), "created_at")
    keys = users.select(name("KEY", "account_id").alias("pix_key_id"), name("CUS", "account_id").alias("customer_id"), "opening_date")
    ips = read(spark, d, "region").select(name("IP", "r_regionkey").alias("endpoint_id"), F.lit(MID - 900 * DAY).alias("valid_from"))
    nodes = graph.static_nodes([
        ("CUSTOMER", customers, "customer_id", "valid_from", None, "valid_from"), ("INSTITUTION", institutions, "institution_id", "valid_from", None, "valid_from"), ("ACCOUNT", accounts, "account_id", "opening_date", None, "opening_date"),
        ("CARD", cards, "card_id", "issued_at", "expires_at", "issued_at"), ("DEVICE", devices, "device_id", "first_seen_at", None, "first_seen_at"), ("MERCHANT", merchants, "merchant_id", "created_at", None, "created_at"),
        ("BENEFICIARY", keys, "pix_key_id", "opening_date", None, "opening_date"), ("IP", ips, "endpoint_id", "valid_from", None, "valid_from"),
    ])
    owned = [("OWNS", accounts, "customer_id", "account_id", "opening_date", None), ("HELD_AT", accounts, "account_id", "institution_id", "opening_date", None), ("OWNS", cards, "customer_id", "card_id", "issued_at", "expires_at"), ("OWNS", keys, "customer_id", "pix_key_id", "opening_date", None), ("ACQUIRED_BY", merchants, "merchant_id", "acquirer_id", "created_at", None)]
    number = F.substring("event_id", 2, 20).cast("long")
    payee = (F.col("customer_id") * 3 + number) % p.agg(F.max("customer_id")).scalar()
    events = p.select(
        "event_id", "payment_id", F.lit(None).cast("string").alias("scenario_id"), "event_time", "source_available_at", "payment_type", name("CUS", "customer_id").alias("customer_id"), name("DEV", "device_id").alias("device_id"),
        F.when(F.col("online"), F.concat(F.lit("IP"), (number % 5).cast("string"))).alias("ip_id"), name("ACC", "account_id").alias("payer_account_id"), name("MER", "merchant_id").alias("merchant_id"),
        F.concat(F.lit("ACC"), payee.cast("string")).alias("payee_account_id"), F.when(number % 4 == 0, F.concat(F.lit("KEY"), payee.cast("string"))).alias("payee_pix_key_id"),
    )
    return nodes, graph.domain_edges(owned).unionByName(graph.event_edges(events, MID - 10 * DAY, MID + 10 * DAY))


ISO = "strftime(make_timestamp({0}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {0} % 1000000 = 0 THEN '' ELSE '.' || lpad(({0} % 1000000)::VARCHAR, 6, '0') END || '+00:00'"
EDGES_SQL = f"""{SOURCES}, py AS (SELECT *, (customer_id * 3 + n) % (SELECT max(customer_id) FROM pay) AS payee FROM pay WHERE t >= {MID - 10 * DAY} AND t < {MID + 10 * DAY}),
dom AS (SELECT 'CUS' || c AS src, 'ACC' || c AS dst, 'OWNS' AS kind, opened AS t, NULL AS vt FROM acc UNION ALL SELECT 'ACC' || c, 'INS' || c % 25, 'HELD_AT', opened, NULL FROM acc UNION ALL SELECT 'CUS' || c, 'CRD' || c * 2, 'OWNS', opened + {DAY}, opened + {3001 * DAY} FROM acc
  UNION ALL SELECT 'CUS' || c, 'KEY' || c, 'OWNS', opened, NULL FROM acc UNION ALL SELECT 'MER' || s_suppkey, 'INS' || s_nationkey, 'ACQUIRED_BY', {1_546_300_800 * MICROS}, NULL FROM supplier),
evt AS (SELECT event_id, payment_id, t, unnest([CASE WHEN device_id IS NOT NULL THEN {{'k': 'USES', 'a': 'CUS' || customer_id, 'b': 'DEV' || device_id}} END, CASE WHEN online THEN {{'k': 'LOGGED_IN_FROM', 'a': 'CUS' || customer_id, 'b': 'IP' || n % 5}} END,
  CASE WHEN payment_type = 'PURCHASE' THEN {{'k': 'PAID', 'a': 'ACC' || customer_id, 'b': 'MER' || merchant_id}} END, CASE WHEN payment_type = 'PURCHASE' THEN {{'k': 'PURCHASED_FROM', 'a': 'CUS' || customer_id, 'b': 'MER' || merchant_id}} END,
  CASE WHEN payment_type = 'TRANSFER' THEN {{'k': 'TRANSFERRED_TO', 'a': 'ACC' || customer_id, 'b': 'ACC' || payee}} END, CASE WHEN payment_type = 'TRANSFER' THEN {{'k': 'RECEIVED_FROM', 'a': 'ACC' || payee, 'b': 'ACC' || customer_id}} END,
  CASE WHEN payment_type = 'TRANSFER' AND n % 4 = 0 THEN {{'k': 'TRANSFERRED_TO', 'a': 'ACC' || customer_id, 'b': 'KEY' || payee}} END]) AS x FROM py),
ed AS (SELECT src, dst, kind, t, vt, NULL AS event_id, NULL AS payment_id FROM dom UNION ALL SELECT x.a, x.b, x.k, t, NULL, event_id, payment_id FROM evt WHERE x IS NOT NULL),
eds AS (SELECT *, 'GED-' || substr(sha256(src || '|' || dst || '|' || kind || '|' || coalesce(event_id, 'None') || '|' || coalesce(payment_id, 'None') || '|' || {ISO.format('t')}), 1, 20) AS edge_id FROM ed)"""


@query("g01_nodes", f"""WITH {SOURCES} SELECT 'CUS' || c AS node_id, 'CUSTOMER' AS node_type, opened - {DAY} AS valid_from FROM acc UNION ALL SELECT 'INS' || n_nationkey, 'INSTITUTION', {MID - 900 * DAY} FROM nation UNION ALL SELECT 'ACC' || c, 'ACCOUNT', opened FROM acc UNION ALL SELECT 'CRD' || c * 2, 'CARD', opened + {DAY} FROM acc
UNION ALL SELECT DISTINCT 'DEV' || device, 'DEVICE', {1_685_577_600 * MICROS} + device::BIGINT * {DAY} FROM ev WHERE device IS NOT NULL UNION ALL SELECT 'MER' || s_suppkey, 'MERCHANT', {1_546_300_800 * MICROS} FROM supplier UNION ALL SELECT 'KEY' || c, 'BENEFICIARY', opened FROM acc UNION ALL SELECT 'IP' || r_regionkey, 'IP', {MID - 900 * DAY} FROM region""")
def g01_nodes(spark, d):
    return _graph(spark, d)[0].select("node_id", "node_type", "valid_from")


@query("g02_event_edges", f"WITH {EDGES_SQL} SELECT edge_id, src AS src_id, dst AS dst_id, kind AS edge_type, t AS valid_from, vt AS valid_to FROM eds")
def g02_event_edges(spark, d):
    return _graph(spark, d)[1].select("edge_id", "src_id", "dst_id", "edge_type", "valid_from", "valid_to")


@query("w07_edge_ids", f"WITH {EDGES_SQL}, tw AS (SELECT * FROM eds UNION ALL SELECT * FROM eds WHERE kind = 'USES'), k AS (SELECT edge_id, row_number() OVER (PARTITION BY edge_id) AS k FROM tw) SELECT CASE WHEN k = 1 THEN edge_id ELSE edge_id || '-' || lpad(k::VARCHAR, 2, '0') END AS edge_id FROM k")
def w07_edge_ids(spark, d):
    edge = _graph(spark, d)[1]
    return graph.unique_ids(edge.unionByName(edge.where("edge_type = 'USES'"))).select("edge_id")


@query("g09_graph_violations", f"""WITH {EDGES_SQL}, nodes AS (SELECT 'CUS' || c AS i FROM acc UNION SELECT 'ACC' || c FROM acc UNION SELECT 'CRD' || c * 2 FROM acc UNION SELECT 'KEY' || c FROM acc UNION SELECT 'INS' || n_nationkey FROM nation UNION SELECT 'DEV' || device FROM ev WHERE device IS NOT NULL AND device::BIGINT % 10 <> 3 UNION SELECT 'MER' || s_suppkey FROM supplier UNION SELECT 'IP' || r_regionkey FROM region)
SELECT 'unknown_node' AS rule, count(*) AS n FROM (SELECT src AS i FROM eds WHERE src NOT IN (SELECT i FROM nodes) GROUP BY 1 UNION ALL SELECT dst FROM eds WHERE dst NOT IN (SELECT i FROM nodes) GROUP BY 1)
UNION ALL SELECT 'duplicate_edge', count(DISTINCT edge_id) FROM eds WHERE kind = 'HELD_AT' UNION ALL SELECT 'self_loop', count(*) FROM eds WHERE src = dst""")
def g09_graph_violations(spark, d):
    """The graph without some devices and with some edges twice: each rule that this breaks, and how often."""
    nodes, edge = _graph(spark, d)
    broken = nodes.where("not (node_type = 'DEVICE' and cast(substring(node_id, 4, 9) as long) % 10 = 3)")
    found = graph.graph_violations(broken, edge.unionByName(edge.where("edge_type = 'HELD_AT'")), MID - 10 * DAY, MID + 10 * DAY)
    rules = spark.createDataFrame([("unknown_node",), ("duplicate_edge",), ("self_loop",)], "rule string")
    return rules.join(found.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


@query("g08_observable_view", f"WITH {EDGES_SQL} SELECT edge_id FROM eds e LEFT JOIN pay p ON p.event_id = e.event_id WHERE e.t <= {MID} AND (vt IS NULL OR vt > {MID}) AND coalesce(p.available, 0) <= {MID}")
def g08_observable_view(spark, d):
    return graph.view(*_graph(spark, d), MID, "observable")[1].select("edge_id")
