"""More registered queries: calibration, predictions, delivery, campaigns and graph exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import DAY, hash_uniform, micros
from tidemark.operators import calibration, campaigns, delivery, graph, predictions, quality, records, workflow
from tidemark.plans.catalogue import EV, HOUR, LINK, MID, SC, U, _device_edges, _scored, query
from tidemark.sources.tables import payment_events, read


@query("p02_bad_values", "SELECT unnest([{'column': 'value', 'bad': sum((value IS NULL OR value <= 0)::INT)::BIGINT}, {'column': 'event_type', 'bad': sum((event_type IS NULL OR event_type = '')::INT)::BIGINT}], recursive := true) FROM events")
def p02_bad_values(spark, d):
    return calibration.bad_values(read(spark, d, "events"), positive=["value"], text=["event_type"])


@query("p06_contract", "SELECT event_id, coalesce(event_type, 'unknown') AS event_type, round(value * 100)::BIGINT AS cents, 'v1' AS schema_version FROM events")
def p06_contract(spark, d):
    e = read(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100))
    return delivery.contract(e, {"event_id": ("long", None), "event_type": ("string", "unknown"), "cents": ("long", 0), "schema_version": ("string", "v1")})


@query("p12_rule_match", "SELECT CASE WHEN event_type = 'purchase' AND value > 50 THEN 'big' WHEN event_type = 'purchase' THEN 'small' WHEN event_type = 'error' THEN 'error' END AS rule, count(*) AS n FROM events GROUP BY 1")
def p12_rule_match(spark, d):
    e = read(spark, d, "events")
    buys = F.col("event_type") == "purchase"
    rows, bad = delivery.match_rules(e, [("big", buys & (F.col("value") > 50)), ("small", buys & (F.col("value") <= 50)), ("error", F.col("event_type") == "error")])
    quality.assert_none(bad)
    return rows.groupBy("rule").agg(F.count("*").alias("n"))


@query("j09_referenced_ids", "SELECT 'l_partkey' AS kind, count(DISTINCT l_partkey) AS n FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'parts', count(DISTINCT l_orderkey) FROM lineitem")
def j09_referenced_ids(spark, d):
    l = read(spark, d, "lineitem").withColumn("parts", F.array("l_orderkey"))
    return delivery.referenced_ids(l, ["l_partkey", "l_suppkey"], ["parts"]).groupBy("kind").agg(F.count("*").alias("n"))


@query("j12_prediction_resolution", f"WITH {SC} SELECT count(*) AS resolved, sum(event_id)::BIGINT AS ids FROM sc WHERE event_id % 3 <> 2")
def j12_prediction_resolution(spark, d):
    rows = _scored(spark, d).select("event_id", F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("payment_ref"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("row_ref"))
    asked = rows.where("event_id % 3 <> 2").select(F.lit("m").alias("model"), F.when(F.col("event_id") % 3 == 0, F.col("payment_ref")).alias("payment_ref"), F.when(F.col("event_id") % 3 == 1, F.col("row_ref")).alias("row_ref"))
    found, bad = predictions.resolve(asked, rows, "event_id", ["payment_ref", "row_ref"])
    quality.assert_none(bad)
    return found.agg(F.count("*").alias("resolved"), F.sum("event_id").alias("ids"))


@query("j13_segment_enrichment", """SELECT n_name AS nation, r_name AS region, c_mktsegment AS segment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE) AS total
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3""")
def j13_segment_enrichment(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    place = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    # Totals by customer first: the join then has one row for each customer, however many orders one has.
    per = o.groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).alias("t"))
    rows = per.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.sum("k").alias("n"), F.sum("t").cast("double").alias("total"))


@query("a02_vocabulary_counts", "SELECT v AS value, count(event_type) AS n FROM (VALUES ('click'), ('view'), ('signup'), ('purchase'), ('error'), ('refund')) t(v) LEFT JOIN events ON event_type = v GROUP BY 1")
def a02_vocabulary_counts(spark, d):
    return calibration.zero_filled(read(spark, d, "events"), "event_type", ["click", "view", "signup", "purchase", "error", "refund"])


#: Events whose times are out of order by rule: created late, ingested before they are available, or processed first.
_TIMES = f"x AS (SELECT event_id, t AS event_time, t + CASE WHEN event_id % 7 = 0 THEN {HOUR} ELSE 0 END AS source_created_at, available AS source_available_at, CASE WHEN event_id % 11 = 0 THEN available - 1 ELSE available + 1 END AS ingested_at, CASE WHEN event_id % 13 = 0 THEN t - 5 WHEN event_id % 17 <> 0 THEN available + 2 END AS processed_at FROM ev)"


def _times(spark, d):
    i, t, available = F.col("event_id"), F.col("t"), F.col("available")
    return payment_events(spark, d).select("event_id", t.alias("event_time"), (t + F.when(i % 7 == 0, HOUR).otherwise(0)).alias("source_created_at"), available.alias("source_available_at"), F.when(i % 11 == 0, available - 1).otherwise(available + 1).alias("ingested_at"), F.when(i % 13 == 0, t - 5).when(i % 17 != 0, available + 2).alias("processed_at"), "amount", (F.col("category") == "error").alias("truth"))


_ORDERED = "event_time <= source_created_at AND source_created_at <= source_available_at AND source_available_at <= ingested_at AND coalesce(ingested_at <= processed_at, true)"


@query("a05_envelope_order", f"WITH {EV}, {_TIMES} SELECT count(*) AS n, count(*) FILTER ({_ORDERED}) AS in_order, count(*) FILTER ({_ORDERED}) / count(*) AS rate FROM x")
def a05_envelope_order(spark, d):
    return quality.envelope_order(_times(spark, d))


@query("a33_run_report", f"WITH {EV}, {_TIMES}, b AS (SELECT x.*, amount, category FROM x JOIN ev USING (event_id) UNION ALL SELECT x.*, amount, category FROM x JOIN ev USING (event_id) WHERE event_id % 9 = 0) SELECT 'unique_rate' AS metric, count(DISTINCT event_id) / count(*) AS value FROM b UNION ALL SELECT 'valid_rate', avg((amount > 5)::INT) FROM b UNION ALL SELECT 'order_rate', avg(({_ORDERED})::INT) FROM b UNION ALL SELECT 'prevalence', avg((category = 'error')::INT) FROM b")
def a33_run_report(spark, d):
    rows = _times(spark, d)
    return quality.run_report(rows.unionByName(rows.where("event_id % 9 = 0")), "event_id", F.col("amount") > 5, F.col("truth"))


@query("a03_fraud_counts", "SELECT user_id % 5 AS segment, count(*) AS payments, count(*) FILTER (event_type = 'error') AS frauds, count(*) FILTER (event_type = 'error') / count(*) AS rate FROM events GROUP BY 1")
def a03_fraud_counts(spark, d):
    return quality.fraud_counts(read(spark, d, "events").withColumn("segment", F.col("user_id") % 5), F.col("event_type") == "error", ["segment"])


@query("o07_tagged_union", """WITH x AS (SELECT 'orders' AS kind, o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS owner FROM orders UNION ALL SELECT 'customers', c_custkey::VARCHAR, c_custkey::VARCHAR FROM customer)
SELECT kind AS logical_type, CAST(('0x' || substr(sha256(owner), 1, 16))::UBIGINT % 8 AS INT) AS partition_id, count(*) AS n, count(DISTINCT id) AS ids FROM x GROUP BY 1, 2""")
def o07_tagged_union(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), "o_totalprice")
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), "c_acctbal")
    out = records.tagged_union({"orders": orders, "customers": customers}, 8)
    return out.groupBy("logical_type", "partition_id").agg(F.count("*").alias("n"), F.count_distinct("logical_id").alias("ids"))


@query("f10_feature_matrix", "SELECT event_id, coalesce(value, 0) AS x_value, (event_type = 'click')::INT::DOUBLE AS click, (event_type = 'purchase')::INT::DOUBLE AS purchase FROM events")
def f10_feature_matrix(spark, d):
    out = predictions.one_hot(read(spark, d, "events"), ["value"], {"event_type": ["click", "purchase"]})
    return out.select("event_id", "x_value", F.col("`x_event_type=click`").alias("click"), F.col("`x_event_type=purchase`").alias("purchase"))


@query("a11_value_and_delay", f"""WITH {SC}, v AS (SELECT customer % 4 AS segment, * FROM sc JOIN (SELECT event_id, amount FROM ev) USING (event_id)),
a AS (SELECT segment, coalesce(sum(CAST(amount AS DECIMAL(38,6))) FILTER (label), 0)::DOUBLE AS fraud_amount, coalesce(sum(CAST(amount AS DECIMAL(38,6))) FILTER (label AND score >= 4), 0)::DOUBLE AS caught_amount, coalesce(sum(CAST(amount AS DECIMAL(38,6))) FILTER (NOT label AND score >= 4), 0)::DOUBLE AS blocked_amount FROM v GROUP BY 1),
e AS (SELECT segment, customer, min(t) AS first, min(t) FILTER (score >= 4) AS found FROM v WHERE label GROUP BY 1, 2), f AS (SELECT segment, count(*) AS frauds, count(found) AS detected, round(avg(found - first), 3) AS mean_delay FROM e GROUP BY 1)
SELECT segment, round(fraud_amount, 6) AS fraud_amount, round(caught_amount, 6) AS caught_amount, round(blocked_amount, 6) AS blocked_amount, frauds, detected, mean_delay FROM a JOIN f USING (segment)""")
def a11_value_and_delay(spark, d):
    rows = _scored(spark, d).withColumn("segment", F.col("customer") % 4).join(payment_events(spark, d).select("event_id", "amount"), "event_id")
    value = predictions.value_at_risk(rows, ["segment"], "score", F.col("label"), "amount", 4.0)
    delay = predictions.detection_delay(rows, ["segment"], "score", F.col("label"), "t", 4.0, "customer")
    return value.join(delay, "segment").withColumns({c: F.round(c, 6) for c in ("fraud_amount", "caught_amount", "blocked_amount")}).withColumn("mean_delay", F.round("mean_delay", 3))


@query("a11_model_metrics", f"""WITH {SC}, m AS (SELECT 'low' AS model, score / 40 AS s, label FROM sc UNION ALL SELECT 'high', least(1.0, score / 20), label FROM sc),
c AS (SELECT model, count(*) AS n, sum(label::INT)::BIGINT AS positives, sum((s >= 0.3 AND label)::INT)::BIGINT AS tp, sum((s >= 0.3)::INT)::BIGINT AS flagged, avg((s - label::INT) ** 2) AS b FROM m GROUP BY 1),
p AS (SELECT *, coalesce(tp / nullif(flagged, 0), 0) AS pr, coalesce(tp / nullif(positives, 0), 0) AS rc FROM c)
SELECT model, n, positives, tp, flagged, round(b, 9) AS brier, round(pr, 9) AS precision, round(rc, 9) AS recall, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 9) AS f1 FROM p""")
def a11_model_metrics(spark, d):
    s = _scored(spark, d)
    rows = s.select(F.lit("low").alias("model"), (F.col("score") / 40).alias("s"), "label").unionByName(s.select(F.lit("high").alias("model"), F.least(F.lit(1.0), F.col("score") / 20).alias("s"), "label"))
    out = predictions.model_metrics(rows, ["model"], "s", F.col("label"), 0.3)
    return out.withColumns({c: F.round(c, 9) for c in ("brier", "precision", "recall", "f1")})


@query("a11_calibration_error", f"WITH {SC}, b AS (SELECT least(floor(least(1.0, score / 20) * 10), 9) AS b, count(*) AS n, avg(least(1.0, score / 20)) AS s, avg(label::INT) AS r FROM sc GROUP BY 1) SELECT round(sum(n * abs(s - r)) / sum(n), 9) AS calibration_error FROM b")
def a11_calibration_error(spark, d):
    rows = _scored(spark, d).withColumn("s", F.least(F.lit(1.0), F.col("score") / 20))
    return predictions.calibration_error(rows, "s", F.col("label")).withColumn("calibration_error", F.round("calibration_error", 9))


@query("a29_conditional_weights", "SELECT o_orderstatus, o_orderpriority AS value, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 12) AS weight FROM orders GROUP BY 1, 2")
def a29_conditional_weights(spark, d):
    return calibration.category_weights(read(spark, d, "orders"), "o_orderpriority", ["o_orderstatus"]).withColumn("weight", F.round("weight", 12))


@query("a30_fidelity", """WITH s AS (SELECT *, ts >= TIMESTAMP '2024-01-16' AS later FROM events), w AS (SELECT event_type, count(*) FILTER (NOT later) / (SELECT count(*) FROM s WHERE NOT later) AS a, count(*) FILTER (later) / (SELECT count(*) FROM s WHERE later) AS b FROM s GROUP BY 1),
r AS (SELECT value, later, row_number() OVER (PARTITION BY later ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY later) AS n FROM s), q(q) AS (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)),
v AS (SELECT q, max(value) FILTER (NOT later) AS a, max(value) FILTER (later) AS b FROM r, q WHERE k = round_even((n - 1) * q, 0) GROUP BY q),
x AS (SELECT 'value' AS field, greatest(0, 1 - avg(abs(a - b) / greatest(abs(a), abs(b)))) AS score FROM v UNION ALL SELECT 'event_type', 1 - sum(abs(a - b)) / 2 FROM w)
SELECT field, round(score, 9) AS score FROM x UNION ALL SELECT 'total', round(avg(score), 9) FROM x""")
def a30_fidelity(spark, d):
    e = read(spark, d, "events").withColumn("later", micros(F.col("ts")) >= MID)
    return calibration.fidelity(e.where("not later"), e.where("later"), ["value"], ["event_type"]).withColumn("score", F.round("score", 9))


@query("a31_descriptors", f"WITH {EV}, x AS (SELECT *, row_number() OVER (ORDER BY available - t) - 1 AS k, count(*) OVER () AS n FROM ev) SELECT count(*) AS rows, avg((category = 'error')::INT) AS prevalence, min(available - t) AS delay_min, max(available - t) AS delay_max, max(CASE WHEN k = n // 2 THEN available - t END) AS delay_median FROM x")
def a31_descriptors(spark, d):
    e = payment_events(spark, d).withColumn("bad", F.col("category") == "error")
    return calibration.descriptors(e, "bad", "t", "available")


@query("a32_drop_vs_baseline", "WITH m AS (SELECT event_type AS model, avg(value) AS metric FROM events GROUP BY 1) SELECT model, round(metric, 9) AS metric, round(((SELECT metric FROM m WHERE model = 'view') - metric) / (SELECT metric FROM m WHERE model = 'view'), 9) AS drop FROM m")
def a32_drop_vs_baseline(spark, d):
    m = read(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("metric"))
    return predictions.drops(m, "model", "metric", "view").withColumns({"metric": F.round("metric", 9), "drop": F.round("drop", 9)})


@query("a39_run_metrics", "WITH x AS (SELECT event_id, value FROM events UNION ALL SELECT event_id, -value FROM events WHERE event_id % 9 = 0) SELECT count(*) AS rows, round(1 - count(DISTINCT event_id) / count(*), 12) AS duplicate_rate, round(avg((NOT value > 0)::INT), 12) AS invalid_rate FROM x")
def a39_run_metrics(spark, d):
    e = read(spark, d, "events").select("event_id", "value")
    rows = e.unionByName(e.where("event_id % 9 = 0").withColumn("value", -F.col("value")))
    out = delivery.run_metrics(rows, "event_id", F.col("value") > 0)
    return out.withColumns({c: F.round(c, 12) for c in ("duplicate_rate", "invalid_rate")})


@query("o04_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o04_top_k(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("o10_hash_order_sample", f"SELECT DISTINCT user_id FROM events QUALIFY dense_rank() OVER (ORDER BY {U.format('42/pick', 'user_id')}, user_id) <= 10")
def o10_hash_order_sample(spark, d):
    return campaigns.trajectories(read(spark, d, "events"), "user_id", 10)


@query("o11_counterfactual", """WITH s AS (SELECT event_id, value, (event_id % 40)::DOUBLE AS velocity FROM events), h AS (SELECT * FROM s WHERE value / 100 + velocity / 40 >= 1.2),
t(c, f, cost) AS (VALUES ('value', 0.25, 0.75), ('value', 0.5, 0.5), ('value', 0.75, 0.25), ('velocity', 0.25, 1.5), ('velocity', 0.5, 1.0), ('velocity', 0.75, 0.5)),
x AS (SELECT event_id, CAST(cost AS DOUBLE) AS cost, c, CAST(f AS DOUBLE) AS f FROM h, t WHERE (CASE WHEN c = 'value' THEN value * CAST(f AS DOUBLE) ELSE value END) / 100 + (CASE WHEN c = 'velocity' THEN velocity * CAST(f AS DOUBLE) ELSE velocity END) / 40 < 1.2),
b AS (SELECT event_id, min({'cost': cost, 'c': c, 'f': f}) AS b FROM x GROUP BY 1)
SELECT h.event_id, b.b.cost AS cost, b.b.c AS column, b.b.f AS factor FROM h LEFT JOIN b USING (event_id)""")
def o11_counterfactual(spark, d):
    rows = read(spark, d, "events").select("event_id", "value", (F.col("event_id") % 40).cast("double").alias("velocity"))
    score = F.col("value") / 100 + F.col("velocity") / 40
    return campaigns.counterfactuals(rows, "event_id", score, 1.2, {"value": ((0.25, 0.5, 0.75), 1.0), "velocity": ((0.25, 0.5, 0.75), 2.0)})


@query("d02_ordinal_ranges", """WITH n AS (SELECT count(*) AS n FROM orders), s AS (SELECT s, n // 7 + (s < n % 7)::INT AS size, s * (n // 7) + least(s, n % 7) AS start FROM n, range(7) r(s)), c AS (SELECT s, start, size, unnest(range(0, size, 500)) AS at_ FROM s)
SELECT s AS shard, at_ // 500 AS chunk, start + at_ AS first, start + least(at_ + 500, size) AS last FROM c""")
def d02_ordinal_ranges(spark, d):
    return delivery.ordinal_ranges(spark, read(spark, d, "orders").count(), 7, 500)


@query("d03_transport_partition", "SELECT CAST(('0x' || substr(sha256('\"' || user_id || '\"'), 1, 8))::BIGINT % 16 AS INT) AS partition, count(*) AS n FROM events GROUP BY 1")
def d03_transport_partition(spark, d):
    return read(spark, d, "events").groupBy(delivery.transport_partition(F.col("user_id")).alias("partition")).agg(F.count("*").alias("n"))


@query("n10_outages", f"WITH {EV}, x AS (SELECT *, CASE WHEN t >= {MID} AND t < {MID + 6 * HOUR} THEN {MID + 6 * HOUR} ELSE t END AS delivered FROM ev WHERE NOT (t >= {MID + DAY} AND t < {MID + DAY + 3 * HOUR})) SELECT count(*) AS n, sum((delivered <> t)::INT)::BIGINT AS moved, max(delivered) AS last FROM x")
def n10_outages(spark, d):
    out = delivery.outages(payment_events(spark, d), "t", [(MID, MID + 6 * HOUR, "BUFFER"), (MID + DAY, MID + DAY + 3 * HOUR, "DROP")])
    return out.agg(F.count("*").alias("n"), F.sum((F.col("delivered") != F.col("t")).cast("long")).alias("moved"), F.max("delivered").alias("last"))


@query("n10_spikes", f"SELECT user_id, CAST(count(*) * CASE WHEN {U.format('spike', 'user_id')} < 0.2 THEN 3 ELSE 1 END AS BIGINT) AS n FROM events GROUP BY user_id")
def n10_spikes(spark, d):
    return delivery.spikes(read(spark, d, "events"), F.col("user_id"), "event_id", 0.2, 3).groupBy("user_id").agg(F.count("*").alias("n"))


@query("n10_rotation", "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 + 3) % count(*) OVER (PARTITION BY user_id) AS delivery FROM events")
def n10_rotation(spark, d):
    return delivery.rotated(read(spark, d, "events"), "user_id", ["ts", "event_id"], 3).select("event_id", "delivery")


@query("n12_camouflage", """WITH m AS (SELECT user_id % 10 AS c, quantile_cont(value, 0.5) AS m FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT event_id, round((1 - 0.6) * value + 0.6 * coalesce(m, value), 5) AS value FROM events LEFT JOIN m ON m.c = user_id % 10 WHERE event_type = 'error'""")
def n12_camouflage(spark, d):
    e = read(spark, d, "events").withColumn("c", F.col("user_id") % 10)
    return campaigns.camouflage(e.where("event_type = 'error'"), e.where("event_type <> 'error'"), ["c"], "value", 0.6, 9).select("event_id", F.round("value", 5).alias("value"))


@query("n15_campaigns")
def n15_campaigns(spark, d):
    n = max(20, read(spark, d, "customer").count() // 10)
    started = F.lit(MID) + F.floor(hash_uniform("campaign", F.col("id")) * DAY)
    base = spark.range(n).select(F.concat(F.lit("CMP-"), F.col("id").cast("string")).alias("campaign_id"), started.alias("started"), (started + 20 * DAY).alias("ends"))
    return campaigns.evolve(base, 200)


@query("k18_dense_index", f"WITH {LINK}, n AS (SELECT DISTINCT src AS node FROM ed) SELECT node, row_number() OVER (PARTITION BY length(node) ORDER BY node) - 1 AS index FROM n")
def k18_dense_index(spark, d):
    nodes = _device_edges(spark, d).select(F.col("src").alias("node")).distinct().withColumn("kind", F.length("node"))
    return graph.dense_index(nodes, "kind", "node").select("node", F.col("index").cast("long").alias("index"))


@query("k11_publication_order", f"WITH {EV}, x AS (SELECT event_id, category AS topic, CAST(('0x' || substr(sha256('\"' || customer || '\"'), 1, 8))::BIGINT % 16 AS INT) AS p, t FROM ev) SELECT event_id, topic, p AS partition, row_number() OVER (PARTITION BY topic, p ORDER BY t, event_id) AS sequence FROM x")
def k11_publication_order(spark, d):
    e = payment_events(spark, d).select("event_id", "category", "customer", "t")
    out = delivery.publication_order(e, F.col("category"), F.col("customer"), "t", "event_id")
    return out.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), "topic", "partition", "sequence")


@query("u05_baseline_model")
def u05_baseline_model(spark, d):
    rows = payment_events(spark, d).select("event_id", "amount", (F.col("t") % DAY / float(HOUR)).alias("hour"), F.col("device").cast("double").alias("dev"), (F.col("category") == "purchase").cast("double").alias("y"))
    features = ["amount", "hour", "dev"]
    model = predictions.train_baseline(rows, features, "y")
    return predictions.predict(model, rows, features).select("event_id", F.round("score", 6).alias("score"))


#: Rows that a task joins by their key.
KEYED_ROWS = 500_000


@query("j17_workflow_checks", """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 3) SELECT 'dangling' AS rule, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'order', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE epoch_us(l_shipdate) < epoch_us(o_orderdate)""")
def j17_workflow_checks(spark, d):
    o, l = read(spark, d, "orders").select("o_orderkey", "o_orderdate"), read(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    parts = max(spark.sparkContext.defaultParallelism, -(-l.count() // KEYED_ROWS))  # as many as the rows need, which are not put together again
    o, l = o.repartition(parts, "o_orderkey"), l.repartition(parts, "l_orderkey")
    lost = workflow.dangling(l, "l_orderkey", o.where("o_orderkey % 10 <> 3"), "o_orderkey", "dangling")
    both = l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", micros(F.col("o_orderdate")).alias("a"), micros(F.col("l_shipdate")).alias("b"))
    found = lost.unionByName(workflow.out_of_order(both, "l_orderkey", ["a", "b"], "order"))
    return calibration.zero_filled(found, "rule", ["dangling", "order"]).withColumnRenamed("value", "rule")


@query("j10_source_prefix", f"WITH {EV}, k AS (SELECT * FROM ev WHERE available <= {MID}) SELECT (SELECT count(*) FROM k) AS facts, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT customer FROM k)) AS customers")
def j10_source_prefix(spark, d):
    known = workflow.prefix(payment_events(spark, d), F.col("available"), MID, [("customers", read(spark, d, "customer"), "customer", "c_custkey")])
    return known["facts"].agg(F.count("*").alias("facts")).select("facts", known["customers"].agg(F.count("*")).scalar().alias("customers"))


@query("a35_fault_rates", f"SELECT 'late' AS fault, 0.02::DOUBLE AS requested, round(avg(({U.format('late', 'event_id')} < 0.02)::INT), 12) AS realised, sum(({U.format('late', 'event_id')} < 0.02)::INT)::BIGINT AS rows FROM events")
def a35_fault_rates(spark, d):
    hit = hash_uniform("late", F.col("event_id")) < 0.02
    return workflow.requested_and_realised(read(spark, d, "events"), {"late": hit}, {"late": 0.02}).withColumn("realised", F.round("realised", 12))


@query("a23_performance_delta", f"WITH m AS (SELECT event_type AS name, avg(value) FILTER (epoch_us(ts) < {MID}) AS a, avg(value) FILTER (epoch_us(ts) >= {MID}) AS b FROM events GROUP BY 1) SELECT name, round(a, 9) AS reference, round(b, 9) AS current, round(b - a, 9) AS delta, coalesce(abs(b - a) >= 0.5, false) AS alert FROM m")
def a23_performance_delta(spark, d):
    e = read(spark, d, "events").withColumn("later", micros(F.col("ts")) >= MID)
    half = lambda later: e.where(F.col("later") == later).groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("v"))
    return workflow.compare(half(False), half(True), "name", "v", 0.5).withColumns({c: F.round(c, 9) for c in ("reference", "current", "delta")})


@query("g07_campaign_members", f"WITH {LINK}, m AS (SELECT tm // {DAY} AS campaign, tm, unnest([src, dst]) AS m FROM ed) SELECT campaign, array_to_string(list_sort(list(DISTINCT m)), ',') AS members, CAST(count(*) / 2 AS BIGINT) AS n_rows, min(tm) AS first_at, max(tm) AS last_at FROM m GROUP BY 1")
def g07_campaign_members(spark, d):
    e = _device_edges(spark, d).withColumn("campaign", F.floor(F.col("at") / DAY))
    return workflow.members(e, "campaign", ["src", "dst"], "at").withColumn("members", F.array_join("members", ",")).select("campaign", "members", "n_rows", "first_at", "last_at")
