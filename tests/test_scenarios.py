"""Entities, scenarios and the workflow after them: what must hold whatever the draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ledger, population, quality, scenarios
from tidemark.operators.population import Population
from tidemark.operators.scenarios import Scenario

P = Population(customers=40, institutions=6, accounts=50, cards=30, merchants=12, devices=25, pix_keys=20)
SETTINGS = {k: Scenario(count=12, attempts=9, amount_max=9_000.0) for k in scenarios.TRIGGERS}


def _paid(spark, p=P, **options):
    return scenarios.attempts(scenarios.campaigns(spark, SETTINGS, 10_000, 0.5, 50), p, SETTINGS, **options)


def test_references_of_entities_resolve(spark):
    made = population.entities(spark, P)
    ids = {"customer_id": "customers", "institution_id": "institutions", "account_id": "accounts"}
    for kind in ("accounts", "cards", "pix_keys"):
        for column in set(made[kind].columns) & set(ids) - {kind[:-1] + "_id"}:
            assert made[kind].join(made[ids[column]], column, "left_anti").count() == 0
    owner = made["cards"].join(made["accounts"].select("account_id", F.col("customer_id").alias("c")), "account_id")
    assert owner.where("c <> customer_id").count() == 0 and owner.count() == P.cards
    acquiring = made["merchants"].join(made["institutions"], F.col("acquirer_id") == F.col("institution_id"))
    kinds = {r[0] for r in made["institutions"].select("institution_type").collect()} & set(population.ACQUIRING)
    assert acquiring.count() == P.merchants and (not kinds or {r[0] for r in acquiring.select("institution_type").collect()} <= kinds)


def test_empty_populations_give_no_rows(spark):
    none = Population(0, 0, 0, 0, 0, 0, 0)
    assert all(t.count() == 0 for t in population.entities(spark, none).values())
    assert population.profiles(spark, none).count() == population.state_history(spark, none, 1.0).count() == _paid(spark, none).count() == 0
    lonely = Population(customers=1, institutions=0, accounts=1, cards=3, merchants=2, devices=0, pix_keys=0)
    assert population.accounts(spark, lonely).first().institution_id is None and population.merchants(spark, lonely).where("acquirer_id is not null").count() == 0
    assert {r[0] for r in _paid(spark, lonely).select("payment_rail").distinct().collect()} == {"CARD"}
    assert population.profiles(spark, lonely).first().preferred_device_ids == []


def test_campaigns_are_as_many_as_the_least_bound(spark):
    assert scenarios.campaigns(spark, SETTINGS, 100, 0.07, 50).count() == 7
    assert scenarios.campaigns(spark, SETTINGS, 10_000, 0.5, 1_000).count() == 60
    assert scenarios.campaigns(spark, SETTINGS | {"F02": Scenario(weight=0.0)}, 10_000, 0.5, 1_000).where("scenario_type = 'F02'").count() == 0


def test_attempts_keep_to_the_shape_of_their_scenario(spark):
    rows = _paid(spark).collect()
    assert {r.scenario_type for r in rows} == set(scenarios.TRIGGERS) and len({r.payment_id for r in rows}) == len(rows)
    balance = {r.account_id: r.available_balance for r in population.accounts(spark, P).collect()}
    for r in rows:
        assert r.scenario_id.startswith("HN-") != r.fraud_truth and r.payer_account_id != r.payee_account_id
        if r.scenario_type == "F04":
            assert 6_750 <= r.amount <= balance[r.payer_account_id] + 0.01 and "PIX_AUTHORIZED" in r.path
        if r.scenario_type == "F03":
            assert r.amount <= balance[r.payer_account_id] * (0.5 if r.fraud_truth else 0.25) + 0.01
        if r.scenario_type == "F02":
            assert r.amount <= 2 and (not r.fraud_truth or r.attempt % 4 == 0 or "CARD_CAPTURED" not in r.path)
        if r.scenario_type == "F01" and r.fraud_truth and r.attempt < 3:
            assert "CARD_CAPTURED" not in r.path
    assert any("CARD_CAPTURED" in r.path for r in rows if r.scenario_type == "F02" and not r.fraud_truth and r.attempt % 4)
    takeovers = {}
    for r in rows:
        if r.scenario_type == "F03":
            takeovers.setdefault(r.scenario_id, []).append(r)
    assert all(len(two) == 2 and two[0].amount == two[1].amount for two in takeovers.values())


def test_events_of_scenarios_are_valid_lifecycles_with_known_causes(spark):
    paid = _paid(spark)
    events = scenarios.scenario_events(paid)
    assert quality.lifecycle_violations(events.where("payment_rail = 'CARD'"), quality.CARD, quality.FIRST["CARD"]).count() == 0
    assert quality.lifecycle_violations(events.where("payment_rail = 'PIX'"), quality.PIX, quality.FIRST["PIX"]).count() == 0
    known = events.select(F.col("event_id").alias("causation_id"), F.col("event_time").alias("t"))
    caused = events.where("causation_id is not null")
    both = caused.join(known, "causation_id")
    assert both.count() == caused.count() > 0 and both.where("t >= event_time").count() == 0
    assert scenarios.records(paid).join(events, "event_id", "left_anti").count() == 0
    n = paid.where("scenario_type = 'F03' and fraud_truth and attempt = 1").count()
    assert events.where("event_id like '%SIGNAL%'").count() == 3 * n > 0


def test_workflow_follows_the_records(spark):
    paid = _paid(spark)
    loss = paid.select("payment_id", F.lit(3).cast(ledger.MONEY).alias("loss"))
    found = scenarios.records(paid)
    whole = scenarios.investigate(found, loss.unionByName(loss)).collect()
    assert len(whole) == found.count() and {r.investigation_outcome for r in whole} == {"CONFIRMED_FRAUD", "FALSE_POSITIVE"}
    assert all((r.label == "FRAUD") == r.fraud_truth and (r.dispute_at is not None) == r.fraud_truth and r.loss == 3 * r.fraud_truth for r in whole)
    none = scenarios.investigate(found, loss, confirmed=-1.0, disputed=-1.0).collect()
    assert {r.investigation_outcome for r in none} == {"UNRESOLVED"} and all(r.label is r.case_closed_at is r.label_available_at is None and r.loss == 0 for r in none)
    told = scenarios.investigate(found, loss, confirmed=-1.0).collect()
    assert all(r.investigation_outcome == ("CUSTOMER_DISPUTE" if r.fraud_truth else "UNRESOLVED") for r in told)
    assert scenarios.investigate(found, loss, alerted=-1.0).count() == 0


def test_realized_loss_falls_back_to_the_status(spark):
    paid = spark.createDataFrame([("a", "A", 10.0, "SETTLED"), ("b", "A", 20.0, "DECLINED"), ("c", "A", 30.0, "DECLINED"), ("d", "A", None, "SETTLED"), ("e", None, 5.0, None)], "payment_id string, payer_account_id string, amount double, current_status string")
    entries = spark.createDataFrame([("c", "A", "DEBIT", 30.0), ("c", "B", "CREDIT", 30.0), ("c", "A", "CREDIT", 12.5), ("c", "B", "DEBIT", 12.5), ("x", "A", "DEBIT", 1.0), ("e", None, "CREDIT", 2.0)], "payment_id string, account_id string, entry_type string, amount double")
    got = {r.payment_id: float(r.loss) for r in ledger.realized_loss(paid, entries).collect()}
    assert got == {"a": 10.0, "b": 0.0, "c": 17.5, "d": 0.0, "e": 0.0}
    assert ledger.realized_loss(paid, entries.limit(0)).count() == 5 and ledger.realized_loss(paid.limit(0), entries).count() == 0
