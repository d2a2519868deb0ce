"""Queries of entities, profiles, fraud scenarios and the workflow after them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import DAY
from tidemark.operators import generate, ledger, population, scenarios
from tidemark.operators.population import Population
from tidemark.operators.scenarios import Scenario
from tidemark.plans.catalogue import U, query
from tidemark.plans.catalogue_generated import BACK, PAYMENTS, _cumulative, _lifecycle, states
from tidemark.sources.tables import read

DAYS = 30
SIZES = """s AS (SELECT (SELECT count(*) FROM customer) AS nc, (SELECT count(*) FROM nation) AS ni, (SELECT count(*) // 20 FROM orders) AS na, (SELECT count(*) FROM part) AS nk, (SELECT count(*) FROM supplier) AS nm, (SELECT count(*) FROM customer) AS nd, (SELECT count(*) FROM supplier) AS np, (SELECT count(*) FROM orders) AS no)"""


def _population(spark, d) -> Population:
    n = lambda name: read(spark, d, name).count()
    nc, nm = n("customer"), n("supplier")
    return Population(customers=nc, institutions=n("nation"), accounts=n("orders") // 20, cards=n("part"), merchants=nm, devices=nc, pix_keys=nm, days=DAYS)


class Sql:
    """Draws of one entity's columns in SQL."""

    def __init__(self, entity: str, key: str = "i") -> None:
        self.entity, self.key = entity, key

    def u(self, name: str) -> str:
        return U.format(f"42/{self.entity}/{name}", self.key)

    def below(self, name: str, count: int | str) -> str:
        return f"floor({self.u(name)} * {count})::BIGINT"

    def one(self, name: str, values) -> str:
        return f"{list(values)!r}[{self.below(name, len(values))} + 1]"

    def between(self, name: str, bounds, digits: int = 2) -> str:
        return f"round({bounds[0]!r} + {self.u(name)} * {bounds[1] - bounds[0]!r}, {digits})"

    def before(self, name: str, days: int) -> str:
        return f"({generate.START} - floor({self.u(name)} * {days} * 86400)::BIGINT * 1000000)"

    def yes(self, name: str) -> str:
        return f"({self.u(name)} < 0.5)"


def sid(prefix: str, ordinal: str) -> str:
    return f"'{prefix}' || lpad(({ordinal})::VARCHAR, 12, '0')"


def _account(key: str) -> dict[str, str]:
    a = Sql("accounts", key)
    return {"customer": sid("CUS-", a.below("customer", "nc")), "institution": sid("INS-", a.below("institution", "ni")), "balance": a.between("balance", population.BALANCES), "opened": a.before("opened", population.ACCOUNT_DAYS), "type": a.one("type", population.ACCOUNTS)}


def _rows(kind: str, count: str, id_: str, detail: list[str], numbers: list[str] = (), times: list[str] = (), extra: str = "") -> str:
    n, t = [*numbers, *["NULL"] * (3 - len(numbers))], [*times, *["NULL"] * (2 - len(times))]
    return f"SELECT '{kind}' AS kind, {id_} AS id, concat_ws('|', {', '.join(detail)}) AS detail, {', '.join(f'({x})::DOUBLE AS n{k}' for k, x in enumerate(n))}, {', '.join(f'({x})::BIGINT AS t{k}' for k, x in enumerate(t))} FROM (SELECT unnest(range({count})) AS i, s.* FROM s){extra}"


def _entities_sql() -> str:
    from tidemark.operators import population as p

    c, n, a, k, m, v, x = (Sql(e) for e in ("customers", "institutions", "accounts", "cards", "merchants", "devices", "pix_keys"))
    mine, of_card, of_key = _account("i"), _account(k.below("account", "na")), _account(x.below("account", "na"))
    issued = f"({generate.START} - {k.below('issued', p.CARD_DAYS + 1)} * {DAY})"
    parts = [
        _rows("customers", "nc", sid("CUS-", "i"), [c.one("type", p.CUSTOMER_TYPES), f"(DATE '2024-01-01' - ({18 * 365} + {c.below('birth', 62 * 365)})::INTEGER)::VARCHAR", c.one("country", p.COUNTRIES), c.one("city", p.CITIES), c.one("risk", p.RISKS), c.one("income", p.INCOME_BANDS), c.one("occupation", p.OCCUPATIONS), c.one("channels", p.CHANNELS)], [], [c.before("since", p.CUSTOMER_DAYS)]),
        _rows("institutions", "ni", sid("INS-", "i"), [n.one("type", p.INSTITUTIONS), sid("SYN", "i"), n.one("risk", p.RISK_PROFILES), n.one("latency", p.LATENCIES)]),
        _rows("accounts", "na", sid("ACC-", "i"), [mine["customer"], mine["institution"], mine["type"]], [a.between("credit", p.CREDIT), mine["balance"], a.between("overdraft", p.OVERDRAFT)], [mine["opened"]]),
        _rows("cards", "nk", sid("CARD-", "i"), [sid("ACC-", k.below("account", "na")), of_card["customer"], k.one("scheme", p.SCHEMES), k.one("type", p.CARDS), f"{k.yes('token')}::VARCHAR", f"{k.yes('abroad')}::VARCHAR"], [k.between("daily", p.DAILY), k.between("single", p.SINGLE)], [issued, f"{issued} + {p.CARD_VALID_DAYS * DAY}"]),
        _rows("merchants", "nm", sid("MER-", "i"), [sid("Synthetic Merchant ", "i"), m.one("category", p.CATEGORIES), m.one("city", p.CITIES), m.one("risk", p.RISKS), sid("INS-", "a"), f"{m.yes('online')}::VARCHAR"], [], [m.before("since", p.ACCOUNT_DAYS)], f" JOIN acq ON acq.k = floor({m.u('acquirer')} * (SELECT count(*) FROM acq))::BIGINT"),
        _rows("devices", "nd", sid("DEV-", "i"), [v.one("type", p.DEVICES), v.one("system", p.SYSTEMS), v.one("browser", p.BROWSERS), f"{v.yes('trusted')}::VARCHAR", sid("synthetic-fingerprint-", "i")], [f"round({v.u('risk')}, 6)"], [v.before("seen", p.DEVICE_DAYS), f"{generate.START} + {v.below('day', DAYS + 1)} * {DAY} + {v.below('hour', 24)} * 3600000000"]),
        _rows("pix_keys", "np", sid("PIX-", "i"), [sid("ACC-", x.below("account", "na")), of_key["customer"], of_key["institution"], x.one("type", p.PIX_KEYS)], [], [of_key["opened"]]),
    ]
    acquiring = f"acq AS (SELECT i AS a, row_number() OVER (ORDER BY i) - 1 AS k FROM (SELECT unnest(range(ni)) AS i FROM s) WHERE {n.one('type', p.INSTITUTIONS)} IN {p.ACQUIRING!r})"
    return f"WITH {SIZES}, {acquiring} " + " UNION ALL ".join(parts)


#: Of each entity: its id, the columns shown as text, numbers and times.
SHOWN = {
    "customers": ("customer_id", ["customer_type", "date_of_birth", "country", "city", "risk_segment", "income_band", "occupation_category", "preferred_channels"], [], ["valid_from"]),
    "institutions": ("institution_id", ["institution_type", "institution_code", "risk_profile", "processing_latency_profile"], [], []),
    "accounts": ("account_id", ["customer_id", "institution_id", "account_type"], ["credit_limit", "available_balance", "overdraft_limit"], ["valid_from"]),
    "cards": ("card_id", ["account_id", "customer_id", "scheme", "card_type", "network_token_enabled", "international_enabled"], ["daily_limit", "transaction_limit"], ["issued_at", "expires_at"]),
    "merchants": ("merchant_id", ["merchant_name", "merchant_category_code", "city", "risk_segment", "acquirer_id", "online_only"], [], ["created_at"]),
    "devices": ("device_id", ["device_type", "os_family", "browser_family", "trusted", "device_fingerprint"], ["risk_score"], ["first_seen_at", "last_seen_at"]),
    "pix_keys": ("pix_key_id", ["account_id", "customer_id", "institution_id", "key_type"], [], ["created_at"]),
}


@query("n01_entities", _entities_sql())
def n01_entities(spark, d):
    made, out = population.entities(spark, _population(spark, d)), []
    for kind, (id_, detail, numbers, times) in SHOWN.items():
        text = [F.array_join(c, ",") if c == "preferred_channels" else F.col(c).cast("string") for c in detail]
        n = [(F.col(numbers[k]) if k < len(numbers) else F.lit(None).cast("double")).alias(f"n{k}") for k in range(3)]
        t = [(F.col(times[k]) if k < len(times) else F.lit(None).cast("long")).alias(f"t{k}") for k in range(2)]
        out.append(made[kind].select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.concat_ws("|", *text).alias("detail"), *n, *t))
    return reduce(DataFrame.unionByName, out)


HALF = generate.START + DAYS * DAY // 2
_H = Sql("history")


@query("n01_state_history", f"""WITH {SIZES}, h AS ({" UNION ALL ".join(f"SELECT {sid(p, 'i')} AS entity_id, '{k}' AS entity_type FROM (SELECT unnest(range({n})) AS i FROM s) WHERE {_H.u(k)} < 0.2" for k, p, n in (("CUSTOMER", "CUS-", "nc"), ("ACCOUNT", "ACC-", "na")))})
SELECT *, 'ACTIVE' AS from_status, 'RESTRICTED' AS to_status, {HALF} AS effective_at, {HALF} AS system_from, {HALF + 1} AS system_to FROM h UNION ALL SELECT *, 'RESTRICTED', 'ACTIVE', {HALF + 1}, {HALF + 1}, NULL FROM h""")
def n01_state_history(spark, d):
    return population.state_history(spark, _population(spark, d), 0.2)


def _profiles_sql() -> str:
    p, d = population, Sql("profiles")
    income = " ".join(f"WHEN '{n}' THEN {lo!r} + {d.u('income')} * {hi - lo!r}" for n, (lo, hi) in p.SPENDING.items())
    hours = f"{[list(h) for h in p.HOURS]!r}[{d.below('hours', len(p.HOURS))} + 1]"
    weights = ", ".join(f"round(CASE WHEN list_contains(typical, {h}) THEN 2.5 ELSE 0.35 END * (0.8 + 0.4 * {d.u(f'hour{h}')}), 6)" if 6 <= h < 23 else "0.0::DOUBLE" for h in range(24))
    days = ", ".join(f"round(1.0 * {f'(0.55 + 1.25 * {d.u('weekend')})' if k >= 5 else f'(0.85 + 0.3 * {d.u(f'day{k}')})'}, 6)" for k in range(7))
    categories = ", ".join(f"{{'u': {d.u(f'category{c}')}, 'c': '{c}'}}" for c in p.CATEGORIES)
    drawn = [d.below(f"device{k}", "nd") for k in range(3)]
    mine = ", ".join(f"CASE WHEN {k} < 1 + {d.below('devices', 3)} AND {Sql('devices', o).yes('trusted')} THEN {sid('DEV-', o)} END" for k, o in enumerate(drawn))
    home = Sql("customers").one("country", p.COUNTRIES)
    weight = U.format("42/profiles/weight", "(i::VARCHAR || ':' || c)")
    return f"""WITH {SIZES}, a AS (SELECT i, nd, {_cumulative(dict(zip(p.SPENDING, (0.5, 0.35, 0.15), strict=True)), d.u("level"))} AS level, {hours} AS typical, {home} AS home, round(0.01 + 0.29 * {d.u("travel")}, 4) AS travel,
 list_sort(list_transform(list_slice(list_sort([{categories}]), 1, 3), lambda x: x.c)) AS cats, list_sort(list_distinct(list_filter([{mine}], lambda x: x IS NOT NULL))) AS devs FROM (SELECT unnest(range(nc)) AS i, s.* FROM s)),
b AS (SELECT *, round(CASE level {income} END, 2) AS income FROM a)
SELECT {sid("BEH-", "i")} AS behavior_profile_id, {sid("CUS-", "i")} AS customer_id, level AS spending_level, array_to_string(typical, ',') AS hours, array_to_string([{weights}], ',') AS hour_weights, array_to_string([{days}], ',') AS weekday_weights,
 CASE WHEN {d.u("travels")} < travel THEN home || ',' || list_filter({list(p.COUNTRIES)!r}, lambda x: x <> home)[{d.below("abroad", len(p.COUNTRIES) - 1)} + 1] ELSE home END AS countries, array_to_string(cats, ',') AS categories,
 array_to_string(list_transform(cats, lambda c: round(0.5 + 1.5 * {weight}, 4)), ',') AS category_weights, income AS monthly_income, round(income * (0.15 + 0.2 * {d.u("budget")}), 2) AS budget, {d.between("card", (0.15, 0.95), 4)} AS card_preference, {d.between("online", (0.1, 0.9), 4)} AS online_rate,
 travel AS travel_frequency, array_to_string(devs, ',') AS devices, len(devs) AS n_devices FROM b"""


@query("n02_profiles", _profiles_sql())
def n02_profiles(spark, d):
    made = population.profiles(spark, _population(spark, d))
    text = lambda c, name: F.array_join(F.col(c).cast("array<string>"), ",").alias(name)
    return made.select(
        "behavior_profile_id", "customer_id", "spending_level", text("typical_payment_hours", "hours"), text("hour_weights", "hour_weights"), text("weekday_weights", "weekday_weights"), text("typical_countries", "countries"),
        text("merchant_category_preferences", "categories"), text("merchant_category_weights", "category_weights"), "monthly_income", F.col("monthly_spending_budget").alias("budget"), F.col("card_vs_transfer_preference").alias("card_preference"),
        F.col("online_purchase_rate").alias("online_rate"), "travel_frequency", text("preferred_device_ids", "devices"), F.col("trusted_device_count").alias("n_devices"),
    )


#: Bounds at which both sides of every rule occur: some balances are too low for a scam.
SETTINGS = {"F01": Scenario(2.0, 40), "F02": Scenario(1.0, 30, amount_min=2.0, attempts=10, window=90), "F03": Scenario(1.0, 30), "F04": Scenario(1.5, 30, amount_min=50.0, amount_max=8_000.0), "F05": Scenario(0.5, 20, attempts=12, window=45)}
MOST, RATE = 90, 0.04
_C, _A, _B = Sql("campaigns", "sid"), Sql("attempts", "k"), _account("payer")


def _each(values: dict[str, object]) -> str:
    return "CASE typ " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


ON_CARDS = "typ IN ('F01', 'F02', 'F05')"
SCENARIOS = f"""{SIZES}, slot AS ({" UNION ALL ".join(f"SELECT '{k}' AS typ, {sid(k + '-', 'i')} AS sid, {s.weight!r}::DOUBLE AS w FROM (SELECT unnest(range({s.count})) AS i)" for k, s in SETTINGS.items())}),
camp AS (SELECT typ, sid FROM (SELECT *, row_number() OVER (ORDER BY -ln(1.0 - {_C.u("slot")}) / w, sid) AS place FROM slot), s WHERE place <= least({MOST}, floor(no * {RATE!r}::DOUBLE), {sum(s.count for s in SETTINGS.values())})),
k1 AS (SELECT typ, CASE WHEN truth THEN sid ELSE 'HN-' || sid END AS sid, truth, s.* FROM (SELECT *, unnest([true, false]) AS truth FROM camp), s),
k2 AS (SELECT *, {_each({k: 3 if k == "F01" else s.attempts if k in ("F02", "F05") else 2 if k == "F03" else 1 for k, s in SETTINGS.items()})} AS n, CASE WHEN {ON_CARDS} THEN {_C.below("card", "nk")} END AS card FROM k1),
k3 AS (SELECT *, CASE WHEN {ON_CARDS} THEN {Sql("cards", "card").below("account", "na")} ELSE {_C.below("payer", "na")} END AS payer FROM k2),
k4 AS (SELECT *, CASE WHEN NOT {ON_CARDS} THEN (payer + 1 + {_C.below("payee", "(na - 1)")}) % na END AS payee, unnest(range(1, n + 1)) AS attempt FROM k3),
k5 AS (SELECT *, sid || '-' || lpad(attempt::VARCHAR, 12, '0') AS k, {_each({k: max(s.amount_min, 0.75 * s.amount_max) if k == "F04" else s.amount_min for k, s in SETTINGS.items()})}::DOUBLE AS lo,
 CASE typ WHEN 'F02' THEN 4.0::DOUBLE WHEN 'F03' THEN least({SETTINGS["F03"].amount_max!r}, {_B["balance"]} * CASE WHEN truth THEN 0.5 ELSE 0.25 END) WHEN 'F04' THEN least(8000.0, {_B["balance"]}) ELSE {SETTINGS["F01"].amount_max!r} END::DOUBLE AS hi FROM k4),
pay AS (SELECT *, 'PAY-' || k AS payment_id, CASE WHEN {ON_CARDS} THEN 'CARD' WHEN typ = 'F03' THEN 'ACCOUNT_TRANSFER' ELSE 'PIX' END AS rail, round(greatest(lo, lo + CASE WHEN {ON_CARDS} THEN {_A.u("amount")} ELSE {_C.u("amount")} END * (hi - lo)), 2) AS amount,
 {generate.START} + {_C.below("start", DAYS * 86_400)} * 1000000 + {_each({k: f"floor((attempt - 1) * {s.window} / n)" if k in ("F02", "F05") else "attempt + 2" if k == "F03" else "attempt - 1" for k, s in SETTINGS.items()})}::BIGINT * 1000000 AS t,
 CASE WHEN typ = 'F03' AND truth AND attempt = 2 THEN 'REPEAT_TRANSFER' ELSE CASE WHEN truth THEN {_each({k: f"'{f}'" for k, (f, _) in scenarios.TRIGGERS.items()})} ELSE {_each({k: f"'{f}'" for k, (_, f) in scenarios.TRIGGERS.items()})} END END AS trigger, {_B["customer"]} AS customer FROM k5 WHERE hi >= lo AND hi > 0),
w1 AS (SELECT *, {states(generate.CHANCES)} AS usual, {states(generate.CHANCES | {"pix_approved": 1.0, "pix_rejected": 0.0})} AS sure FROM pay),
scen AS (SELECT *, CASE WHEN typ = 'F04' THEN sure WHEN truth AND ((typ = 'F01' AND attempt < n) OR (typ = 'F02' AND attempt % 4 <> 0)) AND list_contains(usual, 'CARD_AUTHORIZED') THEN list_slice(usual, 1, list_position(usual, 'CARD_AUTHORIZED') - 1) || ['CARD_DECLINED'] ELSE usual END AS path FROM w1)"""


def _attempts(spark, d) -> DataFrame:
    p = _population(spark, d)
    planted = scenarios.campaigns(spark, SETTINGS, read(spark, d, "orders").count(), RATE, MOST)
    return scenarios.attempts(planted, p, SETTINGS)


@query("n06_scenarios", f"""WITH {SCENARIOS} SELECT payment_id, rail AS payment_rail, {sid("ACC-", "payer")} AS payer_account_id, CASE WHEN payee IS NOT NULL THEN {sid("ACC-", "payee")} END AS payee_account_id, amount, t AS initiated, typ AS scenario_type, sid AS scenario_id, attempt, trigger, truth AS fraud_truth,
 customer AS customer_id, CASE WHEN card IS NOT NULL THEN {sid("CARD-", "card")} END AS card_id, CASE WHEN {ON_CARDS} THEN {sid("MER-", _A.below("merchant", "nm"))} END AS merchant_id, {sid("DEV-", _C.below("device", "nd"))} AS device_id, CASE WHEN typ = 'F04' THEN {sid("PIX-", _C.below("pix", "np"))} END AS pix_key_id, array_to_string(path, ',') AS path FROM scen""")
def n06_scenarios(spark, d):
    return _attempts(spark, d).withColumn("path", F.array_join("path", ","))


@query("n06_scenario_events", f"""WITH {SCENARIOS}, sec(s, took) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in generate.SECONDS.items())}), un AS (SELECT payment_id, k, sid, typ, truth, attempt, t, unnest(path) AS event_type, unnest(range(len(path))) AS step FROM scen),
le AS (SELECT 'EVT-' || k || '-' || step AS event_id, event_type, t + sum(coalesce(took, 0)) OVER (PARTITION BY payment_id ORDER BY step) * 1000000 AS event_time, CASE WHEN step > 0 THEN 'EVT-' || k || '-' || (step - 1) WHEN typ = 'F03' AND truth AND attempt = 1 THEN 'EVT-' || sid || '-SIGNAL-2' WHEN typ = 'F03' AND truth THEN 'EVT-' || sid || '-' || lpad('1', 12, '0') || '-0' END AS causation_id FROM un LEFT JOIN sec ON sec.s = event_type)
SELECT event_id, event_type, event_time::BIGINT AS event_time, causation_id FROM le UNION ALL
SELECT 'EVT-' || sid || '-SIGNAL-' || j, {list(scenarios.SIGNALS)!r}[j + 1], t + (j - 3) * 1000000, CASE WHEN j > 0 THEN 'EVT-' || sid || '-SIGNAL-' || (j - 1) END FROM (SELECT *, unnest(range(3)) AS j FROM scen WHERE typ = 'F03' AND truth AND attempt = 1)""")
def n06_scenario_events(spark, d):
    return scenarios.scenario_events(_attempts(spark, d)).select("event_id", "event_type", "event_time", "causation_id")


POSTED = ", ".join(f"'{x}'" for x in generate.POSTED)
_W = Sql("workflow", "rid")
SHARES = {"alerted": 0.9, "opened": 0.8, "confirmed": 0.7, "disputed": 0.6}


@query("n07_workflow", f"""WITH {SCENARIOS}, r AS (SELECT *, 'FRD-' || k AS rid, CASE WHEN payee IS NULL THEN CASE WHEN regexp_replace(path[-1], '^(CARD|PIX|TRANSFER)_', '') IN {ledger.PAID!r} THEN amount ELSE 0 END ELSE greatest(0, amount * (len(list_filter(path, lambda x: x IN ({POSTED}))) - len(list_filter(path, lambda x: x IN ({BACK}))))) END AS lost FROM scen WHERE truth OR attempt = 1),
a AS (SELECT *, t + (CASE rail WHEN 'PIX' THEN 2 ELSE 5 END + 62) * 1000000 AS alert FROM r WHERE {_W.u("alert")} <= {SHARES["alerted"]}), o AS (SELECT *, CASE WHEN {_W.u("case")} <= {SHARES["opened"]} THEN alert + 300000000 END AS opened FROM a),
c AS (SELECT *, CASE WHEN {_W.u("confirm")} <= {SHARES["confirmed"]} THEN opened + 86400000000 END AS confirmed, CASE WHEN truth AND {_W.u("dispute")} <= {SHARES["disputed"]} THEN opened + 172800000000 END AS disputed FROM o),
e AS (SELECT *, greatest(confirmed, disputed + 4000000) AS closed, CASE WHEN opened IS NULL THEN NULL WHEN confirmed IS NOT NULL THEN CASE WHEN truth THEN 'CONFIRMED_FRAUD' ELSE 'FALSE_POSITIVE' END WHEN disputed IS NOT NULL THEN 'CUSTOMER_DISPUTE' ELSE 'UNRESOLVED' END AS outcome FROM c)
SELECT rid AS fraud_record_id, alert::BIGINT AS alert_created_at, opened::BIGINT AS case_opened_at, confirmed::BIGINT AS confirmed_at, disputed::BIGINT AS dispute_at, closed::BIGINT AS case_closed_at, outcome AS investigation_outcome, (closed + 3600000000)::BIGINT AS label_available_at, CASE WHEN closed IS NULL THEN NULL WHEN outcome IN ('CONFIRMED_FRAUD', 'CUSTOMER_DISPUTE') THEN 'FRAUD' ELSE 'LEGITIMATE' END AS label, CASE WHEN outcome = 'CONFIRMED_FRAUD' THEN lost ELSE 0 END::DOUBLE AS loss FROM e""")
def n07_workflow(spark, d):
    pay = _attempts(spark, d)
    entries = generate.ledger_entries(scenarios.scenario_events(pay))
    loss = ledger.realized_loss(pay.withColumn("current_status", scenarios.final_status(pay)), entries)
    found = scenarios.investigate(scenarios.records(pay), loss, **SHARES)
    return found.select("fraud_record_id", "alert_created_at", "case_opened_at", "confirmed_at", "dispute_at", "case_closed_at", "investigation_outcome", "label_available_at", "label", F.col("loss").cast("double").alias("loss"))


@query("a34_realized_loss", f"""WITH {PAYMENTS}, e AS (SELECT payment_id, CASE WHEN event_type IN ({BACK}) THEN CAST(amount AS DECIMAL(18, 2)) ELSE 0 END AS c, CASE WHEN event_type IN ({POSTED}) THEN CAST(amount AS DECIMAL(18, 2)) ELSE 0 END AS d FROM le WHERE event_type IN ({BACK}, {POSTED}))
SELECT pm.payment_id, greatest(0, coalesce(x.lost, 0))::DOUBLE AS loss FROM pm LEFT JOIN (SELECT payment_id, sum(d) - sum(c) AS lost FROM e GROUP BY 1) x USING (payment_id)""")
def a34_realized_loss(spark, d):
    n = read(spark, d, "orders").count()
    pay = generate.payments(spark, 0, n, max(2, n // 20)).withColumn("current_status", F.lit("INITIATED"))
    out = ledger.realized_loss(pay, generate.ledger_entries(_lifecycle(spark, d)))
    return out.select("payment_id", F.col("loss").cast("double").alias("loss"))

