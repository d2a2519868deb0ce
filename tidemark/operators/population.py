"""Entities and behaviour profiles: every row is a function of (seed, stream, ordinal).

A reference between entities is a draw of the other's ordinal, and what a row copies from its parent is drawn from the
parent's ordinal, so no entity needs a join (merchants alone look up which institutions acquire). Sizes of 0 give no rows;
nothing refers to an empty entity: its ids are null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import DAY, MICROS, hash_uniform, weighted_choice
from tidemark.operators.generate import START, _id
from tidemark.operators.running import running

#: What the columns may hold.
COUNTRIES = ("BR", "US", "GB", "DE")
CITIES = ("Aurora", "Boreal", "Cascata", "Dourado")
RISKS = ("LOW", "MEDIUM", "HIGH")
CUSTOMER_TYPES = ("PERSONAL", "BUSINESS")
INCOME_BANDS = ("LOW", "MIDDLE", "HIGH")
OCCUPATIONS = ("ENGINEERING", "EDUCATION", "HEALTHCARE", "COMMERCE")
CHANNELS = ("MOBILE", "WEB", "MOBILE,WEB")
INSTITUTIONS = ("BANK", "PSP", "ISSUER", "ACQUIRER", "DIGITAL_BANK", "PAYMENT_INSTITUTION")
ACQUIRING = ("ACQUIRER", "BANK", "PSP")
RISK_PROFILES = ("CONSERVATIVE", "STANDARD", "ELEVATED")
LATENCIES = ("FAST", "STANDARD", "SLOW")
ACCOUNTS = ("CHECKING", "PAYMENT_ACCOUNT", "CREDIT_CARD_ACCOUNT", "SAVINGS", "PERSONAL_LOAN", "BUSINESS_ACCOUNT")
SCHEMES = ("VISA", "MASTERCARD", "OTHER")
CARDS = ("DEBIT", "CREDIT", "PREPAID")
CATEGORIES = ("5411", "5311", "5732", "5812")
DEVICES = ("MOBILE", "DESKTOP", "TABLET", "POS_TERMINAL", "ATM")
SYSTEMS = ("ANDROID", "IOS", "WINDOWS", "LINUX")
BROWSERS = ("CHROMIUM", "SAFARI", "FIREFOX", "EMBEDDED")
PIX_KEYS = ("CPF_LIKE", "PHONE", "EMAIL", "RANDOM", "BUSINESS_ID_LIKE")
CUSTOMER_DAYS, ACCOUNT_DAYS, DEVICE_DAYS, CARD_DAYS, CARD_VALID_DAYS = 3650, 1825, 730, 365, 1095
BALANCES, CREDIT, OVERDRAFT, DAILY, SINGLE = (100.0, 25_000.0), (0.0, 50_000.0), (0.0, 5_000.0), (500.0, 20_000.0), (100.0, 10_000.0)
SPENDING = {"LOW": (1_500.0, 3_500.0), "MEDIUM": (3_500.0, 8_000.0), "HIGH": (8_000.0, 30_000.0)}
HOURS = ((7, 8, 12, 13, 18, 19), (9, 10, 12, 18, 20, 21), (6, 7, 11, 17, 18, 22))
#: Institutions up to this number are broadcast to the merchants.
MOST_BROADCAST = 100_000


@dataclass(frozen=True)
class Population:
    """How many entities of each kind there are, and how long the simulated time is."""

    customers: int
    institutions: int
    accounts: int
    cards: int
    merchants: int
    devices: int
    pix_keys: int
    days: int = 30
    seed: int = 42


class Draws:
    """Draws of one entity's columns; `key` is the ordinal, also that of another row."""

    def __init__(self, seed: int, entity: str, key: Column | str = "id") -> None:
        self.stream, self.key = f"{seed}/{entity}", F.col(key) if isinstance(key, str) else key

    def u(self, name: str) -> Column:
        return hash_uniform(f"{self.stream}/{name}", self.key)

    def below(self, name: str, count: int) -> Column:
        return F.floor(self.u(name) * count).cast("long")

    def one(self, name: str, values: Sequence[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (self.below(name, len(values)) + 1).cast("int"))

    def between(self, name: str, bounds: tuple[float, float], digits: int = 2) -> Column:
        return F.round(F.lit(bounds[0]) + self.u(name) * (bounds[1] - bounds[0]), digits)

    def yes(self, name: str) -> Column:
        return self.u(name) < 0.5

    def before(self, name: str, days: int) -> Column:
        return (F.lit(START) - F.floor(self.u(name) * days * 86_400) * MICROS).cast("long")

    def ref(self, name: str, prefix: str, count: int) -> Column:
        return _id(prefix, self.below(name, count)) if count else F.lit(None).cast("string")


def customers(spark: SparkSession, p: Population) -> DataFrame:
    d = Draws(p.seed, "customers")
    return spark.range(p.customers).select(
        _id("CUS-", d.key).alias("customer_id"), d.one("type", CUSTOMER_TYPES).alias("customer_type"), F.lit("ACTIVE").alias("customer_status"),
        F.date_sub(F.lit("2024-01-01").cast("date"), (18 * 365 + d.below("birth", 62 * 365)).cast("int")).alias("date_of_birth"), d.one("country", COUNTRIES).alias("country"), d.one("city", CITIES).alias("city"),
        d.one("risk", RISKS).alias("risk_segment"), d.one("income", INCOME_BANDS).alias("income_band"), d.one("occupation", OCCUPATIONS).alias("occupation_category"),
        F.split(d.one("channels", CHANNELS), ",").alias("preferred_channels"), d.before("since", CUSTOMER_DAYS).alias("valid_from"),
    )


def _institution_type(d: Draws) -> Column:
    return d.one("type", INSTITUTIONS)


def institutions(spark: SparkSession, p: Population) -> DataFrame:
    d = Draws(p.seed, "institutions")
    return spark.range(p.institutions).select(_id("INS-", d.key).alias("institution_id"), _institution_type(d).alias("institution_type"), F.lit("BR").alias("country"), _id("SYN", d.key).alias("institution_code"), d.one("risk", RISK_PROFILES).alias("risk_profile"), d.one("latency", LATENCIES).alias("processing_latency_profile"))


def account_columns(p: Population, key: Column) -> dict[str, Column]:
    """What an account's ordinal says of it; other entities copy from here."""
    d = Draws(p.seed, "accounts", key)
    return {
        "account_id": _id("ACC-", key),
        "customer_id": d.ref("customer", "CUS-", p.customers),
        "institution_id": d.ref("institution", "INS-", p.institutions),
        "account_type": d.one("type", ACCOUNTS),
        "balance": d.between("balance", BALANCES),
        "opening_date": d.before("opened", ACCOUNT_DAYS),
    }


def accounts(spark: SparkSession, p: Population) -> DataFrame:
    d = Draws(p.seed, "accounts")
    a = account_columns(p, d.key)
    return spark.range(p.accounts).select(
        *[a[c].alias(c) for c in ("account_id", "customer_id", "institution_id", "account_type")], F.lit("BRL").alias("currency"), F.lit("ACTIVE").alias("status"), d.between("credit", CREDIT).alias("credit_limit"),
        a["balance"].alias("available_balance"), a["balance"].alias("ledger_balance"), d.between("overdraft", OVERDRAFT).alias("overdraft_limit"), a["opening_date"].alias("valid_from"),
    )


def card_columns(p: Population, key: Column) -> dict[str, Column]:
    a = account_columns(p, Draws(p.seed, "cards", key).below("account", p.accounts))
    return {"card_id": _id("CARD-", key), "account_id": a["account_id"], "customer_id": a["customer_id"]}


def cards(spark: SparkSession, p: Population) -> DataFrame:
    """None where there is no account to hold them."""
    d = Draws(p.seed, "cards")
    issued = F.lit(START) - d.below("issued", CARD_DAYS + 1) * DAY
    return spark.range(p.cards if p.accounts else 0).select(
        *[c.alias(n) for n, c in card_columns(p, d.key).items()], d.one("scheme", SCHEMES).alias("scheme"), d.one("type", CARDS).alias("card_type"), F.lit("ACTIVE").alias("status"), issued.alias("issued_at"),
        (issued + CARD_VALID_DAYS * DAY).alias("expires_at"), F.lit("BR").alias("country"), d.yes("token").alias("network_token_enabled"), F.lit(True).alias("contactless_enabled"), F.lit(True).alias("online_enabled"),
        d.yes("abroad").alias("international_enabled"), d.between("daily", DAILY).alias("daily_limit"), d.between("single", SINGLE).alias("transaction_limit"),
    )


def merchants(spark: SparkSession, p: Population) -> DataFrame:
    """Acquirers are drawn among the institutions that acquire, or among all where none does."""
    d, i = Draws(p.seed, "merchants"), Draws(p.seed, "institutions")
    acquiring = spark.range(p.institutions).where(_institution_type(i).isin(*ACQUIRING)).select("id", F.lit(0).alias("_all"), F.lit(1).alias("_1"))
    some = acquiring.count()
    known = running(acquiring, ["_all"], ["id"], {"_n": ("sum", "_1")}, some).select((F.col("_n") - 1).alias("_k"), F.col("id").alias("_a")) if some else spark.range(p.institutions).select(F.col("id").alias("_k"), F.col("id").alias("_a"))
    known = F.broadcast(known) if p.institutions <= MOST_BROADCAST else known
    rows = spark.range(p.merchants).select("id", d.below("acquirer", some or p.institutions).alias("_k")).join(known, "_k", "left")
    return rows.select(
        _id("MER-", d.key).alias("merchant_id"), F.concat(F.lit("Synthetic Merchant "), _id("", d.key)).alias("merchant_name"), d.one("category", CATEGORIES).alias("merchant_category_code"), F.lit("BR").alias("country"),
        d.one("city", CITIES).alias("city"), d.one("risk", RISKS).alias("risk_segment"), F.when(F.col("_a").isNotNull(), _id("INS-", F.col("_a"))).alias("acquirer_id"), d.yes("online").alias("online_only"), d.before("since", ACCOUNT_DAYS).alias("created_at"),
    )


def devices(spark: SparkSession, p: Population) -> DataFrame:
    d = Draws(p.seed, "devices")
    return spark.range(p.devices).select(
        _id("DEV-", d.key).alias("device_id"), d.one("type", DEVICES).alias("device_type"), d.one("system", SYSTEMS).alias("os_family"), d.one("browser", BROWSERS).alias("browser_family"), d.before("seen", DEVICE_DAYS).alias("first_seen_at"),
        (F.lit(START) + d.below("day", p.days + 1) * DAY + d.below("hour", 24) * 3600 * MICROS).alias("last_seen_at"), d.yes("trusted").alias("trusted"), _id("synthetic-fingerprint-", d.key).alias("device_fingerprint"), F.round(d.u("risk"), 6).alias("risk_score"),
    )


def pix_keys(spark: SparkSession, p: Population) -> DataFrame:
    """None where there is no account to hold them."""
    d = Draws(p.seed, "pix_keys")
    a = account_columns(p, d.below("account", p.accounts))
    return spark.range(p.pix_keys if p.accounts else 0).select(_id("PIX-", d.key).alias("pix_key_id"), *[a[c].alias(c) for c in ("account_id", "customer_id", "institution_id")], d.one("type", PIX_KEYS).alias("key_type"), _id("synthetic-key-", d.key).alias("key_hash_or_synthetic_value"), a["opening_date"].alias("created_at"), F.lit("ACTIVE").alias("status"))


def state_history(spark: SparkSession, p: Population, chance: float) -> DataFrame:
    """Customers and accounts that are restricted half way through, and active again a microsecond later: two rows each."""
    half, out = START + p.days * DAY // 2, None
    for kind, prefix, count in (("CUSTOMER", "CUS-", p.customers), ("ACCOUNT", "ACC-", p.accounts)):
        hit = spark.range(count).where(Draws(p.seed, "history").u(kind) < chance)
        change = lambda old, new, at, end: F.struct(F.lit(old).alias("from_status"), F.lit(new).alias("to_status"), F.lit(at).alias("effective_at"), F.lit(at).alias("system_from"), F.lit(end).cast("long").alias("system_to"))
        both = F.explode(F.array(change("ACTIVE", "RESTRICTED", half, half + 1), change("RESTRICTED", "ACTIVE", half + 1, None)))
        rows = hit.select(_id(prefix, F.col("id")).alias("entity_id"), F.lit(kind).alias("entity_type"), both.alias("c")).select("entity_id", "entity_type", "c.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def endpoints(spark: SparkSession, p: Population, count: int) -> DataFrame:
    i = F.col("id")
    return spark.range(count).select(_id("IP-", i).alias("endpoint_id"), _id("synthetic-ip-", i).alias("address_hash"), F.lit(START).alias("first_seen_at"), F.lit(START + p.days * DAY).alias("last_seen_at"), F.lit(START).alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))


def entities(spark: SparkSession, p: Population) -> dict[str, DataFrame]:
    makers = (customers, institutions, accounts, cards, merchants, devices, pix_keys)
    return {m.__name__: m(spark, p) for m in makers}


def profiles(spark: SparkSession, p: Population, *, levels: Sequence[float] = (0.5, 0.35, 0.15), preferences: int = 3, preferred_devices: int = 3, hours: Sequence[int] = tuple(range(6, 23)), weekdays: Sequence[float] = (1.0,) * 7) -> DataFrame:
    """A behaviour profile for each customer.

    levels weighs LOW, MEDIUM and HIGH spending; preferences is the number of merchant categories, the lowest by a draw;
    preferred devices are drawn among all and kept if trusted, each once, so there may be fewer than drawn; hours are those
    with payments at all, and the typical ones weigh more.
    """
    d = Draws(p.seed, "profiles")
    level = weighted_choice(f"{d.stream}/level", d.key, dict(zip(SPENDING, levels, strict=True)))
    income = F.round(F.coalesce(*[F.when(F.col("spending_level") == n, F.lit(lo) + d.u("income") * (hi - lo)) for n, (lo, hi) in SPENDING.items()]), 2)
    pattern = F.element_at(F.array(*[F.array(*[F.lit(h) for h in one if h in hours] or [F.lit(h) for h in sorted(hours)[:6]]) for one in HOURS]), (d.below("hours", len(HOURS)) + 1).cast("int"))
    hour_weight = [F.round(F.when(F.array_contains("typical_payment_hours", h), 2.5).otherwise(0.35) * (0.8 + 0.4 * d.u(f"hour{h}")), 6) if h in hours else F.lit(0.0) for h in range(24)]
    day_weight = [F.round(w * ((0.55 + 1.25 * d.u("weekend")) if k >= 5 else (0.85 + 0.3 * d.u(f"day{k}"))), 6) for k, w in enumerate(weekdays)]
    ranked = F.slice(F.array_sort(F.array(*[F.struct(d.u(f"category{c}").alias("u"), F.lit(c).alias("c")) for c in CATEGORIES])), 1, min(preferences, len(CATEGORIES)))
    home = Draws(p.seed, "customers").one("country", COUNTRIES)
    abroad = F.filter(F.array(*map(F.lit, COUNTRIES)), lambda c: c != F.col("home"))
    drawn = [d.below(f"device{k}", p.devices) for k in range(preferred_devices if p.devices else 0)]
    mine = F.array_compact(F.array(*[F.when((F.lit(k) < 1 + d.below("devices", preferred_devices)) & Draws(p.seed, "devices", o).yes("trusted"), _id("DEV-", o)) for k, o in enumerate(drawn)])) if drawn else F.array().cast("array<string>")
    rows = spark.range(p.customers).select("id", level.alias("spending_level"), pattern.alias("typical_payment_hours"), home.alias("home"), F.round(0.01 + 0.29 * d.u("travel"), 4).alias("travel_frequency"), F.sort_array(F.transform(ranked, lambda s: s["c"])).alias("merchant_category_preferences"), F.sort_array(F.array_distinct(mine)).alias("preferred_device_ids"))
    rows = rows.withColumn("monthly_income", income)
    return rows.select(
        _id("BEH-", d.key).alias("behavior_profile_id"), _id("CUS-", d.key).alias("customer_id"), "spending_level", "typical_payment_hours", F.array(*hour_weight).alias("hour_weights"), F.array(*day_weight).alias("weekday_weights"),
        F.when(d.u("travels") < F.col("travel_frequency"), F.array("home", F.element_at(abroad, (d.below("abroad", len(COUNTRIES) - 1) + 1).cast("int")))).otherwise(F.array("home")).alias("typical_countries"),
        "merchant_category_preferences", F.transform("merchant_category_preferences", lambda c, k: F.round(0.5 + 1.5 * hash_uniform(f"{d.stream}/weight", F.concat_ws(":", d.key, c)), 4)).alias("merchant_category_weights"),
        "monthly_income", F.round(F.col("monthly_income") * (0.15 + 0.2 * d.u("budget")), 2).alias("monthly_spending_budget"), d.between("card", (0.15, 0.95), 4).alias("card_vs_transfer_preference"), d.between("online", (0.1, 0.9), 4).alias("online_purchase_rate"),
        "travel_frequency", "preferred_device_ids", F.size("preferred_device_ids").alias("trusted_device_count"),
    )
