"""Runs on disk: a folder of Parquet tables in groups, scanned with their types, and written so that what is there is never replaced."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.shipping import write_bytes
from tidemark.operators.dataset import initial_events
from tidemark.sources.sinks import masked

S, L, D, B, A = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


#: The tables of a run by group, with their columns in order.
TABLES: dict[str, dict[str, T.StructType]] = {
    "entities": {
        "customers": _schema(customer_id=S, country=S, risk_segment=S, valid_from=A, valid_to=A, created_at=A),
        "institutions": _schema(institution_id=S, country=S),
        "accounts": _schema(account_id=S, customer_id=S, institution_id=S, ledger_balance=D, credit_limit=D, opening_date=A, valid_from=A, valid_to=A, system_from=A),
        "cards": _schema(card_id=S, customer_id=S, account_id=S, issued_at=A, expires_at=A),
        "merchants": _schema(merchant_id=S, acquirer_id=S, country=S, created_at=A),
        "devices": _schema(device_id=S, customer_id=S, first_seen_at=A, last_seen_at=A, trusted=B),
        "pix_keys": _schema(pix_key_id=S, customer_id=S, account_id=S, created_at=A),
    },
    "behavior": {
        "payments": _schema(payment_id=S, customer_id=S, payer_account_id=S, payee_account_id=S, merchant_id=S, card_id=S, payment_rail=S, payment_type=S, amount=D, initiated_at=A),
        "payment_events": _schema(event_id=S, payment_id=S, customer_id=S, device_id=S, event_type=S, amount=D, online=B, event_time=A, source_created_at=A, source_available_at=A, ingested_at=A, processed_at=A, correlation_id=S, causation_id=S, scenario_id=S, fraud_truth=B),
        "ledger_entries": _schema(ledger_entry_id=S, event_id=S, payment_id=S, account_id=S, entry_type=S, amount=D, effective_at=A, posted_at=A),
        "fraud_labels": _schema(label_id=S, payment_id=S, customer_id=S, label=S, amount=D, fraud_occurred_at=A, fraud_confirmed_at=A, label_available_at=A, fraud_truth=B),
    },
}
#: Columns that older files may lack, and what they are filled from; columns that tell the truth.
LEGACY = {"payment_events": {"ingested_at": "source_available_at", "processed_at": "source_available_at"}}
TRUTH = {"payment_events": ("scenario_id", "fraud_truth"), "fraud_labels": ("fraud_truth",)}


def write_run(tables: Mapping[str, DataFrame], path: str, *, run_id: str, hide_truth: bool = True) -> None:
    """Tables by name, with their columns and types; hidden truth is null. The manifest comes last, and marks the run as whole."""
    known = {name: (group, schema) for group, all_ in TABLES.items() for name, schema in all_.items()}
    unknown = set(tables) - set(known)
    if unknown:
        raise ValueError(f"unknown tables {sorted(unknown)}")
    rows = {}
    for name, table in tables.items():
        group, schema = known[name]
        masked(table, schema, TRUTH.get(name, ()) if hide_truth else ()).write.mode("errorifexists").parquet(f"{path}/{group}/{name}")
        rows[name] = next(iter(tables.values())).sparkSession.read.parquet(f"{path}/{group}/{name}").count()
    spark = next(iter(tables.values())).sparkSession
    write_bytes(spark, f"{path}/manifest.json", json.dumps({"run_id": run_id, "rows": rows, "truth": not hide_truth}, sort_keys=True).encode())


def load_run(spark: SparkSession, path: str, names: Sequence[str] | None = None, *, optional: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables of a run that was written whole. Missing columns and other types are errors, but for what older files lack; missing
    optional tables are empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda p: files.exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    if not there(f"{path}/manifest.json"):
        raise ValueError(f"{path} has no manifest: the run is not whole")
    out = {}
    for group, all_ in TABLES.items():
        for name, schema in all_.items():
            if names is not None and name not in names:
                continue
            if there(f"{path}/{group}/{name}"):
                out[name] = _scan(spark, f"{path}/{group}/{name}", schema, LEGACY.get(name, {}))
            elif name in optional:
                out[name] = spark.createDataFrame([], schema)
            elif names is not None:
                raise ValueError(f"{path}: table {name} is missing")
    return out


def _scan(spark: SparkSession, path: str, schema: T.StructType, legacy: Mapping[str, str]) -> DataFrame:
    """A typed scan; a legacy column that is missing, or null in a row, has the value of its source."""
    found = spark.read.parquet(path)
    have = {f.name: f.dataType for f in found.schema}
    columns = []
    for f in schema:
        source = legacy.get(f.name)
        if f.name not in have and source not in have:
            raise ValueError(f"{path}: column {f.name} is missing")
        if f.name in have and have[f.name] != f.dataType:
            raise ValueError(f"{path}: column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
        own = [F.col(c) for c in (f.name, source) if c in have]
        columns.append((F.coalesce(*own) if len(own) > 1 else own[0]).cast(f.dataType).alias(f.name))
    return found.select(*columns)


PREDICTIONS = {"model": "string", "payment_id": "string", "event_id": "string", "customer_id": "string", "dataset_row_id": "string", "prediction_time": "timestamp", "score": "double"}


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from Parquet or JSON lines with exactly the known columns, scores from 0 to 1, and at least one row."""
    schema = ", ".join(f"{c} {t}" for c, t in PREDICTIONS.items())
    lines = path.endswith((".jsonl", ".json"))
    found = spark.read.option("mode", "FAILFAST").schema(schema).json(path) if lines else spark.read.parquet(path)
    if set(found.columns) != set(PREDICTIONS):
        raise ValueError(f"{path}: columns {sorted(set(found.columns) ^ set(PREDICTIONS))} are missing or unknown")
    out = found.select(*[F.col(c).cast(t) for c, t in PREDICTIONS.items()])
    rows, bad = out.agg(F.count("*"), F.sum((~F.coalesce(F.col("score").between(0, 1), F.lit(False))).cast("long"))).first()
    if not rows or bad:
        raise ValueError(f"{path}: {bad or 'no'} rows {'with a score outside 0 to 1' if bad else ''}".strip())
    return out


def metrics_text(rows: DataFrame, prefix: str = "tidemark") -> str:
    """(metric, value) rows in the text format that metric scrapers read, sorted by name."""
    return "".join(f"{prefix}_{r.metric} {r.value:.10g}\n" for r in rows.orderBy("metric").collect())


def ddl(dialect_money: str = "NUMERIC(38, 9)") -> list[str]:
    """CREATE TABLE statements for all tables of a run, each keyed by its first column."""
    kinds = {S: "TEXT", L: "BIGINT", D: dialect_money, B: "BOOLEAN", A: "TIMESTAMPTZ"}
    out = []
    for all_ in TABLES.values():
        for name, schema in all_.items():
            columns = ",\n  ".join(f"{f.name} {kinds[f.dataType]}{' PRIMARY KEY' if k == 0 else ''}" for k, f in enumerate(schema))
            out.append(f"CREATE TABLE IF NOT EXISTS {name} (\n  {columns}\n)")
    return out


def dataset_tables(run: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that operators.dataset builds from, with times in microseconds, from the tables of a run.

    A payment's initial event is the one of an opening type without a cause; payments without one make no row.
    """
    t = {name: table.withColumns({f.name: F.unix_micros(f.name) for f in table.schema if f.dataType == A}) for name, table in run.items()}
    first = initial_events(t["payment_events"]).select("payment_id", "event_id", "device_id", "online", "event_time", "source_available_at")
    payments = t["payments"].join(first, "payment_id").withColumnRenamed("payer_account_id", "account_id")
    labels = t["fraud_labels"].join(t["payments"].select("payment_id", "merchant_id"), "payment_id", "left")
    return {
        "payments": payments.select("payment_id", "event_id", "customer_id", "account_id", "merchant_id", "card_id", "device_id", "payment_rail", "payment_type", "amount", "online", "event_time", "source_available_at"),
        "accounts": t["accounts"],
        "merchants": t["merchants"].select("merchant_id", "country", "created_at"),
        "devices": t["devices"].select("device_id", "first_seen_at", "trusted"),
        "cards": t["cards"].select("card_id", "issued_at"),
        "labels": labels.select("payment_id", "customer_id", "merchant_id", "label", "amount", "fraud_occurred_at", "fraud_confirmed_at", "label_available_at", "fraud_truth"),
        "entries": t["ledger_entries"].select("account_id", "entry_type", "amount", "effective_at", "posted_at"),
    }
