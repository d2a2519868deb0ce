"""Command line: queries, tables, runs and what is built from runs."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backtest, dataset, ledger, point_in_time, quality, replay
from tidemark.operators.records import fingerprint
from tidemark.plans import catalogue, catalogue_dataset, catalogue_generated, catalogue_more, catalogue_population  # noqa: F401  (the others add to the first)
from tidemark.sources import runs

Command = Callable[[argparse.Namespace], int | None]


def _spark() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _micros(text: str) -> int:
    """Microseconds of an ISO time; one without a zone counts as UTC."""
    from datetime import UTC, datetime

    at = datetime.fromisoformat(text)
    return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1_000_000)


def list_queries(args: argparse.Namespace) -> None:
    print("\n".join(sorted(catalogue.QUERIES)))


def run_query(args: argparse.Namespace) -> None:
    catalogue.QUERIES[args.query](_spark(), args.tables).write.mode("errorifexists").parquet(args.out)


def explain(args: argparse.Namespace) -> None:
    catalogue.QUERIES[args.query](_spark(), args.tables).explain("formatted")


def print_fingerprint(args: argparse.Namespace) -> None:
    print(json.dumps(fingerprint(_spark().read.parquet(args.table)).first().asDict()))


def build_dataset(args: argparse.Namespace) -> None:
    tables = runs.dataset_tables(runs.load_run(_spark(), args.run))
    split = point_in_time.temporal_split(F.col("now"), _micros(args.train_end), _micros(args.validation_end), args.gap_days * dataset.DAY) if args.train_end and args.validation_end else None
    dataset.write(dataset.build(tables, run_id=args.run_id, split=split, unresolved=args.unresolved), args.out)


def validate_ledger(args: argparse.Namespace) -> int:
    bad = ledger.validate_entries(runs.load_run(_spark(), args.run, ["ledger_entries"])["ledger_entries"])
    return _report(bad)


def validate_lifecycles(args: argparse.Namespace) -> int:
    run = runs.load_run(_spark(), args.run, ["payments", "payment_events"])
    events = run["payment_events"].join(run["payments"].select("payment_id", "payment_rail"), "payment_id").withColumn("event_time", F.unix_micros("event_time"))
    card = quality.lifecycle_violations(events.where("payment_rail = 'CARD'"), quality.CARD, quality.FIRST["CARD"])
    return _report(card.unionByName(quality.lifecycle_violations(events.where("payment_rail = 'PIX'"), quality.PIX, quality.FIRST["PIX"])))


def _report(violations) -> int:
    found = violations.groupBy("rule").agg(F.count("*").alias("n")).orderBy("rule").collect()
    for r in found:
        print(f"{r.rule}: {r.n}")
    return 1 if found else 0


def replay_run(args: argparse.Namespace) -> None:
    events = runs.load_run(_spark(), args.run, ["payment_events"])["payment_events"]
    events = events.withColumns({c: F.unix_micros(c) for c in replay.ENVELOPE if c.endswith(("_at", "_time"))})
    replay.replay({"payment_events": events}, _micros(args.start), _micros(args.end), args.order).write.mode("errorifexists").parquet(args.out)


def print_folds(args: argparse.Namespace) -> None:
    day = dataset.DAY
    for f in backtest.folds(_micros(args.start), _micros(args.end), test=args.test_days * day, step=args.step_days * day, gap=args.gap_days * day):
        print(json.dumps({"fold": f.name, "train": f.train, "test": f.test}))


def check_predictions(args: argparse.Namespace) -> None:
    print(runs.load_predictions(_spark(), args.file).count())


def print_ddl(args: argparse.Namespace) -> None:
    print(";\n".join(runs.ddl()) + ";")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run: Command, text: str, *positional: str, **options: object) -> None:
        p = sub.add_parser(name, help=text)
        for a in positional:
            p.add_argument(a)
        for o, default in options.items():
            p.add_argument(f"--{o.replace('_', '-')}", default=default, type=int if isinstance(default, int) else str)
        p.set_defaults(run_command=run)

    command("list", list_queries, "names of the queries")
    command("run", run_query, "run a query into a new Parquet folder", "query", "tables", "out")
    command("explain", explain, "print a query's physical plan", "query", "tables")
    command("fingerprint", print_fingerprint, "rows and digest of a Parquet table, whatever its order", "table")
    command("build-dataset", build_dataset, "the point-in-time dataset of a run", "run", "out", run_id="run", train_end="", validation_end="", gap_days=1, unresolved="include")
    command("validate-ledger", validate_ledger, "check the ledger entries of a run; exit code 1 if any is wrong", "run")
    command("validate-lifecycles", validate_lifecycles, "check the lifecycles of a run; exit code 1 if any is wrong", "run")
    command("replay", replay_run, "the events of a period in order, into a new Parquet folder", "run", "start", "end", "out", order="event_time_order")
    command("folds", print_folds, "the folds of a backtest", "start", "end", test_days=30, step_days=30, gap_days=14)
    command("check-predictions", check_predictions, "check a file of predictions and count them", "file")
    command("ddl", print_ddl, "CREATE TABLE statements for the tables of a run")
    args = parser.parse_args(argv)
    if getattr(args, "query", None) is not None and args.query not in catalogue.QUERIES:
        parser.error(f"no query {args.query!r}")
    return args.run_command(args) or 0


if __name__ == "__main__":
    raise SystemExit(main())
