"""Ranks over ranges: each row's key is worked out once for each pass, and results are those of one order over all rows."""

from __future__ import annotations

import bisect
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ranges
from tidemark.operators import evaluation
from tidemark.operators import point_in_time as pit
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def oracle(name: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con.execute(catalogue.ORACLES[name]).fetchall()


def scored(spark, n: int, kinds: int = 40):
    """(score, id, label) with many ties, and some labels unknown."""
    rng = random.Random(n)
    rows = [(float(rng.randrange(kinds)), k, rng.choice([True, False, False, None])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "s double, i long, y boolean").repartition(3)


def test_pr_auc_works_a_score_out_once_for_each_pass(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 50)
    out = catalogue.QUERIES["a13_pr_auc"](spark, SF)
    assert optimized(out).count("sha2(") == 2  # sizes of the ranges, and ranks; no look for null ranges
    assert list(map(tuple, out.collect())) == oracle("a13_pr_auc")


def test_only_sampled_keys_are_worked_out_for_the_cuts(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 100)
    seen = []
    monkeypatch.setattr(ranges, "_number_of", lambda key, bounds, kind: seen.append(bounds) or F.lit(0))
    same = spark.createDataFrame([(1.0, k) for k in range(5000)], "s double, i long").repartition(4)
    dear = same.select("s", F.when(F.col("i") >= 0, F.col("i")).otherwise(F.raise_error(F.lit("x"))).cast("long").alias("i"))
    ranges.with_range(dear, ["s", "i"])
    assert 25 <= len(seen[0]) <= 80 and [b["k1"] for b in seen[0]] == sorted({b["k1"] for b in seen[0]})
    asked = []
    monkeypatch.setattr(type(dear), "sample", lambda self, *a, _f=type(dear).sample, **b: asked.append(self) or _f(self, *a, **b))
    ranges.with_range(dear, ["s", "i"])
    assert len(asked) == 1  # taken before the keys, so that compiled code works out the sampled rows' alone


@pytest.mark.parametrize("cuts", [0, 1, 2, 3, 7, 8, 33])
def test_a_range_is_found_by_bisection(spark, cuts):
    rng = random.Random(cuts)
    bounds = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(cuts)})
    rows = [(a, b) for a in range(-1, 10) for b in range(-1, 10)]
    df = spark.createDataFrame([*rows, (None, 3)], "a long, b long")
    number = ranges._number_of(F.struct(F.col("a").alias("k0"), F.col("b").alias("k1")), [{"k0": a, "k1": b} for a, b in bounds], "struct<k0:bigint,k1:bigint>")
    got = {(r.a, r.b): r.n for r in df.select("a", "b", number.alias("n")).collect()}
    assert got == {k: bisect.bisect_left(bounds, k) for k in rows} | {(None, 3): 0}


def test_rank_totals_and_maximum_have_no_filter_on_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 20)
    _, df = scored(spark, 300)
    found = [
        evaluation.global_rank(df, [F.col("s"), F.col("i")], "rank"),
        evaluation.running_totals(df.groupBy("s").agg(F.count("*").alias("n")), "s", {"upto": "n"}),
        pit.running_max(df, "s", "i", "most", id_="i"),
    ]
    assert all("isnotnull(transform" not in optimized(f) for f in found)


def test_the_second_order_reads_what_the_first_wrote(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 50)
    out = catalogue.QUERIES["o01_replay_sequence"](spark, SF)
    assert optimized(out).count("sha2(") == 0 and optimized(out).count("Window") <= 2
    assert sorted(map(tuple, out.collect())) == sorted(oracle("o01_replay_sequence"))


def test_auc_sums_ranks_in_the_pass_that_orders_them(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 50)
    out = catalogue.QUERIES["a12_auc"](spark, SF)
    assert optimized(out).count("Relation") == 1 and "Join" not in optimized(out)
    assert list(map(tuple, out.collect())) == oracle("a12_auc")


@pytest.mark.parametrize("n", [0, 1, 30, 700])
def test_auc_of_ties_and_unknown_labels(spark, monkeypatch, n):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 25)
    rows, df = scored(spark, n)
    got = evaluation.auc(df, "s", "y", "i").first()
    order = sorted(rows, key=lambda r: r[:2])
    p, q = [sum(r[2] is v for r in rows) for v in (True, False)]
    ranks = sum(k for k, r in enumerate(order, 1) if r[2])
    assert (got.positives or 0, got.negatives or 0) == (p, q)
    assert got.auc == (pytest.approx((ranks - p * (p + 1) / 2) / (p * q)) if p and q else None)


def test_only_the_range_of_the_last_row_is_ordered(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 50)
    out = catalogue.QUERIES["a15_precision_at_k"](spark, SF)
    assert "Join" not in optimized(out) and optimized(out).count("Relation") == 1
    assert list(map(tuple, out.collect())) == [pytest.approx(r) for r in oracle("a15_precision_at_k")]


@pytest.mark.parametrize("n, fraction", [(0, 0.1), (1, 0.01), (700, 0.001), (700, 0.05), (700, 0.5), (700, 1.0)])
def test_top_fraction_of_ties_and_unknown_labels(spark, monkeypatch, n, fraction):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 25)
    rows, df = scored(spark, n)
    top = sorted(rows, key=lambda r: (-r[0], r[1]))[: max(1, math.ceil(n * fraction))]
    known, positives = [r[2] for r in top if r[2] is not None], sum(bool(r[2]) for r in rows)
    got = evaluation.top_fraction(df, "s", "y", "i", fraction).first()
    assert got.k == len(top)
    assert got.precision_at_k == (pytest.approx(sum(known) / len(top)) if known else None)
    assert got.recall_at_k == (pytest.approx(sum(known) / positives) if known and positives else None)
