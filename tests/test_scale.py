"""What made queries slow or different on larger tables."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs, ranges
from tidemark.operators import evaluation, faults, point_in_time, running


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_order_keys_of_a_rank_are_worked_out_once_a_row(spark, monkeypatch):
    """The range of a row is looked up by some comparisons; none of them works the key out again."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", 100)
    rows = spark.range(2000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("k"))
    ranked = evaluation.global_rank(rows, [F.col("k"), F.col("id")], "rank")
    assert optimized(ranked).count("sha2(") <= 6
    assert [r.id for r in ranked.orderBy("rank").collect()] == [r.id for r in rows.orderBy("k", "id").collect()]


def test_rank_counts_hits_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 20)
    rows = spark.range(500).select("id", (F.col("id") * 7919 % 503).alias("s"), (F.col("id") % 3 == 0).alias("label"))
    got = evaluation.global_rank(rows, [F.col("s")], "rank", {"hits": F.col("label")}).orderBy("rank").collect()
    so_far = 0
    for k, r in enumerate(got, 1):
        so_far += r.label
        assert (r["rank"], r.hits) == (k, so_far)


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_out_of_order_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(faults, "BLOCK", block, raising=False)
    rng = random.Random(5)
    delivered = [rng.randrange(50) for _ in range(100)]
    placed = spark.createDataFrame(list(enumerate(delivered, 1)), "position long, delivered long")
    assert faults.out_of_order(placed).first()[0] == sum(a > b for a, b in zip(delivered, delivered[1:]))


def test_a_reordered_delivery_is_ranked_once(spark):
    sent = spark.range(300).select(F.col("id").alias("record_id"), (F.col("id") % 50).alias("scheduled"), F.lit(1).alias("attempt"), F.lit(0).alias("copy"), F.lit("sent").alias("fate"))
    placed = faults.reordered(sent, 20)
    assert optimized(placed).count("_range") == optimized(evaluation.global_rank(sent, [F.col(c) for c in ("scheduled", "record_id", "attempt", "copy")], "position")).count("_range")
    assert sorted(r.position for r in placed.collect()) == list(range(1, 301))


def test_doubles_are_rounded_as_the_sql_rounds_them(spark):
    """Ties: 2109.49 / 32 is 65.9215625, which is a little less as a double."""
    values = [k / 100 / n for k in range(210_900, 211_000) for n in (32, 64, 128)]
    want = [r[0] for r in duckdb.sql("SELECT round(x, 6) FROM (SELECT unnest(?) AS x)", params=[values]).fetchall()]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(exprs.rounded("x", 6)).collect()]
    assert got == want


def test_keys_that_are_not_hot_are_not_cut(spark, monkeypatch):
    """More rows than a part has, but no key of that size: one window and no join."""
    monkeypatch.setattr(running, "PART_ROWS", 100)
    rows = spark.range(3000).select((F.col("id") % 100).alias("k"), F.col("id").alias("t"), F.lit(1).cast("long").alias("x"))
    out = running.running(rows, ["k"], ["t"], {"n": ("sum", "x")})
    assert "Join" not in optimized(out)
    assert {(r.k, r.n) for r in out.where("t >= 2900").collect()} == {(k, 30) for k in range(100)}


def test_running_max_is_one_window_in_ranges_of_time(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 20)
    rng = random.Random(7)
    rows = [(k, rng.randrange(60), rng.randrange(1000)) for k in range(200)]
    out = point_in_time.running_max(spark.createDataFrame(rows, "id long, t long, x long"), "t", "x", "m", id_="id")
    assert optimized(out).count("Window [") <= 2
    assert {r.id: r.m for r in out.collect()} == {k: max(x for _, s, x in rows if s <= t) for k, t, _ in rows}
